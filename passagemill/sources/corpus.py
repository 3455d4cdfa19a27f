"""Readers and writers: corpora, topics, qrels, triples, metadata, result tables, quality caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_id
from ..operators.ranking import numbered

#: Names that a column may have, the first present one counts.
ALIASES = {"docno": ("pid", "docno", "docid", "doc_id", "passage_id"), "text": ("text", "passage", "body", "contents"), "label": ("label", "labels", "target", "y", "is_relevant", "relevance")}


def resolve(df: DataFrame, what: str) -> str:
    for name in ALIASES[what]:
        if name in df.columns:
            return name
    raise ValueError(f"no column for {what}: one of {', '.join(ALIASES[what])} is needed, there are {', '.join(df.columns)}")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """parquet, jsonl, csv, tsv or orc by the path's suffix (and .gz)."""
    kind = path.removesuffix(".gz").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    if kind in ("json", "jsonl"):
        return reader.json(path)
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    raise ValueError(f"no reader for {path}")


def spread(df: DataFrame, bytes_each: int = 32 << 20) -> DataFrame:
    """df, dealt to all cores where it has under bytes_each for each of them.

    A row group can't be split among tasks, so a small file of one row group is read by one core whatever
    follows. What is moved is bounded by bytes_each for a core; larger tables have row groups enough and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_each else df


def normalized(df: DataFrame, strict: bool = True, label: bool = False) -> DataFrame:
    """docno, text (and label) from any accepted names. strict: a blank id or null text is an error; else such rows go."""
    docno, text = F.trim(F.col(resolve(df, "docno")).cast("string")), F.col(resolve(df, "text"))
    cols: list[Column] = [docno.alias("docno"), text.alias("text")] + ([F.col(resolve(df, "label")).cast("int").alias("label")] if label else [])
    bad = F.coalesce(F.length(docno), F.lit(0)) == 0
    if not strict:
        return df.where(~bad & text.isNotNull()).select(*cols)
    cols[0] = F.when(bad, F.raise_error(F.lit("a passage has no id")).cast("string")).otherwise(docno).alias("docno")
    cols[1] = F.coalesce(text, F.raise_error(F.concat(F.lit("no text for "), docno)).cast("string")).alias("text")
    return df.select(*cols)


def rejects(df: DataFrame) -> DataFrame:
    """One row: passages with a blank id, and without text."""
    return df.agg(F.count_if(F.coalesce(F.length(F.trim(F.col(resolve(df, "docno")).cast("string"))), F.lit(0)) == 0).alias("blank_id"), F.count_if(F.col(resolve(df, "text")).isNull()).alias("no_text"))


def tab_fields(lines: DataFrame, names: list[str]) -> DataFrame:
    """Tab-separated fields of the column value, further ones dropped, bytes that aren't UTF-8 replaced; malformed is true where there are too few."""
    parts = F.split(F.make_valid_utf8("value"), "\t")
    return lines.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)), (F.size(parts) < len(names)).alias("malformed"))


def collection_tsv(spark: SparkSession, path: str) -> DataFrame:
    """docno, text, malformed; gzip is seen by the suffix."""
    return tab_fields(spark.read.text(path), ["docno", "text"])


def triple_examples(triples: DataFrame) -> DataFrame:
    """docno, passage, label: two examples of each triple (query, pos, neg) of texts."""
    pair = F.explode(F.array(F.struct(F.col("pos").alias("passage"), F.lit(1).alias("label")), F.struct(F.col("neg").alias("passage"), F.lit(0).alias("label"))))
    return triples.where(F.col("pos").isNotNull() & F.col("neg").isNotNull()).select(pair.alias("x")).select(text_id(F.col("x.passage")).alias("docno"), "x.passage", "x.label")


def hydrate_triples(triples: DataFrame, corpus: DataFrame) -> DataFrame:
    """qid, pos_pid, neg_pid with both texts; a text is null where the id is unknown, the least one where a docno repeats. Only passages that triples name are gathered."""
    ids = triples.select(F.explode(F.array("pos_pid", "neg_pid")).alias("docno")).distinct()
    known = corpus.join(ids, "docno", "left_semi").groupBy("docno").agg(F.min("text").alias("text"))
    side = lambda n: known.select(F.col("docno").alias(f"{n}_pid"), F.col("text").alias(f"{n}_text"))
    return triples.join(side("pos"), "pos_pid", "left").join(side("neg"), "neg_pid", "left")


def id_triple_examples(hydrated: DataFrame) -> DataFrame:
    ok = hydrated.where(F.col("pos_text").isNotNull() & F.col("neg_text").isNotNull())
    make = lambda n, v: F.struct(F.col(f"{n}_pid").alias("docno"), F.col(f"{n}_text").alias("passage"), F.lit(v).alias("label"))
    return ok.select(F.explode(F.array(make("pos", 1), make("neg", 0))).alias("x")).select("x.*")


def triple_source(spark: SparkSession, source: str, triples: str | DataFrame, corpus: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """docno, passage, label of the examples of training triples.

    source: 'text' (a tab-separated file: query, relevant, other), 'id' (a file of qid and two ids) or
    'pairs' (a table of pos_pid and neg_pid, the first ones of its id order where a cap is given).
    Ids need the corpus (docno, text). Malformed lines and unknown ids give no example.
    """
    if source == "text":
        return triple_examples(tab_fields(spark.read.text(triples), ["query", "pos", "neg"]).where("not malformed"))
    if source not in ("id", "pairs"):
        raise ValueError(f"no triples from {source}: text, id or pairs")
    if corpus is None:
        raise ValueError("triples of ids need a corpus")
    if source == "id":
        ids = tab_fields(spark.read.text(triples), ["qid", "pos_pid", "neg_pid"]).where("not malformed").drop("malformed")
    else:
        ids = window_of(triples, ["pos_pid", "neg_pid"], 0, first)
    return id_triple_examples(hydrate_triples(ids, corpus).where("pos_text <> '' and neg_text <> ''"))


def triple_statistics(hydrated: DataFrame) -> DataFrame:
    pos, neg = F.col("pos_text").isNull(), F.col("neg_text").isNull()
    malformed = F.count_if(F.col("pos_pid").isNull() | F.col("neg_pid").isNull() | (F.col("pos_text") == "") | (F.col("neg_text") == ""))
    return hydrated.agg(malformed.alias("malformed"), F.count(F.lit(1)).alias("triples"), F.count_if(~pos & ~neg).alias("valid"), F.count_if(pos | neg).alias("skipped"), F.count_if(pos).alias("missing_pos"), F.count_if(neg).alias("missing_neg"), (2 * F.count_if(~pos & ~neg)).alias("emitted"))


def targeted(corpus: DataFrame, qrels: DataFrame, min_label: int | None = None) -> DataFrame:
    """corpus with target: 1 for passages in qrels (of min_label or more, where given)."""
    ids = (qrels if min_label is None else qrels.where(F.col("label") >= min_label)).select("docno").distinct().withColumn("_t", F.lit(1))
    return corpus.join(ids, "docno", "left").select(*corpus.columns, F.coalesce("_t", F.lit(0)).alias("target"))


def target_statistics(rows: DataFrame) -> DataFrame:
    n, p = F.count(F.lit(1)), F.count_if(F.col("target") == 1)
    share = lambda x: F.round(100 * F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)), 6)
    return rows.agg(n.alias("total"), p.alias("positives"), (n - p).alias("negatives"), share(p).alias("positive_pct"), share(n - p).alias("negative_pct"))


def validate_targeted(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: rows, corpus_rows, positives, negatives of a targeted collection. Other targets than 0 and 1, a missing class or a size unlike the corpus's is an error."""
    one = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("target") == 1).alias("positives"), F.count_if(F.col("target") == 0).alias("negatives"))
    one = one.crossJoin(F.broadcast(corpus.agg(F.count(F.lit(1)).alias("corpus_rows"))))  # one row
    wrong = (
        F.when(F.col("positives") + F.col("negatives") != F.col("rows"), "a target is neither 0 nor 1")
        .when(F.col("positives") == 0, "no passage is a target")
        .when(F.col("negatives") == 0, "every passage is a target")
        .when(F.col("rows") != F.col("corpus_rows"), "the collection and the corpus differ in size")
    )
    return one.select(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(F.col("rows")).alias("rows"), "corpus_rows", "positives", "negatives")


def window_of(df: DataFrame, order: list[str], skip: int = 0, first: int | None = None) -> DataFrame:
    """The rows behind the first `skip` in an order, `first` of them: a bounded scan that doesn't depend on partitions."""
    if skip < 0 or first is not None and first < 0:
        raise ValueError("skip and first can't be negative")
    if first is not None:  # Spark keeps skip + first rows of each partition
        return df.orderBy(*order).offset(skip).limit(first)
    if not skip:
        return df.orderBy(*order)
    return numbered(df, [F.col(c) for c in order], "_place").where(F.col("_place") > skip).drop("_place").orderBy(*order)


def split_counts(qrels: DataFrame) -> DataFrame:
    """split, ids: distinct passages of each split and of their union."""
    each = qrels.groupBy("split").agg(F.count_distinct("docno").alias("ids"))
    return each.unionByName(qrels.agg(F.lit("union").alias("split"), F.count_distinct("docno").alias("ids")))


def write_tsv(df: DataFrame, path: str, header: bool = True, if_exists: str = "errorifexists") -> None:
    df.write.mode(if_exists).option("sep", "\t").option("header", header).csv(path)


def write_quality(scored: DataFrame, path: str, scorer: str) -> None:
    """The cache is keyed by docno and scorer, never by position; one scorer's partition is replaced at a time."""
    scored.withColumn("scorer", F.lit(scorer)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scorer").parquet(path)


def read_quality(spark: SparkSession, path: str, scorer: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("scorer") == scorer).drop("scorer")


def unscored(corpus: DataFrame, cache: DataFrame) -> DataFrame:
    """What a resumed run still has to score: by docno, so a crash between reading and writing loses nothing."""
    return corpus.join(cache.select("docno"), "docno", "left_anti")


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """docno from a text file (one a line) or a csv (column docno, else the first)."""
    if path.endswith(".csv"):
        df = spark.read.option("header", True).csv(path)
        return df.select(F.col("docno" if "docno" in df.columns else df.columns[0]).alias("docno"))
    return spark.read.text(path).select(F.trim("value").alias("docno")).where(F.length("docno") > 0)


#: How result files are named.
RUN_FILE = r"compare_all_(.+?)_(dev[._]small|test-\d{4}(?:_test-\d{4})*)_([0-9.]+?)(?:_perquery_wide)?\.csv$"


def run_keys(name: Column) -> list[Column]:
    """experiment, qrels_variant (dev_small is read as dev.small) and threshold from a result file's name; another name is an error."""
    known = F.when(F.rlike(name, F.lit(RUN_FILE)), name).otherwise(F.raise_error(F.concat(F.lit("not a result file's name: "), name)).cast("string"))
    variant = F.replace(F.regexp_extract(known, RUN_FILE, 2), F.lit("dev_small"), F.lit("dev.small"))
    return [F.regexp_extract(known, RUN_FILE, 1).alias("experiment"), variant.alias("qrels_variant"), F.try_to_number(F.regexp_extract(known, RUN_FILE, 3), F.lit("9.9999999999")).cast("double").alias("threshold")]


def results_csv(spark: SparkSession, glob: str, exclude: tuple[str, ...] = ("_perquery_", "_timings")) -> DataFrame:
    """Result files of a glob with keys from their names."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(glob).select("*", F.col("_metadata.file_name").alias("file_name"))
    for part in exclude:
        df = df.where(~F.contains("file_name", F.lit(part)))
    return df.select("*", *run_keys(F.col("file_name")))

"""Retrieval effectiveness: measures by query, wide and paired tables, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("RR@10", "nDCG@10", "R@100")


def usable_topics(topics: DataFrame, qrels: DataFrame) -> DataFrame:
    """Topics with qrels and a query that cleaning leaves, the first of each qid."""
    from ..functions.text import clean_query

    kept = first_rows(topics, ["qid"], ["query"]).withColumn("query", clean_query(F.col("query"))).where(F.length("query") > 0)
    return kept.join(qrels.select("qid").distinct(), "qid", "left_semi")


def shared_ids(a: DataFrame, b: DataFrame, column: str = "docno") -> DataFrame:
    """Ids that both have, each once."""
    return a.select(column).intersect(b.select(column))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order: which one stays doesn't depend on partitions."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repeated_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All members of key groups with several rows."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")


def per_query(run: DataFrame, qrels: DataFrame, name: str) -> DataFrame:
    """name, qid, measure, value for every query with qrels; queries without results have 0. run: qid, docno, rank; qrels: qid, docno, label."""
    judged = qrels.where(F.col("label") > 0)
    ideal = judged.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("label"), "docno")))
    gain = lambda label, rank: label / F.log2(rank + 1)
    total = ideal.groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("r") <= 10, gain(F.col("label"), F.col("r")))).alias("idcg"))
    hits = run.join(judged, ["qid", "docno"]).groupBy("qid").agg(
        F.min("rank").alias("best"), F.sum(F.when(F.col("rank") <= 10, gain(F.col("label"), F.col("rank"))).otherwise(0.0)).alias("dcg"), F.sum((F.col("rank") <= 100).cast("long")).alias("found")
    )
    out = qrels.select("qid").distinct().join(total, "qid", "left").join(hits, "qid", "left")
    values = {"RR@10": F.when(F.col("best") <= 10, 1 / F.col("best")), "nDCG@10": F.try_divide("dcg", "idcg"), "R@100": F.try_divide("found", "relevant")}
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.coalesce(v, F.lit(0.0)).alias("value")) for m, v in values.items())))
    return out.select("qid", rows.alias("x")).select(F.lit(name).alias("name"), "qid", "x.measure", "x.value")


def means(long: DataFrame) -> DataFrame:
    return long.groupBy("name", "measure").agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n_queries"))


def wide(long: DataFrame, names: list[str], measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """qid and a column name__measure for each: the values are given, so Spark needs no job to find them."""
    columns = [f"{n}__{m}" for n in names for m in measures]
    return long.withColumn("_c", F.concat_ws("__", "name", "measure")).groupBy("qid").pivot("_c", columns).agg(F.avg("value"))


def paired(long: DataFrame, full: str, pruned: str) -> DataFrame:
    """qid, measure, value_full, value_pruned and both differences of queries that both systems have."""
    pick = lambda name, to: long.where(F.col("name") == name).select("qid", "measure", F.col("value").alias(to))
    both = pick(full, "value_full").join(pick(pruned, "value_pruned"), ["qid", "measure"])
    return both.select("*", (F.col("value_full") - F.col("value_pruned")).alias("diff_full_minus_pruned"), (F.col("value_pruned") - F.col("value_full")).alias("diff_pruned_minus_full"))


def coverage(long: DataFrame, topics: DataFrame) -> DataFrame:
    """measure, name and how many queries are expected, present, missing, extra, repeated."""
    groups = long.select("measure", "name").distinct()
    expected = groups.crossJoin(F.broadcast(topics.agg(F.count_distinct("qid").alias("expected_queries"))))  # one row
    known = topics.select("qid").distinct().withColumn("_known", F.lit(1))
    seen = long.where(F.col("value").isNotNull()).groupBy("measure", "name", "qid").agg(F.count(F.lit(1)).alias("n")).join(known, "qid", "left")
    count = lambda p: F.sum(p.cast("long"))
    got = seen.groupBy("measure", "name").agg(count(F.col("_known").isNotNull()).alias("present_queries"), count(F.col("_known").isNull()).alias("extra_queries"), count(F.col("n") > 1).alias("duplicated_queries"))
    out = expected.join(got, ["measure", "name"], "left").na.fill(0, ["present_queries", "extra_queries", "duplicated_queries"])
    missing = F.col("expected_queries") - F.col("present_queries")
    return out.select("*", missing.alias("missing_queries"), (100 * F.try_divide(missing, F.col("expected_queries"))).alias("missing_percentage"))


def timings(name: str, queries: int, seconds: float) -> dict:
    return {"name": name, "num_queries": queries, "runtime_seconds": seconds, "ms_per_query": 1000 * seconds / queries if queries else None, "queries_per_second": queries / seconds if seconds else None}

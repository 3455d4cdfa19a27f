"""Result tables: names in one form, choice of scorers and metrics, sorted reports, documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .effectiveness import first_rows

#: Other spellings of metrics and pipelines, without case and spaces (pipelines also without - and _).
METRIC_NAMES = {
    "rr@10": "RR@10", "rr(rel=1)@10": "RR@10", "recip_rank@10": "RR@10", "reciprank@10": "RR@10", "ndcg@10": "nDCG@10", "ndcg_cut_10": "nDCG@10",
    "r@100": "R@100", "recall@100": "R@100", "recall_100": "R@100",
}
PIPELINE_NAMES = {"bm25": "BM25", "splade": "SPLADE", "tasb": "TAS-B"}


def _renamed(name: Column, names: dict[str, str], without: str) -> Column:
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.element_at(known, F.regexp_replace(F.lower(F.trim(name)), without, "")), F.trim(name))


def metric_name(name: Column) -> Column:
    return _renamed(name, METRIC_NAMES, " ")


def pipeline_name(name: Column) -> Column:
    return _renamed(name, PIPELINE_NAMES, "[ _-]")


def qrels_name(name: Column) -> Column:
    """dev_small is read as dev.small; a blank name is null and never a default."""
    return F.nullif(F.replace(F.trim(name), F.lit("dev_small"), F.lit("dev.small")), F.lit(""))


def threshold_key(threshold: Column) -> Column:
    """A threshold that is the same whichever file it was read from."""
    return F.round(threshold.cast("double"), 10)


def scorer_key(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), "_{2,}", "_")


def headline_metric(qrels: Column, always_rr: bool = False) -> Column:
    """RR@10 for the small development topics, nDCG@10 for others."""
    low = F.lower(F.coalesce(qrels, F.lit("")))
    return F.lit("RR@10") if always_rr else F.when(F.contains(low, F.lit("dev.small")) | F.contains(low, F.lit("dev_small")), "RR@10").otherwise("nDCG@10")


def split_variants(results: DataFrame, family: str, variants: dict[str, str]) -> DataFrame:
    """Rows of an older form, scorer = family and qrels_variant = <variant>_<qrels>, with the variant's own scorer and the qrels alone. The first variant that fits counts."""
    qrels, scorer, rest = qrels_name(F.col("qrels_variant")), F.col("scorer"), qrels_name(F.col("qrels_variant"))
    for variant, name in reversed(variants.items()):
        fits = (F.trim("scorer") == family) & F.startswith(qrels, F.lit(f"{variant}_"))
        scorer = F.when(fits, F.lit(name)).otherwise(scorer)
        rest = F.when(fits, F.substring(qrels, len(variant) + 2, 1 << 20)).otherwise(rest)
    return results.withColumns({"scorer": scorer, "qrels_variant": rest})


#: A table of scorers: its columns. cache_patterns hold {dataset_name}; place orders the scorers.
SCORER_TABLE = "place int, name string, label string, aliases array<string>, cache_patterns array<string>, `group` string, enabled boolean, higher_is_better boolean"


def resolve_scorers(rows: DataFrame, scorers: DataFrame, column: str = "scorer") -> DataFrame:
    """rows with canonical: the scorer's own name for a name or an alias. The name itself counts first, then the first scorer in order with the alias; null for others."""
    named = scorers.select(F.col("name").alias("_key"), F.lit(0).alias("_kind"), F.col("place").alias("_place"), "name")
    other = scorers.select(F.explode("aliases").alias("_alias"), "place", "name").select(F.lower(scorer_key(F.col("_alias"))).alias("_low"), F.col("place").alias("_place"), "name")
    exact = first_rows(named, ["_key"], ["_place"]).select("_key", F.col("name").alias("_exact"))
    alias = first_rows(other, ["_low"], ["_place"]).select("_low", F.col("name").alias("_other"))
    keyed = rows.withColumn("_key", scorer_key(F.col(column))).withColumn("_low", F.lower("_key"))
    return keyed.join(exact, "_key", "left").join(alias, "_low", "left").select(*rows.columns, F.coalesce("_exact", "_other").alias("canonical"))


def _fits_any(scorer: list[Column], filters: list[str]) -> Column:
    any_of = F.lit(False)
    for f in filters:
        any_of = any_of | F.exists(F.array_compact(F.flatten(F.array(*scorer))), lambda c: F.contains(F.lower(c), F.lit(f.lower())))
    return any_of


def select_scorers(scorers: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, group: str | None = None, only_enabled: bool = True) -> DataFrame:
    """Enabled scorers; with include those it names, enabled or not, by part of a name, a label or an alias in any case. exclude always takes away."""
    names = [F.array("name", F.coalesce("label", "name")), F.coalesce("aliases", F.array().cast("array<string>"))]
    keep = F.lit(True) if group is None else F.col("group") == group
    keep = keep & (_fits_any(names, include) if include is not None else F.coalesce("enabled", F.lit(False)) if only_enabled else F.lit(True))
    return scorers.where(keep & ~_fits_any(names, exclude or []))


def scorer_of_cache(files: DataFrame, scorers: DataFrame, dataset: str) -> DataFrame:
    """files (file_name) with scorer: the first one whose cache pattern gives the name for this dataset; null if none."""
    made = scorers.select(F.explode("cache_patterns").alias("_p"), "place", "name").select(F.replace("_p", F.lit("{dataset_name}"), F.lit(dataset)).alias("file_name"), "place", F.col("name").alias("scorer"))
    return files.join(first_rows(made, ["file_name"], ["place"]).drop("place"), "file_name", "left").select(*files.columns, "scorer")


def sorted_report(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows in one order; a leading - sorts a column downwards. Nulls come last."""
    return df.orderBy(*(F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in by))


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """A row's columns as one JSON document, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_report(df: DataFrame, path: str, kind: str = "csv", force: bool = False) -> None:
    """csv, tsv, json, parquet or orc. What is there is an error unless force replaces it."""
    out = df.write.mode("overwrite" if force else "errorifexists")
    if kind in ("csv", "tsv"):
        out.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind in ("json", "parquet", "orc"):
        out.format(kind).save(path)
    else:
        raise ValueError(f"no writer for {kind}")


def write_bundle(tables: dict[str, DataFrame], path: str, force: bool = False) -> None:
    """Named tables (curves, scalers) under one folder, as Parquet."""
    for name, df in tables.items():
        write_report(df, f"{path}/{name}", "parquet", force)


def read_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_config(spark: SparkSession, config: dict, path: str, force: bool = False) -> None:
    """A configuration as one JSON document, which YAML readers take, too."""
    text = json.dumps(config, indent=2, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite" if force else "errorifexists").text(path)


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).where(F.length("value") > 0).first()["value"])


def result_file(experiment: Column, qrels: Column, threshold: Column, kind: str = "") -> Column:
    """The name of a result file (kind: '', 'perquery_wide' or 'timings'), which sources.corpus.run_keys takes apart."""
    return F.concat(F.lit("compare_all_"), experiment, F.lit("_"), qrels, F.lit("_"), threshold.cast("string"), F.lit(f"_{kind}.csv" if kind else ".csv"))


def run_folder(base: str, *parts: Column) -> Column:
    """Where a system's runs are kept: a folder of safe names below base."""
    from ..functions.text import safe_file_name

    return F.concat_ws("/", F.lit(base.rstrip("/")), *(safe_file_name(p) for p in parts))

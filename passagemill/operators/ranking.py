"""Exact global ranks, running sums and quantiles without one task that sorts everything.

Rows are dealt to ranges of the whole order, key and tie together, by Spark's range partitioning (its
cut points are rows of a sample, whatever their types and prefixes), and written with their range. The
ranges' totals, one row for each, are added up, and windows run inside ranges. Any cut points give the
exact result. There are as many ranges as rows ask for, so a key of any frequency fills many small
ones where a tie tells its rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize

ROWS = 200_000  #: rows that a range should have
SMALL = 1_000_000  #: distinct keys whose ranks are sent to all executors; beyond it they are joined


def ranged(df: DataFrame, order: list[Column], rows: int | None = None) -> DataFrame:
    """df, written, with _range: the ranges follow each other in the order. Rows that are equal in it are in one range."""
    n = df.count() if rows is None else rows
    ranges = n // ROWS + 1
    return materialize(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, key: str, sums: dict[str, str], ascending: bool = True, ties: str | None = None) -> DataFrame:
    """df with columns of running sums: sums maps new names to summed columns. Equal keys share a sum unless ties orders them; null keys come last."""
    order = [F.col(key).asc_nulls_last() if ascending else F.col(key).desc_nulls_last()] + ([F.col(ties).asc()] if ties else [])
    return _running(df, order, sums, bool(ties))


def _running(df: DataFrame, order: list[Column], sums: dict[str, str], apart: bool, rows: int | None = None) -> DataFrame:
    made = ranged(df, order, rows)
    inside = Window.partitionBy("_range").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0) if apart else inside.rangeBetween(Window.unboundedPreceding, 0)
    totals = made.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *(F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_b_{n}") for n in sums))
    out = made.join(F.broadcast(before), "_range")  # a row for each range
    return out.select(*df.columns, *((F.sum(c).over(inside) + F.col(f"_b_{n}")).alias(n) for n, c in sums.items()))


def numbered(df: DataFrame, order: list[Column], name: str = "rank", rows: int | None = None) -> DataFrame:
    """df with its exact 1-based place in an order; rows that are equal in it get different places. rows: how many there are, where that is known."""
    return _running(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}, True, rows).drop("_one")


def global_rank(df: DataFrame, key: str, tie: str, name: str = "rank", ascending: bool = True, rows: int | None = None) -> DataFrame:
    """df with its exact 1-based rank by key, then tie; null keys come last."""
    return numbered(df, [F.col(key).asc_nulls_last() if ascending else F.col(key).desc_nulls_last(), F.col(tie).asc()], name, rows)


def counted_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys without null, their rows, and the rows up to them."""
    return running_sums(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, {"_upto": "_n"})


def average_rank(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the rank of key in which ties share their mean; ranks are made over distinct keys. Rows without a key go."""
    return with_average_rank(df, counted_keys(df, key), key, name)


def with_average_rank(df: DataFrame, counted: DataFrame, key: str, name: str) -> DataFrame:
    """df with the mean rank of key, from counted_keys() of all rows: sent where keys are few, so that a frequent key's rows stay where they are."""
    ranks = materialize(counted.select(key, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name)), "mean-ranks")
    return df.join(F.broadcast(ranks) if ranks.count() <= SMALL else ranks, key)


def quantile(df: DataFrame, key: str, fraction: float, name: str) -> DataFrame:
    """One row: the exact quantile with linear interpolation, from running counts of distinct keys; null without any key."""
    groups = counted_keys(df, key)
    at = F.col("_total") * F.lit(fraction) - F.lit(fraction)  # (total - 1) * fraction
    holds = lambda rank: (F.col("_upto") - F.col("_n") < rank) & (rank <= F.col("_upto"))
    total = F.broadcast(df.agg(F.count(key).alias("_total")))  # one row
    both = groups.crossJoin(total).agg(F.max(F.when(holds(F.floor(at) + 1), F.col(key))).alias("low"), F.max(F.when(holds(F.ceil(at) + 1), F.col(key))).alias("high"), F.max(at - F.floor(at)).alias("part"))
    return both.select((F.col("low") + F.col("part") * (F.coalesce("high", "low") - F.col("low"))).alias(name))

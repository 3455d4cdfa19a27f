"""Tests and comparisons across systems and scorers: non-inferiority, retained effectiveness, areas, ranks, fronts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.student import t_critical, t_tail

#: Relative margin, level, and the upper bound that makes the test one-sided.
MARGIN, ALPHA, UPPER = 0.05, 0.05, 1e6


def paired_moments(pairs: DataFrame, keys: list[str], margin: float = MARGIN) -> DataFrame:
    """n, means, deviation of pruned - full, and the lower bound, of pairs with both sides; groups under two pairs have no row."""
    ok = pairs.where(F.col("value_full").isNotNull() & F.col("value_pruned").isNotNull())
    d = F.col("value_pruned") - F.col("value_full")
    out = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_queries"), F.avg("value_full").alias("mean_full"), F.avg("value_pruned").alias("mean_pruned"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    return out.where("n_queries >= 2").withColumn("lower_bound_absolute", -margin * F.col("mean_full"))


def t_statistic(mean: Column, bound: Column, sd: Column, n: Column) -> Column:
    """(mean - bound) over its standard error; without variance plus or minus infinity, 0 at the bound itself."""
    gap = mean - bound
    sign = F.when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf"))).otherwise(0.0)
    return F.coalesce(F.try_divide(gap, sd / F.sqrt(n)), sign)


def noninferiority(pairs: DataFrame, keys: list[str], margin: float = MARGIN, alpha: float = ALPHA) -> DataFrame:
    """The paired one-sided test that pruned isn't worse than full by the margin, with its interval and three flags."""
    x = paired_moments(pairs, keys, margin)
    n = F.col("n_queries")
    x = x.withColumn("t_noninferiority", t_statistic(F.col("mean_diff"), F.col("lower_bound_absolute"), F.col("sd_diff"), n)).withColumn("df_noninferiority", (n - 1).cast("double"))
    x = x.withColumn("p_noninferiority", t_tail("t_noninferiority", "df_noninferiority")).withColumn("_c", t_critical(F.lit(1 - alpha / 2), "df_noninferiority"))
    half = F.col("_c") * F.col("sd_diff") / F.sqrt(n)
    return x.select(
        "*", (F.col("mean_diff") - half).alias("ci95_low"), (F.col("mean_diff") + half).alias("ci95_high"), F.lit(-margin).alias("lower_bound_relative"), F.lit(UPPER).alias("upper_bound_absolute"),
        (F.col("p_noninferiority") < alpha).alias("passes"), (F.col("mean_diff") > F.col("lower_bound_absolute")).alias("margin_respected_by_mean"), (F.col("mean_diff") - half > F.col("lower_bound_absolute")).alias("margin_respected_by_ci"),
    ).drop("_c")


def against_baseline(results: DataFrame, baseline: str, keys: list[str]) -> DataFrame:
    """delta_value and retained of each row against the baseline scorer at the same keys and pruning level (rounded to 8 places)."""
    keyed = results.withColumn("pruning_key", F.round("pruning_percent", 8))
    base = keyed.where(F.col("scorer") == baseline).groupBy(*keys, "pruning_key").agg(F.avg("value").alias("baseline_value"))
    out = keyed.join(base, [*keys, "pruning_key"], "left")
    safe = F.when(F.abs("baseline_value") > 1e-8, F.col("baseline_value"))
    return out.select("*", (F.col("value") - F.col("baseline_value")).alias("delta_value"), F.try_divide(F.col("value"), safe).alias("retained"))


def ranks(results: DataFrame, keys: list[str], without: str | None = None) -> DataFrame:
    """rank of value, best first, ties sharing the best rank."""
    kept = results.where(F.col("scorer") != without) if without else results
    return kept.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("value"))))


def pruning_area(retained: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoid area of retained over pruning, divided by its range; a single level gives the mean."""
    ok = retained.where(F.col("retained").isNotNull()).withColumn("x", F.col("pruning_percent") / 100)
    w = Window.partitionBy(*keys).orderBy("x", "retained")
    step = ok.withColumn("_a", (F.col("x") - F.lag("x").over(w)) * (F.col("retained") + F.lag("retained").over(w)) / 2)
    out = step.groupBy(*keys).agg(F.sum("_a").alias("_s"), (F.max("x") - F.min("x")).alias("_r"), F.avg("retained").alias("mean_retained"), F.min("retained").alias("min_retained"))
    return out.select(*keys, F.coalesce(F.try_divide("_s", "_r"), F.col("mean_retained")).alias("aupc_retained"), "mean_retained", "min_retained")


def safe_pruning(retained: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """The highest pruning level that passes, as any level and as the last before the first failure; 0 if none."""
    x = retained.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    first_bad = F.min(F.when(~F.col("_ok"), F.col("pruning_percent"))).over(Window.partitionBy(*keys))
    x = x.withColumn("_bad", first_bad)
    top = lambda p: F.coalesce(F.max(F.when(p, F.col("pruning_percent"))), F.lit(0.0))
    return x.groupBy(*keys).agg(top(F.col("_ok")).alias("max_any"), top(F.col("_ok") & (F.col("_bad").isNull() | (F.col("pruning_percent") < F.col("_bad")))).alias("max_contiguous"))


def pareto_front(points: DataFrame, keys: list[str], x: str = "pruning_percent", y: str = "value") -> DataFrame:
    """Points that no other of their group dominates (as far on both axes and farther on one); equal points stay together."""
    by_x = points.groupBy(*keys, x).agg(F.max(y).alias("_top"))
    beyond = Window.partitionBy(*keys).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1)
    best = by_x.withColumn("_beyond", F.max("_top").over(beyond))
    return points.join(best, [*keys, x]).where((F.col(y) == F.col("_top")) & (F.col("_beyond").isNull() | (F.col(y) > F.col("_beyond")))).drop("_top", "_beyond")


def heatmap(results: DataFrame, levels: list[float]) -> DataFrame:
    """scorer by pruning level, means."""
    return results.groupBy("scorer").pivot("pruning_percent", levels).agg(F.avg("value"))


def unpivot_metrics(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(ids, metrics, "metric", "value")


def one_full_value(results: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Each key's full-collection value, and whether it is one value within the tolerance."""
    out = results.groupBy(*keys).agg(F.min("mean_full").alias("lo"), F.max("mean_full").alias("hi"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "n", F.col("lo").alias("mean_full"), ((F.col("hi") - F.col("lo")) <= tolerance).alias("consistent"))


def with_flags(results: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """A left join with test flags that must be unique by key; rows without a test get matched = false."""
    counted = flags.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first("equivalent").alias("equivalent"))
    checked = counted.withColumn("equivalent", F.when(F.col("_n") == 1, F.col("equivalent")).otherwise(F.raise_error(F.lit("several tests for one result")).cast("boolean")))
    return results.join(checked, keys, "left").select(*results.columns, F.coalesce("equivalent", F.lit(False)).alias("equivalent"), F.col("_n").isNotNull().alias("matched"))


def close(a: Column, b: Column, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, width: Column | float, how: str = "inner") -> DataFrame:
    """Rows with equal keys whose a and b lie within width of each other, and some that lie within three: the caller tests.

    The values are cut into cells as wide as the tolerance, and a right row goes to its own and both
    neighbours, so a key with many values is many small groups. Columns of both sides must differ but for keys.
    """
    w = F.lit(width) if isinstance(width, (int, float)) else width
    cell = lambda c: F.floor(F.col(c) / w)
    near = right.withColumn("_cell", F.explode(F.array(cell(b) - 1, cell(b), cell(b) + 1)))
    return left.withColumn("_cell", cell(a)).join(near, [*keys, "_cell"], how).drop("_cell")


def with_close_flags(results: DataFrame, flags: DataFrame, keys: list[str], absolute: float = 1e-8, relative: float = 1e-5) -> DataFrame:
    """Flags whose threshold is close, taken only where exactly one candidate fits; equal flags are several."""
    r = results.withColumn("_row", F.monotonically_increasing_id())  # equal rows are rows of their own
    f = flags.groupBy(*keys, F.col("threshold").alias("_t")).agg(F.count(F.lit(1)).alias("_c"), F.max("equivalent").alias("_e")).where(F.col("_t").isNotNull())
    largest = f.agg(F.coalesce(F.max(F.abs("_t")), F.lit(0.0)).alias("m")).first()["m"]  # the widest tolerance
    near = close(F.col("threshold"), F.col("_t"), absolute, relative)
    hit = band_join(r.select("_row", *keys, "threshold"), f, keys, "threshold", "_t", absolute + relative * largest).where(near)
    one = hit.groupBy("_row").agg(F.sum("_c").alias("_n"), F.max("_e").alias("_e")).where("_n = 1")
    return r.join(one, "_row", "left").select(*results.columns, F.col("_e").alias("equivalent"))


#: Tolerances of resolve_variants: of thresholds, and of the full collection's mean (absolute, relative).
SAME_THRESHOLD, SAME_MEAN = 1e-10, (1e-10, 1e-7)


def resolve_variants(tests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """tests with a qrels_variant for the rows that lack one, where results allow one variant alone; rows that stay without one are kept as null.

    A result is a candidate if its keys are equal, its threshold is the same within SAME_THRESHOLD, and,
    where the test names a mean_full, its mean_full is close to that.
    """
    t = tests.withColumn("_row", F.monotonically_increasing_id())
    asked = t.where(F.col("qrels_variant").isNull() & F.col("threshold").isNotNull()).select("_row", *keys, "threshold", F.when(~F.isnan("mean_full"), F.col("mean_full")).alias("mean_full"))
    # equal questions and equal answers meet once
    cases = asked.groupBy(*keys, "threshold", "mean_full").agg(F.min("_row").alias("_case"))
    answers = results.where(F.col("qrels_variant").isNotNull()).select(*keys, F.col("threshold").alias("_t"), F.col("mean_full").alias("_m"), F.col("qrels_variant").alias("_q")).distinct()
    hit = band_join(cases, answers, keys, "threshold", "_t", SAME_THRESHOLD)
    same = (F.abs(F.col("threshold") - F.col("_t")) <= SAME_THRESHOLD) & (F.col("mean_full").isNull() | F.coalesce(close(F.col("_m"), F.col("mean_full"), *SAME_MEAN), F.lit(False)))
    found = hit.where(same).groupBy("_case").agg(F.count_distinct("_q").alias("_n"), F.min("_q").alias("_found")).where("_n = 1")
    named = cases.join(found, "_case").select(*keys, "threshold", "mean_full", "_found")
    equal = F.lit(True)
    for c in (*keys, "threshold", "mean_full"):
        equal = equal & asked[c].eqNullSafe(named[c])
    resolved = asked.join(named, equal).select("_row", "_found")
    return t.join(resolved, "_row", "left").select(*(F.coalesce("qrels_variant", "_found").alias(c) if c == "qrels_variant" else F.col(c) for c in tests.columns))

"""Dropping low-quality passages, and what labels say about the loss."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import window_of
from ..tables import materialize
from .ranking import global_rank, numbered, quantile, running_sums, with_average_rank

FRACTIONS = (0.0, 0.15, 0.25, 0.3, 0.45, 0.6)


def check_fractions(fractions: tuple[float, ...] | list[float]) -> list[float]:
    out = [float(x) for x in fractions]
    if not out or any(not 0 <= x <= 1 for x in out):
        raise ValueError("prune fractions must be from 0 to 1, and at least one")
    return out


def prune_by_threshold(scored: DataFrame, fraction: float, inclusive: bool = True, exact: bool = True) -> DataFrame:
    """Passages at or above (inclusive) or above the score's quantile; exact or, for very many passages, approximate."""
    scored = written(scored)
    cut = F.broadcast(quantile(scored, "quality", fraction, "_t") if exact else scored.agg(F.percentile_approx("quality", fraction, 10_000).alias("_t")))  # one row
    return scored.crossJoin(cut).where(F.col("quality") >= F.col("_t") if inclusive else F.col("quality") > F.col("_t")).drop("_t")


def written(scored: DataFrame) -> DataFrame:
    """scored as a written table, if it isn't one: ranks read it more than once."""
    return scored if hasattr(scored, "written_at") else materialize(scored, "scored")


def with_prune_rank(scored: DataFrame) -> DataFrame:
    """scored with rank (1: worst; ties by docno; without a score last) and total."""
    scored = written(scored)
    total = scored.count()
    return global_rank(scored, "quality", "docno", rows=total).withColumn("total", F.lit(total))


def prune_fraction(scored: DataFrame, fraction: float) -> DataFrame:
    """Drop exactly the worst n * fraction passages, rounded half to even."""
    return with_prune_rank(scored).where(F.col("rank") > F.bround(F.col("total") * fraction)).drop("rank", "total")


def pruning_metrics(scored: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """A row for each fraction: threshold, what is kept and pruned of both labels, and four rates. scored: docno, quality, label."""
    fractions = check_fractions(fractions)
    ranked = with_prune_rank(scored)
    exploded = ranked.select("*", F.explode(F.array(*map(F.lit, fractions))).alias("prune_fraction"))
    gone = F.col("rank") <= F.bround(F.col("total") * F.col("prune_fraction"))
    count = lambda p: F.sum(p.cast("long"))
    pos, neg = F.col("label") == 1, F.col("label") == 0
    out = exploded.groupBy("prune_fraction").agg(
        F.coalesce(F.max(F.when(gone, F.col("quality"))), F.lit(float("-inf"))).alias("threshold"), F.count(F.lit(1)).alias("total"), count(gone).alias("n_pruned"),
        count(pos).alias("total_positive"), count(neg).alias("total_negative"), count(pos & ~gone).alias("positives_kept"), count(pos & gone).alias("positives_pruned"), count(neg & ~gone).alias("negatives_kept"), count(neg & gone).alias("negatives_pruned"),
    )
    out = out.withColumn("total_positive", F.when((F.col("total_positive") > 0) & (F.col("total_negative") > 0), F.col("total_positive")).otherwise(F.raise_error(F.lit("both labels are needed")).cast("long")))
    return out.select(
        "*", (F.col("total") - F.col("n_pruned")).alias("n_kept"),
        (F.col("positives_kept") / F.col("total_positive")).alias("kept_positive_rate"), (F.col("negatives_pruned") / F.col("total_negative")).alias("removed_negative_rate"),
        (F.col("positives_pruned") / F.col("total_positive")).alias("positive_loss"), (F.col("negatives_kept") / F.col("total_negative")).alias("kept_negative_rate"),
    )


def roc_points(scored: DataFrame) -> DataFrame:
    """score, fpr, tpr at each distinct score, from the best down. scored: quality, label."""
    groups = written(scored).groupBy("quality").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") == 0).cast("long")).alias("n"))
    totals = F.broadcast(groups.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")))  # one row
    cum = running_sums(groups, "quality", {"cp": "p", "cn": "n"}, ascending=False)
    return cum.crossJoin(totals).select("quality", F.try_divide("cn", "all_n").alias("fpr"), F.try_divide("cp", "all_p").alias("tpr"))


def auc(scored: DataFrame) -> DataFrame:
    """One row: area under the curve by rank sums, ties counting half; null with one label only."""
    is_ = lambda v: F.sum((F.col("label") == v).cast("long"))
    groups = written(scored).where(F.col("quality").isNotNull()).groupBy("quality").agg(F.count(F.lit(1)).alias("c"), is_(1).alias("pos"), is_(0).alias("neg"))
    ranked = running_sums(groups, "quality", {"upto": "c"})  # a row for each score: no row meets its score again
    out = ranked.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("upto") - (F.col("c") - 1) / 2)).alias("s"))
    return out.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p").cast("double") * F.col("n")).alias("auc"))


def score_summary(scored: DataFrame) -> DataFrame:
    """AUC, accuracy at the median, and mean, population deviation, extremes of each label's scores, with their gap."""
    scored = written(scored)
    cut = F.broadcast(quantile(scored, "quality", 0.5, "m"))  # one row
    out = scored.crossJoin(cut)
    pick = lambda v: F.when(F.col("label") == v, F.col("quality"))
    stats = out.agg(
        F.avg(((F.col("quality") >= F.col("m")).cast("int") == F.col("label")).cast("double")).alias("accuracy"),
        *(f(pick(v)).alias(f"{name}_{kind}") for v, kind in ((1, "pos"), (0, "neg")) for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))),
    )
    return stats.crossJoin(F.broadcast(auc(scored))).withColumn("gap", F.col("mean_pos") - F.col("mean_neg"))


def delta_tpr(points: DataFrame, base: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """grid fpr, tpr of both curves by linear interpolation, and their difference. The grid is a parameter of fixed size."""
    return _at(points, grid, "tpr").join(_at(base, grid, "base_tpr"), "fpr").withColumn("delta_tpr", F.col("tpr") - F.col("base_tpr"))


def _at(points: DataFrame, grid: tuple[float, ...], name: str) -> DataFrame:
    """Interpolated tpr at each grid point: the last curve point at or before it and the first behind it."""
    spark = points.sparkSession
    start = spark.createDataFrame([(0.0, 0.0)], "fpr double, tpr double")
    curve = points.select("fpr", "tpr").unionByName(start)
    aggs = []
    for i, g in enumerate(grid):
        aggs += [F.max(F.when(F.col("fpr") <= g, F.struct("fpr", "tpr"))).alias(f"a{i}"), F.min(F.when(F.col("fpr") > g, F.struct("fpr", "tpr"))).alias(f"b{i}")]
    one = curve.agg(*aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(float(g)).alias("g"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")) for i, g in enumerate(grid))))
    x = one.select(rows.alias("x")).select("x.*")
    slope = F.coalesce(F.try_divide(F.col("b.tpr") - F.col("a.tpr"), F.col("b.fpr") - F.col("a.fpr")), F.lit(0.0))
    return x.select(F.col("g").alias("fpr"), (F.col("a.tpr") + slope * (F.col("g") - F.col("a.fpr"))).alias(name))


def correlations(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson, Spearman (Pearson of mean ranks), MAE, RMSE, largest difference over finite pairs; a constant side has no correlation (null)."""
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    ok = written(pairs.where(finite(a) & finite(b)).select(F.col(a).alias("x"), F.col(b).alias("y")))
    d = F.abs(F.col("x") - F.col("y"))
    plain = ok.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("pearson"), F.avg(d).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(d).alias("max_abs"))
    # equal pairs are one row with a weight, and both sides' mean ranks have the mean (n + 1) / 2
    pairs = materialize(ok.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")), "pairs")
    keys = lambda k: running_sums(pairs.groupBy(k).agg(F.sum("c").alias("_n")), k, {"_upto": "_n"})
    ranked = with_average_rank(with_average_rank(pairs, keys("x"), "x", "rx"), keys("y"), "y", "ry").crossJoin(F.broadcast(plain.select("n")))  # one row
    x, y = ((F.col(r) - (F.col("n") + 1) / 2) for r in ("rx", "ry"))
    total = lambda v: F.sum(F.col("c") * v)
    spearman = ranked.agg(F.try_divide(total(x * y), F.sqrt(total(x * x)) * F.sqrt(total(y * y))).alias("spearman"))
    return plain.crossJoin(F.broadcast(spearman)).select("n", "pearson", "spearman", "mae", "rmse", "max_abs")  # one row


def histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    """label, bin (1-based), count: equal bins over each label's own range."""
    scored = written(scored)
    span = F.broadcast(scored.groupBy("label").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")))  # a row for each label
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("quality") - F.col("lo"), width), F.lit(0.0))).cast("int") + 1, F.lit(bins))
    return scored.join(span, "label").select("label", at.alias("bin")).groupBy("label", "bin").agg(F.count(F.lit(1)).alias("n"))


def balanced_sample(rows: DataFrame, per_label: int, seed: int = 42, exclude: DataFrame | None = None) -> DataFrame:
    """Exactly per_label passages of each label in an order that only docno and seed decide; excluded docnos never come in."""
    if exclude is not None:
        rows = rows.join(exclude.select("docno").distinct(), "docno", "left_anti")
    w = Window.partitionBy("label").orderBy("_h", "docno")
    drawn = rows.dropDuplicates(["docno"]).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "docno")))
    return drawn.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_label).drop("_h", "_n")


def scanned_sample(examples: DataFrame, order: list[str], per_label: int, skip: int = 0, scan: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """The first per_label examples of each label in an order, without the first `skip` and among the `scan` that follow them, each docno once and none that is excluded. A label that the scan holds too few of gives fewer."""
    seen = numbered(window_of(examples, order, skip, scan), [F.col(c) for c in order], "_at")
    if exclude is not None:
        seen = seen.join(exclude.select("docno").distinct(), "docno", "left_anti")
    once = seen.withColumn("_o", F.row_number().over(Window.partitionBy("docno").orderBy("_at"))).where("_o = 1")
    return once.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy("_at"))).where(F.col("_n") <= per_label).drop("_at", "_o", "_n")


def fingerprint(sample: DataFrame) -> DataFrame:
    """One digest of a bounded sample: docno, label and text by docno."""
    line = F.concat_ws("\t", "docno", F.col("label").cast("string"), F.md5("text"))
    return sample.agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("docno", line.alias("line")))), lambda s: s["line"]), "\n")).alias("fingerprint"))

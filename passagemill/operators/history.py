"""Training history: best steps, running extremes, losses between evaluations, signs of overfitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(history: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """history with new's rows in place of those with the same keys."""
    return history.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def trajectory(history: DataFrame, min_delta: float = 0.0) -> DataFrame:
    """run, step, validation_loss, training_loss, metric with running bests and comparisons with the step before."""
    w = Window.partitionBy("run").orderBy("step")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    x = history.select("*", F.min("validation_loss").over(upto).alias("best_loss"), F.max("metric").over(upto).alias("best_metric"))
    falling = F.coalesce(F.col("training_loss") < F.lag("training_loss").over(w), F.lit(False))
    rising = F.coalesce(F.col("validation_loss") > F.lag("validation_loss").over(w) + min_delta, F.lit(False))
    return x.select(
        "*", F.greatest(F.lit(0.0), F.col("validation_loss") - F.col("best_loss")).alias("loss_over_best"), (F.coalesce(F.max("metric").over(before), F.lit(float("-inf"))) < F.col("metric")).alias("metric_improved"),
        falling.alias("training_falling"), rising.alias("validation_rising"), (falling & rising).alias("overfitting"),
    )


def best_step(history: DataFrame) -> DataFrame:
    """run, step of the highest metric, the first of equals."""
    return history.groupBy("run").agg(F.max_by("step", F.struct("metric", -F.col("step"))).alias("best_step"), F.max("metric").alias("best_metric"))


def mean_loss_between(losses: DataFrame, evaluations: DataFrame) -> DataFrame:
    """run, step, mean_loss: mean of losses (run, at, loss) in (previous evaluation, step] for each evaluation (run, step) that has any.

    Losses and spans meet in cells of the steps: a span goes to each cell that it touches, a loss to its
    own, and a cell is about as wide as a span is long, so a run of any length is many small groups and
    no loss meets all spans of its run. The first span of a run starts below all steps.
    """
    ends = losses.agg(F.min("at").alias("_least"), F.max("at").alias("_last"))
    counted = evaluations.groupBy("run").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("_spans"))
    width = F.greatest((F.col("_last") - F.col("_least")) / F.greatest(F.col("_spans"), F.lit(1)), F.lit(1.0))
    grid = F.broadcast(ends.crossJoin(counted).select("_least", width.alias("_width")))  # one row
    cell = lambda c: F.floor((c - F.col("_least")) / F.col("_width"))
    w = Window.partitionBy("run").orderBy("step")
    spans = evaluations.select("run", "step").distinct().withColumn("_from", F.lag("step").over(w)).crossJoin(grid).where(F.col("step") >= F.col("_least"))
    low = F.greatest(F.coalesce(F.col("_from"), F.col("_least")), F.col("_least"))
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell(low), cell(F.col("step")))))
    placed = losses.crossJoin(grid).withColumn("_cell", cell(F.col("at")))
    hit = placed.join(spans.drop("_width", "_least"), ["run", "_cell"]).where((F.col("_from").isNull() | (F.col("at") > F.col("_from"))) & (F.col("at") <= F.col("step")))
    return hit.groupBy("run", "step").agg(F.avg("loss").alias("mean_loss"))


#: The column of a log's entries that says which of equal keys counts: the greatest.
VERSION = "_version"


def append(rows: DataFrame, path: str, version: int) -> None:
    """Add rows to a log. Nothing that is there is read or written again."""
    rows.withColumn(VERSION, F.lit(version).cast("long")).write.mode("append").parquet(path)


def merged(log: DataFrame, keys: list[str]) -> DataFrame:
    """A log merged on reading: of rows with equal keys (null ones are equal) the one of the greatest version, without the version."""
    rest = [c for c in log.columns if c not in (*keys, VERSION)]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), VERSION).alias("_x"))
    return last.select(*keys, *(F.col("_x")[c].alias(c) for c in rest))


def streaks(flagged: DataFrame, flag: str = "overfitting") -> DataFrame:
    """run, step, streak: how many evaluations in a row were flagged. A run's history is small and is walked in pandas."""

    def walk(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("step")
        f = x[flag].astype(bool)
        return x.assign(streak=f.groupby((~f).cumsum()).cumsum().astype("int64"))[["run", "step", "streak"]]

    return flagged.select("run", "step", flag).groupBy("run").applyInPandas(walk, "run string, step long, streak long")


def held_out_loss(scored: DataFrame) -> DataFrame:
    """Mean cross-entropy of log P(true) with labels."""
    log_false = F.log1p(-F.exp("log_prob"))
    return scored.agg(F.avg(-F.when(F.col("label") == 1, F.col("log_prob")).otherwise(log_false)).alias("loss"), F.count(F.lit(1)).alias("n"))

"""Feature scalers: fitted in one aggregation, kept as a one-row table, applied as arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx

TRANSFORMS = ("identity", "zscore", "log1p_zscore")


def _before(column: Column, transform: str) -> Column:
    if transform not in TRANSFORMS:
        raise ValueError(f"no transform {transform}")
    return F.log1p(F.greatest(column, F.lit(0.0))) if transform == "log1p_zscore" else column


def fit(features: DataFrame, transforms: dict[str, str], weight: str | None = None) -> DataFrame:
    """feature, transform, mean, std (population; 1 where it is 0; identity has 0 and 1). weight: a column of frequencies."""
    w = F.col(weight) if weight else F.lit(1.0)
    aggs = []
    for name, transform in transforms.items():
        x = _before(F.col(name), transform)
        m = F.sum(w * x) / F.sum(w)
        aggs += [m.alias(f"m_{name}"), (F.sum(w * x * x) / F.sum(w)).alias(f"s_{name}")]
    one = features.agg(*aggs)
    rows = []
    for name, transform in transforms.items():
        flat = transform == "identity"
        sd = F.sqrt(F.greatest(F.col(f"s_{name}") - F.col(f"m_{name}") * F.col(f"m_{name}"), F.lit(0.0)))
        rows.append(F.struct(F.lit(name).alias("feature"), F.lit(transform).alias("transform"), (F.lit(0.0) if flat else F.col(f"m_{name}")).alias("mean"), (F.lit(1.0) if flat else F.when(sd > 1e-9, sd).otherwise(1.0)).alias("std")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def first_examples(examples: DataFrame, order: list[str], first: int | None, weight: str = "freq") -> DataFrame:
    """docno and how often each is among the first examples in an order (all without a limit)."""
    kept = examples if first is None else examples.orderBy(*order).limit(first)
    return kept.groupBy("docno").agg(F.count(F.lit(1)).alias(weight))


def fit_states(rows: DataFrame, states: str, mask: Column | None = None) -> DataFrame:
    """Scalers of the features of token vectors and of their pooled vector, all fitted in one aggregation while rows stream by."""
    x = rows.select(F.col(states).alias("_s"), vx.pooled(F.col(states), mask).alias("_p"))
    x = x.select(*vx.embedding_features(F.col("_p")), *vx.token_features(F.col("_s"), F.col("_p")))
    return fit(x, dict.fromkeys(x.columns, "zscore"))


def apply(features: DataFrame, scaler: DataFrame, transforms: dict[str, str]) -> DataFrame:
    """features with each named column scaled; the scaler has one row for each feature and is broadcast."""
    packed = F.broadcast(scaler.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_scaler")))
    out = features.crossJoin(packed)  # one row
    for name, transform in transforms.items():
        s = F.element_at("_scaler", name)
        out = out.withColumn(name, (_before(F.col(name), transform) - s["mean"]) / s["std"])
    return out.drop("_scaler")


def lookup(docnos: DataFrame, metadata: DataFrame, names: list[str], allow_missing: bool = False) -> DataFrame:
    """Features by docno. A docno without any one of them is an error, or has 0 for it where missing ones are allowed."""
    out = docnos.join(metadata.select("docno", *names), "docno", "left")
    for c in names:
        instead = F.lit(0.0) if allow_missing else F.raise_error(F.concat(F.lit(f"no {c} for "), F.col("docno"))).cast("double")
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), instead))
    return out

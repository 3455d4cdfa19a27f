"""A learned quality scorer: logistic regression of labels on features, giving log P(true).

It is fitted by Newton's method. Each step is one pass over the labelled rows, in which tasks sum the
gradient, the Hessian, the losses and the hits of their rows; Spark adds the tasks' sums, and the driver
solves one system of as many equations as there are features. A step that makes the regularised
training loss worse is halved, as Newton's step may overshoot. A penalty on the weights (not on the
constant) keeps them finite where a feature parts the labels.

Features are scaled first (scaling.fit on the training rows alone). Validation rows take no part in
the gradient; their loss and accuracy are summed in the same pass, so the history of steps costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..tables import materialize
from . import scaling

STEPS, TOLERANCE, PENALTY = 30, 1e-10, 1e-3  #: most steps, change of a mean loss that ends them, penalty for each training row
HALVINGS = 12


class Fitted(NamedTuple):
    names: list[str]
    weights: np.ndarray  # the constant first
    scaler: DataFrame
    transforms: dict[str, str]
    history: DataFrame  # run, step, training_loss, validation_loss, metric


def _sums(rows: DataFrame, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over rows (x: array of features, label, training) at some weights, by name."""
    k = len(weights)
    slots = {"gradient": k, "hessian": k * k, "training": 1, "training_n": 1, "validation": 1, "validation_n": 1, "hits": 1}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {name: np.zeros(n) for name, n in slots.items()}
        for part in parts:
            x = np.column_stack([np.ones(len(part)), np.stack(part["x"].to_numpy())]) if len(part) else np.zeros((0, k))
            y, fit = part["label"].to_numpy(np.float64), part["training"].to_numpy(bool)
            z = x @ weights
            loss = np.logaddexp(0, np.where(y == 1, -z, z))
            p = np.exp(-np.logaddexp(0, -z))
            seen, w = x[fit], (p * (1 - p))[fit]
            total["gradient"] += seen.T @ (p - y)[fit]
            total["hessian"] += ((seen * w[:, None]).T @ seen).ravel()
            for name, mine in (("training", fit), ("validation", ~fit)):
                total[name] += loss[mine].sum()
                total[f"{name}_n"] += mine.sum()
            total["hits"] += ((z > 0) == (y == 1))[~fit].sum()
        yield pd.DataFrame([(name, i, v) for name, values in total.items() for i, v in enumerate(values.tolist())], columns=["name", "at", "value"])

    added = rows.mapInPandas(run, "name string, at int, value double").groupBy("name", "at").agg(F.sum("value").alias("value"))
    out = {name: np.zeros(n) for name, n in slots.items()}
    for r in added.collect():  # as many numbers as the Hessian has
        out[r["name"]][r["at"]] = r["value"]
    return out


def newton(rows: DataFrame, features: int, penalty: float = PENALTY, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, list[tuple[int, float, float, float]]]:
    """Weights (constant first), and of each accepted step its number, mean training loss, mean validation loss and validation accuracy. rows (written): x, label (0 or 1), training."""
    weights, step, seen = np.zeros(features + 1), np.zeros(features + 1), []
    ridge = np.r_[0.0, np.full(features, penalty)]
    best, halved, at = np.inf, 0, _sums(rows, weights)
    n = at["training_n"][0]
    mean = lambda s, part: float(s[part][0] / s[f"{part}_n"][0]) if s[f"{part}_n"][0] else float("nan")
    while True:
        loss = mean(at, "training") + float(ridge @ (weights * weights)) / 2
        if loss > best and halved < HALVINGS:
            halved += 1
            step = step / 2
            weights = weights - step  # back by half of what was left
            at = _sums(rows, weights)
            continue
        seen.append((len(seen), mean(at, "training"), mean(at, "validation"), float(at["hits"][0] / at["validation_n"][0]) if at["validation_n"][0] else float("nan")))
        if best - loss < tolerance or len(seen) > steps:
            return weights, seen
        best, halved = loss, 0
        hessian = at["hessian"].reshape(len(weights), -1) / n + np.diag(ridge)
        step = -np.linalg.lstsq(hessian, at["gradient"] / n + ridge * weights, rcond=None)[0]
        weights = weights + step
        at = _sums(rows, weights)


def fit(features: DataFrame, transforms: dict[str, str], training: Column, run: str = "logistic", **how) -> Fitted:
    """Fit labels (0 or 1) on features; training says which rows are learned from. Rows with a null feature or label are an error."""
    spark, names = features.sparkSession, list(transforms)
    marked = features.withColumn("_training", training)
    if marked.where("_training").isEmpty():
        raise ValueError("no training rows")
    scaler = materialize(scaling.fit(marked.where("_training"), transforms), "scaler")
    scaled = scaling.apply(marked, scaler, transforms)
    whole = F.forall(F.array(*(F.col(c).cast("double") for c in names), F.col("label").cast("double")), lambda x: x.isNotNull())
    x = F.when(whole, F.array(*(F.col(c).cast("double") for c in names))).otherwise(F.raise_error(F.lit("a feature or label is null")).cast("array<double>"))
    rows = materialize(scaled.select(x.alias("x"), F.col("label").cast("int").alias("label"), F.col("_training").alias("training")), "examples")
    weights, seen = newton(rows, len(names), **how)
    history = spark.createDataFrame([(run, *s) for s in seen], "run string, step long, training_loss double, validation_loss double, metric double")
    return Fitted(names, weights, scaler, transforms, history)


def coefficients(fitted: Fitted, spark) -> DataFrame:
    """feature (constant included), weight: of scaled features."""
    return spark.createDataFrame(list(zip(["constant", *fitted.names], fitted.weights.tolist(), strict=True)), "feature string, weight double")


def score(features: DataFrame, fitted: Fitted) -> DataFrame:
    """docno, quality: log P(true)."""
    z = F.lit(float(fitted.weights[0]))
    for name, w in zip(fitted.names, fitted.weights[1:].tolist(), strict=True):
        z = z + F.col(name) * F.lit(w)
    return scaling.apply(features, fitted.scaler, fitted.transforms).select("docno", vx.log_prob_true(z, F.lit(0.0)).alias("quality"))

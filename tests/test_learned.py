"""The learned scorer against a numpy fit, its history, and its use on held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import learned as le
from passagemill.operators import pruning as pr
from passagemill.plans import registry as rg

D = "/root/testdata/sf0.01"


def numpy_fit(x, y, penalty):
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.r_[0.0, np.full(x.shape[1] - 1, penalty)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(ridge), x.T @ (p - y) / len(x) + ridge * w)
    return w


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 3)) * [1, 20, 0.01] + [0, 5, 0]
    y = (x[:, 0] + x[:, 1] / 20 + rng.logistic(size=500) > 0.5).astype(int)
    return spark.createDataFrame([(f"d{i}", *map(float, v), int(t), i % 4 != 0) for i, (v, t) in enumerate(zip(x, y, strict=True))], "docno string, a double, b double, c double, label int, fit boolean").repartition(3)


def test_coefficients_equal_numpy(table, spark):
    fitted = le.fit(table, {"a": "zscore", "b": "zscore", "c": "identity"}, F.col("fit"))
    rows = table.toPandas()
    seen = rows[rows.fit]
    z = lambda c: (rows[c] - seen[c].mean()) / seen[c].std(ddof=0)
    x = np.column_stack([z("a"), z("b"), rows["c"]])
    want = numpy_fit(x[rows.fit.to_numpy(bool)], seen.label.to_numpy(), le.PENALTY)
    assert np.allclose(fitted.weights, want, atol=1e-6)
    got = {r["docno"]: r["quality"] for r in le.score(table, fitted).collect()}
    for docno, p in zip(rows.docno, 1 / (1 + np.exp(-(want[0] + x @ want[1:]))), strict=True):
        assert got[docno] == pytest.approx(np.log(p), abs=1e-6)
    steps = fitted.history.orderBy("step").collect()
    assert steps[0]["training_loss"] == pytest.approx(np.log(2)) and steps[-1]["training_loss"] < steps[0]["training_loss"]
    assert [r["feature"] for r in le.coefficients(fitted, spark).collect()] == ["constant", "a", "b", "c"]


def test_parted_labels_one_class_and_no_rows(spark):
    rows = spark.createDataFrame([(str(i), float(i), int(i >= 10), True) for i in range(20)], "docno string, a double, label int, fit boolean")
    fitted = le.fit(rows, {"a": "zscore"}, F.col("fit"))
    assert np.isfinite(fitted.weights).all() and fitted.weights[1] > 1
    one = le.fit(rows.where("label = 1"), {"a": "zscore"}, F.col("fit"))
    assert np.isfinite(one.weights).all() and one.weights[0] > 3
    with pytest.raises(ValueError, match="no training rows"):
        le.fit(rows, {"a": "zscore"}, F.lit(False))
    with pytest.raises(Exception, match="null"):
        le.fit(rows.withColumn("a", F.when(F.col("label") == 1, F.col("a"))), {"a": "identity"}, F.col("fit"))


def test_held_out_labels_of_the_tables(spark):
    features, fitted = rg.learned(spark, D)
    held = le.score(features, fitted).join(rg.labels(spark, D), "docno").where(F.crc32("docno") % 5 == 0)
    rows = held.collect()
    share = sum(r["label"] for r in rows) / len(rows)
    constant = -(share * np.log(share) + (1 - share) * np.log(1 - share))
    loss = -np.mean([r["quality"] if r["label"] else np.log1p(-np.exp(r["quality"])) for r in rows])
    assert loss < 0.75 * constant
    assert pr.auc(held).first()["auc"] > 0.85
    last = fitted.history.orderBy(F.desc("step")).first()
    assert last["validation_loss"] == pytest.approx(loss, abs=1e-9)

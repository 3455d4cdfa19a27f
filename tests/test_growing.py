"""Committed chunks and their summaries, histories in cells, logs merged on reading, joins within a tolerance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import comparison as cp
from passagemill.operators import history as hs
from passagemill.operators import scorers as qs
from passagemill.sources import quality_store as st


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.range(300).select(F.format_string("d%04d", "id").alias("docno"), F.concat_ws(" ", F.lit("a b"), F.col("id") % 7, F.col("id") % 3, F.lit("a")).alias("text"))


def test_a_run_that_dies_between_writing_and_committing(spark, corpus, tmp_path, monkeypatch):
    path, real, calls = f"file://{tmp_path}/store", st._commit, []

    def dies(*args):
        calls.append(args)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(st, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        st.score(corpus, qs.itn, path, 5)
    assert st.manifest(spark, path).count() == 2 and not st.complete(spark, path, 5)
    assert len(list((tmp_path / "store" / "data").iterdir())) == 3  # one that nothing counts
    monkeypatch.setattr(st, "_commit", real)
    seen = []

    def watching(rows):
        seen.append({r["docno"] for r in rows.select("docno").collect()})
        return qs.itn(rows)

    assert st.score(corpus, watching, path, 5) == 3 and st.complete(spark, path, 5)
    assert len(seen) == 3 and sum(map(len, seen)) < 300  # what was committed isn't scored again
    got = st.scores(spark, path)
    assert got.exceptAll(qs.itn(corpus)).isEmpty() and got.count() == 300
    assert st.score(corpus, watching, path, 5) == 0 and len(seen) == 3
    with pytest.raises(ValueError, match="5 chunks"):
        st.score(corpus, qs.itn, path, 6)


def test_two_runs_cannot_both_commit_a_chunk(spark, corpus, tmp_path):
    path = f"file://{tmp_path}/store"

    def slower(rows):  # while it works, another run commits the chunk
        st.score(corpus, qs.itn, path, 1) if st.manifest(spark, path).isEmpty() else None
        return qs.itn(rows)

    assert st.score(corpus, slower, path, 1) == 0
    assert st.scores(spark, path).count() == 300


def test_merged_summaries_equal_one_pass(spark, tmp_path):
    x = np.random.default_rng(1).lognormal(size=20_000)
    rows = spark.createDataFrame([(f"d{i}", float(v)) for i, v in enumerate(x)] + [("nan", float("nan")), ("null", None), ("inf", float("inf"))], "docno string, text double")
    path = f"file://{tmp_path}/store"
    st.score(rows, lambda r: r.select("docno", F.col("text").alias("quality")), path, 7)
    got = st.moments(st.manifest(spark, path)).first()
    assert (got["rows"], got["n"]) == (20_003, 20_000)
    assert [got[c] for c in ("mean", "std", "low", "high")] == pytest.approx([x.mean(), x.std(), x.min(), x.max()], rel=1e-9)
    for p in (0.01, 0.3, 0.5, 0.99):
        cut = st.threshold(st.manifest(spark, path), p).first()["threshold"]
        assert abs((x <= cut).mean() - p) < 0.003
    nothing = spark.createDataFrame([], st.ENTRY)
    assert st.moments(nothing).first()["n"] is None and st.threshold(nothing, 0.5).first()["threshold"] is None


def test_losses_of_a_long_run_in_cells(spark):
    n = 100_000
    losses = spark.range(n).select(F.lit("long").alias("run"), F.col("id").alias("at"), (F.col("id") % 13).cast("double").alias("loss")).union(spark.createDataFrame([("short", 5, 1.0), ("short", 9, 3.0)], "run string, at long, loss double"))
    steps = sorted({0, 7, 50_000, 50_001, 99_998, 200_000} | set(range(60_000, 70_000, 10)))
    evaluations = spark.createDataFrame([("long", s) for s in steps] + [("long", 7), ("short", 4), ("short", 6), ("none", 3)], "run string, step long")
    got = {(r["run"], r["step"]): r["mean_loss"] for r in hs.mean_loss_between(losses, evaluations).collect()}
    before, want = -1, {("short", 6): 1.0}
    for s in steps:
        mine = [i % 13 for i in range(before + 1, min(s, n - 1) + 1)]
        before, want = s, want | ({("long", s): sum(mine) / len(mine)} if mine else {})
    assert got == pytest.approx(want)


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for version, rows in ((1, [("a", 1, "x"), (None, 2, "y")]), (2, [("a", 5, None)]), (3, [("b", 6, "z"), (None, 7, "w")])):
        hs.append(spark.createDataFrame(rows, "k string, v long, s string"), path, version)
    assert sorted(map(str, hs.merged(spark.read.parquet(path), ["k"]).collect())) == sorted(map(str, spark.createDataFrame([("a", 5, None), (None, 7, "w"), ("b", 6, "z")], "k string, v long, s string").collect()))


def test_close_thresholds_of_one_key_stay_few(spark):
    n = 100_000
    at = F.col("id") / n
    results = spark.range(n).select(F.lit("k").alias("key"), (at + 1e-11).alias("threshold"), F.col("id"))
    flags = spark.range(n).select(F.lit("k").alias("key"), at.alias("_t"))
    assert cp.band_join(results, flags, ["key"], "threshold", "_t", 1e-10).count() == n
    twice = flags.select("key", F.col("_t").alias("threshold"), F.lit(True).alias("equivalent")).where("_t < 0.5").union(spark.createDataFrame([("k", 0.25, False)], "key string, threshold double, equivalent boolean"))
    got = cp.with_close_flags(results, twice, ["key"], absolute=1e-9, relative=0.0).groupBy("equivalent").count().collect()
    assert {r["equivalent"]: r["count"] for r in got} == {True: n // 2 - 1, None: n // 2 + 1}


def test_variants(spark):
    results = [("s", 0.3, 0.5, "dev"), ("s", 0.3, 0.6, "test"), ("s", 0.45, 0.5, "dev"), ("s", 0.45, 0.5, "dev"), ("s", 0.6, 0.5, None), ("o", 0.3, 0.5, "dev")]
    tests = [
        (1, "s", 0.3 + 5e-11, 0.5, None, "dev"), (2, "s", 0.3, None, None, None), (3, "s", 0.3, 0.6 * (1 + 5e-8), None, "test"), (4, "s", 0.45, None, None, "dev"), (5, "s", 0.45 + 2e-10, None, None, None), (6, "s", 0.6, None, None, None),
        (7, "s", 0.3, 0.7, None, None), (8, "s", 0.3, 0.5, "mine", "mine"), (9, None, 0.3, 0.5, None, None), (10, "s", None, 0.5, None, None), (11, "s", 0.45, None, None, "dev"),
    ]
    t = spark.createDataFrame([x[:5] for x in tests], "id int, scorer string, threshold double, mean_full double, qrels_variant string")
    r = spark.createDataFrame(results, "scorer string, threshold double, mean_full double, qrels_variant string")
    assert {x["id"]: x["qrels_variant"] for x in cp.resolve_variants(t, r, ["scorer"]).collect()} == {x[0]: x[5] for x in tests}

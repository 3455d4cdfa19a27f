"""Dense search by cells: exact whatever is skipped, calibrated recall, own vectors only."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import dense_index as dx
from passagemill.operators import retrieval as rt


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 3
    x = np.concatenate([centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 8)) * 0.1, np.repeat(centres[:1], 300, 0)])  # a third in one point
    return spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "docno string, doc_vec array<double>").repartition(4)


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where(F.col("docno").substr(5, 1) == "7").select(F.col("docno").alias("qid"), F.col("doc_vec").alias("query_vec"))


@pytest.fixture(scope="module")
def stored(vectors, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('dense')}/index"
    return path, dx.write(vectors, path, 16)


def rows(df):
    return sorted((r["qid"], r["rank"], r["docno"], r["score"]) for r in df.collect())


def test_exact_search_skips_and_finds_all(spark, vectors, queries, stored, monkeypatch):
    index = dx.open_index(spark, *stored)
    want = rows(rt.top_k(rt.dense_search(vectors, queries, 10_000).drop("rank").withColumn("score", F.round("score", 9)), 6))
    found, read = dx.search(index, queries, 6, probes=2)
    assert rows(found) == want
    n = read.agg(F.sum("vectors"), F.sum("scored")).first()
    assert n[1] < 0.7 * n[0]
    monkeypatch.setattr(dx, "QUERY_BLOCK", 20)
    assert rows(dx.search(index, queries, 6, probes=2)[0]) == want


def test_calibrated_recall(spark, queries, stored):
    index = dx.open_index(spark, *stored)
    probes = dx.calibrated(index, 6)
    assert 1 <= probes < 16
    exact, (fast, read) = dx.search(index, queries, 6)[0], dx.search(index, queries, 6, exact=False, probes=probes)
    assert fast.join(exact, ["qid", "docno"]).count() >= 0.9 * exact.count()
    n = read.agg(F.sum("vectors"), F.sum("scored")).first()
    assert n[1] < n[0]


def test_every_vector_is_in_its_nearest_cell_within_the_radius(spark, vectors, stored):
    index = dx.open_index(spark, *stored)
    assert index.vectors.count() == vectors.count() == index.facts["docs"]
    cells = {r["cell"]: r for r in index.cells.collect()}
    centroids = np.array([cells[c]["centroid"] for c in sorted(cells)])
    for r in index.vectors.collect():
        far = np.linalg.norm(centroids - np.array(r["doc_vec"]), axis=1)
        assert np.linalg.norm(np.array(cells[r["cell"]]["centroid"]) - r["doc_vec"]) <= min(far.min() + 1e-9, cells[r["cell"]]["radius"] + 1e-9)


def test_foreign_or_unfinished_indexes_are_errors(spark, vectors, stored, tmp_path):
    path, mark = stored
    assert dx.fingerprint(vectors.repartition(2)) == mark != dx.fingerprint(vectors.where("docno <> 'v0003'"))
    with pytest.raises(ValueError, match="fingerprint"):
        dx.open_index(spark, path, "1-2-3")
    half = f"{tmp_path}/half"
    shutil.copytree(path, half)
    shutil.rmtree(f"{half}/facts")
    with pytest.raises(ValueError, match="no finished index"):
        dx.open_index(spark, half)

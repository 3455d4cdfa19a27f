"""Dense search by matrix products: the same as pairs by Spark's dot product, whatever the vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.functions import vectors as vx
from passagemill.operators import dense_index as dx
from passagemill.operators import products as px
from passagemill.operators import retrieval as rt


def rows(df):
    return sorted((r["qid"], r["rank"], r["docno"], str(r["score"])) for r in df.collect())


def pairs(vectors, queries, k):
    score = F.round(vx.dot(F.col("doc_vec"), F.col("query_vec")), 9)
    return rows(rt.top_k(vectors.crossJoin(queries).select("qid", "docno", score.alias("score")), k))


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(5).normal(size=(700, 6))
    x[100:400] = x[100]  # many copies
    x[400:420] = 0.0
    x[420:480] = x[420] + np.arange(60)[::-1, None] * 1e-13  # apart under the ninth place only
    return spark.createDataFrame([(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)], "docno string, doc_vec array<double>").repartition(5)


def asked(vectors):
    return vectors.where(F.col("docno").substr(4, 1) == "0").select(F.col("docno").alias("qid"), F.col("doc_vec").alias("query_vec"))


def test_ties_are_of_rounded_scores(vectors, monkeypatch):
    want = pairs(vectors, asked(vectors), 7)
    assert rows(rt.dense_search(vectors, asked(vectors), 7, 9)) == want
    monkeypatch.setattr(rt, "QUERY_BLOCK", 9)
    for name, n in (("ROWS", 16), ("PAIRS", 50), ("HELD", 10)):
        monkeypatch.setattr(px, name, n)
    assert rows(rt.dense_search(vectors, asked(vectors), 7, 9)) == want


def test_odd_vectors_and_queries(spark, vectors):
    nan, inf = float("nan"), float("inf")
    odd = [("o1", None), ("o2", [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("o3", [nan] * 6), ("o4", [inf, 0.0, 0.0, 0.0, 0.0, 1.0]), ("o5", [1.0, 2.0]), ("o60", [1e200] * 6)]
    every = vectors.where("docno < 'v020'").union(spark.createDataFrame(odd, "docno string, doc_vec array<double>"))
    q = every.where(F.col("docno").rlike("^o|0$")).select(F.col("docno").alias("qid"), F.col("doc_vec").alias("query_vec"))
    assert rows(rt.dense_search(every, q, 30, 9)) == pairs(every, q, 30)
    for some in (every.where("docno = 'o1'"), every.where("docno = 'x'")):
        assert rows(rt.dense_search(some, q, 3, 9)) == pairs(some, q, 3)
        assert rows(rt.dense_search(every, some.select(F.col("docno").alias("qid"), F.col("doc_vec").alias("query_vec")), 3, 9)) == pairs(every, some.select(F.col("docno").alias("qid"), F.col("doc_vec").alias("query_vec")), 3)


def test_stored_search_meets_no_pairs_in_joins(spark, vectors, tmp_path):
    path = f"{tmp_path}/index"
    found, read = dx.search(dx.open_index(spark, path, dx.write(vectors, path, 8)), asked(vectors), 7, probes=2)
    assert rows(found) == pairs(vectors, asked(vectors), 7)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert read.count() == asked(vectors).count()

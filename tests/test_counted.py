"""Terms counted for many rows at once, and the background in two parts: the same as row by row and in one join."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.operators import scorers as qs


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["", None, "a", "Running runs ran running yyy sky skies", "b " * 50, " ".join(f"w{i % 37}" for i in range(400)), "x_1 ünder ünder", "!!!"] + [f"only{i} a a b" for i in range(60)]
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "docno string, text string").repartition(3)


@pytest.mark.parametrize("stemmed", [False, True])
@pytest.mark.parametrize("at_once", [7, 1_000_000])
def test_counted_terms(corpus, monkeypatch, stemmed, at_once):
    monkeypatch.setattr(tx, "AT_ONCE", at_once)
    monkeypatch.setattr(tx, "KNOWN", 3)
    want = tx.with_terms(corpus, stemmed).select("docno", "n", "terms", "tfs")
    got = tx.counted_terms(corpus, ["docno"], stemmed)
    assert sorted(got.collect()) == sorted(want.collect())


def test_rare_terms_alone_are_shuffled(corpus, monkeypatch):
    words = {r["docno"]: r["w"] for r in corpus.select("docno", tx.tokens(F.col("text")).alias("w")).collect()}
    all_ = Counter(w for ws in words.values() for w in ws)
    n = sum(all_.values())

    def score(ws):
        tf, p = Counter(ws), {w: all_[w] / n for w in set(ws)}
        return -((1 - sum(p.values())) * math.log2(100) + sum(x * math.log2(x / (0.99 * tf[w] / len(ws) + 0.01 * x)) for w, x in p.items())) if ws else -999.0

    for sent in (0, 5, 100_000):
        monkeypatch.setattr(qs, "SENT", sent)
        got = {r["docno"]: r["quality"] for r in qs.cdd(corpus).collect()}
        assert got == pytest.approx({d: score(ws) for d, ws in words.items()})
    often, seldom = qs.frequent(qs.background(corpus), 5)
    assert 0 < often.count() <= 5 and often.count() + seldom.count() == len(all_)
    assert often.agg(F.min("p")).first()[0] > seldom.agg(F.max("p")).first()[0]

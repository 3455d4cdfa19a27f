"""Phrases of a stated set in rows' words: the same as a search of each text, whatever is done at once, and texts are read once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemill.functions import text as tx
from passagemill.operators import phrases as ph
from passagemill.operators import retrieval as rt


def searched(docs, topics):
    s = lambda w: f" {' '.join(w)} "
    return {(d, q): 2 if s(t) in s(w) else 1 for d, w in docs.items() for q, t in topics.items() if s(t[:5]) in s(w)}


def table(topics):
    return pa.table({"qid": pa.array(list(topics), pa.string()), "w": pa.array(list(topics.values()), pa.list_(pa.string()))})


@pytest.mark.parametrize("pairs", [1, 50, 1 << 20])
def test_phrases_are_those_of_a_search(monkeypatch, pairs):
    monkeypatch.setattr(ph, "PAIRS", pairs)
    rng = random.Random(5)
    word = lambda: rng.choice("ab")
    topics = {f"q{i}": [word() for _ in range(rng.randint(5, 9))] for i in range(40)} | {"long": list("ababababab") * 3, "none": ["x"] * 5}
    docs = {i: [rng.choice("aaabbbz") for _ in range(rng.randint(0, 60))] for i in range(80)} | {80: list("ab") * 40, 81: [], 82: list("bbbb")}
    words = pa.array([["cut"]] * 2 + list(docs.values()), pa.list_(pa.string()))[2:]
    got = ph.found(words, ph.phrases(table(topics))).to_pylist()
    rows = [(d, x["qid"], x["label"]) for d, xs in zip(docs, got, strict=True) for x in xs]
    want = searched(docs, topics)
    assert len(rows) == len(set(rows)) and {(d, q): n for d, q, n in rows} == want and set(want.values()) == {1, 2}


def test_heads_of_one_number_are_told_apart_by_words(monkeypatch):
    monkeypatch.setattr(ph, "_keys", lambda words, at: at * 0)
    topics = {"p": list("abcde"), "q": list("abcdf") + ["a"], "r": list("fabcd")}
    words = pa.array([list("abcdfabcde"), list("abcdz")], pa.list_(pa.string()))
    assert ph.found(words, ph.phrases(table(topics))).to_pylist() == [[{"qid": "p", "label": 2}, {"qid": "q", "label": 2}, {"qid": "r", "label": 2}], []]


def test_no_phrases_and_no_rows():
    some = pa.array([["a"] * 9, []], pa.list_(pa.string()))
    assert ph.found(some, ph.phrases(table({}))).to_pylist() == [[], []]
    assert ph.found(some[:0], ph.phrases(table({"q": ["a"] * 5}))).to_pylist() == []


@pytest.mark.parametrize("blocks", [1, 3])
def test_runs_read_texts_once_and_qrels_move_none(spark, monkeypatch, blocks):
    from passagemill.plans import registry

    d = "/root/testdata/sf0.001"
    if blocks > 1:
        monkeypatch.setattr(rt, "SMALL", registry.topics(spark, d).count() // blocks + 1)
    texts = {r["docno"]: r["w"] for r in registry.corpus(spark, d).select("docno", tx.tokens(F.col("text")).alias("w")).collect()}
    topics = {r["qid"]: r["w"] for r in registry.topics(spark, d).select("qid", tx.tokens(F.col("query")).alias("w")).collect()}
    q = registry.qrels(spark, d)
    assert {(r["docno"], r["qid"]): r["label"] for r in q.collect()} == searched(texts, {k: w for k, w in topics.items() if len(w) >= 5})
    assert "Join" not in q._jdf.queryExecution().toString()
    if blocks == 1:
        reads = []
        monkeypatch.setattr(registry, "corpus", lambda *a, read=registry.corpus: reads.append(a) or read(*a))
        assert registry.runs_long(spark, d, ("itn",), (0.3,)).count() > 0 and len(reads) == 1

"""Operator 11 against brute force: counts on nasty texts, the estimated accuracies against plain Python."""

import random
import re
from collections import Counter

import pytest

from passagemill.llm import quality_rules as q

RNG = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, kept string, n_words string, _w string, _row string"


def prose(n):
    return " ".join("".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(3, 7))) + ("." if RNG.random() < 0.1 else "") for _ in range(n))


A = prose(90)
TEXTS = [
    A, A, None, "", " \n\t \n", "one", prose(19), prose(20), "x " * 9, "a b c d e f g h a b c d e f g h", "a b c d e f g h i a b c d e f g h", (prose(9) + "\n") * 4 + prose(30), "  lead " + prose(30) + " \x0b\x0c\r\n",
    " ".join(w + "###" for w in A.split()), A.upper() + " ÄÖÜ", " | ".join(A.split()), "Ünï été 日本語 🙂 " + prose(25), "a\r\nb\r\n\r\na\r\n" + prose(22), prose(4000) + " " + A + "\n" + A, "é" * 70_000, "and " * 20_000, "no-break space " + prose(21),
]


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    letters = sum(any(c.isalpha() for c in w) for w in words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(lines), letters, sum(c.isupper() for c in t), len(re.findall(r"[.!?](?=[\x20\x09-\x0D])", t)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "k", "n", "w", "r") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


def test_counts(docs):
    got = {r["doc_id"]: tuple(r[c] for c in q.COUNTS) for r in q.counts(docs, ["doc_id"]).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def votes_of(counts):
    """What RULES say, from Python's own comparisons."""
    n, chars, symbols, dup, again, lines, letters, capitals, ends = counts
    good = {"prose": 4 * n <= chars <= 7 * n and 50 * ends >= n and 3 * ends <= n and 50 * symbols <= n and 10 * letters >= 9 * n and capitals <= n, "fresh": n >= 20 and not dup and not again and 50 * symbols <= n}
    bad = {"word_length": chars < 3 * n or chars > 10 * n, "symbols": 10 * symbols > n, "lines": 2 * dup > lines, "repeats": 4 * again > n, "letters": 5 * letters < 4 * n, "capitals": capitals > 2 * n, "sentences": 2 * ends > n}
    return [None if not n else 1 if good.get(r) else 0 if bad.get(r) else None for r in q.RULES]


def posterior(votes, accuracy):
    odds = 1.0
    for v, a in zip(votes, accuracy, strict=True):
        odds *= 1 if v is None else a / (1 - a) if v else (1 - a) / a
    return odds / (1 + odds)


def test_estimates_and_verdicts(docs):
    votes = [votes_of(brute(t)) for t in TEXTS]
    start = [x[0] for x in q.RULES.values()]
    accuracy = start
    for _ in range(q.ROUNDS):
        good, new = [posterior(v, accuracy) for v in votes], []
        for j, first in enumerate(start):
            cast = [(p if v[j] else 1 - p) for v, p in zip(votes, good, strict=True) if v[j] is not None]
            new.append((sum(cast) / len(cast) + q.TRUST * first) / (1 + q.TRUST) if cast else first)
        accuracy = new
    got = {r["doc_id"]: r for r in q.judge(docs, ["doc_id"]).collect()}
    assert len(got) == len(TEXTS)
    for i, (t, v) in enumerate(zip(TEXTS, votes, strict=True)):
        n, again = brute(t)[0], brute(t)[4]
        failed = n < 20 or 100 * again > 30 * n
        assert [got[i][r] for r in q.RULES] == v
        assert got[i]["quality"] == pytest.approx(posterior(v, accuracy), abs=2e-6)
        assert got[i]["base_failed"] == failed
        assert got[i]["kept"] == (not failed and got[i]["quality"] >= q.KEEP)
    assert got[0]["kept"] and all(got[i]["quality"] < got[0]["quality"] for i in (13, 14, 15))


def test_no_rows(spark):
    assert q.judge(spark.createDataFrame([], SCHEMA), ["doc_id"]).collect() == []


def test_finds_labelled_junk_and_keeps_the_rest(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").selectExpr("doc_id", "quality AS label")
    rows = q.op11_quality_rules(spark, d).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["label"]], [r["kept"] for r in rows if not r["label"]]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)

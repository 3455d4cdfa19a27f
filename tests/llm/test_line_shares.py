"""Operator 2 with an edit bound that grows with the line, and with more buckets than partitions."""

from __future__ import annotations

import random

from passagemill.llm import common, line_dedup


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng: random.Random, line: str, n: int) -> str:
    chars = list(line)
    for _ in range(n):
        at, what = rng.randrange(len(chars)), rng.randrange(3)
        chars[at : at + (what > 0)] = [] if what == 1 else [rng.choice("xyz")]
    return "".join(chars)


def lines() -> list[str]:
    rng = random.Random(5)
    out = []
    for size in (12, 25, 40, 60, 90):
        for _ in range(4):
            base = "".join(rng.choice("abcdef ") for _ in range(size))
            out += [base, *(changed(rng, base, n) for n in (1, size // 15, size // 10, size // 8, size // 5))]
    return out


def gone(spark, texts: list[str]) -> set[tuple[int, int]]:
    docs = spark.createDataFrame([(i // 10, "\n".join(texts[i : i + 10])) for i in range(0, len(texts), 10)], "doc_id long, text string").repartition(3)
    rows = line_dedup.dedup_lines(docs, ["doc_id"], edits=8, least=80).collect()
    return {(r["doc_id"], p) for r in rows for p in [*r["equal"], *r["near"]]}


def test_a_bound_by_share_finds_every_near_line(spark, monkeypatch):
    texts = lines()
    want = set()
    for i, b in enumerate(texts):
        for a in texts[:i]:
            short = min(len(a), len(b))
            if a == b or abs(len(a) - len(b)) <= short // 10 and distance(a, b) <= min(8, short // 10):
                want.add((i // 10, i % 10))
                break
    assert 20 < len(want) < len(texts)
    assert gone(spark, texts) == want
    monkeypatch.setattr(common, "MOST_PARTITIONS", 2)
    monkeypatch.setattr(line_dedup, "buckets_for", lambda docs: 7)
    assert gone(spark, texts) == want

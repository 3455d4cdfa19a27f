"""Operators 12 and 13 against brute force in whole numbers: nulls, ties, repeats, few rows, large components."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.llm import hard_negatives as hn
from passagemill.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, vector string, error string, block int"


def table(spark, n, seed, dim=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(12)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.05))) for c in rng.choice(centres)], rng.choice([0, 1, 2, 3, None])) for i in range(n)]
    hot = rows[3][1]
    rows += [(n + i, hot, i % 2) for i in range(n // 3)]  # a third of all rows
    rows += [(n * 2, None, 1), (n * 2 + 1, [float("nan")] + hot[1:], 1), (n * 2 + 2, [None] + hot[1:], 1), (n * 2 + 3, [float("inf")] + hot[1:], 2), (n * 2 + 4, [], 1), (None, rows[5][1], 1), (50, hot, 2), (50, hot, 2), (20, rows[20][1], rows[20][2])]
    return spark.createDataFrame([(*r, "c", "v", "e", 0) for r in rows], SCHEMA).repartition(5), [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]


def brute_codes(rows, dim):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    whole = [[math.floor(vc.SCALE * x) for x in r[1]] for r in rows]
    w = dim // vc.PARTS
    parts = [[v[p * w : (p + 1) * w] for v in whole] for p in range(vc.PARTS)]
    books = [p[: vc.ENTRIES] for p in parts]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(vc.ROUNDS):
        for p, book in enumerate(books):
            near = defaultdict(list)
            for x in parts[p]:
                near[best(x, book)[1]].append(x)
            books[p] = [[sum(c) // len(near[j]) for c in zip(*near[j], strict=True)] if j in near else c for j, c in enumerate(book)]
    found = [[best(x, books[p]) for x in parts[p]] for p in range(vc.PARTS)]
    made = [(r[0], r[2], "".join(f"{found[p][i][1]:02x}" for p in range(vc.PARTS)), sum(found[p][i][0] for p in range(vc.PARTS))) for i, r in enumerate(rows)]
    total = defaultdict(int)
    for _, label, _, e in made:
        total[label] += e
    return [(i, c, e, total[label]) for i, label, c, e in made], vc.digest([np.array(b) for b in books])


def none_last(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("n", [40, 330])
def test_codes(spark, tmp_path, monkeypatch, n):
    df, rows = table(spark, n, 12)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(vc, "BLOCK", 37)
    monkeypatch.setattr(vc, "PAIRS", 101)
    got = vc.op12_vector_codes(spark, str(tmp_path)).collect()
    want, digest = brute_codes(rows, 12)
    as_rows = lambda xs: sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in xs)
    assert as_rows(tuple(r)[:4] for r in got) == as_rows(want)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_nearest_where_float32_cannot_tell():
    rng = np.random.default_rng(3)
    book = rng.integers(-(1 << 27), 1 << 27, (256, 16))
    book[100:200] = book[:100] + rng.integers(-1, 2, (100, 16))  # closer than float32 can say
    book[200:] = book[:56]  # equal entries: the lower index
    x = np.r_[book[rng.integers(0, 256, 400)] + rng.integers(-2, 3, (400, 16)), rng.integers(-5, 5, (20, 16)), np.zeros((1, 16), np.int64)]
    index, distance = vc.nearest(x, book)
    exact = ((x[:, None, :] - book[None]) ** 2).sum(2)
    assert (index == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_sums_of_many_labels(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 3 else i % 7, i) for i in range(200)], "vec_id int, label int, error long")
    want = none_last(map(tuple, vc.with_group_sum(df, "label", "error", "s").collect()))
    monkeypatch.setattr(vc, "SMALL", 0)
    assert none_last(map(tuple, vc.with_group_sum(df, "label", "error", "s").collect())) == want


def test_no_vectors_and_wrong_ones(spark, tmp_path):
    nothing = spark.createDataFrame([(1, None, 2, "", "", "", 0)], SCHEMA)
    nothing.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vc.op12_vector_codes(spark, str(tmp_path)).collect() == [] == hn.op13_hard_negatives(spark, str(tmp_path)).collect()
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1e30, 1.0])], "vec_id long, vector array<float>")
    for bad in (2, 3):
        with pytest.raises(Exception, match="components|beyond"):
            vc.learn(rows.where(F.col("vec_id").isin(1, bad)), parts=1)


def brute_negatives(rows):
    rows = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(hn.SCALE * x) for x in v]) for i, v, label in rows if label is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    best = lambda xs: sorted(xs, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for i, label, v in {(r[0], r[1], tuple(r[2])) for r in rows if r[0] is not None and r[0] % hn.EVERY == 0}:
        scored = [(dot(v, x), j, m) for j, m, x in rows]
        for ps, j, _ in best([s for s in scored if s[2] == label and s[1] != i])[: hn.POSITIVES]:
            window = [s for s in scored if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps]
            out += [(i, j, rank, k, ps, ns) for rank, (ns, k, _) in enumerate(best(window)[: hn.NEGATIVES], 1)]
    return out


@pytest.mark.parametrize(("anchors", "at_once", "block"), [(2048, 128, 4096), (3, 2, 41)])
def test_negatives(spark, tmp_path, monkeypatch, anchors, at_once, block):
    df, rows = table(spark, 420, 13)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    monkeypatch.setattr(hn, "AT_ONCE", at_once)
    monkeypatch.setattr(vc, "BLOCK", block)
    got = [tuple(r) for r in hn.op13_hard_negatives(spark, str(tmp_path)).collect()]
    want = brute_negatives(rows)
    assert len(want) > 50 and none_last(got) == none_last(want)


def test_bounds_hold_and_exclude(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-90, 90, (300, 64))
    books = vc.cut(rng.integers(-90, 90, (256, 64)), 16)
    code, distance = vc.assign(x, books)
    block = hn.Block(np.arange(20), np.zeros(20), x[:20], books)
    (_, piece), *rest = block.pieces(20)
    low, high = piece.bounds(code, np.sqrt(distance).astype(np.float32) * np.float32(1.000001))
    exact = x[:20] @ x.T
    assert not rest and (low <= exact).all() and (exact <= high).all()

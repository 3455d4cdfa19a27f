"""Operator 9 on components that hang together by chains."""

from __future__ import annotations

import numpy as np

from passagemill.llm import jaccard_join


def chain(n: int, shift: int, words: int, name: str) -> list[str]:
    return [" ".join(f"{name}{i}" for i in range(d * shift, d * shift + words)) for d in range(n)]


def brute(texts: list[str]) -> tuple[list[int], list[int]]:
    """Class (least place) and number of links of each text."""
    sets = []
    for t in texts:
        w = t.split()
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    near = [[j for j, b in enumerate(sets) if j != i and len(a & b) >= 0.8 * len(a | b) - 1e-9] for i, a in enumerate(sets)]
    low = list(range(len(texts)))
    for _ in texts:
        low = [min([low[i], *(low[j] for j in near[i])]) for i in range(len(texts))]
    return low, [len(x) for x in near]


def test_a_long_chain_is_verified_bucket_by_bucket(spark, monkeypatch):
    texts = chain(150, 4, 60, "w") + chain(3, 1, 40, "v")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen, groups_of = [], jaccard_join.groups_of

    def watched(met, found):
        out = groups_of(met, found)
        seen.append({r["band"] >= 0 for r in out.selectExpr("explode(places.band) AS band").collect()})
        return out

    monkeypatch.setattr(jaccard_join, "groups_of", watched)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    got = sorted(jaccard_join.jaccard_join(docs).select("doc_id", "class_id", "n_links").collect())
    low, n = brute(texts)
    assert [tuple(r) for r in got] == list(zip(range(len(texts)), low, n, strict=True))
    assert seen == [{True, False}]  # the chain by its buckets, the small component whole


def test_pairs_meet_in_the_first_band_they_share():
    bands = np.array([[1, 5, 7], [1, 5, 8], [2, 5, 7]])
    by_band = [jaccard_join.first_shared(bands, i) for i in range(3)]
    assert by_band[0].tolist() == [[True, True, False], [True, True, False], [False, False, True]]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert sum(int(x[i, j]) for x in by_band) == 1

"""The trigram model against one that is made anew, in plain Python, of all other passages."""

import math
import random
from collections import Counter, defaultdict

import pytest

from passagemill.operators import language_model as lm

RNG = random.Random(4)


def passage(n):
    return " ".join(RNG.choice("a b c d e f g hh ii jj".split()) for _ in range(n))


SAME = passage(12)
TEXTS = [SAME, SAME, "", None, "Only once here!", "a", passage(30), passage(7) + " zz", "zz zz zz zz", passage(3) + " été 日本", passage(40)]


def grams(text):
    words = [""] * 2 + lm_tokens(text)
    return Counter(zip(words, words[1:], words[2:], strict=False))


def lm_tokens(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}_]+", (text or "").lower())


def discounts(texts):
    kinds = sum((grams(t) for t in texts), Counter())
    pairs = Counter((v, w) for _, v, w in kinds)
    words = Counter(w for _, w in pairs)
    out = []
    for counts in (words, pairs, kinds):
        n1, n2 = (sum(x == k for x in counts.values()) for k in (1, 2))
        out.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
    return out


def perplexity(text, others, d):
    kinds = sum((grams(t) for t in others), Counter())
    pairs = Counter((v, w) for _, v, w in kinds)
    words = Counter(w for _, w in pairs)
    context, middle = defaultdict(Counter), defaultdict(Counter)
    for (u, v, w), n in kinds.items():
        context[u, v][w] = n
    for (v, w), n in pairs.items():
        middle[v][w] = n
    mixed = lambda counts, w, discount, lower: (max(counts[w] - discount, 0) + discount * len(counts) * lower) / sum(counts.values()) if counts else lower
    total = 0.0
    for (u, v, w), n in grams(text).items():
        p = mixed(words, w, d[0], 1 / (len(words) + 1))
        p = mixed(middle[v], w, d[1], p)
        total += n * math.log(mixed(context[u, v], w, d[2], p))
    size = len(lm_tokens(text))
    return math.exp(-total / size) if size else None


def test_each_passage_by_the_model_of_the_others(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "docno string, text string").repartition(3)
    got = {r["docno"]: r["quality"] for r in lm.perplexity(df).collect()}
    d, known = discounts(TEXTS), len({w for t in TEXTS for w in lm_tokens(t)})
    for i, t in enumerate(TEXTS):
        want = perplexity(t, TEXTS[:i] + TEXTS[i + 1 :], d)
        assert -got[str(i)] == pytest.approx(known + 1 if want is None else want, rel=1e-9), i


def test_a_model_of_another_corpus_and_unknown_words(spark):
    frame = lambda ts: spark.createDataFrame([(str(i), t) for i, t in enumerate(ts)], "docno string, text string")
    model = lm.fit(lm.trigrams(frame(TEXTS)))
    new = ["a b unknown c", "quite another text", SAME, SAME + " " + SAME]
    got = {r["docno"]: r["quality"] for r in lm.perplexity(frame(new), model).collect()}
    for i, t in enumerate(new):
        assert -got[str(i)] == pytest.approx(perplexity(t, TEXTS, discounts(TEXTS)), rel=1e-9)


def test_no_corpus_and_lone_passage(spark):
    empty = spark.createDataFrame([], "docno string, text string")
    assert lm.perplexity(empty).collect() == []
    lone = spark.createDataFrame([("1", "a b a")], "docno string, text string")
    assert lm.perplexity(lone).first()["quality"] == pytest.approx(-1.0)  # nothing is known: one unknown word


def test_statistics_of_pairs_meet_pairs(spark, monkeypatch):
    written = {}

    def watched(df, name, make=lm.materialize):
        out = make(df, name)
        written[name] = (out.columns, out.count())
        return out

    monkeypatch.setattr(lm, "materialize", watched)
    lm.perplexity(spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "docno string, text string")).collect()
    assert written["known-pairs"][1] == written["pairs"][1] < written["known"][1] == written["trigrams"][1]
    assert {"total_v", "before_w"} <= set(written["known-pairs"][0])

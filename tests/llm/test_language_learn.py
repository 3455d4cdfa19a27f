"""What language ID learns: the sample against plain Python, labels of few texts, very long and repeated ones."""

import random

from pyspark.sql import functions as F

from passagemill.llm import language as lang

RNG = random.Random(2)
EN, DE, XX = ("the house of a green tree with some other words and very many birds".split(), "das grüne haus und ein baum mit sehr vielen anderen wörtern über vögel".split(), "qo zul ixx vorra pelt ynna kirr sadu".split())


def say(words, n):
    return " ".join(RNG.choice(words) for _ in range(n))


def test_labels_with_many_rows_and_few_texts(spark):
    few = [say(XX, 12) for _ in range(3)]
    rows = spark.range(40_000).select((F.col("id") * 5 + 1).alias("doc_id"), F.element_at(F.array(*map(F.lit, few)), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit("xx").alias("lang"))
    more = spark.createDataFrame([(1_000_000 + i, say(EN, 30), "en") for i in range(500)], "doc_id long, text string, lang string")
    for turn in range(4):
        changed = rows.withColumn("text", F.concat("text", F.lit(f" zul{turn}")))
        learned = lang.learn(changed.unionByName(more))
        assert list(learned) == ["xx", "en"] and all(len(d) > 20 for d in learned.values())


def test_sample_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(lang, "SAMPLE_TEXTS", 10)
    data = [(i, say(EN if i % 3 else DE, 40), "en" if i % 3 else "de") for i in range(1, 200)] + [(i, "the same text of many rows", "en") for i in range(200, 300)]
    data += [(300, say(EN, 30), "de"), (301, None, "en"), (302, say(EN, 9), None), (None, say(DE, 20), "de"), (303, say(DE, 20_000), "de")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("text").alias("h"), lang.fold(F.col("doc_id")).alias("f")).collect()
    texts, counts = {}, {}
    for r in rows:
        if r["lang"] and r["text"] is not None and r["f"] != 0:
            texts.setdefault(r["lang"], {})[r["h"]] = r["text"]
            counts[r["lang"]] = counts.get(r["lang"], 0) + 1
    parts = {k: [texts[k][h] for h in sorted(texts[k])][:10] for k in sorted(counts, key=lambda k: (-counts[k], k))}
    halves = [lang.Classifier({k: lang.join(x[i::2]) for k, x in parts.items()}) for i in (0, 1)]
    want = {k: lang.join([t for i, t in enumerate(x) if halves[1 - i % 2].predict(t)[0] in (k, "und")] or x) for k, x in parts.items()}
    assert lang.learn(docs) == want and list(want) == ["en", "de"]

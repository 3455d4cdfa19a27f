"""Operator 5, language ID: compression classification.

For each language a zstandard raw-content dictionary is cut from a bounded sample of its labelled
texts. A text goes to the language whose dictionary compresses it to the fewest bytes; whole texts
are compressed, in blocks that are each small against a dictionary, so that a long text can't lean
on its own beginning instead. The score is the relative margin between the best and the second
language; margins under MARGIN are rejected (column rejected), and so are texts without a letter.
The margin alone decides: it holds for texts of every length.

Learning reads text and lang of documents outside the held-out fold only. Every label is learned,
from SAMPLE_TEXTS of its different texts at most, however often they repeat, each whole.

Defined cases: a null text or one without a letter (Unicode's category L) is `und` with score 0 and
rejected; without any labelled text all are. Rows with a null lang teach nothing. Ties go to the
language with more labelled texts and are rejected. With one learned language the score is 1.
Repeated rows give repeated results, and repeated texts teach once. Very long texts are compressed
whole. Extra columns, whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, read_documents

FOLDS = 5
SAMPLE_TEXTS = 48  #: different labelled texts of a language that make its dictionary
LEVEL, BLOCK = 6, 2_048  #: zstandard level; bytes compressed at once
MARGIN = 0.002
UNKNOWN = "und"
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Language to dictionary, the most frequent language first, from text and lang alone.

    The counts are over all labelled rows. The sample is the different texts with the least hash: a
    threshold known from the number of different texts leaves about four times the sample (all, where
    there are few), of which the least are kept; copies go before the shuffle. Labels can be wrong, so
    each half of the sample is classified by the other half's dictionaries, and what they give to
    another language is left out. The driver gets a count and a sample for each label: a bound by the
    number of languages.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ((fold(F.col("doc_id")) != 0) | F.col("doc_id").isNull()))
    known = known.select("lang", "text", F.xxhash64("text").alias("h"))
    told = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").collect()
    if not told:
        return {}
    counts = {r["lang"]: r["n"] for r in told}
    share = F.create_map(*(F.lit(x) for r in told for x in (r["lang"], min(1.0, 4 * SAMPLE_TEXTS / max(r["texts"], 1)))))
    drawn = known.where((F.col("h").cast("double") / 2.0**64 + 0.5) <= F.element_at(share, F.col("lang"))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    least = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("_n") <= SAMPLE_TEXTS)
    parts: dict[str, list[str]] = {}
    for r in least.orderBy("lang", "h").select("lang", "text").collect():
        parts.setdefault(r["lang"], []).append(r["text"])
    parts = {lang: parts[lang] for lang in counts if lang in parts}
    halves = [Classifier({lang: join(x[i::2]) for lang, x in parts.items()}) for i in (0, 1)]
    agree = {lang: [t for i, t in enumerate(x) if halves[1 - i % 2].predict(t)[0] in (lang, UNKNOWN)] for lang, x in parts.items()}
    return {lang: join(agree[lang] or x) for lang, x in parts.items()}


def join(parts: list[str]) -> bytes:
    return b" ".join(plain(t) for t in parts)


def plain(text: str) -> bytes:
    """Lower case, with ASCII digits and marks as spaces: what is left tells languages apart."""
    return text.lower().encode("utf-8", "replace").translate(PLAIN)


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.coders = []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = plain(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score, rejected."""
        if not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        score = 1 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 else 1.0
        return self.langs[order[0]], score, score < MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str]) -> DataFrame:
    """keep's columns, lang_pred, score and rejected of the column text."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    made: list[Classifier] = []

    def predict(texts: list[str]) -> list:
        if not made:
            made.append(Classifier(sent.value))
        found = [made[0].predict(t) for t in texts]
        return [pa.array([x[0] for x in found], pa.string()), np.array([x[1] for x in found], np.float64), pa.array([x[2] for x in found], pa.bool_())]

    return map_texts(docs, predict, "lang_pred string, score double, rejected boolean", keep)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text", held_out), learn(docs), ["doc_id", "held_out"])

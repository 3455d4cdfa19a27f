"""Operator 4, benchmark decontamination: a prefix-filtered set join, in DataFrame functions alone.

A window of an item is a record whose elements are its shingles of three words. A document can hold
the whole window only if it holds every shingle of it, so one shingle is the necessary prefix, and
the rarest over all documents is the one that meets the fewest. Document shingles meet the windows'
prefix shingles in a join by hash; the place of the shingle in the window fixes where the window
would begin, bounds on length and position drop what would stick out, and the words themselves are
compared, so hashes decide nothing. Windows have the item's size where the item is short.

Neither side grows in one place: documents are read where they lie and never shuffled with their
words; the benchmark is sent to them in blocks of at most BLOCK_WINDOWS windows, as many blocks as
it needs, each with its own pass.

Defined cases: a null or empty text has no words, no hits and is not contaminated; items without
words have no window; equal items all count. Rows with equal doc_id and text get equal results. Very
long texts are compared whole, inside their row. Without documents the result is empty, without items
nothing is hit. Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_documents, text_of, whole_row

WINDOW, SHINGLE = 13, 3
BLOCK_WINDOWS = 100_000  #: windows sent to executors at once; with WINDOW words each some tens of MB
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = "".join(chr(c) for c in range(128) if not chr(c).isalnum())  #: ASCII characters outside words


def words_of(text: Column) -> Column:
    """Words after A-Z became lower case. One pass over the characters and a split cost a tenth of matching WORD."""
    return F.array_remove(F.split(F.translate(text, UPPER + APART, LOWER + " " * len(APART)), " "), "")


def windows_of(benchmark: DataFrame) -> DataFrame:
    """Distinct windows: words, items that have it, how many words, a name."""
    items = benchmark.select("item_id", words_of(text_of()).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1))))
    one = items.select("item_id", "w", starts.alias("i")).select("item_id", F.slice("w", F.col("i"), WINDOW).alias("words"))
    return one.groupBy("words").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")).select("words", "items", F.size("words").alias("len"), F.least(F.size("words"), F.lit(SHINGLE)).alias("q"), F.xxhash64("words").alias("window"))


def exploded(df: DataFrame, q: int) -> DataFrame:
    """Positions and hashes of the q-word shingles of the column words; each row keeps df's columns."""
    kept, at = df.columns, [f"_w{i}" for i in range(q)]
    ahead = df.select("*", *((F.col("words") if i == 0 else F.slice("words", i + 1, 1 << 30)).alias(c) for i, c in enumerate(at)))
    made = ahead.select(*kept, F.posexplode(F.arrays_zip(*at)).alias("pos", "_s"))
    return made.where(F.col("_s")[at[-1]].isNotNull()).select(*kept, "pos", F.xxhash64(*(F.col("_s")[c] for c in at)).alias("h"))


def find_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Every verified occurrence in docs (key columns, text): key columns, start, end, window, items."""
    keys = [c for c in docs.columns if c != "text"]
    told = windows.select("q", "window").groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()  # at most SHINGLE rows
    lengths = {r["q"]: r["n"] for r in told}
    found = []
    for q, n in sorted(lengths.items()):
        blocks = -(-n // BLOCK_WINDOWS)
        for block in range(blocks):
            some = windows.where((F.col("q") == q) & (F.pmod(F.col("window"), F.lit(blocks)) == block))
            parts = exploded(some, q)
            sent = F.broadcast(parts.select("h").distinct())  # at most BLOCK_WINDOWS * WINDOW numbers
            texts = docs.select(words_of(text_of()).alias("words"))
            counts = exploded(texts, q).select("h").join(sent, "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
            counts = materialize(counts, "shingle-counts")
            rarest = parts.join(counts, "h").groupBy("window").agg(F.min(F.struct("n", "h", "pos")).alias("r"), F.first("words").alias("w"), F.first("items").alias("items"), F.first("len").alias("len"))
            prefix = F.broadcast(rarest.select(F.col("r.h").alias("h"), F.col("r.pos").alias("at"), "window", "w", "items", "len"))  # at most BLOCK_WINDOWS rows
            here = exploded(docs.select(*keys, words_of(text_of()).alias("words")), q).join(prefix, "h")
            start = F.col("pos") - F.col("at")
            fits = here.where((start >= 0) & (start + F.col("len") <= F.size("words")))
            found.append(fits.where(F.slice("words", start + 1, F.col("len")) == F.col("w")).select(*keys, start.alias("start"), (start + F.col("len")).alias("end"), "window", "items"))
    if not found:
        none = docs.sparkSession.createDataFrame([], "start int, end int, window long, items array<string>")
        return docs.select(*keys).limit(0).join(none, how="left").where(F.lit(False))
    return functools.reduce(DataFrame.unionByName, found)


def covered(spans: Column) -> Column:
    """How many positions a sorted array of (start, end) covers."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    add = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    return F.aggregate(spans, zero, add, lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, h_text (a hash of the text), n_words, n_hit, items (sorted), contaminated."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h_text"), "text")
    windows = materialize(windows_of(benchmark), "windows")
    hits = find_windows(keyed, windows)
    per_doc = hits.groupBy("doc_id", "h_text").agg(covered(F.array_sort(F.collect_set(F.struct("start", "end")))).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "d", "h_text": "h"})
    counted = keyed.select("doc_id", "h_text", F.size(words_of(text_of())).cast("long").alias("n_words"))
    joined = counted.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h_text") == F.col("h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "h_text", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), whole_row(docs))
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("d"), F.col("h_text")).distinct()
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("h_text")), "left_anti").select("_row.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP4_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, w[i : i + 12] AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, l, i, w[i : i + l - 1] AS x
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hits AS (
  SELECT g.doc_id, g.i, g.l, win.item_id FROM grams g JOIN win ON g.l = win.l AND g.x = win.x),
pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

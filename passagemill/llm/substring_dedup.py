"""Operator 10, substring dedup: De Bruijn compaction.

The graph's nodes are strings of WINDOW - 1 words, its edges strings of WINDOW or more words from node
to node. The filter (repeats.py) names the stretches of a document that may repeat; a stretch that
another document has whole is one edge; where no smaller document has it whole, its runs are edges
too, and where runs agree in part only, so is each of their windows. Edges that two documents have stay, each with its source: the
coordinates of its least occurrence. A node is simple if all edges into it end in one window and all
edges out of it begin with one; at simple nodes an edge is joined to the edge that goes on in the same
source, and paths of such joins are compacted by pointer jumping: each round a join doubles how far
every edge sees, until all know where their path starts. Occurrences that follow one path without a
gap are one long span. Spans are verified at last: the words at their coordinates and the words at
the source's are fetched from the texts and compared, so no removal rests on a hash.

Each word that a window covers goes if the window's words also start in a document with a smaller
id; windows are judged on the input. Defined cases: a null or empty text has no words; documents
under WINDOW words lose nothing; copies within one document stay, and so do those among repeated rows
of one id; rows without id count as one document behind all others. Very long texts are worked on
whole; memory follows the longest text. An empty table gives an empty result. Extra columns, whatever
their names, are not looked at. Edges and nodes are named by 64-bit hashes: two names that meet by
chance can leave a repeat standing, and never remove what doesn't repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, join_by_key, materialize, read_documents
from .repeats import Columns, Shape, Sums, candidates, chosen_runs, covered, keyed, pack, pick, run_starts, unpack
from .suffix_dedup import byte_symbols, stretches

WINDOW, GRAM = 13, 5
SPACES = b" \t\n\v\f\r"
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def word_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and how many words each text has (null: none)."""
    raw = texts.cast(pa.large_binary()).fill_null(b"").to_pylist()
    whole = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    word = ~_SPACE[whole]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    bounds = np.cumsum([0, *(len(x) + 1 for x in raw)])
    counts = np.diff(np.searchsorted(start, bounds))
    symbols, _ = byte_symbols(pa.array([whole.tobytes()], pa.large_binary()))
    return Sums(symbols).at(start, end), counts.astype(np.int64)


SHAPE = Shape(word_symbols, WINDOW, GRAM)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


EDGE = "edge long, first long, last long, head long, tail long, n int, k long, h long, p int"
PART = (("edge", "<u8"), ("first", "<u8"), ("last", "<u8"), ("head", "<u8"), ("tail", "<u8"), ("n", "<u4"), ("p", "<u4"))


def edges_at(sums: Sums, at: np.ndarray, n: np.ndarray, window: int) -> Columns:
    """Names of the edges of n windows from these places: own, first and last window, first and last node."""
    stop = at + n
    return {"edge": sums.at(at, stop + window - 1), "first": sums.at(at, at + window), "last": sums.at(stop - 1, stop - 1 + window), "head": sums.at(at, at + window - 1), "tail": sums.at(stop, stop + window - 1), "n": n}


def edge_batch(x: Columns, *more: pa.Array) -> pa.RecordBatch:
    named = [x[c].view(np.int64) for c in ("edge", "first", "last", "head", "tail")]
    columns = [*named, x["n"].astype(np.int32), x["k"], x["h"], x["p"].astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), *more], ["edge", "first", "last", "head", "tail", "n", "k", "h", "p", "parts"][: 9 + len(more)])


def send_edges(shape: Shape):
    """Occurrences of edges with their coordinates. Runs in a row that others have whole are one edge, with its runs packed in parts."""

    def run(batches):
        for _, _, sums, x in chosen_runs(batches, shape):
            if not len(x["p"]):
                continue
            open_ = np.flatnonzero(x["open"] | x["hot"])
            shift = stretches(np.zeros(len(open_), np.int64), x["n"][open_])
            one = np.repeat(open_, x["n"][open_])
            single = edges_at(sums, x["at"][one] + shift, np.ones(len(one), np.int64), shape.length) | {"k": x["k"][one], "h": x["h"][one], "p": x["p"][one] + shift}
            for i in range(0, len(one), 1 << 16):
                yield edge_batch(pick(single, slice(i, i + (1 << 16))), pa.nulls(min(1 << 16, len(one) - i), pa.binary()))
            x = pick(x, x["copy"])
            if not len(x["p"]):
                continue
            new = np.ones(len(x["p"]), bool)
            new[1:] = (x["text"][1:] != x["text"][:-1]) | (x["p"][1:] != x["p"][:-1] + x["n"][:-1])
            edge = np.append(np.flatnonzero(new), len(new))
            begin, stop = edge[:-1], edge[1:] - 1
            n = x["p"][stop] + x["n"][stop] - x["p"][begin]
            whole = edges_at(sums, x["at"][begin], n, shape.length) | {c: x[c][begin] for c in ("k", "h", "p")}
            inner = edges_at(sums, x["at"], x["n"], shape.length) | {"p": x["p"]}
            parts = [pack(pick(inner, slice(a, b + 1)), PART) if a < b else None for a, b in zip(begin, stop, strict=True)]
            yield edge_batch(whole, pa.array(parts, pa.binary()))

    return run


def taken_apart(batches):
    """Edges of parts."""
    for batch in batches:
        for k, h, blob in zip(*(batch.column(c).to_pylist() for c in ("k", "h", "parts")), strict=True):
            x = unpack([blob], PART)
            for i in range(0, len(x["n"]), 1 << 16):
                some = pick(x, slice(i, i + (1 << 16)))
                yield edge_batch(some | {"k": np.full(len(some["n"]), k), "h": np.full(len(some["n"]), h)})


def occurrences_of(sent: DataFrame) -> DataFrame:
    """Occurrences of edges at all grains: what is longer than a run is taken apart where no smaller document has it whole."""
    long = sent.where(F.col("parts").isNotNull())
    # least goes by edge and document, so that the holders of one edge don't meet
    own = long.join(long.groupBy("edge").agg(F.min("k").alias("k")), ["edge", "k"]).select("k", "h", "parts")
    return sent.drop("parts").unionByName(own.mapInArrow(taken_apart, EDGE))


def repeated_edges(occurrences: DataFrame) -> DataFrame:
    """Edges of two documents or more, each with the coordinates of its least occurrence: sk, sh, sp."""
    once = occurrences.groupBy("edge").agg(F.min(F.struct("k", "h", "p")).alias("s"), F.max("k").alias("most"), F.count(F.lit(1)).alias("c"), *(F.min(c).alias(c) for c in ("first", "last", "head", "tail", "n")))
    return once.where(F.col("s.k") < F.col("most")).select("edge", "first", "last", "head", "tail", "n", F.col("s.k").alias("sk"), F.col("s.h").alias("sh"), F.col("s.p").alias("sp"), "c")


def links(edges: DataFrame) -> DataFrame:
    """edge and the edge before it (before), where a simple node joins them and the source goes on."""
    into = edges.groupBy(F.col("tail").alias("node")).agg(F.min("last").alias("a"), F.max("last").alias("b")).where("a = b").select("node")
    out = edges.groupBy(F.col("head").alias("node")).agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a = b").select("node")
    simple = into.join(out, "node")
    left = edges.select(F.col("edge").alias("before"), F.col("tail").alias("node"), "n", "sk", "sh", (F.col("sp") + F.col("n")).alias("sp")).join(simple, "node", "left_semi")
    right = edges.select("edge", F.col("head").alias("node"), "sk", "sh", "sp")
    found = right.join(left, ["node", "sk", "sh", "sp"]).groupBy("edge").agg(F.max(F.struct("n", "before")).alias("x"))
    return found.select("edge", F.col("x.before").alias("before"))


def compact(edges: DataFrame) -> DataFrame:
    """edge, sk, sh, sp, c (occurrences) and start (the place in the source where the edge's path starts), written.

    Pointer jumping: to names an edge before on the path and at its place; done says that it is the
    first. A path goes forward in one source, so there are no rings, and as many jumps are needed as
    the length of the longest path has binary digits. Finished edges take no part any more but as what
    others look up.
    """
    places = edges.select("edge", "sp")
    linked = materialize(links(edges), "links")
    state = linked.join(places.select(F.col("edge").alias("before"), F.col("sp").alias("at")), "before").join(linked.select(F.col("edge").alias("before"), F.lit(True).alias("more")), "before", "left")
    state = materialize(state.select("edge", F.col("before").alias("to"), "at", F.col("more").isNull().alias("done")), "jumps")
    while not state.where("not done").isEmpty():
        goal = state.select(F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("at").alias("at2"), F.col("done").alias("done2"))
        ahead = state.where("not done").select("edge", "to", "at", "done")
        for _ in range(2):  # two jumps for each table that is written
            ahead = ahead.join(goal, "to", "left").select("edge", F.when(F.col("done"), F.col("to")).otherwise(F.col("to2")).alias("to"), F.when(F.col("done"), F.col("at")).otherwise(F.col("at2")).alias("at"), (F.col("done") | F.col("done2")).alias("done"))
        now = materialize(state.where("done").unionByName(ahead), "jumps")
        discard(state)
        state = now
    discard(linked)
    paths = materialize(edges.join(state.select("edge", "at"), "edge", "left").select("edge", "sk", "sh", "sp", F.coalesce("at", "sp").alias("start"), "c"), "paths")
    discard(state)
    return paths


def long_spans(occurrences: DataFrame, paths: DataFrame) -> DataFrame:
    """k, h, a, size (words) of occurrences that follow one path without a gap, and the source's sk, sh, sa."""
    on = join_by_key(occurrences, paths, "edge", "c", occurrences.count()).where(F.col("k") > F.col("sk")).select("k", "h", "p", "n", "sk", "sh", "start", (F.col("p") - F.col("sp")).alias("shift"))
    line = Window.partitionBy("k", "h", "sk", "sh", "start", "shift").orderBy("p", "n")
    reach = F.max(F.col("p") + F.col("n")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    cut = on.withColumn("new", F.coalesce(F.col("p") > reach, F.lit(True)).cast("int"))
    cut = cut.withColumn("part", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = cut.groupBy("k", "h", "sk", "sh", "start", "shift", "part").agg(F.min("p").alias("a"), F.max(F.col("p") + F.col("n")).alias("e"))
    return spans.select("k", "h", "a", (F.col("e") - F.col("a") + (WINDOW - 1)).alias("size"), "sk", "sh", (F.col("a") - F.col("shift")).alias("sa"))


WORDS = "k long, h long, a int, size int, sk long, sh long, sa int, words string"


def fetch(batches):
    """The words at the coordinates that each text is asked for."""
    names = ["k", "h", "a", "size", "sk", "sh", "sa", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    for batch in batches:
        for i in range(batch.num_rows):
            k, h, text, asked = (batch.column(c)[i].as_py() for c in ("k", "h", "text", "asked"))
            words = words_of(text)
            for j in range(0, len(asked), 256):
                rows = [(k, h, x["a"], x["size"], x["sk"], x["sh"], x["sa"], b" ".join(words[x["a"] : x["a"] + x["size"]]).decode("utf-8", "surrogatepass")) for x in asked[j : j + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def verified(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans whose words are the words at their source's coordinates."""
    source = ["size", "sk", "sh", "sa"]
    at_source = spans.select(F.col("sk").alias("k"), F.col("sh").alias("h"), F.col("sa").alias("a"), *source).distinct()
    asked = spans.unionByName(at_source).groupBy("k", "h").agg(F.collect_set(F.struct("a", *source)).alias("asked"))
    told = materialize(rows.join(asked, ["k", "h"]).select("k", "h", "text", "asked").mapInArrow(fetch, WORDS), "words")
    is_source = (F.col("k") == F.col("sk")) & (F.col("h") == F.col("sh")) & (F.col("a") == F.col("sa"))
    right = told.where(is_source).select(*source, "words").distinct()
    return told.where(~is_source).join(right, [*source, "words"], "left_semi").select("k", "h", "a", "size"), told


def repeated_spans(docs: DataFrame, shape: Shape) -> DataFrame:
    """k, h, spans array<struct<a,size>> of docs' rows: stretches of words whose every window a smaller document has."""
    rows = keyed(docs, [])
    may = candidates(docs, shape)
    told = materialize(rows.join(may, ["k", "h"]).select("k", "h", "text", "spans").mapInArrow(send_edges(shape), EDGE + ", parts binary"), "told")
    occurrences = materialize(occurrences_of(told), "occurrences")
    discard(may, told)
    edges = materialize(repeated_edges(occurrences), "edges")
    paths = compact(edges)
    spans = materialize(long_spans(occurrences, paths), "spans")
    discard(occurrences, edges, paths)
    found, told = verified(rows, spans)
    out = materialize(found.groupBy("k", "h").agg(F.collect_set(F.struct("a", "size")).alias("spans")), "repeated-spans")
    discard(spans, told)
    return out


def dedup(docs: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """doc_id, n_words, starts and ends of removed word runs, kept string, of every row of docs."""
    schema = "doc_id long, n_words long, starts array<long>, ends array<long>, kept string"

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns), strict=True):
                    words = words_of(text)
                    a = b = np.zeros(0, np.int64)
                    kept = words
                    if spans:
                        at = np.array([(x["a"], x["a"] + x["size"]) for x in spans], np.int64)
                        gone = covered(at[:, 0], at[:, 1], len(words))
                        a, b = run_starts(gone)
                        kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                    rows.append((doc_id, len(words), a.tolist(), b.tolist(), b" ".join(kept).decode("utf-8", "surrogatepass")))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_words", "starts", "ends", "kept"])

    found = repeated_spans(docs, shape)
    return keyed(docs, ["doc_id"]).join(found, ["k", "h"], "left").select(F.col("doc_id").cast("long"), "text", "spans").mapInArrow(run, schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read_documents(spark, sf_dir))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i : i + 12] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT x, min(doc_id) AS least FROM g GROUP BY x),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (x) WHERE doc_id > least),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.p = r.p WHERE r.p IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

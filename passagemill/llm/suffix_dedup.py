"""Operator 7, suffix-array dedup: bucket-pointer refinement.

Bytes of the UTF-8 text are the symbols, LENGTH bytes in a row are a string. The filter (repeats.py)
names the stretches of a document that may repeat; their bytes are sent, in pieces that keep all
strings around one anchor together, so equal strings meet in one part. There the suffixes of all
pieces are sorted into buckets by their first GRAM bytes, and each suffix points to the last place of
its bucket. A bucket of several suffixes is refined by sorting it on the bucket pointers of the
offsets behind what it was sorted by; each round reuses the pointers that the rounds before updated, so
what is told apart doubles until it covers LENGTH bytes. Buckets of one suffix are never touched
again. Buckets are of bytes and not of hashes: nothing is removed by a collision.

Each byte that a string covers goes if the string also starts in a document with a smaller id;
strings are judged on the input. Defined cases: a null or empty text has no bytes; documents under
LENGTH bytes lose nothing; copies within one document stay, and so do those among repeated rows of
one id; rows without id count as one document behind all others. Very long texts are worked on whole;
memory follows the longest text and the size of a part. An empty table gives an empty result. Extra
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, by_part, dealt, discard, read_documents
from .repeats import COPY, OWN, SENT, SPAN, TO_DOCUMENTS, Columns, Shape, blobs_by_part, by_document, candidates, chosen_runs, covered, joined, keyed, merged, pack, pick, run_starts, sent, settle, spans_of, to_documents, unpack

LENGTH, GRAM = 50, 8
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Pieces: their first n bytes start strings; raw holds all their bytes one after another.
PIECE = (("key", "<u8"), ("content", "<u8"), ("k", "<i8"), ("h", "<i8"), ("p", "<u4"), ("n", "u1"))
HELD = 24 << 20  #: bytes of pieces that a part gathers before it drops copies
SENT_BYTES = 12 << 20  #: bytes of pieces that a map task gathers before it sends them
AT_ONCE = 2 << 20  #: bytes of pieces whose suffixes are sorted together, but for one anchor's
BLOCK = 1 << 14  #: pieces whose bytes are gathered at once


def byte_symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each byte, and how many bytes each text has (null: none)."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    counts = pa.compute.binary_length(raw).to_numpy().astype(np.int64)
    return _BYTES[np.frombuffer(b"".join(raw.to_pylist()), np.uint8)], counts


SHAPE = Shape(byte_symbols, LENGTH, 16)


def stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def sizes(x: Columns, length: int) -> np.ndarray:
    return x["n"].astype(np.int64) + (length - 1)


def bytes_at(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of stretches one after another, gathered BLOCK stretches at a time."""
    out, at = np.empty(int(size.sum()), np.uint8), 0
    for i in range(0, len(start), BLOCK):
        n = int(size[i : i + BLOCK].sum())
        out[at : at + n] = raw[stretches(start[i : i + BLOCK], size[i : i + BLOCK])]
        at += n
    return out


def without_copies(x: Columns, raw: np.ndarray, length: int) -> tuple[Columns, np.ndarray, Columns]:
    """Pieces that no smaller document has whole, their bytes, and spans of the others. Equal names are checked byte by byte."""
    order, smaller, _ = settle(x, ("content",))
    size = sizes(x, length)
    start = np.cumsum(size) - size
    head = order[np.maximum.accumulate(np.where(smaller, 0, np.arange(len(order))))]  # what stands before has the group's least k
    mine, other = order[smaller], head[smaller]
    like = (x["n"][mine] == x["n"][other]) & (x["key"][mine] == x["key"][other])
    mine, other = mine[like], other[like]
    same = np.zeros(len(mine), bool)
    for i in range(0, len(mine), BLOCK):
        a, b = mine[i : i + BLOCK], other[i : i + BLOCK]
        n = size[a]
        equal = raw[stretches(start[a], n)] == raw[stretches(start[b], n)]
        same[i : i + BLOCK] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    stays = np.ones(len(order), bool)
    stays[mine[same]] = False
    return pick(x, stays), bytes_at(raw, start[stays], size[stays]), spans_of(pick(x, ~stays), COPY)


def bucket_pointers(raw: np.ndarray, size: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (places in raw) whose first length bytes others have too, and their buckets; equal buckets are neighbours.

    raw holds pieces of these sizes; a suffix ends with its piece.
    """
    room = (np.repeat(np.cumsum(size), size) - np.arange(len(raw))).astype(np.int32)
    first = np.zeros(len(raw), np.uint64)
    for i in range(gram):
        first[: len(raw) - i] |= raw[i:].astype(np.uint64) << np.uint64(8 * (gram - 1 - i))
    order = np.flatnonzero(room >= gram).astype(np.int32)
    order = order[np.argsort(first[order], kind="stable")]
    pointer = np.zeros(len(raw), np.int32)

    def point(places: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Let the suffixes at these places of order point to the last of their bucket; which have company."""
        if not len(places):
            return np.zeros(0, bool)
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(places)) - 1
        bucket = np.cumsum(new) - 1
        pointer[order[places]] = places[last][bucket]
        return (last > head)[bucket]

    def apart(key: np.ndarray) -> np.ndarray:
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        return new

    active = np.arange(len(order))
    active = active[point(active, apart(first[order]))]
    have = gram
    while have < length:
        ahead = min(have, length - have)
        active = active[room[order[active]] >= have + ahead]
        suffix = order[active]
        key = pointer[suffix].astype(np.uint64) << np.uint64(32) | pointer[suffix + ahead].astype(np.uint64)
        by = np.argsort(key, kind="stable")
        order[active] = suffix[by]
        active = active[point(active, apart(key[by]))]
        have += ahead
    return order[active], pointer[order[active]]


def repeated(x: Columns, raw: np.ndarray, length: int) -> Columns:
    """Spans of string starts that a smaller document has. Anchors are worked on some at a time: equal strings have equal ones."""
    size = sizes(x, length)
    start = np.cumsum(size) - size
    order = np.lexsort((x["k"], x["key"]))
    key, k = x["key"][order], x["k"][order]
    told = [spans_of(pick(x, slice(0, 0)), COPY)]
    if not len(order):
        return told[0]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    last = np.append(head[1:], len(order))
    several = np.flatnonzero(k[head] != k[last - 1])  # an anchor of one document repeats nothing
    upto = np.cumsum(size[order])
    i = 0
    while i < len(several):
        j = max(i + 1, int(np.searchsorted(upto[last[several] - 1], upto[head[several[i]]] + AT_ONCE)))
        places = order[stretches(head[several[i:j]], (last - head)[several[i:j]])]
        some, n = pick(x, places), size[places]
        suffix, bucket = bucket_pointers(bytes_at(raw, start[places], n), n, length)
        i = j
        if not len(suffix):
            continue
        end = np.cumsum(n)
        piece = np.searchsorted(end, suffix, side="right")
        of = some["k"][piece]
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        gone = np.flatnonzero(of > np.minimum.reduceat(of, np.flatnonzero(new))[np.cumsum(new) - 1])
        found = pick(some, piece[gone]) | {"p": some["p"][piece[gone]] + (suffix[gone] - (end - n)[piece[gone]]).astype(np.uint32), "n": np.ones(len(gone), np.uint32)}
        told.append(merged(spans_of(found, COPY)))
    return joined(told)


def send_pieces(shape: Shape, parts: int):
    def flush(got: list[Columns], raws: list[np.ndarray]):
        x, raw, told = without_copies(joined(got), np.concatenate(raws), shape.length)
        rows = []
        if len(told["k"]):
            rows.append((int(told["p"][0]) % parts, True, pack(told, SPAN)))
        size = sizes(x, shape.length)
        start = np.cumsum(size) - size
        x["_at"] = np.arange(len(size))
        for i, blob in blobs_by_part(x, (x["key"] % np.uint64(parts)).astype(np.int32), (*PIECE, ("_at", "<i8"))):
            mine = unpack([blob], (*PIECE, ("_at", "<i8")))
            at = mine.pop("_at")
            rows.append((i, False, pack(mine, PIECE) + bytes_at(raw, start[at], size[at]).tobytes()))
        yield from sent(rows)

    def run(batches):
        got, raws, held = [], [], 0
        for part, _, sums, x in chosen_runs(batches, shape):
            if not len(x["p"]):
                continue
            bytes_of = np.frombuffer(b"".join(part.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()), np.uint8)
            # strings around a crowded anchor go one by one, each to the part of its own name; whole copies go to the anchor's, too
            hot = np.repeat(np.flatnonzero(x["hot"]), x["n"][x["hot"]])
            shift = stretches(np.zeros(len(np.flatnonzero(x["hot"])), np.int64), x["n"][x["hot"]])
            single = pick(x, hot) | {"n": np.ones(len(hot), np.int64), "p": x["p"][hot] + shift, "at": x["at"][hot] + shift}
            single["key"] = single["content"] = sums.at(single["at"], single["at"] + shape.length)
            x = joined([pick(x, ~x["hot"] | x["copy"]), single])
            got.append({name: x[name] for name, _ in PIECE})
            raws.append(bytes_at(bytes_of, x["at"], sizes(x, shape.length)))
            held += len(raws[-1])
            if held >= SENT_BYTES:
                yield from flush(got, raws)
                got, raws, held = [], [], 0
        if got:
            yield from flush(got, raws)

    return run


def refine(shape: Shape, parts: int):
    def run(batches):
        for part in by_part(batches):
            told: list[Columns] = [unpack([], SPAN)]
            x, raw = unpack([], PIECE), np.zeros(0, np.uint8)
            more: list[tuple[Columns, np.ndarray]] = []
            held = 0

            def drop_copies():
                nonlocal x, raw, more
                x, raw, went = without_copies(joined([x, *(a for a, _ in more)]), np.concatenate([raw, *(b for _, b in more)]), shape.length)
                told.append(went)
                more = []

            for batch in part:
                for known, blob in zip(batch.column("told").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                    if known:
                        told.append(unpack([blob], SPAN))
                    else:
                        got = unpack([blob], PIECE)
                        more.append((got, np.frombuffer(blob, np.uint8, int(sizes(got, shape.length).sum()), len(blob) - int(sizes(got, shape.length).sum()))))
                        held += len(blob)
                if held > HELD:
                    drop_copies()
                    yield from by_document(merged(joined(told)), parts)
                    told[:], held = [unpack([], SPAN)], len(raw) // 2
            drop_copies()
            told.append(repeated(x, raw, shape.length))
            yield from by_document(merged(joined(told)), parts)

    return run


def repeated_strings(docs: DataFrame, shape: Shape) -> DataFrame:
    """k, h, spans: of docs' rows, where strings start that a smaller document has."""
    parts = buckets_for(docs)
    may = candidates(docs, shape)
    texts = keyed(docs, []).join(may, ["k", "h"]).select("k", "h", "text", "spans")
    met = dealt(texts.mapInArrow(send_pieces(shape, parts), SENT), parts).mapInArrow(refine(shape, parts), TO_DOCUMENTS)
    found = to_documents(met, parts, "repeated-strings")
    discard(may)
    return found


def dedup(docs: DataFrame, shape: Shape = SHAPE) -> DataFrame:
    """doc_id, n_bytes, starts and ends of removed byte runs, kept binary, of every row of docs."""
    schema = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                rows = []
                for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns), strict=True):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    if spans:
                        x = unpack([spans], OWN)
                        p = x["p"].astype(np.int64)
                        gone = covered(p, p + x["n"] + (shape.length - 1), len(raw))
                        a, b = run_starts(gone)
                        rows.append((doc_id, len(raw), a.tolist(), b.tolist(), np.frombuffer(raw, np.uint8)[~gone].tobytes()))
                    else:
                        rows.append((doc_id, len(raw), [], [], raw))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "starts", "ends", "kept"])

    found = repeated_strings(docs, shape)
    return keyed(docs, ["doc_id"]).join(found, ["k", "h"], "left").select(F.col("doc_id").cast("long"), "text", "spans").mapInArrow(run, schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 49)) AS i FROM b WHERE length(x) >= 100)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i AS a, i + 50 AS e FROM w JOIN m USING (s) WHERE doc_id > least),
g AS (SELECT doc_id, a, e, coalesce(a > max(e) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM r),
u AS (SELECT doc_id, min(a) AS a, max(e) AS e FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY a) AS n FROM g) GROUP BY doc_id, n),
k AS (SELECT doc_id, count(*) AS n, sum(e - a) AS removed, list(a ORDER BY a) AS aa, list(e ORDER BY a) AS ee FROM u GROUP BY doc_id)
SELECT b.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(aa) + 2), lambda j: substr(x, 2 * coalesce(ee[j - 1], 0) + 1, 2 * (coalesce(aa[j], length(x) // 2) - coalesce(ee[j - 1], 0)))), '') END)) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)
"""

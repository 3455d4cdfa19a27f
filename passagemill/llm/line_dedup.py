"""Operator 2, line dedup: segment-partition edit join.

A line goes if an earlier line (by doc_id, then line number) is equal or within EDITS single-character
edits. Where the shorter of two lines has under MIN_CHARS characters, so many edits are allowed as are
the same share of it: one from 16 characters, none below, where two edits make another word of a
word. So edits=10, least=100 is a bound of a tenth of the length up to 100 characters. Equal lines go at every length. With short=False lines under MIN_CHARS stay altogether.
Lines within EDITS edits share one of EDITS + 1 segments: each line is indexed by its own segments
under (its length, segment number, segment) and probes, for each length that is up to EDITS smaller,
the substrings that could be such a segment given where it would have to lie. Keys that bring
different lines together are found on hashes; only their lines are fetched and verified by a banded
bit-parallel edit distance.

When lines are verified, a key's indexed lines are dealt to blocks of BLOCK, and its probing lines go
to each block and pass by one at a time, so no key gathers more than a block of lines in memory. Before
that, hashes alone meet: there a key's different lines lie together in one part's memory, at 33 bytes
and more each. Copies of a line within a batch are settled before the shuffle and equal lines count
as one afterwards. A pair is not looked at once the
later line of it is known to go.

Defined cases: a null or empty text has one empty line, which stays. Lines end at \\n alone. A null
doc_id counts as larger than all others. Rows of one doc_id are told apart by a hash of their text;
fully equal rows share one fate, so copies among them stay. Very long texts are worked on whole, as
one batch. An empty table gives an empty result. Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, by_part, dealt, materialize, read_documents, shuffle_parts, slices, with_fields
from .repeats import STEP, Sums, blobs_by_part, joined, keyed, mix, pack, pick, unpack

EDITS, MIN_CHARS = 2, 32
BLOCK = 2048
FLUSH = 1 << 20

LINE = (("line", "<u8"), ("k", "<i8"), ("h", "<i8"), ("p", "<u4"))
#: role: 0 indexed, 1 probing
KEY = (("key", "<u8"), ("line", "<u8"), ("k", "<i8"), ("h", "<i8"), ("p", "<u4"), ("role", "u1"))
GONE = (("k", "<i8"), ("h", "<i8"), ("p", "<u4"))


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and size of each of edits + 1 nearly equal segments of lines of these lengths."""
    parts = edits + 1
    small, long = length // parts, length % parts
    out, at = [], np.zeros_like(length)
    for i in range(parts):
        size = small + (i >= parts - long)
        out.append((at, size))
        at = at + size
    return out


def allowed(length, edits: int, full: int):
    """Edits allowed between two lines of which the shorter has this length: edits from full characters, below in proportion."""
    return np.minimum(edits, length * edits // full)


def keys_of(sums: Sums, start: np.ndarray, length: np.ndarray, edits: int, full: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(lines, keys, role) of lines that lie at start in a symbol array; lines that allow no edit have none."""

    def key(size: np.ndarray, i: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(sums.at(a, b) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))

    lines = start, length
    for most in range(1, edits + 1):
        own = np.flatnonzero(allowed(lines[1], edits, full) == most)
        start, length = (x[own] for x in lines)
        for i, (at, size) in enumerate(segments(length, most)):
            yield own, key(length, i, start + at, start + at + size), 0
        for less in range(most + 1):
            own = np.flatnonzero(allowed(lines[1] - less, edits, full) == most)
            start, length = (x[own] for x in lines)
            for i, (at, size) in enumerate(segments(length - less, most)):
                # the i segments before hold at most i edits if this is the first that is whole, those behind the others
                low, high = max(-i, less - (most - i)), min(i, less + (most - i))
                for shift in range(low, high + 1):
                    ok = np.flatnonzero((at + shift >= 0) & (at + shift + size <= length))
                    yield own[ok], key(length - less, i, start + at + shift, np.minimum(start + at + shift + size, start + length))[ok], 1


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def lines_in(texts: list[str], least: int) -> tuple[Sums, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Symbols of texts and, of the lines that are long enough: start, length, text, line number."""
    chars = code_points([t + "\n" for t in texts])
    if not len(chars):
        return None
    end = np.flatnonzero(chars == 10)
    start = np.concatenate(([0], end[:-1] + 1))
    text_start = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(text_start, start, side="right") - 1
    number = np.arange(len(start)) - np.searchsorted(start, text_start)[text]
    ok = np.flatnonzero(end - start >= least)
    return Sums(mix(chars.astype(np.uint64) + np.uint64(1))), start[ok], (end - start)[ok], text[ok], number[ok]


SENT = "part int, kind int, blob binary"


def rows_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "kind", "blob"])


def first_of(x: dict[str, np.ndarray], by: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that come first (by k, p, h) among equal ones, and the others; of these not what has the first's place (a repeated row of docs)."""
    order = np.lexsort((x["h"], x["p"], x["k"], *(x[c] for c in by)))
    new = np.ones(len(order), bool)
    for j, c in enumerate(by):
        v = x[c][order]
        differs = v[1:] != v[:-1]
        new[1:] = differs if j == 0 else new[1:] | differs
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    elsewhere = np.zeros(len(order), bool)
    for c in ("k", "p", "h"):
        elsewhere |= x[c][order] != x[c][head]
    return np.sort(order[new]), np.sort(order[elsewhere])


def send(edits: int, full: int, least: int, parts: int) -> Callable:
    def flush(got: list[dict], keys: list[dict]) -> Iterator[pa.RecordBatch]:
        x = joined(got)
        first, again = first_of(x, ("line",))
        rows = []
        if len(again):
            rows.append((int(x["line"][again[0]] % np.uint64(parts)), 2, pack(pick(x, again), GONE)))
        x = pick(x, first)
        rows += [(i, 0, b) for i, b in blobs_by_part(x, (x["line"] % np.uint64(parts)).astype(np.int32), LINE)]
        if keys:
            y = joined(keys)
            y = pick(y, first_of(y, ("key", "role", "line"))[0])
            rows += [(i, 1, b) for i, b in blobs_by_part(y, (y["key"] % np.uint64(parts)).astype(np.int32), KEY)]
        for i in range(0, len(rows), 64):
            yield rows_batch(rows[i : i + 64])

    def run(batches):
        got, keys, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text", STEP):
                found = lines_in([t or "" for t in part.column("text").to_pylist()], least)
                if found is None or not len(found[1]):
                    continue
                sums, start, length, text, number = found
                line = sums.at(start, start + length)
                x = {"line": line, "k": part.column("k").to_numpy()[text], "h": part.column("h").to_numpy()[text], "p": number}
                got.append(x)
                once = first_of(x, ("line",))[0]
                for at, key, role in keys_of(sums, start[once], length[once], edits, full):
                    keys.append(pick(x, once[at]) | {"key": key, "role": np.full(len(at), role, np.uint8)})
                    held += len(at)
                held += len(line)
                if held >= FLUSH:
                    yield from flush(got, keys)
                    got, keys, held = [], [], 0
        if got:
            yield from flush(got, keys)

    return run


MET = "k long, h long, gone binary, asked binary"
ASKED = (("key", "<u8"), ("p", "<u4"), ("role", "u1"))


def meet(batches):
    """Parts one after another: line numbers that go because the line came before; keys under which different lines meet."""
    for part in by_part(batches):
        yield from meet_part(part)


def meet_part(batches):
    lines, keys, gone = [], [], []
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            (lines, keys, gone)[kind].append(blob)
    out = [unpack(gone, GONE)]
    x = unpack(lines, LINE)
    again = first_of(x, ("line",))[1]
    out.append({c: x[c][again] for c, _ in GONE})
    out = joined(out)
    x = unpack(keys, KEY)
    x = pick(x, first_of(x, ("key", "role", "line"))[0])
    order = np.lexsort((x["line"], x["role"], x["key"]))
    x = pick(x, order)
    key, asked = x["key"], {c: np.zeros(0, d) for c, d in (*GONE, ("key", "<u8"), ("role", "u1"))}
    if len(key):
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        n = np.diff(np.append(begin, len(key)))
        indexed = np.add.reduceat((x["role"] == 0).astype(np.int64), begin)
        low, high = np.minimum.reduceat(x["line"], begin), np.maximum.reduceat(x["line"], begin)
        many = (indexed > 0) & (indexed < n) & (low != high)
        keep = many[group]
        place = np.arange(len(key)) - begin[group]  # indexed lines come first in their group
        blocks = -(-indexed // BLOCK)
        times = np.where(x["role"] == 1, blocks[group], 1)[keep]
        x = {c: np.repeat(v[keep], times) for c, v in x.items()}
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        block = np.where(x["role"] == 1, turn, np.repeat((place // BLOCK)[keep], times)).astype(np.uint64)
        x["key"] = mix(x["key"] + block * np.uint64(0xD6E8FEB86659FD93))
        asked = {c: x[c] for c in asked}
    everything = np.concatenate((out["k"], asked["k"])), np.concatenate((out["h"], asked["h"]))
    if not len(everything[0]):
        return
    docs = np.unique(np.rec.fromarrays(everything, names="k,h"))

    def by_document(x: dict[str, np.ndarray], kind: tuple) -> list[bytes | None]:
        order = np.lexsort((x["p"], x["h"], x["k"]))
        x = pick(x, order)
        rec = np.rec.fromarrays((x["k"], x["h"]), names="k,h")
        a, b = np.searchsorted(rec, docs, side="left"), np.searchsorted(rec, docs, side="right")
        return [pack(pick(x, slice(i, j)), kind) if i < j else None for i, j in zip(a, b, strict=True)]

    gone_by, asked_by = by_document(out, GONE), by_document(asked, ASKED)
    for i in range(0, len(docs), 4096):
        s = slice(i, i + 4096)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(docs["k"][s])), pa.array(np.ascontiguousarray(docs["h"][s])), pa.array(gone_by[s], pa.binary()), pa.array(asked_by[s], pa.binary())], ["k", "h", "gone", "asked"])


TOLD = "key long, role int, k long, h long, p int, line string"


def fetch(batches):
    """The lines that meet others, under each of their keys."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows: list[tuple] = []
            for k, h, text, blobs in zip(*(batch.slice(start, 256).column(c).to_pylist() for c in ("k", "h", "text", "asked")), strict=True):
                lines = (text or "").split("\n")
                x = unpack(blobs, ASKED)
                rows += [(key, role, k, h, p, lines[p]) for key, role, p in zip(x["key"].view(np.int64).tolist(), x["role"].tolist(), x["p"].tolist(), strict=True)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["key", "role", "k", "h", "p", "line"])


def common_start(a: str, b: str) -> int:
    """How many characters a and b share at their start: by halving, each step one comparison of memory."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within(a: str, b: str, edits: int) -> bool:
    """Whether a and b are at most edits edits apart.

    After what is common at both ends, one machine word for each error count holds which diagonals of
    the band are still alive: bit d stands for pattern position = text position + d - edits.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    cut = common_start(a, b)
    a, b = a[cut:], b[cut:]
    cut = common_start(a[::-1], b[::-1])
    a, b = a[: len(a) - cut], b[: len(b) - cut]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << (i + edits)
    full = (1 << (2 * edits + 1)) - 1
    alive = [0] * (edits + 1)
    alive[0] = 1 << edits
    for e in range(1, edits + 1):
        alive[e] = alive[e - 1] | (alive[e - 1] << 1) & full
    for j, c in enumerate(b):
        equal = (at.get(c, 0) >> j) & full
        before = alive
        alive = [before[0] & equal]
        for e in range(1, edits + 1):
            now = before[e] & equal | before[e - 1] | before[e - 1] >> 1
            alive.append((now | alive[e - 1] << 1) & full)
        if not any(alive):
            return False
    d = len(a) - len(b) + edits
    return bool(alive[edits] >> d & 1)


def histogram(line: str) -> np.ndarray:
    return np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) % 32, minlength=32).astype(np.int32)


def verify(edits: int, full: int) -> Callable:
    """Sorted by key, role, k, p: each probing line against the indexed lines of its key; the later of a pair (by k, p, h) goes."""

    def run(batches):
        now, held, out = None, [], []
        hist = None
        for batch in batches:
            for key, role, k, h, p, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, held, hist = key, [], None
                if role == 0:
                    held.append([k, p, h, line, False])
                    continue
                if len(held) > 64:
                    if hist is None:
                        hist = np.stack([histogram(x[3]) for x in held])
                    near = np.flatnonzero(np.abs(hist - histogram(line)).sum(axis=1) <= 2 * edits)
                    some = [held[i] for i in near]
                else:
                    some = held
                gone = False
                for x in some:
                    mine = (x[0], x[1], x[2]) < (k, p, h)
                    if x[3] == line or (gone if mine else x[4]):
                        continue
                    if within(x[3], line, int(allowed(min(len(x[3]), len(line)), edits, full))):
                        if mine:
                            gone = True
                            out.append((k, h, p))
                        else:
                            x[4] = True
                            out.append((x[0], x[2], x[1]))
            if out:
                yield gone_batch(out)
                out = []

    return run


def gone_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    blobs = [pack({"k": np.array([k]), "h": np.array([h]), "p": np.array([p])}, GONE) for k, h, p in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(blobs, pa.binary())], ["k", "h", "gone"])


def gone_lines(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS, short: bool = True) -> DataFrame:
    """k, h, gone: of each row with lines to remove, packed line numbers, several times where several things remove them."""
    parts, buckets = shuffle_parts(docs), buckets_for(docs)
    full = max(least, edits + 1)
    rows = keyed(docs, [])
    met = dealt(rows.mapInArrow(send(edits, full, 1 if short else full, buckets), SENT), buckets).mapInArrow(meet, MET)
    met = materialize(met, "lines")
    asked = met.where(F.col("asked").isNotNull()).groupBy("k", "h").agg(F.collect_list("asked").alias("asked"))
    told = rows.join(asked, ["k", "h"]).select("k", "h", "text", "asked").mapInArrow(fetch, TOLD)
    near = told.repartition(parts, "key").sortWithinPartitions("key", "role", "k", "p").mapInArrow(verify(edits, full), "k long, h long, gone binary")
    near = materialize(near, "near-lines")
    return met.where(F.col("gone").isNotNull()).select("k", "h", F.col("gone"), F.lit(False).alias("near")).unionByName(near.withColumn("near", F.lit(True)))


def dedup_lines(docs: DataFrame, keep: list[str], edits: int = EDITS, least: int = MIN_CHARS, short: bool = True) -> DataFrame:
    """keep's columns, n_lines, equal and near (numbers of lines that go, from 0; near only what isn't equal), kept text of every row."""
    found = gone_lines(docs, edits, least, short).groupBy("k", "h").agg(F.collect_list(F.when(~F.col("near"), F.col("gone"))).alias("equal"), F.collect_list(F.when(F.col("near"), F.col("gone"))).alias("near"))
    rows = keyed(docs, keep).join(found, ["k", "h"], "left").select(*keep, F.col("text").alias("_text"), F.col("equal").alias("_equal"), F.col("near").alias("_near"))
    schema = with_fields(rows, keep, "n_lines long, equal array<int>, near array<int>, kept string")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, made = batch.slice(start, 256), []
                for text, equal, near in zip(*(part.column(c).to_pylist() for c in ("_text", "_equal", "_near")), strict=True):
                    lines = (text or "").split("\n")
                    same = set(unpack(equal or [], GONE)["p"].tolist())
                    like = set(unpack(near or [], GONE)["p"].tolist()) - same
                    kept = "\n".join(x for i, x in enumerate(lines) if i not in same and i not in like) if same or like else text
                    made.append((len(lines), sorted(same), sorted(like), kept))
                kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True))], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: lines, how many went as equal or near to an earlier one, which, and a digest of the text that stays."""
    out = dedup_lines(read_documents(spark, sf_dir), ["doc_id"], short=True)
    return out.select("doc_id", "n_lines", F.size("equal").cast("long").alias("n_equal"), F.size("near").cast("long").alias("n_near"), "near", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))

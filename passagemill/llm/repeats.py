"""Where documents may hold what another document holds: the filter before operators 7 and 10.

A document is a sequence of symbols (bytes, words); a window is `length` of them in a row. To match
every window of every document would send many times the input through a shuffle, so a filter comes
first that loses no repeat: the `gram`-symbol gram with the least hash in a window is its anchor,
windows in a row with one anchor are a run, and equal windows have equal anchors at equal distance,
wherever they are. Runs meet by anchor. Told to the documents are runs whose content another document
seems to have (COPY), runs that meet other content under their anchor and agree with it left or right
of the anchor (OPEN; of copies only the least document's run), and runs of anchors with more than
CROWD different contents (HOT), which are not compared at all. The filter goes by 64-bit hashes, and
equal strings have equal ones: it may tell too much, never too little, and what it tells is matched
on the symbols themselves by the operators.

Hot anchors: before the shuffle each batch keeps one run of each content, so of each content one run
for each batch travels, however many copies there are; a receiving part that holds many runs first
drops copies, then the runs of crowded anchors, so its memory doesn't follow either.

Documents without id count as larger than all others. Rows of one doc_id are told apart by a 64-bit
hash of their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, buckets_for, by_part, dealt, materialize, slices

BASE = 0x9E3779B97F4A7C15 | 5
STEP = 1 << 18  #: symbols hashed together, but for longer documents
FLUSH = 400_000  #: runs that a map task gathers before it sends them
HELD = 2_000_000  #: runs that a part gathers before it drops copies and crowded anchors
CROWD = 4_096  #: different contents under one anchor that are compared
PLACE = np.uint64(31)  #: bits of a place in a batch of symbols
COPY, OPEN, HOT = 0, 1, 2

#: Symbols of texts: their hashes, and how many symbols each text has.
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
Columns = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    symbols: Symbols
    length: int  #: symbols of a window
    gram: int  #: symbols of an anchor


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit number over all bits (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Sums:
    """Polynomial prefix sums of a symbol array: the name of any stretch in constant time."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols) + 1
        if len(Sums.powers) < n:
            for name, base in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(Sums, name, np.cumprod(x, dtype=np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(symbols * Sums.powers[: n - 1], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Names of all stretches of size symbols."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * Sums.inverse[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Sums.inverse[start])


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width values in a row."""
    have = 1
    while have < width:
        ahead = min(have, width - have)
        x = np.minimum(x[:-ahead], x[ahead:])
        have += ahead
    return x


def runs(symbols: np.ndarray, counts: np.ndarray, shape: Shape, sums: Sums | None = None) -> Columns:
    """The runs of texts that lie one after another in symbols: text, first window p (in its text) and at (in symbols), windows n, key, content, left, right."""
    none = {k: np.zeros(0, np.int64) for k in ("text", "p", "at", "n", "key", "content", "left", "right")}
    first = np.concatenate(([0], np.cumsum(counts)))
    total, span = int(first[-1]), shape.length - shape.gram + 1
    starts = total - shape.length + 1
    if starts <= 0:
        return none
    sums = sums or Sums(symbols)
    grams = sums.all(shape.gram)
    packed = ((grams >> PLACE) << PLACE) | np.arange(len(grams), dtype=np.uint64)  # of equal hashes the first: content alone decides
    anchor = (least(packed, span) & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)[:starts]
    text = np.repeat(np.arange(len(counts)), counts)[:starts]
    inside = np.arange(starts) + shape.length <= first[text + 1]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    p = np.flatnonzero(begin)
    if not len(p):
        return none
    ends = np.flatnonzero(begin | ~inside)
    after = np.searchsorted(ends, p, side="right")
    n = np.where(after < len(ends), ends[np.minimum(after, len(ends) - 1)], starts) - p
    a, owner = anchor[p], text[p]
    side = (shape.length - shape.gram) // 2
    has_left, has_right = a - side >= p, a + shape.gram + side <= p + n - 1 + shape.length
    content = sums.at(p, p + n - 1 + shape.length) ^ mix((a - p).astype(np.uint64) * np.uint64(64) + n.astype(np.uint64))
    left = np.where(has_left, sums.at(np.where(has_left, a - side, a), a + shape.gram) % np.uint64(255) + np.uint64(1), 0)
    right = np.where(has_right, sums.at(a, np.where(has_right, a + shape.gram + side, a)) % np.uint64(255) + np.uint64(1), 0)
    return {"text": owner, "p": p - first[owner], "at": p, "n": n, "key": grams[a], "content": content, "left": left, "right": right}


RUN = (("key", "<u4"), ("content", "<u8"), ("left", "u1"), ("right", "u1"), ("k", "<i8"), ("h", "<i8"), ("p", "<u4"), ("n", "u1"))
SPAN = (("k", "<i8"), ("h", "<i8"), ("p", "<u4"), ("n", "<u4"), ("kind", "u1"))
OWN = (("p", "<u4"), ("n", "<u4"), ("kind", "u1"))  #: spans of one document


def pack(columns: Columns, kind: tuple) -> bytes:
    return b"".join([len(columns[kind[0][0]]).to_bytes(8, "little"), *(np.ascontiguousarray(columns[name], dtype).tobytes() for name, dtype in kind)])


def unpack(blobs: list, kind: tuple) -> Columns:
    out: dict[str, list] = {name: [] for name, _ in kind}
    for blob in blobs:
        n, at = int.from_bytes(blob[:8], "little"), 8
        for name, dtype in kind:
            out[name].append(np.frombuffer(blob, dtype, n, at))
            at += n * np.dtype(dtype).itemsize
    return {name: np.concatenate(x) if x else np.zeros(0, dtype) for (name, dtype), x in zip(kind, out.values(), strict=True)}


def pick(columns: Columns, at: np.ndarray | slice) -> Columns:
    return {k: v[at] for k, v in columns.items()}


def joined(parts: list[Columns]) -> Columns:
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}


def settle(x: Columns, by: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by content; in it, whether a smaller document has the same, and whether another document has."""
    order = np.lexsort((x["k"], *(x[c] for c in by)))
    if not len(order):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in by:
        v = x[c][order]
        new[1:] |= v[1:] != v[:-1]
    start = np.flatnonzero(new)
    group, k = np.cumsum(new) - 1, x["k"][order]
    last = np.append(start[1:], len(order)) - 1
    return order, k > k[start][group], (k[start] != k[last])[group]


def groups_of_many(x: Columns, by: tuple[str, str]) -> np.ndarray:
    """Whether a row's group (of the two columns, the second not 0) has several documents."""
    if not len(x["k"]):
        return np.zeros(0, bool)
    order = np.lexsort((x["k"], x[by[1]], x[by[0]]))
    a, b, k = x[by[0]][order], x[by[1]][order], x["k"][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(order)) - 1
    out = np.zeros(len(order), bool)
    out[order] = (k[start] != k[last])[np.cumsum(new) - 1] & (b != 0)
    return out


def text_slices(batch: pa.RecordBatch, symbols: Symbols) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in slices(batch, "text", STEP):
        yield part, *symbols(part.column("text"))


def blobs_by_part(x: Columns, part_of: np.ndarray, kind: tuple) -> Iterator[tuple[int, bytes]]:
    """One blob for each part that has rows."""
    order = np.argsort(part_of, kind="stable")
    of = part_of[order]
    edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(of[a]), pack(pick(x, order[a:b]), kind)


def spans_of(x: Columns, kind: int) -> Columns:
    return {"k": x["k"], "h": x["h"], "p": x["p"], "n": x["n"].astype(np.uint32), "kind": np.full(len(x["k"]), kind, np.uint8)}


def merged(x: Columns) -> Columns:
    """Spans sorted by document, kind, place; those of one kind that touch or overlap are one."""
    if not len(x["k"]):
        return x
    x = pick(x, np.lexsort((x["p"], x["kind"], x["h"], x["k"])))
    new = np.zeros(len(x["k"]), bool)
    for c in ("k", "h", "kind"):
        new[1:] |= x[c][1:] != x[c][:-1]
    group = np.cumsum(new).astype(np.int64) << 33
    end = np.maximum.accumulate(group + x["p"] + x["n"])
    new[0] = True
    new[1:] |= group[1:] + x["p"][1:] > end[:-1]
    head = np.flatnonzero(new)
    n = end[np.append(head[1:], len(end)) - 1] - group[head] - x["p"][head]
    return pick(x, head) | {"n": n.astype(np.uint32)}


#: Blobs on their way to a part: told are spans that need no meeting.
SENT = "part int, told boolean, blob binary"


def sent(rows: list[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        part, told, blob = zip(*rows[i : i + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(told, pa.bool_()), pa.array(blob, pa.binary())], ["part", "told", "blob"])


def send_runs(shape: Shape, parts: int) -> Callable:
    def flush(got: list[Columns]) -> Iterator[pa.RecordBatch]:
        x = joined(got)
        order, smaller, many = settle(x, ("key", "content"))
        rows = []
        if many.any():
            known = pick(x, order[many])
            rows.append((int(known["content"][0] % np.uint64(parts)), True, pack(spans_of(known, COPY), SPAN)))
        x = pick(x, np.sort(order[~smaller]))
        part_of = (x["key"] % np.uint64(parts)).astype(np.int32)
        x["key"] = (x["key"] >> np.uint64(32)).astype(np.uint32)
        yield from sent(rows + [(i, False, blob) for i, blob in blobs_by_part(x, part_of, RUN)])

    def run(batches):
        got, held = [], 0
        for batch in batches:
            for part, symbols, counts in text_slices(batch, shape.symbols):
                x = runs(symbols, counts, shape)
                if len(x["p"]):
                    owner = x.pop("text")
                    del x["at"]
                    got.append(x | {"k": part.column("k").to_numpy()[owner], "h": part.column("h").to_numpy()[owner]})
                    held += len(owner)
                if held >= FLUSH:
                    yield from flush(got)
                    got, held = [], 0
        if got:
            yield from flush(got)

    return run


TO_DOCUMENTS = "part int, blob binary"


def by_document(x: Columns, parts: int) -> Iterator[pa.RecordBatch]:
    """Spans as one blob for each part that documents are dealt to."""
    if len(x["k"]):
        part_of = (mix(x["k"].astype(np.uint64) ^ mix(x["h"].astype(np.uint64))) % np.uint64(parts)).astype(np.int32)
        rows = list(blobs_by_part(x, part_of, SPAN))
        for i in range(0, len(rows), 64):
            part, blob = zip(*rows[i : i + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["part", "blob"])


SPANS = "k long, h long, spans binary"


def gather(batches):
    """Parts of documents: a row for each document that has spans, merged by kind."""
    for part in by_part(batches):
        held: list[Columns] = []
        for batch in part:
            held.append(unpack(batch.column("blob").to_pylist(), SPAN))
            if len(held) > 64:
                held = [merged(joined(held))]
        x = merged(joined(held))
        if not len(x["k"]):
            continue
        new = (x["k"][1:] != x["k"][:-1]) | (x["h"][1:] != x["h"][:-1])
        edge = np.concatenate(([0], np.flatnonzero(new) + 1, [len(x["k"])]))
        for i in range(0, len(edge) - 1, 4096):
            some = edge[i : i + 4097]
            blobs = [pack(pick(x, slice(a, b)), OWN) for a, b in zip(some[:-1], some[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x["k"][some[:-1]]), pa.array(x["h"][some[:-1]]), pa.array(blobs, pa.binary())], ["k", "h", "spans"])


def to_documents(met: DataFrame, buckets: int, name: str) -> DataFrame:
    """k, h, spans of blobs (part, blob) by by_document, as a table."""
    return materialize(dealt(met, buckets).mapInArrow(gather, SPANS), name)


def meet_runs(parts: int) -> Callable:
    """Parts of runs: which may repeat, and how."""

    def squeeze(x: Columns, crowded: np.ndarray) -> tuple[Columns, np.ndarray, list[Columns]]:
        """x without copies of a smaller document's run and without crowded anchors, the crowded anchors, and what is told of those that went."""
        order, smaller, many = settle(x, ("key", "content"))
        told = [spans_of(pick(x, order[smaller]), COPY)]
        x["twin"] = x["twin"].copy()
        x["twin"][order] |= many
        x = pick(x, order[~smaller])
        keys, n = np.unique(x["key"], return_counts=True)
        crowded = np.union1d(crowded, keys[n > CROWD])
        hot = np.isin(x["key"], crowded)
        told += [spans_of(pick(x, hot), HOT), spans_of(pick(x, hot & x["twin"]), COPY)]
        return pick(x, ~hot), crowded, told

    def run(batches):
        for part in by_part(batches):
            told: list[Columns] = [unpack([], SPAN)]
            x, crowded = unpack([], RUN) | {"twin": np.zeros(0, bool)}, np.zeros(0, np.uint32)
            more: list[Columns] = []
            held = 0
            for batch in part:
                for known, blob in zip(batch.column("told").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                    got = unpack([blob], SPAN if known else RUN)
                    (told if known else more).append(got if known else got | {"twin": np.zeros(len(got["k"]), bool)})
                    held += len(got["k"])
                if held > HELD:
                    x, crowded, went = squeeze(joined([x, *more]), crowded)
                    yield from by_document(merged(joined(told + went)), parts)
                    told, more, held = [unpack([], SPAN)], [], len(x["k"]) // 2
            x, crowded, went = squeeze(joined([x, *more]), crowded)
            told += [*went, spans_of(pick(x, x["twin"]), COPY)]
            told.append(spans_of(pick(x, groups_of_many(x, ("key", "left")) | groups_of_many(x, ("key", "right"))), OPEN))
            yield from by_document(merged(joined(told)), parts)

    return run


def keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns, k (orders documents), h (tells rows of one doc_id apart), text."""
    return docs.select(*keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64("text").alias("h"), "text")


def candidates(docs: DataFrame, shape: Shape) -> DataFrame:
    """k, h and spans (packed as OWN) of docs' rows that may share windows with others, as a table."""
    parts = buckets_for(docs)
    met = dealt(keyed(docs, []).mapInArrow(send_runs(shape, parts), SENT), parts).mapInArrow(meet_runs(parts), TO_DOCUMENTS)
    return to_documents(met, parts, "candidates")


def inside(x: Columns, spans: Columns, kind: int) -> np.ndarray:
    """Which runs of one document start in a span of this kind. spans: sorted by kind and place, as gather leaves them."""
    of = spans["kind"] == kind
    start, end = spans["p"][of].astype(np.int64), spans["p"][of].astype(np.int64) + spans["n"][of]
    i = np.searchsorted(start, x["p"], side="right") - 1
    return (i >= 0) & (x["p"] < end[np.maximum(i, 0)]) if len(start) else np.zeros(len(x["p"]), bool)


def chosen_runs(batches: Iterable[pa.RecordBatch], shape: Shape) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Sums, Columns]]:
    """Of batches (k, h, text, spans): rows of a slice, their symbols, sums, and the runs that lie in spans, with k, h and flags copy, open, hot."""
    for batch in batches:
        for part, symbols, counts in text_slices(batch, shape.symbols):
            sums = Sums(symbols)
            x = runs(symbols, counts, shape, sums)
            edge = np.searchsorted(x["text"], np.arange(part.num_rows + 1))
            flags = np.zeros((3, len(x["p"])), bool)
            for i in range(part.num_rows):
                spans, own = unpack([part.column("spans")[i].as_py()], OWN), pick(x, slice(edge[i], edge[i + 1]))
                for kind in (COPY, OPEN, HOT):
                    flags[kind, edge[i] : edge[i + 1]] = inside(own, spans, kind)
            x |= {"copy": flags[COPY], "open": flags[OPEN], "hot": flags[HOT], "k": part.column("k").to_numpy()[x["text"]], "h": part.column("h").to_numpy()[x["text"]]}
            yield part, symbols, sums, pick(x, flags.any(axis=0))


def run_starts(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values start and end."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def covered(start: np.ndarray, end: np.ndarray, count: int) -> np.ndarray:
    """Which of count symbols lie in a stretch."""
    change = np.zeros(count + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0

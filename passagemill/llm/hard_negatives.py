"""Operator 13, hard negatives: windows of scores below each positive's, filtered by quantised scores with exact bounds.

Vectors are integers, codebooks of vector_codes are integers too, and each row carries its code and the
norms of its residual's parts. A block of anchors goes to all tasks. There a lookup table holds each
anchor's products with all entries; an anchor's score with a row is the sum of the table's cells that
the row's code names, plus the product with the residual, which the norms bound part by part. Only
pairs whose interval can matter are scored exactly, in int64. Two passes are made for each block of
anchors: its positives (the best rows of the same label), then, with the positives' scores as windows,
its negatives (the best rows of other labels whose score is in the window). Each task keeps the best
few of each anchor or window, and Spark keeps the best few of these, so every result is exact.

The anchors are a stated query set; ANCHORS of them meet all rows at once, so what is sent is bounded,
and the number of passes over the rows grows with the query set. No anchor's rows are gathered.

Defined cases: rows with a null label, a null or empty vector, or a null or non-finite component take
no part. A null vec_id is no anchor, comes behind all others where scores are equal, and comes out as
null. Rows that share an anchor's vec_id aren't its positives; repeated rows count each, and equal
anchors once. Vectors of different lengths, and components beyond the largest of vector_codes, are an
error. An empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, discard, materialize
from .vector_codes import SQL_USABLE, Books, assign, blocks, cut, integers, learn, usable

SCALE, EVERY = 256, 50  #: factor of components before the floor; anchors are the rows whose vec_id it divides
POSITIVES, NEGATIVES = 5, 3  #: rows of an anchor, and of a window
LOW, HIGH = 50, 95  #: a window as hundredths of the positive's score
PART, ENTRIES, ROUNDS = 4, 256, 2  #: components of a part, entries of its codebook, rounds that move them
ANCHORS, AT_ONCE = 2_048, 128  #: anchors that meet all rows at once, and that are in one table of pairs
PAIRS = 1 << 16  #: pairs scored exactly at once


def quantised(rows: DataFrame, books: Books, scale: int) -> DataFrame:
    """rows (vec_id, label, vector) with code and residual: an entry's number and the residual's norm, rounded up, for each part."""
    width = sum(b.shape[1] for b in books)
    sent = rows.sparkSession.sparkContext.broadcast(books)  # entries x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in blocks(batch, "vector", scale, width):
                index, distance = assign(x, sent.value)
                edges = np.arange(len(x) + 1, dtype=np.int32) * index.shape[1]
                norms = np.nextafter(np.sqrt(distance.astype(np.float64)).astype(np.float32) * np.float32(1 + 1e-6), np.float32(np.inf))
                lists = [pa.ListArray.from_arrays(edges, v.ravel()) for v in (index.astype(np.int16), norms)]
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), some.column("vector"), *lists], ["vec_id", "label", "vector", "code", "residual"])

    out = f"{rows.select('vec_id', 'label', 'vector')._jdf.schema().toDDL()}, code array<short>, residual array<float>"
    return rows.select("vec_id", "label", "vector").mapInArrow(run, out)


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class Block:
    """A block of anchors: ids, labels, integer vectors, and the windows of their positives' scores (for negatives)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, books: Books, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.ids, self.labels, self.vectors, self.books, self.low, self.high = ids, labels, vectors, books, low, high
        self.norms = np.stack([np.sqrt((p * p).sum(1).astype(np.float64)) for p in cut(vectors, len(books))], 1) * (1 + 1e-9)

    def pieces(self, n: int) -> Iterator[tuple[int, Block]]:
        """Runs of n anchors and where they start, with their lookup tables: anchors x entries for each part."""
        for i in range(0, len(self.ids), n):
            out = object.__new__(Block)
            for name in ("ids", "labels", "vectors", "low", "high", "norms"):
                value = getattr(self, name)
                setattr(out, name, None if value is None else value[i : i + n])
            out.tables = [part @ book.T for part, book in zip(cut(out.vectors, len(self.books)), self.books, strict=True)]
            yield i, out

    def bounds(self, code: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """anchors x rows: the least and the greatest score that a pair can have."""
        score = np.zeros((len(self.ids), len(code)), np.int64)
        for p, cells in enumerate(self.tables):
            score += np.take(cells, code[:, p], axis=1)
        # room for the product's rounding; the sum of parts is under 2^62
        slack = self.norms @ residual.T.astype(np.float64) * (1 + 1e-9)
        slack = np.ceil(slack).astype(np.int64) + 1
        return score - slack, score + slack

    def exact(self, anchors: np.ndarray, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), PAIRS):
            out[i : i + PAIRS] = np.einsum("ij,ij->i", self.vectors[anchors[i : i + PAIRS]], x[rows[i : i + PAIRS]])
        return out


LEAST = np.iinfo(np.int64).min


class Best:
    """The k best (score down, id up) of each key so far, and the score that a newcomer must reach."""

    def __init__(self, keys: int, k: int):
        self.k, self.key, self.score, self.id = k, *(np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(keys, LEAST)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        place = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
        keep = place < self.k
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]
        last = place == self.k - 1
        self.floor[key[last]] = score[last]


def kth(values: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row's values where `where` holds, LEAST where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), LEAST)
    return np.partition(np.where(where, values, LEAST), values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def search(rows: DataFrame, block: Block, k: int, scale: int) -> DataFrame:
    """key, row_id, score: the k best rows of each task for each anchor (same label), or for each window (other labels) where the block has windows.

    key is the anchor's place in the block, or that times POSITIVES plus the window's place.
    """
    sent = rows.sparkSession.sparkContext.broadcast(block)
    width = block.vectors.shape[1]

    def same_label(part: Block, offset: int, best: Best, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        mine = (part.labels[:, None] == labels) & (part.ids[:, None] != ids)
        must = np.maximum(kth(low, mine, k), best.floor[offset : offset + len(part.ids)])
        a, r = np.nonzero(mine & (high >= must[:, None]))
        best.add(a + offset, part.exact(a, x, r), ids[r])

    def in_windows(part: Block, offset: int, best: Best, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        other = part.labels[:, None] != labels
        for w in range(part.low.shape[1]):
            least, most = part.low[:, w, None], part.high[:, w, None]
            keys = (np.arange(len(part.ids)) + offset) * POSITIVES + w
            sure = other & (low >= least) & (high <= most)
            must = np.maximum(np.maximum(kth(low, sure, k), best.floor[keys])[:, None], least)
            a, r = np.nonzero(other & (low <= most) & (high >= must))
            score = part.exact(a, x, r)
            ok = (score >= part.low[a, w]) & (score <= part.high[a, w])
            best.add(keys[a[ok]], score[ok], ids[r[ok]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        pieces = list(known.pieces(AT_ONCE))
        best = Best(len(known.ids) * (1 if known.low is None else POSITIVES), k)
        for batch in batches:
            for some, x in blocks(batch, "vector", scale, width):
                ids = pa.compute.fill_null(some.column("vec_id").cast(pa.int64()), NO_ID).to_numpy()
                labels, code, residual = some.column("label").to_numpy(), matrix(some.column("code")), matrix(some.column("residual"))
                for i, part in pieces:
                    (same_label if known.low is None else in_windows)(part, i, best, x, ids, labels, *part.bounds(code, residual))
        yield pa.RecordBatch.from_arrays([pa.array(best.key), pa.array(best.id), pa.array(best.score)], ["key", "row_id", "score"])

    made = rows.mapInArrow(run, "key long, row_id long, score long")
    w = Window.partitionBy("key").orderBy(F.desc("score"), "row_id")
    return made.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(table: DataFrame, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from a table of vec_id, label, vector (usable ones; label as a whole number)."""
    spark = table.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    parts = max(1, len((table.select("vector").first() or [[]])[0]) // PART)
    books = learn(table, scale, parts, ENTRIES, ROUNDS)
    if not books:
        return spark.createDataFrame([], out)
    rows = materialize(quantised(table, books, scale), "quantised")
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "vector").distinct()
    queries = materialize(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "label"), F.lit(max(1, -(-asked.count() // ANCHORS) * 5 // 4)))), "anchors")
    found = None
    for number in [r["block"] for r in queries.select("block").distinct().collect()]:  # one for each ANCHORS queries
        part = of_block(rows, queries.where(F.col("block") == number), books, scale)
        found = part if found is None else found.unionByName(part)
    discard(queries)
    return found if found is not None else spark.createDataFrame([], out)


def of_block(rows: DataFrame, queries: DataFrame, books: Books, scale: int) -> DataFrame:
    """The results of one block of anchors, written: about ANCHORS of them are on the driver."""
    spark = rows.sparkSession
    told = queries.select("vec_id", "label", "vector").toArrow().combine_chunks()
    ids, labels = (told.column(c).combine_chunks().cast(pa.int64()).to_numpy() for c in ("vec_id", "label"))
    vectors = integers(told.column("vector").combine_chunks(), scale, sum(b.shape[1] for b in books))
    positives = search(rows, Block(ids, labels, vectors, books), POSITIVES, scale).toArrow()  # POSITIVES rows for each anchor of the block
    anchor, place, score = positives.column("key").to_numpy(), positives.column("rank").to_numpy() - 1, positives.column("score").to_numpy()
    low, high = np.ones((len(ids), POSITIVES), np.int64), np.zeros((len(ids), POSITIVES), np.int64)  # a place without a positive: an empty window
    low[anchor, place] = -((-score * LOW) // 100)
    high[anchor, place] = score // 100 * HIGH + score % 100 * HIGH // 100
    negatives = search(rows, Block(ids, labels, vectors, books, low, high), NEGATIVES, scale)
    windows = pa.table({"key": anchor * POSITIVES + place, "anchor_id": ids[anchor], "positive_id": positives.column("row_id"), "positive_score": score})
    named = negatives.select("key", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    both = named.join(F.broadcast(spark.createDataFrame(windows)), "key")  # POSITIVES rows for each anchor of the block
    return materialize(both.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score"), "negatives")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.where(F.col("label").isNotNull() & usable("embedding"))
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return mine(rows.select("vec_id", label.alias("label"), F.col("embedding").alias("vector")))


OP13_SQL = f"""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND {SQL_USABLE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a, e b WHERE a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= {NEGATIVES}"""

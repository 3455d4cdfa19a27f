"""Operator 12, vector code compression: product quantisation whose nearest entries are exact.

Vectors are cut into parts, and each part is replaced by the number of its nearest codebook entry. The
codebooks start as the first vectors' parts and are moved to their parts' means for some rounds, all in
integers. The nearest entry is searched by one float32 matrix product for a block of rows; its scores
differ from the true ones by no more than a bound that follows from the rounding of each operation, so
every entry within twice the bound of the best is evaluated anew in int64, and ties go to the lower
index. The result is that of exact arithmetic, whatever order the product is summed in.

A task sums the parts of each entry over all its rows and gives one row for each component; the driver
gets the sums of all entries (entries x components numbers, whatever the table) and sends the new
codebooks out. No vector but the first ones goes to the driver.

Defined cases: rows whose vector is null, empty, or has a null or non-finite component go. Fewer rows
than entries give fewer entries; an empty table gives an empty result. A null vec_id comes behind all
others; of repeated vec_ids the least vector comes first. Repeated rows are encoded each. Null labels
are one label. A length that isn't a multiple of the parts gives parts that differ by one component.
Vectors of different lengths, and components that leave LARGEST after scaling, are an error, as no
code or error of theirs would be right. Extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, with_fields

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
LARGEST = 1 << 27  #: absolute value of a scaled component; sums of squares of a few thousand differences fit 64 bits
BLOCK = 4_096  #: rows of one matrix product
PAIRS = 1 << 16  #: pairs of a row and an entry that are evaluated exactly at once
SALTS = 64  #: copies of a label's sum where labels are too many to be sent
SMALL = 1_000_000  #: labels whose sums are sent to all executors

Books = list[np.ndarray]  # for each part, entries x components


def usable(vector: str) -> Column:
    """A vector with components, all of them finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def integers(vectors: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of a list column without nulls, rows x width."""
    if not len(vectors):
        return np.zeros((0, width), np.int64)
    lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} and of {lengths[lengths != width][0]} components")
    scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} / {scale}")
    return scaled.astype(np.int64).reshape(-1, width)


def cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    edges = [x.shape[1] * i // parts for i in range(parts + 1)]
    return [np.ascontiguousarray(x[:, a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest entry (the lowest of equal ones) and the squared distance.

    Squared distances less |x|^2 are |b|^2 - 2 x.b. In float32 with unit roundoff u each term is rounded
    once for each of its operands, once as a product, at most width - 1 times in the sum in any order,
    and once in the difference: at most width + 4 roundings, so the error is at most
    g (|b|^2 + 2 |x| |b|) with g = (width + 4) u / (1 - (width + 4) u), by the inequality of Cauchy and Schwarz.
    """
    rounds = (x.shape[1] + 4) * 2.0**-24
    g = rounds / (1 - rounds)
    squares = (book * book).sum(1)
    widest = float(squares.max())
    norms = np.sqrt((x * x).sum(1).astype(np.float64))
    error = 1.0001 * g * (widest + 2 * norms * np.sqrt(widest))  # and room for the rounding of this line
    scores = x.astype(np.float32) @ book.T.astype(np.float32)
    scores = squares.astype(np.float32) - 2 * scores
    limit = scores.min(1).astype(np.float64) + 2 * error
    hopeful = scores <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]
    rows, entries = np.nonzero(hopeful)
    exact = np.empty(len(rows), np.int64)
    for i in range(0, len(rows), PAIRS):
        d = x[rows[i : i + PAIRS]] - book[entries[i : i + PAIRS]]
        exact[i : i + PAIRS] = (d * d).sum(1)
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])  # each row has an entry: its best
    best = np.minimum.reduceat(exact, starts)
    hit = np.flatnonzero(exact == best[rows])
    first = hit[np.r_[True, rows[hit][1:] != rows[hit][:-1]]]
    return entries[first], best


def assign(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """rows x parts: nearest entries and squared distances."""
    found = [nearest(part, book) for part, book in zip(cut(x, len(books)), books, strict=True)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def blocks(batch: pa.RecordBatch, column: str, scale: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of BLOCK rows with their integer vectors."""
    for i in range(0, batch.num_rows, BLOCK):
        some = batch.slice(i, BLOCK)
        yield some, integers(some.column(column), scale, width)


def first_books(rows: DataFrame, scale: int, parts: int, entries: int) -> Books:
    """Codebooks of the parts of the first vectors by vec_id; [] for an empty table."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    vectors = first.column("vector").combine_chunks()
    if not len(vectors):
        return []
    return cut(integers(vectors, scale, len(vectors[0])), parts)


def moved(rows: DataFrame, books: Books, scale: int) -> Books:
    """Each entry as the floor of the mean of the parts that are nearest to it; entries without any stay."""
    width = sum(b.shape[1] for b in books)
    sent = rows.sparkSession.sparkContext.broadcast(books)  # entries x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        sums, counts = [np.zeros(b.shape, np.int64) for b in known], [np.zeros(len(b), np.int64) for b in known]
        for batch in batches:
            for _, x in blocks(batch, "vector", scale, width):
                for p, (part, index) in enumerate(zip(cut(x, len(known)), assign(x, known)[0].T, strict=True)):
                    order = np.argsort(index, kind="stable")
                    met, starts, n = np.unique(index[order], return_index=True, return_counts=True)
                    sums[p][met] += np.add.reduceat(part[order], starts)
                    counts[p][met] += n
        for p, (s, c) in enumerate(zip(sums, counts, strict=True)):
            met, k = np.flatnonzero(c), s.shape[1]
            cells = [np.full(len(met) * k, p, np.int32), np.repeat(met, k).astype(np.int32), np.tile(np.arange(k, dtype=np.int32), len(met)), s[met].ravel(), np.repeat(c[met], k)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in cells], ["part", "entry", "at", "total", "n"])

    made = rows.select("vector").mapInArrow(run, "part int, entry int, at int, total long, n long")
    sums = made.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    out = [b.copy() for b in books]
    part, entry, at, total, n = (sums.column(c).to_numpy() for c in ("part", "entry", "at", "total", "n"))
    for p, book in enumerate(out):
        here = part == p
        book[entry[here], at[here]] = total[here] // n[here]
    sent.unpersist()
    return out


def learn(rows: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks of rows (vec_id, vector; usable ones): read once for each round. Entries x components numbers, on the driver."""
    books = first_books(rows, scale, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved(rows, books, scale)
    return books


def encode(rows: DataFrame, books: Books, keep: list[str], scale: int = SCALE) -> DataFrame:
    """keep's columns, code (an entry's number for each part) and error (squared distances, summed) of the column vector."""
    width = sum(b.shape[1] for b in books)
    sent = rows.sparkSession.sparkContext.broadcast(books)
    out = with_fields(rows, keep, "code array<int>, error long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in blocks(batch, "vector", scale, width):
                index, distance = assign(x, sent.value)
                codes = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * index.shape[1], index.astype(np.int32).ravel())
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), codes, pa.array(distance.sum(1))], out.fieldNames())

    return rows.select(*keep, "vector").mapInArrow(run, out)


def with_group_sum(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df (written: it is read twice) with the sum of value over equal keys, nulls together. A key may hold any share of the rows: sums are made before the shuffle and sent or dealt back in copies."""
    sums = df.groupBy(key).agg(F.sum(value).alias(name)).select(F.col(key).alias("_k"), name)
    if sums.count() <= SMALL:
        return df.join(F.broadcast(sums), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    copies = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return salted.join(copies, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_salt") == F.col("_s"))).drop("_k", "_s", "_salt")


def digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.where(usable("embedding")).select("vec_id", "label", F.col("embedding").alias("vector"))
    books = learn(rows)
    if not books:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    coded = materialize(encode(rows, books, ["vec_id", "label"]).withColumn("code", hexed), "codes")
    return with_group_sum(coded, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


#: A vector that SQL takes: the same as usable().
SQL_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _sql() -> str:
    rounds = ",\n".join(
        f"""a{i} AS MATERIALIZED (SELECT k, part, any_value(x) AS x, min({{'d': list_dot_product(c, c) - 2 * list_dot_product(x, c), 'e': entry}}).e AS entry FROM p JOIN b{i} USING (part) GROUP BY k, part),
n{i} AS (SELECT part, entry, list(v ORDER BY pos) AS c FROM (SELECT part, entry, pos, floor(sum(v) / count(*)) AS v FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS pos FROM a{i}) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN n{i} USING (part, entry))"""
        for i in range(ROUNDS)
    )
    return f"""WITH e AS (SELECT vec_id, label, row_number() OVER () AS k, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE {SQL_USABLE}),
p AS MATERIALIZED (SELECT k, vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS x FROM e, range({PARTS}) t(part)),
b0 AS MATERIALIZED (SELECT part, entry, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id, x) - 1 AS entry FROM p) WHERE entry < {ENTRIES}),
{rounds},
f AS (SELECT k, part, min({{'d': list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c), 'e': entry}}) AS m FROM p JOIN b{ROUNDS} USING (part) GROUP BY k, part),
g AS (SELECT k, string_agg(printf('%02x', (m.e)::INT), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM f GROUP BY k),
s AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS s FROM (SELECT part, entry, unnest(c) AS v, unnest(range(len(c))) AS pos FROM b{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM e JOIN g USING (k), s"""


OP12_SQL = _sql()

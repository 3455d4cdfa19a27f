"""What the training-data operators share: tables between phases, Arrow batches, shuffle sizes."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import CLEANUP, discard, materialize, shared_dir

__all__ = ["CLEANUP", "discard", "materialize", "shared_dir"]

#: A document without an id sorts behind every other one.
NO_ID = 2**63 - 1


#: Shuffle partitions at most; beyond it several buckets share one and are read one after another.
MOST_PARTITIONS = 100_000


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def buckets_for(df: DataFrame, bytes_each: int = 6 << 20) -> int:
    """As many buckets as keep each near bytes_each of the tables that df reads, at least the session's number of partitions.

    A source that doesn't know its size (Spark says the largest number there is) is measured: the bytes of its texts are summed.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(sizes)
    if size >= 1 << 56:
        size = df.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // bytes_each)


def shuffle_parts(df: DataFrame, bytes_each: int = 6 << 20) -> int:
    """Partitions for work that sorts and streams, so that their size doesn't bind its memory."""
    return min(buckets_for(df, bytes_each), MOST_PARTITIONS)


def dealt(sent: DataFrame, buckets: int) -> DataFrame:
    """Rows (part, ...) with each part's rows one after another in one partition: one part is in memory at a time."""
    parts = min(buckets, MOST_PARTITIONS)
    if parts == buckets:
        return sent.repartitionById(parts, F.col("part"))
    return sent.repartitionById(parts, F.pmod("part", F.lit(parts))).sortWithinPartitions("part")


def by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """The batches of dealt() as one iterator for each part."""

    def runs_of() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            part = batch.column("part").to_numpy()
            edge = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []
            for a, b in itertools.pairwise(edge):
                yield int(part[a]), batch.slice(a, b - a)

    for _, group in itertools.groupby(runs_of(), lambda x: x[0]):
        yield (batch for _, batch in group)


#: Keys that join_by_key sends to all executors at most, and rows that a key may have without being one of them.
HOT_KEYS, FEW = 50_000, 1_024


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with keyed (written: it is read twice; one row for each key) where a key may hold any share of the rows.

    n names keyed's column of how many rows a key has, total is how many rows there are. Keys with more
    than FEW rows and more than one of HOT_KEYS equal shares are HOT_KEYS at most, and are sent to where
    their rows are; no other key's rows fill a task.
    """
    most = max(FEW, total // HOT_KEYS)
    hot = F.broadcast(keyed.where(F.col(n) > most).drop(n))
    cold = keyed.where(F.col(n) <= most).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy runs of rows of a batch; the strings of a run have about most_bytes together."""
    texts, start, size = batch.column(column), 0, 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if size and size + (n or 0) > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct: no name that an operator makes can clash with theirs."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


def with_fields(df: DataFrame, names: list[str], ddl: str) -> T.StructType:
    """The schema of some columns of df, then ddl's."""
    return T.StructType([*(df.schema[c] for c in names), *T.StructType.fromDDL(ddl)])


def give_back() -> None:
    """Return freed memory to the system: an idle worker shares its executor's memory with the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, fn: Callable[[list[str]], Iterable], schema: str, keep: list[str], most_bytes: int = 1 << 20, after: Callable[[], None] | None = None) -> DataFrame:
    """keep's columns of df, then what fn returns for each text: columns as lists or arrays.

    after is called when a partition is done. fn gets runs of texts of about most_bytes, so that memory doesn't follow Spark's batch size.
    """
    out = with_fields(df, keep, schema)
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", most_bytes):
                made = fn(["" if x is None else x for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made], names)
        if after:
            after()
            give_back()

    return df.select(*keep, F.col("text")).mapInArrow(run, out)

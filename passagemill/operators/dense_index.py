"""A dense index in cells: centroids by distributed Lloyd iterations, search by cells with distance bounds.

Each vector lies in the cell of its nearest centroid, and a cell knows its radius, the largest distance
from its centroid. A vector's dot product with a query is at most the centroid's plus the query's norm
times the radius. Exact search scores the PROBES most promising cells of each query and then all cells
whose bound reaches the k-th best score so far; fast search stops after the first part, with as many
cells as reached the wanted recall for some of the index's own vectors (calibrated).

Centroids are a fixed number for an index (a parameter), so what is sent to tasks and gathered from them
does not grow with the vectors. The index is written sorted by cell, its facts last; it is opened for
the vectors that it was made of only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..tables import materialize
from . import products as px
from .products import matrix
from .retrieval import QUERY_BLOCK, top_k

CELLS, LLOYD, PROBES = 64, 6, 8  #: cells of an index, iterations, cells of a query that are read first
BLOCK = 8_192  #: vectors that meet the centroids at once
RECALL, SAMPLE = 0.95, 128  #: share of the true best that calibration asks for, and vectors that it searches for


class DenseIndex(NamedTuple):
    vectors: DataFrame  # docno, doc_vec, cell
    cells: DataFrame  # cell, centroid, radius, n
    facts: Row


def fingerprint(vectors: DataFrame) -> str:
    h = F.xxhash64("docno", "doc_vec")
    one = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x")).first()
    return f"{one['n']}-{int(one['s'])}-{one['x']}"


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(1) - 2 * x @ centroids.T).argmin(1)


def learn(vectors: DataFrame, cells: int = CELLS, rounds: int = LLOYD) -> np.ndarray:
    """Centroids of docno, doc_vec. They start as the vectors with the least hashes of docno; a cell that loses all vectors keeps its centroid."""
    first = vectors.select("doc_vec", F.xxhash64("docno").alias("h")).orderBy("h", "doc_vec").limit(cells).select("doc_vec").toArrow()
    centroids = matrix(first.column("doc_vec").combine_chunks()) if len(first) else np.zeros((0, 1))
    for _ in range(rounds if len(centroids) else 0):
        sent = vectors.sparkSession.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            sums, n = np.zeros(known.shape), np.zeros(len(known))
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK):
                    x = matrix(batch.column("doc_vec").slice(i, BLOCK))
                    cell = _nearest(x, known)
                    np.add.at(sums, cell, x)
                    n += np.bincount(cell, minlength=len(known))
            met, width = np.flatnonzero(n), known.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(met, width)), pa.array(np.tile(np.arange(width), len(met))), pa.array(sums[met].ravel()), pa.array(np.repeat(n[met], width))], ["cell", "at", "total", "n"])

        made = vectors.select("doc_vec").mapInArrow(run, "cell long, at long, total double, n double").groupBy("cell", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        cell, at, total, n = (made.column(c).to_numpy() for c in ("cell", "at", "total", "n"))
        centroids = centroids.copy()
        centroids[cell, at] = total / n
        sent.unpersist()
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """docno, doc_vec, cell, and the distance from the cell's centroid."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                some = batch.slice(i, BLOCK)
                x = matrix(some.column("doc_vec"))
                cell = _nearest(x, sent.value)
                far = np.sqrt(((x - sent.value[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([some.column("docno"), some.column("doc_vec"), pa.array(cell.astype(np.int32)), pa.array(far)], ["docno", "doc_vec", "cell", "far"])

    kind = vectors.schema["doc_vec"].dataType.simpleString()
    return vectors.select("docno", "doc_vec").mapInArrow(run, f"docno string, doc_vec {kind}, cell int, far double")


def write(vectors: DataFrame, path: str, cells: int = CELLS) -> str:
    """Write the index of docno, doc_vec (no nulls, one length) and return the vectors' fingerprint."""
    spark, mark = vectors.sparkSession, fingerprint(vectors)
    centroids = learn(vectors, cells)
    dealt = assigned(vectors, centroids)
    # hot cells are cut by docno's hash: a range partition holds a share of rows, not a cell
    parts = max(2 * spark.sparkContext.defaultParallelism, int(mark.split("-")[0]) // 50_000)
    dealt.withColumn("_h", F.xxhash64("docno")).repartitionByRange(parts, "cell", "_h").sortWithinPartitions("cell").drop("_h").write.parquet(f"{path}/vectors")
    sizes = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")  # cells x components numbers
    known.join(sizes, "cell").coalesce(1).write.parquet(f"{path}/cells")
    spark.createDataFrame([Row(kind="dense", fingerprint=mark, docs=int(mark.split("-")[0]))]).coalesce(1).write.parquet(f"{path}/facts")
    return mark


def open_index(spark: SparkSession, path: str, mark: str | None = None) -> DenseIndex:
    """An index that was written, maybe by another run. An unfinished one, or one of other vectors than mark's, is an error."""
    try:
        facts = spark.read.parquet(f"{path}/facts").first()
    except Exception as e:
        raise ValueError(f"no finished index at {path}") from e
    if mark is not None and facts["fingerprint"] != mark:
        raise ValueError(f"the index at {path} has the fingerprint {facts['fingerprint']}, not {mark}")
    return DenseIndex(spark.read.parquet(f"{path}/vectors").drop("far"), spark.read.parquet(f"{path}/cells"), facts)


def search(index: DenseIndex, queries: DataFrame, k: int, exact: bool = True, probes: int = PROBES, places: int = 9) -> tuple[DataFrame, DataFrame]:
    """qid, docno, score, rank of the k best by dot product, and of each query the vectors of the index and how many were scored.

    queries: qid, query_vec, a stated set; QUERY_BLOCK of them meet the cells at once.
    """
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    found = read = None
    for i in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        f, r = _search_block(index, materialize(some, "queries"), k, exact, probes, places)
        found, read = (f, r) if found is None else (found.unionByName(f), read.unionByName(r))
    return found, read


def _search_block(index: DenseIndex, queries: DataFrame, k: int, exact: bool, probes: int, places: int) -> tuple[DataFrame, DataFrame]:
    middle = vx.dot(F.col("query_vec"), F.col("centroid"))
    bound = (middle + vx.l2(F.col("query_vec")) * F.col("radius")) * 1.0
    every = queries.crossJoin(F.broadcast(index.cells)).select("qid", "cell", "n", middle.alias("middle"), bound.alias("bound"))  # a stated set and CELLS rows
    order = F.desc("bound" if exact else "middle")
    cells = materialize(every.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(order, "cell"))), "cells")

    asked = queries.select("qid", "query_vec").toArrow()
    ids = asked.column("qid").combine_chunks()

    def scored(wanted: DataFrame, least: DataFrame | None = None) -> DataFrame:
        pairs = px.of_queries(ids, wanted.select("qid", "cell").toArrow())  # QUERY_BLOCK x CELLS rows at most
        return px.best(index.vectors, asked, k, places, pairs, None if least is None else px.of_queries(ids, least.select("qid", "_least").toArrow(), "_least"))

    first = materialize(top_k(scored(cells.where(F.col("place") <= probes)), k), "first-cells")
    hopeful = cells.withColumn("read", F.col("place") <= probes)
    if exact:
        least = first.where(F.col("rank") == k).select("qid", F.col("score").alias("_least"))
        room = 1e-9 * (1 + F.abs("bound")) + 10.0**-places  # rounding of sums and of scores
        hopeful = hopeful.join(least, "qid", "left").withColumn("read", F.col("read") | F.col("_least").isNull() | (F.col("bound") + room >= F.col("_least")))
        first = top_k(first.drop("rank").unionByName(scored(hopeful.where(F.col("read") & (F.col("place") > probes)), least)), k)
    return first, hopeful.groupBy("qid").agg(F.sum("n").alias("vectors"), F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)).alias("scored"))


def calibrated(index: DenseIndex, k: int, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """The fewest cells of a query that hold this share of the true k best, measured on the vectors with the least hashes of docno (without themselves)."""
    some = materialize(index.vectors.select(F.col("docno").alias("qid"), F.col("doc_vec").alias("query_vec")).orderBy(F.xxhash64("docno"), "docno").limit(sample), "sample")
    true = search(index, some, k + 1)[0].where("qid <> docno").select("qid", "docno")
    places = some.crossJoin(F.broadcast(index.cells)).select("qid", "cell", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(vx.dot(F.col("query_vec"), F.col("centroid"))), "cell")).alias("place"))  # SAMPLE x CELLS rows
    hit = index.vectors.select("docno", "cell").join(F.broadcast(true), "docno").join(F.broadcast(places), ["qid", "cell"])  # SAMPLE x k rows
    return hit.agg(F.expr(f"percentile_disc({recall}) WITHIN GROUP (ORDER BY place)").alias("p")).first()["p"] or 1

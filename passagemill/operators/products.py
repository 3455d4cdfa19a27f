"""The k best dot products of a stated query set with many vectors, by matrix products inside tasks.

Spark deals the vectors to tasks and merges what they find; QUERY_BLOCK queries are sent at a time. A
matrix product only says which pairs can be among the k best, with room for its rounding: these are
added up component by component, as Spark's dot product does it, so equal vectors have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that meet a block of queries at once, pairs that are added up at once, and pairs that a task holds before it keeps the k best.
ROWS, PAIRS, HELD = 2_048, 1 << 16, 1 << 18
LARGE = 1e100  #: components from here on, and those that are no numbers, go by Spark's dot product
FOUND = "qid string, docno string, score double"


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def regular(vector: Column, width: int) -> Column:
    """Whether a vector has this length and nothing but numbers under LARGE."""
    return F.coalesce((F.size(vector) == width) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < LARGE, F.lit(False))), F.lit(False))


def of_queries(ids: pa.Array, pairs: pa.Table, value: str | None = None) -> np.ndarray:
    """What pairs say of each of ids: which cells they have (a row for each id), or the column value, minus infinity where there is none."""
    at = pd.Categorical(pairs.column("qid").to_pandas(), categories=pd.unique(ids.to_pandas())).codes
    mine = pd.Categorical(ids.to_pandas(), categories=pd.unique(ids.to_pandas())).codes
    if value is None:
        cell = pairs.column("cell").to_numpy()
        out = np.zeros((len(ids), int(cell.max(initial=-1)) + 1), bool)
        out[at, cell] = True
    else:
        out = np.full(len(ids), -np.inf)
        out[at] = pairs.column(value).to_numpy()
    return out[mine]


def rounded(score: np.ndarray, places: int | None) -> np.ndarray:
    """Half away from zero, as SQL has it."""
    return score if places is None else np.copysign(np.floor(np.abs(score) * 10.0**places + 0.5), score) / 10.0**places + 0.0


def _added_up(x: np.ndarray, q: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Products of the columns row of x and at of q, summed in the order of their components."""
    out = np.zeros(len(row))
    for i in range(0, len(row), PAIRS):
        r, a, part = row[i : i + PAIRS], at[i : i + PAIRS], out[i : i + PAIRS]
        for left, right in zip(x, q, strict=True):
            part += left[r] * right[a]
    return out


def _k_best(pairs: pa.Table, k: int) -> tuple[pa.Table, np.ndarray]:
    """The k best pairs of each query (ties by docno), and each one's place."""
    pairs = pairs.take(pc.sort_indices(pairs, sort_keys=[("at", "ascending"), ("score", "descending"), ("docno", "ascending")], null_placement="at_start"))
    at = pairs.column("at").to_numpy()
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return pairs.filter(pa.array(place < k)), place[place < k]


class Kept:
    """The k best pairs of each query that a task has seen, and for each query a score that they reach."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None) -> None:
        self.k, self.least, self.held = k, np.full(queries, -np.inf) if least is None else least.copy(), []

    def add(self, at: np.ndarray, score: np.ndarray, docno: pa.Array) -> None:
        self.held.append(pa.table({"at": at, "score": score, "docno": docno}))
        if sum(map(len, self.held)) > max(HELD, 2 * self.k * len(self.least)):
            self.keep()

    def keep(self) -> None:
        some, place = _k_best(pa.concat_tables(self.held), self.k)
        last = place == self.k - 1
        at = some.column("at").to_numpy()[last]
        self.least[at] = np.maximum(self.least[at], some.column("score").to_numpy()[last])
        self.held = [some]

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.keep()
            yield from self.held[0].to_batches()


def best_of_task(batches: Iterator[pa.RecordBatch], ids: pa.Array, q: np.ndarray, k: int, places: int | None, wanted: np.ndarray | None, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """qid, docno, score of the k best of a task's vectors for each query. wanted: which queries (rows) ask for which cells, where the vectors have a cell. least: scores that the k best of all reach."""
    norms, columns = np.sqrt((q * q).sum(1)), np.ascontiguousarray(q.T)
    unit, held = 0.0 if places is None else 10.0**-places, Kept(len(q), k, least)
    least = held.least
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            some = batch.slice(i, ROWS)
            x, cell = matrix(some.column("doc_vec")), np.zeros(some.num_rows, int) if wanted is None else some.column("cell").to_numpy()
            for c in np.unique(cell):
                asked = np.arange(len(q)) if wanted is None else np.flatnonzero(wanted[:, c]) if c < wanted.shape[1] else []
                if not len(asked):
                    continue
                of_cell = np.flatnonzero(cell == c)
                y = x[of_cell]
                near = q[asked] @ y.T
                room = unit + 1e-12 * norms[asked] * np.sqrt((y * y).sum(1).max())
                first = np.flatnonzero(least[asked] == -np.inf)
                if len(first) and len(y) >= k:
                    least[asked[first]] = np.partition(near[first], len(y) - k, axis=1)[:, len(y) - k]
                at, row = np.nonzero(~(near < (least[asked] - room)[:, None]))
                row, at = of_cell[row], asked[at]
                score = rounded(_added_up(x.T, columns, row, at), places)
                held.add(at, score, some.column("docno").take(pa.array(row)))
    for some in held.batches():
        yield pa.RecordBatch.from_arrays([ids.take(some.column("at")), some.column("docno"), some.column("score")], ["qid", "docno", "score"])


def best(vectors: DataFrame, queries: pa.Table, k: int, places: int | None = None, wanted: np.ndarray | None = None, least: np.ndarray | None = None) -> DataFrame:
    """qid, docno, score: candidates that hold the k best of each query of a block (an Arrow table of qid and query_vec). vectors: docno, doc_vec, and cell with wanted."""
    ids, q = queries.column("qid").combine_chunks(), matrix(queries.column("query_vec").combine_chunks())
    sent = vectors.sparkSession.sparkContext.broadcast((ids, q, wanted, np.full(len(q), -np.inf) if least is None else least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, wanted, least = sent.value
        return best_of_task(batches, ids, q, k, places, wanted, least)

    return vectors.mapInArrow(run, FOUND)

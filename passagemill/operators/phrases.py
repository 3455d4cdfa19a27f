"""Which rows hold which phrases (runs of words) of a stated set, found inside tasks: phrases are sent, and rows stay where they are."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

HEAD = 5  #: leading words of a phrase that make a row a match; phrases have so many or more
PAIRS = 1 << 20  #: pairs of a place and a phrase that are compared at once
HELD = "array<struct<qid:string,label:int>>"


class Phrases(NamedTuple):
    """Words of phrase i lie from starts[i] to starts[i + 1]; order has phrases by the keys of their heads."""

    ids: pa.Array
    known: pa.Array
    first: np.ndarray  # whether a word (a place in known; the last one stands for all others) begins a phrase
    words: np.ndarray
    starts: np.ndarray
    order: np.ndarray
    keys: np.ndarray


def _keys(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for the HEAD words from each place. Others may share it, so words are compared behind it."""
    key = np.zeros(len(at), np.uint64)
    for j in range(HEAD):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[at + j].astype(np.uint64)
    return key


def phrases(topics: pa.Table) -> Phrases:
    """topics: qid, and words w, HEAD or more."""
    ids, words = (pa.concat_arrays(topics.column(c).chunks) if topics.num_rows else pa.array([], topics.schema.field(c).type) for c in ("qid", "w"))
    coded = words.flatten().dictionary_encode()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())]).astype(np.int64)
    codes, first = coded.indices.to_numpy(), np.zeros(len(coded.dictionary) + 1, bool)
    first[codes[starts[:-1]]] = True
    keys = _keys(codes, starts[:-1])
    order = np.argsort(keys, kind="stable")
    return Phrases(ids, coded.dictionary, first, codes, starts, order, keys[order])


def found(words: pa.ListArray, p: Phrases) -> pa.ListArray:
    """The phrases of each array of words that it holds: label 2 for a whole one, 1 for its head alone."""
    upto = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())]).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    t = pc.fill_null(pc.index_in(coded.dictionary, value_set=p.known), -1).to_numpy()[coded.indices.to_numpy()]
    at = np.flatnonzero(p.first[t])
    row = np.searchsorted(upto, at, "right") - 1
    fits = at + HEAD <= upto[row + 1]
    at, row = at[fits], row[fits]
    for j in range(1, HEAD):
        fits = t[at + j] >= 0
        at, row = at[fits], row[fits]
    key = _keys(t, at)
    low = np.searchsorted(p.keys, key, "left")
    many = np.searchsorted(p.keys, key, "right") - low
    at, row, low, many = (x[many > 0] for x in (at, row, low, many))
    pairs, start, cells, labels = np.concatenate([[0], np.cumsum(many)]), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    while start < len(at):
        end = max(start + 1, int(np.searchsorted(pairs, pairs[start] + PAIRS, "right")) - 1)
        some = many[start:end]
        place, of = np.repeat(at[start:end], some), np.repeat(row[start:end], some)
        phrase = p.order[np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[start:end], some)]
        same = reduce(np.logical_and, (t[place + j] == p.words[p.starts[phrase] + j] for j in range(HEAD)))
        place, of, phrase = place[same], of[same], phrase[same]
        size = p.starts[phrase + 1] - p.starts[phrase]
        whole, j = place + size <= upto[of + 1], HEAD
        live = np.flatnonzero(whole)
        while len(live := live[size[live] > j]):
            other = t[place[live] + j] != p.words[p.starts[phrase[live]] + j]
            whole[live[other]] = False
            live, j = live[~other], j + 1
        cell, back = np.unique(of * len(p.ids) + phrase, return_inverse=True)
        label = np.ones(len(cell), np.int32)
        np.maximum.at(label, back, 1 + whole.astype(np.int32))
        cells, labels, start = [*cells, cell], [*labels, label], end
    cell, back = np.unique(np.concatenate(cells), return_inverse=True)
    label = np.ones(len(cell), np.int32)
    np.maximum.at(label, back, np.concatenate(labels))
    of, phrase = np.divmod(cell, max(1, len(p.ids)))
    offsets = pa.array(np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([p.ids.take(pa.array(phrase)), pa.array(label)], ["qid", "label"]))


def held(rows: DataFrame, keep: list[str], p: Phrases) -> DataFrame:
    """keep's columns and held (found() in the tokens of the column text) of the rows that hold any phrase."""
    sent, made, most = rows.sparkSession.sparkContext.broadcast(p), rows.select(*keep, tx.tokens(F.col("text")).alias("words")), tx.AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in tx.slices(batch, most):
                out = pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), found(some.column("words"), sent.value)], [*keep, "held"])
                yield out.filter(pc.greater(pc.list_value_length(out.column("held")), 0))

    return made.mapInArrow(run, T.StructType([*(made.schema[c] for c in keep), *T.StructType.fromDDL(f"held {HELD}")]))


def best_labels(tables: list[DataFrame]) -> DataFrame:
    """qid, docno, label (the best) of tables of docno and held."""
    return reduce(DataFrame.unionByName, (t.select("docno", F.inline("held")) for t in tables)).groupBy("qid", "docno").agg(F.max("label").alias("label"))

"""Operator 9, n-gram Jaccard join: MinHash banding.

Documents are sets of five-word shingles (a shorter document with words is one shingle). Copies of a
text form a class first and go on as one. Each class has a MinHash signature cut into bands; bands
and rows are the widest that reach the target recall at the similarity. Equal bands meet by their
hash, each bucket links its members to its least one, and components of those links hold every
candidate pair. Pairs are then verified on full shingle sets, exactly: component by component, or
bucket by bucket where that sends fewer sets. Small components, and those in which nearly all share
their bands, go whole, as a set travels once then; of a large component that hangs together by
chains only pairs that share a band meet, each in the first band that it shares. What is verified
is dealt to blocks of about BLOCK, and each pair of blocks is one bounded group, so no group grows with
the data and no pair becomes a row. Keys of very many rows are joined where their rows are.

Result: one row for each document with class_id (the least doc_id that links lead to), n_links (other
texts at similarity or above) and n_copies (documents with the same text, itself included).

Defined cases: null is as the empty text; texts without words are copies of each other if they are
equal and link to nothing else. A null doc_id keeps its row and counts as larger than all others.
Repeated rows are copies of one text and each get a row. Very long texts are worked on whole, as one
batch; a group of BLOCK classes holds their sets in memory. An empty table gives an empty result. Extra
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, discard, join_by_key, materialize, read_documents, shuffle_parts, slices, text_of, whole_row
from .components import components
from .repeats import STEP, Sums, mix
from .substring_dedup import word_symbols

SHINGLE, SIMILARITY, RECALL, HASHES = 5, 0.8, 0.9995, 100
BLOCK = 512
_ODD = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, (2, 4 * HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def banding(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which enough bands for the recall need no more hashes than allowed."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= hashes:
            best = bands, rows
    return best


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts one after another, and how many each has (repeats count)."""
    lower = pa.compute.utf8_lower(texts)
    symbols, counts = word_symbols(lower)
    first = np.concatenate(([0], np.cumsum(counts)))
    sums = Sums(symbols)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.repeat(first[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return sums.at(at, at + np.repeat(np.minimum(counts, size), n)), n


def bands_of(hashes: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each set that has members: an array of sets by bands."""
    start = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(start), bands), np.uint64)
    for band in range(bands):
        for row in range(rows):
            j = band * rows + row
            low = np.minimum.reduceat((hashes ^ _ODD[0, j]) * _ODD[1, j], start)
            out[:, band] = mix(out[:, band] ^ low)
    return out


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """k, c, bands of docs (k, c, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", STEP):
                hashes, counts = shingles(part.column("text"))
                signed = bands_of(hashes, counts, bands, rows) if counts.any() else np.zeros((0, bands), np.uint64)
                ends = np.concatenate(([0], np.cumsum((counts > 0) * bands))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("c"), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed.reshape(-1).view(np.int64)))], ["k", "c", "bands"])

    return docs.select("k", "c", "text").mapInArrow(run, "k long, c string, bands array<long>")


def with_sets(rows: DataFrame) -> DataFrame:
    """rows (node, component, text, ...) with the column text turned to set binary: sorted distinct shingle hashes."""
    kept = [c for c in rows.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", STEP):
                hashes, counts = shingles(part.column("text"))
                edge = np.concatenate(([0], np.cumsum(counts)))
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sets, pa.binary())], [*kept, "set"])

    return rows.select(*kept, "text").mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in kept] + ["set binary"]))


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets are at similarity or above, as a symmetric array; none with itself."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.float64)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    owner, column = owner[keep], number[at[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n), np.float32)
    width = max(64, min(4096, (1 << 22) // n))
    total = int((count > 1).sum())
    for start in range(0, total, width):
        a, b = np.searchsorted(column, (start, start + width))
        has = np.zeros((n, width), np.float32)
        has[owner[a:b], column[a:b] - start] = 1
        shared += has @ has.T
    union = sizes[:, None] + sizes[None, :] - shared
    out = shared >= similarity * union - 1e-9
    out &= union > 0
    np.fill_diagonal(out, False)
    return out


def first_shared(bands: np.ndarray, band: int) -> np.ndarray:
    """Which pairs of sets share this band and none before it, from an array of sets by bands."""
    out = bands[:, None, band] == bands[None, :, band]
    for i in range(band):
        out &= bands[:, None, i] != bands[None, :, i]
    return out


def verify(similarity: float):
    """Groups of (g, node, block, own, band, bands, set), sorted by g and node: links of each node in its group, and the least node of its part.

    With a band from 0 on only pairs that meet in that band first count.
    """

    def group(rows: list[tuple]) -> list[tuple[bytes, int, bytes]]:
        blocks, band = np.array([r[1] for r in rows]), rows[0][3]
        out = linked([np.frombuffer(r[5], np.uint64) for r in rows], similarity)
        if not rows[0][2]:  # two different blocks: pairs within one are another group's
            out &= blocks[:, None] != blocks[None, :]
        if band >= 0:
            out &= first_shared(np.array([r[4] for r in rows], np.int64), band)
        low = np.arange(len(rows))  # rows come by node
        links = out.sum(axis=1)
        busy = np.flatnonzero(links)
        while True:
            new = low.copy()
            for i in busy:
                new[i] = min(low[i], low[out[i]].min())
            if (new == low).all():
                break
            low = new
        return [(rows[i][0], int(links[i]), rows[low[i]][0]) for i in busy]

    def run(batches):
        now, rows, done = None, [], []
        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "node", "block", "own", "band", "bands", "set")), strict=True):
                if g != now and rows:
                    done += group(rows) if len(rows) > 1 else []
                    rows = []
                now = g
                if rows and rows[-1][0] == row[0]:
                    continue  # a repeated row of docs
                rows.append(row)
            if len(done) > 10_000:
                yield links_batch(done)
                done = []
        if len(rows) > 1:
            done += group(rows)
        if done:
            yield links_batch(done)

    return run


def links_batch(rows: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["node", "n", "low"])


def groups_of(met: DataFrame, found: DataFrame) -> DataFrame:
    """node and places, an array of where its set is verified: unit, blocks (of the unit) and band (-1: all pairs).

    met (node, bucket, band, n members) and found (node, component) are written. A component is one unit, or each
    of its buckets is, whatever sends fewer sets.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    by_bucket = met.groupBy("node").agg(F.sum(blocks("n")).alias("sent"))
    sized = found.join(by_bucket, "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("sent").alias("sent"))
    sized = materialize(sized.select("component", "size", blocks("size").alias("blocks"), (F.col("size") * blocks("size") <= F.col("sent")).alias("whole")), "sizes")
    nodes = join_by_key(found, sized, "component", "size", sized.agg(F.sum("size")).first()[0] or 0)
    place = lambda unit, n, band: F.struct(unit.alias("unit"), n.alias("blocks"), band.alias("band"))
    whole = nodes.where("whole").select("node", F.array(place(F.xxhash64("component"), F.col("blocks"), F.lit(-1))).alias("places"))
    split = nodes.where("not whole").select("node").join(met, "node").groupBy("node").agg(F.collect_list(place(F.col("bucket"), blocks("n"), F.col("band"))).alias("places"))
    out = materialize(whole.unionByName(split), "places")
    discard(sized)
    return out


def keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns, k (orders documents), c (names the text), text (null as empty)."""
    return docs.select(*keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.md5(text_of()).alias("c"), text_of().alias("text"))


def classes_of(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row for each distinct text of docs: c, rep (its least doc_id), class_id, n_links, n_copies, stays (the first by rep, c of its linked texts)."""
    spark, parts = docs.sparkSession, shuffle_parts(docs)
    bands, rows = banding(similarity, recall)
    texts = keyed(docs, [])
    classes = signatures(texts, bands, rows).groupBy("c").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"))
    # a class is named by its text; in edge tables by the bytes of that name
    classes = materialize(classes.withColumn("node", F.unhex("c")), "classes")
    banded = classes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", "band", F.xxhash64("band", "hash").alias("bucket"))
    buckets = materialize(banded.groupBy("bucket").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("members", F.col("n")), "buckets")
    met = materialize(join_by_key(banded, buckets, "bucket", "members", buckets.agg(F.sum("n")).first()[0] or 0), "met")
    discard(buckets)
    found = materialize(components(met.select(F.col("node").alias("a"), F.col("least").alias("b"))), "candidates")
    places = groups_of(met, found)
    discard(met, found)
    nodes = places.join(classes.select("node", "c", F.col("rep").alias("k"), "bands"), "node")
    sets = with_sets(texts.join(nodes, ["k", "c"]).select("node", "places", "bands", "text"))
    placed = sets.select("node", "bands", "set", F.explode("places").alias("_")).select("node", "set", "_.*", F.when(F.col("_.band") >= 0, F.col("bands")).alias("bands"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    dealt = placed.select("*", block).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select(F.xxhash64("unit", low, high).alias("g"), "node", "block", (F.col("block") == F.col("other")).alias("own"), "band", "bands", "set")
    links = dealt.repartition(parts, "g").sortWithinPartitions("g", "node").mapInArrow(verify(similarity), "node binary, n long, low binary")
    links = materialize(links, "links")
    discard(places)
    counts = links.groupBy("node").agg(F.sum("n").alias("n_links"))
    grouped = components(links.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component", "root")
    # every node of a link has a root and a count
    named = materialize(classes.select("c", "node", "rep", "n_copies").join(counts.join(grouped, "node"), "node", "left"), "rooted")
    least = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct("rep", "c")).alias("least"), F.count(F.lit(1)).alias("members"))
    least = materialize(least, "leasts")
    alone = named.where(F.col("root").isNull()).select("c", "rep", F.col("rep").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_copies", F.lit(True).alias("stays"))
    linked = join_by_key(named.where(F.col("root").isNotNull()), least, "root", "members", least.agg(F.sum("members")).first()[0] or 0)
    out = materialize(alone.unionByName(linked.select("c", "rep", F.col("least.rep").alias("class_id"), "n_links", "n_copies", (F.col("least.c") == F.col("c")).alias("stays"))), "named")
    discard(classes, links, named, least)
    return out


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row for each row of docs: doc_id, class_id, n_links, n_copies."""
    named = classes_of(docs, similarity, recall).select("c", "class_id", "n_links", "n_copies", F.col("n_copies").alias("rows"))
    total = named.agg(F.sum("rows")).first()[0] or 0
    return join_by_key(keyed(docs, ["doc_id"]).select("doc_id", "c"), named, "c", "rows", total).select("doc_id", "class_id", "n_links", "n_copies")


def first_of_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of docs that stay if of each class only the document with the least doc_id does; of texts that share it one stays, and of rows with equal id and text the least by all columns."""
    stay = classes_of(docs, similarity, recall).where("stays").select("c", F.col("rep").alias("k"))
    rows = keyed(docs.select("doc_id", "text", whole_row(docs)), ["_row"]).drop("text")
    first = F.min_by("_row", F.to_json("_row")) if "map<" in rows.schema["_row"].dataType.simpleString() else F.min("_row")  # maps have no order
    return rows.join(stay, ["k", "c"]).groupBy("k", "c").agg(first.alias("_row")).select("_row.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_documents(spark, sf_dir))


OP9_SQL = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS x, min(doc_id) AS rep, count(*) AS n_copies FROM documents GROUP BY 1),
w AS (SELECT rep, regexp_extract_all(lower(x), '[^\x20\x09-\x0D]+') AS w FROM t),
g AS (SELECT DISTINCT rep, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
z AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
p AS (SELECT c.a, c.b FROM (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM g a JOIN g b ON a.s = b.s AND a.rep <> b.rep GROUP BY 1, 2) c JOIN z za ON za.rep = c.a JOIN z zb ON zb.rep = c.b WHERE c.n >= 0.8 * (za.n + zb.n - c.n) - 1e-9),
r AS (SELECT rep AS a, rep AS b FROM t UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT a AS rep, min(b) AS class_id, count(*) FILTER (WHERE a <> b) AS reached FROM r GROUP BY a),
l AS (SELECT a AS rep, count(*) AS n_links FROM p GROUP BY a)
SELECT d.doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, n_copies
FROM documents d JOIN t ON coalesce(d.text, '') = t.x JOIN k USING (rep) LEFT JOIN l USING (rep)
"""

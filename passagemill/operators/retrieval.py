"""Indexes as tables and retrieval as joins: lexical (BM25), sparse (term weights) and dense (dot product)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..tables import materialize
from . import products as px

K1, B = 0.9, 0.4
QUERY_BLOCK = 1_000  #: query vectors that are sent to all documents at once


SMALL = 100_000  #: terms that are sent to all executors; beyond it they are joined. The driver builds what is sent


def postings(corpus: DataFrame, stemmed: bool = False) -> DataFrame:
    """term, docno, tf, len: the lexical index, made without a shuffle."""
    return tx.term_counts(corpus, stemmed).select("term", "docno", "tf", "len")


def lengths(corpus: DataFrame, stemmed: bool = False) -> DataFrame:
    """docno and len of documents with terms."""
    return corpus.select("docno", F.size(tx.tokens(F.col("text"))).cast("long").alias("len")).where("len > 0")


def asked_postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the terms of a query set: sent to the index if their number is small, else joined."""
    distinct = terms.select("term").distinct()
    return index.join(F.broadcast(distinct) if distinct.count() <= SMALL else distinct, "term", "left_semi")


def query_terms(topics: DataFrame) -> DataFrame:
    """qid, term, qtf of cleaned queries."""
    counts = tx.term_counts(topics.select(F.col("qid").alias("docno"), tx.clean_query(F.col("query")).alias("text")))
    return counts.groupBy(F.col("docno").alias("qid"), "term").agg(F.sum("tf").alias("qtf"))


def meet_topics(weighted: DataFrame, terms: DataFrame, rows: int, by: str = "docno") -> DataFrame:
    """Each posting of weighted (rows of them) with every topic that has its term. by: docno, or what follows from it.

    Documents are dealt to partitions before postings multiply, so that sums by topic and document need
    no shuffle of their own where the topics' terms are sent to the executors.
    """
    parts = max(weighted.sparkSession.sparkContext.defaultParallelism, rows // 50_000)
    return weighted.repartition(parts, by).join(F.broadcast(terms) if terms.count() <= SMALL else terms, "term")


def bm25(index: DataFrame, topics: DataFrame, sizes: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """qid, docno, score of documents that share a term with the query. Only the queries' terms leave the index. sizes: docno, len of its documents."""
    stats = sizes.agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg_len"))
    terms = materialize(query_terms(topics), "query-terms")
    asked = materialize(asked_postings(index, terms), "asked-postings")
    df = asked.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return meet_topics(weighted.select("term", "docno", part.alias("w")), terms, asked.count()).groupBy("qid", "docno").agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))


def sparse_index(encoded: DataFrame) -> DataFrame:
    """term, docno, weight from a map column toks."""
    return encoded.select("docno", F.explode_outer("toks").alias("term", "weight")).where(F.col("term").isNotNull())


def tf_encoder(corpus: DataFrame) -> DataFrame:
    """A stand-in for a learned encoder: toks holds log term frequencies scaled to unit length. Documents without terms go."""
    rows = tx.with_terms(corpus.select("docno", "text")).where("n > 0").select("docno", "terms", F.transform("tfs", lambda x: F.log1p(x.cast("double"))).alias("w"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x)))
    # the norm is named twice, so that Spark makes it once for each row and not once for each element
    return rows.select("docno", F.map_from_arrays("terms", F.transform("w", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")))).alias("toks"))


def sparse_search(index: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, docno, score: dot products over shared terms. queries: qid, term, weight. Only the queries' terms leave the index, and documents are dealt before topics multiply them."""
    terms = materialize(queries.select("qid", "term", F.col("weight").alias("qw")), "query-weights")
    asked = materialize(asked_postings(index, terms), "asked-weights")
    return meet_topics(asked, terms, asked.count()).groupBy("qid", "docno").agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


def blocks_of(queries: DataFrame, total: int, size: int) -> list[DataFrame]:
    """queries in parts of about size rows, by a hash of qid."""
    blocks = max(1, -(-total // size))
    return [queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) for i in range(blocks)]


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, places: int | None = None) -> DataFrame:
    """qid, docno, score (rounded to places, where given), rank of the k nearest by dot product. A stated query set meets all vectors, QUERY_BLOCK queries at a time.

    Vectors of one length meet as matrices, dealt to all cores. What can't (nulls, other lengths, components that are no numbers) meets by Spark's dot product.
    """
    one = vectors.agg(F.coalesce(F.max(F.size("doc_vec")), F.lit(-1)).alias("width"), F.count(F.lit(1)).alias("n")).first()
    plain = lambda c: px.regular(F.col(c), one["width"]) if one["width"] > 0 else F.lit(False)
    asked = materialize(queries.select("qid", "query_vec", plain("query_vec").alias("_plain")), "queries")
    parts = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, one["n"] // 50_000)
    dealt = materialize(vectors.select("docno", "doc_vec", plain("doc_vec").alias("_plain")).repartition(parts), "vectors")
    some, odd = asked.where("_plain"), asked.where("not _plain")
    n = some.count()
    found = [materialize(top_k(px.best(dealt.where("_plain").select("docno", "doc_vec"), block.select("qid", "query_vec").toArrow(), k, places), k).drop("rank"), "nearest") for block in blocks_of(some, n, QUERY_BLOCK) if n]

    def by_rows(v: DataFrame, q: DataFrame) -> list[DataFrame]:
        score = vx.dot(F.col("doc_vec"), F.col("query_vec"))
        return [v.crossJoin(F.broadcast(x)).select("qid", "docno", (score if places is None else F.round(score, places)).alias("score")) for x in blocks_of(q, q.count(), QUERY_BLOCK)]

    if not n or not odd.isEmpty():
        found += by_rows(dealt.select("docno", "doc_vec"), odd.select("qid", "query_vec"))
    if not dealt.where("not _plain").isEmpty():
        found += by_rows(dealt.where("not _plain").select("docno", "doc_vec"), some.select("qid", "query_vec"))
    return top_k(reduce(DataFrame.unionByName, found), k)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query with rank; ties by docno. Spark cuts each partition to k before the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("docno"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Documents of a query are dealt to so many cells, of which each keeps its best score.
CELLS = 1024
#: One of so many parts of the documents is scored first, for scores that the k best of all must reach.
PARTS = 16


def cell_of(docno: Column, k: int) -> Column:
    return F.pmod(F.xxhash64(docno), F.lit(max(CELLS, 4 * k)))


def least_of_best(scores: DataFrame, columns: list[str], k: int) -> DataFrame:
    """qid and a score for each column (_least_, null where there are too few) that k of the query's documents reach, so nothing under it is among the k best. scores: of any part of the documents, with _cell (cell_of)."""
    best = scores.groupBy("qid", "_cell").agg(*(F.max(c).alias(c) for c in columns))
    kth = lambda c: F.get(F.sort_array(F.collect_list(c), asc=False), F.lit(k - 1)).alias(f"_least_{c}")
    return best.groupBy("qid").agg(*(kth(c) for c in columns))


def top_k_of_each(scores: DataFrame, columns: dict[str, str], k: int, least: DataFrame | None = None) -> DataFrame:
    """g, qid, docno, score, rank: the k best documents of each query in each column of scores (a run for each name), ties by docno.

    scores: a row for each qid and docno; null where a document isn't in a run. Only rows that can be
    among the k best are spread to a row for each run and sorted: what is under least_of_best() can't.
    Without least it is made of all scores, which are read twice then and should be written.
    """
    least = least if least is not None else least_of_best(scores.withColumn("_cell", cell_of(F.col("docno"), k)), [*columns.values()], k)
    known = materialize(least, "least")
    # room for sums in another order
    hopeful = lambda c: F.when(F.col(f"_least_{c}").isNull() | (F.col(c) >= F.col(f"_least_{c}") - 1e-8), F.col(c))
    rows = F.array(*(F.struct(F.lit(n).alias("g"), hopeful(c).alias("score")) for n, c in columns.items()))
    some = F.filter(rows, lambda x: x["score"].isNotNull())
    each = scores.join(F.broadcast(known) if known.count() <= SMALL else known, "qid", "left")
    spread = each.select("qid", "docno", F.explode(some).alias("x")).select("x.g", "qid", "docno", "x.score")
    w = Window.partitionBy("g", "qid").orderBy(F.desc("score"), F.asc("docno"))
    return spread.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def index_counts(lexical: DataFrame, sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """index, docs of three indexes, and the width of dense vectors."""
    count = lambda df, name: df.agg(F.lit(name).alias("index"), F.count_distinct("docno").alias("docs"))
    width = dense.agg(F.min(F.size("doc_vec")).alias("min_dim"), F.max(F.size("doc_vec")).alias("max_dim"))
    return count(lexical, "lexical").unionByName(count(sparse, "sparse")).unionByName(count(dense, "dense")).crossJoin(F.broadcast(width))  # one row

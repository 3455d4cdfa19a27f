"""Perplexity of passages under a smoothed trigram model of the corpus, each passage without its own counts.

The model is interpolated Kneser-Ney of order three, held as tables: trigrams with their counts,
two-word contexts with totals and followers, word pairs and words with the number of different words
before them (their continuations), one-word contexts, and one row of discounts and totals. Back-off
weights follow from followers and totals. Nothing of it but that row is ever sent anywhere.

A passage of the corpus would be surprised by nothing in it, so what it alone contributes is taken out
of every table while it is scored: counts by subtraction, and continuations and followers where a
trigram, a pair or a word occurs in no other passage. The result is the perplexity under the model of
all other passages (with the whole corpus's discounts), without a model for each.

Scale: trigrams are counted inside the row; kinds of trigrams meet the model's tables once each,
whatever their frequency, and occurrences meet kinds in one join, whose hot keys (phrases in very many
passages) Spark's adaptive skew join splits. What is taken out is summed by windows that all follow the
passage: one shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..tables import discard, materialize


class Model(NamedTuple):
    trigrams: DataFrame  # u, v, w, total
    contexts: DataFrame  # u, v, total_uv, followers_uv
    pairs: DataFrame  # v, w, before_vw: different u before v w
    middles: DataFrame  # v, total_v: sum of before_vw, followers_v
    words: DataFrame  # w, before_w: different v before w
    constants: DataFrame  # one row: d1, d2, d3 (discounts), all_pairs, all_words


def trigrams(corpus: DataFrame) -> DataFrame:
    """docno, _row, n (words of the row), u, v, w, own: a row's trigrams with their counts. Two empty words stand before the first one."""
    rows = corpus.select("docno", F.monotonically_increasing_id().alias("_row"), tx.tokens(F.col("text")).alias("_t"))
    at = lambda i: F.coalesce(F.get("_t", i), F.lit(""))
    joined = F.transform("_t", lambda x, i: F.concat_ws(" ", at(i - 2), at(i - 1), x))  # words hold no space
    rows = tx.run_lengths(rows.withColumn("_g", joined).drop("_t"), F.col("_g"))
    made = tx.exploded_terms(rows, ["docno", "_row", "n"])
    part = F.split("term", " ")
    return made.select("docno", "_row", "n", *(part[i].alias(c) for i, c in enumerate("uvw")), F.col("tf").cast("long").alias("own"))


def _discount(of: str) -> Column:
    """n1 / (n1 + 2 n2) of a column's counts of counts; a half where one is missing."""
    n1, n2 = F.count_if(F.col(of) == 1), F.count_if(F.col(of) == 2)
    return F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(F.lit(0.5))


def fit(grams: DataFrame) -> Model:
    """The model of a corpus's trigrams(), as written tables."""
    kinds = materialize(grams.groupBy("u", "v", "w").agg(F.sum("own").alias("total")), "trigrams")
    contexts = kinds.groupBy("u", "v").agg(F.sum("total").alias("total_uv"), F.count(F.lit(1)).alias("followers_uv"))
    pairs = materialize(kinds.groupBy("v", "w").agg(F.count(F.lit(1)).alias("before_vw")), "pairs")
    middles = pairs.groupBy("v").agg(F.sum("before_vw").alias("total_v"), F.count(F.lit(1)).alias("followers_v"))
    words = materialize(pairs.groupBy("w").agg(F.count(F.lit(1)).alias("before_w")), "words")
    d3, d2 = kinds.agg(_discount("total").alias("d3")), pairs.agg(_discount("before_vw").alias("d2"))
    d1 = words.agg(_discount("before_w").alias("d1"), F.coalesce(F.sum("before_w"), F.lit(0)).alias("all_pairs"), F.count(F.lit(1)).alias("all_words"))
    return Model(kinds, contexts, pairs, middles, words, materialize(d1.crossJoin(d2).crossJoin(d3), "constants"))  # three tables of one row


def _mixed(count: Column, discount: Column, total: Column, followers: Column, lower: Column) -> Column:
    """Interpolated estimate; a context that no text has leaves the word to the shorter context."""
    share = (F.greatest(count - discount, F.lit(0.0)) + discount * followers * lower) / total
    return F.when(total > 0, share).otherwise(lower)


def word_probabilities(grams: DataFrame, model: Model, own: bool = True) -> DataFrame:
    """docno, _row, n, own, p: the probability of each trigram's last word. own: the rows are part of the model and are taken out of it."""
    # rows that are part of the model have its kinds of trigrams; what holds for a pair of words meets pairs, not kinds
    kinds = model.trigrams if own else grams.select("u", "v", "w").distinct().join(model.trigrams, ["u", "v", "w"], "left")
    pairs = model.pairs if own else kinds.select("v", "w").distinct().join(model.pairs, ["v", "w"], "left")
    for table, key in ((model.middles, "v"), (model.words, "w")):
        pairs = pairs.join(table, key, "left")
    pairs = materialize(pairs, "known-pairs")
    in_context = materialize(kinds.join(model.contexts, ["u", "v"], "left"), "known-contexts")
    known = materialize(in_context.join(pairs, ["v", "w"], "left").na.fill(0), "known")
    discard(pairs, in_context)  # one join's shuffles and tables are there at a time
    rows = grams.join(known, ["u", "v", "w"])
    c = {x: F.col(x) for x in (*known.columns, "own", "all_pairs", "all_words")}
    if own:
        # adaptive execution may not undo this: all windows below follow from it
        rows = rows.repartition("_row").withColumn("_only", (F.col("total") == F.col("own")).cast("long"))
        over = lambda *keys: Window.partitionBy("_row", *keys)
        rows = rows.withColumns({"_own_uv": F.sum("own").over(over("u", "v")), "_gone_uv": F.sum("_only").over(over("u", "v")), "_gone_vw": F.sum("_only").over(over("v", "w")), "_first_vw": F.row_number().over(over("v", "w").orderBy("u")), "_gone_v": F.sum("_only").over(over("v"))})
        rows = rows.withColumn("_pair", ((F.col("_first_vw") == 1) & (F.col("before_vw") == F.col("_gone_vw"))).cast("long"))
        rows = rows.withColumns({"_pairs_v": F.sum("_pair").over(over("v")), "_pairs_w": F.sum("_pair").over(over("w")), "_pairs": F.sum("_pair").over(over()), "_first_w": F.row_number().over(over("w").orderBy("v", "u"))})
        rows = rows.withColumn("_words", F.sum(((F.col("_first_w") == 1) & (F.col("before_w") == F.col("_pairs_w"))).cast("long")).over(over()))
        for name, gone in {"total": "own", "total_uv": "_own_uv", "followers_uv": "_gone_uv", "before_vw": "_gone_vw", "total_v": "_gone_v", "followers_v": "_pairs_v", "before_w": "_pairs_w", "all_pairs": "_pairs", "all_words": "_words"}.items():
            c[name] = F.col(name) - F.col(gone)
    rows = rows.crossJoin(F.broadcast(model.constants))  # one row
    even = 1 / (c["all_words"] + 1)
    p1 = _mixed(c["before_w"], F.col("d1"), c["all_pairs"], c["all_words"], even)
    p2 = _mixed(c["before_vw"], F.col("d2"), c["total_v"], c["followers_v"], p1)
    p3 = _mixed(c["total"], F.col("d3"), c["total_uv"], c["followers_uv"], p2)
    return rows.select("docno", "_row", "n", "own", p3.alias("p"))


def perplexity(corpus: DataFrame, model: Model | None = None) -> DataFrame:
    """docno, quality: the negative perplexity of each row, so that higher is better.

    Without a model, the corpus's own is made and each row is scored by that of all others. With one
    (of another corpus), rows are scored by it as it is; words that it doesn't know share what the
    discounts leave. A row without words has the perplexity of the even distribution over the words
    that are known and one unknown.
    """
    grams = materialize(trigrams(corpus), "row-trigrams")
    known = model or fit(grams)
    p = word_probabilities(grams, known, own=model is None)
    scored = p.groupBy("_row", "docno").agg((-F.exp(-F.sum(F.col("own") * F.ln("p")) / F.first("n"))).alias("quality")).select("docno", "quality")
    empty = corpus.where(F.size(tx.tokens(F.col("text"))) == 0).select("docno").crossJoin(F.broadcast(known.constants))  # one row
    return scored.unionByName(empty.select("docno", (-(F.col("all_words") + 1).cast("double")).alias("quality")))

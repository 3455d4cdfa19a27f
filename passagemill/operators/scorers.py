"""Query-independent quality scores of passages: columns quality (higher is better) by docno.

Lexical scorers run in Spark. Scorers that need a model plug in through model_scorer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..tables import materialize
from .language_model import perplexity

LAMBDA, NO_TERMS = 0.99, -999.0
SENT = 100_000  #: terms of the background that are sent to all rows


def lexical_features(corpus: DataFrame, stop_words: tuple[str, ...] | list[str] = tuple(tx.STOP_WORDS)) -> DataFrame:
    """docno and seven lexical features of each row; 0 where a text has no tokens. Made inside the row, without a shuffle."""
    n = F.col("n").cast("double")
    unique, stop = F.size("terms"), F.size(F.filter("words", lambda w: w.isin(*stop_words)))
    logs = F.aggregate("tfs", F.lit(0.0), lambda a, x: a + x * F.log2(x.cast("double")))
    share = lambda x: tx.safe_divide(x.cast("double"), n)
    rows = tx.with_terms(corpus.select("docno", "text")).withColumns({"_u": unique, "_s": stop})
    return rows.select(
        "docno",
        n.alias("length_tokens"),
        share(F.char_length(F.array_join("words", ""))).alias("avg_token_length"),
        share(F.col("_u")).alias("unique_token_ratio"),
        share(n - F.col("_u")).alias("repetition_ratio"),
        F.when(n > 0, F.log2(F.greatest(n, F.lit(1.0))) - logs / n).otherwise(0.0).alias("lexical_entropy"),
        share(F.col("_s")).alias("stopword_ratio"),
        share(n - F.col("_s")).alias("content_word_ratio"),
    )


def idf_features(corpus: DataFrame) -> DataFrame:
    """docno, avg_idf, max_idf, idf_std over a document's distinct terms; idf = ln(N / df)."""
    counts = tx.term_counts(corpus)
    n = corpus.agg(F.count(F.lit(1)).alias("docs"))
    idf = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", F.ln(F.col("docs") / F.col("df")).alias("idf"))  # one row
    return counts.join(idf, "term").groupBy("docno").agg(F.avg("idf").alias("avg_idf"), F.max("idf").alias("max_idf"), F.stddev_pop("idf").alias("idf_std"))


def validate_features(features: DataFrame) -> DataFrame:
    """One row of rule violations: all zero for a sound table."""
    ratios = ["unique_token_ratio", "repetition_ratio", "stopword_ratio", "content_word_ratio"]
    numbers = ["length_tokens", "avg_token_length", "lexical_entropy", *ratios]
    bad = lambda p: F.coalesce(F.sum(p.cast("long")), F.lit(0))
    outside = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    any_of = lambda f, cs: F.exists(F.array(*(f(c) for c in cs)), lambda x: x)
    return features.agg(
        (F.count(F.lit(1)) - F.count_distinct("docno")).alias("repeated_docno"),
        bad(any_of(outside, ratios)).alias("ratio_outside"),
        bad(any_of(lambda c: F.col(c) < 0, numbers)).alias("negative"),
        bad(any_of(lambda c: F.isnan(c) | F.col(c).isNull() | (F.abs(F.col(c)) == float("inf")), numbers)).alias("not_finite"),
    )


def itn(corpus: DataFrame, stemmed: bool = False) -> DataFrame:
    """Information to noise of each row: distinct terms (or stems) over all; 0 without terms. Without a shuffle."""
    words = tx.tokens(F.col("text"))
    rows = corpus.select("docno", (tx.stems(words) if stemmed else words).alias("w"))
    return rows.select("docno", tx.safe_divide(F.size(F.array_distinct("w")).cast("double"), F.size("w").cast("double")).alias("quality"))


def background(corpus: DataFrame, limit: int | None = None, stemmed: bool = False) -> DataFrame:
    """term, p over the corpus, or over its first `limit` passages by docno where a bounded model is wanted."""
    if limit is not None:
        corpus = corpus.orderBy("docno").limit(limit)
    counts = tx.term_counts(corpus, stemmed).groupBy("term").agg(F.sum("tf").alias("tf"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("tf").alias("all")))).select("term", (F.col("tf") / F.col("all")).alias("p"))  # one row


def counted(corpus: DataFrame, stemmed: bool = False, also: tuple | None = None) -> DataFrame:
    """docno, _row, n, terms and tfs (and also's column) of each row of corpus, written: texts are taken apart once, whatever reads them."""
    return materialize(tx.counted_terms(corpus.select("docno", F.monotonically_increasing_id().alias("_row"), "text"), ["docno", "_row"], stemmed, also), "terms")


def cdd(corpus: DataFrame, model: DataFrame | None = None, stemmed: bool = False, limit: int | None = None) -> DataFrame:
    """Negative distance of each row's smoothed term model from the background; NO_TERMS without terms."""
    return cdd_of_terms(counted(corpus, stemmed), model if model is not None or limit is None else background(corpus, limit, stemmed))


def frequent(model: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The most probable terms of term, p, most of them or fewer, and the others. They are cut at a power of two, so what is gathered is a count for each power."""
    power = F.floor(F.log2("p"))
    taken, cut = 0, None
    for r in sorted(model.groupBy(power.alias("at")).agg(F.count(F.lit(1)).alias("n")).where("at is not null").collect(), key=lambda r: -r["at"]):
        taken += r["n"]
        if taken > most:
            break
        cut = r["at"]
    often = F.lit(False) if cut is None else F.coalesce(power >= cut, F.lit(False))
    return model.where(often), model.where(~often)


def cdd_of_terms(rows: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """cdd of rows as counted() writes them.

    Terms that a document lacks contribute P(t) log2(1 / (1 - LAMBDA)) each, so their sum follows from
    the terms that it has. SENT terms of the background, the most frequent ones, are sent to the rows;
    only the postings of all others are shuffled.
    """
    if model is None:
        counts = materialize(tx.exploded_terms(rows, []).groupBy("term").agg(F.sum("tf").alias("tf")), "background")
        model = counts.crossJoin(F.broadcast(counts.agg(F.sum("tf").alias("all")))).select("term", (F.col("tf") / F.col("all")).alias("p"))  # one row
    else:
        model = materialize(model.select("term", "p"), "background")
    often, seldom = frequent(model, SENT)
    own = tx.exploded_terms(rows, ["_row", "n"]).select("_row", "term", (LAMBDA * F.col("tf") / F.col("n")).alias("own"))
    mixed = F.col("own") + (1 - LAMBDA) * F.col("p")

    def sums(known: DataFrame) -> DataFrame:
        return known.groupBy("_row").agg(F.sum("p").alias("p"), F.sum(F.col("p") * F.log2(F.col("p") / mixed)).alias("s")).withColumns({"docno": F.lit(None).cast("string"), "n": F.lit(None).cast("int")})

    parts = [sums(own.join(F.broadcast(often), "term")), rows.select("_row", F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("s"), "docno", "n")]
    if not seldom.isEmpty():
        parts.append(sums(own.join(F.broadcast(often.select("term")), "term", "left_anti").join(seldom, "term")))
    one = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.max("docno").alias("docno"), F.max("n").alias("n"), F.sum("p").alias("p"), F.sum("s").alias("s"))
    absent = (1 - F.coalesce("p", F.lit(0.0))) * F.log2(F.lit(1 / (1 - LAMBDA)))
    return one.select("docno", F.when(F.col("n") == 0, NO_TERMS).otherwise(-(absent + F.coalesce("s", F.lit(0.0)))).alias("quality"))


def magnitude(vectors: DataFrame, column: str = "doc_vec") -> DataFrame:
    return vectors.select("docno", (-vx.l2(F.col(column))).alias("quality"))


def model_scorer(score: Callable[[list[str]], list[float]] | Callable[[], Callable[[list[str]], list[float]]], batch: int = 100, load: bool = False, features: tuple[str, ...] = ()) -> Callable[[DataFrame], DataFrame]:
    """A scorer from a function of prompts: it gets Arrow batches in slices of `batch`; with load it is first called once for each worker to get that function.

    With features (columns of the corpus) the function gets an array of them, a row for each prompt, as second argument.
    """

    def scorer(corpus: DataFrame) -> DataFrame:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fn = score() if load else score
            for part in parts:
                texts = part["prompt"].tolist()
                extra = part[list(features)].to_numpy("float64") if features else None
                made = [x for i in range(0, len(texts), batch) for x in (fn(texts[i : i + batch]) if extra is None else fn(texts[i : i + batch], extra[i : i + batch]))]
                yield pd.DataFrame({"docno": part["docno"], "quality": pd.Series(made, dtype="float64")})

        return corpus.select("docno", tx.prompt(F.col("text")).alias("prompt"), *features).mapInPandas(run, "docno string, quality double")

    return scorer


#: Scorers that a row of counted() says by itself.
OF_COUNTS: dict[str, Callable[[], Column]] = {"itn": lambda: tx.safe_divide(F.size("terms").cast("double"), F.col("n").cast("double")), "length": lambda: F.col("n").cast("double")}
Scorer = Callable[[DataFrame], DataFrame]
_SCORERS: dict[str, Scorer] = {"itn": itn, "itn_stemmed": lambda c: itn(c, stemmed=True), "cdd": cdd, "cdd_stemmed": lambda c: cdd(c, stemmed=True), "perplexity": perplexity, "length": lambda c: c.select("docno", F.size(tx.tokens(F.col("text"))).cast("double").alias("quality"))}


def register(name: str, scorer: Scorer) -> None:
    _SCORERS[name.lower()] = scorer


def get_scorer(name: str) -> Scorer:
    if name.lower() not in _SCORERS:
        raise ValueError(f"no scorer {name}; there are {', '.join(sorted(_SCORERS))}")
    return _SCORERS[name.lower()]


def oriented(score: Column, higher_is_better: Column | bool) -> Column:
    """A score with one direction: higher is better."""
    return F.when(F.lit(higher_is_better) if isinstance(higher_is_better, bool) else higher_is_better, score).otherwise(-score)

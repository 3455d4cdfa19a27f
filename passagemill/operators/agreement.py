"""Do two scorers agree? Pairs of a relevant and another passage, and two sets of scores for one corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pruning import correlations

#: Correlations above the first are nearly equal, above the second close.
SAME, CLOSE = 0.99, 0.90


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def pair_scores(pairs: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """pairs (pos_pid, neg_pid, any others) with <scorer>_pos, _neg and _margin for each scorer. A margin is null unless both scores are finite.

    scores: docno (unique), quality. They are joined by docno once, and only then to the pairs, so that
    the pairs are shuffled twice whatever the number of scorers.
    """
    each = [s.select("docno", F.col("quality").cast("double").alias(n)) for n, s in scores.items()]
    table = reduce(lambda a, b: a.join(b, "docno", "full_outer"), each)
    side = lambda p: table.select(F.col("docno").alias(f"{p}_pid"), *(F.col(n).alias(f"{n}_{p}") for n in scores))
    out = pairs.join(side("pos"), "pos_pid", "left").join(side("neg"), "neg_pid", "left")
    margin = lambda n: F.when(finite(F.col(f"{n}_pos")) & finite(F.col(f"{n}_neg")), F.col(f"{n}_pos") - F.col(f"{n}_neg"))
    return out.select(*pairs.columns, *(c for n in scores for c in (f"{n}_pos", f"{n}_neg", margin(n).alias(f"{n}_margin"))))


def pairwise_summary(scored: DataFrame, names: list[str]) -> DataFrame:
    """A row for each scorer: valid and invalid pairs, share of valid ones whose relevant passage scores higher, and means. One aggregation for all scorers."""
    rows = []
    aggs = []
    for n in names:
        m = F.col(f"{n}_margin")
        ok = m.isNotNull()
        aggs += [
            F.count_if(ok).alias(f"{n}_v"), F.count_if(~ok).alias(f"{n}_i"), F.avg((m > 0).cast("double")).alias(f"{n}_a"),
            F.avg(F.when(ok, F.col(f"{n}_pos"))).alias(f"{n}_p"), F.avg(F.when(ok, F.col(f"{n}_neg"))).alias(f"{n}_n"), F.avg(m).alias(f"{n}_m"),
        ]
        parts = {"valid_pairs": "v", "invalid_pairs": "i", "pairwise_accuracy": "a", "mean_pos": "p", "mean_neg": "n", "mean_margin": "m"}
        rows.append(F.struct(F.lit(n).alias("scorer"), *(F.col(f"{n}_{short}").alias(long) for long, short in parts.items())))
    return scored.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def with_differences(scored: DataFrame, names: list[str], reference: str) -> DataFrame:
    """Each scorer's scores and margin minus the reference's; null where either is."""
    return scored.withColumns({f"{n}_{p}_minus_{reference}": F.col(f"{n}_{p}") - F.col(f"{reference}_{p}") for n in names if n != reference for p in ("pos", "neg", "margin")})


def pairwise_agreement(scored: DataFrame, name: str, reference: str) -> DataFrame:
    """One row: correlations and errors of scores (both passages of each pair) and of margins, and how often both prefer the same passage."""
    both = scored.select(F.explode(F.array(*(F.struct(F.col(f"{name}_{p}").alias("a"), F.col(f"{reference}_{p}").alias("b")) for p in ("pos", "neg")))).alias("x")).select("x.*")
    a, b = F.col(f"{name}_margin"), F.col(f"{reference}_margin")
    prefixed = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    same = scored.where(a.isNotNull() & b.isNotNull()).agg(F.avg(((a > 0) == (b > 0)).cast("double")).alias("pairwise_agreement"))
    out = prefixed(correlations(both, "a", "b"), "score").crossJoin(prefixed(correlations(scored.select(a.alias("a"), b.alias("b")), "a", "b"), "margin"))  # one row each
    return out.crossJoin(same)


def reproduction(mine: DataFrame, official: DataFrame) -> DataFrame:
    """One row that compares two caches (docno, quality) of one corpus, by docno: sizes, finite scores, ranges, errors, correlations, verdict.

    verdict: 'length' where the docnos differ, 'none' without a finite pair or a correlation, else
    'same', 'order differs', 'close' or 'different' by SAME and CLOSE.
    """
    a, b = (x.select("docno", F.col("quality").cast("double").alias(n), F.lit(True).alias(f"_{n}")) for x, n in ((mine, "mine"), (official, "official")))
    both = a.join(b, "docno", "full_outer")
    x, y = F.col("mine"), F.col("official")
    ok = finite(x) & finite(y)
    aggs = [F.count("_mine").alias("mine_rows"), F.count("_official").alias("official_rows"), F.count_if(F.col("_mine") & F.col("_official")).alias("shared_rows"), F.count_if(finite(x)).alias("mine_finite"), F.count_if(finite(y)).alias("official_finite")]
    for n in ("mine", "official"):
        v = F.when(ok, F.col(n))
        aggs += [F.min(v).alias(f"{n}_min"), F.max(v).alias(f"{n}_max"), F.avg(v).alias(f"{n}_mean"), F.stddev_pop(v).alias(f"{n}_std")]
    out = both.agg(*aggs).crossJoin(correlations(both, "mine", "official"))  # one row each
    p, s = F.col("pearson"), F.col("spearman")
    known = finite(p) & finite(s)
    verdict = (
        F.when((F.col("mine_rows") != F.col("official_rows")) | (F.col("shared_rows") != F.col("mine_rows")), "length")
        .when(~known, "none").when((p > SAME) & (s > SAME), "same").when(p > SAME, "order differs").when((p > CLOSE) | (s > CLOSE), "close").otherwise("different")
    )
    return out.withColumn("verdict", verdict)

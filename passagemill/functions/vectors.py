"""Array expressions over dense vectors and token matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def l2(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def mean(v: Column) -> Column:
    return F.try_divide(total(_double(v)), F.size(v))


def embedding_features(v: Column, near_zero: float = 1e-6) -> list[Column]:
    """l1, l2, linf, mean, population variance and share of near-zero entries."""
    v = _double(v)
    m = mean(v)
    return [
        total(F.transform(v, F.abs)).alias("l1_norm"),
        l2(v).alias("l2_norm"),
        F.array_max(F.transform(v, F.abs)).alias("linf_norm"),
        m.alias("emb_mean"),
        (mean(F.transform(v, lambda x: x * x)) - m * m).alias("emb_var"),
        F.try_divide(F.size(F.filter(v, lambda x: F.abs(x) < near_zero)), F.size(v)).alias("near_zero_share"),
    ]


def pooled(states: Column, mask: Column | None = None) -> Column:
    """The mean token vector of an array of token vectors; with a mask (an array of 0 and 1) of its tokens with 1, zeros if there are none."""
    width = F.size(F.get(states, F.lit(0)))
    kept = states if mask is None else F.filter(states, lambda t, i: F.coalesce(F.get(mask, i) == 1, F.lit(False)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda j: total(F.transform(kept, lambda t: F.get(t, j).cast("double"))) / F.greatest(F.size(kept), F.lit(1)))


def token_features(states: Column, pool: Column) -> list[Column]:
    """Mean, deviation and maximum of token norms, natural-log entropy of their distribution, mean cosine to the pooled vector."""
    norms = F.transform(states, l2)
    m = mean(norms)
    share = F.transform(norms, lambda x: x / F.greatest(total(norms), F.lit(1e-12)))
    return [
        m.alias("token_norm_mean"),
        F.sqrt(F.greatest(mean(F.transform(norms, lambda x: x * x)) - m * m, F.lit(0.0))).alias("token_norm_std"),
        F.array_max(norms).alias("token_norm_max"),
        (-total(F.transform(share, lambda p: p * F.ln(F.greatest(p, F.lit(1e-12)))))).alias("token_norm_entropy"),
        mean(F.transform(states, lambda t: dot(t, pool) / F.greatest(l2(t) * l2(pool), F.lit(1e-12)))).alias("token_pool_cosine"),
    ]


def log_prob_true(true_logit: Column, false_logit: Column) -> Column:
    """log P(true | {true, false}) of two logits, in the form that doesn't overflow."""
    d = false_logit - true_logit
    return -(F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d))))

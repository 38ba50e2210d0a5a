"""Scalar and array functions as column expressions; all stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x), with x clipped to where it is 0 or 1 in full precision."""
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def logit(p: Column, eps: float = 1e-9) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))


def softmax(*scores: Column, tau: float = 1.0) -> list[Column]:
    """Softmax of scores / tau, shifted by the largest."""
    if tau <= 0:
        raise ValueError("tau must be positive")
    top = F.greatest(*scores)
    parts = [F.exp((s - top) / tau) for s in scores]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [p / total for p in parts]


def hard_label(y: Column) -> Column:
    """Index of the largest entry of an array, the first on ties; entries are rounded to 9 places, as the last bits follow the order of summation."""
    y = F.transform(y, lambda v: F.round(v, 9))
    return (F.array_position(y, F.array_max(y)) - 1).cast("int")


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.ln(x + 1e-12))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) fixed by the parts: the first 32 bits of their md5."""
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; error under 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def sanitize_id(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"[^0-9A-Za-z._-]+", "_"), r"^_+|_+$", "")


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation; null where a side is constant, which corr() takes for a division by zero."""
    spread = F.sqrt(F.var_pop(F.when(b.isNotNull(), a)) * F.var_pop(F.when(a.isNotNull(), b)))
    return F.covar_pop(a, b) / F.when(spread > 1e-12, spread)


def quantile(c: Column | str, q: float, approx: bool = False) -> Column:
    """Interpolated quantile; approx takes a mergeable sketch (one part in ten thousand), for groups too large to be sorted in one task."""
    return F.percentile_approx(c, q, 10_000) if approx else F.percentile(c, F.lit(q))

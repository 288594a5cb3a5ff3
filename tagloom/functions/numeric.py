"""Numbers: activation, finiteness, weights and confidence bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

__all__ = ["is_finite", "sigmoid", "sigmoid_double", "activate", "round_half_away", "tag_weight", "confidence_band", "is_visible"]


def is_finite(p: Column) -> Column:
    """NaN sorts above everything in Spark, so both ends of a plain comparison need care."""
    return ~F.isnan(p) & (F.abs(p) < F.lit(float("inf")))


def is_visible(p: Column, threshold: float | Column) -> Column:
    """Finite and at or above the threshold. The comparison is made in double precision."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return is_finite(p) & (p.cast("double") >= t)


def sigmoid_double(x: Column) -> Column:
    """Logistic function in two branches so that ``exp`` never overflows; NaN gives 0."""
    x = x.cast("double")
    return (
        F.when(F.isnan(x), F.lit(0.0)).when(x < 0, F.exp(x) / (F.exp(x) + 1)).otherwise(F.lit(1.0) / (F.exp(-x) + 1))
    )


def sigmoid(x: Column) -> Column:
    return sigmoid_double(x).cast("float")


def activate(x: Column, kind: str) -> Column:
    kind = kind.lower()
    if kind == "none":
        return x.cast("float")
    if kind == "sigmoid":
        return sigmoid(x)
    raise ValueError(f"unknown activation {kind!r}")


def round_half_away(x: Column, digits: int = 2) -> Column:
    """Scale the binary value and round its fraction half away from zero (not decimal rounding)."""
    scale = F.lit(float(10**digits))
    scaled = F.abs(x) * scale
    whole = F.floor(scaled).cast("double")
    return F.signum(x) * F.when(scaled - whole >= 0.5, whole + 1).otherwise(whole) / scale


def tag_weight(p: Column, threshold: Column, low: float, high: float) -> Column:
    """Map ``p`` from [threshold, 1] linearly to [low, high], two decimals."""
    low_, high_, one = F.lit(float(low)), F.lit(float(high)), F.lit(1.0)
    span = one - threshold
    clamped = F.least(F.greatest(p.cast("double"), threshold), one)
    raw = F.when(span <= 1e-12, high_).otherwise(low_ + (clamped - threshold) / span * (high_ - low_))
    return round_half_away(F.least(F.greatest(raw, low_), high_))


def confidence_band(p: Column) -> Column:
    p = p.cast("double")
    return (
        F.when(F.isnan(p), "low").when(p >= F.lit(0.9), "high").when(p >= F.lit(0.7), "medium").otherwise("low")
    )

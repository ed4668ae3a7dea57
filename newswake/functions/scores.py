"""Return, z-score and grading expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SIGMA_FLOOR = 1e-6


def log_return(later: Column, base: Column) -> Column:
    """ln(later/base); null when either price is missing or not positive."""
    ok = (later > 0) & (base > 0)
    return F.when(ok, F.ln(later.cast("double") / base.cast("double")))


def z_score(actual: Column, centre: Column, sigma: Column) -> Column:
    """(actual - centre) / sigma; null under the sigma floor or when the centre is unknown."""
    return F.when(sigma >= SIGMA_FLOOR, (actual - centre) / sigma)


def direction(z: Column) -> Column:
    """OVER above zero, UNDER at zero and below."""
    return F.when(z > 0, "OVER").when(z.isNotNull(), "UNDER")


def magnitude(z: Column, four_grades: bool = True) -> Column:
    """EXTREME from 3, HIGH from 2; below that MODERATE, with LOW under 1 on the four-grade scale."""
    size = F.abs(z)
    graded = F.when(size >= 3.0, "EXTREME").when(size >= 2.0, "HIGH")
    if four_grades:
        return graded.when(size >= 1.0, "MODERATE").when(z.isNotNull(), "LOW")
    return graded.when(z.isNotNull(), "MODERATE")


def sample_confidence(n: Column) -> Column:
    """min(1, n/100)."""
    return F.least(F.lit(1.0), n / F.lit(100.0))


def clamp(x: Column, low: float, high: float) -> Column:
    # greatest and least skip nulls, so null is kept apart
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def percent(x: Column) -> Column:
    return x.cast("double") * F.lit(100.0)

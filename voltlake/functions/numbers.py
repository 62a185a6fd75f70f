"""Rounding and number cleaning, as built-in column expressions only."""

from pyspark.sql import Column, functions as F

_HALF_SPLIT = float(2**27 + 1)
_INTEGRAL_FROM = float(2**52)


def round_half_away(x: Column, digits: int = 0) -> Column:
    """Scale, round to an integer with ties away from zero, scale back.

    ``F.round`` rounds the shortest decimal text of the double (1.005 -> 1.01); this one
    rounds the scaled double (1.005 -> 1.0), as SQL engines working on doubles do.
    """
    scale = float(10**digits)
    scaled = F.abs(x) * scale
    nearest = F.rint(scaled)
    away = F.when(scaled - nearest == 0.5, nearest + 1.0).otherwise(nearest)
    return F.signum(x) * away / scale


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Correctly rounded decimal of the double's exact value, ties to even.

    The product ``x * 10**digits`` is itself rounded, which can turn "just below the
    tie" into a tie. Its rounding error is recovered exactly (Dekker's product; the
    scale fits in 26 bits, so only ``x`` is split) and decides those cases.
    """
    if digits == 0:
        return F.rint(x)
    scale = float(10**digits)
    scaled = x * scale
    spread = x * _HALF_SPLIT
    high = spread - (spread - x)
    error = (high * scale - scaled) + (x - high) * scale
    nearest = F.rint(scaled)
    offset = scaled - nearest
    whole = (
        F.when((offset == 0.5) & (error > 0), nearest + 1.0)
        .when((offset == -0.5) & (error < 0), nearest - 1.0)
        .otherwise(nearest)
    )
    return F.when(F.abs(scaled) >= _INTEGRAL_FROM, x).otherwise(whole / scale)


def text_to_double(text: Column) -> Column:
    """Number kept as text; blank, ``None`` and unreadable text become NULL."""
    return F.nullif(F.nullif(text, F.lit("")), F.lit("None")).try_cast("double")


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, NULL where the whole is 0."""
    return part / F.nullif(whole, F.lit(0.0))


def banded(value: Column, edges, rest: str, *, at_least: bool = False) -> Column:
    """Name of the first band ``value`` falls in.

    Edges are exclusive upper limits, or inclusive lower limits with ``at_least``.
    A NULL value meets no edge and gets ``rest``.
    """
    chain = F
    for edge, name in edges:
        inside = value >= edge if at_least else value < edge
        chain = chain.when(inside, F.lit(name))
    return chain.otherwise(F.lit(rest))

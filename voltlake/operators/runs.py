"""Frames over consecutive rows of a time series.

Frames count rows, not time: a gap in the series stretches them. ``strict_gap`` keeps
only runs without a gap.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def trailing_mean(
    value: Column, rows: int, order: str, keys: Sequence[str] = ()
) -> Column:
    """Mean over the current row and the ``rows - 1`` before it.

    Meant for series already reduced to one row per hour, whose length follows the
    calendar (24 rows a day) and not the volume of readings behind it.
    """
    return F.avg(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0))


def full_runs(
    df: DataFrame,
    length: int,
    order: str,
    measures: dict[str, Column],
    keys: Sequence[str] = (),
    *,
    step: timedelta | None = None,
    strict_gap: bool = False,
) -> DataFrame:
    """Every run of ``length`` consecutive rows, as (keys, start, end, measures).

    ``measures`` are aggregate expressions evaluated over the run; ``end`` is the start
    of its last row.
    """
    run = W.partitionBy(*keys).orderBy(order).rowsBetween(0, length - 1)
    runs = df.select(
        *keys,
        F.col(order).alias("start"),
        F.max(order).over(run).alias("end"),
        F.count(F.lit(1)).over(run).alias("_rows"),
        *[aggregate.over(run).alias(name) for name, aggregate in measures.items()],
    ).filter(F.col("_rows") == length)
    if strict_gap:
        runs = runs.filter(F.col("end") - F.col("start") == F.lit(step * (length - 1)))
    return runs.drop("_rows")


@dataclass(frozen=True)
class Reach:
    """Days whose rows' frames hold changed rows, and the days to read to work them out."""

    rewritten: set[str]
    read: set[str]


def trailing_reach(
    counts: DataFrame, day: str, changed: set[str], rows: int, keys: Sequence[str] = ()
) -> Reach:
    """Which days ``trailing_mean`` over ``rows`` rows has to be worked out for again.

    ``counts`` (keys, ``day``, n) has the rows of each day and series, 0 for a changed day
    that lost its rows. Frames count rows, so places in the series decide and gaps stretch
    the reach. Both sets are collected; they grow with the calendar only.
    """
    series = W.partitionBy(*keys).orderBy(day)
    upto = F.sum("n").over(series.rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    is_changed = F.col(day).cast("string").isin(sorted(changed))
    last = F.max(F.when(is_changed, F.col("upto"))).over(series.rowsBetween(W.unboundedPreceding, 0))
    hit = placed.withColumn("last", last).filter(
        is_changed | (F.col("before") < F.col("last") + rows - 1)
    )
    rewritten = {r[0] for r in hit.select(F.col(day).cast("string")).distinct().collect()} | changed
    is_rewritten = F.col(day).cast("string").isin(sorted(rewritten))
    following = F.min(F.when(is_rewritten, F.col("before"))).over(
        series.rowsBetween(0, W.unboundedFollowing)
    )
    near = placed.withColumn("next", following).filter(
        is_rewritten | (F.col("upto") > F.col("next") - (rows - 1))
    )
    read = {r[0] for r in near.select(F.col(day).cast("string")).distinct().collect()}
    return Reach(rewritten, read | rewritten)

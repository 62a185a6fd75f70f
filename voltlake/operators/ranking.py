"""Ranks and row numbers: a plain window for bounded groups, spread forms for any size."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voltlake.session import scratch_path, settle
from voltlake.sinks.files import delete


def percent_rank(value: str, keys: Sequence[str] = ()) -> Column:
    """Window form, for groups whose size has a bound (a horizon of slots, a heatmap).

    NULLs rank last and count as rows.
    """
    return F.percent_rank().over(W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last()))


def spread_percent_rank(
    df: DataFrame, value: str, out: str, keys: Sequence[str] = ()
) -> DataFrame:
    """``percent_rank`` of every row without sorting a group in one task.

    The rank depends only on how many rows lie below a value, so rows are first reduced
    to a count per distinct value (map-side combined: a value holding a third of the rows
    costs one record per task). The counts are sorted over all tasks and stored with the
    number of their part, so parts cannot be drawn anew; a running sum inside each part
    and the totals of the parts before it give the ranks. They go back to the rows in one
    join, which adaptive execution splits where a value is frequent. The plan is the same
    for every size and for any type that can be ordered.

    NULLs rank last and count as rows, as in SQL with NULLS LAST.
    """
    keys = list(keys)
    spark = df.sparkSession
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_rows"))
    order = [*keys, F.col(value).asc_nulls_last()]
    path = scratch_path(spark, "value-counts")
    (
        counts.repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id())
        .write.parquet(path)
    )
    stored = spark.read.parquet(path)
    ranks = settle(_ranks(stored, keys, value, out), "value-ranks")
    delete(spark, path)
    return _attached(df, ranks, [*keys, value])


def _ranks(counts: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, value, rank) from the stored counts."""
    starts = _starts(counts.groupBy(*keys, "_part").agg(F.sum("_rows").alias("_in")), keys)
    inside = W.partitionBy("_part", *keys).orderBy(F.col(value).asc_nulls_last())
    ahead = F.sum("_rows").over(inside.rowsBetween(W.unboundedPreceding, -1))
    placed = counts.withColumn("_ahead", F.coalesce(ahead, F.lit(0)))
    below = F.col("_start") + F.col("_ahead")
    rank = F.when(F.col("_size") > 1, below / (F.col("_size") - 1)).otherwise(0.0)
    return _attached(placed, starts, [*keys, "_part"]).select(*keys, value, rank.alias(out))


def _starts(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a series before each part, and in all, from one row per part and series.

    A part holds few series or a series fills few parts.
    """
    series = W.partitionBy(*keys)
    earlier = series.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_in").over(series).alias("_size"),
    )


def spread_row_number(
    df: DataFrame, order: Sequence[str], out: str, keys: Sequence[str] = ()
) -> DataFrame:
    """``row_number`` of every row by ascending columns, without sorting a series in one task.

    Rows are stored once as they are and once sorted by range of series, order and place in
    the first store, with the number of their part. The place spreads rows that tie in all
    of ``order`` over parts, too; which of them comes first is open, as in SQL. A row's
    number is the rows of its series in earlier parts and its place in its own. NULLs come
    last; a NULL key is a series. Only the part totals are looked at across parts.
    """
    keys, spark = list(keys), df.sparkSession
    by = [F.col(c).asc_nulls_last() for c in order]
    # From files a task that is run again numbers its rows as before.
    rows = settle(df, "unnumbered").withColumn("_place", F.monotonically_increasing_id())
    spread = rows.repartitionByRange(*keys, *by, "_place")
    parts = settle(spread.withColumn("_part", F.spark_partition_id()), "numbered")
    starts = _starts(parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_in")), keys)
    inside = F.row_number().over(W.partitionBy("_part", *keys).orderBy(*by, "_place"))
    numbered = _attached(parts.withColumn("_inside", inside), starts, [*keys, "_part"])
    return numbered.select(*df.columns, (F.col("_start") + F.col("_inside")).alias(out))


def _attached(rows: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Null-safe inner join that adds the right side's other columns."""
    other = [c for c in right.columns if c not in on]
    right = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *other)
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on))
    return rows.join(right, same).select(*rows.columns, *other)

"""As-of join: for every moment the newest fact of its key at or before it."""

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voltlake.session import settle


def _piece(column: str, bucket: timedelta) -> Column:
    """Number of the stretch of time a value falls into."""
    seconds = int(bucket.total_seconds())
    return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / seconds)


def as_of(
    moments: DataFrame,
    facts: DataFrame,
    *,
    keys: Sequence[str] = (),
    moment: str,
    at: str,
    take: dict[str, str],
    bucket: timedelta = timedelta(days=1),
) -> DataFrame:
    """``moments`` with columns of the newest fact whose ``at`` is not after ``moment``.

    ``take`` maps new column names to columns of ``facts``, which must be orderable: of facts
    with one key and time the greatest in the order of ``take`` counts. Every row of
    ``moments`` stays, repeated ones too; without such a fact, without a moment or with a
    NULL key the new columns are NULL. Facts without a time are not used.

    Facts are gathered per key and bucket, as a list of their distinct times, so a bucket
    should hold some thousands of these at most. What was last known before a bucket is
    carried over buckets, of which there are as many as the calendar has, never over rows.
    Moments are joined by key and bucket in one shuffle; the gathered facts are written
    first, so that a key with many moments can be split among tasks.
    """
    taken = set(take) & set(moments.columns)
    if taken:
        raise ValueError(f"moments already have {sorted(taken)}")
    names = [f"_k{i}" for i in range(len(keys))]
    by = [F.col(k).alias(n) for k, n in zip(keys, names)]
    values = [F.col(column).alias(f"_v{i}") for i, column in enumerate(take.values())]

    known = facts.filter(F.col(at).isNotNull()).select(
        *by, _piece(at, bucket).alias("_piece"), F.col(at).alias("_at"), F.struct(*values).alias("_values")
    )
    # A row per key and time, reduced before the shuffle, then a list per bucket.
    known = known.groupBy(*names, "_piece", "_at").agg(F.max("_values").alias("_values"))
    known = known.groupBy(*names, "_piece").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_values"))).alias("_facts")
    )
    asked = moments.select(*by, _piece(moment, bucket).alias("_piece")).filter("_piece IS NOT NULL")
    pieces = known.unionByName(asked.distinct(), allowMissingColumns=True)
    pieces = pieces.groupBy(*names, "_piece").agg(F.first("_facts", ignorenulls=True).alias("_facts"))
    earlier = W.partitionBy(*names).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    newest = F.last(F.try_element_at("_facts", F.lit(-1)), ignorenulls=True)
    pieces = settle(pieces.withColumn("_carried", newest.over(earlier)), "asof")

    here = moments.withColumn("_asked", _piece(moment, bucket))
    same = [here["_asked"] == pieces["_piece"], *(here[k] == pieces[n] for k, n in zip(keys, names))]
    until = F.filter("_facts", lambda f: f["_at"] <= F.col(moment))
    fact = F.coalesce(F.try_element_at(until, F.lit(-1)), F.col("_carried"))
    joined = here.join(pieces, same, "left").withColumn("_fact", fact)
    return joined.select(
        *(here[c] for c in moments.columns),
        *(F.col(f"_fact._values._v{i}").alias(name) for i, name in enumerate(take)),
    )

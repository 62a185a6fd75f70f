"""Data checks of snapshot tables, brought up to date from the dates that changed.

Per table there are up to three small snapshot tables: ``keys`` with the digest of every
unique value per date and how many rows have it, ``repeated`` with the digests that more
than one row has, wherever those rows are filed, and ``counts`` with the violations per
date and check. A refresh reads the table's dates that were written since the last one and
no others. A value that is filed under its own date cannot repeat under another one; for
other values the digests of the changed dates are looked up among those of all dates,
which is 16 bytes a row in place of the table.

``counts`` is written last and notes which state of the table was checked, so a run that
died at any step is made up for by the next.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltlake.operators.quality import Contract, check_rows, tallies
from voltlake.sinks import snapshots
from voltlake.sinks.snapshots import PART

SOURCE = "source"


def _digest(keys: Sequence[str], column: str) -> Column:
    """16 bytes for a value within its series; none for no value."""
    named = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in (*keys, column)]))
    return F.when(F.col(column).isNotNull(), F.unhex(F.md5(named)))


def refresh(
    spark: SparkSession,
    source: str,
    root: str,
    contract: Contract,
    keys: Sequence[str] = (),
    filed_by: str | None = None,
) -> set[str]:
    """Check the dates of the table at ``source`` that changed, results under ``root``.

    ``filed_by`` is the column whose date files a row. Returns the dates that were read.
    One refresh at a time.
    """
    now = snapshots.current(spark, source)
    done = snapshots.current(spark, f"{root}/counts")
    fresh = now.parts_written_since(done.notes.get(SOURCE, 0))
    gone = set(done.parts) - set(now.parts)
    if not fresh and not gone:
        return fresh
    counted = [tally.alias(f"_t{i}") for i, (_, _, tally) in enumerate(tallies(contract))]
    rows = snapshots.read(spark, source, now, sorted(fresh)) if fresh else None
    if contract.unique:
        (column,) = contract.unique
        at = f"{root}/keys"
        if fresh:
            n_rows = F.count(F.lit(1)).alias("n")
            rows = rows.groupBy(PART, _digest(keys, column).alias("digest")).agg(n_rows, *counted)
        else:
            rows = snapshots.read(spark, at, parts=())
        written = snapshots.write(spark, at, rows, replaced=fresh | gone, n_dates=len(fresh))
        touched = snapshots.read(spark, at, written, sorted(fresh))
        _note_repeated(spark, root, touched, written, fresh, alone=column == filed_by)
        sums = [F.sum(f"_t{i}").alias(f"_t{i}") for i in range(len(counted))]
        per_date = touched.groupBy(PART).agg(F.lit(0).alias("_none"), *sums)
    elif fresh:
        per_date = rows.groupBy(PART).agg(F.lit(0).alias("_none"), *counted)
    else:
        per_date = None
    found = [(column, check, F.col(f"_t{i}")) for i, (column, check, _) in enumerate(tallies(contract))]
    if per_date is None:
        per_date = snapshots.read(spark, f"{root}/counts", parts=())
    else:
        per_date = per_date.select(PART, F.inline(check_rows(contract, found)))
    snapshots.write(
        spark,
        f"{root}/counts",
        per_date,
        replaced=fresh | gone,
        notes={SOURCE: now.number},
        n_dates=len(fresh),
    )
    return fresh


def _note_repeated(
    spark: SparkSession,
    root: str,
    touched: DataFrame,
    known: snapshots.Pointer,
    fresh: set[str],
    alone: bool,
) -> None:
    """Digests of more than one row: among the changed dates, between them and others, and
    those known of unchanged dates."""
    columns = [PART, "digest", "n"]
    rows = touched.filter("digest IS NOT NULL").select(columns)
    others = sorted(set(known.parts) - fresh)
    if others and fresh and not alone:
        stored = snapshots.read(spark, f"{root}/keys", known, others).select(columns)
        rows = rows.unionByName(stored.join(rows.select("digest").distinct(), "digest", "left_semi"))
    before = snapshots.current(spark, f"{root}/repeated")
    kept = sorted(set(before.parts) & set(others))
    if kept:
        rows = rows.unionByName(snapshots.read(spark, f"{root}/repeated", before, kept).select(columns))
    rows = rows.distinct()
    more = rows.groupBy("digest").agg(F.sum("n").alias("total")).filter("total > 1").select("digest")
    repeated = rows.join(more, "digest", "left_semi")
    n_dates = len(fresh) + len(kept)
    snapshots.write(spark, f"{root}/repeated", repeated, everything=True, n_dates=n_dates)


def results(spark: SparkSession, root: str, contract: Contract) -> DataFrame:
    """(table_name, column_name, check_name, violations) as of the last refresh."""
    none = [(c, check, F.lit(0).cast("long")) for c, check, _ in tallies(contract)]
    none += [(c, "unique", F.lit(0).cast("long")) for c in contract.unique]
    parts = [spark.range(1).select(F.inline(check_rows(contract, none)))]
    counts = snapshots.current(spark, f"{root}/counts")
    if counts.schema:
        parts.append(snapshots.read(spark, f"{root}/counts", counts).drop(PART))
    repeated = snapshots.current(spark, f"{root}/repeated")
    if repeated.schema:
        rows = snapshots.read(spark, f"{root}/repeated", repeated)
        (column,) = contract.unique
        found = rows.agg(F.countDistinct("digest").alias("n"))
        parts.append(found.select(F.inline(check_rows(contract, [(column, "unique", F.col("n"))]))))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("table_name", "column_name", "check_name").agg(
        F.sum("violations").alias("violations")
    )

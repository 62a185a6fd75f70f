"""Keyed incremental tables on plain Parquet: newest version of each key wins."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime
from threading import Event, Thread
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltlake.functions.timeparts import at
from voltlake.operators.latest import newest_per_key
from voltlake.session import scratch_path
from voltlake.sinks import snapshots
from voltlake.sinks.files import (
    age_seconds,
    create_new,
    delete,
    exists,
    list_names,
    read_text,
    write_text,
)
from voltlake.sinks.snapshots import PART, Pointer, dated

# A writer renews its mark this often; one that was not renewed for the longer time is a
# mark that a killed driver left.
RENEW_SECONDS, STALE_SECONDS = 30, 15 * 60


@dataclass(frozen=True)
class KeyedTable:
    """A snapshot table with one row per key.

    ``dated_by`` names a date or timestamp column that is a function of the key: it
    places the row in a date partition, so a new version of a row lands where the old
    one is and only the dates present in a batch are rewritten. ``touches`` names the time
    column that tables made from this one are dated by, if that is another.
    """

    path: str
    keys: tuple[str, ...]
    dated_by: str
    version: str = "loaded_at"
    touches: str | None = None

    def part_of(self) -> Column:
        return dated(self.dated_by)


def read_table(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """Current rows. Columns added later are NULL in older files."""
    return snapshots.read(spark, table.path).drop(PART)


def high_water(spark: SparkSession, table: KeyedTable) -> datetime | None:
    """Greatest version loaded so far; None for a missing or empty table."""
    mark = snapshots.current(spark, table.path).mark
    return None if mark is None else datetime.fromisoformat(mark)


def newer_than(
    source: DataFrame, mark: datetime | None, version: str = "loaded_at"
) -> DataFrame:
    """Source rows after the mark; all of them when nothing has been loaded yet.

    The mark is a literal, so it reaches the Parquet scan as a pushed filter. A source
    partitioned by load date is cut to the days from the mark on.
    """
    if mark is None:
        return source
    fresh = source.filter(F.col(version) > at(mark))
    if "load_date" in source.columns:
        fresh = fresh.filter(F.col("load_date") >= F.lit(mark.date()))
    return fresh


@contextmanager
def held(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold the table at ``path`` against other writers; a second one gets an error.

    The holder is a file beside the table with the writer's own name in it, written anew
    every ``RENEW_SECONDS`` for as long as the writer lives. One that a killed driver left
    is taken over when it was not renewed for ``STALE_SECONDS``. Nobody removes a holder
    that has another name in it.
    """
    holder, name = f"{path.rstrip('/')}__holder", uuid4().hex
    if not create_new(spark, holder):
        if age_seconds(spark, holder) < STALE_SECONDS:
            raise RuntimeError(f"another run is writing {path}")
        delete(spark, holder)
        if not create_new(spark, holder):
            raise RuntimeError(f"another run is writing {path}")
    write_text(spark, holder, name)

    def own() -> bool:
        return exists(spark, holder) and read_text(spark, holder) == name

    ended = Event()

    def renew() -> None:
        while not ended.wait(RENEW_SECONDS):
            if own():
                write_text(spark, holder, name)

    renewing = Thread(target=renew, daemon=True)
    renewing.start()
    try:
        yield
    finally:
        ended.set()
        renewing.join()
        if own():
            delete(spark, holder)


def upsert(spark: SparkSession, table: KeyedTable, batch: DataFrame) -> Pointer:
    """Merge ``batch`` into the table and return what is current then.

    The batch is reduced and stored once; its dates, few by the calendar, select the
    target's partitions. Their rows and the batch are reduced together to the newest row
    per key, so applying a batch twice, or batches out of order, gives the same table. The
    merged dates are written once, as a new version that becomes current in one step: a
    reader gets the old rows or the new ones, and a run that dies in between changes
    nothing. Another run writing the table at the same time is an error.
    """
    with held(spark, table.path):
        return _merge(spark, table, batch)


def _merge(spark: SparkSession, table: KeyedTable, batch: DataFrame) -> Pointer:
    before = snapshots.current(spark, table.path)
    newest = newest_per_key(batch, table.keys, table.version).withColumn(PART, table.part_of())
    if not before.parts:
        return _written(newest, table)
    path = scratch_path(spark, "batch")
    newest.write.parquet(path)
    stored = spark.read.schema(newest.schema).parquet(path)
    found = stored.select(F.col(PART).cast("string")).distinct().collect()  # by the calendar
    dates = sorted(r[0] for r in found)
    if not dates:
        delete(spark, path)
        return before
    there = [d for d in dates if d in before.parts]
    both = stored
    if there:
        known = snapshots.read(spark, table.path, before, there)
        both = known.unionByName(stored, allowMissingColumns=True)
    after = _written(newest_per_key(both, table.keys, table.version), table, len(dates))
    delete(spark, path)
    return after


def _written(df: DataFrame, table: KeyedTable, n_dates: int = 0) -> Pointer:
    """Write rows by date; the write finds their greatest version."""
    return snapshots.write(
        df.sparkSession,
        table.path,
        df,
        touches=table.touches,
        version_column=table.version,
        n_dates=n_dates,
    )


def load_increment(
    spark: SparkSession,
    table: KeyedTable,
    source: DataFrame,
    clean: Callable[[DataFrame], DataFrame],
) -> Pointer:
    """Incremental load: rows of ``source`` after the high-water mark, cleaned, merged.

    The new mark becomes current together with the rows. A run that dies before takes the
    same rows again next time.
    """
    with held(spark, table.path):
        fresh = newer_than(source, high_water(spark, table), table.version)
        return _merge(spark, table, clean(fresh))


# A history table, whose key contains the version, loads the same way: rows after the mark
# cannot share a key with stored ones, and only the newest load date is rewritten.
append_increment = load_increment

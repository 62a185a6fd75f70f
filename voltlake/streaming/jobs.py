"""The half-hourly refresh as Structured Streaming jobs.

All run with ``availableNow``: they take what has arrived since the last run and stop,
so a plain schedule drives them and the checkpoint remembers what was taken.
"""

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from voltlake.functions.timeparts import NTZ, at
from voltlake.operators.upsert import KeyedTable, upsert
from voltlake.sources import landing, payloads as flat


def stream_payloads(
    spark: SparkSession,
    path: str,
    *,
    whole_files: bool = False,
    files_per_batch: int = 10_000,
    loaded_at: datetime | None = None,
) -> DataFrame:
    """New landed files as payload texts, stamped with the run's load time.

    Without ``loaded_at`` the load time is when the batch ran.
    """
    text = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .option("wholetext", str(whole_files).lower())
        .text(path)
    )
    stamp = at(loaded_at) if loaded_at else F.current_timestamp().cast(NTZ)
    return text.select(F.col("value").alias("payload"), stamp.alias("loaded_at"))


BATCH = "batch_id"
AUDIT = f"source string, status string, n_read long, unreadable long, n_rows long, {BATCH} long"


def ingest_audited(
    payloads: DataFrame,
    source: str,
    flatten: Callable[[DataFrame], DataFrame],
    target: str,
    *,
    audit: str,
    quarantine: str,
    checkpoint: str,
) -> StreamingQuery:
    """Append flattened payloads; every micro-batch leaves an audit row.

    The write itself counts payloads, those that are no JSON, and rows. Payloads that are
    no JSON yield no rows and are kept, with their load time, in the quarantine folder,
    which costs a second read of the batches that have any. All three folders have a part
    per batch that a replay of the batch writes anew, so nothing is counted or stored
    twice. A batch that fails leaves a row that says how, stops the stream, and is taken
    again by the next run.
    """

    def part(folder: str, batch_id: int) -> str:
        return f"{folder}/{BATCH}={batch_id}"

    def note(spark: SparkSession, batch_id: int, *row: object) -> None:
        line = spark.createDataFrame([(source, *row, batch_id)], AUDIT).drop(BATCH)
        line.coalesce(1).write.mode("overwrite").parquet(part(audit, batch_id))

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            read, seen = Observation(f"read_{batch_id}"), Observation(f"rows_{batch_id}")
            rows = flatten(batch.observe(read, *flat.readability()))
            rows = rows.observe(seen, F.count(F.lit(1)).alias("n_rows"))
            stored = landing.dated(rows).write.mode("overwrite").partitionBy(landing.LOAD_DATE)
            stored.parquet(part(target, batch_id))
            n_read, n_bad, n_rows = read.get["n_read"], read.get["unreadable"], seen.get["n_rows"]
            if n_bad:
                bad = batch.filter(flat.is_unreadable())
                bad.write.mode("overwrite").parquet(part(quarantine, batch_id))
            note(spark, batch_id, "OK", n_read, n_bad, n_rows)
        except Exception as error:
            said = str(error).strip().splitlines()
            note(spark, batch_id, f"ERROR — {said[0] if said else type(error).__name__}", None, None, None)
            raise

    return (
        payloads.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_audit(spark: SparkSession, audit: str) -> DataFrame:
    """One row per micro-batch so far."""
    return spark.read.schema(AUDIT).parquet(audit)


def quarantined(spark: SparkSession, quarantine: str) -> DataFrame:
    """Payloads kept aside, to be mended and flattened again."""
    return spark.read.schema(f"payload string, loaded_at timestamp_ntz, {BATCH} long").parquet(quarantine)


def upsert_stream(
    raw: DataFrame,
    clean: Callable[[DataFrame], DataFrame],
    table: KeyedTable,
    checkpoint: str,
) -> StreamingQuery:
    """Newest-wins merge of every micro-batch into a keyed table.

    Late revisions are merged by their version, whatever order files arrive in, and a
    batch that is replayed after a failure leaves the table unchanged.
    """

    def merge(batch: DataFrame, _: int) -> None:
        upsert(batch.sparkSession, table, clean(batch))

    return (
        raw.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def hourly_fuel_means(
    readings: DataFrame, keys: tuple[str, ...] = (), late_by: timedelta = timedelta(hours=1)
) -> DataFrame:
    """Mean MW per hour and fuel, emitted once the hour is closed.

    Every reading counts, also a revised one; use ``hourly_newest_means`` where the newest
    revision has to win. State is one partial mean per open hour, fuel and series.
    """
    # Watermarks need a zoned timestamp; the session zone is UTC.
    timed = readings.withColumn("_at", F.col("period_utc").cast("timestamp"))
    return (
        timed.withWatermark("_at", f"{int(late_by.total_seconds())} seconds")
        .groupBy(*keys, F.window("_at", "1 hour"), "fuel_type")
        .agg(F.avg("generation_mw").alias("generation_mw"))
        .select(
            *keys,
            F.col("window.start").cast(NTZ).alias("hour_utc"),
            "fuel_type",
            "generation_mw",
        )
    )


def hourly_newest_means(
    readings: DataFrame,
    keys: tuple[str, ...] = (),
    late_by: timedelta = timedelta(hours=1),
    reading: str = "settlement_key",
) -> DataFrame:
    """Mean MW per hour and fuel over the newest revision of each reading, once the hour is
    closed.

    ``readings`` are ``silver.typed_generation`` rows: of a ``reading``'s revisions in an
    hour the greatest (loaded_at, generation_mw) counts. Two stateful operators follow one
    watermark: the first keeps one revision per reading of the open hours and hands them on
    when the hour closes, the second averages them. A revision may come any number of runs
    later, as long as its hour is open; afterwards it is dropped, so ``late_by`` has to
    cover how late revisions come (``upsert_stream`` takes them without end). Readings
    without a slot belong to no hour. All revisions of a reading need the same hour and
    fuel: a reading that moves to another hour counts in both.
    """
    timed = readings.withColumn("_at", F.col("period_utc").cast("timestamp"))
    newest = (
        timed.withWatermark("_at", f"{int(late_by.total_seconds())} seconds")
        .groupBy(*keys, F.window("_at", "1 hour").alias("_hour"), "fuel_type", reading)
        .agg(F.max(F.struct("loaded_at", "generation_mw")).alias("_newest"))
    )
    closed = newest.groupBy(*keys, F.window("_hour", "1 hour"), "fuel_type").agg(
        F.avg("_newest.generation_mw").alias("generation_mw")
    )
    return closed.select(
        *keys, F.col("window.start").cast(NTZ).alias("hour_utc"), "fuel_type", "generation_mw"
    )


def append_stream(
    df: DataFrame, target: str, checkpoint: str, partition_by: tuple[str, ...] = ()
) -> StreamingQuery:
    """Append a stream to a Parquet folder: each input file, or closed hour, once."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy(*partition_by)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )

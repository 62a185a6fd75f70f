import json
import random
from datetime import timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.helpers import RAW_GENERATION, T0, frame, rows_of
from voltlake.operators.upsert import KeyedTable, read_table
from voltlake.plans import gold, silver
from voltlake.session import scratch_path
from voltlake.sources import landing, payloads as flat
from voltlake.streaming import jobs


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_audited_ingest_notes_every_batch_and_replays_nothing_twice(spark):
    landed, target, audit, aside, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "au", "bad", "cp"))
    reading = {
        "settlementDate": "2024-06-03", "settlementPeriod": 1, "fuelType": "WIND",
        "generation": 1, "startTime": "2024-06-02T23:00:00Z",
    }
    fail = []

    def land(*lines):
        frame(spark, "value string", *[(x,) for x in lines]).coalesce(1).write.mode("append").text(landed)

    def flatten(payloads):
        if fail:
            raise ValueError("feed is down")
        return flat.flatten_generation(payloads)

    def run(when):
        stream = jobs.stream_payloads(spark, landed, loaded_at=when)
        jobs.ingest_audited(
            stream, "generation", flatten, target, audit=audit, quarantine=aside, checkpoint=checkpoint
        ).awaitTermination()

    def notes():
        noted = jobs.read_audit(spark, audit).select("batch_id", "status", "n_read", "unreadable", "n_rows")
        return sorted(rows_of(noted))

    land(json.dumps([reading, reading]), "<html>busy</html>", json.dumps({"data": [reading]}))
    run(T0)
    assert notes() == [(0, "OK", 3, 1, 3)]
    run(T0)
    assert notes() == [(0, "OK", 3, 1, 3)]
    land(json.dumps({"data": [reading]}))
    fail.append(True)
    with pytest.raises(StreamingQueryException):
        run(T0 + timedelta(hours=1))
    assert notes()[1][:2] == (1, "ERROR — feed is down")
    fail.clear()
    run(T0 + timedelta(hours=2))
    assert notes() == [(0, "OK", 3, 1, 3), (1, "OK", 1, 0, 1)]
    stamps = rows_of(landing.read_bronze(spark, target, "raw_generation"), "loaded_at")
    assert sorted(stamps) == [(T0,)] * 3 + [(T0 + timedelta(hours=2),)]
    assert rows_of(jobs.quarantined(spark, aside), "payload", "batch_id") == [("<html>busy</html>", 0)]


def test_ingest_takes_each_file_once(spark):
    landed, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    reading = {
        "settlementDate": "2024-06-03", "settlementPeriod": 1, "fuelType": "WIND",
        "generation": 1, "startTime": "2024-06-02T23:00:00Z",
    }

    def land(*docs):
        frame(spark, "value string", *[(json.dumps(d),) for d in docs]).coalesce(
            1
        ).write.mode("append").text(landed)

    def run():
        rows = landing.dated(flat.flatten_generation(jobs.stream_payloads(spark, landed)))
        jobs.append_stream(rows, target, checkpoint, ("load_date",)).awaitTermination()
        return landing.read_bronze(spark, target, "raw_generation").count()

    land([reading, reading], {"data": [reading]})
    assert run() == 3
    assert run() == 3
    land({"data": [reading]})
    assert run() == 4


def test_upsert_stream_takes_revisions_in_any_order(spark):
    rng = random.Random(2)
    rows = [
        ("2024-06-03", rng.randrange(1, 9), "WIND", str(i), T0 + timedelta(seconds=rng.random() * 9999), None)
        for i in range(300)
    ]
    raw = frame(spark, RAW_GENERATION, *rows)
    path, checkpoint = scratch_path(spark, "in"), scratch_path(spark, "cp")
    raw.repartition(4).write.parquet(path)
    table = KeyedTable(scratch_path(spark, "t"), ("settlement_key",), "settlement_date")
    for _ in range(2):
        query = jobs.upsert_stream(
            stream_of(spark, path, raw.schema), silver.stg_generation, table, checkpoint
        )
        query.awaitTermination()
    assert sorted(rows_of(read_table(spark, table))) == sorted(
        rows_of(silver.stg_generation(raw))
    )


def test_hourly_means_equal_the_batch_on_closed_hours(spark):
    readings = frame(
        spark, "period_utc ts, fuel_type string, generation_mw double",
        *[(T0 + timedelta(minutes=7 * i), f, float(i)) for i in range(60) for f in ("WIND", "CCGT")],
    )
    path, target = scratch_path(spark, "in"), scratch_path(spark, "out")
    readings.coalesce(1).sortWithinPartitions("period_utc").write.parquet(path)
    means = jobs.hourly_fuel_means(stream_of(spark, path, readings.schema))
    jobs.append_stream(means, target, scratch_path(spark, "cp")).awaitTermination()
    got = spark.read.schema(means.schema).parquet(target).withColumn(
        "generation_mw", F.round("generation_mw", 0)
    )
    last = T0 + timedelta(minutes=7 * 59)
    closed = gold.mart_fuel_mix(readings).filter(
        F.col("hour_utc") + F.expr("INTERVAL 2 HOURS") <= F.lit(last)
    )
    assert sorted(rows_of(got)) == sorted(rows_of(closed))
    assert closed.count() == 2 * 5


def test_hourly_means_of_newest_revisions_over_batches_and_restarts(spark):
    """Revisions come batches and runs later; every closed hour equals the mart's."""
    rng = random.Random(31)
    hours = [T0 + timedelta(hours=h) for h in range(10)]
    path, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))

    def land(n, slots):
        rows = []
        for slot in slots:
            for fuel in ("WIND", " ccgt"):
                mw = None if rng.random() < 0.1 else str(rng.randrange(400))
                load = T0 + timedelta(days=1, minutes=rng.randrange(60 * 24))
                stamp = f"{slot:%Y-%m-%dT%H:%M:%S}Z"
                rows.append((f"{slot:%Y-%m-%d}", 2 * slot.hour + slot.minute // 30 + 1, fuel, mw, load, stamp))
        raw = frame(spark, RAW_GENERATION, *rows)
        raw.coalesce(1).write.mode("append").parquet(path)
        return raw

    def halves(some):
        return [h + timedelta(minutes=m) for h in some for m in (0, 30)]

    def run(raw):
        typed = silver.typed_generation(stream_of(spark, path, raw.schema))
        means = jobs.hourly_newest_means(typed, late_by=timedelta(hours=3))
        jobs.append_stream(means, target, checkpoint).awaitTermination()
        return spark.read.schema(means.schema).parquet(target)

    landed = []
    for n, slots in enumerate((hours[:3], hours[1:5], hours[2:6], hours[5:8], hours[5:10])):
        landed.append(land(n, halves(slots)))
        if n in (1, 2, 4):  # two files in some runs, one in others
            got = run(landed[0])
    run(landed[0])
    everything = spark.read.schema(landed[0].schema).parquet(path)
    mart = gold.mart_fuel_mix(silver.stg_generation(everything))
    last = hours[-1] + timedelta(minutes=30)
    closed = mart.filter(F.col("hour_utc") + F.expr("INTERVAL 4 HOURS") <= F.lit(last))
    rounded = spark.read.schema(got.schema).parquet(target).withColumn(
        "generation_mw", F.expr("round(generation_mw, 0)")
    )
    assert sorted(map(str, rows_of(rounded, *closed.columns))) == sorted(map(str, rows_of(closed)))
    assert closed.select("hour_utc").distinct().count() == 6

import random
import time
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import RAW_GENERATION, RAW_WEATHER, T0, frame, rows_of
from voltlake.operators import upsert as up
from voltlake.plans import silver
from voltlake.plans.lake import HISTORY_TABLES, SILVER_KEYS, Lake
from voltlake.session import scratch_path
from voltlake.sinks import snapshots
from voltlake.sinks.files import (
    age_seconds,
    create_new,
    delete,
    list_names,
    read_text,
    write_text,
)
from voltlake.sources import landing, schemas

GENERATION_TABLE = dict(keys=("settlement_key",), dated_by="settlement_date")


def readings(spark, n=400, seed=1):
    """Revised readings over three days, load times in random order."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day, period = rng.randrange(1, 4), rng.randrange(1, 5)
        loaded = T0 + timedelta(minutes=rng.randrange(1000), microseconds=i)
        rows.append(
            (f"2024-06-0{day}", period, rng.choice(["wind", "CCGT"]), str(i), loaded, None)
        )
    return frame(spark, RAW_GENERATION, *rows)


@pytest.fixture
def table(spark):
    return up.KeyedTable(scratch_path(spark, "t"), **GENERATION_TABLE)


def state(spark, table):
    return sorted(rows_of(up.read_table(spark, table)), key=repr)


def expected(raw):
    return sorted(rows_of(silver.stg_generation(raw)), key=repr)


def test_increments_equal_one_load(spark, table):
    raw = readings(spark)
    for hours in (4, 9, 20):
        known = raw.filter(F.col("loaded_at") <= F.lit(T0 + timedelta(hours=hours)))
        up.load_increment(spark, table, known, silver.stg_generation)
    assert state(spark, table) == expected(raw)


def test_second_load_takes_only_newer_rows(spark, table):
    raw = readings(spark)
    up.load_increment(spark, table, raw, silver.stg_generation)
    seen = []

    def spy(df):
        seen.append(df.count())
        return silver.stg_generation(df)

    up.load_increment(spark, table, raw, spy)
    assert seen == [0]
    assert state(spark, table) == expected(raw)


def test_order_and_repeats_do_not_matter(spark, table):
    raw = readings(spark)
    late = raw.filter(F.col("loaded_at") > F.lit(T0 + timedelta(hours=8)))
    early = raw.exceptAll(late)
    for batch in (late, early, early, late):
        up.upsert(spark, table, silver.stg_generation(batch))
    assert state(spark, table) == expected(raw)


def test_untouched_dates_are_not_rewritten(spark, table):
    raw = readings(spark)
    up.upsert(spark, table, silver.stg_generation(raw))
    before = files(spark, table)
    one_day = raw.filter("settlement_date = '2024-06-02'").withColumn(
        "loaded_at", F.col("loaded_at") + F.expr("INTERVAL 1 DAY")
    )
    up.upsert(spark, table, silver.stg_generation(one_day))
    after = files(spark, table)
    changed = {d for d in before if before[d] != after[d]}
    assert changed == {"part_date=2024-06-02"}


def files(spark, table):
    rows = up.read_table(spark, table).select(F.input_file_name().alias("f")).distinct().collect()
    found = {}
    for (name,) in rows:
        *_, part, file = name.split("/")
        found.setdefault(part, set()).add(file)
    return found


def test_empty_and_missing_tables_load_everything(spark, table):
    raw = readings(spark)
    assert up.high_water(spark, table) is None
    up.load_increment(spark, table, raw.limit(0), silver.stg_generation)
    assert up.high_water(spark, table) is None
    up.load_increment(spark, table, raw, silver.stg_generation)
    assert state(spark, table) == expected(raw)


def test_an_empty_batch_changes_nothing(spark, table):
    raw = readings(spark)
    up.upsert(spark, table, silver.stg_generation(raw))
    up.upsert(spark, table, silver.stg_generation(raw.limit(0)))
    assert state(spark, table) == expected(raw)


@pytest.mark.parametrize("step", ["_days", "_publish", "move_new", "_clean"])
def test_a_run_that_died_at_any_step_leaves_old_or_new_rows(spark, table, monkeypatch, step):
    raw = readings(spark)
    first = raw.filter(F.col("loaded_at") <= F.lit(T0 + timedelta(hours=5)))
    table = replace(table, touches="period_utc")
    up.load_increment(spark, table, first, silver.stg_generation)

    def die(*_):
        raise RuntimeError("driver lost")

    reader = up.read_table(spark, table)  # resolved before the second load
    with monkeypatch.context() as patched:
        patched.setattr(snapshots, step, die)
        with pytest.raises(RuntimeError, match="driver lost"):
            up.load_increment(spark, table, raw, silver.stg_generation)
    assert state(spark, table) == expected(raw if step == "_clean" else first)
    assert sorted(rows_of(reader), key=repr) == expected(first)
    up.load_increment(spark, table, raw, silver.stg_generation)
    assert state(spark, table) == expected(raw)
    known = snapshots.current(spark, table.path)
    versions = {n.split("=")[1] for n in list_names(spark, table.path) if n.startswith("version=")}
    kept = snapshots._named(spark, table.path)
    named = {v for n in kept for v in snapshots._load(spark, table.path, n).parts.values()}
    assert set(known.parts.values()) <= versions == named
    assert sorted(rows_of(reader), key=repr) == expected(first)


def test_a_first_load_that_died_is_replaced(spark, table):
    raw = readings(spark)
    silver.stg_generation(raw.limit(5)).withColumn("part_date", table.part_of()).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).partitionBy("part_date").parquet(table.path)
    up.load_increment(spark, table, raw, silver.stg_generation)
    assert state(spark, table) == expected(raw)


def test_marks_and_partitions_give_the_same_high_water(spark):
    raw = readings(spark)
    newest = raw.agg(F.max("loaded_at")).first()[0]
    keyed = up.KeyedTable(scratch_path(spark, "t"), **GENERATION_TABLE)
    up.upsert(spark, keyed, silver.stg_generation(raw))
    assert up.high_water(spark, keyed) == newest  # read from the column
    marked = up.KeyedTable(scratch_path(spark, "t"), **GENERATION_TABLE)
    up.load_increment(spark, marked, raw, silver.stg_generation)
    assert up.high_water(spark, marked) == newest  # noted by the load
    history = up.KeyedTable(
        scratch_path(spark, "t"), ("settlement_key", "loaded_at"), dated_by="loaded_at"
    )
    up.append_increment(spark, history, raw, silver.stg_generation)
    assert up.high_water(spark, history) == newest  # found in the last partition


def test_added_columns_are_null_in_older_rows(spark):
    table = up.KeyedTable(scratch_path(spark, "t"), ("hour_utc",), "hour_utc")
    raw = frame(
        spark, RAW_WEATHER,
        ("2024-06-03T10:00", "1", "1", T0, "50", "0", "1", "0"),
        ("2024-06-04T10:00", "2", "2", T0, "60", "0", "1", "0"),
    )
    typed = silver.stg_weather(raw)
    up.upsert(spark, table, typed.filter("temp_c = 1").drop("cloudcover_pct"))
    up.upsert(spark, table, typed.filter("temp_c = 2"))
    got = up.read_table(spark, table).orderBy("hour_utc")
    assert rows_of(got, "temp_c", "cloudcover_pct") == [(1.0, None), (2.0, 60.0)]


def test_bronze_columns_added_later(spark):
    path = scratch_path(spark, "bronze")
    old = frame(spark, RAW_GENERATION, ("2024-06-03", 1, "WIND", "1", T0, None)).drop("start_time")
    new = frame(spark, RAW_GENERATION, ("2024-06-03", 2, "WIND", "2", T0, "2024-06-03T00:30:00Z"))
    landing.append_bronze(old, path)
    landing.append_bronze(new, path)
    got = landing.read_bronze(spark, path, "raw_generation").orderBy("settlement_period")
    assert rows_of(got, "generation", "start_time") == [("1", None), ("2", "2024-06-03T00:30:00Z")]
    assert landing.conform(old, "raw_generation").schema == schemas.bronze_schema("raw_generation")


def test_lake_in_two_loads_equals_one(spark):
    start = datetime(2024, 6, 3)
    hours = [start + timedelta(hours=h) for h in range(30)]
    bronze = {
        "raw_generation": frame(
            spark, RAW_GENERATION,
            *[(f"{h:%Y-%m-%d}", 2 * h.hour + 1, f, str(10 + i * 10), h, f"{h:%Y-%m-%dT%H:%M:%SZ}")
              for i, h in enumerate(hours) for f in ("WIND", "CCGT")],
        ),
        "raw_weather": frame(
            spark, RAW_WEATHER,
            *[(f"{h:%Y-%m-%dT%H:%M}", "5", "10", h, "50", "100", "1", "0") for h in hours],
        ),
        "raw_prices": frame(
            spark, schemas.BRONZE["raw_prices"],
            *[(f"{h:%Y-%m-%dT%H:%M:%SZ}", f"{h:%Y-%m-%dT%H:%M:%SZ}", float(i), "A", h)
              for i, h in enumerate(hours)],
        ),
        "raw_carbon_national": frame(
            spark, schemas.BRONZE["raw_carbon_national"],
            *[(f"{h:%Y-%m-%dT%H:%MZ}", f"{h:%Y-%m-%dT%H:%MZ}", "", str(i), "low", h)
              for i, h in enumerate(hours)],
        ),
        "raw_carbon": frame(
            spark, schemas.BRONZE["raw_carbon"],
            *[(str(r), f"R{r}", str(i), "[]", h) for i, h in enumerate(hours) for r in (1, 2)],
        ),
    }
    lookup = landing.region_lookup(spark)
    as_of = start + timedelta(hours=12, minutes=10)
    early = {n: df.filter(F.col("loaded_at") <= F.lit(as_of)) for n, df in bronze.items()}
    twice, once = Lake(spark, scratch_path(spark, "lake")), Lake(spark, scratch_path(spark, "lake"))
    for known in (early, bronze, bronze):
        twice.load_silver(known, lookup)
    once.load_silver(bronze, lookup)
    for name in SILVER_KEYS:
        a, b = (sorted(rows_of(lake.silver_frame(name)), key=repr) for lake in (twice, once))
        assert a == b and len(a) in (30, 60)
    marts_a, marts_b = twice.build_gold(as_of), once.build_gold(as_of)
    assert set(marts_a) == set(marts_b) and len(marts_a) == 10
    for name, df in marts_a.items():
        assert sorted(rows_of(df), key=repr) == sorted(rows_of(marts_b[name]), key=repr)
    assert marts_a["mart_best_windows"].count() == 18
    assert {v for *_, v in rows_of(twice.check())} == {0}
    assert set(HISTORY_TABLES) <= set(SILVER_KEYS)


def test_increment_reads_only_the_days_from_the_mark_on(spark):
    path = scratch_path(spark, "bronze")
    rows = [
        ("2024-06-03", 1, "WIND", str(i), T0 + timedelta(days=i), None) for i in range(5)
    ]
    landing.append_bronze(frame(spark, RAW_GENERATION, *rows), path)
    bronze = landing.read_bronze(spark, path, "raw_generation")
    mark = T0 + timedelta(days=2)
    fresh = up.newer_than(bronze, mark)
    assert sorted(g for (g,) in rows_of(fresh, "generation")) == ["3", "4"]
    text = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(load_date" in text and "GreaterThan(loaded_at" in text
    table = up.KeyedTable(scratch_path(spark, "t"), **GENERATION_TABLE)
    up.load_increment(spark, table, bronze, silver.stg_generation)
    assert rows_of(up.read_table(spark, table), "generation_mw") == [(4.0,)]


def test_a_second_writer_is_refused_and_a_dead_one_replaced(spark, table, monkeypatch):
    raw = readings(spark, 50)
    with up.held(spark, table.path):
        with pytest.raises(RuntimeError, match="another run"):
            up.load_increment(spark, table, raw, silver.stg_generation)
        monkeypatch.setattr(up, "STALE_SECONDS", 0)
        up.load_increment(spark, table, raw, silver.stg_generation)
    assert state(spark, table) == expected(raw)


def test_history_load_that_died_is_replaced_and_increments_add_up(spark):
    raw = readings(spark, 60)
    history = up.KeyedTable(
        scratch_path(spark, "t"), ("settlement_key", "loaded_at"), dated_by="loaded_at"
    )
    raw.limit(3).withColumn("part_date", history.part_of()).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).partitionBy("part_date").parquet(history.path)
    early = raw.filter(F.col("loaded_at") <= F.lit(T0 + timedelta(hours=6)))
    for known in (early, raw, raw):
        up.append_increment(spark, history, known, lambda df: df.withColumn(
            "settlement_key", F.concat("settlement_date", "settlement_period", "fuel_type")))
    assert up.read_table(spark, history).count() == 60


def test_a_holder_is_renewed_and_only_its_owner_removes_it(spark, table, monkeypatch):
    holder = f"{table.path}__holder"
    monkeypatch.setattr(up, "RENEW_SECONDS", 0.2)
    with up.held(spark, table.path):
        first = read_text(spark, holder)
        time.sleep(1.5)
        assert age_seconds(spark, holder) < 1.4 and read_text(spark, holder) == first
        monkeypatch.setattr(up, "STALE_SECONDS", -1)
        with up.held(spark, table.path):
            second = read_text(spark, holder)
            assert second != first
            time.sleep(0.6)
            assert read_text(spark, holder) == second
        delete(spark, holder)
        create_new(spark, holder)
        write_text(spark, holder, "somebody else")
    assert read_text(spark, holder) == "somebody else"


def test_only_dates_of_the_batch_are_read(spark, table, monkeypatch):
    raw = readings(spark, 80)
    up.upsert(spark, table, silver.stg_generation(raw))
    written, read = [], []
    write = up._written

    def spy(df, *rest):
        written.append(df._jdf.queryExecution().executedPlan().toString())
        read.extend(f for f in df.inputFiles() if "version=" in f)
        return write(df, *rest)

    monkeypatch.setattr(up, "_written", spy)
    up.upsert(spark, table, silver.stg_generation(raw.filter("settlement_date = '2024-06-02'")))
    (text,) = written
    assert text.count("Scan parquet") == 2 and "Join" not in text
    assert read and all("part_date=2024-06-02" in f for f in read)

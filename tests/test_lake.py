"""Marts that follow what loads change, against marts made anew from everything."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import RAW_GENERATION, RAW_NATIONAL, RAW_PRICES, RAW_WEATHER, frame, rows_of
from voltlake.operators import runs
from voltlake.plans import gold, serve
from voltlake.plans.lake import MARTS, TEN_MARTS, Lake
from voltlake.session import scratch_path
from voltlake.sinks import snapshots
from voltlake.sources import landing, schemas

START = datetime(2024, 3, 29)  # summer time begins within the data


def feeds(spark, hours, load, rng, keyed):
    """Bronze rows of some hours as one load brings them; zones differ in their gaps."""
    generation, weather, prices, national, regional = [], [], [], [], []
    for zone in ("n", "s") if keyed else (None,):
        key = (zone,) if keyed else ()
        for hour in hours:
            if zone == "s" and hour.hour % 5 == 0:
                continue
            stamp = f"{hour:%Y-%m-%dT%H:%M:%S}Z"
            # Settlement days are local, so late slots are filed under the next day.
            day = hour + timedelta(hours=1) if hour >= datetime(2024, 3, 31, 1) else hour
            for fuel in ("WIND", "CCGT", "INTFR"):
                mw = str(rng.randrange(-40, 400)) if fuel == "INTFR" else str(rng.randrange(400))
                generation.append((*key, f"{day:%Y-%m-%d}", 2 * day.hour + 1, fuel, mw, load, stamp))
            weather.append((*key, stamp[:16], str(rng.randrange(-4, 9)), "10.5", load, "50", "100", "1", "0"))
            prices.append((*key, stamp, stamp, rng.randrange(400) / 4, "A", load))
            national.append((*key, f"{stamp[:16]}Z", f"{stamp[:16]}Z", "", str(rng.randrange(300)), "low", load))
        regional += [(*key, str(r), f"R{r}", str(rng.randrange(300)), "[]", load) for r in (1, 2)]
    zoned = "zone string, " if keyed else ""
    carbon = schemas.BRONZE["raw_carbon"]
    carbon = "zone string, " + carbon if keyed and isinstance(carbon, str) else carbon
    return {
        "raw_generation": frame(spark, zoned + RAW_GENERATION, *generation),
        "raw_weather": frame(spark, zoned + RAW_WEATHER, *weather),
        "raw_prices": frame(spark, zoned + RAW_PRICES, *prices),
        "raw_carbon_national": frame(spark, zoned + RAW_NATIONAL, *national),
        "raw_carbon": frame(
            spark,
            zoned + "regionid string, shortname string, intensity_actual string, generationmix string, loaded_at ts",
            *regional,
        ),
    }


def same(a, b):
    return sorted(map(str, rows_of(a, *sorted(a.columns)))) == sorted(map(str, rows_of(b, *sorted(a.columns))))


@pytest.mark.parametrize("keyed", [False, True])
def test_followed_marts_equal_marts_made_anew(spark, keyed):
    rng = random.Random(4)
    keys = ("zone",) if keyed else ()
    every = [START + timedelta(hours=h) for h in range(24 * 14) if h % 31 != 7 and not 60 < h < 75]
    loads = [
        every[: 24 * 10],
        [*every[24 * 10 :], *every[30:33]],  # new days, and revisions of an old one
        every[100:101],
        [START - timedelta(days=40)],  # an older month
    ]
    lake = Lake(spark, scratch_path(spark, "lake"), keys)
    lookup = landing.region_lookup(spark)
    seen = None
    for n, hours in enumerate(loads):
        load = START + timedelta(days=20, hours=n)
        batch = feeds(spark, hours, load, rng, keyed)
        seen = batch if seen is None else {k: seen[k].unionByName(v) for k, v in batch.items()}
        as_of = START + timedelta(days=9, hours=12 * n, minutes=10)
        lake.load_silver(batch, lookup)
        marts = lake.build_gold(as_of)
        if n in (1, 3):
            anew = Lake(spark, scratch_path(spark, "lake"), keys)
            anew.load_silver(seen, lookup)
            fresh = anew.build_gold(as_of)
            assert set(marts) == set(fresh) == set(TEN_MARTS)
            for name in TEN_MARTS:
                assert same(marts[name], fresh[name]), name
            assert same(lake.table("slot_totals"), anew.table("slot_totals"))
            demand = marts["mart_temp_vs_demand"]
            assert same(lake.demand_profile(), serve.demand_profile(demand, keys))
            mine, theirs = (
                {r[:-3]: r[-3:] for r in rows_of(f)}
                for f in (lake.temp_regression(), serve.temp_regression(demand, keys))
            )
            assert mine.keys() == theirs.keys()
            for key, got in mine.items():
                assert got == pytest.approx(theirs[key], rel=1e-9)
        if n == 2:
            day = f"{every[100]:%Y-%m-%d}"
            # The settlement day's file has an hour of the day before, too.
            eve = f"{every[100] - timedelta(days=1):%Y-%m-%d}"
            assert lake.rebuilt["mart_solar_weather"] == {day}
            assert lake.rebuilt["mart_fuel_mix"] == lake.rebuilt["mart_price_carbon"] == {eve, day}
            reached = lake.rebuilt["mart_renewable_mix"]
            assert {eve, day} < reached and min(reached) == eve and 6 < len(reached) < 12
            month = {d for d in lake.rebuilt["demand_cells"] if d[:7] == day[:7]}
            assert lake.rebuilt["demand_cells"] == month
    numbers = {n: snapshots.current(spark, lake._path(n)).number for g in MARTS for n in g}
    lake.load_silver(seen, lookup)
    lake.build_gold(as_of)
    assert numbers == {n: snapshots.current(spark, lake._path(n)).number for g in MARTS for n in g}
    assert {v for *_, v in rows_of(lake.check())} == {0}


def test_a_refresh_scans_the_changed_days_only(spark, monkeypatch):
    rng = random.Random(5)
    every = [START + timedelta(hours=h) for h in range(24 * 9)]
    lake = Lake(spark, scratch_path(spark, "lake"))
    lookup = landing.region_lookup(spark)
    lake.load_silver(feeds(spark, every, START + timedelta(days=20), rng, False), lookup)
    lake.build_gold(START)
    day = every[130]
    lake.load_silver(feeds(spark, [day], START + timedelta(days=21), rng, False), lookup)
    read = {}
    write = Lake._write

    def spy(self, name, rows, *rest):
        read[name] = {f.split("part_date=")[1][:10] for f in rows.inputFiles() if "part_date=" in f}
        return write(self, name, rows, *rest)

    monkeypatch.setattr(Lake, "_write", spy)
    lake.build_gold(START)
    near = {f"{day + timedelta(days=d):%Y-%m-%d}" for d in (-1, 0, 1)}
    for name in ("slot_totals", "mart_fuel_mix", "mart_price_carbon", "mart_temp_vs_demand",
                 "mart_grid_stress", "mart_solar_weather"):
        assert read[name] and read[name] <= near, name


def test_a_reader_keeps_its_state_while_marts_are_made_again(spark):
    rng = random.Random(6)
    hours = [START + timedelta(hours=h) for h in range(30)]
    lake = Lake(spark, scratch_path(spark, "lake"))
    lookup = landing.region_lookup(spark)
    lake.load_silver(feeds(spark, hours, START + timedelta(days=20), rng, False), lookup)
    before = lake.build_gold(START)["mart_price_carbon"]
    rows = sorted(map(str, rows_of(before)))
    lake.load_silver(feeds(spark, hours, START + timedelta(days=21), rng, False), lookup)
    after = lake.build_gold(START)["mart_price_carbon"]
    assert sorted(map(str, rows_of(before))) == rows != sorted(map(str, rows_of(after)))


def test_a_day_that_loses_its_rows_goes(spark):
    path = scratch_path(spark, "t")
    rows = frame(spark, "k int, at ts", *[(i, START + timedelta(hours=9 * i)) for i in range(9)])
    rows = rows.withColumn(snapshots.PART, snapshots.dated("at"))
    first = snapshots.write(spark, path, rows)
    assert len(first.parts) == 4
    days = ["2024-03-30", "2024-03-31"]
    second = snapshots.write(spark, path, rows.filter("k = 8"), replaced=days)
    assert sorted(second.parts) == ["2024-03-29", "2024-04-01"]
    assert second.changed_since(1) == {*days, "2024-04-01"}
    assert sorted(k for k, *_ in rows_of(snapshots.read(spark, path))) == [0, 1, 2, 8]
    with pytest.raises(ValueError, match="column k"):
        snapshots.write(spark, path, rows.withColumn("k", F.col("k").cast("string")))


def test_columns_come_and_tables_can_be_empty(spark):
    path = scratch_path(spark, "t")
    assert rows_of(snapshots.read(spark, path)) == []
    rows = frame(spark, "k int, at ts", (1, START), (2, None))
    rows = rows.withColumn(snapshots.PART, snapshots.dated("at"))
    snapshots.write(spark, path, rows.limit(0))
    assert snapshots.read(spark, path).columns == ["k", "at", "part_date"]
    assert rows_of(snapshots.read(spark, path)) == []
    snapshots.write(spark, path, rows)
    later = rows.filter("k = 2").withColumn("extra", F.lit("x"))
    snapshots.write(spark, path, later)
    got = snapshots.read(spark, path).orderBy("k")
    assert rows_of(got, "k", "extra") == [(1, None), (2, "x")]


def test_reach_of_a_trailing_mean(spark):
    days = {f"2024-01-{d:02d}": n for d, n in zip(range(1, 11), [3, 3, 0, 1, 3, 3, 3, 3, 3, 3])}
    counts = frame(spark, "d string, n int", *[(d, n) for d, n in days.items()])
    counts = counts.select(F.to_date("d").alias("d"), "n")
    reach = runs.trailing_reach(counts, "d", {"2024-01-03"}, 5)
    # Four rows after the place of the lost day: one on the 4th, three on the 5th.
    assert reach.rewritten == {"2024-01-03", "2024-01-04", "2024-01-05"}
    assert reach.read == reach.rewritten | {"2024-01-01", "2024-01-02"}


def test_moments_survive_large_sums(spark):
    rng = random.Random(7)
    rows = []
    for h in range(2_000):
        temp = rng.gauss(10, 3)
        rows.append((START + timedelta(hours=h), 1e9 - 3 * temp + rng.gauss(0, 1), temp, "weekday"))
    mart = frame(spark, "hour_utc ts, total_demand_mw double, temp_c double, day_type string", *rows)
    ((slope, r2, n),) = rows_of(gold.temp_regression_of(gold.regression_moments(mart)))
    ((slope_, r2_, n_),) = rows_of(serve.temp_regression(mart))
    assert (slope, r2, n) == pytest.approx((slope_, r2_, n_), rel=1e-6)
    none = gold.temp_regression_of(gold.regression_moments(mart.limit(0)))
    assert rows_of(none) == rows_of(serve.temp_regression(mart.limit(0))) == [(None, None, 0)]

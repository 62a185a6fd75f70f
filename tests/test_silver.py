from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import (
    RAW_GENERATION, RAW_NATIONAL, RAW_PRICES, RAW_WEATHER, T0, frame, rows_of, ts,
)
from voltlake.functions.numbers import text_to_double
from voltlake.plans import silver
from voltlake.sources.landing import region_lookup

LOAD = ts("2024-06-03 12:00")
LATER = ts("2024-06-03 12:30")


def test_generation_is_cleaned_and_newest_wins(spark):
    raw = frame(
        spark, RAW_GENERATION,
        ("2024-06-03", 1, " wind ", "10", LOAD, "2024-06-02T23:00:00Z"),
        ("2024-06-03", 1, "WIND", "12.5", LATER, "2024-06-02T23:00:00Z"),
        ("2024-06-03", 2, "ccgt", "-3", LOAD, None),
        ("2024-06-03", 3, "ccgt", None, LOAD, None),
        ("2024-06-03", 0, "ccgt", "1", LOAD, None),
        ("2024-10-27", 50, "ccgt", "1", LOAD, None),
        ("2024-10-27", 51, "ccgt", "1", LOAD, None),
    )
    got = silver.stg_generation(raw).orderBy("settlement_key")
    assert rows_of(got, "settlement_key", "period_utc", "generation_mw") == [
        ("2024-06-03_1_WIND", ts("2024-06-02 23:00"), 12.5),
        # without a start time the period counts from UTC midnight: an hour late in summer
        ("2024-06-03_2_CCGT", ts("2024-06-03 00:30"), -3.0),
        ("2024-10-27_50_CCGT", ts("2024-10-28 00:30"), 1.0),
    ]


def test_generation_on_a_short_day(spark):
    rows = [("2024-03-31", p, "WIND", str(p), LOAD, None) for p in range(1, 47)]
    assert silver.stg_generation(frame(spark, RAW_GENERATION, *rows)).count() == 46


def test_one_hot_key_among_many(spark):
    """A third of the rows revise one key; the newest of each key survives."""
    start = datetime(2024, 1, 1)
    hot = [
        ("2024-01-01", 1, "WIND", str(i), start + timedelta(seconds=i), None) for i in range(3000)
    ]
    cold = [
        ("2024-01-02", p, f"F{i}", "1", start, None) for p in range(1, 49) for i in range(125)
    ]
    got = silver.stg_generation(frame(spark, RAW_GENERATION, *hot, *cold).repartition(8))
    assert got.count() == 1 + 48 * 125
    assert rows_of(got.filter("fuel_type = 'WIND'"), "generation_mw") == [(2999.0,)]


def test_weather_sentinels_and_full_times(spark):
    raw = frame(
        spark, RAW_WEATHER,
        ("2024-06-03T10:00", "", "None", LOAD, "50", "0.0", None, "x"),
        ("2024-06-03T10:15", "4.5", "10", LOAD, "50", "0.0", "180", "0"),
        (None, "4.5", "10", LOAD, "50", "0.0", "180", "0"),
    )
    got = silver.stg_weather(raw).orderBy("hour_utc")
    assert rows_of(got, "hour_utc", "temp_c", "windspeed_kmh", "precipitation_mm") == [
        (ts("2024-06-03 10:00"), None, None, None),
        (ts("2024-06-03 10:15"), 4.5, 10.0, 0.0),
    ]


def test_prices_newest_per_slot(spark):
    raw = frame(
        spark, RAW_PRICES,
        ("2024-06-03T10:00:00Z", "2024-06-03T10:30:00Z", 10.0, "A", LATER),
        ("2024-06-03T10:00:00Z", "2024-06-03T10:30:00Z", 20.0, "B", LOAD),
        (None, "2024-06-03T10:30:00Z", 20.0, "B", LOAD),
    )
    assert rows_of(silver.stg_prices(raw), "price_key", "value_inc_vat", "product_code") == [
        ("2024-06-03 10:00:00", 10.0, "A")
    ]


def test_national_prefers_actual_and_keeps_zone_in_key(spark):
    raw = frame(
        spark, RAW_NATIONAL,
        ("2024-06-03T10:00Z", "2024-06-03T10:30Z", "120", "100", "moderate", LOAD),
        ("2024-06-03T10:30Z", "2024-06-03T11:00Z", "", "90", "low", LOAD),
        ("2024-06-03T11:00Z", "2024-06-03T11:30Z", "", "", "", LOAD),
    )
    got = silver.stg_carbon_national(raw).orderBy("period_from")
    assert rows_of(got, "period_key", "intensity_actual", "intensity_best") == [
        ("2024-06-03 10:00:00+00", 120.0, 120.0),
        ("2024-06-03 10:30:00+00", None, 90.0),
        ("2024-06-03 11:00:00+00", None, None),
    ]


def test_regional_snapshots_keep_history_and_unknown_regions(spark):
    raw = frame(
        spark, "regionid string, shortname string, intensity_actual string, "
        "generationmix string, loaded_at ts",
        ("6", "North Wales", "100", "[]", LOAD),
        ("6", "North Wales", "None", "[]", LATER),
        ("99", "Moon", "1", "[]", LOAD),
        (None, "Nowhere", "1", "[]", LOAD),
    )
    got = silver.stg_carbon(raw, region_lookup(spark)).orderBy("regionid", "loaded_at")
    assert rows_of(got, "regionid", "full_name", "intensity_actual", "carbon_key") == [
        (6, "North Wales & Merseyside", 100.0, "6_2024-06-03 12:00:00"),
        (6, "North Wales & Merseyside", None, "6_2024-06-03 12:30:00"),
        (99, None, 1.0, "99_2024-06-03 12:00:00"),
    ]


@pytest.mark.parametrize("zone", ["UTC", "Europe/London", "Asia/Tokyo"])
def test_slot_texts_do_not_depend_on_the_machine_zone(spark, zone):
    """Prices are zone-less; only the session zone setting of the jobs matters."""
    raw = frame(
        spark, RAW_PRICES, ("2024-06-03T10:00:00Z", "2024-06-03T10:30:00Z", 10.0, "A", LOAD)
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert rows_of(silver.stg_prices(raw), "price_key") == [("2024-06-03 10:00:00",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_keys_separate_series(spark):
    raw = frame(
        spark, "region string, " + RAW_PRICES,
        ("E", "2024-06-03T10:00:00Z", "2024-06-03T10:30:00Z", 10.0, "A", LOAD),
        ("M", "2024-06-03T10:00:00Z", "2024-06-03T10:30:00Z", 20.0, "A", LOAD),
    )
    got = silver.stg_prices(raw, ["region"]).orderBy("region")
    assert rows_of(got, "region", "value_inc_vat") == [("E", 10.0), ("M", 20.0)]


def test_offsets_in_slot_times_are_applied(spark):
    rows = [
        ("2024-06-03T12:00:00+01:00", "2024-06-03T12:30:00+01:00", 5.0, "A", T0),
        ("2024-06-03T11:30:00Z", "2024-06-03T12:00:00Z", 6.0, "A", T0),
        ("2024-06-03T12:00:00", "2024-06-03 12:30", 7.0, "A", T0),
    ]
    got = silver.stg_prices(frame(spark, RAW_PRICES, *rows)).orderBy("valid_from")
    assert rows_of(got, "valid_from", "valid_to", "value_inc_vat") == [
        (ts("2024-06-03 11:00"), ts("2024-06-03 11:30"), 5.0),
        (ts("2024-06-03 11:30"), ts("2024-06-03 12:00"), 6.0),
        (ts("2024-06-03 12:00"), ts("2024-06-03 12:30"), 7.0),
    ]
    mw = frame(
        spark, RAW_GENERATION, ("2024-06-03", 25, "wind", "8", T0, "2024-06-03T13:00:00+01:00")
    )
    assert rows_of(silver.stg_generation(mw), "period_utc") == [(T0,)]


def test_rows_without_a_series_are_left_out_and_counted(spark):
    rows = [
        (zone, "2024-06-03T12:00:00Z", "2024-06-03T12:30:00Z", price, "A", T0)
        for zone, price in (("n", 1.0), (None, 2.0), ("s", 3.0), (None, 4.0))
    ]
    raw = frame(spark, "zone string, " + RAW_PRICES, *rows)
    got = silver.stg_prices(raw, ["zone"])
    assert sorted(rows_of(got, "zone", "value_inc_vat")) == [("n", 1.0), ("s", 3.0)]
    assert rows_of(silver.without_series(raw, ["zone"])) == [(2,)]
    assert rows_of(silver.without_series(raw, [])) == [(0,)]


def test_unreadable_text_is_counted(spark):
    texts = [("12.5",), ("",), ("None",), (None,), ("abc",), ("1e3",), ("--",)]
    counts = silver.unreadable(frame(spark, "t string", *texts), {"t": text_to_double(F.col("t"))})
    assert rows_of(counts) == [(2,)]

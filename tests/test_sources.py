import json
from datetime import date, datetime
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, frame, rows_of
from voltlake.functions.timeparts import parse_utc_offset
from voltlake.session import scratch_path
from voltlake.sources import landing, payloads as flat
from voltlake.sinks.tables import publish_view, rebuild, text_times, write_json


def texts(spark, *docs):
    rows = [(d if isinstance(d, str) else json.dumps(d), T0) for d in docs]
    return frame(spark, "payload string, loaded_at ts", *rows)


READING = {
    "settlementDate": "2024-06-03", "settlementPeriod": 1, "fuelType": "WIND",
    "generation": 12.5, "startTime": "2024-06-02T23:00:00Z", "publishTime": "ignored",
}


def test_generation_bare_or_wrapped(spark):
    docs = texts(
        spark, [READING, {**READING, "generation": 7}], {"data": [READING]}, {"data": []}, {}, [],
        "<html>502</html>",
    )
    got = flat.flatten_generation(docs)
    assert sorted(v for (v,) in rows_of(got, "generation")) == ["12.5", "12.5", "7"]
    assert {tuple(r)[:3] for r in got.collect()} == {("2024-06-03", 1, "WIND")}
    assert rows_of(flat.unreadable(docs)) == [(1,)]


def test_weather_stops_at_the_shortest_array(spark):
    hourly = {
        "time": ["2024-06-03T00:00", "2024-06-03T01:00", "2024-06-03T02:00"],
        "temperature_2m": [1.5, None, 3], "windspeed_10m": [1, 2], "cloudcover": [1, 2, 3],
        "direct_radiation": [0, 0, 0], "wind_direction_10m": [1, 2, 3], "precipitation": [0, 0, 0],
    }
    missing = {k: v for k, v in hourly.items() if k != "precipitation"}
    empty = {**hourly, "time": []}
    got = flat.flatten_weather(
        texts(spark, {"hourly": hourly}, {"hourly": missing}, {"hourly": empty}, {}, "oops")
    )
    assert sorted(rows_of(got, "time", "temperature_2m", "windspeed_10m")) == [
        ("2024-06-03T00:00", "1.5", "1"), ("2024-06-03T01:00", None, "2"),
    ]


@pytest.mark.parametrize(
    "intensity, expected",
    [
        ({"actual": 120, "forecast": 100}, "120"),
        ({"actual": 0, "forecast": 100}, "100"),
        ({"forecast": 100}, "100"),
        ({"actual": None, "forecast": 0}, "0"),
        ({}, "None"),
    ],
)
def test_regional_value(spark, intensity, expected):
    region = {
        "regionid": 3, "shortname": "NW", "intensity": intensity,
        "generationmix": [{"fuel": "gas", "perc": 10.5}],
    }
    bare = {k: v for k, v in region.items() if k != "generationmix"}
    docs = texts(spark, {"data": [{"regions": [region]}, {"regions": [bare]}]}, {"data": []}, {})
    got = flat.flatten_regional(docs).orderBy(F.desc("generationmix"))
    assert [v for (v,) in rows_of(got, "intensity_actual")] == [expected] * 2
    mixes = [json.loads(m) for (m,) in rows_of(got, "generationmix")]
    assert sorted(mixes, key=len) == [[], [{"fuel": "gas", "perc": 10.5}]]


@pytest.mark.parametrize(
    "intensity, expected",
    [
        ({"actual": 10, "forecast": 12, "index": "low"}, ("10", "12", "low")),
        ({"actual": 0, "forecast": 0, "index": ""}, ("", "", "")),
        ({"actual": None}, ("", "", "")),
    ],
)
def test_national_values(spark, intensity, expected):
    doc = {"data": [{"from": "2024-06-03T00:00Z", "to": "2024-06-03T00:30Z", "intensity": intensity}]}
    got = flat.flatten_national(texts(spark, doc))
    assert rows_of(got, "intensity_actual", "intensity_forecast", "intensity_index") == [expected]


PRODUCTS = [
    {"code": "AGILE-23"}, {"code": "AGILE-24", "direction": "IMPORT", "is_prepay": False},
    {"code": "AGILE-25", "direction": "EXPORT"}, {"code": "AGILE-26", "is_prepay": True},
    {"code": "VAR-99"},
]


def test_product_and_prices(spark):
    products = texts(spark, {"results": PRODUCTS[:3]}, {"results": PRODUCTS[3:]})
    assert landing.priced_by(products) == "AGILE-24"
    with pytest.raises(ValueError):
        landing.priced_by(texts(spark, {"results": PRODUCTS[2:]}))
    rates = {"results": [{"valid_from": "a", "valid_to": "b", "value_inc_vat": 3}]}
    got = flat.flatten_prices(texts(spark, rates, {"results": []}), "AGILE-24")
    assert rows_of(got) == [("a", "b", 3.0, "AGILE-24", T0)]


def test_fetch_window_and_settlement_dates(spark):
    slots = ["2024-06-02T11:59Z", "2024-06-02T12:00Z", "2024-06-05T11:30Z", "2024-06-05T12:00Z"]
    df = frame(spark, "t string", *[(s,) for s in slots])
    got = flat.within_fetch_window(df, parse_utc_offset(F.col("t")), T0)
    assert [t for (t,) in rows_of(got)] == slots[1:3]
    # late in a summer evening the local date is a day ahead
    assert flat.settlement_dates(datetime(2024, 6, 3, 23, 30)) == (
        date(2024, 6, 2), date(2024, 6, 4),
    )


def test_landed_files_with_one_document_each(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([READING], indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"data": [READING, READING]}, indent=2))
    docs = landing.read_payloads(spark, str(tmp_path), T0, whole_files=True)
    got = flat.flatten_generation(docs)
    assert got.count() == 3
    assert {r.loaded_at for r in got.collect()} == {T0}


def test_a_failing_source_does_not_stop_the_others(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.json").write_text(json.dumps([READING, READING]))

    def source(name, note=None):
        return landing.Source(
            name,
            lambda: landing.read_payloads(spark, str(tmp_path / name), T0),
            flat.flatten_generation,
            str(tmp_path / f"bronze_{name}"),
            note=note,
        )

    sources = [source("missing"), source("good", note=lambda: "X"), source("absent")]
    audit = landing.load_sources(spark, sources)
    status = {s: (t, n) for s, t, n in rows_of(audit)}
    assert status["good"] == ("OK — 2 rows (X)", 2)
    assert status["missing"][0].startswith("ERROR — ") and status["absent"][1] is None
    (tmp_path / "empty").mkdir()
    assert landing.load_sources(spark, [source("empty")]).first()["status"] == "OK — 0 rows"
    landing.load_sources(spark, sources[1:2])
    stored = landing.read_bronze(spark, str(tmp_path / "bronze_good"), "raw_generation")
    assert stored.count() == 4  # bronze is only ever appended to


def test_region_lookup_from_file(spark, tmp_path):
    path = tmp_path / "regions.csv"
    path.write_text("regionid,shortname,full_name\n1,A,Alpha & Co\n")
    assert rows_of(landing.region_lookup(spark, str(path))) == [(1, "A", "Alpha & Co")]
    assert landing.region_lookup(spark).count() == 14


def test_sinks(spark):
    df = frame(spark, "t ts, d date, n int", (T0, date(2024, 6, 3), None))
    path = scratch_path(spark, "sink")
    for _ in range(2):
        assert rows_of(rebuild(df, path)) == rows_of(df)
    assert rebuild(df, scratch_path(spark, "sink"), ("d",)).count() == 1
    publish_view(df, "slots_view")
    assert spark.sql("SELECT t FROM slots_view").collect() == [(T0,)]
    assert rows_of(text_times(df)) == [("2024-06-03 12:00:00", "2024-06-03", None)]
    out = scratch_path(spark, "json")
    write_json(df, out)
    (line,) = [r.value for r in spark.read.text(out).collect()]
    assert json.loads(line) == {"t": "2024-06-03 12:00:00", "d": "2024-06-03", "n": None}


def test_one_failing_feed_of_any_kind_stops_no_other(spark, tmp_path):
    def silent():
        raise RuntimeError

    payload = frame(spark, "payload string, loaded_at ts", ("no json", T0))
    audit = landing.load_sources(
        spark,
        [
            landing.Source("silent", silent, flat.flatten_weather, str(tmp_path / "a")),
            landing.Source("garbage", lambda: payload, flat.flatten_weather, str(tmp_path / "b")),
            landing.priced_source("prices", lambda: payload, silent, str(tmp_path / "c")),
        ],
    )
    assert rows_of(audit, "source", "status") == [
        ("silent", "ERROR — RuntimeError"),
        ("garbage", "ERROR — none of 1 payloads is JSON"),
        ("prices", "ERROR — RuntimeError"),
    ]


def test_sources_are_loaded_side_by_side(spark, tmp_path):
    """Each of two sources waits for the other; loaded in turn, neither would end well."""
    both = Barrier(2)

    def payloads():
        both.wait(timeout=60)
        return texts(spark, {"data": []})

    sources = [
        landing.Source(name, payloads, flat.flatten_national, f"{tmp_path}/{name}") for name in ("b", "a")
    ]
    rows = landing.load_sources(spark, sources).collect()
    assert [(r.source, r.status) for r in rows] == [("b", "OK — 0 rows"), ("a", "OK — 0 rows")]


def test_sources_of_one_target_are_loaded_in_turn(spark, tmp_path):
    begun = []

    def source(name):
        def payloads():
            begun.append(name)
            raise ValueError(name)

        return landing.Source(name, payloads, flat.flatten_national, f"{tmp_path}/one")

    names = [f"s{n}" for n in range(6)]
    rows = landing.load_sources(spark, [source(n) for n in names]).collect()
    assert begun == names == [r.source for r in rows]

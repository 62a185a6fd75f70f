import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, rows_of, ts
from voltlake.functions import numbers, scoring, timeparts

random.seed(7)


def _doubles():
    ties = [k / 10**d + 5 / 10 ** (d + 1) for d in (0, 1, 2) for k in range(-300, 300)]
    cents = [random.randrange(-10**6, 10**6) / 100 / n for n in (2, 3, 4, 7) for _ in range(500)]
    raw = [random.uniform(-1e4, 1e4) for _ in range(500)]
    odd = [0.49999999999999994, 1.005, 0.285, 2.675, -2.675, 0.0, 1e300, 4.6e15, 1e-300]
    wild = [struct.unpack("d", struct.pack("Q", random.getrandbits(64)))[0] for _ in range(300)]
    return ties + cents + raw + odd + [w for w in wild if abs(w) < 1e15]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_half_away_rounds_the_scaled_double(spark, digits):
    values = _doubles()
    got = rows_of(
        frame(spark, "x double", *[(v,) for v in values]).select(
            "x", numbers.round_half_away(F.col("x"), digits)
        )
    )
    expected = duckdb.execute(
        f"SELECT x, round(x, {digits}) FROM (SELECT unnest(?) AS x)", [values]
    ).fetchall()
    assert got == expected


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_half_even_is_the_correctly_rounded_decimal(spark, digits):
    values = [v for v in _doubles() if abs(v) < 1e290]
    got = rows_of(
        frame(spark, "x double", *[(v,) for v in values]).select(
            "x", numbers.round_half_even(F.col("x"), digits)
        )
    )
    assert [(x, y) for x, y in got if y != round(x, digits)] == []


def test_null_stays_null(spark):
    df = frame(spark, "x double", (None,))
    assert rows_of(df.select(numbers.round_half_away(F.col("x"), 1))) == [(None,)]
    assert rows_of(df.select(numbers.round_half_even(F.col("x"), 1))) == [(None,)]


def test_text_numbers(spark):
    df = frame(spark, "t string", ("12.5",), ("",), ("None",), (None,), ("n/a",), ("-3",))
    got = [v for (v,) in rows_of(df.select(numbers.text_to_double(F.col("t"))))]
    assert got == [12.5, None, None, None, None, -3.0]


def test_slots_hours_and_weekdays(spark):
    df = frame(
        spark, "t ts", (ts("2024-06-02 23:59:59.9"),), (ts("2024-06-03 00:30:00"),)
    ).select(
        timeparts.slot_of(F.col("t")),
        timeparts.hour_of(F.col("t")),
        timeparts.weekday_number(F.col("t")),
        timeparts.weekday_name(F.col("t")),
        timeparts.day_type(F.col("t")),
    )
    assert rows_of(df) == [
        (ts("2024-06-02 23:30"), ts("2024-06-02 23:00"), 0, "Sun", "weekend"),
        (ts("2024-06-03 00:30"), ts("2024-06-03 00:00"), 1, "Mon", "weekday"),
    ]


def test_local_time_across_both_clock_changes(spark):
    moments = ["2024-03-31 00:30", "2024-03-31 01:00", "2024-10-27 00:30", "2024-10-27 01:00"]
    df = frame(spark, "t ts", *[(ts(m),) for m in moments]).select(
        timeparts.local_time(F.col("t"), "Europe/London")
    )
    assert [v for (v,) in rows_of(df)] == [
        ts("2024-03-31 00:30"),
        ts("2024-03-31 02:00"),
        ts("2024-10-27 01:30"),
        ts("2024-10-27 01:00"),
    ]


@pytest.mark.parametrize("text, slot", [
    ("2024-06-03T12:00:00Z", "2024-06-03 12:00"),
    ("2024-06-03T12:00:00+01:00", "2024-06-03 11:00"),
    ("2024-06-03 12:00:00 +01:00", "2024-06-03 11:00"),
    ("2024-06-03T12:00:00 Europe/London", "2024-06-03 11:00"),
    ("2024-01-03T12:00:00 Europe/London", "2024-01-03 12:00"),
    ("2024-06-03T12:00:00-0230", "2024-06-03 14:30"),
    ("2024-06-03T12:00:00-02:30", "2024-06-03 14:30"),
    ("2024-06-03T12:00", "2024-06-03 12:00"),
    ("2024-06-03", "2024-06-03 00:00"),
    ("2024-03-31T01:30:00", "2024-03-31 01:30"),
    ("2024-06-03T12:00:00 Nowhere/Town", None),
    ("noon", None),
    ("", None),
    (None, None),
])
def test_any_zone_the_cast_reads_is_applied(spark, text, slot):
    got = frame(spark, "t string", (text,)).select(timeparts.parse_utc(F.col("t")))
    assert rows_of(got) == [(slot and ts(slot),)]


def test_offsets_are_shifted_to_utc(spark):
    df = frame(
        spark, "t string", ("2024-06-01T00:00Z",), ("2024-06-01T00:00+01:00",), ("soon",)
    ).select(timeparts.parse_utc_offset(F.col("t")))
    assert [v for (v,) in rows_of(df)] == [
        ts("2024-06-01 00:00"),
        ts("2024-05-31 23:00"),
        None,
    ]


def test_weight_is_clamped_amplified_and_saturates(spark):
    weights = [-1.0, 0.0, 0.4, 0.5, 0.6, 0.7777777777777778, 0.9, 1.0, 5.0]
    df = frame(spark, "w double", *[(w,) for w in weights])
    got = [v for (v,) in rows_of(df.select(scoring.amplify_weight(F.col("w"))))]
    assert got == pytest.approx([0.0, 0.0, 0.32, 0.5, 0.68, 1.0, 1.0, 1.0, 1.0])


def test_score_rounds_ties_to_even_and_bands_it(spark):
    df = frame(spark, "p double, c double", (0.375, 0.375), (0.365, 0.365), (0.0, 0.0), (1.0, 1.0))
    score = scoring.blended_score(F.col("p"), F.col("c"), F.lit(0.5))
    scored = df.select(score.alias("s")).withColumn("r", scoring.recommendation(F.col("s")))
    assert [s for s, _ in rows_of(scored)] == [62, 64, 100, 0]
    texts = [
        r
        for _, r in rows_of(
            frame(spark, "s int", (75,), (74,), (55,), (54,), (35,), (34,)).withColumn(
                "r", scoring.recommendation(F.col("s"))
            )
        )
    ]
    assert [t.split(",")[0] for t in texts] == [
        "Excellent", "Good", "Good", "Fair", "Fair", "Poor",
    ]

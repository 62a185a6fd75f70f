"""Grid feeds derived from the test tables, so the jobs run on given data.

Every row of ``events`` becomes one landed reading of each feed, which keeps the work
proportional to the table: about seven revisions per half hour at sf0.01, seventy at
sf0.1. Measures sit on a binary grid (quarters, whole numbers), so sums are exact and
do not depend on the order in which engines add them. ``oracle.py`` states the same
feeds in SQL.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltlake.functions.numbers import banded
from voltlake.functions.timeparts import hour_of, slot_of
from voltlake import settings

AS_OF = datetime(2024, 1, 15, 12, 10)
FUELS = {
    "view": " wind ",
    "signup": "biomass",
    "click": "CCGT",
    "purchase": "Nuclear",
    "error": "intfr",
}
FUEL_COLUMNS = ("BIOMASS", "CCGT", "INTFR", "NUCLEAR", "WIND")
ZONES = 8


def _id() -> Column:
    return F.col("event_id")


def _ts() -> Column:
    return F.col("ts")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_zone(table(spark, sf_dir, "events"))


def with_zone(df: DataFrame) -> DataFrame:
    """Adds the series key of the keyed queries."""
    return df.selectExpr("*", f"concat('Z', user_id % {ZONES}) AS zone")


def _iso(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, pattern)


def _slot_text(ts: Column) -> Column:
    return _iso(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _minute_text(ts: Column) -> Column:
    return _iso(ts, "yyyy-MM-dd'T'HH:mm'Z'")


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


_SLOT = (
    "CAST(date_trunc('hour', ts) AS timestamp_ntz)"
    " + CASE WHEN minute(ts) >= 30 THEN INTERVAL 30 MINUTES ELSE INTERVAL 0 MINUTES END"
)
_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
_ISO_MINUTE = "yyyy-MM-dd'T'HH:mm'Z'"
_SUMMER = "yyyy-MM-dd'T'HH:mm:ss'+01:00'"


def _iso_sql(slot: str) -> str:
    """The slot as text; every seventh event writes summer time with its offset."""
    return (
        f'CASE WHEN event_id % 7 = 1 THEN date_format({slot} + INTERVAL 1 HOUR, "{_SUMMER}") '
        f'ELSE date_format({slot}, "{_ISO}") END'
    )
_PERIOD = "hour(ts) * 2 + CASE WHEN minute(ts) >= 30 THEN 2 ELSE 1 END"


def _fuel_name() -> str:
    arms = " ".join(f"WHEN '{kind}' THEN '{fuel}'" for kind, fuel in FUELS.items())
    return f"CASE event_type {arms} END"


def _gap(number: str, missing: str, mark: str) -> str:
    """A reading as text, or the feed's mark for a missing one."""
    return f"CASE WHEN {missing} THEN '{mark}' ELSE CAST({number} AS string) END"


def raw_generation(ev: DataFrame, keys=()) -> DataFrame:
    return ev.selectExpr(
        *keys,
        "CAST(CAST(ts AS date) AS string) AS settlement_date",
        f"{_PERIOD} AS settlement_period",
        f"{_fuel_name()} AS fuel_type",
        "CAST(CAST(rint(value * 100) AS bigint) * CASE WHEN event_type = 'error'"
        " AND event_id % 3 = 0 THEN -1 ELSE 1 END AS string) AS generation",
        "ts AS loaded_at",
        f"CASE WHEN event_id % 10 <> 0 THEN {_iso_sql(_SLOT)} END AS start_time",
    )


def raw_weather(ev: DataFrame, keys=()) -> DataFrame:
    sun = "CASE WHEN hour(ts) BETWEEN 6 AND 18 THEN event_id * 13 % 900 ELSE 0 END"
    readings = {
        "temperature_2m": _gap("floor(value) % 30 - 5", "event_id % 17 = 4", ""),
        "windspeed_10m": _gap("concat(event_id % 45, '.5')", "event_id % 19 = 7", "None"),
        "cloudcover": _gap("event_id * 7 % 101", "event_id % 11 = 3", "None"),
        "direct_radiation": _gap(sun, "event_id % 13 = 5", ""),
        "wind_direction_10m": _gap("event_id * 37 % 360", "event_id % 23 = 9", ""),
        "precipitation": "concat(event_id % 10, '.25')",
    }
    return ev.selectExpr(
        *keys,
        "date_format(date_trunc('hour', ts), \"yyyy-MM-dd'T'HH:mm\") AS time",
        *[f"{text} AS {name}" for name, text in readings.items()],
        "ts AS loaded_at",
    )


def raw_prices(ev: DataFrame, keys=()) -> DataFrame:
    return ev.selectExpr(
        *keys,
        f"{_iso_sql(_SLOT)} AS valid_from",
        f"{_iso_sql(_SLOT + ' + INTERVAL 30 MINUTES')} AS valid_to",
        "floor(value * 4) / 4.0D - 10.0D AS value_inc_vat",
        "concat('AGILE-', event_type) AS product_code",
        "ts AS loaded_at",
    )


def raw_carbon_national(ev: DataFrame, keys=()) -> DataFrame:
    """Slots run 36 hours ahead of the load; the actual is unknown after AS_OF."""
    ahead = ev.selectExpr(
        *keys,
        "ts AS loaded_at",
        f"{_SLOT} + INTERVAL 36 HOURS AS slot",
        "floor(value * 4) AS guess",
        "floor(value * 4) + event_id % 7 AS known",
    )
    return ahead.select(
        *keys,
        F.expr(f'date_format(slot, "{_ISO_MINUTE}") AS from_time'),
        F.expr(f'date_format(slot + INTERVAL 30 MINUTES, "{_ISO_MINUTE}") AS to_time'),
        F.expr(
            f"CASE WHEN slot > TIMESTAMP_NTZ '{AS_OF}' OR known = 0 THEN ''"
            " ELSE CAST(known AS string) END AS intensity_actual"
        ),
        F.expr(_gap("guess", "guess = 0", "")).alias("intensity_forecast"),
        banded(F.col("guess"), settings.INTENSITY_BANDS, settings.INTENSITY_REST).alias(
            "intensity_index"
        ),
        "loaded_at",
    )


def raw_carbon(ev: DataFrame, keys=()) -> DataFrame:
    return ev.selectExpr(
        *keys,
        "CAST(user_id % 27 AS string) AS regionid",
        "concat('R', user_id % 27) AS shortname",
        f"{_gap('CAST(floor(value) AS bigint)', 'event_id % 29 = 7', 'None')}"
        " AS intensity_actual",
        'concat(\'[{"fuel":"\', event_type, \'","perc":\', event_id % 100, \'}]\')'
        " AS generationmix",
        "ts AS loaded_at",
    )


def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("regionid"),
        F.col("n_name").alias("shortname"),
        F.col("n_name").alias("full_name"),
    )


RAW = {
    "raw_generation": raw_generation,
    "raw_weather": raw_weather,
    "raw_prices": raw_prices,
    "raw_carbon_national": raw_carbon_national,
    "raw_carbon": raw_carbon,
}


# Landed payloads: one small response per event, so nothing has to be gathered.


def _payload(ev: DataFrame, text: Column) -> DataFrame:
    return ev.select("event_id", text.alias("payload"), _ts().alias("loaded_at"))


def generation_payloads(ev: DataFrame) -> DataFrame:
    """Two readings; the list is bare for odd events and under ``data`` for even ones."""
    period = F.hour(_ts()) * 2 + F.when(F.minute(_ts()) >= 30, 2).otherwise(1)

    def reading(fuel: Column, mw: Column) -> Column:
        return F.struct(
            F.to_date(_ts()).cast("string").alias("settlementDate"),
            period.alias("settlementPeriod"),
            fuel.alias("fuelType"),
            mw.alias("generation"),
            _slot_text(slot_of(_ts())).alias("startTime"),
        )

    rows = F.array(
        reading(F.upper("event_type"), F.rint(F.col("value") * 100).cast("long")),
        reading(F.lit("OTHER"), _id() % 1000 - 500),
    )
    wrapped = F.to_json(F.struct(rows.alias("data")))
    return _payload(ev, F.when(_id() % 2 == 0, wrapped).otherwise(F.to_json(rows)))


def weather_payloads(ev: DataFrame) -> DataFrame:
    """Three hours; every fourth response is one wind reading short."""
    hours = F.array(*[F.lit(n) for n in range(3)])

    def series(value) -> Column:
        return F.transform(hours, value)

    def time(n: Column) -> Column:
        return _iso(hour_of(_ts()) + F.make_dt_interval(hours=n), "yyyy-MM-dd'T'HH:mm")

    wind = series(lambda n: (_id() + n) % 45)
    body = F.struct(
        series(time).alias("time"),
        series(
            lambda n: F.when((_id() + n) % 17 != 4, _whole(F.col("value")) % 30 - n)
        ).alias("temperature_2m"),
        F.when(_id() % 4 == 0, F.slice(wind, 1, 2)).otherwise(wind).alias("windspeed_10m"),
        series(lambda n: (_id() + n) % 101).alias("cloudcover"),
        series(lambda n: (_id() + n) * 13 % 900).alias("direct_radiation"),
        series(lambda n: (_id() + n) * 37 % 360).alias("wind_direction_10m"),
        series(lambda n: (_id() + n) % 10).alias("precipitation"),
    )
    return _payload(ev, F.to_json(F.struct(body.alias("hourly"))))


def regional_payloads(ev: DataFrame) -> DataFrame:
    """Two regions; the actual is zero, missing or known by turns."""
    forecast = _whole(F.col("value")) + 1
    actual = F.when(_id() % 3 == 0, F.lit(0).cast("long")).when(
        _id() % 3 == 2, forecast + 5
    )
    mix = F.array(F.struct(F.col("event_type").alias("fuel"), (_id() % 100).alias("perc")))

    def region(n: int, actual: Column) -> Column:
        number = (F.col("user_id") % 14 + n).cast("int")
        return F.struct(
            number.alias("regionid"),
            F.concat(F.lit("R"), number.cast("string")).alias("shortname"),
            F.struct(actual.alias("actual"), (forecast + n).alias("forecast")).alias("intensity"),
            mix.alias("generationmix"),
        )

    regions = F.array(region(1, actual), region(15, F.lit(None).cast("long")))
    entry = F.struct(regions.alias("regions"))
    return _payload(ev, F.to_json(F.struct(F.array(entry).alias("data"))))


def price_payloads(ev: DataFrame) -> DataFrame:
    def rate(n: int) -> Column:
        start = slot_of(_ts()) + F.lit(n * settings.SLOT)
        return F.struct(
            _slot_text(start).alias("valid_from"),
            _slot_text(start + F.lit(settings.SLOT)).alias("valid_to"),
            (F.floor(F.col("value") * 4) / 4.0 - n).alias("value_inc_vat"),
        )

    rates = F.array(rate(0), rate(1))
    return _payload(ev, F.to_json(F.struct(rates.alias("results"))))


def product_payloads(ev: DataFrame) -> DataFrame:
    """Two products; direction and prepay mark are left out by turns."""
    day = _iso(_ts(), "yy-MM-dd")
    kind = F.when(F.col("event_type") == "view", "VAR-").otherwise("AGILE-")
    first = F.struct(
        F.concat(kind, day).alias("code"),
        F.when(F.col("event_type") == "click", "EXPORT")
        .when(F.col("event_type") == "error", "IMPORT")
        .alias("direction"),
        F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type") == "purchase")
        .alias("is_prepay"),
    )
    second = F.struct(
        F.concat(F.lit("FLEX-"), day).alias("code"),
        F.lit("IMPORT").alias("direction"),
        F.lit(False).alias("is_prepay"),
    )
    docs = F.to_json(F.struct(F.array(first, second).alias("results")))
    return ev.select("event_id", "zone", docs.alias("payload"), _ts().alias("loaded_at"))


def national_payloads(ev: DataFrame) -> DataFrame:
    forecast = _whole(F.col("value"))

    def slot(n: int) -> Column:
        start = slot_of(_ts()) + F.lit(n * settings.SLOT)
        return F.struct(
            _minute_text(start).alias("from"),
            _minute_text(start + F.lit(settings.SLOT)).alias("to"),
            F.struct(
                F.when(_id() % 5 != 0, forecast + n).alias("actual"),
                forecast.alias("forecast"),
                F.when(_id() % 7 != 0, "moderate").alias("index"),
            ).alias("intensity"),
        )

    slots = F.array(slot(0), slot(1))
    return _payload(ev, F.to_json(F.struct(slots.alias("data"))))

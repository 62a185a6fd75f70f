"""Bronze to silver: typed columns, UTC slots, newest reading per key.

Every function takes a bronze frame and optional series ``keys`` (region, tariff,
meter) that exist in it; without keys the frame is one series.

Text that cannot be read becomes NULL instead of failing the load; ``unreadable`` counts
it. A row without a value in one of the ``keys`` belongs to no series: it is left out
here, and ``without_series`` counts such rows.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voltlake import settings
from voltlake.functions.numbers import text_to_double
from voltlake.functions.timeparts import NTZ, parse_utc, parse_utc_offset
from voltlake.operators.latest import newest_per_key


def _in_series(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that belong to a series."""
    return raw.dropna(subset=list(keys)) if keys else raw


def without_series(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many bronze rows have no series: one row, column ``n_rows``."""
    known = raw.select(*keys).dropna(subset=list(keys)) if keys else raw
    return raw.agg(F.count("*").alias("n_all")).join(known.agg(F.count("*").alias("n_known"))).select(
        (F.col("n_all") - F.col("n_known")).alias("n_rows")
    )


def unreadable(raw: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """How often text is there but its typed value is not: one row, a column per name.

    ``columns`` gives the typed expression of each text column, such as
    ``{"valid_from": parse_utc(F.col("valid_from"))}``. Blank and ``None`` are no values.
    """
    blank = ("", "None")
    return raw.agg(
        *[
            F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*blank) & typed.isNull()).alias(c)
            for c, typed in columns.items()
        ]
    )


def typed_generation(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every reading with its types, slot and key, revisions included. Streams, too.

    Rows without a start time fall back to date and period number, which is an hour
    late while clocks are on summer time.
    """
    date = F.col("settlement_date").try_cast("date")
    period = F.col("settlement_period").try_cast("int")
    counted = date.cast(NTZ) + F.make_dt_interval(mins=30 * (period - 1))
    known = F.col("generation").isNotNull() & period.between(1, settings.PERIODS_PER_DAY_MAX)
    typed = (
        _in_series(raw, keys)
        .filter(known)
        .select(
            *keys,
            date.alias("settlement_date"),
            period.alias("settlement_period"),
            F.coalesce(parse_utc(F.col("start_time")), counted).alias("period_utc"),
            F.upper(F.trim("fuel_type")).alias("fuel_type"),
            F.col("generation").try_cast("double").alias("generation_mw"),
            "loaded_at",
        )
    )
    key = F.concat("settlement_date", F.lit("_"), "settlement_period", F.lit("_"), "fuel_type")
    return typed.withColumn("settlement_key", key)


def stg_generation(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Half-hourly MW per fuel, the newest reading of each key."""
    return newest_per_key(typed_generation(raw, keys), [*keys, "settlement_key"])


def stg_weather(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weather per reported time; times are kept as given, not cut to the hour."""
    measures = {
        "temp_c": "temperature_2m",
        "windspeed_kmh": "windspeed_10m",
        "cloudcover_pct": "cloudcover",
        "direct_radiation_wm2": "direct_radiation",
        "wind_direction_deg": "wind_direction_10m",
        "precipitation_mm": "precipitation",
    }
    typed = (
        _in_series(raw, keys)
        .filter(F.col("time").isNotNull())
        .select(
            *keys,
            parse_utc(F.col("time")).alias("hour_utc"),
            *[text_to_double(F.col(c)).alias(name) for name, c in measures.items()],
            "loaded_at",
        )
    )
    return newest_per_key(typed, [*keys, "hour_utc"])


def stg_prices(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Price per half-hour slot, in pence including tax."""
    typed = (
        _in_series(raw, keys)
        .filter(F.col("valid_from").isNotNull())
        .select(
            *keys,
            parse_utc(F.col("valid_from")).alias("valid_from"),
            parse_utc(F.col("valid_to")).alias("valid_to"),
            F.col("value_inc_vat").cast("double").alias("value_inc_vat"),
            "product_code",
            "loaded_at",
        )
    )
    newest = newest_per_key(typed, [*keys, "valid_from"])
    return newest.withColumn("price_key", F.col("valid_from").cast("string"))


def stg_carbon_national(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """National intensity per slot: the actual where published, else the forecast."""
    actual, forecast = (
        F.nullif(F.col(c), F.lit("")) for c in ("intensity_actual", "intensity_forecast")
    )
    typed = (
        _in_series(raw, keys)
        .filter(F.col("from_time").isNotNull())
        .select(
            *keys,
            parse_utc_offset(F.col("from_time")).alias("period_from"),
            parse_utc_offset(F.col("to_time")).alias("period_to"),
            actual.try_cast("double").alias("intensity_actual"),
            forecast.try_cast("double").alias("intensity_forecast"),
            F.coalesce(actual, forecast).try_cast("double").alias("intensity_best"),
            "intensity_index",
            "loaded_at",
        )
    )
    newest = newest_per_key(typed, [*keys, "period_from"])
    return newest.withColumn("period_key", F.concat(F.col("period_from").cast("string"), F.lit("+00")))


def stg_carbon(raw: DataFrame, lookup: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Regional snapshots with the region's full name; every snapshot is kept.

    No broadcast hint: Spark broadcasts the lookup when its size allows, and otherwise
    shuffles, where adaptive execution splits a region that holds most snapshots.
    """
    names = lookup.selectExpr("CAST(regionid AS int) AS regionid", "full_name")
    typed = (
        _in_series(raw, keys)
        .filter(F.col("regionid").isNotNull())
        .select(
            *keys,
            F.col("regionid").try_cast("int").alias("regionid"),
            "shortname",
            text_to_double(F.col("intensity_actual")).alias("intensity_actual"),
            "generationmix",
            "loaded_at",
        )
    )
    return typed.join(names, "regionid", "left").selectExpr(
        *keys,
        "regionid",
        "shortname",
        "full_name",
        "intensity_actual",
        "generationmix",
        "loaded_at",
        "concat(regionid, '_', loaded_at) AS carbon_key",
    )

"""Flatten landed JSON payloads into bronze rows.

Each function takes a frame with the payload text in ``payload`` and its load time in
``loaded_at``, batch or streaming alike, and is one narrow pass: no shuffle, and the
arrays it explodes are as large as one response. Each text is parsed once: a filter on
the parsed document before the generator would parse it again per condition. A text that is no JSON of the expected
shape yields no rows; ``unreadable`` counts those.
"""

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from voltlake import settings
from voltlake.functions.timeparts import at
from voltlake.sources import schemas


def _parsed(payloads: DataFrame, shape: str) -> DataFrame:
    others = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*others, F.from_json("payload", shape).alias("_doc"))


def _others(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("_doc", "loaded_at")]


def _falsy_number(text: Column) -> Column:
    """True for a missing, blank or zero value, which the feeds use for "not known"."""
    return text.isNull() | (text == "") | F.coalesce(text.try_cast("double") == 0, F.lit(False))


def flatten_generation(payloads: DataFrame) -> DataFrame:
    """A bare list of readings, or an object with the list under ``data``."""
    docs = _parsed(payloads, schemas.GENERATION_PAYLOAD)
    keep = _others(docs)
    entry = F.col("_entry")
    fields = ("settlementDate", "settlementPeriod", "fuelType", "generation", "startTime")
    itself = F.array(F.struct(*[entry[f].alias(f) for f in fields]))
    empty_object = F.coalesce(*[entry[f].cast("string") for f in fields]).isNull()
    rows = (
        # Outer, because Spark guards a plain explode with a filter that parses again.
        docs.select(*keep, "loaded_at", F.explode_outer("_doc").alias("_entry"))
        .filter(entry["data"].isNotNull() | ~empty_object)
        .select(*keep, "loaded_at", F.inline(F.coalesce(entry["data"], itself)))
    )
    return rows.select(
        *keep,
        F.col("settlementDate").alias("settlement_date"),
        F.col("settlementPeriod").alias("settlement_period"),
        F.col("fuelType").alias("fuel_type"),
        "generation",
        "loaded_at",
        F.col("startTime").alias("start_time"),
    )


def flatten_weather(payloads: DataFrame) -> DataFrame:
    """Parallel arrays to one row per hour, as far as the shortest array reaches."""
    docs = _parsed(payloads, schemas.WEATHER_PAYLOAD)
    keep = _others(docs)
    series = [F.col(f"_doc.hourly.{name}") for name in schemas.WEATHER_SERIES]
    # A missing array makes the zipped one NULL, and the payload gives no rows.
    zipped = F.slice(F.arrays_zip(*series), F.lit(1), F.least(*[F.size(s) for s in series]))
    rows = docs.select(*keep, "loaded_at", F.inline(zipped).alias(*schemas.WEATHER_SERIES))
    return rows.select(
        *keep,
        "time",
        "temperature_2m",
        "windspeed_10m",
        "loaded_at",
        "cloudcover",
        "direct_radiation",
        "wind_direction_10m",
        "precipitation",
    )


def flatten_regional(payloads: DataFrame) -> DataFrame:
    """Regions of every snapshot; the forecast stands in for a missing or zero actual."""
    docs = _parsed(payloads, schemas.REGIONAL_PAYLOAD)
    keep = _others(docs)
    actual, forecast = F.col("intensity.actual"), F.col("intensity.forecast")
    return (
        docs.select(*keep, "loaded_at", F.explode("_doc.data").alias("_entry"))
        .select(*keep, "loaded_at", F.inline("_entry.regions"))
        .select(
            *keep,
            "regionid",
            "shortname",
            F.when(~_falsy_number(actual), actual)
            .otherwise(F.coalesce(forecast, F.lit("None")))
            .alias("intensity_actual"),
            F.coalesce("generationmix", F.lit("[]")).alias("generationmix"),
            "loaded_at",
        )
    )


def flatten_prices(payloads: DataFrame, product_code: Column | str) -> DataFrame:
    """Unit rates of one product."""
    code = F.lit(product_code) if isinstance(product_code, str) else product_code
    docs = _parsed(payloads, schemas.PRICES_PAYLOAD)
    keep = _others(docs)
    return docs.select(*keep, "loaded_at", F.inline("_doc.results")).select(
        *keep, "valid_from", "valid_to", "value_inc_vat", code.alias("product_code"), "loaded_at"
    )


def flatten_national(payloads: DataFrame) -> DataFrame:
    """National slots; a missing value and 0 both become empty text."""
    docs = _parsed(payloads, schemas.NATIONAL_PAYLOAD)
    keep = _others(docs)

    def text(name: str) -> Column:
        value = F.col(f"intensity.{name}")
        return F.when(_falsy_number(value), "").otherwise(value)

    return docs.select(*keep, "loaded_at", F.inline("_doc.data")).select(
        *keep,
        F.col("from").alias("from_time"),
        F.col("to").alias("to_time"),
        text("actual").alias("intensity_actual"),
        text("forecast").alias("intensity_forecast"),
        F.coalesce("intensity.index", F.lit("")).alias("intensity_index"),
        "loaded_at",
    )


def latest_product(payloads: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Greatest code among the import, non-prepay products of the tariff family.

    One row (per series); the code is NULL when no product qualifies.
    """
    docs = _parsed(payloads, schemas.PRODUCTS_PAYLOAD)
    eligible = (
        F.col("code").contains(settings.PRODUCT_MARK)
        & (
            F.coalesce("direction", F.lit(settings.PRODUCT_DIRECTION))
            == settings.PRODUCT_DIRECTION
        )
        & ~F.coalesce("is_prepay", F.lit(False))
    )
    return (
        docs.select(*keys, F.inline("_doc.results"))
        .groupBy(*keys)
        .agg(F.max(F.when(eligible, F.col("code"))).alias("product_code"))
    )


def is_unreadable() -> Column:
    """True for a payload text that is no JSON."""
    return F.col("payload").isNotNull() & F.try_parse_json("payload").isNull()


def readability() -> tuple[Column, Column]:
    """Aggregates over payload texts: how many there are, and how many are no JSON."""
    return F.count("payload").alias("n_read"), F.count_if(is_unreadable()).alias("unreadable")


def unreadable(payloads: DataFrame) -> DataFrame:
    """Number of payload texts that are no JSON; they yield no rows above."""
    return payloads.agg(readability()[1])


def within_fetch_window(df: DataFrame, slot: Column, as_of: datetime) -> DataFrame:
    """Slots from 24 hours before ``as_of`` up to 48 hours after it."""
    return df.filter(
        (slot >= at(as_of - settings.LOOKBACK)) & (slot < at(as_of + settings.LOOKAHEAD))
    )


def settlement_dates(as_of: datetime) -> tuple[date, date]:
    """First and last settlement date a fetch at ``as_of`` covers.

    Settlement dates follow local time, which runs an hour ahead of UTC in summer.
    """
    return (as_of - settings.LOOKBACK).date(), (as_of + timedelta(hours=1)).date()


def within_settlement_dates(df: DataFrame, as_of: datetime) -> DataFrame:
    first, last = settlement_dates(as_of)
    return df.filter(F.col("settlement_date").try_cast("date").between(F.lit(first), F.lit(last)))

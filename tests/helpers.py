"""Small frames for tests."""

from datetime import datetime

T0 = datetime(2024, 6, 3, 12, 0)  # a Monday, summer time in London


def ts(text):
    return datetime.fromisoformat(text)


def frame(spark, ddl, *rows):
    """A frame from tuples; ``ts`` columns are zone-less timestamps."""
    return spark.createDataFrame(list(rows), ddl.replace(" ts", " timestamp_ntz"))


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return [tuple(r) for r in picked.collect()]


RAW_GENERATION = (
    "settlement_date string, settlement_period int, fuel_type string, generation string, "
    "loaded_at ts, start_time string"
)
RAW_WEATHER = (
    "time string, temperature_2m string, windspeed_10m string, loaded_at ts, "
    "cloudcover string, direct_radiation string, wind_direction_10m string, "
    "precipitation string"
)
RAW_PRICES = (
    "valid_from string, valid_to string, value_inc_vat double, product_code string, "
    "loaded_at ts"
)
RAW_NATIONAL = (
    "from_time string, to_time string, intensity_actual string, intensity_forecast string, "
    "intensity_index string, loaded_at ts"
)
PRICE_CARBON = (
    "period_utc ts, value_inc_vat double, carbon_intensity double, intensity_index string, "
    "renewable_pct double"
)
STG_GENERATION = "period_utc ts, fuel_type string, generation_mw double"
STG_WEATHER = (
    "hour_utc ts, temp_c double, windspeed_kmh double, cloudcover_pct double, "
    "direct_radiation_wm2 double, wind_direction_deg double, precipitation_mm double"
)

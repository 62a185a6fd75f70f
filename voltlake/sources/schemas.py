"""Shapes of the landed payloads and of the bronze tables.

Numbers inside payloads are read as text: bronze keeps them as they were sent.
"""

from pyspark.sql import types as T

# --- fixed values: field names of the payloads and bronze columns -------------
GENERATION_ROW = (
    "settlementDate string, settlementPeriod int, fuelType string, "
    "generation string, startTime string"
)
# The payload is a bare list of rows or an object with the rows under ``data``;
# one shape covers both because an object parses as a list of one.
GENERATION_PAYLOAD = f"array<struct<data: array<struct<{GENERATION_ROW}>>, {GENERATION_ROW}>>"

WEATHER_SERIES = (
    "time",
    "temperature_2m",
    "windspeed_10m",
    "cloudcover",
    "direct_radiation",
    "wind_direction_10m",
    "precipitation",
)
WEATHER_PAYLOAD = (
    "struct<hourly: struct<"
    + ", ".join(f"{name}: array<string>" for name in WEATHER_SERIES)
    + ">>"
)

REGIONAL_PAYLOAD = (
    "struct<data: array<struct<regions: array<struct<regionid: string, shortname: string, "
    "intensity: struct<actual: string, forecast: string>, generationmix: string>>>>>"
)
PRODUCTS_PAYLOAD = (
    "struct<results: array<struct<code: string, direction: string, is_prepay: boolean>>>"
)
PRICES_PAYLOAD = (
    "struct<results: array<struct<valid_from: string, valid_to: string, "
    "value_inc_vat: double>>>"
)
NATIONAL_PAYLOAD = (
    "struct<data: array<struct<`from`: string, `to`: string, "
    "intensity: struct<actual: string, forecast: string, index: string>>>>"
)

BRONZE = {
    "raw_generation": "settlement_date string, settlement_period int, fuel_type string, "
    "generation string, loaded_at timestamp_ntz, start_time string",
    "raw_weather": "time string, temperature_2m string, windspeed_10m string, "
    "loaded_at timestamp_ntz, cloudcover string, direct_radiation string, "
    "wind_direction_10m string, precipitation string",
    "raw_prices": "valid_from string, valid_to string, value_inc_vat double, "
    "product_code string, loaded_at timestamp_ntz",
    "raw_carbon_national": "from_time string, to_time string, intensity_actual string, "
    "intensity_forecast string, intensity_index string, loaded_at timestamp_ntz",
    "raw_carbon": "regionid string, shortname string, intensity_actual string, "
    "generationmix string, loaded_at timestamp_ntz",
}
REGION_LOOKUP = "regionid int, shortname string, full_name string"
# --- end of fixed values ------------------------------------------------------


def bronze_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(BRONZE[table])

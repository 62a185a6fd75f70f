"""Every registered query beside the SQL that must give the same rows."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltlake import settings
from voltlake.functions.numbers import round_half_away
from voltlake.functions.scoring import amplify_weight
from voltlake.functions.timeparts import at, parse_utc, parse_utc_offset
from voltlake.operators.asof import as_of
from voltlake.operators.latest import newest_per_key
from voltlake.operators.quality import check_tables
from voltlake.operators.ranking import spread_percent_rank
from voltlake.operators.upsert import (
    KeyedTable,
    append_increment,
    load_increment,
    read_table,
)
from voltlake.plans import gold, serve, silver
from voltlake.plans.lake import Lake
from voltlake.session import configure, scratch_path
from voltlake.sinks.files import is_directory
from voltlake.sinks.tables import publish_view, text_times, write_json
from voltlake.sources import landing, payloads as flat
from voltlake.streaming import jobs
from workloads import oracle, views
from workloads.frames import Frames

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

ZONED = ("zone",)
WEIGHT = 0.7
# What the amplifier makes of WEIGHT.
AMPLIFIED = 0.5 + (WEIGHT - 0.5) * settings.WEIGHT_GAIN


def _register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def _both(name: str, plan: Callable[[Frames], DataFrame], sql: Callable[[bool], str]) -> None:
    """Register the single-series form and the one per zone."""
    _register(name, lambda spark, d: plan(Frames(spark, d)), sql(False))
    _register(f"{name}_by_zone", lambda spark, d: plan(Frames(spark, d, ZONED)), sql(True))


def _one(name: str, plan: Callable[[Frames], DataFrame], select: str) -> None:
    _register(name, lambda spark, d: plan(Frames(spark, d)), oracle.statement(select))


def _select(text: str) -> Callable[[bool], str]:
    return lambda keyed: oracle.statement(text, keyed)


# ---- sources ---------------------------------------------------------------

_SLOT = "time_bucket(INTERVAL '30 minutes', ts)"
_ISO = "'%Y-%m-%dT%H:%M:%SZ'"
_ISO_MINUTE = "'%Y-%m-%dT%H:%MZ'"

_one(
    "ingest_generation",
    lambda f: flat.flatten_generation(views.generation_payloads(f.events)),
    f"""SELECT event_id, strftime(ts, '%Y-%m-%d') AS settlement_date,
               (hour(ts) * 2 + (minute(ts) >= 30)::INT + 1)::INTEGER AS settlement_period,
               fuel_type, mw::VARCHAR AS generation, ts AS loaded_at,
               strftime({_SLOT}, {_ISO}) AS start_time
        FROM (SELECT *, upper(event_type) AS fuel_type, round(value * 100)::BIGINT AS mw FROM ev
              UNION ALL SELECT *, 'OTHER', event_id % 1000 - 500 FROM ev)""",
)
_one(
    "ingest_weather",
    lambda f: flat.flatten_weather(views.weather_payloads(f.events)),
    """SELECT event_id,
              strftime(date_trunc('hour', ts) + to_hours(n), '%Y-%m-%dT%H:%M') AS time,
              CASE WHEN (event_id + n) % 17 <> 4
                   THEN (floor(value)::BIGINT % 30 - n)::VARCHAR END AS temperature_2m,
              ((event_id + n) % 45)::VARCHAR AS windspeed_10m, ts AS loaded_at,
              ((event_id + n) % 101)::VARCHAR AS cloudcover,
              ((event_id + n) * 13 % 900)::VARCHAR AS direct_radiation,
              ((event_id + n) * 37 % 360)::VARCHAR AS wind_direction_10m,
              ((event_id + n) % 10)::VARCHAR AS precipitation
       FROM ev, (VALUES (0), (1), (2)) hours_ahead(n)
       WHERE n < 2 OR event_id % 4 <> 0""",
)
_one(
    "ingest_regional",
    lambda f: flat.flatten_regional(views.regional_payloads(f.events)),
    """SELECT event_id, region::VARCHAR AS regionid, 'R' || region AS shortname,
              (CASE WHEN n = 1 AND event_id % 3 = 2 THEN guess + 5 ELSE guess + n END)::VARCHAR
                  AS intensity_actual,
              '[{{"fuel":"' || event_type || '","perc":' || (event_id % 100) || '}}]'
                  AS generationmix,
              ts AS loaded_at
       FROM (SELECT *, user_id % 14 + n AS region, floor(value)::BIGINT + 1 AS guess
             FROM ev, (VALUES (1), (15)) shift(n))""",
)
_PRICE_ROWS = f"""
    SELECT event_id, strftime(start, {_ISO}) AS valid_from,
           strftime(start + INTERVAL '30 minutes', {_ISO}) AS valid_to,
           floor(value * 4) / 4.0 - n AS value_inc_vat, 'AGILE-24' AS product_code,
           ts AS loaded_at
    FROM (SELECT *, {_SLOT} + to_minutes(30 * n) AS start
          FROM ev, (VALUES (0), (1)) shift(n))"""
_one(
    "ingest_prices",
    lambda f: flat.flatten_prices(views.price_payloads(f.events), "AGILE-24"),
    _PRICE_ROWS,
)
_NATIONAL_ROWS = f"""
    SELECT event_id, strftime(start, {_ISO_MINUTE}) AS from_time,
           strftime(start + INTERVAL '30 minutes', {_ISO_MINUTE}) AS to_time,
           CASE WHEN event_id % 5 = 0 OR guess + n = 0 THEN '' ELSE (guess + n)::VARCHAR END
               AS intensity_actual,
           CASE WHEN guess = 0 THEN '' ELSE guess::VARCHAR END AS intensity_forecast,
           CASE WHEN event_id % 7 = 0 THEN '' ELSE 'moderate' END AS intensity_index,
           ts AS loaded_at
    FROM (SELECT *, {_SLOT} + to_minutes(30 * n) AS start, floor(value)::BIGINT AS guess
          FROM ev, (VALUES (0), (1)) shift(n))"""
_one(
    "ingest_national",
    lambda f: flat.flatten_national(views.national_payloads(f.events)),
    _NATIONAL_ROWS,
)


def _in_window(f: Frames) -> DataFrame:
    """National slots and prices the fetch at AS_OF would have asked for."""
    national = flat.within_fetch_window(
        flat.flatten_national(views.national_payloads(f.events)),
        parse_utc_offset(F.col("from_time")),
        views.AS_OF,
    ).select("event_id", F.lit("national").alias("feed"), F.col("from_time").alias("slot"))
    prices = flat.within_fetch_window(
        flat.flatten_prices(views.price_payloads(f.events), "AGILE-24"),
        parse_utc(F.col("valid_from")),
        views.AS_OF,
    ).select("event_id", F.lit("prices").alias("feed"), F.col("valid_from").alias("slot"))
    generation = flat.within_settlement_dates(f.raw("raw_generation"), views.AS_OF).select(
        F.lit(None).cast("long").alias("event_id"),
        F.lit("generation").alias("feed"),
        F.col("settlement_date").alias("slot"),
    )
    return national.unionByName(prices).unionByName(generation)


_WINDOW = (
    f"BETWEEN {oracle.AS_OF} - INTERVAL '24 hours'"
    f" AND {oracle.AS_OF} + INTERVAL '48 hours' - INTERVAL '1 microsecond'"
)
_one(
    "ingest_window",
    _in_window,
    f"""SELECT event_id, 'national' AS feed, from_time AS slot FROM ({_NATIONAL_ROWS})
        WHERE replace(from_time, 'Z', ':00')::TIMESTAMP {_WINDOW}
        UNION ALL SELECT event_id, 'prices', valid_from FROM ({_PRICE_ROWS})
        WHERE timezone('UTC', valid_from::TIMESTAMPTZ) {_WINDOW}
        UNION ALL SELECT NULL, 'generation', settlement_date FROM raw_generation
        WHERE settlement_date IN ('2024-01-14', '2024-01-15')""",
)

_PRODUCT = """
    SELECT {k}max(CASE WHEN event_type = 'signup' THEN 'AGILE-' || strftime(ts, '%y-%m-%d')
                       WHEN event_type = 'error' THEN 'AGILE-' || strftime(ts, '%y-%m-%d')
                  END) AS product_code
    FROM ev {group}"""
_both(
    "latest_product",
    lambda f: flat.latest_product(views.product_payloads(f.events), f.keys),
    _select(_PRODUCT),
)


def _landed(frames: Frames) -> dict[str, str]:
    """Payload texts of every feed, one per line, in a fresh landing folder."""
    root = scratch_path(frames.spark, "landed")
    feeds = {
        "generation": views.generation_payloads,
        "weather": views.weather_payloads,
        "carbon": views.regional_payloads,
        "products": views.product_payloads,
        "prices": views.price_payloads,
        "carbon_national": views.national_payloads,
    }
    payloads = {name: make(frames.events).select("payload") for name, make in feeds.items()}
    with ThreadPoolExecutor(landing.CONCURRENT_LOADS) as pool:  # feeds land independently
        list(pool.map(lambda name: payloads[name].write.text(f"{root}/{name}"), payloads))
    return {name: f"{root}/{name}" for name in feeds}


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all feeds from landed files; one of them is missing on purpose."""
    frames = Frames(spark, sf_dir)
    landed = _landed(frames)
    bronze = scratch_path(spark, "bronze")

    def read(path: str) -> DataFrame:
        return landing.read_payloads(spark, path, views.AS_OF)

    flatten = {
        "generation": flat.flatten_generation,
        "weather": flat.flatten_weather,
        "carbon": flat.flatten_regional,
        "carbon_national": flat.flatten_national,
    }
    sources = [
        landing.Source(
            name,
            lambda name=name: read(landed[name]),
            how,
            f"{bronze}/{name}",
        )
        for name, how in flatten.items()
    ]
    sources.append(
        landing.priced_source(
            "prices",
            lambda: read(landed["prices"]),
            lambda: read(landed["products"]),
            f"{bronze}/prices",
        )
    )
    no_products = landing.priced_source(
        "unpriced",
        lambda: read(landed["prices"]),
        lambda: read(landed["products"]).filter("false"),
        f"{bronze}/unpriced",
    )
    garbage = frames.events.select(
        F.concat(F.lit("<html>"), F.col("event_id").cast("string")).alias("payload"),
        at(views.AS_OF).alias("loaded_at"),
    )
    sources += [
        no_products,
        landing.Source("garbage", lambda: garbage, flat.flatten_national, f"{bronze}/garbage"),
        landing.Source(
            "partly_garbage",
            lambda: garbage.filter("event_id % 3 = 0").unionByName(read(landed["carbon_national"])),
            flat.flatten_national,
            f"{bronze}/partly",
        ),
    ]
    broken = landing.Source(
        "unreachable", lambda: read(f"{bronze}/none"), flat.flatten_weather, f"{bronze}/none"
    )
    audit = landing.load_sources(spark, [*sources, broken])
    # The text of a missing path names this run's folder.
    path = F.col("source") == "unreachable"
    return audit.withColumn("status", F.when(path, F.left("status", F.lit(5))).otherwise(F.col("status")))


_register(
    "ingest_audit",
    _audit,
    """WITH n AS (SELECT count(*) AS c, count(*) FILTER (event_id % 4 = 0) AS short FROM events),
            counts AS (
                SELECT 'generation' AS source, 2 * c AS n_rows, 'rows' AS unit FROM n
                UNION ALL SELECT 'weather', 3 * c - short, 'rows' FROM n
                UNION ALL SELECT 'carbon', 2 * c, 'rows' FROM n
                UNION ALL SELECT 'prices', 2 * c, 'rates (' || (
                    SELECT max('AGILE-' || strftime(ts, '%y-%m-%d')) FROM events
                    WHERE event_type IN ('signup', 'error')) || ')' FROM n
                UNION ALL SELECT 'carbon_national', 2 * c, 'rows' FROM n)
       SELECT source, 'OK — ' || n_rows || ' ' || unit AS status, n_rows FROM counts
       UNION ALL SELECT 'unreachable', 'ERROR', NULL
       UNION ALL SELECT 'unpriced', 'ERROR — no eligible product found', NULL
       UNION ALL SELECT 'garbage', 'ERROR — none of ' || c || ' payloads is JSON', NULL FROM n
       UNION ALL SELECT 'partly_garbage', 'OK — ' || 2 * c || ' rows, ' || bad || ' of ' || (c + bad)
                        || ' payloads are no JSON', 2 * c
                 FROM n, (SELECT count(*) FILTER (event_id % 3 = 0) AS bad FROM events)""",
)


def _evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written before and after columns were added, read as one table."""
    frames = Frames(spark, sf_dir)
    raw = frames.raw("raw_generation")
    path = scratch_path(spark, "evolving")
    early = F.col("loaded_at") <= at(views.AS_OF)
    landing.append_bronze(raw.filter(early).drop("start_time"), path)
    landing.append_bronze(landing.conform(raw.filter(~early), "raw_generation"), path)
    return landing.read_bronze(spark, path, "raw_generation").drop(landing.LOAD_DATE)


def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region names written as CSV with a header and read back as a seed."""
    path = scratch_path(spark, "seed")
    Frames(spark, sf_dir).lookup.write.csv(path, header=True)
    return landing.region_lookup(spark, path)


_register(
    "region_seed",
    _seed,
    """SELECT n_nationkey::INTEGER AS regionid, n_name AS shortname, n_name AS full_name
       FROM nation""",
)


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest national slots behind a session view, asked with SQL."""
    publish_view(Frames(spark, sf_dir).national, "stg_carbon_national_view")
    return spark.sql(
        "SELECT intensity_index, count(*) AS n_slots, max(intensity_best) AS highest "
        "FROM stg_carbon_national_view GROUP BY intensity_index"
    )


_register(
    "silver_view",
    _view,
    oracle.statement(
        """SELECT intensity_index, count(*) AS n_slots, max(intensity_best) AS highest
           FROM stg_carbon_national GROUP BY intensity_index"""
    ),
)


_register(
    "schema_evolve",
    _evolved,
    oracle.statement(
        f"""SELECT settlement_date, settlement_period::INTEGER AS settlement_period, fuel_type,
                   generation, loaded_at,
                   CASE WHEN loaded_at > {oracle.AS_OF} THEN start_time END AS start_time
            FROM raw_generation"""
    ),
)

# ---- silver ----------------------------------------------------------------

_both("stg_generation", lambda f: f.generation, _select("SELECT * FROM stg_generation"))
_both("stg_weather", lambda f: f.weather, _select("SELECT * FROM stg_weather"))
_both("stg_prices", lambda f: f.prices, _select("SELECT * FROM stg_prices"))
_both(
    "stg_carbon_national", lambda f: f.national, _select("SELECT * FROM stg_carbon_national")
)
_both("stg_carbon", lambda f: f.regional_snapshots, _select("SELECT * FROM stg_carbon"))
_one(
    "dedupe_latest",
    lambda f: newest_per_key(
        f.events.select("user_id", "event_type", "ts", "value"), ["user_id", "event_type"], "ts"
    ),
    """SELECT user_id, event_type, max(ts) AS ts, arg_max(value, ts) AS value
       FROM events GROUP BY ALL""",
)


def _as_of_by_user(f: Frames) -> DataFrame:
    """Every click with what its user had last viewed by then."""
    events = f.events.select("event_id", "user_id", "ts", "value", "event_type")
    return as_of(
        events.filter("event_type = 'click'").drop("event_type"),
        events.filter("event_type = 'view'"),
        keys=("user_id",),
        moment="ts",
        at="ts",
        take={"viewed_at": "ts", "viewed_event": "event_id", "viewed_value": "value"},
    )


_one(
    "as_of_by_user",
    _as_of_by_user,
    """SELECT c.event_id, c.user_id, c.ts, c.value, v.ts AS viewed_at, v.event_id AS viewed_event,
              v.value AS viewed_value
       FROM (SELECT * FROM events WHERE event_type = 'click') c
       ASOF LEFT JOIN (
         SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value
         FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v
       ON c.user_id = v.user_id AND c.ts >= v.ts""",
)


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bronze table loaded twice, half of it known the first time."""
    frames = Frames(spark, sf_dir)
    raw = frames.raw("raw_generation")
    table = KeyedTable(
        scratch_path(spark, "stg_generation"), ("settlement_key",), "settlement_date"
    )
    for known in (raw.filter(F.col("loaded_at") <= at(views.AS_OF)), raw):
        load_increment(spark, table, known, silver.stg_generation)
    return read_table(spark, table)


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regional snapshots loaded twice; a first load that died left rows behind."""
    frames = Frames(spark, sf_dir)
    raw = frames.raw("raw_carbon")
    path = scratch_path(spark, "stg_carbon")
    table = KeyedTable(path, ("carbon_key",), "loaded_at")

    def clean(rows: DataFrame) -> DataFrame:
        return silver.stg_carbon(rows, frames.lookup)

    dead = clean(raw.filter(F.col("loaded_at") > at(views.AS_OF)))
    dead.withColumn("part_date", table.part_of()).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).partitionBy("part_date").parquet(path)
    for known in (raw.filter(F.col("loaded_at") <= at(views.AS_OF)), raw):
        append_increment(spark, table, known, clean)
    return read_table(spark, table)


_register("incremental_history", _history, oracle.statement("SELECT * FROM stg_carbon"))
_register(
    "incremental_upsert", _incremental, oracle.statement("SELECT * FROM stg_generation")
)
_both("dq_checks", lambda f: _checked(f), oracle.checks)


def _checked(f: Frames) -> DataFrame:
    return check_tables(
        {
            "stg_generation": f.generation,
            "stg_weather": f.weather,
            "stg_prices": f.prices,
            "stg_carbon_national": f.national,
            "stg_carbon": f.regional_snapshots,
            "mart_temp_vs_demand": f.temp_vs_demand,
            "mart_renewable_mix": f.renewable_mix,
            "mart_carbon_heatmap": f.carbon_heatmap,
        },
        keys=f.keys,
    )


# ---- gold ------------------------------------------------------------------


def _steady(df: DataFrame) -> DataFrame:
    """Rolling mean at six decimals: engines add the 168 doubles in different orders."""
    mean = round_half_away(F.col("renewable_pct_7d_avg"), 6)
    return df.withColumn("renewable_pct_7d_avg", mean)


_both("price_carbon", lambda f: f.price_carbon, _select("SELECT * FROM price_carbon"))
_both("best_windows", lambda f: f.best_windows, _select("SELECT * FROM best_windows"))
_both(
    "best_windows_all",
    lambda f: gold.best_windows_all(f.price_carbon, f.keys),
    _select(oracle.BEST_WINDOWS_ALL),
)
_both("carbon_heatmap", lambda f: f.carbon_heatmap, _select("SELECT * FROM carbon_heatmap"))
_both("price_heatmap", lambda f: f.price_heatmap, _select("SELECT * FROM price_heatmap"))
_both("fuel_mix_hourly", lambda f: f.fuel_mix, _select("SELECT * FROM fuel_mix"))
_both("renewable_mix", lambda f: _steady(f.renewable_mix), _select(oracle.RENEWABLE_MIX))
_both("temp_vs_demand", lambda f: f.temp_vs_demand, _select("SELECT * FROM temp_vs_demand"))
_both("grid_stress", lambda f: f.grid_stress, _select("SELECT * FROM grid_stress"))
_both("regional_latest", lambda f: f.regional_latest, _select("SELECT * FROM regional_latest"))
_both("weather_indices", lambda f: f.solar_weather, _select("SELECT * FROM weather_indices"))

# ---- read queries ----------------------------------------------------------

_both(
    "now_summary",
    lambda f: serve.now_summary(
        f.price_carbon_newest(1, views.AS_OF), f.renewable_mix, f.best_windows, views.AS_OF, f.keys
    ),
    oracle.now_summary,
)
_both(
    "appliance_windows",
    lambda f: serve.appliance_windows(f.price_carbon_ahead, views.AS_OF, 2.0, WEIGHT, f.keys),
    lambda keyed: oracle.appliance_windows(4, AMPLIFIED, keyed),
)
_register(
    "appliance_windows_long",
    lambda spark, d: serve.appliance_windows(
        Frames(spark, d).price_carbon_ahead, views.AS_OF, 3.5
    ),
    oracle.appliance_windows(7, 0.5),
)
_both(
    "windows_by_day",
    lambda f: serve.windows_by_day(f.price_carbon_ahead, views.AS_OF, WEIGHT, f.keys),
    lambda keyed: oracle.windows_by_day(AMPLIFIED, keyed),
)
_both(
    "best_windows_top5",
    lambda f: serve.best_windows_top(f.best_windows, 5, f.keys),
    _select(
        """SELECT * REPLACE (period_utc::VARCHAR AS period_utc, period_to::VARCHAR AS period_to)
           FROM best_windows WHERE rank <= 5"""
    ),
)
_both(
    "prices_carbon_recent",
    lambda f: serve.prices_carbon_recent(f.price_carbon_newest(200), 200, f.keys),
    _select(
        """SELECT {k}period_utc::VARCHAR AS period_utc, round(value_inc_vat, 2) AS price_p_kwh,
                  round(carbon_intensity, 0) AS carbon_intensity, intensity_index,
                  round(renewable_pct, 1) AS renewable_pct
           FROM (SELECT * FROM price_carbon QUALIFY
                 row_number() OVER ({part} ORDER BY price_carbon.period_utc DESC) <= 200)"""
    ),
)
_both(
    "combined_heatmap",
    lambda f: serve.combined_heatmap(f.price_heatmap, f.carbon_heatmap, f.keys),
    _select(oracle.COMBINED_HEATMAP),
)
_CELLS = ", ".join(
    f"coalesce(max(generation_mw) FILTER (fuel_type = '{fuel}'), 0) AS \"{fuel}\""
    for fuel in views.FUEL_COLUMNS
)
_both(
    "fuel_mix_pivot",
    lambda f: serve.fuel_mix_pivot(f.fuel_mix, views.FUEL_COLUMNS, 960, f.keys),
    _select(
        f"""SELECT {{k}}strftime(hour_utc, '%Y-%m-%d %H') AS hour_label, {_CELLS}
            FROM (SELECT * FROM fuel_mix QUALIFY row_number() OVER (
                      {{part}} ORDER BY hour_utc DESC, fuel_type DESC) <= 960)
            GROUP BY ALL"""
    ),
)
_both(
    "renewable_weather",
    lambda f: _steady(serve.renewable_weather(f.renewable_mix, f.solar_weather, 720, f.keys)),
    _select(
        """SELECT {k}hour_utc::VARCHAR AS hour_utc, renewable_pct,
                  round(renewable_pct_7d_avg, 6) AS renewable_pct_7d_avg, windspeed_kmh
           FROM (SELECT * FROM renewable_mix
                 LEFT JOIN (SELECT {k}hour_utc, windspeed_kmh FROM weather_indices)
                 USING ({k}hour_utc)
                 QUALIFY row_number() OVER ({part} ORDER BY hour_utc DESC) <= 720)"""
    ),
)
_one(
    "regional_carbon",
    lambda f: serve.regional_carbon(f.regional_latest),
    "SELECT shortname, full_name, intensity_actual, intensity_band FROM regional_latest",
)
_both(
    "grid_stress_recent",
    lambda f: serve.grid_stress_recent(f.grid_stress, 168, f.keys),
    _select(
        """SELECT {k}hour_utc::VARCHAR AS hour_utc, total_mw, renewable_pct, temp_c,
                  windspeed_kmh, is_stress_hour, temp_band, day_type
           FROM (SELECT * FROM grid_stress QUALIFY
                 row_number() OVER ({part} ORDER BY grid_stress.hour_utc DESC) <= 168)"""
    ),
)
_both(
    "demand_profile",
    lambda f: serve.demand_profile(f.temp_vs_demand, f.keys),
    _select(oracle.DEMAND_PROFILE),
)
_both(
    "kpi_summary",
    lambda f: serve.kpi_summary(
        f.renewable_mix,
        f.temp_vs_demand,
        f.regional_latest,
        f.grid_stress,
        f.price_carbon_newest(1, views.AS_OF),
        views.AS_OF,
        f.keys,
    ),
    oracle.kpi_summary,
)


def _regression(f: Frames) -> DataFrame:
    return _rounded_fit(serve.temp_regression(f.temp_vs_demand, f.keys))


def _rounded_fit(fit: DataFrame) -> DataFrame:
    return fit.withColumns(
        {
            "mw_per_degree_c": round_half_away(F.col("mw_per_degree_c"), 4),
            "r_squared": round_half_away(F.col("r_squared"), 6),
        }
    )


_both("temp_regression", _regression, _select(oracle.REGRESSION))

# ---- scoring blocks --------------------------------------------------------

_one(
    "amplify_weight",
    lambda f: f.events.select(
        "event_id",
        round_half_away(amplify_weight(F.col("value") / 100 - 0.25), 9).alias("weight"),
    ),
    """SELECT event_id, round(0.5 + sign(d) * least(0.5, 1.8 * abs(d)), 9) AS weight
       FROM (SELECT event_id, least(1, greatest(0, value / 100 - 0.25)) - 0.5 AS d FROM ev)""",
)


def _ranked(spark: SparkSession, sf_dir: str, value: str = "value", keys=()) -> DataFrame:
    events = Frames(spark, sf_dir).events
    events = events.withColumns({"day": F.to_date("ts"), "kind": F.col("event_type")})
    events = events.select("event_id", "zone", F.col(value).alias("value"))
    return spread_percent_rank(events, "value", "value_rank", keys)


def _rank_sql(value: str) -> str:
    return (
        f"SELECT event_id, zone, {value} AS value, "
        f"percent_rank() OVER ({{part}} ORDER BY {value} NULLS LAST) AS value_rank FROM ev"
    )


_register("percent_rank_global", _ranked, oracle.statement(_rank_sql("value")))
_register(
    "percent_rank_ranges",
    lambda spark, d: _ranked(spark, d, "event_id"),
    oracle.statement(_rank_sql("event_id")),
)
_register(
    "percent_rank_ranges_by_zone",
    lambda spark, d: _ranked(spark, d, keys=ZONED),
    oracle.statement(_rank_sql("value"), keyed=True),
)
_register(
    "percent_rank_date", lambda spark, d: _ranked(spark, d, "day"), oracle.statement(_rank_sql("ts::DATE"))
)
_register(
    "percent_rank_text",
    lambda spark, d: _ranked(spark, d, "kind", ZONED),
    oracle.statement(_rank_sql("event_type"), keyed=True),
)

# ---- sinks and the whole build ---------------------------------------------


def _build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every table, loading silver in two increments; rows of each, and its measure
    summed in quarters. The ``stored_`` queries compare whole rows."""
    frames = Frames(spark, sf_dir)
    lake = Lake(spark, scratch_path(spark, "lake"))
    early = F.col("loaded_at") <= at(views.AS_OF)
    bronze = {name: frames.raw(name) for name in views.RAW}
    for known in ({n: df.filter(early) for n, df in bronze.items()}, bronze):
        lake.load_silver(known, frames.lookup)
    stored = lake.build_gold(views.AS_OF)
    tables = {n: lake.silver_frame(n) for n in lake.silver_names} | stored
    counted = [
        df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.floor(F.col(_MEASURES[n]) * 4)).cast("bigint").alias("quarters"),
        ).select(F.lit(n).alias("table_name"), "n_rows", "quarters")
        for n, df in tables.items()
        if n in _STORED
    ]
    return reduce(DataFrame.unionByName, counted)


_STORED = {
    **{n: n for n in ("stg_generation", "stg_weather", "stg_prices")},
    **{n: n for n in ("stg_carbon_national", "stg_carbon")},
    **{
        f"mart_{n}": n
        for n in (
            "price_carbon",
            "best_windows",
            "carbon_heatmap",
            "price_heatmap",
            "fuel_mix",
            "renewable_mix",
            "temp_vs_demand",
            "grid_stress",
        )
    },
    "mart_regional_carbon": "regional_latest",
    "mart_solar_weather": "weather_indices",
}
_MEASURES = {
    "stg_generation": "generation_mw",
    "stg_weather": "temp_c",
    "stg_prices": "value_inc_vat",
    "stg_carbon_national": "intensity_best",
    "stg_carbon": "intensity_actual",
    "mart_price_carbon": "total_mw",
    "mart_best_windows": "window_score",
    "mart_carbon_heatmap": "avg_intensity_gco2kwh",
    "mart_price_heatmap": "avg_price_p_kwh",
    "mart_fuel_mix": "generation_mw",
    "mart_renewable_mix": "renewable_pct",
    "mart_temp_vs_demand": "total_demand_mw",
    "mart_grid_stress": "total_mw",
    "mart_regional_carbon": "intensity_actual",
    "mart_solar_weather": "windspeed_kmh",
}
_register(
    "lake_build",
    _build,
    oracle.statement(
        " UNION ALL ".join(
            f"SELECT '{stored}' AS table_name, count(*) AS n_rows, "
            f"sum(floor({_MEASURES[stored]} * 4))::BIGINT AS quarters FROM {name}"
            for stored, name in _STORED.items()
        )
    ),
)


_LAKES: dict[tuple[str, str], Lake] = {}


def _followed(spark: SparkSession, sf_dir: str) -> Lake:
    """A lake whose marts followed three loads, late revisions among them.

    One a session and folder; the queries below ask it for different tables.
    """
    frames = Frames(spark, sf_dir)
    place = spark.sparkContext.applicationId, sf_dir
    if place not in _LAKES or not is_directory(spark, _LAKES[place].root):
        lake = Lake(spark, scratch_path(spark, "followed"))
        bronze = {name: frames.raw(name) for name in views.RAW}
        for until in (views.AS_OF - timedelta(days=3), views.AS_OF, None):
            known = F.lit(True) if until is None else F.col("loaded_at") <= at(until)
            lake.load_silver({n: df.filter(known) for n, df in bronze.items()}, frames.lookup)
            lake.build_gold(until or views.AS_OF)
            lake.check_changes()
        _LAKES[place] = lake
    return _LAKES[place]


def _stored(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _followed(spark, sf_dir).table(name)
        return _steady(rows) if name == "mart_renewable_mix" else rows

    return query


for _table, _view in _STORED.items():
    if _view not in ("carbon_heatmap", "price_heatmap"):
        _sql = oracle.RENEWABLE_MIX if _view == "renewable_mix" else f"SELECT * FROM {_view}"
        _register(f"stored_{_view}", _stored(_table), oracle.statement(_sql))
for _name, _ask, _sql in (
    ("carbon_heatmap", lambda lake: lake.marts()["mart_carbon_heatmap"], "SELECT * FROM carbon_heatmap"),
    ("price_heatmap", lambda lake: lake.marts()["mart_price_heatmap"], "SELECT * FROM price_heatmap"),
    ("demand_profile", lambda lake: lake.demand_profile(), oracle.DEMAND_PROFILE),
):
    _register(
        f"{_name}_incremental",
        lambda spark, d, ask=_ask: ask(_followed(spark, d)),
        oracle.statement(_sql),
    )
_register(
    "dq_checks_incremental",
    lambda spark, d: _followed(spark, d).check_changes(),
    oracle.checks(),
)
_register(
    "temp_regression_incremental",
    lambda spark, d: _rounded_fit(_followed(spark, d).temp_regression()),
    oracle.statement(oracle.REGRESSION),
)


def _json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and carbon slots written as JSON rows and read back."""
    rows = Frames(spark, sf_dir).price_carbon
    path = scratch_path(spark, "json")
    write_json(rows, path)
    return spark.read.schema(text_times(rows).schema).json(path)


_register(
    "json_rows",
    _json_rows,
    oracle.statement(
        "SELECT * REPLACE (period_utc::VARCHAR AS period_utc) FROM price_carbon"
    ),
)

# ---- streaming -------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(views.table(spark, sf_dir, "events").schema)
    if is_directory(spark, path):
        stream = reader.parquet(path)
    else:  # streams read folders, so a single file is picked out of its folder
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return views.with_zone(stream)


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files taken by a stream; a second run finds nothing new."""
    frames = Frames(spark, sf_dir)
    landed = _landed(frames)["generation"]
    bronze = scratch_path(spark, "bronze-stream")
    checkpoint = scratch_path(spark, "checkpoint")
    for _ in range(2):
        rows = landing.dated(flat.flatten_generation(jobs.stream_payloads(spark, landed)))
        by_day = (landing.LOAD_DATE,)
        jobs.append_stream(rows, bronze, checkpoint, by_day).awaitTermination()
    return landing.read_bronze(spark, bronze, "raw_generation").drop(
        "loaded_at", landing.LOAD_DATE
    )


_register(
    "stream_ingest",
    _stream_ingest,
    ORACLE["ingest_generation"]
    .replace("SELECT event_id, strftime", "SELECT strftime", 1)
    .replace(" ts AS loaded_at,", "", 1),
)


def _stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream noted over two runs, with broken payloads in the first; the second run
    finds nothing new. Rows and quarantine are counted from what was stored."""
    frames = Frames(spark, sf_dir)
    landed = _landed(frames)["generation"]
    broken = frames.events.filter("event_id % 10 = 0").select(F.format_string('{"data": [%d', "event_id"))
    broken.write.mode("append").text(landed)
    target, audit, aside, checkpoint = (scratch_path(spark, f"audited-{n}") for n in ("rows", "audit", "bad", "cp"))
    for _ in range(2):
        stream = jobs.stream_payloads(spark, landed, files_per_batch=4, loaded_at=views.AS_OF)
        query = jobs.ingest_audited(
            stream, "generation", flat.flatten_generation, target,
            audit=audit, quarantine=aside, checkpoint=checkpoint,
        )
        query.awaitTermination()
    total = jobs.read_audit(spark, audit).groupBy("source", "status").agg(
        *(F.sum(c).alias(c) for c in ("n_read", "unreadable", "n_rows"))
    )
    stored = landing.read_bronze(spark, target, "raw_generation")
    stored = stored.agg(F.count("*").alias("n_stored"), F.count_if(F.col("loaded_at") == at(views.AS_OF)).alias("stamped"))
    kept = jobs.quarantined(spark, aside).agg(F.count("*").alias("n_aside"))
    return total.join(stored).join(kept)  # one row each


_register(
    "stream_audit",
    _stream_audit,
    f"""WITH r AS (SELECT count(*) AS n FROM ({ORACLE["ingest_generation"]})),
        e AS (SELECT count(*) AS n, count(*) FILTER (event_id % 10 = 0) AS bad FROM events)
        SELECT 'generation' AS source, 'OK' AS status, e.n + bad AS n_read, bad AS unreadable,
               r.n AS n_rows, r.n AS n_stored, r.n AS stamped, bad AS n_aside FROM r, e""",
)


def _stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.raw_generation(_event_stream(spark, sf_dir))
    table = KeyedTable(
        scratch_path(spark, "stream_generation"), ("settlement_key",), "settlement_date"
    )
    checkpoint = scratch_path(spark, "checkpoint")
    jobs.upsert_stream(raw, silver.stg_generation, table, checkpoint).awaitTermination()
    return read_table(spark, table)


_register("stream_upsert", _stream_upsert, oracle.statement("SELECT * FROM stg_generation"))


def _stream_fuel_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = views.raw_generation(_event_stream(spark, sf_dir)).select(
        F.col("loaded_at").alias("period_utc"),
        F.upper(F.trim("fuel_type")).alias("fuel_type"),
        F.col("generation").cast("double").alias("generation_mw"),
    )
    means = jobs.hourly_fuel_means(readings, late_by=timedelta(hours=1))
    target = scratch_path(spark, "fuel-stream")
    jobs.append_stream(means, target, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(means.schema).parquet(target)


_register(
    "stream_fuel_mix",
    _stream_fuel_mix,
    oracle.statement(
        """SELECT hour_utc, fuel_type, avg(mw) AS generation_mw
           FROM (SELECT date_trunc('hour', loaded_at) AS hour_utc,
                        upper(trim(fuel_type)) AS fuel_type, generation::DOUBLE AS mw,
                        max(loaded_at) OVER () - INTERVAL '1 hour' AS closed_before
                 FROM raw_generation)
           WHERE hour_utc + INTERVAL '1 hour' <= closed_before
           GROUP BY ALL"""
    ),
)


def _stream_newest_mix(f: Frames) -> DataFrame:
    """Hourly means of newest revisions, in two runs of one stream."""
    raw = views.raw_generation(_event_stream(f.spark, f.sf_dir), f.keys)
    means = jobs.hourly_newest_means(silver.typed_generation(raw, f.keys), f.keys, timedelta(hours=6))
    target, checkpoint = scratch_path(f.spark, "newest-mix"), scratch_path(f.spark, "checkpoint")
    for _ in range(2):
        jobs.append_stream(means, target, checkpoint).awaitTermination()
    return f.spark.read.schema(means.schema).parquet(target)


_both(
    "stream_newest_mix",
    _stream_newest_mix,
    _select(
        """SELECT {k}hour_utc, fuel_type, avg(generation_mw) AS generation_mw
           FROM (SELECT *, date_trunc('hour', period_utc) AS hour_utc,
                        max(period_utc) OVER () - INTERVAL '6 hours' AS closed_before
                 FROM stg_generation)
           WHERE hour_utc + INTERVAL '1 hour' <= closed_before
           GROUP BY ALL"""
    ),
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best half hours of the next two days."""
    return QUERIES["best_windows_top5"](spark, sf_dir)

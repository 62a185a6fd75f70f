"""Silver to gold: the marts.

All aggregations combine on the map side before they shuffle, so one series, fuel or
slot holding much of the data costs one partial row per task. Windows only run over
frames with a bound that does not depend on the volume of readings: the slots of a
48-hour horizon, or one row per hour.
"""

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voltlake import settings
from voltlake.functions.numbers import banded, round_half_away, safe_ratio
from voltlake.functions.scoring import recommendation
from voltlake.functions.timeparts import (
    at,
    day_type,
    hour_of,
    local_time,
    plus,
    weekday_name,
    weekday_number,
)
from voltlake.operators.latest import attach, top_n
from voltlake.operators.ranking import percent_rank, spread_percent_rank, spread_row_number
from voltlake.operators.runs import trailing_mean
from voltlake.session import settle
from voltlake.sinks.snapshots import dated


def slot_totals(
    generation: DataFrame,
    keys: Sequence[str] = (),
    renewable_fuels: Sequence[str] = settings.RENEWABLE_FUELS,
) -> DataFrame:
    """Per slot: output without exports, renewable output, and the plain sum (demand).

    Four marts start from these totals; a build stores them once, so the readings
    themselves are scanned once for all of them.
    """
    mw = F.col("generation_mw")
    renewable = F.when(F.col("fuel_type").isin(*renewable_fuels), mw).otherwise(0.0)
    return generation.groupBy(*keys, "period_utc").agg(
        F.sum(F.greatest(mw, F.lit(0.0))).alias("total_mw"),
        F.sum(renewable).alias("renewable_mw"),
        F.sum(mw).alias("demand_mw"),
    )


def hourly_totals(totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over the hour's slots of each slot total."""
    return totals.groupBy(*keys, hour_of(F.col("period_utc")).alias("hour_utc")).agg(
        *[F.avg(c).alias(c) for c in ("total_mw", "renewable_mw", "demand_mw")]
    )


def mart_price_carbon(
    prices: DataFrame,
    carbon: DataFrame,
    totals: DataFrame,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per slot known to either feed; generation only where there is a price.

    The inputs are one row per slot by construction, so the joins cannot multiply rows,
    and all three are already partitioned by slot when they come from the silver plans.
    """
    slot = [*keys, "period_utc"]
    priced = prices.select(
        *keys, F.col("valid_from").alias("period_utc"), "value_inc_vat"
    ).join(totals.drop("demand_mw"), slot, "left")
    clean = carbon.select(
        *keys,
        F.col("period_from").alias("period_utc"),
        F.col("intensity_best").alias("carbon_intensity"),
        "intensity_index",
    )
    share = safe_ratio(F.col("renewable_mw"), F.col("total_mw")) * 100
    return priced.join(clean, slot, "full_outer").select(
        *slot,
        "value_inc_vat",
        "carbon_intensity",
        "intensity_index",
        "total_mw",
        round_half_away(share, 1).alias("renewable_pct"),
        F.hour("period_utc").alias("hour_of_day"),
        weekday_number(F.col("period_utc")).alias("day_of_week"),
    )


def price_carbon_newest(
    prices: DataFrame,
    carbon: DataFrame,
    totals: DataFrame,
    n: int,
    keys: Sequence[str] = (),
    until: datetime | None = None,
) -> DataFrame:
    """The newest ``n`` slots of ``mart_price_carbon`` (a series), none after ``until``.

    Each side's newest ``n`` slots are taken before the join: a slot that is not among
    them on one side has ``n`` newer ones there, so it is not among the joined newest
    either. Totals are looked up for those slots alone. History is never joined.
    """

    def newest(side: DataFrame, slot: str) -> DataFrame:
        known = side.filter(F.col(slot).isNotNull())
        if until is not None:
            known = known.filter(F.col(slot) <= at(until))
        return top_n(known, [F.col(slot).desc()], n, keys)

    prices = newest(prices, "valid_from")
    # At most n rows a series; without keys small enough to go to every task.
    slots = prices.select(*keys, F.col("valid_from").alias("period_utc"))
    slots = slots if keys else F.broadcast(slots)
    totals = totals.join(slots, [*keys, "period_utc"], "left_semi")
    joined = mart_price_carbon(prices, newest(carbon, "period_from"), totals, keys)
    return top_n(joined, [F.col("period_utc").desc()], n, keys)


def price_carbon_ahead(
    prices: DataFrame,
    carbon: DataFrame,
    totals: DataFrame,
    as_of: datetime,
    keys: Sequence[str] = (),
) -> DataFrame:
    """``mart_price_carbon`` for the running slot and the 48 hours after it.

    Enough for every question about coming slots. Cutting each input first matters: a
    filter on the joined slot, which may come from either side, is not pushed below the
    outer join, while these reach the scans.
    """
    first, last = at(as_of - settings.SLOT), at(as_of + settings.BEST_WINDOW_HORIZON)
    return mart_price_carbon(
        prices.filter(F.col("valid_from").between(first, last)),
        carbon.filter(F.col("period_from").between(first, last)),
        totals.filter(F.col("period_utc").between(first, last)),
        keys,
    )


def mart_best_windows(
    price_carbon: DataFrame, as_of: datetime, keys: Sequence[str] = ()
) -> DataFrame:
    """Slots of the next 48 hours, ranked by price and carbon taken equally.

    The slot that is running at ``as_of`` is included. At most 97 slots per series
    remain after the filter, which is what the ranking windows run over.
    """
    slot = F.col("period_utc")
    ahead = _priced(price_carbon).filter(
        (slot > at(as_of - settings.SLOT)) & (slot <= at(as_of + settings.BEST_WINDOW_HORIZON))
    )
    both = percent_rank("value_inc_vat", keys) + percent_rank("carbon_intensity", keys)
    order = W.partitionBy(*keys).orderBy("_ranks", "period_utc")
    ranked = ahead.withColumn("_ranks", both)
    return _windows(ranked.withColumn("rank", F.row_number().over(order).cast("long")), keys)


def best_windows_all(price_carbon: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``mart_best_windows`` over any horizon, such as all slots there are.

    Percent ranks and row numbers are spread, so no series is sorted in one task.
    """
    known = settle(_priced(price_carbon), "priced")
    ranked = spread_percent_rank(known, "value_inc_vat", "_by_price", keys)
    ranked = spread_percent_rank(ranked, "carbon_intensity", "_by_carbon", keys)
    ranked = ranked.withColumn("_ranks", F.col("_by_price") + F.col("_by_carbon"))
    return _windows(spread_row_number(ranked, ("_ranks", "period_utc"), "rank", keys), keys)


def _priced(price_carbon: DataFrame) -> DataFrame:
    """Slots with both a price and a carbon intensity."""
    return price_carbon.dropna(subset=["value_inc_vat", "carbon_intensity"])


def _windows(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What readers see of ranked slots; ``_ranks`` is the sum of both percent ranks."""
    return ranked.select(
        *keys,
        "rank",
        "period_utc",
        plus(F.col("period_utc"), settings.SLOT).alias("period_to"),
        round_half_away(F.col("value_inc_vat"), 2).alias("price_p_kwh"),
        round_half_away(F.col("carbon_intensity"), 0).alias("carbon_gco2_kwh"),
        "intensity_index",
        round_half_away(F.col("renewable_pct"), 1).alias("renewable_pct"),
        round_half_away((1 - F.col("_ranks") / 2) * 100, 0).alias("window_score"),
    ).withColumn("recommendation", recommendation(F.col("window_score")))


def _local_cells(df: DataFrame, slot: str, zone: str, keys: Sequence[str]):
    """Group by wall-clock hour and weekday: 168 groups a series."""
    clock = local_time(F.col(slot), zone)
    return df.withColumn("_clock", clock).groupBy(
        *keys,
        F.hour("_clock").alias("hour_of_day"),
        weekday_number(F.col("_clock")).alias("day_of_week"),
        weekday_name(F.col("_clock")).alias("day_name"),
    )


def mart_carbon_heatmap(
    carbon: DataFrame, keys: Sequence[str] = (), zone: str = settings.LOCAL_ZONE
) -> DataFrame:
    known = carbon.filter(F.col("intensity_best").isNotNull())
    return _local_cells(known, "period_from", zone, keys).agg(
        round_half_away(F.avg("intensity_best"), 1).alias("avg_intensity_gco2kwh"),
        F.count(F.lit(1)).alias("n_readings"),
    )


def mart_price_heatmap(
    prices: DataFrame, keys: Sequence[str] = (), zone: str = settings.LOCAL_ZONE
) -> DataFrame:
    known = prices.filter(F.col("valid_from").isNotNull())
    price = "value_inc_vat"
    return _local_cells(known, "valid_from", zone, keys).agg(
        round_half_away(F.avg(price), 2).alias("avg_price_p_kwh"),
        round_half_away(F.min(price), 2).alias("min_price_p_kwh"),
        round_half_away(F.max(price), 2).alias("max_price_p_kwh"),
        F.count(F.lit(1)).alias("n_periods"),
    )


def month_of(slot: str | Column) -> Column:
    """First day of a time's month; no time has a month of its own."""
    return F.trunc(dated(slot), "month")


_PARTIALS = {"n_rows": F.sum, "n_known": F.sum, "total": F.sum, "least": F.min, "greatest": F.max}


def _partials(value: str) -> list[Column]:
    """What readings of a cell add up to, so that parts of it can be put together later."""
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count(value).alias("n_known"),
        F.sum(value).alias("total"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
    ]


def _together(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells of all months put together, with their mean."""
    whole = cells.groupBy(*by).agg(*[f(c).alias(c) for c, f in _PARTIALS.items()])
    return whole.withColumn("mean", safe_ratio(F.col("total"), F.col("n_known")))


_CELL = ("hour_of_day", "day_of_week", "day_name")


def carbon_cells(
    carbon: DataFrame, keys: Sequence[str] = (), zone: str = settings.LOCAL_ZONE
) -> DataFrame:
    """Partial aggregates of the carbon heatmap: 168 rows a month and series."""
    known = carbon.filter(F.col("intensity_best").isNotNull())
    known = known.withColumn("month", month_of("period_from"))
    return _local_cells(known, "period_from", zone, (*keys, "month")).agg(*_partials("intensity_best"))


def price_cells(
    prices: DataFrame, keys: Sequence[str] = (), zone: str = settings.LOCAL_ZONE
) -> DataFrame:
    """Partial aggregates of the price heatmap: 168 rows a month and series."""
    known = prices.filter(F.col("valid_from").isNotNull()).withColumn("month", month_of("valid_from"))
    return _local_cells(known, "valid_from", zone, (*keys, "month")).agg(*_partials("value_inc_vat"))


def carbon_heatmap_of(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``mart_carbon_heatmap`` from its partial aggregates."""
    by = (*keys, *_CELL)
    return _together(cells, by).select(
        *by,
        round_half_away(F.col("mean"), 1).alias("avg_intensity_gco2kwh"),
        F.col("n_rows").alias("n_readings"),
    )


def price_heatmap_of(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``mart_price_heatmap`` from its partial aggregates."""
    by = (*keys, *_CELL)
    return _together(cells, by).select(
        *by,
        round_half_away(F.col("mean"), 2).alias("avg_price_p_kwh"),
        round_half_away(F.col("least"), 2).alias("min_price_p_kwh"),
        round_half_away(F.col("greatest"), 2).alias("max_price_p_kwh"),
        F.col("n_rows").alias("n_periods"),
    )


def demand_cells(temp_vs_demand: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Partial aggregates of the demand profile: 48 rows a month and series."""
    known = temp_vs_demand.filter(F.col("total_demand_mw").isNotNull())
    by = (*keys, month_of("hour_utc").alias("month"), "hour_of_day", "day_type")
    return known.groupBy(*by).agg(*_partials("total_demand_mw"))


def demand_profile_of(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``serve.demand_profile`` from its partial aggregates."""
    by = (*keys, "hour_of_day", "day_type")
    return (
        _together(cells, by)
        .filter("n_known >= 2")
        .select(
            *by,
            round_half_away(F.col("mean") / 1000, 2).alias("avg_gw"),
            round_half_away(F.col("least") / 1000, 2).alias("min_gw"),
            round_half_away(F.col("greatest") / 1000, 2).alias("max_gw"),
        )
        .orderBy(*by)
    )


def regression_moments(temp_vs_demand: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Moments of weekday demand over temperature: one row a month and series.

    Squares are taken around the month's own means, so that putting months together loses
    no digits to large sums.
    """
    demand, temp = "total_demand_mw", "temp_c"
    usable = temp_vs_demand.filter(
        (F.col("day_type") == "weekday") & F.col(temp).isNotNull() & F.col(demand).isNotNull()
    )
    n = F.count(F.lit(1))
    return usable.groupBy(*keys, month_of("hour_utc").alias("month")).agg(
        n.alias("n_hours"),
        F.avg(temp).alias("mean_x"),
        F.avg(demand).alias("mean_y"),
        (F.var_pop(temp) * n).alias("xx"),
        (F.var_pop(demand) * n).alias("yy"),
        (F.covar_pop(temp, demand) * n).alias("xy"),
    )


def temp_regression_of(moments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``serve.temp_regression`` from its moments.

    Every month adds its own squares and those of the distance of its means from the
    series' means, which are worked out first; only one row a month and series is joined.
    """
    n = F.col("n_hours")
    whole = moments.groupBy(*keys).agg(
        F.sum("n_hours").alias("n"),
        (F.sum(n * F.col("mean_x")) / F.sum("n_hours")).alias("x"),
        (F.sum(n * F.col("mean_y")) / F.sum("n_hours")).alias("y"),
    )
    dx, dy = F.col("mean_x") - F.col("x"), F.col("mean_y") - F.col("y")
    sums = (
        attach(moments, whole, keys, "inner")
        .groupBy(*keys)
        .agg(
            F.sum("n_hours").alias("n_hours"),
            F.sum(F.col("xx") + n * dx * dx).alias("xx"),
            F.sum(F.col("yy") + n * dy * dy).alias("yy"),
            F.sum(F.col("xy") + n * dx * dy).alias("xy"),
        )
    )
    xx, yy, xy = (F.col(c) for c in ("xx", "yy", "xy"))
    # A demand that never varies is explained in full, as the engine's own aggregate has it.
    explained = F.when(yy == 0, 1.0).otherwise(xy * xy / (xx * yy))
    return sums.select(
        *keys,
        F.when(xx > 0, xy / xx).alias("mw_per_degree_c"),
        F.when(xx > 0, explained).alias("r_squared"),
        F.coalesce("n_hours", F.lit(0)).cast("bigint").alias("n_hours"),
    )


def mart_fuel_mix(generation: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hourly mean of the half-hour readings per fuel: power, not energy."""
    return generation.groupBy(
        *keys, hour_of(F.col("period_utc")).alias("hour_utc"), "fuel_type"
    ).agg(round_half_away(F.avg("generation_mw"), 0).alias("generation_mw"))


def mart_renewable_mix(
    totals: DataFrame, keys: Sequence[str] = (), rows: int = settings.ROLLING_HOURS
) -> DataFrame:
    """Renewable share per hour and its mean over the last ``rows`` hours on record."""
    return renewable_shares(hourly_totals(totals, keys), keys, rows)


def renewable_shares(
    hourly: DataFrame, keys: Sequence[str] = (), rows: int = settings.ROLLING_HOURS
) -> DataFrame:
    """The same from hourly totals."""
    share = safe_ratio(F.col("renewable_mw"), F.col("total_mw")) * 100
    return hourly.select(
        *keys,
        "hour_utc",
        "renewable_mw",
        "total_mw",
        round_half_away(share, 2).alias("renewable_pct"),
        trailing_mean(share, rows, "hour_utc", keys).alias("renewable_pct_7d_avg"),
    )


def mart_temp_vs_demand(
    totals: DataFrame, weather: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Hourly demand (exports counted as negative) beside the temperature."""
    hour = F.col("hour_utc")
    return (
        hourly_totals(totals, keys)
        .join(
            weather.select(*keys, "hour_utc", "temp_c", "windspeed_kmh"),
            [*keys, "hour_utc"],
            "left",
        )
        .select(
            *keys,
            "hour_utc",
            F.col("demand_mw").alias("total_demand_mw"),
            "temp_c",
            "windspeed_kmh",
            weekday_number(hour).alias("day_of_week"),
            F.hour(hour).alias("hour_of_day"),
            day_type(hour).alias("day_type"),
        )
    )


def is_stress_hour(share: Column) -> Column:
    """Cold, calm, evening peak and short of renewables; unknown counts as no."""
    first, last = settings.STRESS_HOURS_UTC
    stressed = (
        (F.col("temp_c") < settings.STRESS_BELOW_TEMP_C)
        & (F.col("windspeed_kmh") < settings.STRESS_BELOW_WIND_KMH)
        & F.hour("hour_utc").between(first, last)
        & (share < settings.STRESS_BELOW_RENEWABLE_SHARE)
    )
    return F.coalesce(stressed, F.lit(False))


def mart_grid_stress(
    totals: DataFrame, weather: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Hours with a known temperature, flagged when the grid was under stress."""
    measured = weather.filter(F.col("temp_c").isNotNull()).select(
        *keys, "hour_utc", "temp_c", "windspeed_kmh"
    )
    share = safe_ratio(F.col("renewable_mw"), F.col("total_mw"))
    hour = F.col("hour_utc")
    return (
        hourly_totals(totals, keys)
        .drop("demand_mw")
        .join(measured, [*keys, "hour_utc"])
        .select(
            *keys,
            "hour_utc",
            "total_mw",
            "renewable_mw",
            round_half_away(share * 100, 1).alias("renewable_pct"),
            "temp_c",
            "windspeed_kmh",
            F.hour(hour).alias("hour_of_day"),
            day_type(hour).alias("day_type"),
            is_stress_hour(share).alias("is_stress_hour"),
            banded(
                F.col("temp_c"), settings.TEMPERATURE_BANDS, settings.TEMPERATURE_REST
            ).alias("temp_band"),
        )
    )


def mart_regional_carbon(carbon: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Latest snapshot with a value per region."""
    known = carbon.filter(F.col("intensity_actual").isNotNull())
    newest_first = [F.col("loaded_at").desc_nulls_last(), F.col("intensity_actual").desc()]
    return top_n(known, newest_first, 1, [*keys, "regionid"]).select(
        *keys,
        "regionid",
        "shortname",
        "full_name",
        "intensity_actual",
        "generationmix",
        F.col("loaded_at").alias("snapshot_at"),
        banded(
            F.col("intensity_actual"), settings.INTENSITY_BANDS, settings.INTENSITY_REST
        ).alias("intensity_band"),
    )


def mart_solar_weather(weather: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Solar and wind indices per hour, column expressions only."""
    sun = F.col("direct_radiation_wm2")
    wind = F.col("windspeed_kmh")
    cloud = F.coalesce(F.col("cloudcover_pct"), F.lit(100.0))
    dark = sun.isNull() | (sun == 0)
    strength = F.least(sun / settings.FULL_SUN_WM2, F.lit(1.0))
    potential = F.greatest(F.lit(0.0), (1 - cloud / 100.0) * strength * 100)
    return weather.filter(F.col("hour_utc").isNotNull()).select(
        *keys,
        "hour_utc",
        "temp_c",
        "windspeed_kmh",
        "wind_direction_deg",
        "cloudcover_pct",
        "direct_radiation_wm2",
        "precipitation_mm",
        F.when(dark, 0.0).otherwise(round_half_away(potential, 1)).alias("solar_index"),
        F.when(dark, "night")
        .when((sun > 400) & (cloud < 30), "excellent")
        .when((sun > 200) & (cloud < 60), "good")
        .when(sun > 50, "fair")
        .otherwise("poor")
        .alias("solar_condition"),
        round_half_away(F.pow(wind / settings.REFERENCE_WIND_KMH, F.lit(3.0)) * 100, 1).alias(
            "wind_power_index"
        ),
        banded(wind, settings.WIND_BANDS, settings.WIND_REST, at_least=True).alias(
            "wind_condition"
        ),
    )

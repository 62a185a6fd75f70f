"""Read queries over the marts.

Each takes mart frames (stored or still lazy), an explicit ``as_of`` where the question
depends on the time, and optional series ``keys``. Only results of a fixed small size
are sorted globally.
"""

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from voltlake import settings
from voltlake.functions.numbers import round_half_away, round_half_even
from voltlake.functions.scoring import amplify_weight, blended_score, recommendation
from voltlake.functions.timeparts import as_text, at
from voltlake.operators.latest import attach, top_n
from voltlake.operators.ranking import percent_rank
from voltlake.operators.runs import full_runs


def _midnight(moment: datetime) -> datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)


def _rounded_slots(price_carbon: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slot figures at display precision. The mart holds one row per slot already."""
    return price_carbon.select(
        *keys,
        "period_utc",
        round_half_away(F.col("value_inc_vat"), 2).alias("price_p_kwh"),
        round_half_away(F.col("carbon_intensity"), 0).alias("carbon_gco2_kwh"),
        round_half_away(F.col("renewable_pct"), 1).alias("renewable_pct"),
        "intensity_index",
    )


def _newest_ascending(
    df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Newest ``n`` rows (per series), shown oldest first."""
    newest = top_n(df, [F.col(c).desc_nulls_last() for c in order], n, keys)
    return newest.orderBy(*keys, *order)


def now_summary(
    price_carbon: DataFrame,
    renewable_mix: DataFrame,
    best_windows: DataFrame,
    as_of: datetime,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The running slot with its score, and the best slot still to come.

    While the running slot has no generation yet, the share of the newest hour stands
    in, whatever it is.
    """
    moment = at(as_of)
    newest_hour = top_n(
        renewable_mix.select(*keys, "hour_utc", F.col("renewable_pct").alias("_newest")),
        [F.col("hour_utc").desc_nulls_last()],
        1,
        keys,
    ).drop("hour_utc")
    running = top_n(
        price_carbon.filter(F.col("period_utc") <= moment),
        [F.col("period_utc").desc()],
        1,
        keys,
    )
    shown = attach(running, newest_hour, keys)
    shown = shown.withColumn("renewable_pct", F.coalesce("renewable_pct", "_newest"))
    scores = best_windows.select(
        *keys, "period_utc", "window_score", "recommendation", "rank"
    )
    upcoming = top_n(
        best_windows.filter(F.col("period_utc") > moment), [F.col("rank")], 1, keys
    ).select(
        *keys,
        as_text(F.col("period_utc")).alias("next_period_utc"),
        F.col("price_p_kwh").alias("next_price"),
        F.col("carbon_gco2_kwh").alias("next_carbon"),
        F.col("window_score").alias("next_score"),
        F.col("recommendation").alias("next_recommendation"),
    )
    scored = _rounded_slots(shown, keys).join(scores, [*keys, "period_utc"], "left")
    return attach(scored, upcoming, keys).select(
        *keys,
        as_text(F.col("period_utc")).alias("period_utc"),
        "price_p_kwh",
        "carbon_gco2_kwh",
        "intensity_index",
        "renewable_pct",
        "window_score",
        "recommendation",
        "rank",
        "next_period_utc",
        "next_price",
        "next_carbon",
        "next_score",
        "next_recommendation",
    )


def appliance_windows(
    price_carbon: DataFrame,
    as_of: datetime,
    hours: float = 2.0,
    weight: float | Column = 0.5,
    keys: Sequence[str] = (),
    *,
    top: int = 5,
    strict_gap: bool = False,
) -> DataFrame:
    """Best runs of consecutive slots for an appliance that needs ``hours``.

    At most 72 slots a series enter. Means are taken over exact integer sums
    (hundredths, tenths), so they do not depend on the order of addition.
    """
    length = max(1, round(hours * 2))
    slot = F.col("period_utc")
    ahead = price_carbon.filter(
        (slot >= at(as_of))
        & (slot < at(as_of + settings.RUN_HORIZON))
        & F.col("value_inc_vat").isNotNull()
    )
    slots = _rounded_slots(ahead, keys)

    def total(name: str, unit: float) -> Column:
        return F.sum(F.rint(F.col(name) * unit).cast("long"))

    runs = full_runs(
        slots,
        length,
        "period_utc",
        {
            "_price": total("price_p_kwh", 100.0),
            "_carbon": total("carbon_gco2_kwh", 1.0),
            "_carbon_n": F.count("carbon_gco2_kwh"),
            "_renew": total("renewable_pct", 10.0),
            "_renew_n": F.count("renewable_pct"),
        },
        keys,
        step=settings.SLOT,
        strict_gap=strict_gap,
    ).filter(F.col("_carbon_n") > 0)
    means = runs.select(
        *keys,
        "start",
        "end",
        round_half_even(F.col("_price") / 100.0 / length, 2).alias("avg_price"),
        (F.col("_carbon") / F.col("_carbon_n")).cast("long").alias("avg_carbon"),
        F.when(
            F.col("_renew_n") > 0,
            round_half_even(F.col("_renew") / 10.0 / F.col("_renew_n"), 1),
        ).alias("avg_renewable"),
    )
    scored = _with_score(means, "avg_price", "avg_carbon", weight, keys)
    best = top_n(scored, [F.col("score").desc(), F.col("start")], top, keys)
    return best.select(
        *keys,
        as_text(F.col("start")).alias("start"),
        as_text(F.col("end")).alias("end"),
        "avg_price",
        "avg_carbon",
        "avg_renewable",
        "score",
    )


def _with_score(
    df: DataFrame, price: str, carbon: str, weight: float | Column, keys: Sequence[str]
) -> DataFrame:
    ranked = df.withColumns(
        {"_price_rank": percent_rank(price, keys), "_carbon_rank": percent_rank(carbon, keys)}
    )
    score = blended_score(
        F.col("_price_rank"), F.col("_carbon_rank"), amplify_weight(weight)
    )
    return ranked.withColumn("score", score).drop("_price_rank", "_carbon_rank")


def windows_by_day(
    price_carbon: DataFrame,
    as_of: datetime,
    weight: float | Column = 0.5,
    keys: Sequence[str] = (),
    *,
    top: int = 5,
) -> DataFrame:
    """Best slots of today and of tomorrow; all slots are ranked in one pool."""
    slot = F.col("period_utc")
    ahead = price_carbon.filter(
        (slot > at(as_of - settings.SLOT))
        & (slot < at(_midnight(as_of) + timedelta(days=2)))
        & F.col("value_inc_vat").isNotNull()
        & F.col("carbon_intensity").isNotNull()
    )
    scored = _with_score(
        _rounded_slots(ahead, keys), "price_p_kwh", "carbon_gco2_kwh", weight, keys
    ).withColumn("day", as_text(F.to_date("period_utc")))
    best = top_n(scored, [F.col("score").desc(), slot], top, [*keys, "day"])
    return best.withColumns(
        {
            "recommendation": recommendation(F.col("score")),
            "period_utc": as_text(slot),
        }
    )


def best_windows_top(
    best_windows: DataFrame, n: int = 5, keys: Sequence[str] = ()
) -> DataFrame:
    return top_n(best_windows, [F.col("rank")], n, keys).withColumns(
        {c: as_text(F.col(c)) for c in ("period_utc", "period_to")}
    )


def prices_carbon_recent(
    price_carbon: DataFrame, n: int = 200, keys: Sequence[str] = ()
) -> DataFrame:
    recent = _newest_ascending(price_carbon, n, ["period_utc"], keys)
    return recent.select(
        *keys,
        as_text(F.col("period_utc")).alias("period_utc"),
        round_half_away(F.col("value_inc_vat"), 2).alias("price_p_kwh"),
        round_half_away(F.col("carbon_intensity"), 0).alias("carbon_intensity"),
        "intensity_index",
        round_half_away(F.col("renewable_pct"), 1).alias("renewable_pct"),
    )


def combined_heatmap(
    price_heatmap: DataFrame, carbon_heatmap: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Score per weekday and hour: at most 168 cells a series."""
    cell = [*keys, "hour_of_day", "day_of_week"]
    joined = price_heatmap.select(*cell, "day_name", "avg_price_p_kwh").join(
        carbon_heatmap.select(*cell, F.col("avg_intensity_gco2kwh").alias("avg_carbon")),
        cell,
    )
    scored = _with_score(joined, "avg_price_p_kwh", "avg_carbon", 0.5, keys)
    return scored.orderBy(*keys, "day_of_week", "hour_of_day")


def fuel_mix_pivot(
    fuel_mix: DataFrame,
    fuels: Sequence[str] | None = None,
    n: int = 960,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Newest ``n`` hour-and-fuel rows as one row per hour and one column per fuel.

    Naming the fuels fixes the columns, and a reading of any other fuel among those rows
    is an error that names it; otherwise Spark first looks up which fuels occur. Fuels
    without a reading show 0.
    """
    newest = top_n(
        fuel_mix.select(
            *keys,
            "hour_utc",
            "fuel_type",
            round_half_away(F.col("generation_mw"), 0).alias("generation_mw"),
        ),
        [F.col("hour_utc").desc_nulls_last(), F.col("fuel_type").desc_nulls_last()],
        n,
        keys,
    )
    label = F.date_format("hour_utc", "yyyy-MM-dd HH").alias("hour_label")
    if fuels:
        unnamed = F.raise_error(F.concat(F.lit("no column for fuel "), "fuel_type"))
        named = F.col("fuel_type").isin(*fuels) | F.col("fuel_type").isNull()
        fuel = F.when(named, F.col("fuel_type")).otherwise(unnamed)
        newest = newest.withColumn("fuel_type", fuel)
    grouped = newest.groupBy(*keys, label).pivot("fuel_type", list(fuels) if fuels else None)
    wide = grouped.agg(F.first("generation_mw"))
    filled = [c for c in wide.columns if c not in (*keys, "hour_label")]
    return wide.fillna(0, filled).orderBy(*keys, "hour_label")


def renewable_weather(
    renewable_mix: DataFrame,
    solar_weather: DataFrame,
    n: int = 720,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Newest hours of the renewable share beside the wind speed.

    The newest rows are taken before the join: weather has one row per hour, so the
    join can neither add nor drop any.
    """
    newest = top_n(renewable_mix, [F.col("hour_utc").desc_nulls_last()], n, keys)
    wind = solar_weather.select(*keys, "hour_utc", "windspeed_kmh")
    return (
        newest.join(wind, [*keys, "hour_utc"], "left")
        .orderBy(*keys, "hour_utc")
        .select(
            *keys,
            as_text(F.col("hour_utc")).alias("hour_utc"),
            "renewable_pct",
            "renewable_pct_7d_avg",
            "windspeed_kmh",
        )
    )


def regional_carbon(regional: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    columns = ["shortname", "full_name", "intensity_actual", "intensity_band"]
    return regional.select(*keys, *columns).orderBy(*keys, "intensity_actual", "shortname")


def grid_stress_recent(
    grid_stress: DataFrame, n: int = 168, keys: Sequence[str] = ()
) -> DataFrame:
    return _newest_ascending(grid_stress, n, ["hour_utc"], keys).select(
        *keys,
        as_text(F.col("hour_utc")).alias("hour_utc"),
        "total_mw",
        "renewable_pct",
        "temp_c",
        "windspeed_kmh",
        "is_stress_hour",
        "temp_band",
        "day_type",
    )


def demand_profile(temp_vs_demand: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Demand in GW by hour of day and kind of day; cells with one reading are left out."""
    demand = F.col("total_demand_mw")
    cells = (
        temp_vs_demand.filter(demand.isNotNull())
        .groupBy(*keys, "hour_of_day", "day_type")
        .agg(
            round_half_away(F.avg(demand) / 1000, 2).alias("avg_gw"),
            round_half_away(F.min(demand) / 1000, 2).alias("min_gw"),
            round_half_away(F.max(demand) / 1000, 2).alias("max_gw"),
            F.count(F.lit(1)).alias("_hours"),
        )
    )
    return (
        cells.filter(F.col("_hours") >= 2)
        .drop("_hours")
        .orderBy(*keys, "hour_of_day", "day_type")
    )


def kpi_summary(
    renewable_mix: DataFrame,
    temp_vs_demand: DataFrame,
    regional: DataFrame,
    grid_stress: DataFrame,
    price_carbon: DataFrame,
    as_of: datetime,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Headline numbers, one row per series.

    The cleanest hour falls back to the newest hour on record while today has none:
    today's hours sort first by share, all others after them by time.
    """
    today = at(_midnight(as_of)).cast("date")
    hour = F.col("hour_utc")
    is_today = F.to_date(hour) == today
    cleanest = top_n(
        renewable_mix,
        [
            is_today.desc(),
            F.when(is_today, F.col("renewable_pct")).desc_nulls_last(),
            F.when(is_today, hour).asc_nulls_last(),
            hour.desc_nulls_last(),
        ],
        1,
        keys,
    ).select(
        *keys,
        as_text(hour).alias("cleanest_hour"),
        round_half_away(F.col("renewable_pct"), 1).alias("renewable_pct"),
        round_half_away(F.col("renewable_pct_7d_avg"), 1).alias("avg_7d"),
    )
    demand = _summary(
        temp_vs_demand,
        is_today,
        {
            "avg_demand_gw": lambda on: round_half_away(
                F.avg(F.when(on, F.col("total_demand_mw"))) / 1000, 1
            ),
            "peak_demand_gw": lambda on: round_half_away(
                F.max(F.when(on, F.col("total_demand_mw"))) / 1000, 1
            ),
        },
        keys,
    )
    carbon = _summary(
        regional,
        F.lit(True),
        {"avg_carbon": lambda on: round_half_away(F.avg("intensity_actual"), 0)},
        keys,
    )
    week = F.to_date(hour) >= F.date_sub(today, 7)
    stress = _summary(
        grid_stress,
        F.col("is_stress_hour") & week,
        {"stress_hours": lambda on: F.count_if(on)},
        keys,
    )
    price = top_n(
        price_carbon.filter(F.col("period_utc") <= at(as_of)),
        [F.col("period_utc").desc()],
        1,
        keys,
    ).select(
        *keys, round_half_away(F.col("value_inc_vat"), 2).alias("current_price_p_kwh")
    )
    merged = demand
    how = "full_outer" if keys else "left"
    for part in (cleanest, carbon, stress, price):
        merged = attach(merged, part, keys, how)
    if keys:
        merged = merged.fillna(0, ["stress_hours"])
    return merged.select(
        *keys,
        "cleanest_hour",
        "renewable_pct",
        "avg_7d",
        "avg_demand_gw",
        "peak_demand_gw",
        "avg_carbon",
        "stress_hours",
        "current_price_p_kwh",
    )


def _summary(df: DataFrame, on: Column, aggregates: dict, keys: Sequence[str]) -> DataFrame:
    """One row per series, also for a series without matching rows.

    Without keys the condition is a plain filter, so it reaches the stored table; with
    keys it moves into the aggregates to keep every series.
    """
    if not keys:
        df, on = df.filter(on), F.lit(True)
    return df.groupBy(*keys).agg(*[make(on).alias(n) for n, make in aggregates.items()])


def temp_regression(temp_vs_demand: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Least squares of weekday demand on temperature.

    One aggregation; Spark merges the partial moments, so nothing is collected. The
    slope is NULL where the temperature never varies.
    """
    demand, temp = "total_demand_mw", "temp_c"
    usable = temp_vs_demand.filter(
        (F.col("day_type") == "weekday")
        & F.col(temp).isNotNull()
        & F.col(demand).isNotNull()
    )
    return usable.groupBy(*keys).agg(
        F.regr_slope(demand, temp).alias("mw_per_degree_c"),
        F.regr_r2(demand, temp).alias("r_squared"),
        F.count(F.lit(1)).alias("n_hours"),
    )

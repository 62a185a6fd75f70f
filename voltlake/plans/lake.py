"""Whole build: bronze frames to stored silver and gold tables.

Silver tables and marts are snapshot tables. A silver load notes which days it changed;
``build_gold`` works out each mart again for the days that changed since the mart was last
made, and for no others. Heatmaps, the demand profile and the regression are kept as
partial aggregates per month and put together when they are read.
"""

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltlake import settings
from voltlake.operators.quality import CONTRACTS, Contract, check_table, check_tables
from voltlake.operators.runs import trailing_reach
from voltlake.operators.upsert import (
    KeyedTable,
    append_increment,
    held,
    load_increment,
    read_table,
)
from voltlake.plans import checks, gold, silver
from voltlake.sinks import snapshots
from voltlake.sinks.snapshots import PART, Pointer, dated, on_days

# Independent writes submitted at the same time, so small stages of one fill the gaps
# of another.
CONCURRENT_WRITES = 8

# Silver table -> its key, and the column that dates a row.
SILVER_KEYS = {
    "stg_generation": ("settlement_key", "settlement_date"),
    "stg_weather": ("hour_utc", "hour_utc"),
    "stg_prices": ("valid_from", "valid_from"),
    "stg_carbon_national": ("period_from", "period_from"),
    "stg_carbon": ("carbon_key", "loaded_at"),
}
# Keyed by load time, so loads only ever add rows.
HISTORY_TABLES = ("stg_carbon",)

# The time of a row that decides which days of a mart it goes into.
SLOTS = {
    "stg_generation": "period_utc",
    "stg_weather": "hour_utc",
    "stg_prices": "valid_from",
    "stg_carbon_national": "period_from",
    "stg_carbon": "loaded_at",
    "slot_totals": "period_utc",
    "mart_price_carbon": "period_utc",
    "mart_temp_vs_demand": "hour_utc",
}

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Mart:
    """A table made day by day: of these tables, dated by this column.

    ``follows`` are the silver tables whose changes reach it. A ``monthly`` one has rows per
    month, in a column of that name, and is made again a month at a time.
    """

    reads: tuple[str, ...]
    follows: tuple[str, ...]
    build: Callable[[Frames, Sequence[str]], DataFrame]
    slot: str = "hour_utc"
    monthly: bool = False


_GENERATION, _WEATHER = "stg_generation", "stg_weather"
_PRICES, _NATIONAL = "stg_prices", "stg_carbon_national"
_TOTALS, _DEMAND = "slot_totals", "mart_temp_vs_demand"

# Tables of each group are made of silver and of the groups before.
MARTS: tuple[dict[str, Mart], ...] = (
    {
        _TOTALS: Mart(
            (_GENERATION,), (_GENERATION,), lambda f, k: gold.slot_totals(f[_GENERATION], k), "period_utc"
        ),
        "mart_fuel_mix": Mart(
            (_GENERATION,), (_GENERATION,), lambda f, k: gold.mart_fuel_mix(f[_GENERATION], k)
        ),
        "mart_solar_weather": Mart(
            (_WEATHER,), (_WEATHER,), lambda f, k: gold.mart_solar_weather(f[_WEATHER], k)
        ),
        "carbon_cells": Mart(
            (_NATIONAL,), (_NATIONAL,), lambda f, k: gold.carbon_cells(f[_NATIONAL], k), "month", True
        ),
        "price_cells": Mart(
            (_PRICES,), (_PRICES,), lambda f, k: gold.price_cells(f[_PRICES], k), "month", True
        ),
    },
    {
        "mart_price_carbon": Mart(
            (_PRICES, _NATIONAL, _TOTALS),
            (_PRICES, _NATIONAL, _GENERATION),
            lambda f, k: gold.mart_price_carbon(f[_PRICES], f[_NATIONAL], f[_TOTALS], k),
            "period_utc",
        ),
        _DEMAND: Mart(
            (_TOTALS, _WEATHER),
            (_GENERATION, _WEATHER),
            lambda f, k: gold.mart_temp_vs_demand(f[_TOTALS], f[_WEATHER], k),
        ),
        "mart_grid_stress": Mart(
            (_TOTALS, _WEATHER),
            (_GENERATION, _WEATHER),
            lambda f, k: gold.mart_grid_stress(f[_TOTALS], f[_WEATHER], k),
        ),
    },
    {
        "demand_cells": Mart(
            (_DEMAND,), (_GENERATION, _WEATHER), lambda f, k: gold.demand_cells(f[_DEMAND], k), "month", True
        ),
        "regression_moments": Mart(
            (_DEMAND,),
            (_GENERATION, _WEATHER),
            lambda f, k: gold.regression_moments(f[_DEMAND], k),
            "month",
            True,
        ),
    },
)
# The marts that readers ask for.
TEN_MARTS = (
    "mart_price_carbon mart_best_windows mart_carbon_heatmap mart_price_heatmap mart_fuel_mix "
    "mart_renewable_mix mart_temp_vs_demand mart_grid_stress mart_regional_carbon mart_solar_weather"
).split()

# Marts that are stored as partial aggregates.
PUT_TOGETHER = ("mart_carbon_heatmap", "mart_price_heatmap")


@dataclass
class Lake:
    """Tables under one root folder.

    ``bronze`` holds raw_generation, raw_weather, raw_prices, raw_carbon_national and
    raw_carbon; ``lookup`` names the regions.
    """

    spark: SparkSession
    root: str
    keys: Sequence[str] = ()
    # What the last build did: mart -> days that were made again, None for all.
    rebuilt: dict[str, set[str] | None] = field(default_factory=dict)
    # What the last ``check_changes`` did: table -> days that were read.
    checked: dict[str, set[str]] = field(default_factory=dict)

    def silver_table(self, name: str) -> KeyedTable:
        key, dated_by = SILVER_KEYS[name]
        slot = SLOTS[name]
        return KeyedTable(
            f"{self.root}/silver/{name}",
            (*self.keys, key),
            dated_by,
            touches=None if slot == dated_by else slot,
        )

    def load_silver(self, bronze: dict[str, DataFrame], lookup: DataFrame) -> None:
        """Merge the bronze rows that are newer than each table."""
        keys = self.keys
        cleaners: dict[str, Callable[[DataFrame], DataFrame]] = {
            "stg_generation": lambda raw: silver.stg_generation(raw, keys),
            "stg_weather": lambda raw: silver.stg_weather(raw, keys),
            "stg_prices": lambda raw: silver.stg_prices(raw, keys),
            "stg_carbon_national": lambda raw: silver.stg_carbon_national(raw, keys),
            "stg_carbon": lambda raw: silver.stg_carbon(raw, lookup, keys),
        }

        def load(name: str) -> None:
            source = bronze[name.replace("stg_", "raw_")]
            increment = append_increment if name in HISTORY_TABLES else load_increment
            increment(self.spark, self.silver_table(name), source, cleaners[name])

        _together(load, cleaners)

    @property
    def silver_names(self) -> tuple[str, ...]:
        return tuple(SILVER_KEYS)

    def silver_frame(self, name: str) -> DataFrame:
        return read_table(self.spark, self.silver_table(name))

    def _path(self, name: str) -> str:
        return f"{self.root}/{'silver' if name in SILVER_KEYS else 'gold'}/{name}"

    def table(self, name: str) -> DataFrame:
        """A stored table as it is now."""
        return snapshots.read(self.spark, self._path(name)).drop(PART)

    def _on(self, name: str, pointer: Pointer, days: set[str] | None) -> DataFrame:
        """A table's rows of some days, or all; only parts that have such rows are read."""
        if days is None:
            return snapshots.read(self.spark, self._path(name), pointer).drop(PART)
        parts = pointer.parts_touching(days)
        rows = snapshots.read(self.spark, self._path(name), pointer, parts).drop(PART)
        return rows.filter(on_days(SLOTS[name], days))

    def build_gold(self, as_of: datetime) -> dict[str, DataFrame]:
        """Bring every mart up to date with the silver tables and return them as stored.

        The silver tables are looked up once, so all marts are made of the same state, also
        while loads go on. A mart that is up to date is not written.
        """
        with held(self.spark, f"{self.root}/gold"):
            now = {n: snapshots.current(self.spark, self._path(n)) for n in SILVER_KEYS}
            self.rebuilt = {}
            for group in MARTS:
                known = dict(now)

                def make(name: str, group=group, known=known) -> None:
                    now[name] = self._make(name, group[name], known)

                _together(make, group)
            _together(lambda f: f(), [
                lambda: self._make_renewable_mix(now),
                lambda: self._make_regional(now),
                lambda: self._make_best_windows(now, as_of),
            ])
        return self.marts()

    def marts(self) -> dict[str, DataFrame]:
        """The ten marts as they are now."""
        put_together = {
            "mart_carbon_heatmap": lambda: gold.carbon_heatmap_of(self.table("carbon_cells"), self.keys),
            "mart_price_heatmap": lambda: gold.price_heatmap_of(self.table("price_cells"), self.keys),
        }
        return {n: put_together[n]() if n in put_together else self.table(n) for n in TEN_MARTS}

    def demand_profile(self) -> DataFrame:
        return gold.demand_profile_of(self.table("demand_cells"), self.keys)

    def temp_regression(self) -> DataFrame:
        return gold.temp_regression_of(self.table("regression_moments"), self.keys)

    def _changed(
        self, mart: Pointer, follows: Iterable[str], now: dict[str, Pointer]
    ) -> set[str] | None:
        """Days that changed since a mart was made; None if it never was."""
        if not mart.notes:
            return None
        return set().union(*[now[s].changed_since(mart.notes.get(s, 0)) for s in follows])

    def _make(self, name: str, mart: Mart, now: dict[str, Pointer]) -> Pointer:
        path = self._path(name)
        before = snapshots.current(self.spark, path)
        days = self._changed(before, mart.follows, now)
        replaced = days or set()
        if days and mart.monthly:
            months = {d[:7] for d in days}
            replaced = {f"{m}-01" for m in months}
            known = {d for t in mart.reads for p in now[t].parts for d in now[t].days(p)}
            days = days | {d for d in known if d[:7] in months}
        self.rebuilt[name] = days
        if days is not None and not days:
            return before
        rows = mart.build({t: self._on(t, now[t], days) for t in mart.reads}, self.keys)
        rows = rows.withColumn(PART, dated(mart.slot))
        if mart.monthly:
            rows = rows.drop("month")
        n_dates = 0 if mart.monthly else len(self._dates(mart.reads, now) if days is None else days)
        return self._write(name, rows, mart.follows, now, replaced, days is None, n_dates)

    def _dates(self, tables: Iterable[str], now: dict[str, Pointer]) -> set[str]:
        """The dates that rows of some tables are filed under."""
        return {p for t in tables for p in now[t].parts}

    def _write(
        self,
        name: str,
        rows: DataFrame,
        follows: Iterable[str],
        now: dict[str, Pointer],
        replaced: Iterable[str],
        everything: bool,
        n_dates: int = 0,
    ) -> Pointer:
        return snapshots.write(
            self.spark,
            self._path(name),
            rows,
            replaced=replaced,
            everything=everything,
            notes={s: now[s].number for s in follows},
            n_dates=n_dates,
        )

    def _make_renewable_mix(self, now: dict[str, Pointer]) -> None:
        """The rolling share: a changed hour reaches the rows after it, on later days too."""
        name, follows, rolling = "mart_renewable_mix", (_GENERATION,), settings.ROLLING_HOURS
        before = snapshots.current(self.spark, self._path(name))
        days = self._changed(before, follows, now)
        self.rebuilt[name] = days
        if days is not None and not days:
            return
        totals = self._on(_TOTALS, now[_TOTALS], days)
        if days is None:
            rows = gold.mart_renewable_mix(totals, self.keys, rolling)
            rows, n_dates = rows.withColumn(PART, dated("hour_utc")), len(now[_TOTALS].parts)
            self._write(name, rows, follows, now, (), True, n_dates)
            return
        columns = [*self.keys, "hour_utc", "renewable_mw", "total_mw", PART]
        stored = snapshots.read(self.spark, self._path(name), before)
        hourly = gold.hourly_totals(totals, self.keys).withColumn(PART, dated("hour_utc"))
        is_old = on_days(PART, days)
        hourly = stored.filter(~is_old).select(columns).unionByName(hourly.select(columns))
        # A changed day counts even if it has no rows any more.
        places = hourly.select(*self.keys, PART, F.lit(1).alias("n"))
        places = places.unionByName(stored.filter(is_old).select(*self.keys, PART, F.lit(0).alias("n")))
        counts = places.groupBy(*self.keys, PART).agg(F.sum("n").alias("n"))
        reach = trailing_reach(counts, PART, days, rolling, self.keys)
        near = hourly.filter(on_days(PART, reach.read))
        rows = gold.renewable_shares(near, self.keys, rolling).withColumn(PART, dated("hour_utc"))
        rows = rows.filter(on_days(PART, reach.rewritten))
        self.rebuilt[name] = reach.rewritten
        self._write(name, rows, follows, now, reach.rewritten, False, len(reach.rewritten))

    def _make_regional(self, now: dict[str, Pointer]) -> None:
        """The newest snapshot of a region: of the stored one and of those that came."""
        name, follows = "mart_regional_carbon", ("stg_carbon",)
        before = snapshots.current(self.spark, self._path(name))
        days = self._changed(before, follows, now)
        self.rebuilt[name] = days
        if days is not None and not days:
            return
        came = self._on("stg_carbon", now["stg_carbon"], days)
        if days is not None:
            stored = snapshots.read(self.spark, self._path(name), before)
            known = stored.withColumnRenamed("snapshot_at", "loaded_at").drop(PART, "intensity_band")
            came = came.select(known.columns).unionByName(known)
        rows = gold.mart_regional_carbon(came, self.keys)
        self._write(name, rows.withColumn(PART, dated("snapshot_at")), follows, now, (), True)

    def _make_best_windows(self, now: dict[str, Pointer], as_of: datetime) -> None:
        """The coming slots: of the two or three days they lie on."""
        first, last = as_of - settings.SLOT, as_of + settings.BEST_WINDOW_HORIZON
        source = "mart_price_carbon"
        days = {p for p in now[source].parts if f"{first:%Y-%m-%d}" <= p <= f"{last:%Y-%m-%d}"}
        ahead = self._on(source, now[source], days)
        rows = gold.mart_best_windows(ahead, as_of, self.keys).withColumn(PART, dated("period_utc"))
        self.rebuilt["mart_best_windows"] = days
        self._write("mart_best_windows", rows, (), now, (), True)

    def check_changes(self) -> DataFrame:
        """Data checks of all tables, reading only the days written since the last time.

        A mart that is put together on reading has a bounded number of rows and is checked
        as a whole.
        """

        def place(contract: Contract) -> tuple[str, str]:
            return self._path(contract.table), f"{self.root}/checks/{contract.table}"

        def refresh(contract: Contract) -> None:
            name = contract.table
            filed_by = SILVER_KEYS[name][1] if name in SILVER_KEYS else "hour_utc"
            self.checked[name] = checks.refresh(
                self.spark, *place(contract), contract, self.keys, filed_by
            )

        stored = [c for c in CONTRACTS if c.table not in PUT_TOGETHER]
        with held(self.spark, f"{self.root}/checks"):
            _together(refresh, stored)
            parts = [checks.results(self.spark, place(c)[1], c) for c in stored]
        marts = self.marts()
        parts += [check_table(marts[c.table], c, self.keys) for c in CONTRACTS if c.table in PUT_TOGETHER]
        return reduce(DataFrame.unionByName, parts)

    def check(self) -> DataFrame:
        """Data checks over the stored tables, all of them read."""
        tables = {name: self.silver_frame(name) for name in SILVER_KEYS}
        return check_tables({**tables, **self.marts()}, keys=self.keys)


def _together(write: Callable, names) -> None:
    with ThreadPoolExecutor(CONCURRENT_WRITES) as pool:
        list(pool.map(write, list(names)))

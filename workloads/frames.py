"""The lake's frames over one folder of test tables, lazily planned."""

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from voltlake.plans import gold, silver
from voltlake.session import configure
from workloads import views


class Frames:
    """Bronze, silver and gold frames for one series, or one per key."""

    def __init__(self, spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self.keys = keys

    @cached_property
    def events(self) -> DataFrame:
        return views.events(self.spark, self.sf_dir)

    @cached_property
    def lookup(self) -> DataFrame:
        return views.region_names(self.spark, self.sf_dir)

    def raw(self, name: str) -> DataFrame:
        return views.RAW[name](self.events, self.keys)

    @cached_property
    def generation(self) -> DataFrame:
        return silver.stg_generation(self.raw("raw_generation"), self.keys)

    @cached_property
    def weather(self) -> DataFrame:
        return silver.stg_weather(self.raw("raw_weather"), self.keys)

    @cached_property
    def prices(self) -> DataFrame:
        return silver.stg_prices(self.raw("raw_prices"), self.keys)

    @cached_property
    def national(self) -> DataFrame:
        return silver.stg_carbon_national(self.raw("raw_carbon_national"), self.keys)

    @cached_property
    def regional_snapshots(self) -> DataFrame:
        return silver.stg_carbon(self.raw("raw_carbon"), self.lookup, self.keys)

    @cached_property
    def totals(self) -> DataFrame:
        return gold.slot_totals(self.generation, self.keys)

    @cached_property
    def price_carbon(self) -> DataFrame:
        return gold.mart_price_carbon(self.prices, self.national, self.totals, self.keys)

    def price_carbon_newest(self, n: int, until: datetime | None = None) -> DataFrame:
        return gold.price_carbon_newest(
            self.prices, self.national, self.totals, n, self.keys, until
        )

    @cached_property
    def price_carbon_ahead(self) -> DataFrame:
        return gold.price_carbon_ahead(
            self.prices, self.national, self.totals, views.AS_OF, self.keys
        )

    @cached_property
    def best_windows(self) -> DataFrame:
        return gold.mart_best_windows(self.price_carbon_ahead, views.AS_OF, self.keys)

    @cached_property
    def carbon_heatmap(self) -> DataFrame:
        return gold.mart_carbon_heatmap(self.national, self.keys)

    @cached_property
    def price_heatmap(self) -> DataFrame:
        return gold.mart_price_heatmap(self.prices, self.keys)

    @cached_property
    def fuel_mix(self) -> DataFrame:
        return gold.mart_fuel_mix(self.generation, self.keys)

    @cached_property
    def renewable_mix(self) -> DataFrame:
        return gold.mart_renewable_mix(self.totals, self.keys)

    @cached_property
    def temp_vs_demand(self) -> DataFrame:
        return gold.mart_temp_vs_demand(self.totals, self.weather, self.keys)

    @cached_property
    def grid_stress(self) -> DataFrame:
        return gold.mart_grid_stress(self.totals, self.weather, self.keys)

    @cached_property
    def regional_latest(self) -> DataFrame:
        return gold.mart_regional_carbon(self.regional_snapshots, self.keys)

    @cached_property
    def solar_weather(self) -> DataFrame:
        return gold.mart_solar_weather(self.weather, self.keys)

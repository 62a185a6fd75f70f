"""Data checks: NULLs, duplicate keys and unexpected values, as a frame of counts."""

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Contract:
    """What a table promises about its columns."""

    table: str
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    accepted: tuple[tuple[str, tuple[str, ...]], ...] = ()


CONTRACTS = (
    Contract(
        "stg_generation",
        not_null=("settlement_key", "settlement_date", "fuel_type", "generation_mw"),
        unique=("settlement_key",),
    ),
    Contract("stg_weather", not_null=("hour_utc",), unique=("hour_utc",)),
    Contract("stg_prices", not_null=("price_key", "value_inc_vat"), unique=("price_key",)),
    Contract("stg_carbon_national", not_null=("period_key",), unique=("period_key",)),
    Contract("stg_carbon", not_null=("carbon_key", "intensity_actual")),
    Contract(
        "mart_temp_vs_demand",
        not_null=("hour_utc",),
        unique=("hour_utc",),
        accepted=(("day_type", ("weekday", "weekend")),),
    ),
    Contract(
        "mart_renewable_mix", not_null=("hour_utc", "renewable_pct"), unique=("hour_utc",)
    ),
    Contract(
        "mart_carbon_heatmap",
        not_null=("hour_of_day", "day_of_week", "avg_intensity_gco2kwh"),
    ),
)


def tallies(contract: Contract) -> list[tuple[str, str, Column]]:
    """(column, check, count of violations) of the checks that look at one row at a time."""
    return [
        (column, "not_null", F.count_if(F.col(column).isNull())) for column in contract.not_null
    ] + [
        (column, "accepted_values", F.count_if(~F.col(column).isin(*values)))
        for column, values in contract.accepted
    ]


def check_rows(contract: Contract, results: Iterable[tuple[str, str, Column]]) -> Column:
    """(table_name, column_name, check_name, violations) of some checks as an array."""
    return F.array(
        *[
            F.struct(
                F.lit(contract.table).alias("table_name"),
                F.lit(column).alias("column_name"),
                F.lit(check).alias("check_name"),
                count.alias("violations"),
            )
            for column, check, count in results
        ]
    )


def check_table(df: DataFrame, contract: Contract, keys: Iterable[str] = ()) -> DataFrame:
    """(table_name, column_name, check_name, violations) for one table.

    NULL and value checks are counted in the same pass that groups by the unique
    column, so a table is scanned once. The grouping combines on the map side, and it
    reuses the partitioning of a table that was just de-duplicated by that column.
    ``violations`` counts rows, for ``unique`` the keys that occur more than once.
    """
    rowwise = tallies(contract)
    names = [f"_t{i}" for i in range(len(rowwise))]
    counted = [tally.alias(name) for name, (_, _, tally) in zip(names, rowwise)]
    results = [(column, check, F.col(name)) for name, (column, check, _) in zip(names, rowwise)]

    if len(contract.unique) > 1:
        raise ValueError("one unique column per contract")
    if contract.unique:
        (column,) = contract.unique
        per_key = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_rows"), *counted)
        repeated = F.count_if(F.col(column).isNotNull() & (F.col("_rows") > 1))
        totals = per_key.agg(
            repeated.alias("_dup"),
            *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names],
        )
        results.append((column, "unique", F.col("_dup")))
    else:
        totals = df.agg(*counted)
    return totals.select(F.inline(check_rows(contract, results)))


def check_tables(
    tables: dict[str, DataFrame], contracts=CONTRACTS, keys: Iterable[str] = ()
) -> DataFrame:
    """All contracts whose table is given. Violations are reported, never raised."""
    keys = tuple(keys)
    parts = [check_table(tables[c.table], c, keys) for c in contracts if c.table in tables]
    return reduce(DataFrame.unionByName, parts)

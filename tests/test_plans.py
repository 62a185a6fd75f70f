"""What the physical plans must look like for large inputs."""

import re

import pytest

from tests.helpers import RAW_GENERATION, RAW_PRICES, T0, frame
from voltlake.plans import gold, serve, silver
from voltlake.session import scratch_path
from workloads import catalog
from workloads.frames import Frames

SF = "/root/testdata/sf0.001"


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


LAZY = [n for n in catalog.QUERIES if not n.startswith(
    ("stream", "lake", "incremental", "schema", "json", "ingest_audit", "percent_rank", "stored"))
    and not n.endswith("_incremental")]


# The data checks end in one row per check over all series: partial counts meet there.
@pytest.mark.parametrize("name", [n for n in LAZY if n.endswith("_by_zone") and n[:3] != "dq_"])
def test_keyed_queries_never_gather_everything(spark, name):
    assert "SinglePartition" not in plan(catalog.QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", LAZY)
def test_no_python_in_the_plan_and_no_cartesian_product(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert not re.search(r"Python|CartesianProduct|MapInPandas|ArrowEval", text)


@pytest.mark.parametrize("name", LAZY)
def test_times_are_parsed_without_patterns(spark, name):
    assert "regexp_extract" not in plan(catalog.QUERIES[name](spark, SF))


def test_newest_wins_reduces_before_the_shuffle(spark):
    newest = silver.stg_generation(frame(spark, RAW_GENERATION))
    tree = newest._jdf.queryExecution().executedPlan().toString()
    # printed from the result down: the shuffle reads what the partial maximum left
    assert tree.index("hashpartitioning(settlement_key") < tree.index("partial_max")
    assert "Window" not in tree


def test_stored_prices_are_read_with_pushed_filters(spark):
    path = scratch_path(spark, "p")
    prices = silver.stg_prices(
        frame(spark, RAW_PRICES, ("2024-06-03T12:00:00Z", "2024-06-03T12:30:00Z", 1.0, "A", T0))
    )
    prices.write.parquet(path)
    f = Frames(spark, SF)
    stored = spark.read.parquet(path)
    ahead = gold.price_carbon_ahead(stored, f.national, f.totals, T0)
    text = plan(serve.appliance_windows(ahead, T0))
    (scan,) = [s for s in text.split("\n\n") if path in s and "PushedFilters" in s]
    assert "GreaterThanOrEqual(valid_from" in scan and "LessThanOrEqual(valid_from" in scan
    assert "product_code" not in re.search(r"ReadSchema: (.*)", scan).group(1)


def test_one_slot_is_found_without_joining_history(spark):
    path = scratch_path(spark, "p")
    row = ("2024-06-03T12:00:00Z", "2024-06-03T12:30:00Z", 1.0, "A", T0)
    silver.stg_prices(frame(spark, RAW_PRICES, row)).write.parquet(path)
    f = Frames(spark, SF)
    stored = spark.read.parquet(path)
    text = plan(gold.price_carbon_newest(stored, f.national, f.totals, 1, until=T0))
    scans = [s for s in text.split("\n\n") if path in s and "PushedFilters" in s]
    assert scans and all("LessThanOrEqual(valid_from" in s for s in scans)
    assert text.count("TakeOrderedAndProject") >= 3 or text.count("GlobalLimit") >= 2


def test_joins_reuse_the_partitioning_of_the_newest_rows(spark):
    """Prices and carbon are shuffled once each, for newest-wins and for the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(Frames(spark, SF).price_carbon)
        shuffles = len(re.findall(r"\(\d+\) Exchange\n", text))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # prices, carbon, readings by key, slot totals
    assert shuffles == 4


def test_checks_reuse_the_partitioning_of_the_key(spark):
    from voltlake.operators.quality import CONTRACTS, check_table

    contract = next(c for c in CONTRACTS if c.table == "stg_generation")
    text = plan(check_table(Frames(spark, SF).generation, contract))
    assert len(re.findall(r"hashpartitioning", text)) == 1


def test_top_k_is_not_a_full_sort(spark):
    text = plan(serve.best_windows_top(Frames(spark, SF).best_windows))
    assert "TakeOrderedAndProject" in text


def test_lookup_join_has_another_way_beyond_broadcast_size(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = Frames(spark, SF)
        text = plan(silver.stg_carbon(f.raw("raw_carbon"), f.lookup))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_every_query_has_sql_and_the_flagship_has_rows(spark):
    assert set(catalog.ORACLE) == set(catalog.QUERIES)
    rows = catalog.flagship(spark, SF).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows


@pytest.mark.parametrize("name", [n for n in LAZY if n.startswith("ingest_") and "window" not in n])
def test_payloads_are_parsed_once(spark, name):
    tree = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert tree.count("from_json") == 1

import random
from datetime import timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.helpers import T0, frame, rows_of
from voltlake.operators import latest, quality, runs
from voltlake.operators.ranking import percent_rank, spread_percent_rank, spread_row_number

def sql_ranks(rows, kind, part=""):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t (id INT, g VARCHAR, v {kind})")
    if rows:
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    return sorted(
        con.execute(
            f"SELECT id, percent_rank() OVER ({part} ORDER BY v NULLS LAST) FROM t"
        ).fetchall()
    )


def test_percent_rank_window_with_ties_and_nulls(spark):
    values = [4.0, None, 9.5, 4.0, -1.0, 9.5, 9.5, None, 0.0]
    rows = [(i, "a", v) for i, v in enumerate(values)]
    df = frame(spark, "id int, g string, v double", *rows)
    got = sorted(rows_of(df.select("id", percent_rank("v"))))
    assert got == sql_ranks(rows, "DOUBLE")


KINDS = {
    "double": ("DOUBLE", lambda n: n / 4),
    "date": ("DATE", lambda n: (T0 + timedelta(days=n)).date()),
    "string": ("VARCHAR", lambda n: f"v{n:03d}"),
    "bigint": ("BIGINT", lambda n: n * 10**12),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("keys", [(), ("g",)])
def test_spread_percent_rank_with_a_hot_value(spark, kind, keys):
    """A third of the rows share one value, one series holds most rows."""
    sql, made = KINDS[kind]
    rng = random.Random(17)
    rows = [(i, "a", made(28)) for i in range(250)]
    rows += [(250 + i, rng.choice("aaab"), made(rng.randrange(90))) for i in range(500)]
    rows += [(800, "a", None), (801, "b", None), (802, None, made(1)), (803, "c", made(20))]
    df = frame(spark, f"id int, g string, v {kind}", *rows).repartition(5)
    got = sorted(rows_of(spread_percent_rank(df, "v", "r", keys), "id", "r"))
    assert got == sql_ranks(rows, sql, "PARTITION BY g" if keys else "")


@pytest.mark.parametrize("rows", [[], [(1, "a", 3.0)], [(1, "a", None), (2, "a", float("nan"))]])
def test_spread_percent_rank_of_next_to_nothing(spark, rows):
    df = frame(spark, "id int, g string, v double", *rows)
    got = sorted(rows_of(spread_percent_rank(df, "v", "r"), "id", "r"))
    assert got == sql_ranks(rows, "DOUBLE")


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_spread_row_numbers_with_ties_nulls_and_a_hot_series(spark, keys):
    rng = random.Random(23)
    rows = [(i, rng.choice("aaaab"), 1.0 if i % 3 == 0 else rng.randrange(40) / 4, i % 50) for i in range(900)]
    rows += [(900, "a", None, 1), (901, None, 2.0, 1), (902, None, 2.0, None), (903, "c", None, None)]
    df = frame(spark, "id int, g string, v double, w int", *rows).repartition(6)
    numbered = spread_row_number(df, ("v", "w"), "n", keys)
    assert numbered.columns == [*df.columns, "n"]
    got = rows_of(numbered)
    assert sorted(map(str, (r[:4] for r in got))) == sorted(map(str, rows))
    series = {}
    for _, g, v, w, n in got:
        series.setdefault(g if keys else "all", []).append((n, v is None, v or 0, w is None, w or 0))
    for members in series.values():
        members.sort()
        assert [m[0] for m in members] == list(range(1, len(members) + 1))
        assert [m[1:] for m in members] == sorted(m[1:] for m in members)


def test_spread_row_numbers_spread_full_ties_and_take_empty_frames(spark):
    same = spark.range(4000).select(F.lit(1).alias("v"))
    numbered = spread_row_number(same, ("v",), "n")
    assert sorted(n for _, n in rows_of(numbered)) == list(range(1, 4001))
    assert rows_of(spread_row_number(same.limit(0), ("v",), "n")) == []
    plan = numbered._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "_part" in plan  # sorted before, by parts


def test_newest_per_key_is_repeatable_on_equal_versions(spark):
    rows = [("k", T0, i) for i in range(50)] + [("j", T0 - timedelta(1), 1), ("j", None, 2)]
    for parts in (1, 3, 7):
        df = frame(spark, "k string, loaded_at ts, v int", *rows).repartition(parts)
        got = rows_of(latest.newest_per_key(df, ["k"]).orderBy("k"), "k", "v")
        assert got == [("j", 1), ("k", 49)]


def test_top_n_per_series(spark):
    df = frame(spark, "g string, v int", *[(g, v) for g in "ab" for v in range(5)])
    assert sorted(rows_of(latest.top_n(df, [F.desc("v")], 2, ["g"]))) == [
        ("a", 3), ("a", 4), ("b", 3), ("b", 4),
    ]
    assert latest.top_n(df, [F.desc("v"), F.col("g")], 3).collect()[0] == ("a", 4)


def test_runs_of_one_row_and_by_series(spark):
    df = frame(
        spark, "g string, t ts, v double",
        *[(g, T0 + timedelta(minutes=30 * i), float(i)) for g in "ab" for i in range(3)],
    )
    single = runs.full_runs(df, 1, "t", {"m": F.avg("v")}, ["g"])
    assert single.count() == 6
    pairs = runs.full_runs(df, 2, "t", {"m": F.avg("v")}, ["g"])
    assert sorted(rows_of(pairs, "g", "m")) == [("a", 0.5), ("a", 1.5), ("b", 0.5), ("b", 1.5)]


def test_checks_count_what_is_wrong(spark):
    df = frame(
        spark, "k string, kind string, n int",
        ("a", "x", 1), ("a", "y", None), ("b", "z", 2), (None, "x", 3), (None, "x", None),
    )
    contract = quality.Contract(
        "t", not_null=("k", "n"), unique=("k",), accepted=(("kind", ("x", "y")),)
    )
    got = {(c, k): v for _, c, k, v in rows_of(quality.check_table(df, contract))}
    assert got == {
        ("k", "not_null"): 2, ("n", "not_null"): 2,
        ("kind", "accepted_values"): 1, ("k", "unique"): 1,
    }


def test_checks_of_an_empty_table(spark):
    df = frame(spark, "k string")
    contract = quality.Contract("t", not_null=("k",), unique=("k",))
    assert [v for *_, v in rows_of(quality.check_table(df, contract))] == [0, 0]


def test_all_declared_checks_are_there():
    checks = [
        (c.table, column)
        for c in quality.CONTRACTS
        for column in (*c.not_null, *c.unique, *(name for name, _ in c.accepted))
    ]
    assert len(checks) == 16 + 6 + 1

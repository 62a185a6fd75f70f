"""Checks kept from changes, against checks of everything."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, rows_of
from voltlake.operators.quality import Contract, check_table
from voltlake.plans import checks
from voltlake.session import scratch_path
from voltlake.sinks import snapshots

DAY = datetime(2024, 5, 1)
FILED = Contract(
    "t", not_null=("k", "n"), unique=("k",), accepted=(("kind", ("x", "y")),)
)


def days_of(spark, rng, days, rows=12):
    """Rows of some days; few keys, so they repeat in a day and between days."""
    made = [
        (rng.choice("ab"), rng.choice([None, *range(60)]), rng.choice(["x", "y", "z"]),
         rng.choice([1, 2, None]), DAY + timedelta(days=d))
        for d in days for _ in range(rows)
    ]
    df = frame(spark, "zone string, k int, kind string, n int, at ts", *made)
    return df.withColumn(snapshots.PART, snapshots.dated("at"))


def text(*days):
    return {f"{DAY + timedelta(days=d):%Y-%m-%d}" for d in days}


def steps(rng):
    return [range(8), [3], [9, 10], [], [0, 3, 9]] + [rng.sample(range(11), 2) for _ in range(2)]


@pytest.mark.parametrize("keys", [(), ("zone",)])
def test_kept_checks_equal_checks_of_everything(spark, keys, monkeypatch):
    rng = random.Random(41)
    source, root = scratch_path(spark, "t"), scratch_path(spark, "checks")
    assert checks.refresh(spark, source, root, FILED, keys) == set()
    assert {v for *_, v in rows_of(checks.results(spark, root, FILED))} == {0}
    read, plain = [], snapshots.read

    def spy(session, path, pointer=None, parts=None):
        if path == source:
            read.append(parts)
        return plain(session, path, pointer, parts)

    seen = set()
    for n, days in enumerate(steps(rng)):
        if days:
            snapshots.write(spark, source, days_of(spark, rng, days))
        if n == 3:  # a day goes, without rows in its place
            snapshots.write(spark, source, days_of(spark, rng, [5]).limit(0), replaced=text(5))
        read.clear()
        monkeypatch.setattr(snapshots, "read", spy)
        assert checks.refresh(spark, source, root, FILED, keys) == text(*days)
        monkeypatch.setattr(snapshots, "read", plain)
        assert read == ([sorted(text(*days))] if days else [])
        whole = check_table(snapshots.read(spark, source), FILED, keys)
        got = rows_of(checks.results(spark, root, FILED), *whole.columns)
        assert sorted(got) == sorted(rows_of(whole))
        seen.add(dict((r[1:3], r[3]) for r in got)["k", "unique"])
    assert len(seen) > 3 and min(seen) > 0


def test_values_filed_by_their_own_date_need_no_other_dates(spark, monkeypatch):
    contract = Contract("t", not_null=("at",), unique=("at",))
    rng = random.Random(43)
    source, root = scratch_path(spark, "t"), scratch_path(spark, "checks")
    snapshots.write(spark, source, days_of(spark, rng, range(4)))
    checks.refresh(spark, source, root, contract, filed_by="at")
    snapshots.write(spark, source, days_of(spark, rng, [2], rows=1))
    listed, plain = [], snapshots.read

    def spy(session, path, pointer=None, parts=None):
        listed.append((path.rsplit("/", 1)[1], parts))
        return plain(session, path, pointer, parts)

    monkeypatch.setattr(snapshots, "read", spy)
    checks.refresh(spark, source, root, contract, filed_by="at")
    assert all(set(parts) <= text(2) for name, parts in listed if name != "repeated")
    monkeypatch.setattr(snapshots, "read", plain)
    got = {r[2]: r[3] for r in rows_of(checks.results(spark, root, contract))}
    assert got == {"not_null": 0, "unique": 3}


@pytest.mark.parametrize("dies_at", ["keys", "repeated", "counts"])
def test_a_refresh_that_died_is_made_up_for(spark, monkeypatch, dies_at):
    rng = random.Random(47)
    source, root = scratch_path(spark, "t"), scratch_path(spark, "checks")
    snapshots.write(spark, source, days_of(spark, rng, range(5)))
    checks.refresh(spark, source, root, FILED)
    snapshots.write(spark, source, days_of(spark, rng, [1, 2]), replaced=text(4))
    plain = snapshots.write

    def write(session, path, *rest, **named):
        if path.endswith(dies_at):
            raise RuntimeError("executor lost")
        return plain(session, path, *rest, **named)

    monkeypatch.setattr(snapshots, "write", write)
    with pytest.raises(RuntimeError, match="lost"):
        checks.refresh(spark, source, root, FILED)
    monkeypatch.setattr(snapshots, "write", plain)
    checks.refresh(spark, source, root, FILED)
    whole = check_table(snapshots.read(spark, source), FILED)
    assert sorted(rows_of(checks.results(spark, root, FILED), *whole.columns)) == sorted(rows_of(whole))


def test_checks_without_a_unique_column(spark):
    contract = Contract("t", not_null=("n",))
    rng = random.Random(53)
    source, root = scratch_path(spark, "t"), scratch_path(spark, "checks")
    for days in (range(3), [1]):
        snapshots.write(spark, source, days_of(spark, rng, days))
        checks.refresh(spark, source, root, contract)
        whole = check_table(snapshots.read(spark, source), contract)
        assert rows_of(checks.results(spark, root, contract), *whole.columns) == rows_of(whole)

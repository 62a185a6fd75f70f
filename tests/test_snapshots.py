"""Versions with many dates, filed by month, against rows kept in a dictionary."""

import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from tests.helpers import frame, rows_of
from voltlake.operators.quality import Contract, check_table
from voltlake.operators.upsert import KeyedTable, read_table, upsert
from voltlake.plans import checks
from voltlake.session import scratch_path
from voltlake.sinks import snapshots
from voltlake.sinks.files import list_names

DAY = datetime(2024, 1, 20)


def some_days(spark, days, value):
    rows = [(100 * value + d % 3, DAY + timedelta(days=d, hours=h)) for d in days for h in (1, 20)]
    df = frame(spark, "v int, at ts", *rows, (value, None))
    return df.withColumn(snapshots.PART, snapshots.dated("at"))


def by_date(df):
    found = {}
    for v, at, part in sorted(rows_of(df, "v", "at", F.col(snapshots.PART).cast("string")), key=repr):
        assert part == (snapshots.NO_DATE if at is None else f"{at:%Y-%m-%d}")
        found.setdefault(part, []).append((v, at))
    return found


def folders(spark, path):
    names = [n for n in list_names(spark, path) if n.startswith("version=")]
    return {n: set(list_names(spark, f"{path}/{n}")) - {"_SUCCESS", "._SUCCESS.crc"} for n in names}


def test_many_dates_are_filed_by_month(spark):
    rng = random.Random(61)
    path, model = scratch_path(spark, "t"), {}
    for step, n in enumerate([100, 3, 70, 1, 65, 2, 90, 90, 90]):
        days = rng.sample(range(100), n)
        rows = some_days(spark, days, step)
        after = snapshots.write(spark, path, rows, n_dates=len(days))
        new = by_date(rows)
        model |= new
        assert set(after.parts) == set(model) and after.changed_since(step) == set(new)
        assert after.written[after.parts[snapshots.NO_DATE]] == len(new)
        got = snapshots.read(spark, path)
        assert got.columns == ["v", "at", "part_date"] and by_date(got) == model
        some = rng.sample(sorted(model), 20)
        assert by_date(snapshots.read(spark, path, parts=some)) == {p: model[p] for p in some}
        made = folders(spark, path)
        (last,) = [f for v, f in made.items() if v.endswith(after.parts[snapshots.NO_DATE])]
        assert len(last) <= 6 if n > snapshots.APART else len(last) == n + 1
    # What no kept pointer names has gone: months by then, or dates.
    kept = [snapshots._load(spark, path, n) for n in snapshots._named(spark, path)]
    named = {snapshots._folder("", v, p).rsplit("/", 1)[1] for k in kept for p, v in k.parts.items()}
    assert set(made) == {f"version={v}" for k in kept for v in k.parts.values()}
    assert set().union(*made.values()) <= named


def test_a_month_goes_when_none_of_its_dates_is_current(spark):
    path = scratch_path(spark, "t")
    snapshots.write(spark, path, some_days(spark, range(100), 0), n_dates=100)
    february = [d for d in range(100) if (DAY + timedelta(days=d)).month == 2]
    for step, days in enumerate([february[1:], february[:1], [0], [0], [0]]):
        snapshots.write(spark, path, some_days(spark, days, step))
        first = folders(spark, path)[min(folders(spark, path))]
        # The pointer that still names a date of February goes with the fourth write.
        assert ("part_date=2024-02-01" in first) == (step < 3)
    assert "part_date=2024-01-01" in first


@pytest.mark.parametrize("keys", [(), ("zone",)])
def test_checks_of_many_dates_write_few_folders(spark, keys):
    contract = Contract("t", not_null=("v",), unique=("v",))
    source, root = scratch_path(spark, "t"), scratch_path(spark, "checks")
    for days in (range(150), [5, 60], range(40, 130)):
        rows = some_days(spark, days, len(days)).withColumn("zone", F.lit("a"))
        snapshots.write(spark, source, rows)
        checks.refresh(spark, source, root, contract, keys)
        whole = check_table(snapshots.read(spark, source), contract, keys)
        got = rows_of(checks.results(spark, root, contract), *whole.columns)
        assert sorted(got) == sorted(rows_of(whole))
    for name in ("keys", "counts"):
        assert sum(map(len, folders(spark, f"{root}/{name}").values())) < 20


def test_an_upsert_of_many_dates_writes_few_folders(spark):
    table = KeyedTable(scratch_path(spark, "t"), ("at",), "at", "loaded_at", "at")
    slots = [DAY + timedelta(hours=8 * h) for h in range(400)]
    model = {}
    for step, picked in enumerate([slots[:9], slots, slots[100:103], slots[50:380]]):
        rows = [(step, at, DAY + timedelta(days=step)) for at in picked]
        upsert(spark, table, frame(spark, "v int, at ts, loaded_at ts", *rows))
        model |= dict.fromkeys(picked, step)
    assert dict(rows_of(read_table(spark, table), "at", "v")) == model
    assert sum(map(len, folders(spark, table.path).values())) < 25

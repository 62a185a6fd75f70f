import random
from collections import Counter
from datetime import timedelta

import pytest

from tests.helpers import T0, frame, rows_of
from voltlake.operators.asof import as_of

MOMENTS = "id int, who string, asked ts"
FACTS = "who string, seen ts, price double, note string"


def brute(moments, facts):
    out = Counter()
    for i, who, asked in moments:
        known = [f[1:] for f in facts if who is not None and f[0] == who and f[1] and asked and f[1] <= asked]
        best = max(known, default=(None, None, None))
        out[i, who, asked, best[0], best[1], best[2]] += 1
    return out


def joined(spark, moments, facts, **how):
    got = as_of(
        frame(spark, MOMENTS, *moments).repartition(3),
        frame(spark, FACTS, *facts).repartition(3),
        keys=("who",), moment="asked", at="seen",
        take={"since": "seen", "price": "price", "said": "note"}, **how,
    )
    return got, Counter(rows_of(got))


def made(seed, n):
    rng = random.Random(seed)
    # Half of the rows belong to one key; times repeat, and days lie empty.
    time = lambda: T0 + timedelta(minutes=rng.choice((0, 1, 30, 1440, 9000)) * rng.randrange(-9, 9))
    who = lambda: rng.choice(("hot", "hot", "hot", "a", "b", None))
    moments = [(rng.randrange(n), who(), rng.choice((time(), time(), None))) for _ in range(n)]
    facts = [(who(), rng.choice((time(), time(), None)), float(rng.randrange(4)), rng.choice("xy")) for _ in range(n)]
    return moments, facts


@pytest.mark.parametrize("bucket", [timedelta(days=1), timedelta(minutes=7), timedelta(days=400)])
def test_matches_brute_force(spark, bucket):
    moments, facts = made(3, 120)
    _, got = joined(spark, moments, facts, bucket=bucket)
    assert got == brute(moments, facts)


def test_carries_over_empty_days_and_takes_the_same_instant(spark):
    day = timedelta(days=1)
    facts = [("a", T0, 1.0, "x"), ("a", T0 + 40 * day, 2.0, "y"), ("a", T0 + 40 * day, 2.0, "z")]
    moments = [(1, "a", T0), (2, "a", T0 - day), (3, "a", T0 + 30 * day), (4, "a", T0 + 90 * day), (4, "b", T0)]
    _, got = joined(spark, moments, facts)
    assert {(k[0], k[1], k[5]) for k in got} == {(1, "a", "x"), (2, "a", None), (3, "a", "x"), (4, "a", "z"), (4, "b", None)}


def test_empty_sides(spark):
    moments, facts = made(4, 10)
    assert joined(spark, [], facts)[1] == Counter()
    assert joined(spark, moments, [])[1] == brute(moments, [])


def test_no_window_over_rows_and_names_must_be_new(spark):
    got, _ = joined(spark, *made(5, 30))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan and "BroadcastNestedLoop" not in plan
    with pytest.raises(ValueError, match="already have"):
        as_of(frame(spark, MOMENTS), frame(spark, FACTS), moment="asked", at="seen", take={"id": "price"})


def test_without_keys(spark):
    moments = frame(spark, "asked ts", (T0,), (T0 + timedelta(days=3),))
    facts = frame(spark, "seen ts, v int", (T0 + timedelta(hours=1), 5), (T0 - timedelta(days=9), 4))
    got = as_of(moments, facts, moment="asked", at="seen", take={"v": "v"})
    assert sorted(v for _, v in rows_of(got)) == [4, 5]

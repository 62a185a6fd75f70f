import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from voltlake.llm.periodic import (
    digests,
    periodic_run_report,
    periodic_runs,
    stuttered,
    without_repeats,
)


def brute(words):
    """Every period at every place; of equal stretches the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((a, length, q) for (a, length), q in found.items())


def texts(rng, count):
    for _ in range(count):
        words = [b"%d" % rng.randrange(rng.randint(1, 4)) for _ in range(rng.choice([0, 1, 5, 6, 12, 30, 70]))]
        if words and rng.random() < 0.6:
            a, p = rng.randrange(len(words)), rng.randint(1, 6)
            words = words[:a] + [words[min(a + i % p, len(words) - 1)] for i in range(len(words))] + words
        yield words


def test_runs_of_many_texts_at_once_are_those_of_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        some = list(texts(rng, rng.randint(1, 6)))
        assert periodic_runs(some) == [brute(w) for w in some]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=60), max_size=4))
def test_two_letters(some):
    some = [[c.encode() for c in t] for t in some]
    assert periodic_runs(some) == [brute(w) for w in some]


def test_fibonacci_words_and_long_texts():
    a, b = "a", "ab"
    while len(b) < 3_000:
        a, b = b, b + a
    fibonacci = [c.encode() for c in b]
    same, turns = [b"w"] * 30_000, [b"x", b"y", b"x"] * 9_000
    assert periodic_runs([fibonacci, same, turns]) == [
        brute(fibonacci),
        [(0, 30_000, 1)],
        [(0, 27_000, 3)],
    ]


def test_words_after_the_first_period_go():
    words = b"a b c b c b c b c d d d d d d e".split()
    runs = periodic_runs([words])[0]
    assert runs == [(1, 8, 2), (9, 6, 1)]
    assert without_repeats(words, runs) == b"a b c d e".split()


def test_planted_words_follow_the_rule():
    words = [b"%d" % i for i in range(50)]
    assert stuttered(None, words) == words and stuttered(3, []) == []
    changed = [i for i in range(200) if stuttered(i, words) != words]
    assert 5 < len(changed) < 50
    assert all(len(stuttered(i, words)) == 50 for i in changed)


ROWS = [
    (1, "no no no no no no stop"),
    (1, "no no no no no no stop"),
    (2, None),
    (3, ""),
    (4, " \n\t"),
    (None, "x y x y x y x y z z z z z z z z"),
    (5, "one two three"),
    (6, "äß c " * 8 + "end"),
    (7, "long " * 60_000),
    (8, "Aa aa Aa aa Aa aa Aa aa"),
]


@pytest.mark.parametrize("planted", [False, True])
def test_frame(spark, planted):
    rows = [(i, t, "clash", 9, "x") for i, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, start int, words string")
    got = periodic_run_report(docs.repartition(3), planted=planted)
    expected = []
    for i, t in ROWS:
        words = (t or "").encode().split()
        words = stuttered(i, words) if planted else words
        runs = brute(words) if len(words) < 5_000 else periodic_runs([words])[0]
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = 1000 * top[1] // top[2] if runs else None
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        kept = b" ".join(without_repeats(words, runs))
        shown = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), kept)]
        expected.append((i, len(runs), *top, milli, *shown))
    assert sorted(map(str, map(tuple, digests(got).collect()))) == sorted(map(str, expected))


def test_no_rows(spark):
    assert periodic_run_report(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []

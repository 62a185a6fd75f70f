import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from voltlake.llm import near_dedup as module
from voltlake.llm.components import components
from voltlake.llm.near_dedup import near_dedup
from voltlake.llm.text import LOWER, UPPER

SPLIT = str.maketrans(UPPER, LOWER)


def sets_of(docs, size=5):
    out = []
    for i, text in docs:
        # Only these six characters separate words.
        words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (text or "").translate(SPLIT))
        words = [w for w in words.split(" ") if w]
        runs = max(1, len(words) - size + 1) if words else 0
        out.append((i, {tuple(words[k : k + size]) for k in range(runs)}))
    return out


def brute(docs, percent=75):  # ids that repeat do so with one text
    sets = sets_of(docs)
    root = {i: i for i, _ in docs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return sorted(
        (-1 if i is None else i, len(s), -1 if i is None else find(i)) for i, s in sets
    )


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus():
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "a b c"), (6, "A  b\nc")]
    docs += [(7, "a b\xa0c"), (8, "a b c d e"), (9, "long " * 60_000), (10, "LONG " * 50_000)]
    docs += [(None, "a b c"), (None, None)]
    chain = prose(120)
    for i in range(12):  # each like the one before, the ends unlike
        docs.append((100 - i, " ".join(chain)))
        chain = edited(rng, chain, 2)
    base = prose(150)
    for i in range(150):  # pairs of one group on both sides of the threshold
        docs.append((200 + i, " ".join(edited(rng, base, rng.randrange(1, 9)))))
    shared = prose(30)
    for i in range(60):
        docs.append((400 + i, " ".join(prose(20) + shared + prose(20))))
    docs += [(500 + i, docs[40][1]) for i in range(5)]
    return docs


def test_components_match_brute_force(spark):
    docs = corpus()
    rows = [(i, t, "x", 1.0) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, keys string, component double")
    out = near_dedup(frame.repartition(5)).fillna(-1, ["doc_id", "component_id"]).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    first, second = " ".join(map(str, range(40))), " ".join(map(str, range(90, 140)))
    rows = [(5, first), (5, second), (2, first), (9, second + " 1")]
    out = near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(2, 2), (5, 2), (5, 5), (9, 5)]


def test_empty_table(spark):
    assert near_dedup(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("n", [2, 7, 33])
def test_components_of_paths_and_rings(spark, n):
    rng = random.Random(n)
    names = rng.sample(range(1000), 2 * n)
    path, ring = names[:n], names[n:]
    pairs = [*zip(path, path[1:]), *zip(ring, ring[1:] + ring[:1])]  # noqa: B905
    edges = spark.createDataFrame(pairs, "u bigint, v bigint")
    got = {r.node: r.component for r in components(edges.union(edges)).collect()}
    assert got == {x: min(path) for x in path} | {x: min(ring) for x in ring}


def test_components_without_edges(spark):
    none = spark.createDataFrame([], "u bigint, v bigint")
    assert components(none).collect() == []
    loops = spark.range(3).select(F.col("id").alias("u"), F.col("id").alias("v"))
    assert components(loops).collect() == []


def test_linked_classes_with_one_smallest_id_stay_apart(spark):
    rng = random.Random(8)
    a, b = ([f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(2))
    a_, b_ = edited(rng, a, 1), edited(rng, b, 1)
    rows = [(5, a), (5, b), (7, a_), (8, b_), (5, a), (9, a_)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    out = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs).collect())
    assert out == [(5, 76, 5, True)] * 3 + [(i, 76, 5, False) for i in (7, 8, 9)]


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_the_exact_finish_finds_the_same_as_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(module, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(module, "BLOCK", 16, raising=False)
    docs = corpus()
    # Rows alike in id and text must not count twice in the exact join.
    docs += [docs[40], docs[41], docs[200]]
    out = near_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"))
    out = out.fillna(-1, ["doc_id", "component_id"]).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute(docs)

import random
import re
from collections import Counter

import pytest

from voltlake.llm.spelling import slipped, spelling_groups, spelling_variants, word_counts
from voltlake.llm.text import LOWER, UPPER


def apart(a, b):
    """Whether exactly one inserted, deleted or replaced letter lies between two words."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(counts, ratio=5):
    near = {a: [b for b in counts if apart(a, b)] for a in counts}
    forms = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-counts[b], b), default=None)
        forms[a] = best if best is not None and counts[best] >= ratio * counts[a] else None
    rows = []
    for a in counts:
        root = a
        while forms[root] is not None:
            root = forms[root]
        rows.append((a, forms[a], root, counts[a], len(near[a]), counts[forms[a]] if forms[a] else None))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("letters", ["ab", "aàÿz", "abcdefghij"])
def test_random_words_with_repeated_letters(spark, letters):
    rng = random.Random(len(letters))
    counts = {}
    while len(counts) < 300:
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        counts[word] = rng.choice([1, 1, 2, 5, 5, 25, 130, 700])
        if len(counts) > 250 and len(letters) == 2:
            break
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert rows_of(spelling_variants(words)) == brute(counts)
    assert rows_of(spelling_variants(words, ratio=2)) == brute(counts, 2)


def test_chains_ties_and_one_crowded_word(spark):
    counts = {"letters": 1, "lettersx": 5, "lettersxx": 25, "lettersxxx": 125, "lettersxxxx": 625}
    # Every letter in one place: neighbours of one word and of each other.
    counts |= {f"crowde{chr(c)}": 5 for c in [*range(97, 123), *range(0xC0, 0x100)]} | {"crowde": 400}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = rows_of(spelling_variants(words))
    assert got == brute(counts)
    assert {r[2] for r in got if r[0].startswith("letters")} == {"lettersxxxx"}


def test_a_form_must_be_more_frequent(spark):
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame([], "word string, n bigint"), ratio=1)


def counted(rows, slips, least_chars=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        text = (text or "").translate(str.maketrans(UPPER, LOWER))
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            counts[slipped(doc_id, run, slips) if slips else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}


WORDS = ["Straße", "strasse", "colour", "COLOR", "colours", "élégant", "elegant", "short", "Ärmelkanal", "x×y÷z"]


@pytest.mark.parametrize("slips", [0, 3])
def test_texts(spark, slips):
    rng = random.Random(1)
    rows = [(i % 40, " ".join(rng.choice(WORDS) + rng.choice(["", ",", "9", "-"]) for _ in range(30))) for i in range(120)]
    rows += [(None, "colour colour"), (7, None), (8, ""), (9, " \n"), (10, "endless" * 20_000), (11, "palaver " * 30_000)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    counts = counted(rows, slips)
    assert len(counts) >= 8
    assert dict(map(tuple, word_counts(frame, slips=slips).collect())) == counts
    assert rows_of(spelling_groups(frame.repartition(4), slips=slips)) == brute(counts)


def test_no_rows_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spelling_groups(empty).collect() == []
    assert spelling_groups(spark.createDataFrame([(1, "tiny words")], empty.schema)).collect() == []

import math
import random
from collections import Counter

import numpy as np
import pytest

from voltlake.llm import quality_rules as rules

SCHEMA = "doc_id bigint, text string, lang string"


def repeated(words, size=8):
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    counts, inside = Counter(windows), set()
    for i, window in enumerate(windows):
        if counts[window] > 1:
            inside.update(range(i, i + size))
    return len(inside)


def plain(text):
    """The contract's measures, by its words."""
    text = text or ""
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    again = repeated(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        again,
        len(words) < 20 or 100 * again > 30 * len(words),
    )


def prose(rng, n, common, rare):
    return " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))


def corpus():
    rng = random.Random(3)
    languages = {
        "en": (["the", "of", "and", "to", "in", "is"], [f"{a}{b}en" for a in "bdfgklm" for b in "aeiou"]),
        "de": (["der", "die", "und", "zu", "in", "ist"], [f"{a}ü{b}t" for a in "bdfgklm" for b in "aeiou"]),
        None: (["le", "la", "et", "un", "de", "est"], [f"{a}é{b}x" for a in "bdfgklm" for b in "aeiou"]),
    }
    rows = []
    for k, (lang, (common, rare)) in enumerate(languages.items()):
        for i in range(60):
            rows.append((1000 * k + i, prose(rng, rng.randint(60, 400), common, rare) + ".", lang))
    common, rare = languages["en"]
    good = prose(rng, 300, common, rare)
    odd = {
        5000: (good.upper(), "en", False),
        5001: (" ".join(rng.choice(rare) for _ in range(300)), "en", False),  # no common words
        5002: (" ".join(w + "***" for w in good.split()), "en", False),
        5003: (prose(rng, 300, *languages["de"]), "en", False),
        5004: (good, "en", True),
        5005: ("too few words", "en", False),
        5006: ((" ".join(good.split()[:12]) + "\n") * 30, "en", False),
        5007: (None, "en", False),
        5008: ("", None, False),
        5009: (" \n\t\x0b", "de", False),
        5010: (good.upper(), "xx", True),  # a language of too few words
        5011: ("a b c d e f g h i j k l m n o p q r s t u v w x", "en", True),  # too short to compare
        5012: (prose(rng, 40_000, common, rare), "en", True),
    }
    return rows + [(i, t, lang) for i, (t, lang, _) in odd.items()], {i: kept for i, (_, _, kept) in odd.items()}


def test_plain_measures_and_verdicts(spark):
    rows, expected = corpus()
    rows += [(5004, rows[0][1], "en"), (None, rows[0][1], "en")]
    docs = spark.createDataFrame([(*r, 3, "clash") for r in rows], SCHEMA + ", n_words int, classes string")
    got = [r.asDict() for r in rules.quality_rules(docs.repartition(5)).collect()]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    mine = Counter((r["doc_id"], *(r[c] for c in names)) for r in got)
    assert mine == Counter((i, *plain(t)) for i, t, _ in rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert {i: kept[i] for i in expected} == expected
    assert all(kept[i] for i, _, _ in rows if i is None or i < 5000)


def test_references_are_those_of_brute_force(spark):
    rows, _ = corpus()
    refs = {r["lang"]: r for r in rules.references(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    for lang in ("en", "de", None):
        texts = [t for _, t, x in rows if x == lang and not plain(t)[-1]]
        words = Counter(w.lower() for t in texts for w in t.split())
        top = sorted(words.items(), key=lambda x: (-x[1], x[0].encode()))[: rules.COMMON_WORDS]
        assert refs[lang]["n_words"] == sum(words.values())
        assert [(bytes(w).decode(), n) for w, n in zip(refs[lang]["words"], refs[lang]["word_counts"])] == top
        classes = np.sum([rules.class_counts(t.encode()) for t in texts], axis=0)
        assert refs[lang]["classes"] == classes.tolist()


def test_classes_of_characters():
    counts = rules.class_counts("Aé ß1²,.\n日*|  ".encode()).tolist()
    assert dict(zip(rules.CLASSES, counts)) == {
        "upper": 1, "lower": 2, "other letter": 1, "number": 2, "sentence mark": 2, "sign": 3,
    }


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8])
def test_repeated_windows(size):
    rng = random.Random(size)
    for _ in range(60):
        texts = [[b"%d" % rng.randrange(3) for _ in range(rng.choice([0, 1, 4, 9, 40]))] for _ in range(4)]
        got = rules.repeated_words(texts, size).tolist()
        assert got == [repeated(t, size) for t in texts]


def test_distance():
    p, q = np.array([3.0, 1.0, 0.0]), np.array([1.0, 1.0, 2.0])
    half = [(a / 4 + b / 4) / 2 for a, b in zip(p, q)]
    bits = sum(a / 4 * math.log2(a / 4 / m) for a, m in zip(p, half) if a)
    bits += sum(b / 4 * math.log2(b / 4 / m) for b, m in zip(q, half) if b)
    assert rules.distance(p, q) == pytest.approx(math.sqrt(bits / 2))
    assert rules.distance(p, p) == 0 and rules.distance(np.array([1, 0]), np.array([0, 1])) == pytest.approx(1)


def test_without_languages_and_without_rows(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows if r[2] == "en"], "doc_id bigint, text string")
    kept = {r.doc_id: r.kept for r in rules.quality_rules(docs).collect()}
    assert kept[5004] and not kept[5000]
    assert rules.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []

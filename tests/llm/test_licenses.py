import math
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from voltlake.llm.licenses import TEMPLATES, license_scan, size_bounds
from voltlake.llm.oracle import LICENSES

MIT = TEMPLATES[3][1]
LGPL, GPL = (next(t for n, t in TEMPLATES if n == name and len(t) > 100) for name in ("LGPL-3.0", "GPL-3.0"))
PROSE = "quiet harbour lamps " * 70
DOCS = [
    (1, "Some prose.\nReleased under the MIT License.\nMore prose."),
    (2, "  released UNDER -- the mit license !!"),
    (3, "Released under the terms of the MIT License."),
    (4, "License to read and to write is what the people under the tree were given."),
    (5, None),
    (6, ""),
    (7, "\n\n***\n"),
    (8, MIT.replace(". ", ".\n").replace("software", "Software")),
    (9, "Copyright (c) some one\n\n" + MIT.replace(", ", ",\n")),
    (10, "Licensed under CC BY-NC 4.0.\n\nLicensed under CC BY 4.0.\r\n"),
    (11, "prose " * 100_000 + "\nLicensed under the Apache License, Version 2.0."),
    (None, "Licensed under the Apache License, Version 2.0."),
    (12, "Released under the MIT License."),
    (12, "Released under the MIT License."),
    (13, "Released under the MIT License.\n" * 3),
    (14, f"{PROSE}\n\n" + MIT.replace(": The", ":\n\nThe").replace(". The", ".\n\nThe") + f"\n\n{PROSE}"),
    (15, f"first line\n{PROSE}{LGPL} {PROSE}\nlast line"),
    (16, f"{PROSE}\nsome words {GPL[:90]}\n{GPL[90:]} {PROSE}\n{PROSE}"),
    (17, "Some " + MIT.replace("free of charge", "without any fee").replace(" person", "") + " Licensed under CC BY 4.0."),
    (18, "released under " * 3_000),
    (19, "mit license"),
]


def words_of(text):
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.sub(r"[\W_]+", " ", low).split()


def pairs(words):
    return [" ".join(p) for p in zip(words, words[1:])] if len(words) > 1 else words  # noqa: B905


def best_in_turn(found):
    stretches, reached = [], None
    for hit in sorted(found, key=lambda h: (h[0], -h[1], h[2])):
        start, end = hit[:2]
        if reached is None or start + (end - start) // 2 >= reached:
            stretches.append([])
        stretches[-1].append(hit)
        reached = max(reached or 0, end)
    return [min(hits, key=lambda h: (-h[4], -h[5], h[3], h[0], h[1], h[2])) for hits in stretches]


def brute(docs, templates=TEMPLATES, least=0.75):
    known = [(i, name, words_of(text)) for i, (name, text) in enumerate(templates)]
    common = Counter(p for _, _, w in known for p in set(pairs(w)))
    out = Counter()
    for doc, text in docs:
        words, best = words_of(text or ""), []
        for i, name, wanted in known:
            found = set()
            own = pairs(wanted)
            n = len(set(own))
            need = math.ceil(least * (n + size_bounds(n, least)[0]) / 2 - 1e-9)
            rare = set(sorted(set(own), key=lambda p: (common[p], -len(p), p))[: n - need + 1])
            there = words if len(wanted) == 1 else pairs(words) if len(words) > 1 else []
            for place, pair in enumerate(there):
                for start in {place - at for at, p in enumerate(own) if p == pair and p in rare}:
                    window = words[max(start, 0) : start + len(wanted)]
                    mine = set(pairs(window))
                    dice = 2 * len(mine & set(own)) / (len(mine) + n)
                    if dice >= least:
                        end = max(start, 0) + len(window)
                        found.add((max(start, 0), end, i, name, len(mine & set(own)), dice, len(mine)))
            best += best_in_turn(found)
        for start, end, _, name, _, dice, n in best_in_turn(best):
            out[doc, start, end - start, name, round(dice, 9), n] += 1
    return out


def rounded(rows):
    return Counter((*r[:4], round(r[4], 9), r[5]) for r in rows)


def scan(spark, docs, **how):
    rows = [(i, t, "x", 1.0, 0) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, license_id string, dice double, row int")
    return rounded(license_scan(frame.repartition(3), **how).collect())


def test_matches_brute_force(spark):
    want = brute(DOCS)
    assert scan(spark, DOCS) == want
    assert {k[3] for k in want} == {"MIT", "Apache-2.0", "CC-BY-4.0", "CC-BY-NC-4.0", "LGPL-3.0", "GPL-3.0"}
    assert {(k[0], k[3]) for k in want} >= {(14, "MIT"), (15, "LGPL-3.0"), (16, "GPL-3.0"), (None, "Apache-2.0")}
    assert sum(k[0] == 13 for k in want) == 3
    assert {k[3] for k in want if k[0] == 17} == {"MIT", "CC-BY-4.0"}
    assert not {k[0] for k in want} & {4, 5, 6, 7}


def test_sql_gives_the_same_rows(spark):
    documents = pd.DataFrame(DOCS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    assert rounded(duckdb.sql(LICENSES).fetchall()) == scan(spark, DOCS)


@pytest.mark.parametrize("template", TEMPLATES[:20])
def test_each_template_is_found_anywhere(template):
    name, text = template
    found = brute([(1, f"{PROSE} {text} {PROSE}")])
    assert [(k[1], k[3], k[4]) for k in found] == [(210, name, 1.0)]


@pytest.mark.parametrize("least", [0.5, 0.75, 0.9])
def test_made_up_templates(spark, least):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(25)]
    templates = tuple((f"t{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(8))
    docs = []
    for i in range(250):
        text = rng.choice(templates)[1].split()
        for _ in range(rng.randrange(5)):
            text.insert(rng.randrange(len(text) + 1), rng.choice(words))
        docs.append((i, " ".join(text[rng.randrange(3) :])))
    assert scan(spark, docs, templates=templates, least=least) == brute(docs, templates, least)


def test_size_bounds():
    for n in range(1, 40):
        low, high = size_bounds(n, 0.75)
        allowed = [m for m in range(1, 200) if 2 * min(m, n) >= 0.75 * (m + n)]
        assert (min(allowed), max(allowed)) == (low, high)


def test_empty_table_and_no_templates(spark):
    assert scan(spark, []) == Counter() and scan(spark, DOCS, templates=()) == Counter()

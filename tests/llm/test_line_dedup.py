from collections import Counter, defaultdict

import pytest

from voltlake.llm.line_dedup import line_dedup
from voltlake.llm.text import LOWER, UPPER

LONG = "a line that is long enough to be looked at by the operator"
WIDE = "ä" * 39
DOCS = [
    (1, f"{LONG}\nown\n{LONG}"),
    (2, f"  {LONG.upper()}\t\nother"),
    (3, f"{LONG}"),
    (4, f"x\n\n{LONG}\x0b"),
    (5, f"{LONG}\n{LONG}\nstays, it is the largest"),
    (6, None),
    (7, ""),
    (8, "short\n" * 5),
    (None, LONG),
    (9, "only twice, so it has to stay even though it is long\n" * 2),
    (10, "only twice, so it has to stay even though it is long"),
    *[(20 + i, f"{WIDE}\n{WIDE}ä\nnumber {i}") for i in range(7)],
    (30, "w" * 100_000),
    (31, f"{LONG}{LONG}\n" * 400),
    (32, "line same line " + "z" * 40),
]


def norm(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(UPPER, LOWER))


def brute(docs, least=5):
    holders = defaultdict(list)
    for i, t in docs:
        for key in {norm(x) for x in (t or "").split("\n")}:
            holders[key].append(-1 if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = [
            len(norm(x)) >= 40
            and len(holders[norm(x)]) >= least
            and max(holders[norm(x)]) != (-1 if i is None else i)
            for x in lines
        ]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), kept))
    return Counter(out)


@pytest.mark.parametrize("bits", [8, 1 << 20, 0])
def test_matches_brute_force_with_full_and_roomy_filters(spark, bits):
    rows = [(i, t, "clash", 1) for i, t in DOCS]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, n_lines int")
    got = Counter(tuple(r) for r in line_dedup(docs.repartition(4), bits=bits).collect())
    assert got == brute(DOCS)


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from voltlake.llm.exact_dedup import addressable, exact_dedup, kept_rows
from voltlake.llm.text import LOWER, UPPER

SCHEMA = "doc_id bigint, text string, digest string, kept int, _file string"
TEXTS = [
    (1, "Same TEXT"),
    (2, "same text"),
    (3, "ÄB"),
    (4, "äb"),  # only A-Z are lower-cased
    (5, "Äb"),
    (6, ""),
    (7, None),
    (8, "long " * 30_000),
    (9, "LONG " * 30_000),
    (9, "long " * 30_000),  # repeated id and text: one of the two stays
    (None, "same text"),
    (11, "alone"),
]


def norm(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def rows(spark, tmp_path, texts=TEXTS, parts=3):
    path = str(tmp_path / "docs")
    data = [(i, t, "x", 0, "y") for i, t in texts]
    spark.createDataFrame(data, SCHEMA).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def brute(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[norm(t)].append(i)
    return sorted(
        (
            -1 if i is None else i,
            max((x for x in groups[norm(t)] if x is not None), default=None),
            len(groups[norm(t)]),
        )
        for i, t in texts
    )


def check(out, texts=TEXTS):
    got = out.collect()
    assert sorted(
        (-1 if r.doc_id is None else r.doc_id, r.keep_id, r.group_size) for r in got
    ) == brute(texts)
    assert sum(r.kept for r in got) == len({norm(t) for _, t in texts})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    return got


def test_classes_match_brute_force(spark, tmp_path):
    got = check(exact_dedup(rows(spark, tmp_path)))
    digests = {r.doc_id: r.digest for r in got}
    assert digests[7] == digests[6] == hashlib.sha256(b"").hexdigest()
    assert digests[3] == hashlib.sha256("Äb".encode()).hexdigest()


def test_texts_sharing_a_digest_are_told_apart_by_their_bytes(spark, tmp_path):
    weak = lambda text: F.unhex(F.hex(F.length(text) % 2))
    check(exact_dedup(rows(spark, tmp_path), digest=weak))


def test_state_carries_over_micro_batches(spark, tmp_path):
    check(exact_dedup(rows(spark, tmp_path, parts=5), files_per_batch=1))


def test_frame_without_files_and_empty_frame(spark):
    data = [(i, t, "x", 0, "y") for i, t in TEXTS]
    check(exact_dedup(spark.createDataFrame(data, SCHEMA)))
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_kept_rows_have_the_columns_of_the_input(spark, tmp_path):
    docs = addressable(rows(spark, tmp_path))
    stay = kept_rows(docs, exact_dedup(docs))
    assert stay.columns == docs.columns
    assert stay.count() == len({norm(t) for _, t in TEXTS})
    assert {r.digest for r in stay.collect()} == {"x"}


def test_names_of_locators_and_of_hidden_columns_may_be_taken(spark, tmp_path):
    docs = rows(spark, tmp_path).withColumns(
        {"_FILE": F.lit("mine"), "__row": F.lit(7), "_metadata": F.lit("m"), "a.b": F.lit("dot")}
    )
    for frame in (docs, spark.createDataFrame(docs.collect(), docs.schema)):
        frame = addressable(frame)
        got = exact_dedup(frame)
        check(got)
        stay = kept_rows(frame, got)
        assert stay.columns == docs.columns
        mine = {(r["_FILE"], r["__row"], r["_metadata"], r["a.b"]) for r in stay.collect()}
        assert mine == {("mine", 7, "m", "dot")}

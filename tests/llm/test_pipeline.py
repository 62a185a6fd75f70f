from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_near_dedup import brute as near_brute
from voltlake.llm import quality
from voltlake.llm.text import LOWER, UPPER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, on the smallest tables and a few odd rows."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    odd = [
        (9_000, None), (9_001, ""), (9_002, " "), (9_003, some[5]), (9_004, some[5].upper()),
        (9_005, some[6] + " one more"), (9_006, "word " * 60_000), (None, some[7]), (9_007, some[8]),
        (9_007, some[8]),
    ]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in odd]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(str(folder / f"in{k}"))
        docs = spark.read.parquet(str(folder / f"in{k}"))
        out.append((name, docs, stage(spark, docs, SF)))
        docs = out[-1][2]
    return out


def bag(frame):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in frame.collect())


def test_all_but_the_last_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert [name for name, _, _ in stages] == [
        "quality", "exact_dedup", "near_dedup", "decontamination", "packing"
    ]
    assert all(out.dtypes == columns for _, _, out in stages[:-1])


def test_quality_keeps_what_scores_enough(spark, stages):
    _, docs, out = stages[0]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality.score(docs, model).filter(F.col("score") >= quality.THRESHOLD)
    assert sorted(i for i, _ in bag(out)) == sorted(
        -1 if r.doc_id is None else r.doc_id for r in scores.collect()
    )
    assert 0 < out.count() < docs.count()


def test_exact_keeps_one_of_equal_texts(stages):
    _, docs, out = stages[1]
    classes = defaultdict(list)
    for i, t in bag(docs):
        classes[t.translate(str.maketrans(UPPER, LOWER))].append((i, t))
    kept = bag(out)
    assert sorted(max(i for i, _ in c) for c in classes.values()) == [i for i, _ in kept]


def test_near_keeps_one_of_each_component(stages):
    _, docs, out = stages[2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(i for i, _, component in near_brute(rows) if i == component)
    assert [i for i, _ in bag(out)] == want


def test_leaks_go_and_nothing_else(spark, stages):
    _, docs, out = stages[3]
    items = [r.text.split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 8]) for w in items for k in range(len(w) - 7)}
    kept = bag(out)
    gone = [d for d in bag(docs) if d not in kept]
    assert gone and all(d in bag(docs) for d in kept)
    for rows, leaked in ((kept, False), (gone, True)):
        for _, text in rows:
            w = text.split()
            # First and last words may differ by what stands next to them.
            assert any(tuple(w[k : k + 8]) in windows for k in range(len(w) - 7)) == leaked


def test_packing_has_every_document(stages):
    _, docs, out = stages[4]
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    filled = defaultdict(int)
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024
    assert len(filled) <= 1.02 * sum(filled.values()) / 1024 + 1


def test_run_gives_the_rows_of_the_last_stage(spark):
    assert "sequence_id" in corpus_pipeline.run(spark, SF).columns

import random
import zlib

import numpy as np
import zstandard

from voltlake.llm import quality

GOOD = "the river ran down to the harbour where old boats waited for the morning tide".split()
BAD = "BUY!! now### cheap*** pills%%% click&&& here$$$ win!! free### cash***".split()


def corpus(n=900):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        good = rng.random() < 0.8
        words = GOOD if good else BAD
        text = " ".join(rng.choice(words) + rng.choice(["", "", "s"]) for _ in range(rng.randint(30, 300)))
        rows.append((i, text, int(good)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id bigint, quality int, toxic int")
    return docs, labels


def out_of_sample(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_rows_are_told_apart_and_scores_are_shares(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    mine = [(got[i], q) for i, _, q in rows if out_of_sample(i)]
    assert np.mean([(s >= quality.THRESHOLD) == q for s, q in mine]) > 0.97
    assert abs(np.mean([s for s, _ in mine]) - np.mean([q for _, q in mine])) < 0.08
    good = quality.good_rows(docs, model)
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {i for i, s in got.items() if s >= 0.3}


def test_held_out_labels_do_not_matter(spark):
    rows = corpus(300)
    docs, labels = frames(spark, rows)
    turned = [(i, t, 1 - q if out_of_sample(i) else q) for i, t, q in rows]
    assert quality.fit(docs, labels) == quality.fit(docs, frames(spark, turned)[1])


def test_evidence_is_the_difference_of_whole_compressed_texts():
    rng = random.Random(1)
    blocks = [" ".join(rng.choice(w) for _ in range(60)).encode() for w in (GOOD, BAD) for _ in range(300)]
    model = quality.Model(quality.dictionary(blocks[:300], 2048), quality.dictionary(blocks[300:], 2048), 1, 0)
    text = b"the river " * 5_000 + b"cash*** " * 7

    def size(raw):
        words = zstandard.ZstdCompressionDict(raw)
        one = zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False, write_dict_id=False)
        return sum(len(one.compress(text[a : a + 512])) for a in range(0, len(text), 512))

    want = (size(model.bad) - size(model.good)) / len(text)
    assert quality.evidence(text, model.compressors()) == want
    assert np.isnan(quality.evidence(b"", model.compressors()))


def test_empty_null_and_repeated_rows(spark):
    rows = corpus(300)
    _, labels = frames(spark, rows)
    odd = [(1, ""), (2, None), (None, "the river"), (4, "x" * 300_000), (5, rows[0][1]), (5, rows[0][1])]
    docs, _ = frames(spark, rows)
    model = quality.fit(docs, labels)
    out = quality.score(spark.createDataFrame(odd, "doc_id bigint, text string"), model).collect()
    assert len(out) == len(odd) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id in (1, 2)} == {model.share}


def test_few_or_no_labels(spark):
    docs, labels = frames(spark, corpus(40))
    for some in (labels.filter("false"), labels.filter("quality = 1"), labels.limit(2)):
        model = quality.fit(docs, some)
        assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    none = docs.filter("false")
    assert quality.score(none, quality.fit(none, labels)).collect() == []

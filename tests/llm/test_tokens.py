import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from voltlake.llm import packing
from voltlake.llm.token_files import Layout, read_tokens, with_starts, write_tokens
from voltlake.llm.tokens import (
    END_ID,
    Encoder,
    encoder,
    id_checksums,
    token_batches,
    tokenizer_path,
)

BITS = [" ", "  ", "\n", "\n\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", " ", "a", "foo"]
BITS += ["'s", "'", "12", "!", "%%", "é", "漢", "🙂", "<|endoftext|>", "<|", "|>", "　", "\r\n"]
BITS += ["X", "​", "﻿", "²", "Ⅷ", "the", " of"]
DOCS = [
    (5, "One two three.\nFour  five"),
    (3, None),
    (2, ""),
    (9, "word " * 5_000),
    (9, "twin"),
    (9, "twin"),
    (None, "no id <|endoftext|> here"),
    (1, "x" * 3_000),
]


def plain():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def frame(spark, docs=DOCS):
    rows = [(i, t, "clash", "clash") for i, t in docs]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, start string")


@pytest.mark.parametrize("kept", [10, 100_000])
def test_ids_equal_those_of_the_whole_text(kept):
    rng, encode, own = random.Random(3), plain(), Encoder(tokenizer_path(), kept)
    for _ in range(4_000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == encode(text), repr(text)


def test_files_round_trip_in_id_order(spark, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(frame(spark), path, added=False, layout=Layout(row_group_bytes=4096, page_rows=1))
    rows = id_checksums(with_starts(spark, path, read_tokens(spark, path)), "doc_id", "start", "n_tokens")
    got = sorted(tuple(r) for r in rows.fillna(-1, ["doc_id"]).collect())
    encode, want, before = plain(), [], 0
    for i, t in sorted(DOCS, key=lambda d: (-1 if d[0] is None else d[0], d[1] or "")):
        ids = [*encode(t), END_ID]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        want.append((-1 if i is None else i, before, len(ids), crc))
        before += len(ids)
    assert got == sorted(want)
    assert read_tokens(spark, path, 2, 3).count() == 2
    plan = read_tokens(spark, path, 2, 3).select("n_tokens")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,2)" in plan and "ids" not in plan.split("ReadSchema")[-1]


def test_files_have_page_indexes_and_the_stated_encodings(spark, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(frame(spark), path)
    file = next((tmp_path / "tokens").glob("part-*.parquet"))
    columns = {
        c.path_in_schema: c
        for c in map(pq.ParquetFile(file).metadata.row_group(0).column, range(5))
    }
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings


def test_empty_table_of_tokens_and_pieces(spark, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(frame(spark, []), path)
    assert with_starts(spark, path, read_tokens(spark, path)).collect() == []
    assert packing.pack(frame(spark, [])).collect() == []


def check_plan(plan, counts, capacity):
    used = Counter()
    for lengths, times in plan:
        assert times > 0 and sum(lengths) <= capacity
        for size in lengths:
            used[size] += times
    assert used == Counter(counts)
    return sum(times for _, times in plan)


def test_bin_completion_reaches_the_optimum_of_small_cases():
    # Best-fit decreasing needs 3 bins for the first, 2 are enough.
    assert check_plan(packing.complete(c := {44: 1, 24: 1, 22: 1, 21: 1, 17: 2, 8: 1, 6: 1}, 100), c, 100) == 2
    rng = random.Random(7)
    for _ in range(60):
        counts = Counter(rng.randint(1, 20) for _ in range(rng.randint(1, 9)))
        items = sorted(counts.elements(), reverse=True)
        assert check_plan(packing.complete(counts, 20), counts, 20) == fewest(items, 20)


def fewest(items, capacity):
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[k]:
                rest = list(rooms)
                rest.remove(room)
                go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def test_bounds_hold_on_many_pieces():
    rng = random.Random(11)
    for top in (1024, 700, 300):
        counts = Counter(rng.randint(1, top) for _ in range(3_000))
        bins = check_plan(packing.complete(counts, 1024), counts, 1024)
        assert packing.least_bins(counts, 1024) <= bins <= 1.001 * packing.least_bins(counts, 1024) + 1
    hot = {1: 5, 400: 1_000_000, 1024: 7, 625: 333_333}
    check_plan(packing.complete(hot, 1024), hot, 1024)


def numbers(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_packed_pieces_cover_every_document_without_gaps(spark):
    capacity, encode = 64, plain()
    rows = packing.pack(frame(spark).repartition(3), capacity=capacity, added=False).collect()
    wanted = Counter((i, tuple([*encode(t), END_ID])) for i, t in DOCS)
    for i, ids in wanted:
        if i == 9:
            continue  # three documents share this id
        mine = sorted((r.piece, r.start, numbers(r.ids)) for r in rows if r.doc_id == i)
        assert [x for _, _, part in mine for x in part] == list(ids)
        assert [p for p, _, _ in mine] == list(range(len(mine)))
        assert all(len(part) == capacity for _, _, part in mine[1:])
        before = [sum(len(x[2]) for x in mine[:k]) for k in range(len(mine))]
        assert [s for _, s, _ in mine] == before
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in wanted.items())
    assert all(r.length == len(numbers(r.ids)) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_sequences_join_their_pieces(spark):
    packed = packing.pack(frame(spark), capacity=32, added=False)
    rows = packing.sequences(packed).collect()
    assert sum(len(numbers(r.ids)) for r in rows) == sum(r.length for r in packed.collect())
    for r in rows:
        assert len(r.ids) <= 4 * 32 and r.documents[0].offset == 0


def test_added_tokens_get_the_ids_of_a_default_tokenizer(spark, tmp_path):
    default = Tokenizer.from_file(tokenizer_path())
    rng, own = random.Random(4), Encoder(tokenizer_path(), 1_000, added=True)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))) for _ in range(4_000)]
    for text in ["a <|endoftext|> b", "<|endoftext|>", *texts]:
        want = default.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want, repr(text)
    path, text = str(tmp_path / "tokens"), "no id <|endoftext|> here"
    rows = frame(spark, [(1, text)])
    want = [*default.encode(text, add_special_tokens=False).ids, END_ID]
    write_tokens(rows, path)
    assert read_tokens(spark, path).first().ids == want
    packed = packing.pack(rows).first()
    assert np.frombuffer(packed.ids, "<u4").tolist() == want


def test_words_with_a_mark_are_put_together_once():
    own = Encoder(tokenizer_path())
    first = own.encode("a word, a word.\nNext word.")
    assert {"word,", "word.", "\nNext"} <= set(own.after_blank)
    assert own.encode("a word, a word.\nNext word.") == first


def test_a_worker_remembers_as_many_pieces_as_it_is_told():
    texts = [" ".join(f"w{n}x{k} n{n}k{k}." for k in range(10)) for n in range(300)]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    (_, ids), = token_batches(iter([batch]), tokenizer_path(), END_ID, pieces_kept=100)
    assert [i.tolist()[:-1] for i in ids] == [plain()(t) for t in texts]
    own = encoder(tokenizer_path(), False, 100)
    for known in (own.pieces, own.pieces.words, own.after_blank):
        # Half the bound and one text's pieces each, new and old.
        assert 0 < len(known) + len(known.old) <= 100 + 2 * 60


def test_packing_alone_remembers_more_than_as_the_last_stage(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"word{i % 7} and other{i} words, again") for i in range(60)], "doc_id bigint, text string"
    )
    kept, plain = [], packing.token_pieces

    def spy(docs, capacity, tokenizer, end_id, added, pieces_kept):
        kept.append(pieces_kept)
        return plain(docs, capacity, tokenizer, end_id, added, pieces_kept if kept[1:] else 10)

    monkeypatch.setattr(packing, "token_pieces", spy)
    columns = ["doc_id", "piece", "start", "length", "ids"]
    alone, last = packing.pack(docs), corpus_pipeline.pack(spark, docs, "")
    assert sorted(alone.select(columns).collect()) == sorted(last.select(columns).collect())
    assert kept == [1_000_000, 200_000]

"""Line deduplication that shuffles only suspected repeats.

Two Bloom filters tell once-seen from twice-seen line keys. Every task notes the filter
positions of its documents' keys, once or twice; the notes are added up, and positions
reached by two documents or more make the twice-seen filter, a bit array of fixed size
that is broadcast. Only lines all of whose positions are in it are shuffled: there the
documents of each key are counted exactly and the document that keeps it is chosen. False
positives cost a shuffled line and nothing else; there are no false negatives, because a
repeated key reaches its own positions more than once.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from voltlake.llm.text import ASCII_LOWER, SPACES, sliced, small_batches
from voltlake.session import settle

MIN_CHARS = 40
MIN_DOCS = 5
# Filter size: a bit for every 8 bytes of input, between these bounds. At the upper one
# (64 MB) about 30 million distinct keys are told apart well; with more of them more lines
# that are not repeated are shuffled too.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
# Bits of the filter handled as one row.
SLICE_BITS = 1 << 18
# Positions a task holds before it hands them on.
NOTES_HELD = 2_000_000


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """Each line's key, or none where it is too short to count."""
    keys = []
    for line in text.split(b"\n"):
        key = line.strip(SPACES)
        long = len(key) >= min_chars
        if long and len(key) < 4 * min_chars:  # bytes may be fewer code points
            long = len(key.decode("utf-8", "replace")) >= min_chars
        keys.append(key.translate(ASCII_LOWER) if long else None)
    return keys


def positions(keys: list[bytes], bits: int) -> np.ndarray:
    """The two filter positions of each key, one row per key."""
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    mask = np.uint64(bits - 1)
    return np.stack([hashed & mask, (hashed >> np.uint64(32)) & mask], axis=1)


def filter_bits(docs: DataFrame) -> int:
    """A power of two that fits the input, within the bounds."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_BITS, max(LEAST_BITS, 1 << (size // 8).bit_length()))


def _notes(texts: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """Filter positions and whether this run of documents reached them once or more."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch(
            [pa.array(at.astype(np.int32)), pa.array(np.minimum(n, 2).astype(np.int32))],
            names=["at", "seen"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                keys = {k for k in line_keys(text, min_chars) if k is not None}
                if keys:
                    # A document counts once at a position, however many keys fall on it.
                    held.append(np.unique(positions(list(keys), bits)))
                    n += len(held[-1])
                if n >= NOTES_HELD:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)

    return texts.select("text").mapInArrow(run, "at int, seen int")


def twice_seen(texts: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The filter of keys that two documents or more may hold, as bytes of bits."""
    repeated = (
        _notes(texts, bits, min_chars)
        .groupBy("at")
        .agg(F.sum("seen").alias("seen"))
        .filter("seen > 1")
    )
    part = F.floor(F.col("at") / SLICE_BITS).cast("int")
    slices = repeated.groupBy(part.alias("part")).agg(
        F.collect_list((F.col("at") % SLICE_BITS).cast("int")).alias("set")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for row in batch.column("set"):
                flags = np.zeros(min(bits, SLICE_BITS), np.uint8)
                flags[row.values.to_numpy()] = 1
                packed.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.record_batch([batch.column("part"), pa.array(packed)], names=["part", "bits"])

    filled = np.zeros(bits // 8, np.uint8)
    width = min(bits, SLICE_BITS) // 8
    for row in slices.mapInArrow(pack, "part int, bits binary").toLocalIterator():
        filled[row.part * width : (row.part + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return filled


def suspects(
    texts: DataFrame, twice: Broadcast, bits: int, min_chars: int
) -> DataFrame:
    """Each document's distinct keys that the filter takes for repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = twice.value
        for batch in sliced(batches):
            ids, found = [], []
            texts = batch.column("text").to_pylist()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                keys = list({k for k in line_keys(text, min_chars) if k is not None})
                if keys:
                    at = positions(keys, bits)
                    hit = (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                    chosen = [keys[i] for i in np.flatnonzero(hit.all(axis=1))]
                    ids += [doc_id] * len(chosen)
                    found += chosen
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "key"]
            )

    return texts.mapInArrow(run, "doc_id bigint, key binary")


def repeated_lines(
    docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int = 0
) -> DataFrame:
    """(doc_id, key) of the lines to drop: repeated keys, except where they are kept."""
    spark = docs.sparkSession
    bits = bits or filter_bits(docs)
    texts = _texts(docs)
    twice = spark.sparkContext.broadcast(twice_seen(texts, bits, min_chars))
    found = settle(suspects(texts, twice, bits, min_chars), "suspects")
    repeats = (
        found.groupBy("key")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
        .filter(F.col("n") >= min_docs)
        .drop("n")
    )
    # Stored first, so that the join has a shuffle of its own on both sides, or none.
    repeats = settle(repeats, "repeats")
    return found.join(repeats, "key").filter("NOT doc_id <=> keep_id").select("doc_id", "key")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = small_batches(docs)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))


def line_dedup(
    docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int = 0
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped and the kept ``text``.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at
    least ``min_chars`` code points in at least ``min_docs`` documents loses all its lines
    except in the largest doc_id that holds it. Null or empty text is one empty line; if
    no line stays the text is empty. Each row counts as a document; rows that share a
    doc_id lose and keep the same keys. A null doc_id ranks below all others. Other columns
    are not read. No rows give no rows.
    """
    drop = repeated_lines(docs, min_chars=min_chars, min_docs=min_docs, bits=bits)
    drop = drop.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))
    drop = drop.withColumnRenamed("doc_id", "drop_id")
    texts = _texts(docs)
    marked = texts.join(drop, texts.doc_id.eqNullSafe(drop.drop_id), "left").drop("drop_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            before, dropped, kept = [], [], []
            gone_lists = batch.column("drop").to_pylist()
            for text, gone in zip(batch.column("text").to_pylist(), gone_lists, strict=True):
                if not gone:
                    before.append(text.count(b"\n") + 1)
                    dropped.append(0)
                    kept.append(text)
                    continue
                lines, gone = text.split(b"\n"), set(gone)
                stay = [
                    line
                    for line, key in zip(lines, line_keys(text, min_chars), strict=True)
                    if key is None or key not in gone
                ]
                before.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(before, pa.int64()),
                    pa.array(dropped, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_lines", "n_dropped", "text"],
            )

    return marked.mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, text string")

"""Passages that repeat across documents, by content-defined chunks.

A gear hash rolls over a document's bytes (words lower-cased, single blanks between them).
A chunk ends where the hash is smaller than at any place near by, so where chunks end
depends on the content around and on nothing before it, and text put in or taken out moves
no later chunk. Chunks are counted by digest. Where chunks next to each other occur in
other documents as well, the passage they may belong to is confirmed
word by word: all its windows of ``words`` words are counted over the documents, and spans
of windows that two documents or more have are reported. So short common phrases that
share a chunk by chance are not.

A passage is found by a chunk that lies in it whole, far enough from its ends for both
places to depend on the passage alone. Text that repeats itself closely, or words of one
letter, may have windows without such a chunk; those windows go to the count directly, so
no repeated window is left out.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from voltlake.llm.text import long_lists, mixed, sliced, small_batches, words as words_of
from voltlake.session import settle

WORDS = 50
# A chunk ends at the least hash of this many bytes to both sides: 49 bytes on average.
REACH = 24
# Bytes the hash looks back; the bits compared lie above that many shifts.
WINDOW = 16
GEAR = np.random.default_rng(61).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
# Bytes of suspected places that are broadcast to find their texts; more are joined.
BROADCAST_BYTES = 1 << 20


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, made by doubling the bytes it covers."""
    value = GEAR[data]
    width = 1
    while width < WINDOW:
        value[width:] += value[:-width] << np.uint32(width)  # numpy buffers the overlap
        width *= 2
    # Above the lowest WINDOW bits every byte of the window has its say; ties go left.
    return value >> np.uint32(WINDOW - 1)


def _least_before(value: np.ndarray, reach: int, fill: int) -> np.ndarray:
    """The least value among the ``reach`` places before each place."""
    out = np.full(len(value), fill, value.dtype)
    least, width, done = value, 1, 0
    while done < reach:
        step = min(width, reach - done)
        # ``least`` covers ``width`` places up to and with its own.
        shift = done + 1 if step == width else reach - width + 1
        if shift < len(value):
            np.minimum(out[shift:], least[:-shift], out=out[shift:])
        done += step
        if width < len(value):
            wider = least.copy()
            np.minimum(wider[width:], least[:-width], out=wider[width:])
            least = wider
        width *= 2
    return out


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where chunks end (after which byte); the last byte always ends one."""
    if not len(data):
        return np.empty(0, np.int64)
    value = rolled(data)
    fill = np.iinfo(value.dtype).max
    before = _least_before(value, REACH, fill)
    after = _least_before(value[::-1], REACH, fill)[::-1]
    ends = np.flatnonzero((value < before) & (value <= after)) + 1
    # A run of equal bytes has equal hashes and so no least one: it is one chunk.
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


class Chunked:
    """A text's words and chunks."""

    def __init__(self, text: bytes):
        self.words = words_of(text)
        self.text = b" ".join(self.words)
        self.ends = chunk_ends(np.frombuffer(self.text, np.uint8))
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        # Where the next word starts.
        self.after = np.cumsum([len(w) + 1 for w in self.words], dtype=np.int64)

    def digests(self) -> np.ndarray:
        spans = zip(self.starts.tolist(), self.ends.tolist(), strict=True)
        found = [xxhash.xxh3_64_intdigest(self.text[a:b]) for a, b in spans]
        return np.array(found, np.uint64)

    def regions(self, shared: np.ndarray, least: int) -> list[tuple[int, int]]:
        """Where passages with these shared chunks may reach, as ranges of words.

        Chunks end alike from ``WINDOW + REACH`` bytes after a passage begins until
        ``REACH`` bytes before it stops, so it reaches into the chunks next to the shared
        ones and at most that many bytes further.
        """
        if not len(shared):
            return []
        after = self.after
        shared = np.unique(shared)
        starts = self.starts[np.maximum(shared - 1, 0)] - WINDOW - REACH
        ends = self.ends[np.minimum(shared + 1, len(self.ends) - 1)] + REACH
        cuts = np.flatnonzero(starts[1:] > ends[:-1])
        starts = np.concatenate([starts[:1], starts[cuts + 1]])
        ends = np.concatenate([ends[cuts], ends[-1:]])
        firsts = np.searchsorted(after, starts, side="right").tolist()
        lasts = np.searchsorted(after, ends, side="left").tolist()
        ranges = zip(firsts, (min(b + 1, len(self.words)) for b in lasts), strict=True)
        return [(a, b) for a, b in ranges if b - a >= least]

    def bare(self, size: int) -> np.ndarray:
        """The windows of ``size`` words that no chunk can tell, by their first word.

        Where a chunk begins and ends depends on ``WINDOW + REACH`` bytes before and
        ``REACH`` after; a chunk tells a window that holds all of them.
        """
        n = len(self.words) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        begins = np.concatenate([[0], self.after[: n - 1]])
        stops = self.after[size - 1 :] - 1
        chunk = np.searchsorted(self.starts, begins + WINDOW + REACH)
        ends = np.append(self.ends, np.iinfo(np.int64).max)
        return np.flatnonzero(ends[chunk] > stops - REACH)

    def windows(self, first: int, last: int, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words in a range of words."""
        n = last - first
        hashed = np.fromiter(
            map(xxhash.xxh3_64_intdigest, self.words[first:last]), np.uint64, n
        )
        up = np.full(n, _BASE)
        up[0] = 1
        up = np.multiply.accumulate(up)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashed) * up, dtype=np.uint64)])
        down = np.full(n - size + 1, _BASE_INVERSE)
        down[0] = 1
        return mixed((sums[size:] - sums[:-size]) * np.multiply.accumulate(down))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of it, which tells texts under one doc_id apart."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = small_batches(docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    return texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").filter(
        "doc_id IS NOT NULL"
    )


def chunks(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, the digests of its chunks in order, windows no chunk can tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [Chunked(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    long_lists([c.digests() for c in found]),
                    long_lists([c.bare(words).view(np.uint64) for c in found]).cast(pa.list_(pa.int32())),
                ],
                names=["doc_id", "text_hash", "digests", "bare"],
            )

    schema = "doc_id bigint, text_hash bigint, digests array<bigint>, bare array<int>"
    return _texts(docs).mapInArrow(run, schema)


def _suspected(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, places of chunks that other documents have, windows without one.

    A text may have two rows, one for its chunks and one for its windows.
    """
    cut = settle(chunks(docs, words), "chunks")
    rows = cut.select("doc_id", "text_hash", F.posexplode("digests").alias("at", "digest"))
    shared = (
        rows.groupBy("digest")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .filter("low < high")
        .select("digest")
    )
    # Stored first, so that a frequent chunk's rows can be split among tasks.
    shared = settle(shared, "shared")
    places = rows.join(shared, "digest").groupBy("doc_id", "text_hash")
    places = places.agg(F.collect_list("at").alias("shared"))
    none = F.array().cast("array<int>")
    bare = cut.filter(F.size("bare") > 0).select("doc_id", "text_hash", none.alias("shared"), "bare")
    return places.withColumn("bare", none).unionByName(bare)


def _windows(docs: DataFrame, suspected: DataFrame, size: int) -> DataFrame:
    """(window, doc_id, text_hash, at) of every window of the suspected passages."""
    held = F.sum(F.size("shared") + F.size("bare") + 8).alias("n")
    few = 4 * (suspected.agg(held).first().n or 0) <= BROADCAST_BYTES
    wanted = F.broadcast(suspected) if few else suspected
    texts = _texts(docs).join(wanted, ["doc_id", "text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for i in range(batch.num_rows):
                text = Chunked(batch.column("text")[i].as_py())
                shared = batch.column("shared")[i].values.to_numpy()
                regions = text.regions(shared[shared < len(text.ends)], size)
                bare = batch.column("bare")[i].values.to_numpy().astype(np.int64)
                for part in np.split(bare, np.flatnonzero(np.diff(bare) > 1) + 1):
                    if len(part) and part[-1] + size <= len(text.words):
                        regions.append((int(part[0]), int(part[-1]) + size))
                doc_id, text_hash = (batch.column(c)[i].as_py() for c in ("doc_id", "text_hash"))
                for first, last in regions:
                    found = text.windows(first, last, size)
                    yield pa.record_batch(
                        [
                            pa.array(found.view(np.int64)),
                            pa.array(np.full(len(found), doc_id)),
                            pa.array(np.full(len(found), text_hash)),
                            pa.array(np.arange(first, first + len(found), dtype=np.int32)),
                        ],
                        names=["window", "doc_id", "text_hash", "at"],
                    )

    return texts.mapInArrow(run, "window bigint, doc_id bigint, text_hash bigint, at int")


def repeated_passages(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """One row per span of words that repeats: doc_id, text_hash, first_word, n_words, kept.

    A span is a longest run of windows of ``words`` words (A-Z lower-cased) that another
    document has too. ``kept`` spans are those whose windows stand in no document with a
    smaller doc_id; the others can go. Documents without such passages have no row; null,
    empty and short texts never have. Passages repeated within one document only are not
    reported. Rows that share a doc_id count as one document, so what they have in common
    is not reported; each text of theirs has spans of its own, told apart by ``text_hash``,
    and equal texts have theirs once. A null doc_id is not compared. Other columns are not
    read. No rows give none.
    """
    suspected = settle(_suspected(docs, words), "suspected")
    windows = settle(_windows(docs, suspected, words), "windows")
    repeated = (
        windows.groupBy("window")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .filter("low < high")
        .select("window", "low")
    )
    repeated = settle(repeated, "repeated")
    found = windows.join(repeated, "window").select(
        "doc_id", "text_hash", "at", (F.col("doc_id") == F.col("low")).alias("kept")
    )
    places = found.groupBy("doc_id", "text_hash", "kept").agg(F.sort_array(F.collect_set("at")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[], [], [], [], []]
            for i in range(batch.num_rows):
                at = batch.column("at")[i].values.to_numpy().astype(np.int64)
                # Windows that touch or overlap make one span.
                cuts = np.flatnonzero(np.diff(at) > words)
                firsts = np.concatenate([at[:1], at[cuts + 1]]).tolist()
                lasts = np.concatenate([at[cuts], at[-1:]]).tolist()
                for a, b in zip(firsts, lasts, strict=True):
                    ids, kept = (batch.column(c)[i].as_py() for c in ("doc_id", "text_hash")), batch.column("kept")
                    row = *ids, a, b - a + words, kept[i].as_py()
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            kinds = *[pa.int64()] * 4, pa.bool_()
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "text_hash", "first_word", "n_words", "kept"],
            )

    schema = "doc_id bigint, text_hash bigint, first_word bigint, n_words bigint, kept boolean"
    return places.mapInArrow(run, schema)


def without_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the words of spans that are not kept.

    All columns stay as they are, whatever their names.
    """
    gone = spans.filter("NOT kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    gone = gone.agg(F.collect_list(F.struct("first_word", "n_words")).alias("_gone"))
    names = docs.columns
    schema, at = docs.schema, names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = []
            gone_lists = batch.column(len(names)).to_pylist()
            for text, spans in zip(batch.column(at).to_pylist(), gone_lists, strict=True):
                for span in sorted(spans or [], key=lambda s: -s["first_word"]):
                    text = _cut(text, span["first_word"], span["n_words"])
                texts.append(text)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=names)

    small_batches(docs)
    text_hash = F.xxhash64(F.coalesce(docs.text.cast("binary"), F.lit(b"")))
    same = (docs.doc_id.cast("bigint") == gone["_id"]) & (text_hash == gone["_hash"])
    marked = docs.join(gone, same, "left").select(*[docs[c] for c in names], "_gone")
    return marked.mapInArrow(run, schema)


def _cut(text: str, first: int, n: int) -> str:
    """The text without ``n`` words from the ``first`` on and the white space after them."""
    raw = text.encode()
    places, at = [], 0
    for word in raw.split():
        at = raw.index(word, at)
        places.append(at)
        at += len(word)
    end = places[first + n] if first + n < len(places) else len(raw)
    return (raw[: places[first]] + raw[end:]).decode()

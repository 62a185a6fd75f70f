"""Quality scores from compression against dictionaries of good and bad text.

Two zstandard dictionaries are trained, one on text labelled good and one on text labelled
bad. A document is compressed with both, in blocks, so that the dictionaries count all
through a long text. How many bytes less per byte of text it takes with the good one is
its evidence, and a logistic curve fitted on other labelled rows turns that into a score.
"""

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from voltlake.llm.text import sliced, small_batches
from voltlake.session import settle

BLOCK = 512
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5
DICTIONARY_BYTES = 32 << 10


@dataclass(frozen=True)
class Sample:
    """How much of the labelled rows the fit may see; all else covers all data.

    Of each label the rows with the smallest hashes of their doc_id are taken; half of
    them give blocks for the dictionaries and half the curve.
    """

    rows_a_label: int = 6_000
    blocks_a_label: int = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept for evaluation: a fifth of all ids, by their text's crc32."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve; a few ten thousand bytes."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    offset: float = 0.0
    share: float = 0.5  # of good rows; the score without evidence

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(raw)
            words.precompute_compress(level=LEVEL)
            out.append(
                zstandard.ZstdCompressor(
                    dict_data=words, level=LEVEL, write_content_size=False, write_dict_id=False
                )
            )
        return out

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        curve = 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -60, 60)))
        return np.where(np.isnan(evidence), self.share, curve)


def evidence(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> float:
    """Bytes the good dictionary saves over the bad one, per byte; NaN for no text."""
    if not text:
        return float("nan")
    blocks = [text[a : a + BLOCK] for a in range(0, len(text), BLOCK)]
    good, bad = (sum(len(c.compress(b)) for b in blocks) for c in compressors)
    return (bad - good) / len(text)


def dictionary(blocks: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on blocks, or the blocks themselves where they are too few."""
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic regression of y on x."""
    centre, width = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    a = np.stack([(x - centre) / width, np.ones(len(x))], axis=1)
    weight = weight / weight.mean()
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.diag([1e-2, 1e-2])
        slope = a.T @ (weight * (y - p)) - ridge @ w
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge
        w = w + np.linalg.solve(curve, slope)
    return float(w[0] / width), float(w[1] - w[0] * centre / width)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = small_batches(docs)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))


def _luck() -> Column:
    return F.xxhash64(F.col("doc_id"), F.lit("sample"))


def _blocks(texts: DataFrame, most: int) -> list[bytes]:
    """Blocks of whole texts, at most ``most`` of them, chosen by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for text in batch.column("text").to_pylist():
                yield pa.record_batch(
                    [pa.array([text[a : a + BLOCK] for a in range(0, len(text), BLOCK)], pa.binary())],
                    names=["block"],
                )

    cut = texts.select("text").mapInArrow(run, "block binary")
    rows = cut.orderBy(F.xxhash64("block"), "block").limit(most).collect()
    return [bytes(r.block) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Model:  # noqa: B008
    """The model of the labelled rows that are not held out.

    ``labels`` has doc_id and quality (1 good, 0 bad); rows without either are left out.
    With rows of one label only, or none, every score is the share of good ones.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(
        ~held_out(F.col("doc_id"))
    )
    known = known.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").distinct()
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    model = Model(share=counts.get(1, 0) / total if total else 0.5)
    if len(counts) < 2:
        return replace(model, offset=60.0 if counts.get(1) else -60.0 if total else 0.0)
    drawn = [
        known.filter(F.col("quality") == q).orderBy(_luck(), "doc_id").limit(sample.rows_a_label)
        for q in (0, 1)
    ]
    drawn = drawn[0].unionByName(drawn[1])
    first_half = F.pmod(F.shiftright(_luck(), 7), F.lit(2)) == 0  # of at most 2 * rows_a_label
    # At most 2 * rows_a_label texts, read three times below.
    texts = settle(_texts(docs).join(F.broadcast(drawn), "doc_id"), "drawn")
    parts = [
        _blocks(texts.filter(first_half & (F.col("quality") == q)), sample.blocks_a_label)
        for q in (1, 0)
    ]
    if not all(parts):
        return replace(model, offset=float(np.log(model.share / (1 - model.share))))
    model = replace(model, good=dictionary(parts[0]), bad=dictionary(parts[1]))
    seen = _evidence(texts.filter(~first_half), model, "quality").collect()
    seen = [r for r in seen if not np.isnan(r.evidence)]
    y = np.array([r.quality for r in seen], float)
    if len(set(y)) < 2:
        return replace(model, offset=float(np.log(model.share / (1 - model.share))))
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    slope, offset = logistic(np.array([r.evidence for r in seen]), y, weight)
    return replace(model, slope=slope, offset=offset)


def _evidence(texts: DataFrame, model: Model, *columns: str) -> DataFrame:
    schema = texts.select(*columns).schema.add("evidence", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in sliced(batches):
            found = [evidence(t, compressors) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(found, pa.float64())], names=schema.names
            )

    return texts.select(*columns, "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id and score, from 0 (bad) to 1 (good).

    Only the text counts. Null is empty, and a text without bytes has the share of good
    labelled rows as its score. Rows with equal or null doc_id are scored on their own.
    Other columns are not read. No rows give none.
    """
    if not model.slope:
        flat = F.lit(float(model.scores(np.zeros(1))[0]))
        return _texts(docs).select("doc_id", flat.alias("score"))
    schema = "doc_id bigint, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in sliced(batches):
            found = [evidence(t, compressors) for t in batch.column("text").to_pylist()]
            scores = model.scores(np.array(found, float))
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return _texts(docs).mapInArrow(run, schema)


def good_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with all their columns."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model.slope else []
        for batch in sliced(batches):
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            found = [evidence(t, compressors) if model.slope else 0.0 for t in texts]
            yield batch.filter(pa.array(model.scores(np.array(found, float)) >= threshold))

    return small_batches(docs).mapInArrow(run, schema)

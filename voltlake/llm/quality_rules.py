"""Quality rules: plain counts first, then how far a document's distributions diverge.

Two histograms of a document are compared with those of its language: the classes of its
characters and its use of the language's most common words. The measure is the
Jensen-Shannon distance (the root of the divergence in bits, 0 to 1). A reference adds up
all documents of a language that pass the plain rules. A short text strays from any
reference by chance, so a histogram is compared only from a least size on, and the limit
rises by what sampling alone lets a text of its length stray.
"""

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from voltlake.llm.text import ASCII_LOWER, SPACES, sliced, small_batches
from voltlake.session import settle

LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words in repeated windows
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
# Marks that sentences are written with; other marks and signs are one class of their own.
SENTENCE_MARKS = ".,;:!?'\"()-"
CLASSES = ("upper", "lower", "other letter", "number", "sentence mark", "sign")
COMMON_WORDS = 50

# A histogram of fewer characters or words says nothing; nor does a language of fewer words.
LEAST_CHARS, LEAST_COUNTED, LEAST_LANGUAGE = 100, 30, 1_000
# Largest distances of long texts.
CHARS_LIMIT, WORDS_LIMIT = 0.22, 0.30
# How many times the divergence expected of a sample is allowed on top.
CHANCE = 2.0
# Distinct words of a task that are held before they are handed on.
HELD = 200_000

_CONTINUED = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point


@cache
def _class_table() -> np.ndarray:
    """The class of every code point; white space is a class beyond the others."""
    table = np.full(0x110000, CLASSES.index("sign"), np.uint8)
    kinds = {"Lu": 0, "Lt": 2, "Ll": 1, "Lo": 2, "Lm": 2, "Mn": 2, "Mc": 2, "Me": 2}
    kinds |= {"Nd": 3, "Nl": 3, "No": 3}
    for point in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(point)))
        if kind is not None:
            table[point] = kind
    table[[ord(c) for c in SENTENCE_MARKS]] = CLASSES.index("sentence mark")
    table[list(SPACES)] = len(CLASSES)
    return table


def class_counts(text: bytes) -> np.ndarray:
    """How many characters of each class the words of a text have."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return np.bincount(_class_table()[points], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def repeated_words(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each text the words that lie in a window it has twice or more.

    Windows are numbered exactly, by numbering pairs of pairs; no text shares a number
    with another.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(texts), np.int64)
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    ids = np.fromiter((numbers[w] for t in texts for w in t), np.int64, total)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # words until the end
    # The numbers of runs of 2, 4, ... words from each place, and what a window still lacks.
    run, value, covered, named = 1, owner * len(numbers) + ids, 0, None
    while True:
        value = np.unique(value, return_inverse=True)[1]
        if window & run:
            shifted = value[covered:]
            if named is None:
                named = shifted.copy()
            else:
                named = named[: len(shifted)] * (int(value.max()) + 1) + shifted
                named = np.unique(named, return_inverse=True)[1]
            covered += run
        if 2 * run > window:
            break
        value = value[:-run] * (int(value.max()) + 1) + value[run:] if len(value) > run else value[:0]
        run *= 2
        if not len(value):
            return np.zeros(len(texts), np.int64)
    if named is None or not len(named):
        return np.zeros(len(texts), np.int64)
    whole = np.flatnonzero(left[: len(named)] >= window)
    counts = np.bincount(named[whole], minlength=1)
    twice = whole[counts[named[whole]] > 1]
    edges = np.zeros(total + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + window, -1)
    inside = (np.cumsum(edges[:-1]) > 0).astype(np.int64)
    return np.bincount(owner, inside, len(texts)).astype(np.int64)


@dataclass(frozen=True)
class Measured:
    """The plain measures of one text."""

    words: list[bytes]
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        n = len(self.words)
        return n < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * n


def measured(texts: list[bytes]) -> list[Measured]:
    """The plain measures of some texts."""
    split = [text.split() for text in texts]
    out = []
    for text, found, again in zip(texts, split, repeated_words(split).tolist(), strict=True):
        lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
        out.append(
            Measured(
                found,
                len(text.translate(None, SPACES + _CONTINUED)),
                len(text) - len(text.translate(None, SYMBOLS)),
                len(lines) - len(set(lines)),
                again,
            )
        )
    return out


def distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """The Jensen-Shannon distance of two histograms."""
    p, q = counts / counts.sum(), reference / reference.sum()
    middle = (p + q) / 2

    def surplus(x: np.ndarray) -> float:
        some = x > 0
        return float((x[some] * np.log2(x[some] / middle[some])).sum())

    return math.sqrt(max(0.0, (surplus(p) + surplus(q)) / 2))


def limit(largest: float, cells: int, n: int) -> float:
    """The largest distance of a text with ``n`` counted things in so many cells.

    A sample of n diverges by (cells - 1) / (8 n ln 2) bits from what it is drawn from.
    """
    return math.sqrt(largest**2 + CHANCE * (cells - 1) / (8 * n * math.log(2)))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and text; a table without languages is of one."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    small_batches(docs)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"), text.alias("text")
    )


def references(docs: DataFrame, common: int = COMMON_WORDS) -> DataFrame:
    """One row per language: lang, n_words, classes, words, word_counts.

    Added up over all its documents that pass the plain rules. Tasks add up what they have
    before anything is shuffled; of the words only a task's most frequent go to the last
    choice, so no language meets in one task with its vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(held)
            return pa.record_batch(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.string()),
                    pa.array([k[2] for k in keys], pa.binary()),
                    pa.array(list(held.values()), pa.int64()),
                ],
                names=["lang", "kind", "cell", "n"],
            )

        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            added: dict[str | None, Counter] = defaultdict(Counter)
            for lang, text, found in zip(
                batch.column("lang").to_pylist(), texts, measured(texts), strict=True
            ):
                if not found.failed:
                    added[lang].update(w.translate(ASCII_LOWER) for w in found.words)
                    held[lang, "all", b""] += len(found.words)
                    for k, n in enumerate(class_counts(text).tolist()):
                        held[lang, "class", b"%d" % k] += n
            for lang, words in added.items():
                for word, n in words.items():
                    held[lang, "word", word] += n
            if len(held) >= HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    cells = (
        _texts(docs)
        .mapInArrow(run, "lang string, kind string, cell binary, n bigint")
        .groupBy("lang", "kind", "cell")
        .agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "cell"))
    most = max(common, len(CLASSES))
    cells = cells.withColumn("place", place).filter(F.col("place") <= most)
    entry = F.struct("place", "cell", "n")
    of_kind = {
        kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, entry)))
        for kind in ("all", "class", "word")
    }
    listed = cells.groupBy("lang").agg(*[c.alias(kind) for kind, c in of_kind.items()])
    words = F.slice("word", 1, common)
    refs = listed.select(
        "lang",
        F.col("all")[0]["n"].alias("n_words"),
        F.array_sort(
            F.transform("class", lambda c: F.struct(c.cell.alias("cell"), c.n.alias("n")))
        )["n"].alias("classes"),
        words["cell"].alias("words"),
        words["n"].alias("word_counts"),
    )
    return settle(refs, "references")


class Reference:
    """What a language's documents are compared with."""

    def __init__(self, n_words: int, classes: list[int], words: list[bytes], counts: list[int]):
        self.n_words = n_words
        self.classes = np.array(classes, np.float64)
        self.place = {w: k for k, w in enumerate(words)}
        self.counts = np.array([*counts, n_words - sum(counts)], np.float64)

    def verdict(self, text: bytes, found: Measured) -> tuple[float | None, float | None, bool]:
        """Both distances, none where a histogram is too small, and whether both are near."""
        chars = words = None
        near = True
        if found.word_chars >= LEAST_CHARS:
            chars = distance(class_counts(text), self.classes)
            near = chars <= limit(CHARS_LIMIT, len(CLASSES), found.word_chars)
        if len(found.words) >= LEAST_COUNTED:
            rest = len(self.place)
            at = [self.place.get(w.translate(ASCII_LOWER), rest) for w in found.words]
            words = distance(np.bincount(at, minlength=rest + 1), self.counts)
            near = near and words <= limit(WORDS_LIMIT, rest + 1, len(found.words))
        return chars, words, near


def quality_rules(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: its measures, both distances, base_failed and kept.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    chars_distance, words_distance, base_failed, kept. Words are runs without white space,
    compared as they are in the plain measures and with A-Z lower-cased in the histogram.
    ``base_failed`` texts have fewer than 20 words or over 30 per cent of their words in
    windows of 8 words that they have twice. ``kept`` texts pass that and are near the
    reference of their ``lang``; a null ``lang`` is a language too, and so is a table
    without the column. A distance is null, and no reason to go, for a histogram of fewer
    than 100 characters or 30 words, and for a language whose passing documents have fewer
    than 1,000 words. Null, empty and blank texts have no words and fail. Repeated rows and
    repeated or null doc_ids are rows of their own. ``refs`` are the references to use, by
    default those of ``docs``. Other columns are not read. No rows give none.
    """
    refs = references(docs) if refs is None else refs
    of = refs.filter(F.col("n_words") >= LEAST_LANGUAGE).withColumnRenamed("lang", "ref_lang")
    texts = _texts(docs)
    # Spark broadcasts references as far as their size allows and else shuffles both sides.
    texts = texts.join(of, texts.lang.eqNullSafe(of.ref_lang), "left").drop("ref_lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Reference | None] = {}
        for batch in sliced(batches):
            bodies = batch.column("text").to_pylist()
            found = measured(bodies)
            out = []
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                if lang not in known:
                    parts = [batch.column(c)[k].as_py() for c in ("n_words", "classes", "words", "word_counts")]
                    known[lang] = Reference(*parts) if parts[0] is not None else None
                reference = known[lang]
                out.append(reference.verdict(bodies[k], found[k]) if reference else (None, None, True))
            failed = [f.failed for f in found]
            whole = pa.int64()
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([len(f.words) for f in found], whole),
                    *[
                        pa.array([getattr(f, c) for f in found], whole)
                        for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
                    ],
                    pa.array([o[0] for o in out], pa.float64()),
                    pa.array([o[1] for o in out], pa.float64()),
                    pa.array(failed),
                    pa.array([o[2] and not f for o, f in zip(out, failed, strict=True)]),
                ],
                names=_NAMES,
            )

    return texts.mapInArrow(run, _SCHEMA)


_SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, chars_distance double, words_distance double, base_failed boolean, "
    "kept boolean"
)
_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]

"""Spelling variants of words, by permuterm rotations.

Every word gets a terminator and is turned into all its rotations. Two words that differ by
one replaced letter have rotations that end in it and are equal before; a word with one
letter more has a rotation that ends in it and otherwise is a whole rotation of the shorter
word. So in the order of rotations the neighbours of an edit are one prefix range: the
prefix is a rotation with its last letter skipped. Ranges are scanned group by group. A
range holds a word for every letter at most, and from its members alone follow how many
neighbours each has there and which of them is the most frequent; no pairs are listed.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from voltlake.llm.text import ASCII_LOWER, sliced, small_batches
from voltlake.session import settle

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_CHARS, LEAST_COUNT = 6, 5
# How many times as frequent a word's form has to be.
RATIO = 5
TERMINATOR = "$"
# Distinct words a task holds before it hands them on.
HELD = 200_000


def slipped(doc_id: int | None, word: str, times: int) -> str:
    """The word, or in one of ``times`` cases the word without one of its letters."""
    # A row without doc_id counts as one with an empty one.
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % times:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(
    docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, slips: int = 0
) -> DataFrame:
    """(word, n) of the words of all texts, A-Z lower-cased, that are long and frequent enough.

    Words are the longest runs of the letters A-Z, a-z and U+00C0 to U+00FF. With ``slips``
    one in so many of a document's distinct words is altered first (``slipped``). Counts
    are added up in the tasks before they are shuffled.
    """
    text = F.col("text").cast("binary")
    texts = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            counts = pa.array(list(held.values()), pa.int64())
            return pa.record_batch([pa.array(list(held), pa.string()), counts], names=["word", "n"])

        for batch in sliced(batches):
            ids = batch.column("doc_id").to_pylist()
            for doc_id, body in zip(ids, batch.column("text").to_pylist(), strict=True):
                if not body:
                    continue
                found = RUN.findall(body.translate(ASCII_LOWER).decode("utf-8", "replace"))
                for word, n in Counter(found).items():
                    # A slip takes a letter away, so shorter words can't count.
                    if len(word) >= least_chars:
                        word = slipped(doc_id, word, slips) if slips else word
                        if len(word) >= least_chars:
                            held[word] += n
            if len(held) >= HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    counted = texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, first, n): the prefixes under which a word's neighbours stand.

    A whole rotation skips nothing. ``first`` tells whether the skipped letter is unlike
    the one before it in the word: taking any of equal letters in a row gives one word.
    """
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("at"))
    tail = F.concat(F.expr("substring(word, at + 1)"), F.lit(TERMINATOR))
    head = F.expr("substring(word, 1, at)")
    last, before = F.expr("substring(word, at, 1)"), F.expr("substring(word, at - 1, 1)")
    whole = F.struct(
        F.concat(tail, head).alias("prefix"),
        F.lit(None).cast("string").alias("skipped"),
        F.lit(True).alias("first"),
    )
    cut = F.struct(
        F.concat(tail, F.expr("substring(word, 1, at - 1)")).alias("prefix"),
        last.alias("skipped"),
        ((F.col("at") == 1) | (last != before)).alias("first"),
    )
    both = F.explode(F.when(F.col("at") > 0, F.array(whole, cut)).otherwise(F.array(whole)))
    return turned.select("n", both.alias("r")).select("r.prefix", "r.skipped", "r.first", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have others one edit away.

    ``best`` is the most frequent of them, of equal ones the least in code-point order. In
    a range every pair is one edit apart. Pairs that differ by a letter more stand in
    several ranges if the letter is one of equal ones in a row; they count where it is the
    first of them.
    """
    word = F.concat(
        F.substring_index("prefix", TERMINATOR, -1),
        F.coalesce("skipped", F.lit("")),
        F.substring_index("prefix", TERMINATOR, 1),
    )
    place = F.struct((-F.col("n")).alias("less"), word.alias("word"))
    members = rotations(words).select("prefix", "skipped", "first", place.alias("place"))
    group = W.partitionBy("prefix").orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cut = F.col("skipped").isNotNull()
    scanned = members.select(
        "place",
        "skipped",
        "first",
        F.count_if(cut).over(group).alias("n_cut"),
        F.count_if(cut & F.col("first")).over(group).alias("n_first"),
        F.count_if(~cut).over(group).alias("n_whole"),
        F.first("place").over(group).alias("top"),
        F.nth_value("place", 2).over(group).alias("second"),
    ).filter("second IS NOT NULL")
    others = F.col("n_cut") - 1 + F.when(F.col("first"), F.col("n_whole")).otherwise(0)
    near = F.when(F.col("skipped").isNull(), F.col("n_first")).otherwise(others)
    best = F.when(F.col("place") == F.col("top"), F.col("second")).otherwise(F.col("top"))
    each = scanned.select("place.word", near.alias("near"), best.alias("best"))
    found = each.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the last of the forms that follow.

    Every round follows as many forms as all before together. A form is several times as
    frequent as its word, so there are no rings and few rounds.
    """
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(further, "root", "left")
        step = settle(step.select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        now = step.select("word", "root")
        if step.filter("next IS NOT NULL").isEmpty():
            return now


def spelling_variants(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``words`` (word, n): word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point makes one the other.
    ``n_near`` counts a word's near words; ``form`` is the most frequent of them, of equal
    ones the least in code-point order, if it occurs at least ``ratio`` times as often as
    the word (more than once as often, or forms could go in rings), else null; ``root`` is
    the last of the forms that follow, the word itself if it has none. Words are distinct
    and have no terminator. No words give no rows. Other columns are not read.
    """
    if ratio <= 1:
        raise ValueError("a form has to be more frequent than its word")
    words = settle(words.select("word", "n"), "words")
    near = words.join(neighbours(words), "word", "left")
    named = F.col("best_n") >= ratio * F.col("n")
    graded = settle(
        near.select(
            "word",
            F.when(named, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(named, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(graded.filter("form IS NOT NULL"))
    joined = graded.join(last, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(
    docs: DataFrame,
    *,
    least_chars: int = LEAST_CHARS,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    slips: int = 0,
) -> DataFrame:
    """``spelling_variants`` of the words of ``docs`` that are long and frequent enough.

    See ``word_counts`` for what a word is. Null, empty and blank texts have none; repeated
    rows and doc_ids count each time, and a null doc_id matters to ``slips`` alone, as an
    empty one. Other columns are not read. No rows give none.
    """
    words = word_counts(docs, least_chars=least_chars, least_count=least_count, slips=slips)
    return spelling_variants(words, ratio=ratio)

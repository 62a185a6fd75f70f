"""Benchmark passages in documents, also with other numbers, names and units.

Texts are turned into templates: numbers, names and units become typed placeholders, other
words lose punctuation and case. Windows of template words are hashed in the JVM and joined
with those of the benchmark. Windows that match on one diagonal (the same distance between
document and item) belong together; those count whose slots hold values that can be told
from the item's by one replacement each, as in a question asked with other numbers. Windows
of plain lower-cased words are joined the same way and always count, so a copy is found
whatever its case and however few literal words it has. Only built-in functions are used.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltlake.llm.text import LOWER, UPPER
from voltlake.session import settle

WINDOW = 8
LEAST_WORDS = 5  # of an item; shorter than a window, it is searched as a whole
DRIFT = 8  # words put in or left out between two windows of one match
LEAST_LITERALS = 4  # of a window
LEAST_SHARE = 0.5  # of an item's words
LEAST_RUN = 13  # words in a row that are enough for any item
# Benchmark windows that are broadcast; a larger benchmark is joined by shuffling.
SMALL = 1_000_000

NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
SPACE = "[\\x20\\x09-\\x0D]"
# A capitalised word within a sentence. What comes before is looked at last, as only few
# characters are capitals.
_NAME = f"\\p{{Lu}}(?<=[^.!?:\\x20\\x09-\\x0D]{SPACE}\\p{{Lu}})\\p{{Ll}}[^\\x20\\x09-\\x0D]*"
_NUMBER = "[0-9](?<![^\\x20\\x09-\\x0D][0-9])[^\\x20\\x09-\\x0D]*"
UNITS = (
    "mm cm m km ft yd mi mg g kg t oz lb ml l sec ms min h hr hrs ns kb mb gb tb hz khz mhz "
    "ghz kw mw wh kwh pa kpa bar usd eur gbp percent seconds minutes hours days weeks "
    "months years meters metres kilometers kilometres miles feet inches grams kilograms pounds "
    "ounces liters litres gallons dollars euros cents degrees"
).split()
_UNIT = f"(?<={NUMBER}{SPACE})({'|'.join(UNITS)})(?![^\\x20\\x09-\\x0D])"
_DROPPED = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»…–—¿¡"
_WIDE_UPPER = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_WIDE_LOWER = "".join(chr(c + 0x20) for c in range(0xC0, 0xDF) if c != 0xD7)


def _bare(text: Column) -> Column:
    """Lower-cased, without punctuation."""
    return F.translate(text, UPPER + _WIDE_UPPER + _DROPPED, LOWER + _WIDE_LOWER)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def template_words(text: Column) -> Column:
    """The template of a text, word by word."""
    named = F.regexp_replace(text, _NAME, NAME)
    numbered = F.regexp_replace(_bare(named), _NUMBER, NUMBER)
    return _words(F.regexp_replace(numbered, _UNIT, UNIT))


def plain_words(text: Column) -> Column:
    """The words that stand at the template's places."""
    return _words(_bare(text))


def _windows(df: DataFrame, size: int) -> DataFrame:
    """``df`` with the hash of every window of its ``shape``, made from two shorter ones.

    Every step is a column of its own: within one expression Spark would work out the
    shorter hashes anew for both halves of the longer ones.
    """
    df = df.withColumn("hashes", F.transform("shape", lambda w: F.xxhash64(w)))
    width = 1
    while width < size:
        # The last ones run over the end; the slice below leaves them out.
        step = min(width, size - width)
        later = F.slice("hashes", F.lit(step + 1), F.size("hashes"))
        df = df.withColumn("hashes", F.zip_with("hashes", later, lambda a, b: F.xxhash64(a, b)))
        width += step
    n = F.greatest(F.size("hashes") - (size - 1), F.lit(0))
    return df.withColumn("hashes", F.slice("hashes", F.lit(1), n))


def _is_slot(word: Column) -> Column:
    return word.isin(NAME, NUMBER, UNIT)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with ``row``, which tells rows with the same doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("bigint").alias("doc_id")
    return docs.select(doc_id, F.xxhash64("doc_id", text).alias("row"), text.alias("text"))


def _items(benchmark: DataFrame) -> DataFrame:
    """Template and words of each id's every text; null texts are left out."""
    known = benchmark.filter("text IS NOT NULL")
    known = known.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    return known.select(
        F.xxhash64("item_id", "text").alias("item"),
        "item_id",
        template_words(F.col("text")).alias("shape"),
        plain_words(F.col("text")).alias("said"),
    )


def _met(said: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(row, doc_id, item, shift, place) of the windows of ``shape`` that both sides have."""
    if asked.count() <= SMALL:
        asked = F.broadcast(asked)
    # The outer form, because the plain one makes Spark filter texts without windows first,
    # for which it would work out all their windows a second time. Nulls join nothing.
    said = _windows(said, window).select(
        "row", "doc_id", F.posexplode_outer("hashes").alias("at", "hash")
    )
    return said.join(asked, "hash").select(
        "row", "doc_id", "item", (F.col("at") - F.col("place")).alias("shift"), "place"
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, item, shift, places, plain): the item's windows a document has.

    ``places`` are those of template windows, ``plain`` those of plain words.
    """
    items, keyed = _items(benchmark), _keyed(docs)
    literals = F.size(
        F.filter(F.slice("shape", F.col("place") + 1, window), lambda w: ~_is_slot(w))
    )
    asked = (
        _windows(items, window)
        .select("item", "shape", F.posexplode("hashes").alias("place", "hash"))
        .filter(literals >= min(LEAST_LITERALS, window))
        .select("item", "place", "hash")
    )
    said = keyed.select("row", "doc_id", template_words(F.col("text")).alias("shape"))
    found = _met(said, asked, window).withColumn("is_plain", F.lit(False))
    verbatim = keyed.select("row", "doc_id", plain_words(F.col("text")).alias("shape"))
    words = items.select("item", F.col("said").alias("shape"))
    sizes = words.select(F.least(F.size("shape"), F.lit(window)).alias("size")).distinct()
    for size in sorted(r["size"] for r in sizes.collect()):
        if size >= min(LEAST_WORDS, window):
            some = words.filter(F.least(F.size("shape"), F.lit(window)) == size)
            asked = _windows(some, size).select("item", F.posexplode("hashes").alias("place", "hash"))
            met = _met(verbatim, asked, size)
            found = found.unionByName(met.withColumn("is_plain", F.lit(True)))
    return found.groupBy("row", "doc_id", "item", "shift").agg(
        F.sort_array(F.collect_set(F.when(~F.col("is_plain"), F.col("place")))).alias("places"),
        F.sort_array(F.collect_set(F.when(F.col("is_plain"), F.col("place")))).alias("plain"),
    )


def _spread(places: Column, window: Column) -> Column:
    """The words that windows at these places cover."""
    return F.array_distinct(
        F.flatten(F.transform(places, lambda p: F.sequence(p, (p + window - 1).cast("int"))))
    )


def _run(places: str) -> Column:
    """How many of the sorted places follow each other without a gap at most; 0 of none."""
    firsts = F.filter(places, lambda p: ~F.array_contains(places, p - 1))
    lasts = F.filter(places, lambda p: ~F.array_contains(places, p + 1))
    runs = F.zip_with(firsts, lasts, lambda a, b: b - a + 1)
    return F.coalesce(F.array_max(runs), F.lit(0))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    least_share: float = LEAST_SHARE,
    least_run: int = LEAST_RUN,
) -> DataFrame:
    """One row per document and item found in it; other documents have none.

    Columns: doc_id, item_id, first_word (of the match in the document), n_words (of the
    item's words matched), share (of the item's words), n_slots, n_changed (slots with
    another value than the item's) and ``row`` (the row's hash). An item is found where
    windows of ``window`` words match and cover ``least_share`` of its words or
    ``least_run`` in a row, on one diagonal and those at most ``DRIFT`` words from it.
    Windows match as plain words, or as templates whose slots hold values that stand for
    one value of the item all along the diagonal. Items shorter than ``window`` are
    searched as a whole, as plain words. Of several places the one with most words is
    reported.

    Null texts are empty and have no windows; items of fewer than ``LEAST_WORDS`` words are
    not searched. Every text under an item_id is searched, and the one with most words is
    reported; a null item_id is an id like others. Rows that share doc_id and text give one
    result; a null doc_id is reported as null. Other columns are not read. No documents or
    no items give no rows.
    """
    items = _items(benchmark)
    hits = settle(matches(docs, benchmark, window), "hits")
    found = hits.select("row").distinct()
    texts = _keyed(docs).join(found, "row", "left_semi").dropDuplicates(["row", "doc_id"])
    texts = texts.select(
        F.col("row").alias("row_"), F.col("doc_id").alias("id_"), plain_words(F.col("text")).alias("words")
    )
    same = (F.col("row") == F.col("row_")) & F.col("doc_id").eqNullSafe(F.col("id_"))
    both = hits.join(texts, same).join(items, "item")
    slots = F.filter(
        _spread(F.col("places"), F.lit(window)), lambda p: _is_slot(F.get("shape", p))
    )
    pairs = F.transform(
        slots,
        lambda p: F.struct(
            F.get("shape", p).alias("kind"),
            F.get("said", p).alias("asked"),
            F.get("words", p + F.col("shift")).alias("found"),
        ),
    )
    both = both.withColumn("pairs", F.array_distinct(pairs))
    # Values of the item that more than one value of the document stands for.
    both = both.withColumn("asked", F.transform("pairs", lambda p: p.dropFields("found")))
    torn = F.filter("asked", lambda a: F.size(F.filter("asked", lambda b: a == b)) > 1)
    both = both.withColumn("torn", torn)
    at_torn = F.filter(
        F.sequence(F.lit(0), F.size("shape") - 1),
        lambda p: F.array_contains(
            "torn", F.struct(F.get("shape", p).alias("kind"), F.get("said", p).alias("asked"))
        ),
    )
    both = both.withColumn("at_torn", at_torn)
    # Named twice, or Spark would work ``at_torn`` out anew for every place.
    sound = F.when(F.size("at_torn") == 0, F.col("places")).otherwise(
        F.filter("places", lambda p: ~F.exists("at_torn", lambda t: (t >= p) & (t < p + window)))
    )
    whole = F.least(F.lit(window), F.size("said"))
    both = both.withColumn("alike", F.array_sort(_spread(sound, F.lit(window))))
    # Where templates are enough, they say where the match is.
    enough = (F.size("alike") >= least_share * F.size("said")) | (_run("alike") >= least_run)
    every = F.array_union("alike", _spread(F.col("plain"), whole))
    covered = F.when(enough & (F.size("torn") == 0), F.col("alike")).otherwise(every)
    both = both.withColumn("covered", covered).filter(F.size("covered") > 0)
    told = F.transform(
        "covered",
        lambda p: F.struct(
            p.alias("place"),
            _is_slot(F.get("shape", p)).alias("slot"),
            (F.get("said", p) != F.get("words", p + F.col("shift"))).alias("changed"),
        ),
    )
    near = (
        Window.partitionBy("row", "doc_id", "item").orderBy("shift").rangeBetween(-DRIFT, DRIFT)
    )
    # Words put in or left out move the rest of a match to a diagonal close by.
    first = (F.array_min("covered") + F.col("shift")).cast("bigint")
    joined = both.select(
        "row",
        "doc_id",
        "item_id",
        F.size("said").alias("n"),
        F.min(first).over(near).alias("first_word"),
        F.array_distinct(F.flatten(F.collect_list(told).over(near))).alias("told"),
    )
    joined = joined.withColumn("covered", F.array_sort(F.array_distinct("told.place")))
    slots = F.array_distinct(F.filter("told", lambda t: t["slot"])["place"])
    kept = F.array_distinct(F.filter("told", lambda t: t["slot"] & ~t["changed"])["place"])
    scored = joined.select(
        "row",
        "doc_id",
        "item_id",
        "first_word",
        F.size("covered").cast("bigint").alias("n_words"),
        (F.size("covered") / F.col("n")).alias("share"),
        F.size(slots).cast("bigint").alias("n_slots"),
        (F.size(slots) - F.size(kept)).cast("bigint").alias("n_changed"),
        _run("covered").alias("run"),
    ).filter((F.col("share") >= least_share) | (F.col("run") >= least_run))
    columns = ["n_words", "first_word", "share", "n_slots", "n_changed"]
    best = F.max(F.struct("n_words", (-F.col("first_word")).alias("early"), *columns[1:])).alias("best")
    return (
        scored.groupBy("row", "doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", *[F.col(f"best.{c}").alias(c) for c in columns], "row")
    )


def clean_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which nothing was found, with the columns they had."""
    row = F.xxhash64(docs["doc_id"].cast("bigint"), F.coalesce(docs["text"], F.lit("")))
    dirty = found.select(F.col("row").alias("dirty_row"), F.col("doc_id").alias("dirty_id"))
    same = (row == dirty["dirty_row"]) & docs["doc_id"].eqNullSafe(dirty["dirty_id"])
    return docs.join(dirty, same, "left_anti")

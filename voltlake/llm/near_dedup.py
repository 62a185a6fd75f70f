"""Near-duplicate components by MinHash with tensored banding.

A document has two small collections of half keys, each hashed from a few minhashes. The
key of table (i, j) is the pair of half key i of the first and half key j of the second
collection: m * m tables from 2 * m half keys, so the minhashes needed grow with the square
root of the number of tables. Two documents meet in a table with the probability of as
many equal minhashes as in plain banding.

Documents with equal shingle sets form one class. Only half keys that several classes have
can make a shared table key, so table rows are made for those alone. In a table cell the
members are compared with a leader, never with each other, for ``LEADER_ROUNDS`` rounds:
first with the smallest, then with leaders drawn anew. That joins what lies close together
with one comparison a member. Every link is confirmed on the whole shingle sets.

The classes of cells that still hold several components with members that have not led are
then joined exactly, without cells, leaders or marks: by the rarest of their shared
shingles (a prefix filter), with bounds on size, place and a bitmap of the whole set that
no link exceeds. Classes of one component are not compared there. A shingle in the prefixes
of k classes costs k * k / 2 tests of these bounds, in blocks that are tasks of their own;
few of them lead to a comparison.

With the defaults a pair at similarity 0.75 is lost with probability 5e-6 if it is not in
that join: it shares no cell (4e-6) or its marks mislead (1e-6). In the join none is lost.
"""

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from voltlake.llm.components import components
from voltlake.llm.text import long_lists, mixed, shingles, sliced, small_batches
from voltlake.session import settle

WORDS = 5
PERCENT = 75
HALF_KEYS = 16  # in each of the two collections
MINHASHES = 2  # in a half key
LEADER_ROUNDS = 1
SEED = 20_240_601
# Ids of candidates that are broadcast to find their texts; more of them are joined.
FEW = 1_000_000
# Shingles hashed at a time.
RUN = 4_096
# Bits of the map of a whole set, and classes with a prefix shingle compared in one task.
MAP_BITS, BLOCK = 1_024, 1_024


# Bits of each minhash that go along with a class, and how many standard deviations below
# their mean at the threshold the agreeing ones of a pair may be.
MARK_BITS, DEVIATIONS = 4, 5.0


def least_hashes(found: np.ndarray, n: int) -> np.ndarray:
    """``n`` minhashes of a set."""
    draw = np.random.default_rng(SEED)
    times = draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = draw.integers(0, 1 << 63, n, np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max)
    for a in range(0, len(found), RUN):
        some = found[None, a : a + RUN] * times[:, None] + plus[:, None]
        least = np.minimum(least, some.min(axis=1))
    return mixed(least)


def marks(least: np.ndarray) -> np.ndarray:
    """The lowest bits of each minhash, 16 minhashes to a number."""
    low = (least & np.uint64(15)).reshape(-1, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64))
    return np.bitwise_or.reduce(low, axis=1)


def least_agreement(n: int, percent: int) -> int:
    """How many marks of a pair at the threshold agree at least, but for rare chance."""
    chance = percent / 100 + (1 - percent / 100) / 2**MARK_BITS
    return math.floor(n * chance - DEVIATIONS * math.sqrt(n * chance * (1 - chance)))


def _agreeing(a: Column, b: Column, n: int) -> Column:
    """How many of ``n`` marks are equal: groups of four bits without any difference."""
    total = F.lit(n)
    for k in range(n // 16):
        other = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for step in (1, 2):
            other = other.bitwiseOR(F.shiftrightunsigned(other, step))
        total -= F.bit_count(other.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def half_keys(least: np.ndarray, half: int, minhashes: int) -> np.ndarray:
    """The half keys of both collections; each is different from all at other places."""
    keys = np.arange(2 * half, dtype=np.uint64)
    for column in least.reshape(2 * half, minhashes).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return keys


def sketches(
    docs: DataFrame, words: int = WORDS, half: int = HALF_KEYS, minhashes: int = MINHASHES
) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, half keys, marks; none without words."""
    n = 2 * half * minhashes
    if n % 16:
        raise ValueError("the number of minhashes has to be a multiple of 16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.empty(0, np.uint64)
        for batch in sliced(batches):
            sizes, digests, keys, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text or b"", words)
                sizes.append(len(found))
                some = len(found) > 0
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if some else None)
                least = least_hashes(found, n) if some else nothing
                keys.append(half_keys(least, half, minhashes) if some else nothing)
                bits.append(marks(least) if some else nothing)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    long_lists(keys),
                    long_lists(bits),
                ],
                names=["doc_id", "n_shingles", "digest", "keys", "marks"],
            )

    schema = "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>, marks array<bigint>"
    return _texts(docs).mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The shingle sets of the wanted classes (cls, digest, low), made again from their texts."""
    n = wanted.count()
    texts = _texts(docs)
    found = F.broadcast(wanted) if n <= FEW else wanted
    texts = texts.join(found, texts.doc_id == found.low).select("cls", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, sets = [], []
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for cls, digest, text in rows:
                found = shingles(text or b"", words)
                # Another text under the same doc_id is of another class.
                if xxhash.xxh3_128_digest(found.tobytes()) == digest:
                    ids.append(cls)
                    sets.append(found)
            yield pa.record_batch([pa.array(ids, pa.int64()), long_lists(sets)], names=["cls", "set"])

    sets = settle(texts.mapInArrow(run, "cls bigint, set array<bigint>"), "sets")
    # Rows that are alike in doc_id and text give a class's set again.
    return sets if sets.count() == n else settle(sets.dropDuplicates(["cls"]), "sets")


def _cells(classes: DataFrame, half: int) -> DataFrame:
    """(key, cls) of every table cell that more than one class falls into."""
    rows = classes.select("cls", F.posexplode("keys").alias("at", "half"))
    shared = rows.groupBy("half").agg(F.count("*").alias("k")).filter("k > 1").select("half")
    sides = (
        rows.join(shared, "half")
        .groupBy("cls")
        .agg(
            F.collect_list(F.when(F.col("at") < half, F.col("half"))).alias("us"),
            F.collect_list(F.when(F.col("at") >= half, F.col("half"))).alias("vs"),
        )
    )
    pairs = sides.select("cls", "vs", F.explode("us").alias("u")).select(
        "cls", F.explode("vs").alias("v"), "u"
    )
    cells = settle(pairs.select(F.xxhash64("u", "v").alias("key"), "cls"), "cells")
    several = cells.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    return cells.join(several, "key")


def _alike(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose whole sets are similar enough."""
    of_a = sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a"))
    of_b = sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b"))
    both = edges.join(of_b, "b").join(of_a, "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    sizes = F.size("set_a") + F.size("set_b")
    return (
        both.select("a", "b", common.alias("common"), sizes.alias("sizes"))
        .filter(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common")))
        .select("a", "b")
    )


def _draw(
    members: DataFrame, labels: DataFrame, turn: int, percent: int, marked: int
) -> tuple[DataFrame, DataFrame]:
    """The open cells with a new leader marked, and the pairs to compare (a < b)."""
    known = members.join(labels, "cls")
    luck = F.xxhash64("key", "cls", F.lit(turn)) if turn else F.lit(0)
    lead = F.struct("led", luck.alias("luck"), "cls", "n", "marks", "component")
    leaders = (
        known.groupBy("key")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.sum((~F.col("led")).cast("int")).alias("waiting"),
            F.min(lead).alias("lead"),
        )
        # With one member left to lead, all its pairs have been compared.
        .filter("low <> high AND waiting > 1")
        .select("key", "lead")
    )
    close = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
    agreeing = _agreeing(F.col("marks"), F.col("lead.marks"), marked)
    asked = (F.col("component") != F.col("lead.component")) & close
    asked = asked & (agreeing >= least_agreement(marked, percent))
    now = known.join(leaders, "key").select(
        "key",
        "cls",
        (F.col("led") | (F.col("cls") == F.col("lead.cls"))).alias("led"),
        F.when(asked, F.col("lead.cls")).alias("ask"),
    )
    now = settle(now, "cells")
    pairs = now.filter("ask IS NOT NULL").select(
        F.least("cls", "ask").alias("a"), F.greatest("cls", "ask").alias("b")
    )
    return now.drop("ask"), pairs.distinct()


def _link(
    docs: DataFrame, classes: DataFrame, half: int, minhashes: int, words: int, percent: int
) -> DataFrame:
    """(cls, component) of the classes that share cells with others."""
    members = settle(_cells(classes, half), "cells").withColumn("led", F.lit(False))
    own = members.select("cls").distinct()
    wanted = settle(classes.join(own, "cls").select("cls", "digest", "low", "n", "marks"), "wanted")
    sets = _sets(docs, wanted.select("cls", "digest", "low"), words)
    labels = wanted.select("cls", F.col("cls").alias("component"), "n", "marks")
    tested = None
    for turn in range(LEADER_ROUNDS):
        members, pairs = _draw(members, labels, turn, percent, 2 * half * minhashes)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = settle(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = settle(_alike(pairs, sets, percent), "links")
        if not links.isEmpty():
            labels = _joined(labels, links)
        if members.isEmpty():
            break
    open_ = settle(_open(members, labels), "open")
    if not open_.isEmpty():
        pairs = settle(_candidates(open_, sets, percent), "pairs")
        links = settle(_alike(pairs, sets, percent), "links")
        if not links.isEmpty():
            labels = _joined(labels, links)
    return labels.select("cls", "component")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(cls, n, component) of the classes in cells with pairs that were never compared."""
    known = members.join(labels, "cls")
    cells = known.groupBy("key").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.sum((~F.col("led")).cast("int")).alias("waiting"),
    )
    cells = cells.filter("low <> high AND waiting > 1").select("key")
    return known.join(cells, "key").select("cls", "n", "component").distinct()


def bit_map(found: np.ndarray) -> np.ndarray:
    """``MAP_BITS`` bits, those set that a member falls on.

    Each bit in which two maps differ stands for a shingle that one of the sets lacks.
    """
    bits = np.zeros(MAP_BITS, np.uint8)
    bits[found.view(np.uint64) % np.uint64(MAP_BITS)] = 1
    return np.packbits(bits).view(np.uint64)


def _maps(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("set").values.to_numpy(zero_copy_only=False)
            cuts = batch.column("set").offsets.to_numpy()
            maps = [bit_map(flat[a:b]) for a, b in pairwise(cuts)]
            yield pa.record_batch([batch.column("cls"), long_lists(maps)], names=["cls", "map"])

    return small_batches(sets).select("cls", "set").mapInArrow(run, "cls bigint, map array<bigint>")


def _prefixes(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, cls, n, component, at) of the shingles a link cannot do without.

    Shingles that only one component has come first in the order, then the rarest; ``at``
    is the place in it. A link has its first common shingle in the prefix of both classes.
    """
    rows = sets.join(open_, "cls").select("cls", "n", "component", F.explode("set").alias("shingle"))
    rows = settle(rows, "shingles")
    shared = (
        rows.groupBy("shingle")
        .agg(F.count("*").alias("k"), F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("shingle", "k")
    )
    ranked = rows.join(shared, "shingle").groupBy("cls", "n", "component").agg(
        F.sort_array(F.collect_list(F.struct("k", "shingle"))).alias("order")
    )
    own = F.col("n") - F.size("order")
    # Places with 100 * (n - at) >= percent * n, less those of the shingles that come first.
    last = F.floor(F.col("n") * (100 - percent) / 100) + 1 - own
    placed = ranked.withColumn("own", own).withColumn("last", last).filter("last > 0")
    cut = F.slice("order", F.lit(1), F.col("last").cast("int"))
    return placed.select("cls", "n", "component", "own", F.posexplode(cut).alias("place", "one")).select(
        F.col("one.shingle").alias("shingle"), "cls", "n", "component", (F.col("own") + F.col("place")).alias("at")
    )


def _candidates(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open classes of different components; no link is left out."""
    rows = settle(_prefixes(open_, sets, percent), "prefixes")
    hot = (
        rows.groupBy("shingle")
        .agg(F.count("*").alias("k"), F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("shingle", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    )
    rows = rows.join(hot, "shingle").join(_maps(sets.join(open_.select("cls"), "cls")), "cls")
    # Every block of a shingle's classes meets every other in a task of its own.
    rows = settle(rows.withColumn("home", F.pmod(F.xxhash64("cls"), F.col("blocks"))), "blocks")
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1).cast("array<bigint>")

    def side(name: str, u: Column, v: Column) -> DataFrame:
        columns = [F.col(c).alias(f"{c}_{name}") for c in ("cls", "n", "component", "at", "map")]
        return rows.select("shingle", u.alias("u"), v.alias("v"), *columns)

    a = side("a", F.col("home"), F.explode(blocks))
    b = side("b", F.explode(blocks), F.col("home"))
    # The smaller set's first common shingle lies still earlier.
    a = a.filter((F.col("n_a") - F.col("at_a")) * (100 + percent) >= 2 * percent * F.col("n_a"))
    sizes = F.col("n_a") + F.col("n_b")
    left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    differing = F.lit(0)
    for k in range(MAP_BITS // 64):
        differing += F.bit_count(F.get("map_a", F.lit(k)).bitwiseXOR(F.get("map_b", F.lit(k))))
    near = (
        (F.struct("n_a", "cls_a") < F.struct(F.col("n_b").alias("n_a"), F.col("cls_b").alias("cls_a")))
        & (F.col("component_a") != F.col("component_b"))
        & (left * (100 + percent) >= percent * sizes)
        & (differing * (100 + percent) <= (100 - percent) * sizes)
    )
    same = (a.shingle == b.shingle) & (a.u == b.u) & (a.v == b.v)
    return a.join(b, same & near).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the components at both ends of every link have become one."""
    u = labels.select(F.col("cls").alias("a"), F.col("component").alias("u"))
    v = labels.select(F.col("cls").alias("b"), F.col("component").alias("v"))
    merged = components(links.join(u, "a").join(v, "b").select("u", "v"))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    joined = labels.join(merged, "component", "left")
    component = F.coalesce("joined", "component").alias("component")
    return settle(joined.select("cls", component, "n", "marks"), "labels")


def near_dedup(
    docs: DataFrame,
    *,
    words: int = WORDS,
    percent: int = PERCENT,
    half: int = HALF_KEYS,
    minhashes: int = MINHASHES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Words are runs without white space, A-Z lower-cased; a document's set has its distinct
    runs of ``words`` words, or all its words as one if they are fewer. Two documents are
    linked if the intersection of their sets is at least ``percent`` per cent of the union.
    ``component_id`` is the smallest doc_id that can be reached, its own included; the row
    with that doc_id is kept. Null or empty texts, or texts of white space, are linked with
    nothing and kept. A row with a null doc_id is linked with nothing, has no component_id
    and is kept. Rows that share a doc_id are documents of their own. Shingles are compared
    by 64-bit hashes. Other columns are not read. No rows give none.
    """
    drawn = settle(sketches(docs, words, half, minhashes), "sketches")
    usable = drawn.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = usable.groupBy("digest").agg(
        F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"),
        F.first("keys").alias("keys"), F.first("marks").alias("marks"),
    )
    # Numbers name classes: different texts may have one smallest doc_id.
    classes = settle(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    labels = _link(docs, classes, half, minhashes, words, percent)
    placed = classes.select("digest", "cls", "low").join(labels, "cls", "left")
    placed = placed.select("digest", "low", F.coalesce("component", "cls").alias("component"))
    placed = settle(placed, "placed")
    least = settle(placed.groupBy("component").agg(F.min("low").alias("component_id")), "least")
    placed = placed.join(least, "component").select("digest", "component_id")
    rest = drawn.filter("doc_id IS NULL OR n_shingles = 0")
    out = (
        usable.join(placed, "digest")
        .select("doc_id", "n_shingles", "component_id")
        .unionByName(rest.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.withColumn("kept", kept)


def kept_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they had.

    A doc_id goes if no row with it is kept.
    """
    gone = verdicts.groupBy(F.col("doc_id").alias("_id")).agg(F.bool_or("kept").alias("kept"))
    gone = gone.filter("NOT kept").select("_id")
    return docs.join(gone, docs.doc_id.cast("bigint") == gone["_id"], "left_anti")

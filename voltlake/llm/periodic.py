"""Periodic runs of words, by branching tandems in an enhanced suffix array.

The array of a text's words comes with its inverse and the longest common prefixes of
neighbours. An interval of the array holds the suffixes that share their first ``depth``
words; the places where neighbours share exactly that many part it into children. Suffixes
i and i + depth in different children are a branching tandem, a square that does not go on
to the right; it is enough to look at both sides of the suffixes outside the largest child.
A square is rotated to the left as long as words allow, which gives the run it ends. No
tree nodes are made: intervals live on a stack while the array is scanned.

The arrays of many texts are made together by doubling prefixes, where only suffixes that
are not yet told apart are sorted again. Texts never share a prefix.
"""

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voltlake.llm.text import sliced, small_batches

LEAST_WORDS, LEAST_PERIODS = 6, 4
# A run of 6 words and 4 periods has two suffixes that share this many words.
LEAST_SHARED = 5

Run = tuple[int, int, int]  # start, length, period


class SuffixArrays:
    """The enhanced suffix arrays of texts laid end to end.

    ``order[k]`` is the place of the k-th suffix, ``place_of`` its inverse, ``shared[k]``
    what the suffixes k - 1 and k have in common; a text's suffixes are next to each other
    in the order, at its own places.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        n = len(ids)
        ends = np.repeat(np.cumsum(sizes), sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        first = owner * (int(ids.max()) + 1 if n else 1) + ids
        by_word = np.argsort(first, kind="stable")
        rank = np.empty(n, np.int64)
        rank[by_word] = _group_starts(first[by_word])
        kind = np.int32 if n < 1 << 31 else np.int64
        # Equal ranks on level m: the first 2 ** m words are the same.
        self.levels = [rank.astype(kind)]
        self.ends = ends
        open_ = by_word[_in_groups(rank[by_word])]
        width = 1
        while len(open_):
            after = open_ + width
            inside = after < ends[open_]
            following = np.zeros(len(open_), np.int64)
            following[inside] = rank[after[inside]] + 1
            key = rank[open_] * (n + 1) + following
            turn = np.argsort(key, kind="stable")
            open_, key = open_[turn], key[turn]
            old = rank[open_]
            rank = rank.copy()
            rank[open_] = old + _group_starts(key) - _group_starts(old)
            self.levels.append(rank.astype(kind))
            open_ = open_[_in_groups(key)]
            width *= 2
        self.place_of = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.shared = np.zeros(n, np.int64)
        if n > 1:
            self.shared[1:] = self._common(self.order[:-1], self.order[1:])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``a`` and ``b`` have in common."""
        common = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            u, v = a + common, b + common
            inside = np.flatnonzero((u < self.ends[a]) & (v < self.ends[b]))
            ranks = self.levels[level]
            same = inside[ranks[u[inside]] == ranks[v[inside]]]
            common[same] += 1 << level
        return common


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    """For each place of an ordered array the first place with the same value."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))


def _in_groups(ordered: np.ndarray) -> np.ndarray:
    """The places of an ordered array whose value occurs more than once."""
    same = ordered[1:] == ordered[:-1]
    return np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))


def branching_tandems(order: list[int], place_of: list[int], shared: list[int]) -> set[tuple[int, int]]:
    """(period, place) of the squares whose next word differs from their first, or is none."""
    n = len(order)
    found: set[tuple[int, int]] = set()

    def test(depth: int, low: int, high: int, cuts: list[int]) -> None:
        """The interval low..high, its children begin at ``low`` and at ``cuts``."""
        bounds = [low, *cuts, high + 1]
        sizes = [b - a for a, b in zip(bounds, bounds[1:])]
        largest = sizes.index(max(sizes))
        for child in range(len(sizes)):
            if child == largest:
                continue
            a, b = bounds[child], bounds[child + 1]
            for i in order[a:b]:
                for first, other in ((i, i + depth), (i - depth, i - depth)):
                    if 0 <= other < n:
                        k = place_of[other]
                        if low <= k <= high and not a <= k < b:
                            found.add((depth, first))

    stack: list[tuple[int, int, list[int]]] = [(0, 0, [])]
    for k in range(1, n + 1):
        common = shared[k] if k < n else 0
        low = k - 1
        while stack[-1][0] > common:
            depth, low, cuts = stack.pop()
            # A longer period cannot be there four times.
            if LEAST_PERIODS * depth <= n:
                test(depth, low, k - 1, cuts)
        if stack[-1][0] == common:
            stack[-1][2].append(k)
        else:
            stack.append((common, low, [k]))
    return found


def _rotated(ids: np.ndarray, place: int, period: int) -> int:
    """The first place to which a square can be rotated to the left."""
    step = 16
    while place > 0:
        a = max(0, place - step)
        differ = np.flatnonzero(ids[a:place] != ids[a + period : place + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        place, step = a, 2 * step
    return place


def runs_of(ids: np.ndarray, order: np.ndarray, place_of: np.ndarray, shared: np.ndarray) -> list[Run]:
    """The runs of one text, by start, then period."""
    tandems = branching_tandems(order.tolist(), place_of.tolist(), shared.tolist())
    ending: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
    runs = []
    for period, place in sorted(tandems):
        end = place + 2 * period
        # A square of several periods ends the run that its smallest period makes.
        if any(period % p == 0 and start <= place for start, p in ending[end]):
            continue
        start = _rotated(ids, place, period)
        ending[end].append((start, period))
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
            runs.append((start, end - start, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def periodic_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each of some texts, given as words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    ids = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    arrays = SuffixArrays(ids, sizes)
    out = []
    for a, b in zip((np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist(), strict=True):
        # The first of a text has nothing in common with the last of the text before.
        if b - a < LEAST_WORDS or arrays.shared[a:b].max() < LEAST_SHARED:
            out.append([])
            continue
        order, place_of = arrays.order[a:b] - a, arrays.place_of[a:b] - a
        out.append(runs_of(ids[a:b], order, place_of, arrays.shared[a:b]))
    return out


def without_repeats(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words but those that a run has after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return [words[i] for i in stay.tolist()]


def stuttered(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words with a planted run: a tenth of the documents repeat a stretch until they end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(b"%d" % doc_id)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_run_report(docs: DataFrame, *, planted: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the greatest run, all runs, the rest.

    Words are runs without white space, compared as they are. A run is a stretch of words
    with a smallest period q, of at least 4 q and 6 words, that no neighbouring word extends
    with that period. Columns: ``start`` (word number), ``length``, ``period`` and
    ``exponent_milli`` (thousandths of length / period, rounded down) of the longest run,
    of equal ones the first, then the one of smaller period; ``runs``, an array of all by
    start, then period; ``collapsed``, the words joined by single blanks without those that
    a run has after its first period. Null, empty and blank texts have no runs: four nulls,
    an empty array and an empty text. Repeated rows and repeated or null doc_ids are rows
    of their own. Other columns are not read. No rows give none. With ``planted`` words are
    altered by doc_id first (``stuttered``; rows without doc_id are not).
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words = [text.split() for text in batch.column("text").to_pylist()]
            if planted:
                ids = batch.column("doc_id").to_pylist()
                words = [stuttered(i, w) for i, w in zip(ids, words, strict=True)]
            runs = periodic_runs(words)
            top = [min(r, key=lambda x: (-x[1], x[0], x[2]), default=None) for r in runs]
            kept = [b" ".join(without_repeats(w, r)) for w, r in zip(words, runs, strict=True)]
            whole = pa.int64()
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([len(r) for r in runs], whole),
                    *[pa.array([t and t[k] for t in top], whole) for k in range(3)],
                    pa.array([t and 1000 * t[1] // t[2] for t in top], whole),
                    pa.array(
                        [[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in runs],
                        pa.list_(pa.struct([(c, whole) for c in ("start", "length", "period")])),
                    ),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"],
            )

    schema = (
        "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )
    return texts.mapInArrow(run, schema)


def digests(report: DataFrame) -> DataFrame:
    """The report with digests of its runs and of the collapsed text in their place."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return report.withColumns(
        {
            "runs_sha256": F.sha2(F.concat_ws("", lines), 256),
            "collapsed_sha256": F.sha2("collapsed", 256),
        }
    ).drop("runs", "collapsed")

"""Packing of token pieces into sequences of a fixed length.

How many pieces there are of each length is all that matters for the plan, and there are
at most ``capacity`` lengths, so the plan is made on that histogram: patterns of lengths
and how often each is used. It comes from bin completion: the longest piece left is
completed with fillings that no other filling dominates, least waste first, branches that
must waste more than the best known plan are cut, and best-fit decreasing gives the first
plan to beat. The pieces themselves are then numbered per length, in parallel, and take
the places the plan has for that number.
"""

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from voltlake.llm.text import small_batches
from voltlake.llm.tokens import END_ID, PIECES_KEPT, token_batches, tokenizer_path
from voltlake.session import settle

CAPACITY = 1024
# Completions tried before the best plan so far is taken.
NODES = 4_000
# Fillings tried for one longest piece.
BRANCHES = 3
# Broadcast of the parts' first numbers: rows of three integers.
SMALL = 500_000

Plan = list[tuple[tuple[int, ...], int]]


def least_bins(counts: Mapping[int, int], capacity: int) -> int:
    """A bound below the number of bins: pieces over half a bin and the room beside them."""
    best = 0
    total = sum(s * n for s, n in counts.items())
    for k in [0, *sorted(s for s in counts if 2 * s <= capacity)]:
        big = sum(n for s, n in counts.items() if s > capacity - k)
        mid = [(s, n) for s, n in counts.items() if capacity - k >= s > capacity / 2]
        small = sum(s * n for s, n in counts.items() if capacity / 2 >= s >= k)
        room = sum((capacity - s) * n for s, n in mid)
        more = max(0, -(-(small - room) // capacity))
        best = max(best, big + sum(n for _, n in mid) + more)
    return max(best, -(-total // capacity))


def best_fit(counts: Mapping[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, many equal bins at a time."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((lengths, times))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, lengths, times = capacity, (), left
            else:
                room = rooms[at]
                lengths, times = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            each = min(room // size, left)
            used = min(times, left // each)
            left -= used * each
            put(room - each * size, lengths + (size,) * each, used)
            if lengths and times > used:
                put(room, lengths, times - used)
    return [bin_ for bins in open_bins.values() for bin_ in bins]


def _fillings(counts: list[int], room: int, limit: int) -> list[tuple[int, ...]]:
    """Fillings of ``room`` with the least waste, long pieces before short ones.

    A filling that wastes more, or that has several pieces where one as long as all of
    them would do, is dominated; for equal waste those with the longest pieces come first.
    """
    sizes = [s for s in range(1, room + 1) if counts[s]]
    # Bit r of sums[k]: room r can be filled exactly with pieces of the first k sizes.
    mask, reach = (1 << (room + 1)) - 1, 1
    sums = [reach]
    for size in sizes:
        most, step = min(counts[size], room // size), 1
        while most:
            step = min(step, most)
            reach |= (reach << (step * size)) & mask
            most -= step
            step *= 2
        sums.append(reach)
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int, k: int) -> None:
        if left == 0:
            found.append(chosen)
            return
        for j in range(min(k, bisect_right(sizes, left)) - 1, -1, -1):
            if not sums[j + 1] >> left & 1:
                return  # the sizes up to this one cannot fill it
            size = sizes[j]
            for times in range(1, min(counts[size], left // size) + 1):
                if sums[j] >> (left - times * size) & 1:
                    extend((*chosen, *(size,) * times), left - times * size, j)
                    if len(found) >= limit:
                        return

    extend((), reach.bit_length() - 1, len(sizes))
    return found


def complete(
    counts: Mapping[int, int], capacity: int, nodes: int = NODES, branches: int = BRANCHES
) -> Plan:
    """Bin completion with branch and bound; the plan with the fewest bins found."""
    best = best_fit(counts, capacity)
    fewest = sum(times for _, times in best)
    bound = least_bins(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    start = [0] * (capacity + 1)
    for size, n in counts.items():
        start[size] = n
    # A branch: pieces left, bins used, tokens wasted, the plan so far as a linked list.
    stack = [(start, 0, 0, None)]
    while stack and fewest > bound and nodes:
        left, bins, waste, plan = stack.pop()
        nodes -= 1
        # A plan with one bin less than the best may waste this much.
        if waste > (fewest - 1) * capacity - total:
            continue
        longest = max((s for s, n in enumerate(left) if n), default=0)
        if not longest:
            fewest, best = bins, []
            while plan:
                best.append(plan[0])
                plan = plan[1]
            continue
        left[longest] -= 1  # the piece itself is not there to fill its own bin
        fillings = _fillings(left, capacity - longest, branches)
        left[longest] += 1
        for filling in reversed(fillings):
            lengths = (longest, *filling)
            times = min(left[s] // lengths.count(s) for s in set(lengths))
            rest = left.copy()
            for s in lengths:
                rest[s] -= times
            wasted = (capacity - sum(lengths)) * times
            stack.append((rest, bins + times, waste + wasted, ((lengths, times), plan)))
    return best


class Places:
    """Sequence and offset for the n-th piece of each length."""

    def __init__(self, plan: Plan, capacity: int):
        taken = [0] * (capacity + 1)
        keys, firsts, sequences, offsets = [], [], [], []
        sequence = 0
        for lengths, times in plan:
            at = 0
            for size in lengths:
                keys.append((size << 48) + taken[size])
                firsts.append(taken[size])
                sequences.append(sequence)
                offsets.append(at)
                taken[size] += times
                at += size
            sequence += times
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.firsts = np.array(firsts, np.int64)[order]
        self.sequences = np.array(sequences, np.int64)[order]
        self.offsets = np.array(offsets, np.int64)[order]

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 48) + number, side="right") - 1
        return self.sequences[at] + number - self.firsts[at], self.offsets[at]


PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, part int, nth bigint, "
    "ids binary"
)


def token_pieces(
    docs: DataFrame,
    capacity: int,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    added: bool = True,
    pieces_kept: int = PIECES_KEPT,
) -> DataFrame:
    """Each document's ids in pieces; ``nth`` counts the part's pieces of that length.

    Ids are little-endian 32-bit numbers, one after the other.

    Only documents of more than ``capacity`` ids are cut. Then all pieces but the first
    have ``capacity`` ids and the first has the rest.
    """
    model = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, ids in token_batches(batches, model, end_id, added, pieces_kept):
            columns = [[], [], [], [], [], [], []]
            for doc, tokens in zip(rows.column("doc_id").to_pylist(), ids, strict=True):
                at, length = 0, len(tokens) % capacity or capacity
                for piece in range(-(-len(tokens) // capacity)):
                    row = doc, piece, at, length, part, seen[length]
                    for column, value in zip(columns, row, strict=False):
                        column.append(value)
                    columns[-1].append(tokens[at : at + length].tobytes())
                    seen[length] += 1
                    at, length = at + length, capacity
            yield pa.record_batch(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int32()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.int64()),
                    pa.array(columns[4], pa.int32()),
                    pa.array(columns[5], pa.int64()),
                    pa.array(columns[6], pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "part", "nth", "ids"],
            )

    texts = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInArrow(encode, PIECES)


def pack(
    docs: DataFrame,
    *,
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    nodes: int = NODES,
    added: bool = True,
    pieces_kept: int = PIECES_KEPT,
) -> DataFrame:
    """One row per piece: its ids, its sequence and its place there.

    The tokenizer file's added tokens in a text become their own ids, unless ``added`` is
    false: then they are text like other. ``pieces_kept`` bounds what a worker remembers of
    its texts: it is memory against time, the ids are the same.

    Columns: doc_id, piece, start, length, ids (little-endian 32-bit numbers), sequence_id,
    offset. Null text is empty: a
    piece of the end id alone. Rows with equal or null doc_id are packed as documents of
    their own. Other columns are not read. No rows give no pieces. Sequences have no gaps
    from offset 0 on.
    """
    spark = docs.sparkSession
    pieces = settle(token_pieces(docs, capacity, tokenizer, end_id, added, pieces_kept), "pieces")
    per_part = settle(
        pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts"
    )
    histogram = per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # <= capacity
    plan = complete({r.length: r.n for r in histogram}, capacity, nodes)
    places = spark.sparkContext.broadcast(Places(plan, capacity))
    by_part = Window.partitionBy("length").orderBy("part")
    firsts = per_part.select(
        "part", "length", (F.sum("n").over(by_part) - F.col("n")).alias("first")
    )
    if per_part.count() <= SMALL:
        firsts = F.broadcast(firsts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(k).to_numpy() for k in ("length", "number"))
            sequence, offset = places.value.of(length, number)
            yield pa.record_batch(
                [
                    *(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids")),
                    pa.array(sequence),
                    pa.array(offset),
                ],
                names=out.names,
            )

    numbered = pieces.join(firsts, ["part", "length"]).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids",
        (F.col("first") + F.col("nth")).alias("number"),
    )
    out = numbered.drop("number").schema
    out = out.add("sequence_id", LongType()).add("offset", LongType())
    return numbered.mapInArrow(place, out)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids in place order, and where each document begins.

    A sequence holds at most ``capacity`` ids, so no group is large.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            joined.alias("ids"),
            F.transform("parts", lambda p: p.dropFields("ids")).alias("documents"),
        )
    )

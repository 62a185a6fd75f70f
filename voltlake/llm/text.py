"""Text rules the corpus operators share: ASCII lower-casing, words, 64-bit hashes."""

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
# What bytes.split() and bytes.strip() take as white space is exactly this set.
SPACES = b" \t\n\x0b\x0c\r"
# The same set for Spark's expressions.
SPACES_TEXT = SPACES.decode()

_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else.

    ``lower`` does the same on texts of ASCII alone and is much faster there.
    """
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finisher)."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def words(text: bytes) -> list[bytes]:
    """Lower-cased words between runs of white space."""
    return text.translate(ASCII_LOWER).split()


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words.

    Fewer words make one shingle, no words none.
    """
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    runs = max(1, len(found) - size + 1)
    value = np.full(runs, np.uint64(min(size, len(found))))
    for k in range(min(size, len(found))):
        value = mixed(value * _STEP + hashed[k : k + runs])
    return np.unique(value)


# Arrow batches are built in memory on both sides of a Python worker, beside the heap.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; its session sends texts to Python in batches of bounded size."""
    for name, value in BATCH.items():
        df.sparkSession.conf.set(name, value)
    return df


# What forgets things that a Python worker remembers from task to task.
FORGET: list[Callable[[], None]] = []


# Bytes of text that a task turns into Python objects at a time.
SLICE_BYTES = 2 << 20


def sliced(
    batches: Iterator[pa.RecordBatch], column: str = "text", *, forget: bool = True
) -> Iterator[pa.RecordBatch]:
    """The rows in runs of about ``SLICE_BYTES`` of text; a longer text makes its own run.

    Lists of Python objects take several times the memory of a batch. Workers go from one
    operator to the next, so what another one remembers there goes first.
    """
    for clear in FORGET if forget else ():
        clear()
    pa.default_memory_pool().release_unused()  # what the task before left
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        run = np.cumsum(size, dtype=np.int64) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            if b > a:
                yield batch.slice(a, b - a)


def long_lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit hashes as one Arrow column of bigint lists."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))

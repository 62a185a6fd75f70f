"""Whole texts to token ids with a byte-level BPE file, as little-endian 32-bit bytes.

Such a tokenizer splits a text by a pattern before it merges bytes, and never across the
place where white space follows something else. So a text is cut at those places, each
distinct piece is split and merged by the tokenizer once per Python worker, and the pieces'
ids are put together; they equal those of the whole text (tested). This saves encoding
frequent words again and again.
"""

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType
from tokenizers import Tokenizer

from voltlake.llm.text import FORGET, sliced

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
# What the tokenizer's pattern takes as white space besides blank and line end.
OTHER_SPACE = "\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B))
)
_PIECE = re.compile(f"[ \n{OTHER_SPACE}]*[^ \n{OTHER_SPACE}]+|[ \n{OTHER_SPACE}]+")
# Places where a cut at blanks and line ends alone would split a run of white space.
_RUNS = ("  ", "\n\n", "\n ", " \n")
# Distinct pieces of a kind that a Python worker remembers at most; older ones it has not met
# since go. 175 MB a worker by 83 MB of documents of the check tool.
PIECES_KEPT = 1_000_000


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Remembered(dict):
    """A dictionary of bounded size that computes what it lacks.

    When half the bound is reached all entries become old; an old one that is met again is
    kept, the others go the next time.
    """

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def age(self, bound: int) -> None:
        if 2 * len(self) > bound:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.made(key)
        self[key] = ids
        return ids


class _Words(_Remembered):
    """Ids of what the pattern finds."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.merge = tokenizer.model.tokenize
        self.letters = _byte_letters()

    def made(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(letters)]).tobytes()


class _Pieces(_Remembered):
    """Ids of pieces of text."""

    def __init__(self, words: _Words):
        super().__init__()
        self.words = words
        self.found = regex.compile(public_tokenizers.PATTERN).findall

    def made(self, piece: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.found(piece)))


class _AfterBlank(_Remembered):
    """Ids of pieces that begin with a blank, by what follows it, or with a line end.

    The usual shapes need no pattern: letters are one word, and a last character that is
    no letter is another.
    """

    def __init__(self, pieces: _Pieces):
        super().__init__()
        self.pieces, self.words = pieces, pieces.words
        self.merge, self.blank = pieces.words.merge, pieces.words.letters[ord(" ")]

    def made(self, part: str) -> bytes:
        head, last = part[:-1], part[-1:]
        if head.isalpha() and not last.isalpha():
            return self[head] + self.words[last]
        if part[:1] == "\n":
            rest = part[1:]
            return self.words["\n"] + self.words[rest] if rest.isalpha() else self.pieces.made(part)
        return self.words.made(" " + part) if part.isalpha() else self.pieces.made(" " + part)

    def __missing__(self, part: str) -> bytes:
        # Most of what is met for the first time; no further calls.
        ids = self.old.get(part)
        if ids is None:
            if part.isascii() and part.isalpha():
                ids = array("I", [t.id for t in self.merge(self.blank + part)]).tobytes()
            else:
                ids = self.made(part)
        self[part] = ids
        return ids


class Encoder:
    """Ids of texts, remembering those of pieces up to a bound.

    With ``added``, a text that holds one of the file's added tokens is left to the
    library, which makes one id of it; without, such a token is text like other.
    """

    def __init__(self, path: str, pieces_kept: int = PIECES_KEPT, added: bool = False):
        self.pieces_kept = pieces_kept
        self.whole = Tokenizer.from_file(path)
        tokens = self.whole.get_added_tokens_decoder().values() if added else ()
        self.added = [t.content for t in tokens]
        self.pieces = _Pieces(_Words(self.whole))
        self.after_blank = _AfterBlank(self.pieces)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        for known in (self.pieces.words, self.pieces, self.after_blank):
            known.age(self.pieces_kept)
        has = text.__contains__
        if any(map(has, self.added)):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if any(map(has, _RUNS)) or any(map(has, OTHER_SPACE)):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))
        # Single blanks and line ends only: cut at blanks and before line ends.
        first, *parts = text.replace("\n", " \n").split(" ")
        start = self.pieces[first] if first else b""
        return start + b"".join(map(self.after_blank.__getitem__, parts))


@lru_cache(maxsize=1)
def encoder(path: str, added: bool = False, pieces_kept: int = PIECES_KEPT) -> Encoder:
    """One encoder per Python worker, tokenizer file, way with added tokens and bound."""
    return Encoder(path, pieces_kept, added)


FORGET.append(encoder.cache_clear)


def tokenizer_path(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


def token_batches(
    batches: Iterator[pa.RecordBatch],
    path: str,
    end_id: int,
    added: bool = False,
    pieces_kept: int = PIECES_KEPT,
) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows with a ``text`` column, with each row's ids and the end id; null is empty."""
    end = np.array([end_id], "<u4").tobytes()
    encode = encoder(path, added, pieces_kept).encode
    for rows in sliced(batches, forget=False):
        texts = rows.column("text").to_pylist()
        yield rows, [np.frombuffer(encode(t or "") + end, "<u4") for t in texts]


def id_lists(encoded: list[np.ndarray]) -> pa.ListArray:
    """Ids of several texts as one Arrow column of integer lists."""
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(e) for e in encoded], out=offsets[1:])
    flat = np.concatenate(encoded).astype(np.int32) if encoded else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def id_checksums(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and ``ids_crc32`` of each row's ``ids`` as 32-bit little-endian."""
    schema = df.select(*columns).schema.add("ids_crc32", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            cuts = ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in pairwise(cuts)]
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(sums, pa.int64())], names=schema.names
            )

    return df.select(*columns, "ids").mapInArrow(run, schema)

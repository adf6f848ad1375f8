"""Sum-of-squares packing of token ids into windows.

A document's ids are cut into whole windows; what is left over, shorter than a window, is placed online. Among the
fill levels that have an open window, and an empty one, the piece goes where the sum over all
levels of the squared number of open windows at that level gets smallest, which keeps levels
varied and so keeps partners at hand for later pieces. The numbers stand in one array by level.

Each task packs the rows of its own input split, so nothing is shuffled and a lost executor
repeats its splits only. At the end of a split, or when too many windows are open, open
windows are refilled: their pieces are cut where a window ends. The ids that then remain, less than one
window a split, go into windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from duefold.llm.common import column

WINDOW = 2048
MOST_OPEN = 4096
CACHED_WORDS = 400_000
END_ID = 1

_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = ", ".join(f"{name} long" for name in _COLUMNS)


def _printable_bytes() -> dict[int, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, others follow at 256."""
    itself = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in itself]
    return {b: 256 + k for k, b in enumerate(others)}


_PRINTABLE = _printable_bytes()
#: Letters, then marks that neither start a contraction nor hold a letter, digit or special token.
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-;=-@\[-`{-~]+)")


class WordTokenizer:
    """Ids of a tokenizer whose tokens never cross white space, as little-endian 32-bit integers.

    A text is cut at blanks and line ends, and the ids of each piece are looked up, so a
    frequent word is tokenized once a process. The cache has a bound; when it is full a new one starts,
    which takes over what is still asked for. Plain words go to the tokenizer's model directly, once for
    all their capitals and the marks behind them, others through its normalizer and pre-tokenizer first.
    """

    def __init__(self, path: str) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model

    def ids(self, text: str) -> bytes:
        if len(self.known) > CACHED_WORDS // 2:
            self.older, self.known = self.known, {"": b""}
        words = text.replace("\n", " ").split(" ")
        found = list(map(self.known.get, words))
        if None in found:
            found = [self._cached(w) if ids is None else ids for w, ids in zip(words, found)]
        return b"".join(found)

    def _cached(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                found = self._word(word)
            self.known[word] = found
        return found

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            lower = _plain(word)
            if lower is not None:
                return self._cached(lower) if lower != word else self._letters(lower)
        elif marked := _MARKED.fullmatch(word):
            head, marks = marked.groups()
            lower = _plain(head) if head.isalpha() else None
            if lower is not None:
                return self._cached(lower) + self._cached(marks)
        if "<|" in word:  # may hold a special token
            ids = self.whole.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        parts = self.whole.pre_tokenizer.pre_tokenize_str(
            self.whole.normalizer.normalize_str(word)
        )
        return b"".join(self._packed(self.model.tokenize(part)) for part, _ in parts)

    def _letters(self, lower: str) -> bytes:
        if not lower.isascii():
            lower = lower.encode().decode("latin-1").translate(_PRINTABLE)
        return self._packed(self.model.tokenize(lower))

    @staticmethod
    def _packed(tokens: list) -> bytes:
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])


def _plain(word: str) -> str | None:
    """Letters in lower case if the normalizer does nothing else to them, else None."""
    lower = word.lower()
    # Latin letters have no forms that depend on their neighbours.
    if word.isascii() or max(word) < "\u0250" and unicodedata.is_normalized("NFC", word) and lower.isalpha():
        return lower
    return None


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Packer:
    """Packs documents one after another; pieces come out when their window is closed."""

    def __init__(self, window: int, first_sequence: int) -> None:
        self.window = window
        self.sequence = first_sequence
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.count = np.zeros(window + 1, np.int64)
        self.n_open = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            piece = (doc_id, start, ids[4 * start : 4 * (start + self.window)], total)
            yield from self._close([piece])
        if whole < total:
            yield from self._place((doc_id, whole, ids[4 * whole :], total))

    def _place(self, piece: tuple) -> Iterator[tuple]:
        size = len(piece[2]) // 4
        # Growth of the sum of squares for each level the piece could be put on top of: a
        # window leaves its level and enters a higher one, unless it gets full there.
        enters = 2 * self.count[size:] + 1
        enters[-1] = 0
        growth = enters + np.where(
            self.count[: len(enters)] > 0, 1 - 2 * self.count[: len(enters)], 1 << 40
        )
        growth[0] = enters[0]
        level = int(growth.argmin())
        pieces = self.open[level].pop() if level else []
        pieces.append(piece)
        self.count[level] -= level > 0
        self.n_open -= level > 0
        if level + size == self.window:
            yield from self._close(pieces)
            return
        self.open[level + size].append(pieces)
        self.count[level + size] += 1
        self.n_open += 1
        if self.n_open > MOST_OPEN:
            yield from self.refill(last=False)

    def refill(self, last: bool) -> Iterator[tuple]:
        """Close all open windows, cutting pieces at window ends; ``last`` leaves none open."""
        rest: list[tuple] = []
        held = 0
        for level in range(self.window - 1, 0, -1):
            for pieces in self.open[level]:
                for piece in pieces:
                    rest.append(piece)
                    held += len(piece[2]) // 4
                    if held >= self.window:
                        full, rest = _cut(rest, self.window)
                        held -= self.window
                        yield from self._close(full)
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        self.n_open = 0
        if not last and held:
            self.open[held].append(rest)
            self.count[held] = self.n_open = 1
            return
        while held:
            part = 1 << (held.bit_length() - 1)
            full, rest = _cut(rest, part)
            held -= part
            yield from self._close(full)

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1


def _cut(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
    """The first ``size`` ids of some pieces, and the rest."""
    head: list[tuple] = []
    for k, (doc_id, start, ids, total) in enumerate(pieces):
        length = len(ids) // 4
        if length >= size:
            head.append((doc_id, start, ids[: 4 * size], total))
            rest = [(doc_id, start + size, ids[4 * size :], total)] if length > size else []
            return head, rest + pieces[k + 1 :]
        head.append((doc_id, start, ids, total))
        size -= length
    return head, []


def _packed(path: str, window: int):
    end = np.array([END_ID], "<u4").tobytes()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = tokenizer.ids(text.as_py() or "") + end
                rows += packer.add(doc_id.as_py(), ids)
                if len(rows) >= 1 << 14:
                    yield batch_of(rows)
                    rows = []
        rows += packer.refill(last=True)
        if rows:
            yield batch_of(rows)

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and then id 1. Null and empty texts have that id only. Long texts fill
    windows of their own and leave one shorter piece. Repeated rows and null ids are packed like any
    other. An empty table returns no rows. Other columns are ignored.
    ``tokenizer_path`` must be readable on every executor.
    """
    rows = docs.select(
        column(id_column).cast("long").alias("doc_id"), column(text_column).alias("text")
    )
    return rows.mapInArrow(_packed(tokenizer_path, window), _SCHEMA).withColumnRenamed(
        "doc_id", id_column
    )

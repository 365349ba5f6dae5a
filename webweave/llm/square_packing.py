"""Online packing of token sequences by the sum-of-squares rule over fill levels."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from webweave.llm.common import id_and_text
from webweave.llm.packing import WordTokenizer

#: Tokens in partly filled windows that a task holds before it closes them all: a bound of memory.
HELD_TOKENS = 8_000_000
#: Sequence ids are the task's number times this, plus a running number within the task.
TASK_SEQUENCES = 1 << 40

_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
]
_SCHEMA = pa.schema(_FIELDS)
_DDL = ", ".join(f"{name} {'binary' if kind == pa.binary() else 'long'}" for name, kind in _FIELDS)
_ROWS = 2_000

# (doc_id, start, ids as bytes, tokens of the document)
Piece = tuple[int | None, int, bytes, int]


class Levels:
    """How many windows are filled up to each level, and the level at which the next piece does best.

    A window counts while it would have to be padded: a level of 0, of ``size`` or of a power of two
    does not, all others do. A piece goes where the sum of the squared counts grows least (or falls
    most); of equally good places to the fullest one.
    """

    def __init__(self, size: int) -> None:
        self.size = size
        self.windows = np.zeros(size + 1, np.int64)
        self.counted = np.ones(size + 1, np.int64)
        self.counted[[0, size]] = 0
        self.counted[[1 << k for k in range(size.bit_length())]] = 0

    def place(self, length: int) -> int:
        """The level of the window that takes the piece (0: a new window); counts are updated."""
        room = self.size - length
        now = self.windows * self.counted
        after = (2 * now[length:] + 1) * self.counted[length:]
        before = (2 * now[: room + 1] - 1) * self.counted[: room + 1]
        change = after - before
        there = self.windows[: room + 1] > 0
        there[0] = True
        change[~there] = np.iinfo(np.int64).max
        level = room - int(np.argmin(change[::-1]))
        if level:
            self.windows[level] -= 1
        if level + length < self.size:
            self.windows[level + length] += 1
        return level


class Packer:
    """Windows of one task: pieces come in one by one, finished windows go out as rows."""

    def __init__(self, size: int, first_id: int) -> None:
        self.size, self.next_id = size, first_id
        self.held = 0
        self._reset()

    def _reset(self) -> None:
        self.levels = Levels(self.size)
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        """Take a document; whole windows of a longer one are full at once, its rest is placed."""
        total = len(ids) // 4
        whole = total - total % self.size
        for start in range(0, whole, self.size):
            yield from self._close([(doc_id, start, ids[4 * start : 4 * (start + self.size)], total)])
        if whole == total:
            return
        piece = (doc_id, whole, ids[4 * whole :], total)
        length = total - whole
        level = self.levels.place(length)
        window = self.open[level].pop() if level else []
        window.append(piece)
        if level + length == self.size:
            self.held -= level
            yield from self._close(window)
        else:
            self.held += length
            self.open[level + length].append(window)
            if self.held > HELD_TOKENS:
                yield from self.finish()

    def finish(self) -> Iterator[tuple]:
        """Close what is open: the emptiest windows are cut up to fill the fullest ones.

        The last one is cut into windows of powers of two, so that nothing at all is padded.
        """
        left = []
        for level in sorted(self.open, reverse=True):
            for window in self.open[level]:
                if self.levels.counted[level]:
                    left.append((level, window))
                else:
                    yield from self._close(window)
        i, j = 0, len(left) - 1
        while i < j:
            level, window = left[i]
            donor_level, donor = left[j]
            taken = self._take(donor, min(self.size - level, donor_level))
            window.extend(taken)
            moved = sum(len(p[2]) // 4 for p in taken)
            left[i], left[j] = (level + moved, window), (donor_level - moved, donor)
            if not left[j][0]:
                j -= 1
            if left[i][0] == self.size:
                yield from self._close(window)
                i += 1
        if i == j:
            level, window = left[i]
            for k in range(level.bit_length()):
                if level >> k & 1:
                    yield from self._close(self._take(window, 1 << k))
        self.held = 0
        self._reset()

    @staticmethod
    def _take(window: list[Piece], tokens: int) -> list[Piece]:
        """Take that many tokens off the end of a window; a piece is cut where they begin."""
        taken = []
        while tokens:
            doc_id, start, ids, total = window.pop()
            n = len(ids) // 4
            if n > tokens:
                window.append((doc_id, start, ids[: 4 * (n - tokens)], total))
                doc_id, start, ids, total = doc_id, start + n - tokens, ids[4 * (n - tokens) :], total
                n = tokens
            taken.append((doc_id, start, ids, total))
            tokens -= n
        return taken[::-1]

    def _close(self, window: list[Piece]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in window:
            n = len(ids) // 4
            yield doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset, ids
            offset += n
        self.next_id += 1


@cache
def _tokenizer(path: str) -> WordTokenizer:
    """One per worker and file."""
    return WordTokenizer(path)


def pack_online(
    docs: DataFrame, path: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): a row per piece.

    Sum of squares (Csirik et al. 2006): every document goes, as it comes, into the window whose new
    fill level leaves the sum of squared counts of partly filled windows smallest; the counts per
    level are all that decides. Documents of more than ``size`` ids fill whole windows and place
    their rest. Each task packs its share of the rows in one pass and without a shuffle; a task that
    starts again gives the same rows. What is partly filled at its end, or once ``HELD_TOKENS`` are
    held, is closed by cutting the emptiest windows to fill the fullest, and the last one into powers
    of two, so each sequence has ``size`` ids or a power of two and nothing is padded.

    Ids end with ``end_id``. Null or empty text: the end id alone. Null ids are kept. Rows that repeat
    are packed each; equally good places go to the fullest. A very long text is cut at every ``size``
    ids. ``ids`` (little-endian unsigned 32-bit) is null without ``keep_ids``. Empty table: no rows.
    """
    if size < 1 or size & size - 1:
        raise ValueError("the window size must be a power of two")
    end = np.asarray([end_id], "<u4").tobytes()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        if not keep_ids:
            columns[-1] = [None] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        packer = Packer(size, TaskContext.get().partitionId() * TASK_SEQUENCES)
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                for row in packer.add(doc_id.as_py(), tokenizer.encode(text.as_py()) + end):
                    rows.append(row)
                    if len(rows) >= _ROWS:
                        yield batch_of(rows)
                        rows = []
        for row in packer.finish():
            rows.append(row)
            if len(rows) >= _ROWS:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, _DDL)

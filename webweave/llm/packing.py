"""Packing of token sequences by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from webweave.llm.common import Memory, id_and_text
from webweave.session import materialize

#: Words whose ids a worker remembers, in each of two generations: a bound of memory only.
REMEMBERED = 200_000
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("slice", pa.int32()), ("nth", pa.int64()),
])


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Length -> how many of it: the combination of available lengths that fills most of ``capacity``.

    Subset sums as the bits of one integer; the sums before each item are kept to walk back. Ends at
    an exact fill; longer pieces are taken up first.
    """
    reach, mask, trail = 1, (1 << capacity + 1) - 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, many = min(counts[length], capacity // length), 1
        while left:
            many = min(many, left)
            trail.append((reach, length, many))
            reach |= reach << length * many & mask
            left -= many
            many *= 2
        if reach >> capacity:
            break
    fill, used = reach.bit_length() - 1, {}
    for before, length, many in reversed(trail):
        if not before >> fill & 1:
            used[length] = used.get(length, 0) + many
            fill -= length * many
    return used


def plan_bins(counts: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, the lengths in each): every bin has the longest piece left and the fullest rest.

    A combination is taken for as many bins as the counts allow, so the work follows the number of
    lengths (``size`` at most), not that of the pieces.
    """
    counts, plan = {k: n for k, n in counts.items() if n}, []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        bin_ = fullest({k: n for k, n in counts.items() if n}, size - seed)
        counts[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in bin_.items())
        plan.append((times, bin_))
        for k, n in bin_.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return plan


class WordTokenizer:
    """Encodes texts word by word with a BPE of word ends that drops white space, and remembers words.

    The tokenizer lower-cases, drops white space and joins nothing across it, nor letters with full
    stops and commas; so equal words between blanks have equal ids, and each is encoded once while
    it is remembered. New words of letters only need no more than the model, which takes many at a
    time: their ids end with a token of a word's end each.
    """

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        model = json.loads(self.whole.to_str())["model"]
        self.letters = Tokenizer(models.BPE(
            vocab=model["vocab"], merges=[tuple(x) for x in model["merges"]],
            end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0,
        ))
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        ])
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for x, i in model["vocab"].items() if x.endswith(model["end_of_word_suffix"])]] = True
        self.stops = {x: self._ids(x) for x in ".,"}
        self.memory = Memory(REMEMBERED)

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if _ODD_BLANKS.search(text):
            return self._ids(text)
        words = (text if _NOT_PLAIN.search(text) else text.lower()).split()
        self._learn(self.memory.missing(set(words)))
        return b"".join(map(self.memory.now.__getitem__, words))

    def _learn(self, new: list[str]) -> None:
        now, before = self.memory.now, self.memory.before
        plain, stopped, others = set(), [], []
        for word in new:
            stem = word[:-1] if word[-1] in self.stops else word
            if not stem.isalpha() or stem != stem.lower() or _NOT_PLAIN.search(stem):
                others.append(word)
            elif stem is word:
                plain.add(word)
            else:
                stopped.append(word)
                if stem not in now and stem not in before:
                    plain.add(stem)
        self._add(list(plain), lambda part: (ids := np.asarray(
            self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4"
        ), np.append(0, np.flatnonzero(self.ends[ids]) + 1)))
        self._add(others, self._others)
        now.update((x, (now.get(x[:-1]) or before[x[:-1]]) + self.stops[x[-1]]) for x in stopped)

    def _others(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.whole.encode(part, is_pretokenized=True, add_special_tokens=False)
        return np.asarray(found.ids, "<u4"), np.searchsorted(np.asarray(found.word_ids, np.int64), np.arange(len(part) + 1))

    def _add(self, words: list[str], encode) -> None:
        """Encode words, many at a time, by a function that returns all ids and where each word's begin."""
        for i in range(0, len(words), 1_000):
            part = words[i : i + 1_000]
            ids, cuts = encode(part)
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            self.memory.now.update((word, raw[a:b]) for word, a, b in zip(part, cuts, cuts[1:], strict=False))


# What Python and the tokenizer may take for blanks differently; and what is neither a
# plain blank nor of the scripts whose lower case and composition need no context.
_ODD_BLANKS = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
_NOT_PLAIN = re.compile("[^\t-\r -~\xa1-\u012f\u0131-\u024f]")


@cache
def _tokenizer(path: str) -> WordTokenizer:
    """One per worker and file."""
    return WordTokenizer(path)


def token_pieces(
    docs: DataFrame, path: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, slice, nth): the pieces of each document's ids.

    Ids end with ``end_id``; only documents of more than ``size`` ids are cut. ``slice`` and ``nth``
    number the pieces of one length within a task's share of the input.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        here, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids = tokenizer.encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    n = len(part) // 4
                    nth = seen[n] = seen.get(n, -1) + 1
                    rows.append((doc_id.as_py(), piece, at // 4, n, zlib.crc32(part), part if keep_ids else None, here, nth))
                if len(rows) >= 1_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), _PIECES.types)], schema=_PIECES)

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, slice int, nth long"
    )


def _placing(plan: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, by rank: first rank, first sequence, pieces of the length per bin, their offset."""
    entries: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, bin_ in plan:
        offset = 0
        for length in sorted(bin_, reverse=True):
            many = bin_[length]
            entries.setdefault(length, []).append((used.get(length, 0), first, many, offset))
            used[length] = used.get(length, 0) + times * many
            offset += length * many
        first += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows)) for length, rows in entries.items()}


def pack(
    docs: DataFrame, path: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset): a row per piece of a document.

    Minimum bin slack: each sequence starts with the longest piece left, and subset sums over the
    lengths at hand find the fullest rest. The plan needs only how many pieces each length has, at
    most ``size`` numbers whatever the corpus holds; so do the broadcast places. Pieces take their
    places by rank among those of their length, counted per task and added up, so no length is
    gathered in one task.

    Null or empty text: the end id alone. Null ids are kept. Rows that repeat are packed each.
    ``ids`` (little-endian unsigned 32-bit) is null without ``keep_ids``. Empty table: no rows.
    """
    pieces = materialize(token_pieces(docs, path, size, end_id, id_col, text_col, keep_ids))
    per_slice = materialize(pieces.groupBy("length", "slice").agg((F.max("nth") + 1).alias("many")))
    counts = {r.length: r.many for r in per_slice.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("length", "slice", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["length", "slice"]).withColumn("rank", F.col("nth") + F.col("_before"))
    places = docs.sparkSession.sparkContext.broadcast(_placing(plan_bins(counts, size)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths, ranks):
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            first_rank, first, many, start = places.value[int(n)]
            entry = np.searchsorted(first_rank, rank[at], "right") - 1
            inside = rank[at] - first_rank[entry]
            sequence[at] = first[entry] + inside // many[entry]
            offset[at] = start[entry] + inside % many[entry] * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # only lengths and ranks go through Python, the ids stay with Spark
    return ranked.withColumn("_at", place("length", "rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", "_at.sequence_id", "_at.offset"
    )

"""Byte-level BPE by replaying the merges of a rank file over the corpus's pieces."""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from webweave.llm.common import Memory, id_and_text

#: Bounds of memory only: pieces replayed together, and pieces whose ids a worker remembers.
REPLAYED, REMEMBERED = 20_000, 600_000
# Fixed value: the pattern whose pieces take up one blank before them and no other.
_BLANK_LED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.binary())])
_DIGESTS = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
])


class MergeReplay:
    """The merges of a rank file, applied to many pieces at once in rank order.

    All pieces lie in one array of symbols with links to their neighbours. An inverted index leads
    from each pair of symbols, named by the rank of its merge, to the positions where it stands. The
    lowest rank in the index is merged at all its positions, left to right; only the pairs with the
    two neighbours change, and are entered anew. A piece in which a merge makes a pair of lower rank
    than its own (no trained vocabulary has such) is done again by itself.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.symbol = [ranks[bytes([b])] for b in range(256)]
        self.bytes = {str(rank): token for token, rank in ranks.items()}
        self.merge: dict[int, int] = {}  # two symbols, the left one 20 bits up, and the rank they merge to
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merge[left << 20 | right] = rank

    def encode(self, pieces: Sequence[bytes]) -> list[list[int]]:
        """The ids of each piece; a piece that is a token has that one."""
        out: list[list[int] | None] = [[self.ranks[p]] if p in self.ranks else None for p in pieces]
        todo = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(todo, self._replay([pieces[i] for i in todo])):
            out[i] = ids
        return out

    def decode(self, ids: str) -> bytes:
        """The bytes of decimal ids joined by one space."""
        return b"".join(map(self.bytes.__getitem__, ids.split(" "))) if ids else b""

    def _replay(self, pieces: Sequence[bytes]) -> list[list[int]]:
        symbol, merged = self.symbol, self.merge.get
        token: list[int] = []
        starts: list[int] = []
        for piece in pieces:
            starts.append(len(token))
            token += [symbol[b] for b in piece]
            token.append(-1)  # no pair crosses the end of a piece
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [merged(a << 20 | b, -1) for a, b in zip(token, token[1:])]
        pair.append(-1)
        places: dict[int, list[int]] = {}
        for at, rank in enumerate(pair):
            if rank >= 0:
                places.setdefault(rank, []).append(at)
        waiting = list(places)
        heapify(waiting)
        again: set[int] = set()

        def enter(start: int, new: int, rank: int) -> None:
            if new < rank:
                again.add(bisect_right(starts, start) - 1)
            if new in places:
                places[new].append(start)
            else:
                places[new] = [start]
                heappush(waiting, new)

        while waiting:
            rank = heappop(waiting)
            here = places.pop(rank)
            here.sort()
            for at in here:
                if pair[at] != rank:
                    continue  # a merge before this one has taken a part of it
                gone = after[at]
                right = after[gone]
                token[at], token[gone], pair[gone], after[at], before[right] = rank, -2, -1, right, at
                pair[at] = new = merged(rank << 20 | token[right], -1) if token[right] >= 0 else -1
                if new >= 0:
                    enter(at, new, rank)
                left = before[at]
                if left >= 0 and token[left] >= 0:
                    pair[left] = new = merged(token[left] << 20 | rank, -1)
                    if new >= 0:
                        enter(left, new, rank)
        ends = [*starts[1:], n]
        out = [[t for t in token[a:b] if t >= 0] for a, b in zip(starts, ends)]
        for i in again:
            out[i] = self._alone(pieces[i])
        return out

    def _alone(self, piece: bytes) -> list[int]:
        ids = [self.symbol[b] for b in piece]
        while True:
            found = [(self.merge.get(a << 20 | b, -1), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
            rank, at = min((x for x in found if x[0] >= 0), default=(-1, -1))
            if rank < 0:
                return ids
            ids[at : at + 2] = [rank]


@cache
def replay_of(path: str) -> MergeReplay:
    """One per worker and rank file."""
    with open(path, "rb") as lines:
        return MergeReplay({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


# Fixed value: where the pieces of a text are not those of its blank-led words and its line ends.
_IRREGULAR = regex.compile(r"[^\S \n]|\s\s|\0")


class Encoder:
    """Ids of texts in decimal; remembers words with the blank before them, and the pieces in words."""

    def __init__(self, path: str, pattern: str) -> None:
        self.replay, self.pattern = replay_of(path), regex.compile(pattern)
        self.blank_led = pattern == _BLANK_LED
        self.words, self.pieces = Memory(REMEMBERED), Memory(REMEMBERED)

    def _split(self, text: str) -> list[str]:
        """Parts of a text that the pattern splits no differently than the text as a whole."""
        if not self.blank_led or _IRREGULAR.search(text):
            return self.pattern.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: Sequence[str]) -> list[str]:
        """The ids of each text, joined by one space; the new pieces of all are replayed together."""
        parts = [self._split(text) for text in texts]
        new = {word: self.pattern.findall(word) for word in self.words.missing(set().union(*parts))}
        pieces = self.pieces.missing(set().union(*new.values()))
        for i in range(0, len(pieces), REPLAYED):
            some = pieces[i : i + REPLAYED]
            for piece, ids in zip(some, self.replay.encode([p.encode("utf-8", "replace") for p in some])):
                self.pieces.now[piece] = " ".join(map(str, ids))
        known = self.pieces.now.__getitem__
        self.words.now.update((word, " ".join(map(known, own))) for word, own in new.items())
        return [" ".join(filter(None, map(self.words.now.__getitem__, own))) for own in parts]


@cache
def _encoder(path: str, pattern: str) -> Encoder:
    """One per worker, rank file and pattern."""
    return Encoder(path, pattern)


def _groups(batch: pa.RecordBatch, chars: int = 1_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and whole texts of a batch, a bounded number of characters (or one text) at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode_texts(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """Encode every whole text and decode the ids again; one row per row of ``docs``.

    (doc_id, n_tokens, ids, decoded): ids in decimal joined by one space, and the bytes that they
    decode to; with ``digests`` their SHA-256 in lower-case hex instead, (…, ids_sha256,
    decoded_sha256). ``path`` is a rank file that every machine has, ``pattern`` splits the text.
    Null text: the empty text, which has no ids. Null ids stay null. Nothing is shuffled; a task
    holds one batch of texts and the bounded memory of pieces.
    """
    schema = _DIGESTS if digests else _SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            for doc_ids, texts in _groups(batch):
                counts, ids, decoded = [], [], []
                for line in encoder.encode(texts):
                    counts.append(line.count(" ") + 1 if line else 0)
                    raw = encoder.replay.decode(line)
                    ids.append(hashlib.sha256(line.encode()).hexdigest() if digests else line)
                    decoded.append(hashlib.sha256(raw).hexdigest() if digests else raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip((doc_ids, counts, ids, decoded), schema.types)], schema=schema
                )

    kinds = "string, decoded_sha256 string" if digests else "string, decoded binary"
    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, f"doc_id long, n_tokens long, {'ids_sha256' if digests else 'ids'} {kinds}"
    )

"""Hashes of words and of word shingles, over whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Odd multipliers of the hashes, drawn once: bytes in a word (by powers of the first), words in a shingle.
_MULTIPLIERS = np.random.default_rng(20_240_501).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ x >> np.uint64(30)
    x = x * _MULTIPLIERS[60]
    x = x ^ x >> np.uint64(27)
    x = x * _MULTIPLIERS[61]
    return x ^ x >> np.uint64(31)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, _MULTIPLIERS[63])))


class Words:
    """The words ``[^ \\t-\\r]+`` of texts with A-Z lower-cased.

    ``hashes``: 64 bits per word of all texts in order; ``bounds``: text i has the words
    bounds[i] to bounds[i+1]; ``spans``: start and end byte of each word within its text in UTF-8.
    """

    def __init__(self, texts: Sequence[str]) -> None:
        raw = [text.encode("utf-8", "replace").lower() for text in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)])
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        before = np.concatenate([[True], blank[:-1]])
        starts = np.flatnonzero(~blank & before)
        ends = np.flatnonzero(blank & ~before)
        self.bounds = np.searchsorted(starts, first)
        if not len(starts):
            self.hashes, self.spans = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
            return
        at = np.zeros(len(data), np.int64)
        at[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
        at[blank] = 0
        value = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(at.max()) + 1)[at]
        value[blank] = 0
        self.hashes = mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * _MULTIPLIERS[62])
        self.spans = np.stack([starts, ends], 1) - np.repeat(first[:-1], np.diff(self.bounds))[:, None]

    def shingles(self, size: int) -> Iterator[np.ndarray]:
        """Per text the hashes of its shingles in order: one per word that ``size`` words start at.

        A text of fewer words has its whole sequence as one shingle, one without words none.
        """
        n = len(self.hashes)
        whole = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size if n >= size else 0):
            whole += self.hashes[k : n - size + 1 + k] * _MULTIPLIERS[k]
        whole = mix(whole)
        for a, b in zip(self.bounds, self.bounds[1:]):
            if b - a >= size:
                yield whole[a : b - size + 1]
            elif b > a:
                yield mix(np.append(self.hashes[a:b], np.uint64(b - a)) @ np.append(_MULTIPLIERS[: b - a], _MULTIPLIERS[59:60])[:, None])
            else:
                yield whole[:0]

"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweave.llm.common import Memory, id_and_text
from webweave.session import materialize

#: Labelled documents of each kind that the model is fitted on at most, by the order of a hash.
TOXIC_SAMPLE, CLEAN_SAMPLE = 2_000, 4_000
#: Words that the machine is trained on at most, and landmarks of the kernel's map.
CLEAN_WORDS, LANDMARKS = 6_000, 128
#: Letters of a common subsequence, and what each letter of its span counts.
ORDER, DECAY = 3, 0.6
#: A longer unit is scored by overlapping windows of this length.
WINDOW = 24
#: Words whose margins a worker remembers: a bound of memory only.
REMEMBERED = 600_000

_SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_LOOKALIKES = str.maketrans("013457@$", "oieastas")


class Machine(NamedTuple):
    """``table``: what each triple of the alphabet's letters adds to a margin, summed over the landmarks."""

    landmarks: tuple[str, ...]
    alphabet: dict[str, int]
    table: np.ndarray
    bias: float
    slope: float
    offset: float


def units(text: str) -> list[str]:
    """What is scored of a text: its words, and rows of three or more single characters as one word each."""
    words = text.lower().split()
    if _SPELLED.search(text):
        words += ["".join(x.lower().split()) for x in _SPELLED.findall(text)]
    return words


def letters(word: str) -> str:
    """A word's letters; among letters some digits and signs stand for those that they look like."""
    return word if word.isalpha() else "".join(c for c in word.translate(_LOOKALIKES) if c.isalpha())


def _codes(words: Sequence[str], width: int) -> np.ndarray:
    """(word, letter): code points of words of one length."""
    raw = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32).astype(np.int64).reshape(len(words), width)


@cache
def _triples(width: int) -> tuple[np.ndarray, ...]:
    """First, second and third place of every subsequence of three letters, and what its span counts."""
    i, j, k = (x.astype(np.int16) for x in np.array(list(combinations(range(width), ORDER)), np.int64).reshape(-1, ORDER).T)
    return i, j, k, (DECAY ** (k - i - 2).astype(np.float32)).astype(np.float32)


def _norms(codes: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of words, all of one length, with themselves."""
    apart = np.arange(codes.shape[1])[:, None] - np.arange(codes.shape[1])[None, :] - 1
    before = np.where(apart >= 0, DECAY ** np.maximum(apart, 0), 0).astype(np.float32)
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float32)
    ways = same
    for _ in range(ORDER - 1):
        ways = same * (before @ ways @ before.T)
    return np.sqrt(ways.sum((1, 2)))


def _by_length(words: Sequence[str], some: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and codes of words of one length, ``some`` at a time; words too short for the kernel are left out."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths[lengths >= ORDER]):
        at = np.flatnonzero(lengths == length)
        for i in range(0, len(at), some):
            yield at[i : i + some], _codes([words[k] for k in at[i : i + some]], int(length))


def _numbers(codes: np.ndarray, alphabet: dict[str, int]) -> np.ndarray:
    """Letters by their place in the alphabet; all others are 0, which no landmark has."""
    points = np.array([ord(c) for c in alphabet], np.int64)
    order = np.argsort(points)
    at = np.minimum(np.searchsorted(points[order], codes), len(points) - 1)
    return np.where(points[order][at] == codes, order[at] + 1, 0)


def _alphabet(landmarks: Sequence[str]) -> dict[str, int]:
    return {c: i for i, c in enumerate(sorted(set("".join(landmarks))), 1)}


def _spread(landmarks: Sequence[str], alphabet: dict[str, int]) -> np.ndarray:
    """(triple, landmark): each landmark as the vector of its subsequences, of length one."""
    size = len(alphabet) + 1
    out = np.zeros((size**3, len(landmarks)), np.float32)
    for at, codes in _by_length(landmarks, 1):
        i, j, k, weight = _triples(codes.shape[1])
        x = _numbers(codes, alphabet)[0]
        np.add.at(out[:, at[0]], (x[i] * size + x[j]) * size + x[k], weight)
        out[:, at[0]] /= _norms(codes)[0]
    return out


def _products(words: Sequence[str], table: np.ndarray, alphabet: dict[str, int]) -> np.ndarray:
    """Products of each word's vector of subsequences, of length one, with the table's columns."""
    out = np.zeros((len(words), *table.shape[1:]), np.float32)
    size = len(alphabet) + 1
    for at, codes in _by_length(words, 2_000 if table.ndim == 1 else 50):
        i, j, k, weight = _triples(codes.shape[1])
        x = _numbers(codes, alphabet)
        found = table[(x[:, i] * size + x[:, j]) * size + x[:, k]]
        total = found @ weight if table.ndim == 1 else np.einsum("ntm,t->nm", found, weight)
        out[at] = (total.T / _norms(codes)).T
    return out


def similarities(words: Sequence[str], landmarks: Sequence[str]) -> np.ndarray:
    """(word, landmark): the kernel normalised to 0..1; words of fewer than ORDER letters are like nothing.

    The kernel counts common subsequences of ORDER letters, each by DECAY to the letters between. It
    is the product of the words' vectors of weighted subsequences, which are few and are formed here.
    """
    alphabet = _alphabet(landmarks)
    return _products(words, _spread(landmarks, alphabet), alphabet)


def _windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def margins(words: Sequence[str], machine: Machine) -> np.ndarray:
    """The machine's margin of each word, the largest of its windows."""
    if not words:
        return np.zeros(0, np.float32)
    parts = [_windows(letters(w)) for w in words]
    values = _products([p for own in parts for p in own], machine.table, machine.alphabet) + np.float32(machine.bias)
    return np.maximum.reduceat(values, np.cumsum([0, *(len(own) for own in parts[:-1])]))


def _choose_landmarks(words: Sequence[str], number: int) -> list[str]:
    """Words that leave least of the others' kernel unexplained: each next is the one explained worst, the first of equals."""
    gram = similarities(words, words).astype(np.float64)
    residue, basis, chosen = np.diag(gram).copy(), np.zeros((len(words), 0)), []
    for _ in range(min(number, len(words))):
        at = int(residue.round(3).argmax())
        if residue[at] < 0.05:
            break
        chosen.append(words[at])
        column = (gram[:, at] - basis @ basis[at]) / np.sqrt(residue[at])
        basis = np.column_stack([basis, column])
        residue = np.maximum(residue - column**2, 0)
    return chosen


def _train(features: np.ndarray, labels: np.ndarray, cost: float = 10_000.0) -> np.ndarray:
    """Weights, bias last, of a linear machine with squared hinge loss, both classes weighed alike; by Newton's method."""
    x, y = np.column_stack([features, np.ones(len(features))]), np.where(labels, 1.0, -1.0)
    share = np.where(labels, cost / 2 / max(labels.sum(), 1), cost / 2 / max((~labels).sum(), 1))
    w, ridge = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 1e-6)
    for _ in range(30):
        gap = 1 - y * (x @ w)
        on = gap > 0
        xs, c = x[on], share[on]
        step = np.linalg.solve((xs * c[:, None]).T @ xs + np.diag(ridge), xs.T @ (c * y[on] * gap[on]) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _calibrate(best: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to probabilities.

    Fitted by Newton's method, lightly damped. Where a gap parts nearly all clean documents from
    nearly all toxic ones the curve is moved to pass 0.7 a quarter of the way up, so that insults
    less alike than those of the sample are still met.
    """
    x, w, ridge = np.column_stack([best, np.ones(len(best))]), np.zeros(2), np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
    low, high = np.quantile(best[toxic == 0], 0.999), np.quantile(best[toxic == 1], 0.05)
    if high > low and w[0] > 0:
        w[1] = np.log(0.7 / 0.3) - w[0] * (low + (high - low) / 4)
    return float(w[0]), float(w[1])


def _unlike(sets: Sequence[set[str]]) -> int:
    """How many of the sets, up to 12, are mutually unlike; copies and near copies count once."""
    found: list[set[str]] = []
    for words in sets:
        if len(found) < 12 and all(10 * len(words & x) < 3 * len(words | x) for x in found):
            found.append(words)
    return len(found)


def _witnesses(toxic: Sequence[set[str]], clean_counts: Counter, clean: int) -> list[str]:
    """Words that tell toxic documents from clean ones, the most frequent first: twenty times as
    frequent in them, in one of 200 of them and in five or more that are unlike each other."""
    holders: dict[str, list[int]] = {}
    for i, words in enumerate(toxic):
        for w in words:
            holders.setdefault(w, []).append(i)
    telling = [
        (-len(own), w) for w, own in holders.items()
        if len(own) >= max(5, len(toxic) / 200) and len(w) >= ORDER and len(own) * clean >= 20 * (clean_counts[w] + 0.5) * len(toxic)
    ]

    return [w for _, w in sorted(telling) if _unlike([toxic[i] for i in holders[w]][:100]) >= 5]


def _altered(word: str) -> list[str]:
    """The word with a letter put in, and with one doubled."""
    half = len(word) // 2
    return [word[:half] + "x" + word[half:], word[:2] + word[1] + word[2:]]


def fit_toxicity(sentences: Sequence[tuple[str, bool]]) -> Machine | None:
    """A machine from labelled texts; None unless both labels occur and some words set them apart."""
    texts: dict[str, bool] = {}
    for text, label in sentences:
        texts[text] = texts.get(text, False) or label
    bags = [({letters(w) for w in units(t)} - {""}, label) for t, label in texts.items()]
    toxic, clean = [b for b, label in bags if label], [b for b, label in bags if not label]
    counts = Counter(w for words in clean for w in words)
    telling = _witnesses(toxic, counts, len(clean))
    if not telling or not clean:
        return None
    telling = list(dict.fromkeys(w[:WINDOW] for w in telling))
    ranked = sorted((w for w in counts if ORDER <= len(w) <= WINDOW), key=lambda w: (-counts[w], w))
    # half are the most frequent ones, half are spread over all others
    rest = ranked[CLEAN_WORDS // 2 :]
    other = ranked[: CLEAN_WORDS // 2] + rest[:: max(1, 2 * len(rest) // CLEAN_WORDS)][: CLEAN_WORDS // 2]
    landmarks = _choose_landmarks(telling[:500], LANDMARKS * 3 // 4)
    landmarks += [w for w in _choose_landmarks(other[:400], LANDMARKS // 4) if w not in landmarks]
    alphabet = _alphabet(landmarks)
    spread = _spread(landmarks, alphabet)
    values, vectors = np.linalg.eigh(_products(landmarks, spread, alphabet).astype(np.float64))
    whiten = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])  # the Nyström map of the landmarks
    altered = [x for w in telling[:300] if len(w) > ORDER for x in _altered(w)]
    for _ in range(2):  # the second time with the clean words that came out worst
        words = telling + altered + other
        toxic_word = np.arange(len(words)) < len(telling) + len(altered)
        trained = _train(_products(words, spread, alphabet) @ whiten, toxic_word)
        table = (spread @ (whiten @ trained[:-1])).astype(np.float32)
        machine = Machine(tuple(landmarks), alphabet, table, float(trained[-1]), 1.0, 0.0)
        worst = np.argsort(-margins(ranked, machine), kind="stable")[: CLEAN_WORDS // 6]
        other = list(dict.fromkeys(other + [ranked[i] for i in worst]))
    own = sorted({w for words, _ in bags for w in words})
    known = dict(zip(own, margins(own, machine).tolist()))
    best = np.array([max((known[w] for w in words), default=machine.bias) for words, _ in bags])
    slope, offset = _calibrate(best, np.array([label for _, label in bags], float))
    return machine._replace(slope=slope, offset=offset)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[str, bool]]:
    """Texts and labels of a bounded number of labelled rows outside the held-out part."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("_label")).where(
        F.col("_label").isin(0, 1) & (_fold("doc_id") != 1)
    ).groupBy("doc_id").agg(F.max("_label").alias("_label"))
    order = F.xxhash64("doc_id")
    bounded = materialize(
        marks.where("_label = 1").orderBy(order).limit(TOXIC_SAMPLE).unionByName(marks.where("_label = 0").orderBy(order).limit(CLEAN_SAMPLE))
    )
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(bounded), "doc_id")  # of the size stated above
    return [(r.text, r._label == 1) for r in rows.select("text", "_label").toLocalIterator()]


def _fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 3


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.7,
) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``; only the text makes the score.

    The machine learns from at most ``TOXIC_SAMPLE`` and ``CLEAN_SAMPLE`` labelled documents whose
    crc32 of the id modulo 3 is not 1; those with 1 are held out. Its kernel counts common
    subsequences of letters, less for every letter between them, so letters put in or gaps lower a
    likeness but do not end it; marks inside a word, letters set apart and look-alike digits are
    undone first. A document scores by its worst word, on a curve fitted to the sample.

    Null or empty texts score as texts without any unit. Null ids are scored and never held out.
    Repeated rows are scored each; of labels that contradict each other the higher one counts. Without
    labels of both kinds every score is 0. Empty table: no rows.
    """
    machine = fit_toxicity(_sample(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(machine)
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                words = set(units(text))
                new = memory.missing(words)
                memory.now.update(zip(new, margins(new, machine).tolist()))
                best = max(map(memory.now.__getitem__, words), default=machine.bias)
                scores.append(1 / (1 + np.exp(-np.clip(machine.slope * best + machine.offset, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    texts = id_and_text(docs, id_col, text_col)
    scored = texts.select("doc_id", F.lit(0.0).alias("score")) if machine is None else texts.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(_fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


_MEMORIES: dict[bytes, Memory] = {}


def _memory(machine: Machine) -> Memory:
    """One per worker, for the machine it last worked with."""
    key = machine.table.tobytes()
    if key not in _MEMORIES:
        _MEMORIES.clear()
        _MEMORIES[key] = Memory(REMEMBERED)
    return _MEMORIES[key]

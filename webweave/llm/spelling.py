"""Groups of spelling variants: words one edit apart, found with k-d trees over their letter counts."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweave.llm.common import partitions
from webweave.session import materialize

MIN_LENGTH, MIN_COUNT = 5, 3
#: One run in this many has a letter deleted.
DELETE_EVERY = 97
#: The trees that deal words to cells are fitted on at most this many words; every word is dealt.
SAMPLE_WORDS = 200_000
#: A cell is split while it holds more words of the sample; also how many words a leaf in a cell has.
CELL_WORDS, LEAF_WORDS = 4_000, 128
#: Distinct words that a task counts before it sends them on.
COUNTED_WORDS = 300_000
#: Bytes of one comparison of queries with words.
_CHUNK = 1 << 22

# Letters as Latin-1 bytes, A-Z lower-cased; all other characters are blanks.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256)
)
#: a to z have a dimension each, all other letters share a few: a shared one only lowers distances.
_OTHERS = 6
DIMENSIONS = 26 + _OTHERS
_DIMENSION = np.array([b - 97 if 97 <= b <= 122 else 26 + b % _OTHERS for b in range(256)])


# --- words ------------------------------------------------------------------------------------


def words_of(doc_id: int | None, text: str) -> Iterator[tuple[bytes, int]]:
    """(word in Latin-1, occurrences) of one text, short ones left out, after the deletions."""
    runs = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
    seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in runs.items():
        code = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if code % DELETE_EVERY == 0:
            at = code % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= MIN_LENGTH:
            yield run, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least ``MIN_LENGTH`` letters that occur ``MIN_COUNT`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["word", "n"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in words_of(doc_id, text.as_py()):
                    counts[word] += n
                if len(counts) > COUNTED_WORDS:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# --- trees ------------------------------------------------------------------------------------


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """The count vectors of words of one length, given as a matrix of Latin-1 bytes."""
    rows, length = letters.shape
    at = np.arange(rows)[:, None] * DIMENSIONS + _DIMENSION[letters]
    counts = np.bincount(at.ravel(), minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)
    return np.minimum(counts, 120).astype(np.int8)


def letter_code(vectors: np.ndarray) -> np.ndarray:
    """Two bits per dimension: is the count one or more, two or more? Differing bits are at most the L1 distance."""
    bits = np.stack([vectors >= 1, vectors >= 2], axis=2).reshape(len(vectors), 2 * DIMENSIONS)
    return np.packbits(bits, axis=1).view(np.uint64)[:, 0]


class KdTree:
    """A k-d tree over count vectors: nodes (dimension, threshold, low child, high child) and leaves.

    A vector goes to the low child if its count in the dimension is at most the threshold. Leaves
    are numbered from 0; a tree without nodes is the one leaf 0.
    """

    def __init__(self, vectors: np.ndarray, leaf: int) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []
        self.members: list[np.ndarray] = []
        self._grow(vectors, np.arange(len(vectors)), leaf)

    def _grow(self, vectors: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        """The number of a node, or of a leaf as -1 - its number."""
        split = self._split(vectors[rows]) if len(rows) > leaf else None
        if split is None:
            self.members.append(rows)
            return -len(self.members)
        dimension, threshold = split
        at = len(self.nodes)
        self.nodes.append((dimension, threshold, 0, 0))
        low = vectors[rows, dimension] <= threshold
        children = self._grow(vectors, rows[low], leaf), self._grow(vectors, rows[~low], leaf)
        self.nodes[at] = (dimension, threshold, *children)
        return at

    @staticmethod
    def _split(vectors: np.ndarray) -> tuple[int, int] | None:
        """The dimension and threshold that part the vectors most evenly; None if they are all equal."""
        median = np.sort(vectors, axis=0)[len(vectors) // 2]
        best, found = 0, None
        for threshold in (median, median - 1):
            low = (vectors <= threshold).sum(0)
            even = np.minimum(low, len(vectors) - low)
            dimension = int(np.argmax(even))
            if even[dimension] > best:
                best, found = int(even[dimension]), (dimension, int(threshold[dimension]))
        return found

    def search(self, queries: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``queries``) for every leaf whose box is within L1 distance ``reach`` of them.

        All queries go down together. ``over`` is by how much each query lies outside of the box of
        the node in each dimension; where the sum exceeds ``reach`` the query is dropped.
        """
        root = 0 if self.nodes else -1
        stack = [(root, np.arange(len(queries)), np.zeros(queries.shape, np.int8), np.zeros(len(queries), np.int16))]
        while stack:
            node, rows, over, total = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows
                continue
            dimension, threshold, low, high = self.nodes[node]
            count = queries[rows, dimension].astype(np.int16)
            for child, gap in ((low, count - threshold), (high, threshold + 1 - count)):
                before = over[:, dimension]
                now = np.maximum(before, np.minimum(gap, 100)).astype(np.int8)
                sum_ = total + (now - before)
                kept = np.flatnonzero(sum_ <= reach)
                inside = over[kept]
                inside[:, dimension] = now[kept]
                stack.append((child, rows[kept], inside, sum_[kept]))

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The one leaf that each vector belongs to."""
        out = np.zeros(len(vectors), np.int64)
        stack = [(0 if self.nodes else -1, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            dimension, threshold, low, high = self.nodes[node]
            below = vectors[rows, dimension] <= threshold
            stack += [(low, rows[below]), (high, rows[~below])]
        return out


def one_edit(queries: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Row by row: is the word one inserted, deleted or replaced letter away from the query?"""
    if queries.shape[1] > words.shape[1]:
        queries, words = words, queries
    length = queries.shape[1]
    if length == words.shape[1]:
        return (queries != words).sum(1) == 1
    if not length:
        return np.ones(len(queries), bool)
    head = np.logical_and.accumulate(queries == words[:, :length], axis=1).sum(1)
    tail = np.logical_and.accumulate((queries == words[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= length


def _matrix(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


class Cell:
    """The words of one cell, all of one length, in a k-d tree of their own."""

    def __init__(self, words: list[bytes]) -> None:
        self.words, self.length = words, len(words[0])
        self.letters = _matrix(words, self.length)
        vectors = letter_counts(self.letters)
        self.codes = letter_code(vectors)
        self.tree = KdTree(vectors, LEAF_WORDS)

    def near(self, queries: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query numbers, word numbers) one edit apart, for queries of one length.

        A replaced letter changes two counts by one, an inserted or deleted one changes one; only
        words within that distance are compared letter by letter.
        """
        letters = _matrix(queries, len(queries[0]))
        vectors = letter_counts(letters)
        codes = letter_code(vectors)
        reach = 2 if len(queries[0]) == self.length else 1
        for leaf, rows in self.tree.search(vectors, reach):
            members = self.tree.members[leaf]
            step = max(1, _CHUNK // (8 * len(members)))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                a, b = np.nonzero(np.bitwise_count(codes[some][:, None] ^ self.codes[members][None, :]) <= reach)
                wide = max(1, _CHUNK // (self.length + 1))
                for j in range(0, len(a), wide):
                    q, w = some[a[j : j + wide]], members[b[j : j + wide]]
                    hit = one_edit(letters[q], self.letters[w])
                    yield q[hit], w[hit]


# --- search on Spark --------------------------------------------------------------------------


def _trees(words: DataFrame) -> dict[int, KdTree]:
    """A tree per word length, fitted on the words of the least hashes; it only deals words to cells."""
    sample = words.select("word").orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).where(F.length("word") <= 255)
    groups = defaultdict(list)
    for row in sample.toLocalIterator():
        groups[len(row.word)].append(row.word.encode("latin-1"))
    return {n: KdTree(letter_counts(_matrix(group, n)), CELL_WORDS) for n, group in groups.items()}


_ROUTED = pa.schema([("cell", pa.int64()), ("role", pa.int8()), ("word", pa.string()), ("n", pa.int64())])
_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])
_CELLS = 1 << 20  # numbers of cells that each length has for itself


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): words with any word one edit away, their number and the most frequent.

    Every word belongs to one cell of its length's tree, and asks all cells of its own and the two
    neighbouring lengths whose boxes its edits can reach. A task builds the tree of one cell at a
    time and lets the cell's queries stream by, so neither many queries nor many neighbours of a
    word are ever held together.
    """
    spark = words.sparkSession
    trees = spark.sparkContext.broadcast(_trees(words))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = KdTree(np.zeros((0, DIMENSIONS), np.int8), 1)
        for batch in batches:
            groups = defaultdict(list)
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                groups[len(word)].append((word, n))
            for length, rows in groups.items():
                texts = np.array([w for w, _ in rows], object)
                counts = np.array([n for _, n in rows], np.int64)
                vectors = letter_counts(_matrix([w.encode("latin-1") for w in texts], length))

                def sent(cell: np.ndarray, role: int, at: np.ndarray, texts=texts, counts=counts) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([
                        pa.array(cell, pa.int64()), pa.array(np.full(len(at), role, np.int8)),
                        pa.array(texts[at], pa.string()), pa.array(counts[at]),
                    ], schema=_ROUTED)

                own = trees.value.get(length, whole).leaf_of(vectors)
                yield sent(length * _CELLS + own, 0, np.arange(len(rows)))
                for other, reach in ((length - 1, 1), (length, 2), (length + 1, 1)):
                    for leaf, at in trees.value.get(other, whole).search(vectors, reach):
                        yield sent(np.full(len(at), other * _CELLS + leaf), 1, at)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, members, cell = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "role", "word", "n")]
            queries = defaultdict(list)
            for at, role, word, n in zip(*columns):
                if at != number:
                    yield from _answer(cell, members, queries)
                    queries.clear()
                    number, members, cell = at, [], None
                if role == 0:
                    members.append((word.encode("latin-1"), n))
                elif members:
                    cell = cell or Cell([w for w, _ in members])
                    queries[len(word)].append(word.encode("latin-1"))
            yield from _answer(cell, members, queries)

    width = partitions(spark)
    routed = words.mapInArrow(route, "cell long, role byte, word string, n long")
    found = routed.repartition(width, "cell").sortWithinPartitions("cell", "role").mapInArrow(
        look, "word string, n_near long, near_n long, near string"
    )
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.minus_n")).alias("near_n"), F.col("b.near").alias("near")
    )


def _answer(cell: Cell | None, members: list[tuple[bytes, int]], queries: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """One row per query with a near word in the cell: how many, and the most frequent of them."""
    if cell is None or not queries:
        return
    counts = np.array([n for _, n in members], np.int64)
    # rank of each word: most frequent first, then by letters
    rank = np.empty(len(members), np.int64)
    order = sorted(range(len(members)), key=lambda i: (-members[i][1], members[i][0]))
    rank[order] = np.arange(len(members))
    for asked in queries.values():
        near = np.zeros(len(asked), np.int64)
        best = np.full(len(asked), len(members), np.int64)
        for q, w in cell.near(asked):
            np.add.at(near, q, 1)
            np.minimum.at(best, q, rank[w])
        hit = np.flatnonzero(near)
        if len(hit):
            first = np.array(order, np.int64)[best[hit]]
            yield pa.RecordBatch.from_arrays([
                pa.array([asked[i].decode("latin-1") for i in hit], pa.string()), pa.array(near[hit]),
                pa.array(counts[first]), pa.array([members[i][0].decode("latin-1") for i in first], pa.string()),
            ], schema=_FOUND)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: pointers are doubled until they end at a word without one.

    A form is at least twice as frequent, so no way is longer than the logarithm of the counts.
    """
    way = materialize(forms.select("word", F.col("form").alias("root")))
    moved = True
    while moved:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = materialize(
            way.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next")
        )
        moved = not stepped.where("_next IS NOT NULL").isEmpty()
        way = stepped.drop("_next")
    return way


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of a corpus with the spelling they lean on.

    Words are the lower-cased (A-Z only) runs of letters of whole texts, where one run in
    ``DELETE_EVERY``, by the checksum of document and run, loses a letter; of at least ``MIN_LENGTH``
    letters and ``MIN_COUNT`` occurrences. Two are near if one inserted, deleted or replaced letter
    makes one of the other. A word's form is its most frequent near word, the first in code-point
    order of equally frequent ones, if that is twice as frequent or more; the root is where the forms
    lead. ``n_near`` counts near words.

    One edit changes letter counts by two in all at most, so near words are looked for with k-d trees
    over letter counts, per pair of lengths, and verified letter by letter. The result is exact. The
    upper levels of the trees are fitted on a bounded sample, which decides only where words are kept.

    Null and empty texts have no words. A null id counts as an empty one in the checksum. Rows that
    repeat are counted each. Texts and words of any length are read whole. Empty table: no rows.
    """
    words = materialize(word_counts(docs, id_col, text_col))
    near = materialize(near_words(words))
    joined = words.join(near, "word", "left")
    leans = F.col("near_n") >= 2 * F.col("n")
    rows = materialize(joined.select(
        "word", F.when(leans, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(leans, F.col("near_n")).alias("form_n"),
    ))
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

"""Ranked lexical search over an index of documents stratified by their length normaliser."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webweave.llm.common import partitions
from webweave.operators.ordered import running
from webweave.session import materialize

#: Documents of one stratum that make up a block: a longer stratum has several.
BLOCK_DOCS = 4_096
#: Postings in the blocks that a task orders by bound at a time.
SHELF_POSTINGS = 4_000_000
#: Terms of items that are searched for at a time.
TERMS_AT_ONCE = 200_000

# Bytes of terms in UTF-8, with A-Z lower-cased; all others are blanks. The score scale,
# and the normaliser's and the impact's parameters.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
BASE, SLOPE = 10, 90
SCALE, TF_FACTOR, NORMALISER_FACTOR = 1_000_000_000, 1_000, 8

_ASCII_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats: runs of digits, letters and all beyond ASCII."""
    return text.translate(_TERM_BYTES).split()


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """What a term's weight is multiplied by in a document of normaliser ``m``, once per ``tf``."""
    return SCALE * tf // (TF_FACTOR * tf + NORMALISER_FACTOR * m)


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    found = F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _UPPER.lower()), F.lit(_ASCII_TERM), F.lit(0))
    return items.select(F.col(id_col).alias("item_id"), F.explode(found).alias("term")).distinct()


# --- index ------------------------------------------------------------------------------------


def term_frequencies(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, term list, tf list): every document with any term, and its counts of the numbered terms."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64())),
    ])
    known = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                words = terms_of(text.as_py())
                if words:
                    counts = Counter(words)
                    pairs = sorted((number[t], counts[t]) for t in counts.keys() & number.keys())
                    rows.append((doc_id, len(words), [t for t, _ in pairs], [k for _, k in pairs]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def stratified_index(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(m, docs, term, tf, size, posting): one row per block of a stratum.

    A stratum is all documents of one normaliser ``m``. Run i of a block's postings holds the
    positions within ``docs`` of the documents with ``tf[i]`` occurrences of ``term[i]``: ``size[i]``
    numbers of ``posting``. Ranges of (m, doc_id) are dealt to tasks, so a stratum of any size is
    spread over as many tasks as its share of the documents asks for.
    """
    schema = pa.schema([
        ("m", pa.int64()), ("docs", pa.list_(pa.int64())), ("term", pa.list_(pa.int32())),
        ("tf", pa.list_(pa.int64())), ("size", pa.list_(pa.int32())), ("posting", pa.list_(pa.int32())),
    ])
    normed = counted.selectExpr(
        f"{BASE}L + (({SLOPE}L * n * {n_docs}L) div {max(1, n_terms)}L) AS m", "doc_id", "term", "tf"
    )

    def block(m: int, docs: list, terms: list[np.ndarray], tfs: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in terms])
        at = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        term, tf = np.concatenate(terms), np.concatenate(tfs)
        order = np.lexsort((at, tf, term))
        term, tf, at = term[order], tf[order], at[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(term))).astype(np.int32)
        values = ([m], [docs], [term[first]], [tf[first]], [size], [at])
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, terms, tfs = None, [], [], []
        for batch in batches:
            columns = (batch.column(c) for c in ("m", "doc_id", "term", "tf"))
            for m, doc_id, term, tf in zip(*columns):
                if docs and (m.as_py() != now or len(docs) >= BLOCK_DOCS):
                    yield block(now, docs, terms, tfs)
                    docs, terms, tfs = [], [], []
                now = m.as_py()
                docs.append(doc_id.as_py())
                terms.append(term.values.to_numpy())
                tfs.append(tf.values.to_numpy())
        if docs:
            yield block(now, docs, terms, tfs)

    width = partitions(counted.sparkSession)
    return normed.where(F.size("term") > 0).repartitionByRange(width, "m", "doc_id").sortWithinPartitions("m", "doc_id").mapInArrow(
        run, "m long, docs array<long>, term array<int>, tf array<long>, size array<int>, posting array<int>"
    )


# --- search -----------------------------------------------------------------------------------


class Items:
    """Weights of the terms, and which items have which term, both ways."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weights: np.ndarray) -> None:
        self.weights = weights
        self.n = int(item.max()) + 1 if len(item) else 0
        order = np.lexsort((term, item))
        self.terms = np.split(term[order], np.searchsorted(item[order], np.arange(1, self.n)))
        order = np.lexsort((item, term))
        self.by_term = item[order]
        self.first = np.searchsorted(term[order], np.arange(len(weights) + 1))


class Block:
    """One block of a stratum: weighted impacts of its postings, and a bound of each item's scores."""

    def __init__(self, row: dict, items: Items) -> None:
        self.docs = row["docs"]
        term, tf, size = row["term"], row["tf"], row["size"]
        self.posting = row["posting"]
        per_tf, which = np.unique(tf, return_inverse=True)
        value = items.weights[term] * impacts(per_tf, row["m"])[which]
        self.value = np.repeat(value, size)
        # the runs of a term follow each other by tf, so the last one has the greatest impact
        last = np.append(term[1:] != term[:-1], True)
        first = np.flatnonzero(np.append(True, last[:-1]))
        start = np.append(0, np.cumsum(size))
        self.term, self.start = term[last], np.append(start[first], start[-1])
        n = items.first[self.term + 1] - items.first[self.term]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.first[self.term], n)
        self.bounds = np.zeros(items.n, np.int64)
        np.add.at(self.bounds, items.by_term[at], np.repeat(value[last], n))

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """The score of each document of the block for an item of these (sorted) terms."""
        out = np.zeros(len(self.docs), np.int64)
        _, at, _ = np.intersect1d(self.term, terms, assume_unique=True, return_indices=True)
        n = self.start[at + 1] - self.start[at]
        if n.sum():
            spots = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[at], n)
            np.add.at(out, self.posting[spots], self.value[spots])
        return out


class Best:
    """The ``k`` best (score, doc_id) of one item so far; of equal scores those of the smallest ids."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.least
        if good.any():
            score, doc = np.append(self.score, score[good]), np.append(self.doc, doc[good])
            order = np.lexsort((doc, -score))[: self.k]
            self.score, self.doc = score[order], doc[order]
            if len(order) == self.k:
                self.least = max(1, int(self.score[-1]))


_NO_ID = np.iinfo(np.int64).max


def visit(blocks: list[Block], items: Items, best: list[Best]) -> int:
    """Score each item in the blocks by falling bound, until the bound is under its k-th best score.

    Returns how many visits there were.
    """
    bounds = np.array([b.bounds for b in blocks]).reshape(len(blocks), items.n)
    visits = 0
    for i, found in enumerate(best):
        open_ = np.flatnonzero(bounds[:, i] >= found.least)
        for j in open_[np.argsort(-bounds[open_, i], kind="stable")]:
            if bounds[j, i] < found.least:
                break
            found.add(blocks[j].scores(items.terms[i]), blocks[j].docs)
            visits += 1
    return visits


def search(index: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, doc_id, score): for each item number the ``k`` best documents of every task's share of the index.

    A task takes blocks until they hold ``SHELF_POSTINGS`` postings, orders and visits those, and goes
    on with the next ones with the scores to beat that it has by then.
    """
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best, shelf, held = [Best(k) for _ in range(items.n)], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values.to_numpy() for c in ("term", "tf", "size", "posting")}
                row["docs"] = batch.column("docs")[i].values.fill_null(_NO_ID).to_numpy()
                row["m"] = batch.column("m")[i].as_py()
                shelf.append(Block(row, items))
                held += len(row["posting"]) + items.n
                if held > SHELF_POSTINGS:
                    visit(shelf, items, best)
                    shelf, held = [], 0
        visit(shelf, items, best)
        for i, found in enumerate(best):
            if len(found.doc):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found.doc), i)), pa.array(found.doc, mask=found.doc == _NO_ID), pa.array(found.score)],
                    ["item", "doc_id", "score"],
                )

    return index.mapInArrow(run, "item long, doc_id long, score long")


def _item_blocks(terms: DataFrame) -> DataFrame:
    """Items with the number of the block of ``TERMS_AT_ONCE`` terms that they are searched in."""
    sizes = terms.groupBy("item_id").agg(F.count("*").alias("_n"), F.lit("all").alias("_all"))
    upto = running(sizes, ["_all"], ["item_id"], _upto=("sum", "_n"))
    return upto.select("item_id", F.floor((F.col("_upto") - F.col("_n")) / TERMS_AT_ONCE).cast("long").alias("_block"))


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest scores above 0 for each item.

    Documents are grouped into strata of equal normaliser, with postings by number of occurrences in
    each, so an impact is computed once per stratum, and a stratum's greatest impacts bound the score
    of all its documents. Every task visits the blocks of its share by falling bound and stops when
    no bound reaches the k-th best score so far. All is counted over all documents; scores are exact
    integers.

    Only counts of the items' terms are kept of the documents. Items are taken in blocks of
    ``TERMS_AT_ONCE`` terms (an item of more terms is a block), which is what is broadcast and all that
    passes through the driver.

    Null or empty texts have no terms: such documents are not counted, such items have no rows. Items
    that repeat an id are one item with the terms of all; a null item id is an item like any other.
    Rows that repeat a document id are documents of their own. Of equal scores the smaller doc_id
    comes first, a null one last. Long texts are read whole. Empty tables: no rows.
    """
    spark = docs.sparkSession
    terms = materialize(query_terms(items, item_id_col, item_text_col))
    blocks = materialize(_item_blocks(terms))
    last = blocks.agg(F.max("_block")).first()[0]
    found = None
    for number in range((last or 0) + 1):
        here = blocks.where(F.col("_block") == number).withColumnRenamed("item_id", "_id")
        mine = terms.join(here, F.col("item_id").eqNullSafe(F.col("_id"))).select("item_id", "term")
        pairs = mine.collect()
        names = sorted({r.item_id for r in pairs}, key=lambda x: (x is None, x))
        vocabulary = sorted({r.term for r in pairs})
        item_at, term_at = {x: i for i, x in enumerate(names)}, {t: i for i, t in enumerate(vocabulary)}
        counted = materialize(term_frequencies(docs, {t.encode(): i for t, i in term_at.items()}, id_col, text_col))
        totals = counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in counted.select(F.explode("term").alias("t")).groupBy("t").count().collect():
            df[r.t] = r["count"]
        weights = np.floor(1000 * np.log((2 * totals.docs + 2) / (2 * df + 1))).astype(np.int64)
        asked = Items(
            np.array([item_at[r.item_id] for r in pairs], np.int64), np.array([term_at[r.term] for r in pairs], np.int64), weights
        )
        index = materialize(stratified_index(counted, totals.docs, totals.terms))
        best = search(index, asked, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        kind = items.schema[item_id_col].dataType
        named = spark.createDataFrame(list(enumerate(names)), f"item long, item_id {kind.simpleString()}")
        top = top.join(named, "item").select("item_id", "rank", "doc_id", "score")
        found = top if found is None else found.unionByName(top)
    return found

"""Ranked search against scores straight from their definition."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from webweave.llm import lexical_search
from webweave.llm.lexical_search import Best, Block, Items, impacts, ranked_search, terms_of, visit

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, k=10):
    counts = [(i, Counter(_terms(t))) for i, t in docs if _terms(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(_terms(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms if c[t]
            )
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def _rows(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


def test_terms_are_maximal_runs():
    text = "It's ÉÀ a_b 12-x y\x00Z {q} 漢字🙂 İ"
    assert [t.decode() for t in terms_of(text.encode())] == _terms(text)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Ünder", "ünder", "ABC", "x" * 50]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 5, 5, 20, 60, 300])))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, " .,- "), (403, docs[3][1]), (3, docs[3][1]), (404, docs[3][1]), (None, docs[3][1]), (405, "w1 " * 50_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)]
    items += [(30, None), (31, "nothing of this"), (32, "W1 w1, w1."), (33, "w0"), (33, "w39 abc"), (None, "w2")]
    return docs, items


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, docs_of, corpus, monkeypatch, small):
    if small:  # many blocks, shelves and rounds of items
        monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 7)
        monkeypatch.setattr(lexical_search, "SHELF_POSTINGS", 300)
        monkeypatch.setattr(lexical_search, "TERMS_AT_ONCE", 60)
    docs, items = corpus
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    assert _rows(ranked_search(docs_of(docs), asked)) == _brute(docs, items)
    assert _rows(ranked_search(docs_of(docs), asked, k=3)) == _brute(docs, items, 3)


def test_empty_tables(spark, docs_of, corpus):
    docs, items = corpus
    asked = spark.createDataFrame(items, "item_id long, text string")
    for d, i in ((docs_of(docs).limit(0), asked), (docs_of(docs), asked.limit(0)), (docs_of([(1, None)]), asked)):
        assert ranked_search(d, i).collect() == []


def test_strata_under_the_scores_to_beat_are_not_visited():
    """Blocks of falling bounds: the best documents are found without looking at most blocks."""
    rng = np.random.default_rng(0)
    items = Items(np.array([0, 0]), np.array([0, 1], np.int32), np.array([5_000, 3_000]))
    blocks, every = [], []
    for m in range(10, 600, 10):
        docs = np.arange(20) + 1_000 * m
        holders = rng.permutation(20)[:6].astype(np.int32)
        row = {"m": m, "docs": docs, "term": np.array([0, 0, 0, 1, 1, 1]), "tf": np.array([1, 2, 4, 1, 2, 4]),
               "size": np.full(6, 2, np.int32), "posting": np.concatenate([holders, holders])}
        blocks.append(Block(row, items))
        scores = np.zeros(20, np.int64)
        for r, (t, f) in enumerate(zip(row["term"], row["tf"])):
            for p in row["posting"][2 * r : 2 * r + 2]:
                scores[p] += items.weights[t] * impacts(np.array([f]), m)[0]
        assert (blocks[-1].scores(items.terms[0]) == scores).all() and blocks[-1].bounds[0] >= scores.max()
        every += [(-s, d) for s, d in zip(scores.tolist(), docs.tolist()) if s]
    best = [Best(10)]
    visits = visit(blocks, items, best)
    assert list(zip((-best[0].score).tolist(), best[0].doc.tolist())) == sorted(every)[:10]
    assert visits < len(blocks) / 3

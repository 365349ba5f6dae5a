"""Near duplicates of vectors, documents and passages against brute force."""

from __future__ import annotations

import math
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from llm_brute import cosine_links, jaccard_components, repeated_documents, shingles
from pyspark.sql import functions as F

from webweave.llm import near_vectors as vectors_module
from webweave.llm.common import stored
from webweave.llm.near_vectors import list_decode, near_vectors, scores
from webweave.llm.ngram_join import Threshold, divide_skip, probe, similar_documents
from webweave.llm.shingles import Words
from webweave.llm.substrings import (
    ENOUGH, _joined, _met, _rounds, _shared, _short, _stretches, alike, compact_windows, cut, hopeful, repeated_passages, without_repeats,
)
from webweave.session import checkpoint_dir


def test_list_decode_finds_every_direction_that_exceeds():
    unit = np.random.default_rng(1).standard_normal((3, 10))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for score in scores(unit, 0)[:, :, :20]:
        every = (score[0][:, None] + score[1][None, :]).ravel()
        for least in (-1, 0.1, 0.4, 2):
            assert sorted(list_decode(score, least)) == np.flatnonzero(every >= least).tolist()


def _around(rng, centre, cosine, n):
    """Unit vectors at just this cosine to the centre."""
    side = rng.standard_normal((n, len(centre)))
    side -= (side @ centre)[:, None] * centre
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return cosine * centre + math.sqrt(1 - cosine**2) * side


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows: list[tuple[int, list | None]] = []
    for cosine, n in ((0.999, 30), (0.98, 25), (0.965, 25), (0.94, 15)):
        centre = rng.standard_normal(24)
        rows += list(enumerate(_around(rng, centre / np.linalg.norm(centre), cosine, n).tolist(), len(rows)))
        rows.append((len(rows), (3 * centre).tolist()))
    rows += [(len(rows) + i, rng.standard_normal(24).tolist()) for i in range(60)]
    rows += [(i + 1_000, list(rows[5][1])) for i in range(4)]  # copies
    rows += [(2_000, None), (2_001, []), (2_002, [0.0] * 24), (2_003, [1.0, None, 2.0]), (2_004, [1.0, float("nan")]), (2_005, [float("inf"), 1.0]), (2_006, [2.0]), (2_007, [3.0]), (2_008, [-1.0])]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, uid int, unit double")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(table).collect()}
    assert found == {i: (n, c, i == c) for i, (n, c) in cosine_links(rows, 0.95).items()}
    assert near_vectors(table.limit(0)).count() == 0


def test_vectors_with_repeated_and_null_ids(spark):
    table = spark.createDataFrame([(7, [1.0, 0.0]), (7, [1.0, 0.001]), (None, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors(table).collect()), key=str) == sorted(
        [(7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False), (3, 0, 3, True)], key=str
    )


@pytest.mark.parametrize("dim", [3, 8, 24, 64, 256])
def test_filters_recall_pairs_at_the_threshold(dim):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((2_000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.concatenate([_around(rng, v, 0.95, 1) for v in a])
    missed = np.ones(len(a), bool)
    for number in range(vectors_module.CODES):
        x, y = scores(a, number), scores(b, number)
        for p, q in ((x, y), (y, x)):
            place = np.take_along_axis(p, q.argmax(2)[:, :, None], 2)[:, :, 0].sum(1)
            best = p.max(2).sum(1)
            missed &= place < best - vectors_module.reach(best, dim, 0.95)
    assert not missed.any()


def test_divide_skip_and_probe():
    rng = random.Random(4)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 20))) for _ in range(rng.randint(0, 6))]
        need = rng.randint(1, 4)
        counts = Counter(x for own in lists for x in own)
        found = divide_skip([np.array(x, np.int64) for x in lists], need)
        assert list(zip(*(x.tolist() for x in found))) == sorted((x, n) for x, n in counts.items() if n >= need)
    a, b = np.unique(np.array([rng.randrange(500) for _ in range(300)], np.uint64)), np.unique(np.array([rng.randrange(500) for _ in range(300)], np.uint64))
    common = len(set(a.tolist()) & set(b.tolist()))
    assert probe(a, b, 0, 0) == common and probe(a, b, 0, common) == common and probe(a, b, 0, 400) < 400


def test_threshold_numbers():
    t = Threshold(75)
    assert t.links(3, 3, 4) and not t.links(2, 3, 3) and t.overlap(8) == 6
    for n in range(1, 200):
        assert 1 <= t.sure(n) <= t.first(n) <= n


def test_words_and_shingles():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aAbé \n .") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "x", "a " * 9]
    seen: dict[str, int] = {}
    for text, found in zip(texts, Words(texts).shingles(3)):
        own = shingles(text, 3)
        assert len(own) == len(found)
        for a, b in zip(own, found.tolist()):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", range(6))
def test_tables_of_one_short_text(docs_of, n):
    docs = docs_of([(1, " ".join("abcde"[:n]))]).coalesce(1)
    assert [tuple(x) for x in similar_documents(docs).select("doc_id", "n_shingles", "component_id").collect()] == [(1, min(n, 1), 1)]
    assert repeated_passages(docs).count() == 0


def _edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"w{rng.randrange(10**9)}" for w in text.split())


@pytest.fixture(scope="module")
def corpus(prose):
    """Copies, near copies at all distances, chains, shared passages, frequent lines."""
    rng = random.Random(6)
    texts: list[str | None] = [prose(i, rng.randint(1, 150)) for i in range(40)]
    for base in range(6):
        text = prose(100 + base, 120)
        texts += [text, text.upper(), text.replace(" ", "\n ")] + [_edited(rng, text, s) for s in (0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.08) for _ in range(3)]
    chain = prose(200, 200).split()
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 60, 6)]
    passage = prose(300, 60)
    texts += [f"{prose(301 + i, 70)} {passage} {prose(400 + i, 20)}" for i in range(25)]
    texts += [f"{prose(500, 8)} {prose(501 + i, 3)}" for i in range(12)]
    texts += ["", None, " \n", "a b", "A b", "one two three four", "one two three four five", "a " * 200, "a " * 300]
    return list(enumerate(texts, 10))


def test_documents_equal_brute_force(docs_of, corpus):
    docs = docs_of(corpus)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(docs).collect()}
    assert found == jaccard_components(corpus)
    assert similar_documents(docs.limit(0)).count() == 0


def test_documents_with_null_and_repeated_ids(docs_of, prose):
    text, other = prose(1, 40), prose(2, 40)
    rows = similar_documents(docs_of([(None, text), (4, text), (4, text), (5, other), (4, other)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4")] * 3 + [("5", "4"), ("None", "None")]


def _left_behind(spark, run):
    """Columns of the stored tables that are still there once ``run`` has returned."""
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("table-*"))
    run()
    return {c for path in set(folder.glob("table-*")) - before for c in spark.read.parquet(str(path)).columns}


def test_stored_sets_and_spans_are_deleted(spark, docs_of, prose):
    docs = docs_of(_around_passages(prose, [prose(60_000, 400), prose(60_000, 390), prose(60_001, 60), prose(60_001, 60)]))
    assert _left_behind(spark, lambda: similar_documents(docs).count()).isdisjoint({"tokens", "hashes", "small", "token"})
    assert _left_behind(spark, lambda: repeated_passages(docs).count()).isdisjoint({"shared", "shingles", "signature"})


def test_overlap_that_two_sizes_need():
    t = Threshold(75)
    for a in range(1, 60):
        sizes = np.array([b for b in range(1, 60) if 4 * min(a, b) >= 3 * max(a, b)])
        least = [next(c for c in range(a + 1) if t.links(c, a, b)) for b in sizes.tolist()]
        assert t.overlap_of(a, sizes).tolist() == least


def test_shared_shingles_take_four_bytes(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g"), (2, "x a b c d e f"), (3, "k l m n o p")], "doc_id long, text string")
    common = {_short(x).tobytes() for x in np.split(next(Words(["a b c d e f"]).shingles(5)), 2)}
    assert {r.doc_id: set(map(bytes, r.shared)) for r in _shared(texts, 5).collect()} == {1: common, 2: common}


def test_compact_windows_cover_every_stretch_once():
    rng = np.random.default_rng(7)
    for ties in (10**9, 4):
        hashes = rng.integers(0, ties, 40).astype(np.uint64)
        for width in (1, 5, 40, 41):
            windows = compact_windows(hashes, width)
            for i in range(40):
                for j in range(i + width - 1, 40):
                    least = hashes[i : j + 1].min()
                    places = set((i + np.flatnonzero(hashes[i : j + 1] == least)).tolist())
                    own = [(c, d) for a, c, d, b in windows if a <= i and j <= b and hashes[c] == least and places & set(range(c, d + 1))]
                    assert len(own) == 1
    assert compact_windows(np.full(200_000, 7, np.uint64), 35) == [(0, 0, 199_999, 199_999)]


def test_copies_of_a_passage_name_the_first_document(docs_of, prose):
    passage = prose(50_000, 60)
    rows = repeated_passages(docs_of(_around_passages(prose, [passage] * 30))).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1, 30))
    assert all(r.source_id < r.doc_id and r.end_word - r.start_word >= 60 and r.similarity == 1 for r in rows)  # prose may go on alike
    short = " ".join(passage.split()[:44])  # 40 shingles of 46
    rows = repeated_passages(docs_of(_around_passages(prose, [short] * 3))).collect()
    assert sorted((r.doc_id, r.source_id) for r in rows) == [(1, 0), (2, 0)]
    assert all(r.end_word - r.start_word == 50 and r.similarity == pytest.approx(40 / 46) for r in rows)


def test_alike_finds_stretches():
    rng = np.random.default_rng(8)
    a, b, same = rng.integers(0, 2**60, 90), rng.integers(0, 2**60, 80), rng.integers(0, 2**60, 60)
    own = np.concatenate([a[:30], same, a[30:]]).astype(np.uint64)
    source = np.concatenate([b[:7], same, b[7:]]).astype(np.uint64)
    assert alike(own, source, 46, 75) == [(30, 89, 7, 66, 1.0)]
    source[20] = 1
    ((first, last, *_, similarity),) = alike(own, source, 46, 75)
    assert (first, last) == (30, 89) and similarity == pytest.approx(59 / 61)
    assert alike(own[:60], source, 46, 75) == []


def test_passages(docs_of, corpus):
    docs = docs_of(corpus)
    rows = repeated_passages(docs).collect()
    words = {i: [w.lower() for w in (t or "").split()] for i, t in corpus}
    for r in rows:
        assert r.source_id < r.doc_id and r.end_word - r.start_word >= 50
        a, b = (set(shingles(" ".join(words[i][s:e]))) for i, s, e in ((r.doc_id, r.start_word, r.end_word), (r.source_id, r.source_start, r.source_end)))
        assert 100 * len(a & b) >= 75 * len(a | b)
    found = {r.doc_id for r in rows}
    assert repeated_documents([(i, t or "") for i, t in corpus]) <= found
    assert found.isdisjoint(range(10, 50))  # random prose
    assert repeated_passages(docs.limit(0)).count() == 0
    kept = without_repeats(docs)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert all(texts[i] == t for i, t in corpus if i not in found)
    for i, t in corpus:
        gone = set()
        for r in rows:
            if r.doc_id == i:
                gone |= set(range(r.start_word, r.end_word))
        left = [w for k, w in enumerate((t or "").split()) if k not in gone]
        assert (texts[i] or "").split() == left if left or i not in found else i not in texts


def test_alike_allows_what_the_similarity_allows():
    rng = np.random.default_rng(9)
    source, more = rng.integers(0, 2**60, 64).astype(np.uint64), rng.integers(0, 2**60, 40).astype(np.uint64)
    assert alike(np.concatenate([source[:30], more[:16], source[34:]]), source, 46, 75) == [(0, 75, 0, 63, 0.75)]
    assert alike(np.concatenate([source[:30], more[:17], source[34:]]), source, 46, 75) == []
    ((first, last, *_),) = alike(np.concatenate([more[:2], source[:43], more[2:9]]), source, 46, 75)
    assert last - first + 1 == 46


def test_hopeful_spans_hold_every_stretch():
    rng = np.random.default_rng(10)
    for _ in range(30):
        own = rng.integers(0, 60, 50).astype(np.uint64)
        shared = np.unique(rng.choice(own, 25))
        inside = {k for a, b in hopeful(own, shared, 8, 75) for k in range(a, b)}
        for i in range(50):
            for j in range(i + 8, 51):
                part = set(own[i:j].tolist())
                if 100 * len(part & set(shared.tolist())) >= 75 * len(part):
                    assert inside >= set(range(i, j))


def _around_passages(prose, texts):
    """Documents that hold the texts between prose of their own."""
    return [(i, f"{prose(10**6 + i, 60)} {text} {prose(2 * 10**6 + i, 60)}") for i, text in enumerate(texts)]


def _sources(rows):
    return {(r.doc_id, r.source_id) for r in repeated_passages(rows).select("doc_id", "source_id").collect()}


def test_passages_with_an_inserted_sentence(docs_of, prose):
    texts = []
    for k in range(5):  # 60 of 80 shingles
        words = prose(40_000 + k, 68).split()
        texts += [" ".join(words), " ".join([*words[:34], *prose(41_000 + k, 12).split(), *words[34:]])]
    assert _sources(docs_of(_around_passages(prose, texts))) == {(i + 1, i) for i in range(0, 10, 2)}


def test_passages_of_fifty_words_at_the_threshold(docs_of, prose):
    texts = []
    for k in range(100):  # two words changed: 40 of 52 shingles
        words = prose(30_000 + k, 50).split()
        texts += [" ".join(words), " ".join(f"y{k}" if i in (24, 25) else w for i, w in enumerate(words))]
    assert _sources(docs_of(_around_passages(prose, texts))) == {(i + 1, i) for i in range(0, 200, 2)}


def test_passages_that_only_later_documents_have(docs_of, prose):
    lines = [prose(10_000 + k, 12) for k in range(8)]
    # (a) frequent lines in frequent order, owned by documents without the passage
    texts, wanted = [*(f"{a} {b}" for a, b in zip(lines, lines[1:])), *[" ".join(lines)] * 2], {(8, 7)}
    for k in range(12):  # (b) an earlier variant below the similarity
        words = prose(20_000 + k, 60).split()
        wanted.add((len(texts) + 2, len(texts) + 1))
        texts += [" ".join(f"x{k}" if i in (12, 24, 36, 48) else w for i, w in enumerate(words)), *[" ".join(words)] * 2]
    assert wanted <= _sources(docs_of(_around_passages(prose, texts)))


def test_cut_keeps_the_rest():
    assert cut("aé b\nc  d e", [(1, 3), (2, 4)]) == "aé  e"
    assert cut("a b", [(0, 2)]) == "" and cut("a b", []) == "a b" and cut("a b", [(1, 9)]) == "a"


def test_shuffles_of_a_stored_table_are_deleted_at_once(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in map(str, files.mkString(" ").split()) if "shuffle_" in name}

    before = shuffles()
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = stored(spark.range(1_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(5, "count"))
    for _ in range(50):  # Spark's executors delete them on their own
        if not shuffles() <= before:
            time.sleep(0.1)
    assert shuffles() <= before and table.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_windows_meet_share_by_share(spark):
    rows = [(s, f, d, 0, 1, 1, 9) for s in range(-7, 40) for f, d in ((0, 5 + s % 3), (1, 6), (2, 6))]
    windows = spark.createDataFrame(rows, "signature long, function byte, doc_id long, l int, c int, d int, r int")
    hits, shares = _met(windows)
    assert len(shares) > 1
    assert sorted(map(tuple, hits.collect())) == sorted((*r, 5 if r[0] % 3 == 0 else 6) for r in rows if r[0] % 3 != 1)


def test_pairs_of_windows_meet_across_batches(spark):
    rng = random.Random(5)
    rows = [
        (d, o, f, 10 + f % 3, 80 + rng.randint(0, 9), 20 + f % 5, 95 + rng.randint(0, 9))
        for d, o in ((9, 1), (9, 2), (8, 1), (7, 3)) for f in range(24 if d != 7 else ENOUGH - 1) for _ in range(1 + f % 2)
    ]
    names = ["doc_id", "other", "function", "l", "r", "pl", "pr"]
    pairs = spark.createDataFrame(rows, "doc_id long, other long, function byte, l int, r int, pl int, pr int")
    wanted = []
    for d, o in {r[:2] for r in rows}:
        group = {c: np.array([r[i] for r in rows if r[:2] == (d, o)]) for i, c in enumerate(names)}
        wanted += [(d, lo, hi, o, plo, phi) for lo, hi, plo, phi in _stretches(group, 46, 35)]
    assert len({w[0] for w in wanted}) == 2
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows_in_batch in ("5", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_in_batch)
            assert sorted(map(tuple, _joined(pairs, 46, 35).collect())) == sorted(wanted)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_a_frequent_signature_is_searched_in_shares(spark):
    own = spark.createDataFrame([(s, d) for s, n in ((1, 40), (2, 3)) for d in range(n)], "signature long, doc_id long")
    assert _rounds(own, own, 2_000) == 1 and _rounds(own, own, 400) == 5 and _rounds(own.limit(0), own, 1) == 1

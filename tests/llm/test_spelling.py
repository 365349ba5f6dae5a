"""Spelling variants against their definition, and the trees against plain distances."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from webweave.llm import spelling
from webweave.llm.spelling import Cell, KdTree, letter_counts, one_edit, spelling_variants


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    return out - {word}


def _brute(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    alphabet = {c for w in words for c in w}
    near = {w: _edits(w, alphabet) & words.keys() for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def _found(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(3, 9))) for _ in range(150)]
    words = list(base)
    for w in base:
        for _ in range(4):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeté") + w[i:], w[:i] + "x" + w[i + 1 :], w[::-1]]))
    docs = [(i, " ".join(rng.choices(words, [1 / (k % 150 + 1) for k in range(len(words))], k=rng.randint(0, 200)))) for i in range(150)]
    return docs + [
        (150, None), (151, ""), (152, "1 2 3 ,,,"), (None, "Straße STRASSE straÿe ÷×÷×÷ " * 3), (153, "anagram nagaram gramana " * 4),
        (153, "anagram nagaram gramana " * 4), (154, ("z" * 300 + " ") * 3 + ("z" * 299 + " ") * 8), (155, "word " * 60_000),
        (156, "don't ét́e Ünder ünder 漢字words🙂words " * 5),
    ]


@pytest.mark.parametrize("small", [False, True])
def test_variants_equal_brute_force(docs_of, corpus, monkeypatch, small):
    if small:  # many cells and leaves, counts sent on early
        for name, value in (("CELL_WORDS", 7), ("LEAF_WORDS", 3), ("SAMPLE_WORDS", 120), ("COUNTED_WORDS", 40), ("_CHUNK", 4_000)):
            monkeypatch.setattr(spelling, name, value)
    assert _found(spelling_variants(docs_of(corpus))) == _brute(corpus)


def test_roots_follow_long_ways(docs_of):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc"]
    docs = [(1, " ".join(f"{w} " * (3 * 2**k) for k, w in enumerate(chain)))]  # an id that deletes no letter here
    got = _found(spelling_variants(docs_of(docs)))
    assert got == _brute(docs) and got["aaaaa"][1] == "bbbbc"


def test_very_long_words(docs_of):
    long = "etao" * 10_000
    got = _found(spelling_variants(docs_of([(1, f"{long} " * 9 + f"{long[:-1]} " * 4 + f"x{long[1:]} " * 3 + f"{long[::-1]} " * 3)])))
    assert got[long][2:4] == (9, 2) and got[long[:-1]] == (long, long, 4, 1, 9) and got[long[::-1]][3] == 0


def test_empty_tables(docs_of):
    assert spelling_variants(docs_of([(1, "x")]).limit(0)).count() == 0
    assert spelling_variants(docs_of([(1, None), (2, "one word only once")])).count() == 0


def test_tree_finds_every_vector_within_reach():
    rng = np.random.default_rng(2)
    vectors = rng.integers(0, 3, (700, spelling.DIMENSIONS)).astype(np.int8) * (rng.random(spelling.DIMENSIONS) < 0.2)
    vectors = vectors.astype(np.int8)
    tree = KdTree(vectors, 5)
    assert sorted(np.concatenate(tree.members)) == list(range(700))
    leaf = tree.leaf_of(vectors)
    for reach in (0, 1, 2):
        seen = defaultdict(set)
        for number, rows in tree.search(vectors, reach):
            assert (leaf[tree.members[number]] == number).all()
            for r in rows.tolist():
                seen[r].update(tree.members[number].tolist())
        far = np.abs(vectors[:, None].astype(int) - vectors[None].astype(int)).sum(2)
        for r in range(700):
            assert set(np.flatnonzero(far[r] <= reach).tolist()) <= seen[r]
    pruned = sum(len(rows) for _, rows in tree.search(vectors, 2))
    assert pruned < 700 * len(tree.members) / 3
    assert len(KdTree(np.zeros((50, spelling.DIMENSIONS), np.int8), 5).members) == 1


def test_letters_are_verified_in_order():
    words = ["abcde", "abced", "abcdf", "abcd", "abcdef", "bcde", "aabcde", "edcba", "abxde", "abcdé", "xbcdy"]
    for q in words:
        group = defaultdict(list)
        for w in words:
            group[len(w)].append(w.encode("latin-1"))
        found = set()
        for length, members in group.items():
            if abs(length - len(q)) <= 1:
                cell = Cell(members)
                found |= {members[w].decode("latin-1") for _, ws in cell.near([q.encode("latin-1")]) for w in ws}
        assert found == _edits(q, set("abcdefxyé")) & set(words)
    a, b = (np.frombuffer(x, np.uint8).reshape(1, -1) for x in (b"abab", b"ababa"))
    assert one_edit(a, b).all() and one_edit(b, a).all() and not one_edit(a, a).any()
    assert letter_counts(a)[0, :2].tolist() == [2, 2]

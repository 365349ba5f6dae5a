"""Sum-of-squares packing against its definition and an exact round trip."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webweave.llm import square_packing
from webweave.llm.square_packing import Levels, Packer, pack_online

WORDS = public_tokenizers.path("word_bpe_49k.json")


def _cost(levels, size):
    counts = defaultdict(int)
    for h in levels:
        if 0 < h < size and h & (h - 1):
            counts[h] += 1
    return sum(n * n for n in counts.values())


@pytest.mark.parametrize("size", [16, 64])
def test_every_piece_goes_where_the_sum_of_squares_is_least(size):
    rng = random.Random(size)
    levels, fills = Levels(size), []
    for _ in range(600):
        length = rng.choice([1, 2, 3, 5, 7, size // 3, size // 2, size - 1, rng.randint(1, size - 1)])
        options = {}
        for h in {0, *fills}:
            if h + length <= size:
                after = list(fills)
                if h:
                    after.remove(h)
                options[h] = _cost([*after, h + length], size)
        least = min(options.values())
        level = levels.place(length)
        assert level == max(h for h, c in options.items() if c == least)
        if level:
            fills.remove(level)
        if level + length < size:
            fills.append(level + length)
        assert levels.windows.sum() == len(fills)


def _check(pieces, texts, size, end_id):
    """Pieces as dicts: every id in one piece, sequences gapless and never padded."""
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        per_doc[p["doc_id"]].append(p)
        per_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(per_doc) == set(texts)
    for i, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        at = 0
        for p in sorted(per_doc[i], key=lambda p: p["start"]):
            part = np.asarray(ids[at : at + p["length"]], "<u4").tobytes()
            assert (p["start"], p["ids_crc32"], p["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
            assert p["length"] > 0 and (p["ids"] is None or p["ids"] == part)
            at += p["length"]
        assert at == len(ids)
    for places in per_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size and not at & (at - 1)


def test_round_trip_of_odd_texts(spark, docs_of, prose):
    texts = {i: prose(i, n) for i, n in enumerate([1, 3, 50, 200, 700, 4_000, 90, 90])}
    texts |= {100: None, 101: "", 102: " \n", 103: "x" * 30_000, 104: "It's we'LL <|endoftext|> 🙂 漢字", 105: prose(0, 1), 106: "word " * 4_095, 107: "word " * 4_096}
    docs = docs_of(list(texts.items())).repartition(3)
    pieces = [r.asDict() for r in pack_online(docs, WORDS, 64).collect()]
    _check(pieces, texts, 64, 2)
    assert {p["ids"] for p in pack_online(docs, WORDS, keep_ids=False).toPandas().to_dict("records")} == {None}
    assert pack_online(docs.limit(0), WORDS).count() == 0
    whole = [r.asDict() for r in pack_online(docs.coalesce(1), WORDS).collect()]
    _check(whole, texts, 4096, 2)
    with pytest.raises(ValueError):
        pack_online(docs, WORDS, 100)


def test_repeated_and_null_ids(docs_of):
    docs = docs_of([(1, "same text"), (1, "same text"), (None, "other"), (None, None)])
    rows = pack_online(docs, WORDS).toPandas()
    rows["known"] = rows["doc_id"].notna()
    assert rows.groupby("known")["length"].sum().to_dict() == {True: 6, False: 3}
    assert sorted(rows.drop_duplicates(["known", "doc_tokens"])["doc_tokens"]) == [1, 2, 3]


def test_held_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(square_packing, "HELD_TOKENS", 500)
    rng, packer = random.Random(1), Packer(64, 0)
    rows, most, given = [], 0, 0
    for i in range(800):
        n = rng.randint(1, 200)
        given += n
        rows += packer.add(i, np.arange(n, dtype="<u4").tobytes())
        most = max(most, packer.held)
    rows += packer.finish()
    assert most <= 500 and sum(r[2] for r in rows) == given
    fills = defaultdict(int)
    for r in rows:
        fills[r[5]] += r[2]
    assert all(not n & (n - 1) and n <= 64 for n in fills.values())


def test_query_on_the_given_table(spark, sf_dir):
    from webweave.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op13_square_packing"](spark, sf_dir)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    _check([r.asDict() | {"ids": None} for r in rows.collect()], texts, 4096, 2)

"""Operators that work document by document: URLs, archives, encoding, packing, exact duplicates."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import zlib
from itertools import product

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from webweave.llm import packing, warc
from webweave.llm.bpe import _encoder, encode_texts, replay_of
from webweave.llm.exact_dedup import CHUNK, exact_duplicates, without_duplicates
from webweave.llm.url_filters import Rule, Trie, judge_urls

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "\n\n", "a", "A b\u00a0c\u2003d", "x" * 3_000, "ab" * 2_000, "é" * 999, "🙂 \x00 漢字\t ", "It's we'LL 12,000 <|endoftext|>", "ΑΣ. İ ǅ"]


def test_trie_takes_longest_host_then_path():
    rules = [Rule("net", "/", "block"), Rule("a.net", "/x/", "allow"), Rule("a.net", "/x/yz", "block"), Rule("", "/any", "block")]
    trie = Trie(rules)

    def brute(host, path):
        fits = [r for r in rules if (not r.host or f".{host}".endswith(f".{r.host}")) and path.startswith(r.path)]
        return max(fits, key=lambda r: (len(r.host), len(r.path)), default=None)

    hosts = ["net", "a.net", "b.a.net", "ba.net", "", "net.", "a.net.org", "x"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/yz", "/x/yzz/q", "/anything", "any", "//x/"]
    for host, path in product(hosts, paths):
        assert trie.longest(host, path) == brute(host, path), (host, path)


def test_urls_of_any_shape(spark):
    urls = [None, "", "no scheme", "HTTP://A.NET", "http://a.net?q=/en/", "x://b.a.net:80/p#f", "http://É.org/fr/x://y", "http://u.net/en/", "http://u.net/en/"]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    rows = {r.page_id: r for r in judge_urls(pages, [Rule("net", "/", "block"), Rule("net", "/", "allow")]).collect()}
    assert [(rows[i].host, rows[i].path) for i in range(7)] == [
        ("", ""), ("", ""), ("", ""), ("a.net", ""), ("a.net", ""), ("b.a.net:80", "/p"), ("É.org", "/fr/x://y")
    ]
    assert (rows[3].verdict, rows[7].verdict, rows[7].rule, rows[8].verdict) == ("allow", "block", "net/", "block")
    assert judge_urls(pages.limit(0), []).count() == 0
    with pytest.raises(ValueError):
        judge_urls(pages, [Rule("x" * 40_000_000, "/", "block")])


def test_bundle_is_seekable():
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = warc.BundleWriter(sink, 700)
    records = [warc.make_record(i, f"http://x/{i}\r\n", bytes(range(i % 250)) * 3 + b"\r\n\r\n", hashlib.sha1().hexdigest(), None, "d") for i in range(40)]
    places = [writer.add(r) for r in records]
    writer.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    bundle = warc.BundleReader(Source(sink.getvalue()))
    assert len(bundle.frames) > 5
    for record, (frame, offset) in zip(records, places):
        assert bundle.frame(frame)[offset : offset + len(record)] == record
    assert [r for i in range(len(bundle.frames)) for r in warc._records(bundle.frame(i))] == records
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True) as stream:
        assert stream.read() == b"".join(records)  # any reader of the format passes over the seek table
    with pytest.raises(ValueError):
        warc.BundleReader(Source(b"x" * 50))


def test_archives_round_trip(spark):
    long = "ä" * 600
    rows = [(1, "u", long), (2, "u", long), (5, None, long), (3, "v", "short"), (4, "v", "short"), (6, "w", None), (None, "w", "z" * 1000), (7, "", ""), (5, "r", long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    index = warc.write_archives(pages)
    found = sorted(((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, bytes(r.payload or b"")) for r in warc.read_archives(index).collect()), key=str)
    expected = sorted((
        (i or -1, "revisit" if t == long and i != 5 else "response", 5 if t == long and i != 5 else None, len((t or "").encode()),
         hashlib.sha1((t or "").encode()).hexdigest(), b"" if t == long and i != 5 else (t or "").encode())
        for i, _, t in rows
    ), key=str)
    assert found == expected
    some = warc.look_up(index.where("page_id in (2, 3)"), payloads=False).collect()
    assert sorted((r.page_id, r.record_type, r.payload_bytes) for r in some) == [(2, "revisit", 1200), (3, "response", 5)]
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_archives_are_read_by_many_tasks(spark):
    pages = spark.range(400).repartition(8).selectExpr("id AS page_id", "'u' AS url", "sha2(string(id), 512) AS html")
    index = warc.write_archives(pages, file_bytes=4_000, frame_bytes=1_000)
    assert index.select("file").distinct().count() > 16
    read = warc.read_archives(index)
    assert read.count() == 400
    assert read.selectExpr("spark_partition_id() AS task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.fixture(scope="module")
def tiktoken_of():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay_equals_the_library(tiktoken_of):
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("aAbé \n\t1🙂'sß漢 .!\u00a0") for _ in range(rng.randint(0, 80))) for _ in range(2_000)]
    encoder = _encoder(RANKS, public_tokenizers.PATTERN)
    for text, line in zip(texts, encoder.encode(texts)):
        assert line == " ".join(map(str, tiktoken_of.encode_ordinary(text)))
        assert encoder.replay.decode(line) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), max_size=5))
def test_merge_replay_equals_piece_by_piece(pieces):
    replay = replay_of(RANKS)
    assert replay.encode(pieces) == [[replay.ranks[p]] if p in replay.ranks else replay._alone(p) for p in pieces]


def test_encoding_of_a_table(docs_of, tiktoken_of):
    docs = docs_of([*enumerate(ODD), (None, "x y"), (1, "x y")])
    rows = encode_texts(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows[: len(ODD)]:
        ids = tiktoken_of.encode_ordinary(ODD[r.doc_id] or "")
        assert (r.n_tokens, r.ids, bytes(r.decoded)) == (len(ids), " ".join(map(str, ids)), (ODD[r.doc_id] or "").encode())
    digest = encode_texts(docs.limit(1), RANKS, public_tokenizers.PATTERN, digests=True).first()
    assert digest.ids_sha256 == hashlib.sha256(b"").hexdigest() == digest.decoded_sha256
    assert encode_texts(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_words_are_encoded_as_in_whole_texts(prose):
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    rng = random.Random(6)
    texts = [t or "" for t in ODD] + [prose(i, 60) for i in range(50)]
    texts += ["".join(rng.choice("aAÉé \n\x1c\u0301'sSß.,!1 \u200b") for _ in range(40)) for _ in range(1_000)]
    encoder = packing._tokenizer(WORDS)
    for text, found in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(text) == b"".join(i.to_bytes(4, "little") for i in found.ids), repr(text)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 30))
def test_fullest_is_fullest(counts, capacity):
    used = packing.fullest(counts, capacity)
    assert all(0 < n <= counts[k] for k, n in used.items())
    sums = {sum(k * n for k, n in zip(counts, many)) for many in product(*(range(n + 1) for n in counts.values()))}
    assert sum(k * n for k, n in used.items()) == max(x for x in sums if x <= capacity)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 50), max_size=12))
def test_plan_uses_every_piece_once(counts):
    plan = packing.plan_bins(counts, 20)
    used: dict[int, int] = {}
    for times, bin_ in plan:
        assert sum(k * n for k, n in bin_.items()) <= 20
        for k, n in bin_.items():
            used[k] = used.get(k, 0) + times * n
    assert used == counts


def test_packing_of_a_table(docs_of, prose):
    texts = [*ODD, *(prose(i, 5 + 7 * i) for i in range(40)), "on " * 400]
    docs = docs_of([*enumerate(texts), (None, "on"), (1, "on")])
    rows = packing.pack(docs, WORDS, size=64, end_id=1).collect()
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    bins: dict[int, list[tuple[int, int]]] = {}
    pieces: dict[int, dict[int, bytes]] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        if r.doc_id is not None and r.doc_id != 1:
            assert r.start == 64 * r.piece
            pieces.setdefault(r.doc_id, {})[r.piece] = bytes(r.ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    for i, text in enumerate(texts):
        if i != 1:
            ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
            assert b"".join(pieces[i][k] for k in sorted(pieces[i])) == b"".join(x.to_bytes(4, "little") for x in ids)
    assert len(bins) <= sum(r.length for r in rows) / 64 * 1.05 + 1
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_ids_do_not_pass_through_python_to_be_placed(docs_of, prose):
    plan = packing.pack(docs_of([(1, prose(1, 9)), (2, "")]), WORDS)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


def test_chunks_make_up_the_text(spark, prose):
    from pyspark.sql import functions as F

    texts = ["", "a", "é" * 10_000, prose(1, 4_000), "x" * 511 + "a b", "\n".join(prose(i, 300) for i in range(9))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(CHUNK), F.lit(0)).alias("c"))
    for r in rows.collect():
        assert "".join(r.c) == r.t and all(len(c) <= 4096 for c in r.c)


def test_exact_duplicates(docs_of, prose):
    long = prose(3, 3_000)
    rows = [(1, long), (9, long), (4, long), (2, long + "."), (5, None), (6, ""), (7, " "), (8, "É"), (10, "é"), (11, "r"), (11, "r"), (None, "n"), (12, "n"), (None, "z")]
    docs = docs_of(rows)
    found = exact_duplicates(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert {i: (r.keep_id, r.group_size) for i, r in by_id.items()} == {
        1: (9, 3), 9: (9, 3), 4: (9, 3), 2: (2, 1), 5: (6, 2), 6: (6, 2), 7: (7, 1), 8: (8, 1), 10: (10, 1), 11: (11, 2), 12: (12, 2)
    }
    assert all(r.text_sha256 == hashlib.sha256((dict(rows)[i] or "").encode()).hexdigest() for i, r in by_id.items())
    assert sorted(r.kept for r in found if r.doc_id == 11) == [False, True]
    assert sorted((r.keep_id or 0, r.kept) for r in found if r.doc_id is None) == [(0, True), (12, False)]
    kept = without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 6, 7, 8, 9, 10, 11, 12]
    assert exact_duplicates(docs.limit(0)).count() == 0

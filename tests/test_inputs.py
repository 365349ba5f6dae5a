"""Inputs as they really come: odd bytes, repeated rows, further columns, long words."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest

from webweave.functions.html import decode_page, read_page
from webweave.operators import crawl, language
from webweave.operators.blocks import distances
from webweave.operators.keys import latest_rows, upsert, without_key
from webweave.plans.ingest import State, ingest
from webweave.schemas import BACKLINK_KEYS, BACKLINKS, DOMAINS, SCRAPED_DOMAINS, URL_MATCHES
from webweave.sources.export import read_export
from webweave.sources.store import read_stored, replace_table
from webweave.streaming.incremental import stream_backlinks


@pytest.mark.parametrize("page, text", [
    ("<meta charset=iso-8859-1>é".encode("latin-1"), "<meta charset=iso-8859-1>é"),
    ("ä€".encode("cp1252"), "ä€"), ("ä€".encode(), "ä€"), (b"\xef\xbb\xbfx", "x"), ("﻿ab".encode("utf-16-le"), "ab"),
    ("﻿ab".encode("utf-16-be"), "ab"), ('<meta content="text/html; charset=nonsense">é'.encode(), '<meta content="text/html; charset=nonsense">é'),
])
def test_charsets(page, text):
    assert decode_page(page) == text


def test_broken_pages_are_rows(spark):
    pages = spark.createDataFrame(
        [("a", bytearray(b"<title>\xe9</title><body>x")), ("b", bytearray(b"\x81\xff")), ("c", None), ("d", bytearray(b""))], "domain string, html binary"
    )
    rows = {r.domain: r for r in crawl.extract_pages(pages).collect()}
    assert (rows["a"].title, rows["a"].main, rows["a"].parse_error) == ("é", "x", None)
    assert rows["b"].parse_error and rows["c"].parse_error is None and rows["d"].main is None


def test_unclosed_tags_cost_the_same_each():
    start = time.perf_counter()
    title, main, _ = read_page("<title>t</title><body>" + "<p>x</q>" * 100_000)
    assert (title, len(main.split())) == ("t", 100_000) and time.perf_counter() - start < 5


def test_long_words_keep_all_grams(spark):
    word = "".join(chr(97 + i * i % 26) for i in range(200))
    rows = spark.createDataFrame([(word,)], "word string")
    padded = f" {word} "
    expected = sorted(padded[i : i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1) if padded[i : i + k] != " ")
    assert sorted(r.gram for r in language._with_grams(rows).collect()) == expected
    docs = spark.createDataFrame([("a-long-language-code", word), ("x", "b" * 5), (None, "c")], "lang string, text string")
    model = language.train_language_model(docs, "lang", "text")
    assert {r.lang for r in model.select("lang").distinct().collect()} == {"a-long-language-code", "x"}
    assert word in [r.word for r in language.word_counts(docs, "lang", "text").collect()]


def test_small_values_are_not_merged():
    frame = pd.DataFrame({"idx": [np.array([0])] * 3, "val": [np.array([x]) for x in (1e-9, 2e-9, 2e-9)]})
    d = distances(frame, frame)
    assert d[1, 2] == 0 and np.allclose(distances(frame.assign(val=[v * 1e9 for v in frame.val]), frame.assign(val=[v * 1e9 for v in frame.val]))[0, 1], 1)


def test_latest_of_repeated_rows(spark):
    rows = spark.createDataFrame(
        [(1, "a", 5, "x"), (1, "b", 7, None), (1, "c", 7, "y"), (2, "d", None, "z"), (None, "e", 1, "q")], "k int, v string, t int, w string"
    )
    assert sorted(map(tuple, latest_rows(rows, ["k"], ["t"]).collect())) == [(1, "c", 7, "y"), (2, "d", None, "z")]
    assert [r.v for r in without_key(rows, ["k"]).collect()] == ["e"]


def test_upsert_takes_up_columns(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 8)], "k int, v string, more int")
    with pytest.raises(ValueError):
        upsert(old, new, ["k"], "all")
    got = upsert(old, new, ["k"], "all", add_columns=True)
    assert sorted(map(tuple, got.collect())) == [(1, "a", None), (2, "c", 9), (3, "d", 8)]


HEADER = ["#", "Referring Page URL", "Link URL", "Link Anchor", "Backlink Status", "First Seen", "Last Check", "Day Lost", "Extra (desc)"]
LINES = [
    ["1", "http://a.com/1", "http://t", "x", "", "2020-01-01", "2020-01-02", "", "e1"],
    ["2", "http://a.com/1", "http://t", "y", "Lost", "2020-01-01", "2020-01-05", "", "e2"],
    ["3", "http://b.com/1", "http://t", "y", "", "never", "2020-01-05", "", "e3"],
]


def _state(spark):
    return State(*[spark.createDataFrame([], s) for s in (BACKLINKS, DOMAINS, URL_MATCHES, SCRAPED_DOMAINS)])


def _links(spark):
    return spark.createDataFrame([tuple(x) for x in LINES], ", ".join(f"`{c}` string" for c in HEADER))


def test_ingest_of_repeats_extras_and_rejects(spark):
    domains = spark.createDataFrame([("1", "a.com", "5", "7", "2019-01-01", "z")] * 2, "`#` string, `Referring Domain` string, `Domain Rating (desc)` string, `Organic Traffic` string, `First Seen` string, Note string")
    state = ingest(_links(spark), domains, _state(spark), "2024-01-01")
    again = ingest(_links(spark), domains, state, "2024-01-01")
    for s in (state, again):
        (row,) = s.backlinks.collect()
        assert (row.link_anchor, row.live, row.extra) == ("y", False, "e2")
        assert [r.note for r in s.domains.collect()] == ["z"]
        assert [(r.domain, r.total_backlinks) for r in s.scraped.collect()] == [("a.com", 1)]
        assert [r.extra for r in s.rejected_backlinks.collect()] == ["e3"] and s.rejected_domains.count() == 0


def test_exports_with_returns_and_byte_order(spark, tmp_path):
    text = "\r\n".join("\t".join(x) for x in [HEADER, *LINES]) + "\r\n"
    for encoding in ("utf-16-le", "utf-16-be"):
        (tmp_path / encoding).write_bytes(("﻿" + text).encode(encoding))
    for encoding in ("UTF-16LE", "UTF-16BE"):
        rows = read_export(spark, str(tmp_path / encoding.lower().replace("utf-16", "utf-16-")), encoding=encoding)
        assert rows.columns[-1] == "Extra (desc)" and [r[-1] for r in rows.collect()] == ["e1", "e2", "e3"]
    with pytest.raises(ValueError):
        read_export(spark, str(tmp_path / "utf-16-be"))


def test_stream_takes_up_columns(spark, tmp_path):
    table, folder = str(tmp_path / "table"), str(tmp_path / "in")
    replace_table(spark.createDataFrame([], BACKLINKS), table, BACKLINK_KEYS)
    _links(spark).write.parquet(folder)
    query = stream_backlinks(
        spark.readStream.schema(_links(spark).schema).parquet(folder), lambda: read_stored(spark, table),
        lambda df: replace_table(df, table, BACKLINK_KEYS), lambda n: "2024-01-01", str(tmp_path / "progress"),
    )
    query.awaitTermination(120)
    (row,) = read_stored(spark, table).collect()
    assert (row.link_anchor, row.extra) == ("y", "e2")


def test_captures_are_a_log(spark):
    tried = spark.createDataFrame([("d", 0, "u"), ("d", 1, "v")], "domain string, pos int, url string")
    log = spark.createDataFrame([
        ("u", 200, None, "old", "1"), ("u", 200, None, "new", "2"), ("v", 500, None, "e", "1"), ("v", None, "timeout", None, "3"), ("u", 200, None, "new", "2"),
    ], "url string, status_code int, request_error string, html string, fetched_at string")
    (row,) = crawl.pick_response(tried, log).collect()
    assert (row.html, row.last_scrape_request_error, row.last_scrape_code) == ("new", "timeout", None)

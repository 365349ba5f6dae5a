"""URLs, names, links and other scalar columns on hand-made rows."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webweave.functions import columns as C
from webweave.functions import urls as U
from webweave.functions.html import read_page
from webweave.operators import crawl
from webweave.operators.matching import match_domain


def rows(df):
    return [tuple(r) for r in df.collect()]


URLS = [
    ("https://www.a.com/x?y=1", ("https://", "www.", "a.com", "x", "y=1")),
    ("http://wwwfoo.com/", ("http://", "wwwf", "oo.com", None, None)),
    ("https://www2.b.org", ("https://", "www2.", "b.org", None, None)),
    ("https://wwww.c.org/p/q?z#f", ("https://", "wwww.", "c.org", "p/q", "z#f")),
    ("x http://d.com#top", ("http://", None, "d.com#top", None, None)),
    ("ftp://e.com", (None,) * 5),
    ("https://", ("https://", None, None, None, None)),
    ("https://www.com", ("https://", "www.", "com", None, None)),
    ("http://f.com:80/a b ?q= 1 ", ("http://", None, "f.com:80", "a b", "q= 1")),
    ("HTTP://G.com", (None,) * 5),
    ("http://h.com/a\nb?c\nd", ("http://", None, "h.com", "a\nb", "c")),
    ("https://i.com?q=1/2", ("https://", None, "i.com", None, "q=1/2")),
    ("https://user@j.com/", ("https://", None, "user@j.com", None, None)),
    ("https://www٣.k.com/", ("https://", "www٣.", "k.com", None, None)),
    ("https://l.com/a b?c d", ("https://", None, "l.com", "a b", "c d")),
    ("http://www/", ("http://", "www/", None, None, None)),
    ('"https://m.com/n"', ("https://", None, "m.com", "n", None)),
    ('"https://m.com/n', ("https://", None, "m.com", "n", None)),
    ('https://m.com/n"', ("https://", None, "m.com", 'n"', None)),
    (None, (None,) * 5),
]


def test_split_url(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)], "i int, u string")
    got = {r.i: r.s for r in df.select("i", U.split_url(F.col("u")).alias("s")).collect()}
    for i, (url, parts) in enumerate(URLS):
        assert tuple(got[i])[:5] == parts, url
        assert (got[i].error is None) == (parts[0] is not None), url


def test_url_main(spark):
    cases = {
        "https://www.a.com/x": "a.com", "http://a.com?q": "a.com?q", "x http://a.com": None,
        "http://wwwxa.com": "a.com", "https:///p": "", "//a.com": None, "http://www.": "",
    }
    df = spark.createDataFrame(list(cases.items()), "u string, h string")
    for url, want, got in rows(df.select("u", "h", U.url_main(F.col("u")))):
        assert want == got, url


def test_candidates(spark):
    df = spark.createDataFrame(
        [("both", 1, 1, 2), ("secure", 2, 0, 2), ("plain", 0, 2, 2)],
        "domain string, url_https long, url_www long, total_backlinks long",
    )
    got = sorted(rows(crawl.candidates(df)))
    assert [u for d, _, u in got if d == "both"] == [
        "https://www.both", "http://www.both", "https://both", "http://both"
    ]
    assert [u for d, _, u in got if d == "secure"] == ["https://secure"]
    assert [u for d, _, u in got if d == "plain"] == ["http://www.plain"]


def test_names():
    names = ["#", "Referring Page URL", "Domain Rating (desc)", "Traffic %", "Description"]
    assert [C.normalize_name(n) for n in names] == [
        "#", "referring_page_url", "domain_rating", "traffic", "ription"
    ]


def test_clean_link_and_timestamps(spark):
    df = spark.createDataFrame([("a\\b", "2020-01-02"), (None, "never")], "u string, t string")
    assert rows(df.select(U.clean_link(F.col("u")))) == [("a\\\\b",), (None,)]
    assert [r.t is None for r in C.parse_ts(df, ["t"]).collect()] == [False, True]
    assert rows(C.rejected_ts(df, ["t"])) == [(1,)]


def test_link_type(spark):
    df = spark.createDataFrame([("x",), (None,)], "anchor string")
    assert rows(df.select(C.link_type(F.col("anchor")))) == [("Has anchor",), ("No anchor",)]


def test_match_domain(spark):
    hosts = ["a.b.c", "b.c", "xb.c", "c", "b.c.", None, "q.a.b.c"]
    df = spark.createDataFrame([(h,) for h in hosts] * 2, "host string")
    known = spark.createDataFrame([("b.c",), ("q.a.b.c",), (None,)], "domain string")
    got = {r.host: (r.matching_domain, r.match_error) for r in match_domain(df, known, "host", "domain").collect()}
    assert len(got) == len(hosts)
    assert got["a.b.c"] == got["b.c"] == ("b.c", None)
    assert got["q.a.b.c"] == ("q.a.b.c", None)
    assert got["xb.c"] == got["c"] == got["b.c."] == (None, None)
    assert got[None][0] is None and got[None][1]


@pytest.mark.parametrize("page, want", [
    ("<title>a\n b</title><body>x</body>", ("a b", "x", [])),
    ("<body>a<header>h<header>k</header></header>b<header>second</header><footer>f</footer>c</body>",
     (None, "a b second c", [])),
    ("<body><header>h<footer>inner</footer></header>t<footer>f</footer></body>", (None, "t", [])),
    ("<body>o<main>a<!-- no -->b</main><main>c</main></body>", (None, "a b c", [])),
    ("<body><script>var x='</p>';</script><style>p{}</style>v&amp;w&nbsp;</body>", (None, "v&w", [])),
    ("<p>no body", (None, None, [])),
    ('<body><header><a href="http://h.com">h</a></header><a href="/rel">r</a><a href="https://k.com">k</a></body>',
     (None, "r k", ["https://k.com"])),
    ('<main>m</main><footer><a href="https://f.com">f</a></footer><a href="HTTP://x.com">x</a>',
     (None, "m", ["https://f.com"])),
    ("<body><b>unclosed<p>x</p></div>y", (None, "unclosed x y", [])),
    ("<body>a\t b\n\nc</body>", (None, "a b c", [])),
    ("", (None, None, [])),
])
def test_read_page(page, want):
    assert read_page(page) == want


def test_own_links_and_hosts(spark):
    df = spark.createDataFrame(
        [("a.com", "<body><a href='https://www.a.com/x'>1</a><a href='http://b.com/?u=a.com'>2</a>"
                   "<a href='http://c.com/1'>3</a><a href='http://c.com/2'>4</a></body>"),
         ("none.com", None)], "domain string, html string")
    got = {r.domain: r for r in crawl.extract_pages(df).collect()}
    assert got["a.com"].links == ["http://c.com/1", "http://c.com/2"]
    assert got["a.com"].links_main_domains == ["c.com"]
    assert got["none.com"].main is None and got["none.com"].links is None


def test_pages_are_read_a_slice_at_a_time(spark):
    from webweave.functions import html

    pages = [b"<title>%d</title>" % i + b" " * 400_000 if i % 4 else None for i in range(20)]
    assert max(len(x) for x in html._slices(pa.array(pages))) <= 4
    assert [p for some in html._slices(pa.array(pages)) for p in some] == pages
    got = spark.createDataFrame(list(enumerate(pages)), "i int, html binary").coalesce(1).select("i", html.extract_page("html").alias("p"))
    assert {r.i: r.p.title for r in got.collect()} == {i: str(i) if i % 4 else None for i in range(20)}

"""Export files, keyed tables, upserts, encodings and crawl results."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from webweave import schemas
from webweave.operators import crawl
from webweave.operators.keys import check_keys, upsert
from webweave.plans.ingest import State, clean_backlinks, ingest, ingest_into, stored_in
from webweave.sources import store, tables
from webweave.sources.export import read_export


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_read_export(spark, tmp_path):
    text = '#\tReferring Page URL\tLink URL\tLink Anchor\tBacklink Status\tFirst Seen\tLast Check\tDay Lost\n'
    text += '1\thttps://www.a.com/é\thttp://t.com\t"say ""hi"""\t\t2020-01-02 03:04:05\tnever\t\n'
    text += '2\thttp://b.com\thttp://t.com\t\tLost\t2020-01-03\t\t\n'
    path = tmp_path / "export.csv"
    path.write_bytes(text.encode("utf-16"))
    for multiline in (False, True):
        got = clean_backlinks(read_export(spark, str(path), multiline=multiline), "2024-01-01").collect()
        got = sorted(got, key=lambda r: r.referring_page_url, reverse=True)
        assert [r.referring_page_url for r in got] == ["https://www.a.com/é", "http://b.com"]
        assert [r.link_anchor for r in got] == ['say "hi"', None]
        assert [r.link_type for r in got] == ["Has anchor", "No anchor"]
        assert [r.live for r in got] == [True, False]
        assert [r.url_main for r in got] == ["a.com", "b.com"]
        assert got[0].last_check is None and got[0].first_seen.hour == 3
        assert "#" not in got[0].asDict()


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, c string, extra string")
    updates = spark.createDataFrame([(2, None), (3, "n")], "k int, c string")
    everything = upsert(target, updates, ["k"], "all")
    assert rows(everything) == [(1, "a", "x"), (2, None, "y"), (3, "n", None)]
    assert rows(upsert(everything, updates, ["k"], "all")) == rows(everything)
    assert rows(upsert(target, updates, ["k"])) == [(1, "a", "x"), (2, "b", "y"), (3, "n", None)]
    assert rows(upsert(target, updates, ["k"], ["c"])) == rows(everything)
    with pytest.raises(ValueError):
        upsert(target, updates, ["k"], "some")
    with pytest.raises(ValueError):
        upsert(updates, target, ["k"], "all")


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    stored = tables.replace_table(first, path, ["k"])
    # a table may be replaced by a plan that reads it
    again = tables.replace_table(upsert(stored, first.limit(1), ["k"], "all"), path, ["k"])
    assert rows(again) == rows(first)
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        broken = spark.createDataFrame(bad, "k int, c string")
        assert check_keys(broken, ["k"]).count() == 1
        with pytest.raises(tables.KeyViolation):
            tables.replace_table(broken, path, ["k"])
    assert rows(tables.read_stored(spark, path)) == rows(first)


def _files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet")}


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path = tmp_path / "t"
    old = spark.createDataFrame([(i, f"g{i % 40}", "old") for i in range(400)], "k int, g string, c string")
    store.replace_table(old, str(path), ["k", "g"], ["g"], buckets=16)
    before, manifest = _files(path), store.read_manifest(str(path))
    updates = spark.createDataFrame([(3, "g3", "new", 1), (1_003, "g3", "new", 2)], "k int, g string, c string, extra int")
    got = store.upsert_table(updates, str(path), "all", add_columns=True)
    want = {(i, f"g{i % 40}", "old", None) for i in range(400) if i != 3} | {(3, "g3", "new", 1), (1_003, "g3", "new", 2)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 401
    after = store.read_manifest(str(path))
    (bucket,) = store.buckets_of(updates, str(path))
    assert {b for b in after.folders if after.folders[b] != manifest.folders.get(b)} == {str(bucket)}
    assert before <= _files(path), "the version before stays readable"
    # an update of another bucket: what only the first version had is gone, all others stay
    later = spark.createDataFrame([(7, "g7", "newer", None)], "k int, g string, c string, extra int")
    store.upsert_table(later, str(path), "all")
    assert not any(f.startswith(manifest.folders[str(bucket)]) for f in _files(path))
    assert len([f for f in path.iterdir() if f.name.startswith("_manifest")]) == 2
    assert store.read_stored(spark, str(path)).count() == 401
    assert store.upsert_table(later.limit(0), str(path), "all").count() == 401


def test_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    store.replace_table(first, path, ["k"])
    before = store.read_manifest(path)
    broken = first.withColumn("c", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.replace_table(broken, path, ["k"])
    with pytest.raises(store.KeyViolation):
        store.upsert_table(spark.createDataFrame([(3, "x"), (3, "y")], "k int, c string"), path)
    assert store.read_manifest(path) == before and rows(store.read_stored(spark, path)) == rows(first)
    assert rows(store.replace_table(first.limit(0), path, ["k"])) == [] and store.read_stored(spark, path).columns == ["k", "c"]
    with pytest.raises(FileNotFoundError):
        store.read_stored(spark, str(tmp_path / "none"))


def test_repeated_batch_is_recognised(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace_table(spark.createDataFrame([(1, 0)], "k int, n int"), path, ["k"])
    for number, n in ((0, 5), (1, 6), (1, 99), (0, 98), (2, 7)):
        store.upsert_table(spark.createDataFrame([(1, n)], "k int, n int"), path, batch=("links", number))
        assert store.has_batch(path, ("links", number)) and not store.has_batch(path, ("other", number))
    assert rows(store.read_stored(spark, path)) == [(1, 7)]


def test_encoded_crawl_table(spark):
    text, links = "é" * 200, ["https://a.com/ü", None]
    cells = [base64.b64encode(x.encode()).decode() for x in (text, json.dumps(links, ensure_ascii=False))]
    df = spark.createDataFrame([("d", *cells), ("e", None, None)], "domain string, main string, links string")
    decoded = tables.import_crawl_table(df)
    got = {r.domain: r for r in decoded.collect()}
    assert got["d"].main == text and got["d"].links == links
    assert got["e"].main is None and got["e"].links is None
    encoded = tables.export_crawl_table(decoded.where("domain = 'd'")).first()
    assert base64.b64decode(encoded.main).decode() == text and "\n" not in encoded.main
    assert json.loads(base64.b64decode(encoded.links)) == links


def test_apply_scrape(spark):
    names = "domain string, first_seen string, last_scrape_code int, last_scrape_date string, "
    names += "last_successful_scrape_date string, last_scrape_parse_error string, "
    names += "last_scrape_request_error string, main string"
    old = spark.createDataFrame([
        ("ok", "1", None, None, None, None, None, None), ("bad", "1", 200, "2", "2", None, None, "old"),
        ("idle", "1", 200, "2", "2", None, None, "same"),
    ], names)
    new = spark.createDataFrame([
        ("ok", 200, "5", "5", None, None, "new"), ("bad", None, "5", None, None, "timeout", None),
    ], names.replace("first_seen string, ", ""))
    got = {r.domain: r for r in crawl.apply_scrape(old, new).collect()}
    assert got["ok"].main == "new" and got["ok"].first_seen == "1"
    assert got["bad"].main == "old" and got["bad"].last_scrape_request_error == "timeout"
    assert got["bad"].last_successful_scrape_date == "2" and got["bad"].last_scrape_date == "5"
    assert got["bad"].last_scrape_code is None
    assert got["idle"].main == "same" and got["idle"].last_scrape_code == 200


def test_pick_response(spark):
    tried = spark.createDataFrame([("d", 0, "u0"), ("d", 1, "u1"), ("d", 2, "u2"), ("e", 0, "v")], "domain string, pos int, url string")
    responses = spark.createDataFrame([
        ("u0", 200, None, "first", "t"), ("u1", 200, None, "second", "t"), ("u2", None, "timeout", None, "t2"),
        ("v", 404, None, "missing", "t"),
    ], "url string, status_code int, request_error string, html string, fetched_at string")
    got = {r.domain: r for r in crawl.pick_response(tried, responses).collect()}
    assert got["d"].html == "second" and got["d"].last_scrape_code is None
    assert got["d"].last_scrape_request_error == "timeout" and got["d"].last_scrape_date == "t2"
    assert got["e"].html is None and got["e"].last_scrape_code == 404
    first = {r.domain: r for r in crawl.pick_response(tried, responses, "first_ok").collect()}
    assert first["d"].html == "first"


def test_ingest_stores_each_table(spark, tmp_path):
    header = "`#` string, `Referring Page URL` string, `Link URL` string, `Link Anchor` string, `Backlink Status` string, "
    header += "`First Seen` string, `Last Check` string, `Day Lost` string"
    export = spark.createDataFrame([
        ("1", "https://www.m.a.com/1", "http://t", "", "", "2020-01-02", "", ""),
        ("2", "http://a.com/2", "http://t", "x", "Lost", "2020-01-01", "", ""),
        ("3", "http://other.org/", "http://t", "x", "", "2020-01-01", "", ""),
        ("4", "mailto:x", "http://t", "x", "", "2020-01-01", "", ""),
    ], header)
    domains = spark.createDataFrame(
        [("1", "a.com", "55.5", "7", "2019-01-01")],
        "`#` string, `Referring Domain` string, `Domain Rating (desc)` string, `Organic Traffic` string, `First Seen` string",
    )
    empty = State(*[
        spark.createDataFrame([], s)
        for s in (schemas.BACKLINKS, schemas.DOMAINS, schemas.URL_MATCHES, schemas.SCRAPED_DOMAINS)
    ])
    state = ingest(export, domains, empty, "2024-01-01", store=stored_in(str(tmp_path)))
    for _ in range(2):
        assert rows(state.url_matches) == [("a.com", "a.com", None), ("m.a.com", "a.com", None), ("other.org", None, None)]
        queue = state.scraped.collect()
        assert [(r.domain, r.total_backlinks, r.live_backlinks, r.url_www, r.url_https, r.first_seen.day) for r in queue] == [
            ("a.com", 2, 1, 1, 1, 1)
        ]
        assert state.backlinks.count() == 4 and state.domains.first().organic_traffic == 7
        state = ingest(export, domains, state, "2024-01-02", store=stored_in(str(tmp_path)))
    anchored = ingest(export, domains, empty, "2024-01-01", types=["Has anchor"]).scraped.first()
    assert anchored.total_backlinks == 1
    counts = {(r.table, r.column): r.n for r in state.rejected_times.collect()}
    assert set(counts.values()) == {0} and len(counts) == 4


def test_uploads_into_a_stored_state_equal_ingest(spark, tmp_path):
    """Uploads in turn: statuses change, a longer known domain takes hosts over, a row loses its type."""
    header = "`#` string, `Referring Page URL` string, `Link URL` string, `Link Anchor` string, `Backlink Status` string, "
    header += "`First Seen` string, `Last Check` string, `Day Lost` string"

    def links(*found):
        return spark.createDataFrame([("1", u, "http://t", a, s, day, "", "") for u, a, s, day in found], header)

    def names(*found):
        return spark.createDataFrame(
            [("1", d, "1", "2", "2019-01-01") for d in found],
            "`#` string, `Referring Domain` string, `Domain Rating (desc)` string, `Organic Traffic` string, `First Seen` string",
        )

    uploads = [
        (links(("https://www.m.a.com/1", "x", "", "2020-01-02"), ("http://a.com/2", "x", "", "1/2/2020"), ("http://b.org/", "", "", "soon")), names("a.com")),
        (links(("http://a.com/2", "", "Lost", "2020-01-02"), ("http://m.a.com/3", "x", "", "5 Jan 2020"), ("http://c.org/", "x", "", "Jan 3, 2020")), names("m.a.com", "c.org")),
        (links(("http://z.m.a.com/3", "x", "", "2019-01-05")), names("c.org").limit(0)),
    ]
    for types in (None, ["Has anchor"]):
        state = State(*[
            spark.createDataFrame([], s)
            for s in (schemas.BACKLINKS, schemas.DOMAINS, schemas.URL_MATCHES, schemas.SCRAPED_DOMAINS)
        ])
        folder = str(tmp_path / f"s{types is None}")
        for i, (export, known) in enumerate(uploads):
            state = ingest(export, known, state, f"2024-01-0{i + 1}", types, store=stored_in(f"{folder}-full"))
            stored = ingest_into(folder, export, known, f"2024-01-0{i + 1}", types)
            for name in ("backlinks", "domains", "url_matches", "scraped", "rejected_backlinks", "rejected_times"):
                assert rows(getattr(stored, name)) == rows(getattr(state, name)), (types, i, name)
        assert stored.scraped.count() == 3


def test_upload_reads_and_writes_its_hosts_buckets_only(spark, tmp_path):
    header = "`Referring Page URL` string, `Link URL` string, `Link Anchor` string, `Backlink Status` string, `First Seen` string, `Last Check` string, `Day Lost` string"
    many = spark.createDataFrame([(f"http://h{i}.com/", "http://t", "x", "", "2020-01-01", "", "") for i in range(200)], header)
    known = spark.createDataFrame([("h1.com", "1", "2", "2019-01-01")], "`Referring Domain` string, `Domain Rating` string, `Organic Traffic` string, `First Seen` string")
    ingest_into(str(tmp_path), many, known, "2024-01-01")
    before = store.read_manifest(str(tmp_path / "backlinks")).folders
    ingest_into(str(tmp_path), many.where("`Referring Page URL` = 'http://h1.com/'"), known, "2024-01-02")
    after = store.read_manifest(str(tmp_path / "backlinks")).folders
    assert sum(after[b] != before[b] for b in before) == 1 and set(after) == set(before)


def test_a_table_of_many_files_is_not_dealt_out(spark, tmp_path, capsys):
    from webweave.sources.tables import read_table

    spark.conf.set("spark.sql.files.openCostInBytes", str(2**27))
    try:
        spark.range(40).repartition(4).write.parquet(str(tmp_path / "t"))
        for n, exchanges in ((4, 0), (9, 1)):
            read_table(spark, str(tmp_path / "t"), n).explain()
            assert capsys.readouterr().out.count("Exchange") == exchanges
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")

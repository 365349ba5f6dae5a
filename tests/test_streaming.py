"""Uploads that arrive one file at a time end in the same table as one large upload."""

from __future__ import annotations

from pyspark.sql import types as T

from webweave.schemas import BACKLINK_KEYS, BACKLINKS
from webweave.sources.store import read_manifest, read_stored, replace_table
from webweave.streaming.incremental import export_stream, stream_backlinks, stream_into_table

HEADER = ["#", "Referring Page URL", "Link URL", "Link Anchor", "Backlink Status", "First Seen", "Last Check", "Day Lost"]


def test_stream_of_exports(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "backlinks")
    folder.mkdir()
    schema = T.StructType([T.StructField(c, T.StringType()) for c in HEADER])
    replace_table(spark.createDataFrame([], BACKLINKS), table, BACKLINK_KEYS)

    def put(name, lines):
        text = "\n".join("\t".join(x) for x in [HEADER, *lines]) + "\n"
        (folder / name).write_bytes(text.encode("utf-16"))

    def run():
        query = stream_backlinks(
            export_stream(spark, str(folder), schema),
            lambda: read_stored(spark, table),
            lambda df: replace_table(df, table, BACKLINK_KEYS),
            lambda n: "2024-01-01", str(tmp_path / "progress"),
        )
        query.awaitTermination(120)

    put("1.csv", [["1", "http://a.com", "http://t", "x", "", "2020-01-01", "2020-01-02", ""],
                  ["2", "http://b.com", "http://t", "", "", "2020-01-01", "2020-01-02", ""]])
    run()
    put("2.csv", [["1", "http://a.com", "http://t", "x", "Lost", "2020-01-01", "2020-02-02", "2020-02-01"]])
    run()
    run()
    got = {r.referring_page_url: (r.live, r.link_type, r.url_main) for r in read_stored(spark, table).collect()}
    assert got == {"http://a.com": (False, "Has anchor", "a.com"), "http://b.com": (True, "No anchor", "b.com")}


def test_stream_into_a_stored_table(spark, tmp_path):
    """Batches go into the buckets of their hosts, and a batch that comes again is recognised."""
    folder, table = tmp_path / "in", str(tmp_path / "backlinks")
    folder.mkdir()
    schema = T.StructType([T.StructField(c, T.StringType()) for c in HEADER])
    replace_table(spark.createDataFrame([], BACKLINKS), table, BACKLINK_KEYS, ["url_main"])

    def run(progress):
        query = stream_into_table(export_stream(spark, str(folder), schema), table, lambda n: f"2024-01-0{n + 1}", str(tmp_path / progress))
        query.awaitTermination(120)

    for i, status in enumerate(("", "Lost")):
        lines = [HEADER, ["1", "http://a.com", "http://t", "x", status, "2020-01-01", f"2020-01-0{i + 2}", ""]]
        (folder / f"{i}.csv").write_bytes(("\n".join("\t".join(x) for x in lines) + "\n").encode("utf-16"))
        run("progress")
    (row,) = read_stored(spark, table).collect()
    assert (row.live, row.last_updated.day) == (False, 2)
    before = read_manifest(table)
    run("lost progress")  # the stream starts anew: its batch 0 is in the ledger
    assert read_manifest(table) == before and before.batches == {"backlinks": 1}

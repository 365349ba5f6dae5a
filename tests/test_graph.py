"""Graph operators, ordered scans and reports on small inputs."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from webweave.catalog import _graph
from webweave.operators import graph, reports
from webweave.operators.ordered import group_medians, numbered, running
from webweave.plans.reports import NetworkReport


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def info_of(spark, pairs, removed=()):
    edges = edges_of(spark, pairs)
    nodes = graph.edge_nodes(edges)
    if removed:
        names = spark.createDataFrame([(r,) for r in removed], "domain string")
        nodes, edges = graph.remove_nodes(nodes, edges, names)
    attributes = spark.createDataFrame([], "domain string, domain_rating double, organic_traffic long")
    return graph.domain_info(nodes, edges, attributes)


def test_star_and_mutual(spark):
    stats = {r.centroid: r for r in graph.component_info(info_of(
        spark, [("a", "b"), ("b", "a"), ("h", "x"), ("y", "h"), ("h", "z"), ("x", "z"), ("s", "t")]
    )).collect()}
    assert (stats["h"].component, stats["h"].size, stats["h"].links, stats["h"].star) == (0, 4, 4, False)
    # a mutual pair: two links, and the centroid has two links
    assert (stats["a"].size, stats["a"].links, stats["a"].centroid_links, stats["a"].star) == (2, 2, 2, True)
    assert (stats["a"].component, stats["s"].component) == (1, 2)


def test_removal_leaves_isolated_nodes(spark):
    rows = graph.component_info(info_of(spark, [("a", "h"), ("b", "h"), ("h", "c")], ["h", "unknown"])).collect()
    assert sorted((r.centroid, r.size, r.links, r.density, r.star) for r in rows) == [
        (n, 1, 0, 0.0, True) for n in "abc"
    ]


def test_removals_in_turn_equal_a_graph_without_the_nodes(spark):
    """Members kept up to date by removals are those of the graph that never had the nodes."""
    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(55)] + [("lone", "pair"), ("pair", "lone")]
    pairs = sorted({p for p in pairs if p[0] != p[1]})
    edges = edges_of(spark, pairs)
    known, left = graph.members(graph.edge_nodes(edges), edges), edges
    gone = []
    for names in (["pair"], ["n7", "n30", "nobody"], ["n7"], ["n11"]):
        gone += names
        known, left = graph.members_without(known, left, spark.createDataFrame([(n,) for n in names], "domain string"))
        attributes = spark.createDataFrame([], "domain string, domain_rating double, organic_traffic long")
        got = sorted(tuple(r) for r in graph.members_info(known, attributes).collect())
        assert got == sorted(tuple(r) for r in info_of(spark, pairs, gone).collect())
        assert sorted(tuple(r) for r in left.collect()) == [p for p in pairs if not set(p) & set(gone)]


def test_components_of_numbers_and_names_agree(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(10, 99), rng.randrange(10, 99)) for _ in range(50)]
    numbers = spark.createDataFrame(pairs, "src long, dst long")
    names = edges_of(spark, [(str(a), str(b)) for a, b in pairs])
    nodes = spark.range(10, 99).withColumnRenamed("id", "domain")
    by_number = {r.domain: r.root for r in graph.connected(nodes, numbers).collect()}
    by_name = {int(r.domain): int(r.root) for r in graph.connected(nodes.selectExpr("string(domain) AS domain"), names).collect()}
    assert by_number == by_name and len(by_number) == 89


def test_empty_graph(spark):
    assert info_of(spark, []).count() == 0


def test_edges(spark):
    pages = spark.createDataFrame(
        [("a", ["b", "b", "a", None], ["x"]), ("b", None, [])],
        "domain string, links_main_domains array<string>, links array<string>",
    )
    assert [tuple(r) for r in graph.build_edges(pages, "all_domains").collect()] == [("a", "b")]
    with pytest.raises(ValueError):
        graph.build_edges(pages, "other")


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    for size, count in ((60, 40), (40, 39)):
        names = [f"n{i:03d}" for i in range(size)]
        pairs = [tuple(rng.sample(names, 2)) for _ in range(count)]
        if count == 39:  # a long path in random direction
            pairs = [tuple(rng.sample(names[i:i + 2], 2)) for i in range(size - 1)]
        root = {n: n for p in pairs for n in p}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        edges = edges_of(spark, pairs)
        got = {r.domain: r.root for r in graph.connected(graph.edge_nodes(edges), edges).collect()}
        assert got == {n: find(n) for n in root}


def test_network_report(spark):
    domains = spark.createDataFrame(
        [("a", 1.0, 10), ("b", 3.0, None), ("never", 5.0, 7)],
        "referring_domain string, domain_rating double, organic_traffic long",
    ).withColumns({"first_seen": F.current_timestamp(), "last_updated": F.current_timestamp()})
    scraped = spark.createDataFrame(
        [("a", ["b"], ["b", "x"], ["http://q"]), ("b", [], [], [])],
        "domain string, links_known_domains array<string>, links_main_domains array<string>, links array<string>",
    ).withColumns({"live_backlinks": F.lit(1), "total_backlinks": F.lit(1), "last_successful_scrape_date": F.current_timestamp()})
    report = NetworkReport(domains, scraped)
    row = report.component_info.first()
    assert (row.size, row.links, row.mean_domain_rating, row.max_organic_traffic) == (2, 1, 2.0, 10)
    wider = report.set_link_type("all_domains")
    assert wider.domain_info.count() == 3
    assert wider.remove_node("a").component_info.count() == 2
    assert wider.remove_node("a").reset_network_graph().component_info.count() == 1
    assert wider.get_component_by_domain("x").count() == 3 and wider.get_component(1).count() == 0
    assert wider.component_subgraph(0)[1].count() == 2


def test_running_and_numbered(spark):
    rng = random.Random(5)
    data = [(rng.choice("aab"), i, rng.randint(1, 9), rng.choice([None, None, i])) for i in range(500)]
    df = spark.createDataFrame(data, "g string, i int, x int, m int").repartition(4)
    got = running(df, ["g"], ["i"], total=("sum", "x"), seen=("last", "m"))
    totals, last = {}, {}
    want = {}
    for g, i, x, m in data:
        totals[g] = totals.get(g, 0) + x
        last[g] = m if m is not None else last.get(g)
        want[i] = (totals[g], last[g])
    assert {r.i: (r.total, r.seen) for r in got.collect()} == want
    order = [(r.i, r.n) for r in numbered(df, ["i"], "n").collect()]
    assert all(i == n for i, n in order)


def test_group_medians(spark):
    rng = random.Random(7)
    data = [(rng.choice("abc"), rng.choice([None, 1.0, 2.0, 2.0, rng.random()]), None) for _ in range(301)] + [("d", None, None)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    got = {r.g: (r.x, r.y) for r in group_medians(df, "g", ["x", "y"]).collect()}
    for g in "abc":
        assert got[g] == (statistics.median(x for h, x, _ in data if h == g and x is not None), None)
    assert "d" not in got


def test_real_clusters(spark):
    df = spark.createDataFrame(
        [("en", "en1"), ("en", "en-1"), ("zh-cn", "zh-cn3"), ("zh-cn", "zh-cn-1"), ("de", "de-clustering-failed"), ("x", None)],
        "lang string, cluster string",
    )
    assert [r.cluster for r in reports.real_clusters(df, strict=True).collect()] == ["en1"]
    assert sorted(r.cluster for r in reports.real_clusters(df).collect()) == ["en1", "zh-cn3"]


def test_queries_find_distinct_edges_and_nodes_once(spark, sf_dir):
    for rows in _graph(spark, sf_dir, "fx_edges_large"):
        assert all("/table-" in path for path in rows.inputFiles()) and rows.inputFiles()


def test_report_order(spark):
    df = spark.createDataFrame(
        [("en1", "en", 2, 0.1), ("de0", "de", 1, 0.5), ("en0", "en", 3, 0.9), ("en2", "en", 2, 0.05)],
        "cluster string, language string, num_domains int, mean_distance double",
    )
    assert [r.cluster for r in reports.in_report_order(df).collect()] == ["de0", "en0", "en2", "en1"]

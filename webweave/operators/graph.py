"""The directed link graph: edges, degrees, weak components and their reports.

A graph is a pair of DataFrames, ``nodes(domain)`` and ``edges(src, dst)``, because removing a node
can leave others without any edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from webweave.operators.ordered import numbered
from webweave.session import discard, materialize

# Link types and the crawl-table columns that hold them.
LINK_COLUMNS = {
    "all_known_domains": "links_known_domains",
    "all_domains": "links_main_domains",
    "all_links": "links",
}


def network_domains(domains: DataFrame, scraped: DataFrame) -> DataFrame:
    """Known domains with their crawl row; a domain that was never crawled has a null ``domain``."""
    return domains.alias("d").join(
        scraped.alias("s"), F.col("d.referring_domain") == F.col("s.domain"), "left"
    ).select(
        "s.domain", "d.domain_rating", "d.organic_traffic", "s.live_backlinks", "s.total_backlinks",
        "d.first_seen", "d.last_updated", "s.last_successful_scrape_date", "s.links",
        "s.links_known_domains", "s.links_main_domains",
    )


def build_edges(pages: DataFrame, link_type: str = "all_known_domains") -> DataFrame:
    """Distinct directed edges (src, dst) without self-loops from one of the link columns."""
    if link_type not in LINK_COLUMNS:
        raise ValueError(f"link_type must be one of {sorted(LINK_COLUMNS)}")
    return (
        pages.select(F.col("domain").alias("src"), F.explode(LINK_COLUMNS[link_type]).alias("dst"))
        .where("src <> dst")
        .distinct()
    )


def edge_nodes(edges: DataFrame) -> DataFrame:
    """All end points of the edges."""
    ends = F.explode(F.array("src", "dst"))
    return edges.select(ends.alias("domain")).distinct()


def remove_nodes(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph without the domains in ``names(domain)`` and their edges; unknown names are ignored."""
    gone = names.select("domain").distinct()
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(gone.withColumnRenamed("domain", end), end, "left_anti")
    return nodes.join(gone, "domain", "left_anti"), kept.select("src", "dst")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, all_links, in_links, out_links); a mutual pair counts twice at both ends."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("domain"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("domain"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    )
    counted = ends.groupBy(F.col("e.domain").alias("domain")).agg(
        F.count("*").alias("all_links"), F.sum("e.i").alias("in_links"), F.sum("e.o").alias("out_links")
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("all_links", "in_links", "out_links")}
    return nodes.join(counted, "domain", "left").withColumns(zero)


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, root): the smallest member of each node's weakly connected component.

    Names become their 64-bit hashes, so the rounds aggregate longs by hash and never move or sort a
    name; names come back once at the end. Should two names share a hash, numbers in name order take
    the hashes' place. Nodes that are longs already stay as they are.
    """
    if nodes.schema["domain"].dataType.simpleString() == "bigint":
        found = _contract(edges.select("src", "dst"))
        return nodes.join(found.withColumnRenamed("x", "domain"), "domain", "left").withColumn(
            "root", F.coalesce("root", "domain")
        )
    names = materialize(nodes.select("domain").distinct().withColumn("id", F.xxhash64("domain")))
    if names.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        pairs = edges.select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))
    else:
        names = materialize(numbered(names.select("domain"), ["domain"], "id"))
        pairs = _as_numbers(edges, names)
    roots = _contract(pairs)
    by_id = materialize(
        names.join(roots.withColumnRenamed("x", "id"), "id", "left").select("domain", F.coalesce("root", "id").alias("_root"))
    )
    least = by_id.groupBy("_root").agg(F.min("domain").alias("root"))
    return nodes.join(by_id.join(least, "_root").select("domain", "root"), "domain")


def _as_numbers(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges (src, dst) with numbers for names."""
    out = edges.select("src", "dst")
    for end in ("src", "dst"):
        here = names.select(F.col("domain").alias(end), F.col("id").alias(f"_{end}"))
        out = out.join(here, end)
    return out.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))


def _contract(edges: DataFrame) -> DataFrame:
    """(x, root) for every number with a neighbour: the smallest number of its component.

    Rounds of hooking and contraction: every node points at its smallest neighbour if that is
    smaller, pointers are doubled until they end at roots, and the roots become the nodes of the
    next, smaller graph. A root that nothing points at has a smaller neighbour in the next round, so
    two rounds at least halve the nodes. The minimum is combined on the map side and the pointer
    table has one row per node, so a hub never has its neighbours gathered; only counts reach the
    driver.
    """
    pairs = materialize(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .where("u <> v")
        .distinct()
    )
    rounds = []
    while True:
        pointers = _point(pairs)
        rounds.append(pointers)
        of_u = pointers.select(F.col("x").alias("u"), F.col("root").alias("_u"))
        of_v = pointers.select(F.col("x").alias("v"), F.col("root").alias("_v"))
        watch, before = Observation(), pairs
        pairs = materialize(
            pairs.join(of_u, "u").join(of_v, "v").where("_u <> _v")
            .select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v"))
            .distinct()
            .observe(watch, F.count("*").alias("n"))
        )
        discard(before)
        if not watch.get["n"]:
            break
    # a root of one round is a node of the next, as long as it has neighbours there
    roots = rounds.pop()
    while rounds:
        later = roots.select(F.col("x").alias("root"), F.col("root").alias("_root"))
        roots = rounds.pop().join(later, "root", "left").select(
            "x", F.coalesce("_root", "root").alias("root")
        )
    return roots


def _point(pairs: DataFrame) -> DataFrame:
    """(x, root) of one round: the end of each node's chain of smaller neighbours."""
    ends = F.explode(F.array(
        F.struct(F.col("u").alias("x"), F.col("v").alias("y")),
        F.struct(F.col("v").alias("x"), F.col("u").alias("y")),
    ))
    pointers = materialize(
        pairs.select(ends.alias("e")).groupBy(F.col("e.x").alias("x"))
        .agg(F.least(F.min("e.y"), F.first("e.x")).alias("root"))
    )
    before = pointers
    while True:
        for _ in range(2):
            ahead = pointers.select(F.col("x").alias("root"), F.col("root").alias("_next"))
            pointers = pointers.join(ahead, "root").select(
                "x", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")
            )
        watch = Observation()
        after = materialize(pointers.observe(watch, F.count_if("_moved").alias("moved")))
        discard(before)
        before, pointers = after, after.drop("_moved")
        if not watch.get["moved"]:
            return pointers


def members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, root, all_links, in_links, out_links), stored: what a removal is computed from."""
    return materialize(connected(nodes, edges).join(degrees(nodes, edges), "domain"))


def members_without(known: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` and edges after the domains in ``names(domain)`` are removed; unknown names are ignored.

    Only components that held a removed domain are looked at: their other members are connected
    again over their remaining edges, and lose the links that went. All others keep their root and
    degrees; no edge of theirs is read again, but for the test of its source's component.
    """
    gone = names.select("domain").distinct()
    touched = materialize(known.join(gone, "domain", "left_semi").select("root").distinct())
    inside = materialize(known.join(touched, "root", "left_semi").join(gone, "domain", "left_anti").select("domain"))
    kept_nodes, kept_edges = remove_nodes(inside, edges.join(inside.withColumnRenamed("domain", "src"), "src", "left_semi"), gone)
    again = members(kept_nodes, materialize(kept_edges))
    others = known.join(touched, "root", "left_anti").select(*again.columns)
    return materialize(others.unionByName(again)), remove_nodes(inside, edges, gone)[1]


def number_components(known: DataFrame) -> DataFrame:
    """(root, component): components numbered from 0 by size, ties by smallest member."""
    sizes = known.groupBy("root").agg((-F.count("*")).alias("minus_size"))
    return numbered(sizes, ["minus_size", "root"], "component").select("root", "component")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, component): weak components numbered from 0 by size, ties by smallest member."""
    found = materialize(connected(nodes, edges))
    return found.join(number_components(found), "root").select("domain", "component")


def domain_info(nodes: DataFrame, edges: DataFrame, domains: DataFrame) -> DataFrame:
    """Per node: component, links, rating and traffic; sort by ``all_links`` descending to read."""
    return members_info(members(nodes, edges), domains)


def members_info(known: DataFrame, domains: DataFrame) -> DataFrame:
    """``domain_info`` of stored ``members``."""
    attributes = domains.where("domain IS NOT NULL").select(
        "domain", "domain_rating", "organic_traffic"
    )
    return known.join(number_components(known), "root").join(attributes, "domain", "left").select(
        "domain", "component", "all_links", "in_links", "out_links", "domain_rating", "organic_traffic",
    )


def _component_report(info: DataFrame, *measures: Column) -> DataFrame:
    """One aggregation per component; every edge is counted once, at its source node."""
    centroid = F.min_by(
        F.struct("domain", "all_links"), F.struct(-F.col("all_links"), F.col("domain"))
    )
    grouped = info.groupBy("component").agg(
        F.count("*").alias("size"), F.sum("out_links").alias("links"), centroid.alias("best"), *measures
    )
    return grouped.select(
        "component",
        "size",
        "links",
        (F.col("links") / F.col("size")).alias("density"),
        (F.col("links") == F.col("best.all_links")).alias("star"),
        F.col("best.domain").alias("centroid"),
        F.col("best.all_links").alias("centroid_links"),
        *grouped.columns[4:],
    )


def component_stats(info: DataFrame) -> DataFrame:
    """Per component: size, links, density, star, centroid and its links."""
    return _component_report(info)


def component_info(info: DataFrame) -> DataFrame:
    """``component_stats`` with mean and maximum of rating and traffic, in the same aggregation."""
    return _component_report(info, *[
        pick(c).alias(f"{name}_{c}")
        for name, pick in (("mean", F.avg), ("max", F.max))
        for c in ("domain_rating", "organic_traffic")
    ])


def component(info: DataFrame, number: int) -> DataFrame:
    """Rows of one component."""
    return info.where(F.col("component") == number)


def component_of(info: DataFrame, domains: Sequence[str]) -> DataFrame:
    """All rows of the components that hold any of the given domains; unknown domains give none."""
    wanted = info.where(F.col("domain").isin(list(domains))).select("component").distinct()
    return info.join(wanted, "component", "left_semi")


def component_subgraph(
    members: DataFrame, edges: DataFrame, number: int
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one component, for plotting elsewhere."""
    nodes = component(members, number).select("domain")
    inside = edges.join(nodes.withColumnRenamed("domain", "src"), "src", "left_semi")
    return nodes, inside.select("src", "dst")

"""Cluster reports and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webweave.operators.ordered import group_medians


def real_clusters(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of real clusters.

    ``strict`` drops every label with a hyphen, which also loses languages such as ``zh-cn``;
    otherwise only noise (``…-1``) and failed languages go.
    """
    if strict:
        return df.where(~F.col("cluster").like("%-%"))
    noise = F.col("cluster") == F.concat("lang", F.lit("-1"))
    failed = F.col("cluster") == F.concat("lang", F.lit("-clustering-failed"))
    return df.where(F.col("cluster").isNotNull() & ~noise & ~failed)


def cluster_domains(
    clusters: DataFrame, scraped: DataFrame, domains: DataFrame, strict: bool = False
) -> DataFrame:
    """Domains of real clusters with their crawl and export measures."""
    return (
        real_clusters(clusters, strict).alias("c")
        .join(scraped.alias("s"), F.col("c.domain") == F.col("s.domain"), "left")
        .join(domains.alias("d"), F.col("c.domain") == F.col("d.referring_domain"), "left")
        .select(
            "c.*", "s.last_successful_scrape_date", "s.live_backlinks", "s.total_backlinks",
            "d.domain_rating", "d.organic_traffic", "d.first_seen", "d.last_updated",
        )
    )


def cluster_backlinks(
    clusters: DataFrame, matches: DataFrame, backlinks: DataFrame, strict: bool = False
) -> DataFrame:
    """Backlinks of real clusters; a cluster domain without backlinks keeps one row of nulls.

    Written as inner join plus the rows without a partner: a host that holds a large share of the
    backlinks can then be split, which a left outer join would not allow on its right side.
    """
    hosts = (
        real_clusters(clusters, strict).alias("c")
        .join(matches.alias("m"), F.col("c.domain") == F.col("m.matching_domain"), "left")
        .select("c.cluster", "m.url_main")
    )
    fields = [c for c in backlinks.columns if c != "url_main"]
    found = hosts.join(backlinks, "url_main").select("cluster", "url_main", *fields)
    linked = backlinks.select("url_main").where("url_main IS NOT NULL").distinct()
    empty = hosts.join(linked, "url_main", "left_anti").select(
        "cluster", F.lit(None).cast("string").alias("url_main")
    )
    return found.unionByName(empty, allowMissingColumns=True)


def new_threshold(df: DataFrame, mode: str = "min") -> DataFrame:
    """One row ``threshold``: the earliest update, or with ``mode="last_upload"`` the latest."""
    if mode not in ("min", "last_upload"):
        raise ValueError("mode must be 'min' or 'last_upload'")
    pick = F.min if mode == "min" else F.max
    return df.agg(pick("last_updated").alias("threshold"))


def flag_new(df: DataFrame, threshold: datetime | str | DataFrame) -> DataFrame:
    """Add ``new``: updated at or after the threshold, a value or a ``new_threshold`` row."""
    if isinstance(threshold, DataFrame):
        since = threshold.select("threshold").scalar()
    else:
        since = F.lit(threshold).cast("timestamp")
    return df.withColumn("new", F.coalesce(F.col("last_updated") >= since, F.lit(False)))


def cluster_info(members: DataFrame) -> DataFrame:
    """One row per cluster from ``cluster_domains`` rows with ``new``.

    Columns named ``mean_…`` are medians. Sums of nothing are 0.
    """
    medians = group_medians(
        members, "cluster",
        ["mean_distance", "live_backlinks", "total_backlinks", "domain_rating", "organic_traffic"],
    ).withColumnsRenamed({
        "live_backlinks": "mean_live_backlinks",
        "total_backlinks": "mean_backlinks",
        "domain_rating": "mean_domain_rating",
        "organic_traffic": "mean_organic_traffic",
    })

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    sums = members.where("cluster IS NOT NULL").groupBy("cluster").agg(
        F.count("*").alias("num_domains"),
        F.count_if("new").alias("num_new_domains"),
        total("live_backlinks").alias("total_live_backlinks"),
        total("total_backlinks").alias("total_backlinks"),
        total("organic_traffic").alias("total_organic_traffic"),
        F.max("live_backlinks").alias("max_live_backlinks"),
        F.max("total_backlinks").alias("max_backlinks"),
        F.max("domain_rating").alias("max_domain_rating"),
        F.max("organic_traffic").alias("max_organic_traffic"),
    )
    return sums.join(medians, "cluster", "left").select(
        "cluster", F.substring("cluster", 1, 2).alias("language"), "num_domains", "num_new_domains",
        "total_live_backlinks", "total_backlinks", "total_organic_traffic", "mean_distance",
        "mean_live_backlinks", "mean_backlinks", "mean_domain_rating", "mean_organic_traffic",
        "max_live_backlinks", "max_backlinks", "max_domain_rating", "max_organic_traffic",
    )


def in_report_order(info: DataFrame, order_by: Sequence | None = None) -> DataFrame:
    """Clusters by language, then size descending, then mean distance, then name."""
    order = order_by or [
        F.asc("language"), F.desc("num_domains"), F.asc_nulls_last("mean_distance"), F.asc("cluster")
    ]
    return info.orderBy(*order)


def get_cluster(df: DataFrame, cluster: str) -> DataFrame:
    """Rows (domains or backlinks) of one cluster."""
    return df.where(F.col("cluster") == cluster)


def cluster_of(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """All rows of the clusters that hold any of the given values of ``column``."""
    wanted = df.where(F.col(column).isin(list(values))).select("cluster").distinct()
    return df.join(wanted, "cluster", "left_semi")


def cluster_of_domain(df: DataFrame, domain: str) -> DataFrame:
    return cluster_of(df, "domain", [domain])


def cluster_of_url(df: DataFrame, url: str) -> DataFrame:
    return cluster_of(df, "referring_page_url", [url])

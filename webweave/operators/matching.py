"""Longest-suffix matching of hosts to known domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webweave.functions.urls import host_suffixes, split_url

MISSING_HOST = "missing host"


def match_domain(hosts: DataFrame, domains: DataFrame, host: str, domain: str) -> DataFrame:
    """(host, matching_domain, match_error) for each distinct host, null host included.

    The theta-join "domain is a suffix of host" becomes an equi-join on exploded suffixes; the
    longest hit wins. Hosts are made distinct first, so the join sees each host once however many
    rows it has. The known side is unique, so a suffix shared by very many hosts is a skewed key on
    the left side only, which adaptive execution can split.
    """
    known = domains.select(F.col(domain).alias("suffix")).where("suffix IS NOT NULL").distinct()
    distinct = hosts.select(F.col(host).alias(host)).distinct()
    suffixes = host_suffixes(F.col(host))
    tried = distinct.select(host, F.posexplode(suffixes).alias("pos", "suffix"))
    longest = tried.join(known, "suffix").groupBy(host).agg(F.min("pos").alias("pos"))
    return distinct.join(longest, host, "left").select(
        host, F.when(F.col("pos").isNotNull(), F.get(suffixes, F.col("pos"))).alias("matching_domain"),
        F.when(F.col(host).isNull(), F.lit(MISSING_HOST)).alias("match_error"),
    )


def build_domain_matches(backlinks: DataFrame, domains: DataFrame) -> DataFrame:
    """Match table of all referring hosts; its key is the host, so a null host has no row.

    Stored backlinks carry their host, which is then the only column read. Hosts are made distinct
    on the map side; making the much longer URLs distinct first would only shuffle them.
    """
    return match_domain(
        backlinks.select(stored_host(backlinks).alias("url_main")).where("url_main IS NOT NULL"),
        domains,
        "url_main",
        "referring_domain",
    )


def stored_host(backlinks: DataFrame) -> Column:
    """The host column of stored backlinks, or the host taken from the referring URL."""
    if "url_main" in backlinks.columns:
        return F.col("url_main")
    return split_url(F.col("referring_page_url"))["host"]

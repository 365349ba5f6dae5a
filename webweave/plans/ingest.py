"""Ingest of crawler exports: clean, upsert, match hosts, refresh the crawl queue."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webweave.functions import columns as C
from webweave.functions.urls import clean_link, host_suffixes, split_url
from webweave.operators.crawl import COUNTERS, build_crawl_queue, domain_counters, host_counters
from webweave.operators.keys import latest_rows, upsert, without_key
from webweave.operators.matching import build_domain_matches, match_domain
from webweave.schemas import (
    BACKLINK_KEYS, BACKLINKS, DOMAIN_KEYS, DOMAINS, SCRAPED_DOMAINS, SCRAPED_KEYS, URL_MATCH_KEYS, URL_MATCHES,
)
from webweave.session import materialize
from webweave.sources.store import buckets_of, read_manifest, read_stored, replace_table, upsert_table

TABLE_KEYS = {
    "backlinks": BACKLINK_KEYS, "domains": DOMAIN_KEYS, "url_matches": URL_MATCH_KEYS,
    "scraped": SCRAPED_KEYS,
}

BACKLINK_TIMES = ["first_seen", "last_check", "day_lost"]
DOMAIN_TIMES = ["first_seen"]
# of several export rows with one key the last by these counts
BACKLINK_ORDER = ["last_check", "link_anchor"]
DOMAIN_ORDER = ["first_seen"]


@dataclass
class State:
    """The stored tables of the ingest and crawl.

    ``rejected_backlinks`` and ``rejected_domains`` are the cleaned rows of the last upload that have
    no key, for instance because their first_seen is no time. ``rejected_times`` counts, per table and
    column, its texts that are no times.
    """

    backlinks: DataFrame
    domains: DataFrame
    url_matches: DataFrame
    scraped: DataFrame
    rejected_backlinks: DataFrame | None = None
    rejected_domains: DataFrame | None = None
    rejected_times: DataFrame | None = None


def _named(export: DataFrame) -> DataFrame:
    named = C.normalize_columns(export).drop("#")
    texts = [f.name for f in named.schema if f.dataType.simpleString() == "string"]
    return C.empty_to_null(named, texts)


def clean_backlinks(
    export: DataFrame,
    load_time: datetime | str,
    link_rules: Sequence[tuple[str, Column]] = (),
    escape_links: bool = False,
) -> DataFrame:
    """Backlink rows ready to be stored, from an export as read.

    ``escape_links`` doubles backslashes for stores that un-escape on load; the default keeps URLs
    as they are.
    """
    rows = C.parse_ts(_named(export), BACKLINK_TIMES)
    if escape_links:
        rows = rows.withColumns({c: clean_link(F.col(c)) for c in ("referring_page_url", "link_url")})
    rows = rows.withColumns({
        "live": F.isnull("backlink_status"),
        "link_type": C.link_type(F.col("link_anchor"), link_rules),
        "url_main": split_url(F.col("referring_page_url"))["host"],
    })
    return C.with_load_time(rows, load_time)


def clean_domains(export: DataFrame, load_time: datetime | str) -> DataFrame:
    """Domain rows ready to be stored, from an export as read."""
    rows = C.parse_ts(_named(export), DOMAIN_TIMES)
    numbers = {"domain_rating": "double", "organic_traffic": "bigint"}
    rows = rows.withColumns({
        c: F.expr(f"try_cast({c} AS {kind})") for c, kind in numbers.items() if c in rows.columns
    })
    return C.with_load_time(rows, load_time)


def ingest(
    backlinks_export: DataFrame,
    domains_export: DataFrame,
    state: State,
    load_time: datetime | str,
    types: Sequence[str] | None = None,
    link_rules: Sequence[tuple[str, Column]] = (),
    escape_links: bool = False,
    store: Callable[[str, DataFrame], DataFrame] = lambda name, df: df,
) -> State:
    """State after an upload.

    ``types`` limits the crawl queue to backlinks of these link types; None takes all. Each table
    goes through ``store(name, table)`` as soon as it is known and the next ones are computed from
    what that returns, so with ``stored_in`` nothing is computed twice. The default stores nothing.

    Export columns that the state lacks are added to it. Of export rows with one key the last counts,
    so a repeated upload changes nothing; rows without a key are returned as rejected.
    """
    links = clean_backlinks(backlinks_export, load_time, link_rules, escape_links)
    last = latest_rows(links, BACKLINK_KEYS, BACKLINK_ORDER)
    backlinks = store("backlinks", upsert(state.backlinks, last, BACKLINK_KEYS, "all", add_columns=True))
    rows = clean_domains(domains_export, load_time)
    last = latest_rows(rows, DOMAIN_KEYS, DOMAIN_ORDER)
    domains = store("domains", upsert(state.domains, last, DOMAIN_KEYS, "all", add_columns=True))
    matches = store("url_matches", build_domain_matches(backlinks, domains))
    scraped = store("scraped", build_crawl_queue(state.scraped, backlinks, matches, types))
    return State(
        backlinks, domains, matches, scraped, without_key(links, BACKLINK_KEYS), without_key(rows, DOMAIN_KEYS),
        rejected_times(backlinks_export, domains_export),
    )


def rejected_times(backlinks_export: DataFrame, domains_export: DataFrame) -> DataFrame:
    """(table, column, n): how many texts of an upload's time columns are no times."""
    counts = []
    for name, export, columns in (
        ("backlinks", backlinks_export, BACKLINK_TIMES), ("domains", domains_export, DOMAIN_TIMES),
    ):
        one = C.rejected_ts(_named(export), columns)
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns]))
        counts.append(one.select(F.lit(name).alias("table"), pairs.alias("p")).select("table", "p.*"))
    return counts[0].unionByName(counts[1])


def stored_in(folder: str) -> Callable[[str, DataFrame], DataFrame]:
    """A ``store`` that replaces the tables of a folder, each with its key checked."""
    return lambda name, df: replace_table(df, f"{folder.rstrip('/')}/{name}", TABLE_KEYS[name])


# --- uploads into a stored state ----------------------------------------------------------------

#: The stored tables of a folder: schema, key and the columns that rows are dealt to buckets by. ``hosts``
#: holds the counters of each referring host, which is all that the queue needs of the backlinks.
_HOSTS = "url_main string, total_backlinks long, live_backlinks long, url_www long, url_https long, first_seen timestamp"
STORED = {
    "backlinks": (BACKLINKS, BACKLINK_KEYS, ["url_main"]),
    "hosts": (_HOSTS, URL_MATCH_KEYS, ["url_main"]),
    "domains": (DOMAINS, DOMAIN_KEYS, DOMAIN_KEYS),
    "url_matches": (URL_MATCHES, URL_MATCH_KEYS, URL_MATCH_KEYS),
    "scraped": (SCRAPED_DOMAINS, SCRAPED_KEYS, SCRAPED_KEYS),
}


def create_state(spark: SparkSession, folder: str) -> None:
    """Empty stored tables in ``folder``, where there are none yet."""
    for name, (schema, keys, by) in STORED.items():
        if read_manifest(f"{folder}/{name}") is None:
            replace_table(spark.createDataFrame([], schema), f"{folder}/{name}", keys, by)


def stored_state(spark: SparkSession, folder: str) -> State:
    """The state as it is stored."""
    return State(*[read_stored(spark, f"{folder}/{t}") for t in ("backlinks", "domains", "url_matches", "scraped")])


def ingest_into(
    folder: str,
    backlinks_export: DataFrame,
    domains_export: DataFrame,
    load_time: datetime | str,
    types: Sequence[str] | None = None,
    link_rules: Sequence[tuple[str, Column]] = (),
    escape_links: bool = False,
) -> State:
    """``ingest`` into the stored tables of ``folder``, with work that follows the upload.

    Backlinks are stored by referring host. Only the buckets of the upload's hosts are read and
    written; their hosts' counters are summed anew. Only hosts that are new, or that end in a domain
    that is new, are matched, and only the domains that any of these hosts belonged or belongs to have
    their counters added up from the hosts' ones. The other backlinks are never read.
    """
    spark = backlinks_export.sparkSession
    create_state(spark, folder)
    at = {name: f"{folder}/{name}" for name in STORED}
    links = clean_backlinks(backlinks_export, load_time, link_rules, escape_links)
    last = materialize(latest_rows(links, BACKLINK_KEYS, BACKLINK_ORDER))
    rows = clean_domains(domains_export, load_time)
    last_domains = materialize(latest_rows(rows, DOMAIN_KEYS, DOMAIN_ORDER))

    seen = materialize(last.select("url_main").where("url_main IS NOT NULL").distinct())
    upsert_table(last, at["backlinks"], "all", add_columns=True)
    stored = read_stored(spark, at["backlinks"], buckets_of(seen, at["backlinks"]))
    mine = stored.join(seen, "url_main", "left_semi")
    sums = seen.join(host_counters(mine, types), "url_main", "left").withColumns(
        {c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTERS}
    )
    upsert_table(materialize(sums), at["hosts"], "all")

    new_domains = materialize(
        last_domains.join(read_stored(spark, at["domains"]), "referring_domain", "left_anti").select("referring_domain")
    )
    domains = upsert_table(last_domains, at["domains"], "all", add_columns=True)
    matches = read_stored(spark, at["url_matches"])
    hosts = read_stored(spark, at["hosts"])
    ends = hosts.select("url_main", F.explode(host_suffixes(F.col("url_main"))).alias("referring_domain"))
    under = ends.join(new_domains, "referring_domain", "left_semi").select("url_main")
    unmatched = materialize(seen.join(matches, "url_main", "left_anti").union(under).distinct())
    found = materialize(match_domain(unmatched, domains, "url_main", "referring_domain"))
    changed = seen.union(unmatched).distinct()
    left = matches.join(changed, "url_main", "left_semi").select("matching_domain")
    upsert_table(found, at["url_matches"], "all")
    matches = read_stored(spark, at["url_matches"])
    now = matches.join(changed, "url_main", "left_semi").select("matching_domain")
    touched = materialize(left.union(now).where("matching_domain IS NOT NULL").distinct())
    mine = matches.join(touched, "matching_domain", "left_semi")
    counters = domain_counters(hosts.where("total_backlinks > 0"), mine)
    upsert_table(materialize(counters), at["scraped"], COUNTERS)
    state = stored_state(spark, folder)
    state.rejected_backlinks, state.rejected_domains = without_key(links, BACKLINK_KEYS), without_key(rows, DOMAIN_KEYS)
    state.rejected_times = rejected_times(backlinks_export, domains_export)
    return state

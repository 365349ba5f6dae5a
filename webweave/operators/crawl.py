"""The crawl queue and crawl results as data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webweave.functions import urls
from webweave.functions.html import extract_page
from webweave.operators.keys import upsert
from webweave.operators.matching import match_domain, stored_host

# Texts and conditions of the crawl.
NEVER_SCRAPED = "last_scrape_date IS NULL"
NOT_UTF8 = "Scraped nonutf8 characters failed pg upload."
COUNTERS = ["total_backlinks", "live_backlinks", "url_www", "url_https"]
OUTCOME = [
    "last_scrape_code", "last_scrape_date", "last_scrape_parse_error", "last_scrape_request_error",
]
CONTENT = ["lang", "html", "main", "links", "links_main_domains", "links_known_domains"]


def host_counters(backlinks: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Per referring host: backlink counts, live ones, www and https ones, first sight."""
    if types is not None:
        backlinks = backlinks.where(F.col("link_type").isin(list(types)))
    parts = urls.split_url(F.col("referring_page_url"))
    return (
        backlinks.select(
            stored_host(backlinks).alias("url_main"),
            F.isnull("backlink_status").cast("long").alias("live"),
            F.coalesce(parts["www"] == urls.WWW, F.lit(False)).cast("long").alias("www"),
            F.coalesce(parts["scheme"] == urls.HTTPS, F.lit(False)).cast("long").alias("https"),
            "first_seen",
        )
        .where("url_main IS NOT NULL")
        .groupBy("url_main")
        .agg(
            F.count("*").alias("total_backlinks"),
            F.sum("live").alias("live_backlinks"),
            F.sum("www").alias("url_www"),
            F.sum("https").alias("url_https"),
            F.min("first_seen").alias("first_seen"),
        )
    )


def domain_counters(hosts: DataFrame, matches: DataFrame) -> DataFrame:
    """The counters of hosts added up per matched domain."""
    known = matches.where("matching_domain IS NOT NULL").select(
        "url_main", F.col("matching_domain").alias("domain")
    )
    return hosts.join(known, "url_main").groupBy("domain").agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.min("first_seen").alias("first_seen")
    )


def crawl_counters(
    backlinks: DataFrame, matches: DataFrame, types: Sequence[str] | None = None
) -> DataFrame:
    """Per matched domain: backlink counts, live ones, www and https ones, first sight.

    Rows are summed per host before the join with the matches, so a host with very many backlinks
    is reduced on the map side and never becomes a skewed join key.
    """
    return domain_counters(host_counters(backlinks, types), matches)


def build_crawl_queue(
    scraped: DataFrame, backlinks: DataFrame, matches: DataFrame, types: Sequence[str] | None = None
) -> DataFrame:
    """Queue after new backlinks: known domains refresh the counters only, new ones are added."""
    return upsert(scraped, crawl_counters(backlinks, matches, types), ["domain"], COUNTERS)


def crawl_queue(scraped: DataFrame, condition: str = NEVER_SCRAPED) -> DataFrame:
    """Domains that the caller's SQL condition selects for crawling."""
    return scraped.where(F.expr(condition))


def next_batch(queue: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest domains of the queue."""
    return queue.orderBy(F.desc("first_seen"), "domain").limit(n)


def remaining(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Queue without the domains that are done."""
    return queue.join(done.select("domain"), "domain", "left_anti")


def candidates(queue: DataFrame) -> DataFrame:
    """(domain, pos, url): the URLs to try for each domain, in order."""
    tried = urls.candidate_urls(
        F.col("domain"), F.col("url_https"), F.col("url_www"), F.col("total_backlinks")
    )
    return queue.select("domain", F.posexplode(tried).alias("pos", "url"))


def pick_response(tried: DataFrame, responses: DataFrame, mode: str = "last") -> DataFrame:
    """One row per domain: code and error of the last attempt, body of the chosen response.

    ``responses`` holds captured fetches (url, status_code, request_error, html, fetched_at).
    ``mode="last"`` takes the last attempt that did not fail, ``"first_ok"`` the first with code
    200; ``url`` and ``html`` are null unless that response has code 200. The choice is made on the
    small columns, so only chosen bodies are joined in. Captures are a log: of several of one URL
    the latest counts, and of those at one time the one with the largest code and error.
    """
    if mode not in ("last", "first_ok"):
        raise ValueError("mode must be 'last' or 'first_ok'")
    latest = responses.groupBy("url").agg(
        F.max(F.struct("fetched_at", "status_code", "request_error")).alias("_last")
    ).select("url", "_last.*")
    attempts = tried.join(latest, "url")
    answered = F.col("request_error").isNull()
    if mode == "first_ok":
        answered = answered & (F.col("status_code") == 200)
        choose = F.min_by
    else:
        choose = F.max_by
    outcome = attempts.groupBy("domain").agg(
        F.max_by("status_code", "pos").alias("last_scrape_code"),
        F.max_by("request_error", "pos").alias("last_scrape_request_error"),
        F.max_by("fetched_at", "pos").alias("last_scrape_date"),
        choose(
            F.when(F.col("status_code") == 200, F.col("url")), F.when(answered, F.col("pos"))
        ).alias("url"),
    )
    chosen = outcome.where("url IS NOT NULL").select("url").distinct()
    bodies = (
        responses.select("url", "fetched_at", "status_code", "request_error", "html").join(chosen, "url", "left_semi")
        .groupBy("url").agg(F.max_by("html", F.struct("fetched_at", "status_code", "request_error", "html")).alias("html"))
    )
    return outcome.join(bodies, "url", "left")


def own_links_removed(hrefs: Column, domain: Column) -> Column:
    """Links without those that hold the page's own domain anywhere in their text."""
    return F.filter(hrefs, lambda href: ~F.contains(href, domain))


def main_hosts(links: Column) -> Column:
    """Sorted distinct hosts of links; an unparsable link contributes nothing."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(links, urls.url_main))))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Add title, main, links, links_main_domains and parse_error to (domain, html, …) rows."""
    return (
        pages.withColumn("_page", extract_page(F.col("html").cast("binary")))
        .withColumns(
            {
                "title": F.col("_page.title"),
                "main": F.col("_page.main"),
                "links": own_links_removed(F.col("_page.hrefs"), F.col("domain")),
                "parse_error": F.col("_page.error"),
            }
        )
        .withColumn("links_main_domains", main_hosts(F.col("links")))
        .drop("_page")
    )


def known_links(pages: DataFrame, domains: DataFrame, key: str = "domain") -> DataFrame:
    """(key, links_known_domains): known domains that a page links to, sorted and distinct.

    Distinct hosts are matched once, then joined back to the (page, host) rows. A host that very
    many pages link to is a skewed key on the page side only; the match side is unique.
    """
    pairs = pages.select(key, F.explode_outer("links_main_domains").alias("host"))
    matches = match_domain(
        pairs.select("host").where("host IS NOT NULL"), domains, "host", "referring_domain"
    )
    return (
        pairs.join(matches, "host", "left")
        .groupBy(key)
        .agg(F.sort_array(F.collect_set("matching_domain")).alias("links_known_domains"))
    )


def utf8_guard(results: DataFrame) -> DataFrame:
    """Turn rows whose text is not valid UTF-8 into failures without content."""
    texts = [c for c in ("html", "main") if c in results.columns]
    bad = F.lit(False)
    for c in texts:
        bad = bad | ~F.coalesce(F.is_valid_utf8(F.col(c).cast("string")), F.lit(True))
    guarded = results.withColumn("_bad", bad)
    columns = {
        c: F.when(~F.col("_bad"), F.col(c)) for c in CONTENT if c in results.columns
    }
    columns["last_scrape_parse_error"] = F.when(F.col("_bad"), F.lit(NOT_UTF8)).otherwise(
        F.col("last_scrape_parse_error")
    )
    if "last_successful_scrape_date" in results.columns:
        columns["last_successful_scrape_date"] = F.when(
            ~F.col("_bad"), F.col("last_successful_scrape_date")
        )
    return guarded.withColumns(columns).drop("_bad")


def split_outcome(scraped: DataFrame) -> DataFrame:
    """Add ``success``: the last crawl is also the last successful one."""
    return scraped.withColumn(
        "success",
        F.coalesce(F.col("last_scrape_date") == F.col("last_successful_scrape_date"), F.lit(False)),
    )


def apply_scrape(scraped: DataFrame, results: DataFrame) -> DataFrame:
    """Crawl table after results: successes refresh all result columns, failures the outcome only.

    Both updates are one outer join; results for unknown domains are added.
    """
    new = split_outcome(results).alias("r")
    success = F.coalesce(F.col("r.success"), F.lit(False))
    arrived = F.col("r.domain").isNotNull()
    columns = []
    for c in scraped.columns:
        before, after = F.col(f"s.{c}"), F.col(f"r.{c}") if c in results.columns else None
        if c == "domain":
            value = F.coalesce(before, after)
        elif after is None:
            value = before
        elif c in OUTCOME:
            value = F.when(arrived, after).otherwise(before)
        else:
            value = F.when(success, after).otherwise(before)
        columns.append(value.cast(scraped.schema[c].dataType).alias(c))
    same = F.col("s.domain") == F.col("r.domain")
    return scraped.alias("s").join(new, same, "full_outer").select(*columns)

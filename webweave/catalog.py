"""All queries by name, each with the SQL that gives the same rows where SQL can.

Every query reads the given tables in full, or views that are derived from them in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweave.fixtures import table, view, with_views
from webweave.functions import columns as C
from webweave.functions import urls as U
from webweave.operators import crawl, density, graph, language, matching, reports, text
from webweave.operators.keys import check_keys, upsert
from webweave.plans.crawl import crawl as run_crawl
from webweave.plans.ingest import State, ingest, ingest_into
from webweave.plans.ingest import rejected_times as ingest_times
from webweave.plans.recluster import recluster as run_recluster
from webweave.plans.reports import ClusterReport, NetworkReport
from webweave.schemas import BACKLINKS, DOMAINS, SCRAPED_DOMAINS, URL_MATCHES
from webweave.session import checkpoint_dir, materialize
from webweave.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LOAD_TIME = "2024-06-01 00:00:00"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return function

    return register


# --- sources, keys, upserts -------------------------------------------------------------------


@query(
    "sql_adhoc",
    "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang",
)
def sql_adhoc(spark: SparkSession, sf: str) -> DataFrame:
    return tables.sql(
        spark,
        "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM {docs} GROUP BY lang",
        docs=table(spark, sf, "documents"),
    )


def _label_updates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    updates = table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") % 2).cast("int").alias("quality")
    )
    return table(spark, sf, "labels"), updates


_UPSERT = """
    SELECT coalesce(t.doc_id, u.doc_id) AS doc_id, {quality} AS quality, t.toxic AS toxic
    FROM labels t FULL JOIN (SELECT doc_id, (n_chars % 2)::INT AS quality FROM documents) u
      ON t.doc_id = u.doc_id"""


@query("upsert_all", _UPSERT.format(quality="CASE WHEN u.doc_id IS NULL THEN t.quality ELSE u.quality END"))
def upsert_all(spark: SparkSession, sf: str) -> DataFrame:
    return upsert(*_label_updates(spark, sf), ["doc_id"], "all")


@query(
    "upsert_cols",
    """SELECT coalesce(t.doc_id, u.doc_id) AS doc_id,
              CASE WHEN u.doc_id IS NULL THEN t.quality ELSE u.quality END AS quality,
              CASE WHEN t.doc_id IS NULL THEN u.toxic ELSE t.toxic END AS toxic
       FROM labels t FULL JOIN (SELECT doc_id, (n_chars % 2)::INT AS quality,
                                       (n_chars % 3)::INT AS toxic FROM documents) u
         ON t.doc_id = u.doc_id""",
)
def upsert_cols(spark: SparkSession, sf: str) -> DataFrame:
    updates = table(spark, sf, "documents").select(
        "doc_id",
        (F.col("n_chars") % 2).cast("int").alias("quality"),
        (F.col("n_chars") % 3).cast("int").alias("toxic"),
    )
    return upsert(table(spark, sf, "labels"), updates, ["doc_id"], ["quality"])


@query("upsert_insert_only", _UPSERT.format(quality="CASE WHEN t.doc_id IS NULL THEN u.quality ELSE t.quality END"))
def upsert_insert_only(spark: SparkSession, sf: str) -> DataFrame:
    return upsert(*_label_updates(spark, sf), ["doc_id"])


@query(
    "key_violations",
    """SELECT url_main, link_anchor, count(*) AS n FROM fx_backlinks GROUP BY ALL
       HAVING count(*) > 1 OR url_main IS NULL OR link_anchor IS NULL""",
)
def key_violations(spark: SparkSession, sf: str) -> DataFrame:
    return check_keys(view(spark, sf, "fx_backlinks"), ["url_main", "link_anchor"])


@query(
    "import_crawl_table",
    """SELECT page_id, p.html, p.url AS main, concat(b.url_main, ' ', b.link_url) AS links
       FROM pages p JOIN fx_backlinks b USING (page_id)""",
)
def import_crawl_table(spark: SparkSession, sf: str) -> DataFrame:
    encoded = view(spark, sf, "fx_backlinks").join(table(spark, sf, "pages"), "page_id").select(
        "page_id",
        F.base64(F.encode("html", "UTF-8")).alias("html"),
        F.base64(F.encode("url", "UTF-8")).alias("main"),
        F.base64(F.encode(F.to_json(F.array("url_main", "link_url")), "UTF-8")).alias("links"),
    )
    return tables.import_crawl_table(encoded).withColumn("links", F.array_join("links", " "))


@query(
    "export_crawl_table",
    """SELECT page_id, to_base64(encode(html)) AS html, to_base64(encode(url)) AS main,
              to_base64(encode(concat('["', url, '"]'))) AS links FROM pages""",
)
def export_crawl_table(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(
        "page_id", "html", F.col("url").alias("main"), F.array("url").alias("links")
    )
    return tables.export_crawl_table(pages)


# --- ingest -----------------------------------------------------------------------------------

_EXPORT_HEADER = (
    "#", "Referring Page URL", "Link URL", "Link Anchor", "Backlink Status", "First Seen",
    "Last Check", "Day Lost", "Domain Rating (desc)", "Traffic %",
)


def _backlinks_export(spark: SparkSession, sf: str) -> DataFrame:
    """The backlinks in the form of an export file: raw names, all text, empty for missing."""
    rows = view(spark, sf, "fx_backlinks").select(
        F.col("page_id").cast("string"),
        "referring_page_url",
        F.concat("link_url", F.lit("a\\b")),
        F.coalesce("link_anchor", F.lit("")),
        F.coalesce("backlink_status", F.lit("")),
        F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"),
        F.when(F.col("page_id") % 5 == 0, "soon").otherwise(F.date_format("first_seen", "yyyy-MM-dd")),
        F.lit(""),
        (F.col("page_id") % 90).cast("string"),
        (F.col("page_id") % 8).cast("string"),
    )
    return rows.toDF(*_EXPORT_HEADER)


def _domains_export(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "fx_domains").select(
        F.lit("1"),
        "referring_domain",
        F.col("domain_rating").cast("string"),
        F.coalesce(F.col("organic_traffic").cast("string"), F.lit("")),
        F.date_format("first_seen", "yyyy-MM-dd"),
    )
    return rows.toDF("#", "Referring Domain", "Domain Rating (desc)", "Organic Traffic", "First Seen")


def _old_state(spark: SparkSession, sf: str) -> State:
    """A state before the upload: stored rows for part of the keys, with older values."""
    backlinks = view(spark, sf, "fx_backlinks").select(
        "referring_page_url",
        F.concat("link_url", F.lit("a\\b")).alias("link_url"),
        F.lit("old anchor").alias("link_anchor"),
        "first_seen",
        "url_main",
    )
    return State(
        _conform(backlinks.where("link_anchor IS NOT NULL"), BACKLINKS),
        _conform(view(spark, sf, "fx_domains").select("referring_domain"), DOMAINS),
        spark.createDataFrame([], URL_MATCHES),
        _conform(view(spark, sf, "fx_scraped"), SCRAPED_DOMAINS),
    )


def _conform(df: DataFrame, schema) -> DataFrame:
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


@query(
    "normalized_cols",
    """SELECT page_id::VARCHAR AS "#", referring_page_url, concat(link_url, 'a\\b') AS link_url,
              coalesce(link_anchor, '') AS link_anchor, coalesce(backlink_status, '') AS backlink_status,
              strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen,
              CASE WHEN page_id % 5 = 0 THEN 'soon' ELSE strftime(first_seen, '%Y-%m-%d') END AS last_check,
              '' AS day_lost, (page_id % 90)::VARCHAR AS domain_rating, (page_id % 8)::VARCHAR AS traffic
       FROM fx_backlinks""",
)
def normalized_cols(spark: SparkSession, sf: str) -> DataFrame:
    return C.normalize_columns(_backlinks_export(spark, sf))


@query("clean_links", """SELECT page_id, replace(concat(url, '\\x'), '\\', '\\\\') AS link FROM pages""")
def clean_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", U.clean_link(F.concat("url", F.lit("\\x"))).alias("link")
    )


_INGESTED = f"""
    SELECT referring_page_url, concat(link_url, 'a\\b') AS link_url, link_anchor, backlink_status, first_seen,
           CASE WHEN page_id % 5 <> 0 THEN first_seen END AS last_check, NULL::TIMESTAMP AS day_lost,
           backlink_status IS NULL AS live,
           CASE WHEN link_anchor IS NULL THEN 'No anchor' ELSE 'Has anchor' END AS link_type,
           TIMESTAMP '{LOAD_TIME}' AS last_updated, url_main, (page_id % 90)::VARCHAR AS domain_rating,
           (page_id % 8)::VARCHAR AS traffic
    FROM fx_backlinks"""


@query("ingest_backlinks", _INGESTED)
def ingest_backlinks(spark: SparkSession, sf: str) -> DataFrame:
    state = ingest(_backlinks_export(spark, sf),
                   _domains_export(spark, sf), _old_state(spark, sf), LOAD_TIME)
    return state.backlinks


@query(
    "ingest_domains",
    f"""SELECT referring_domain, domain_rating, organic_traffic::BIGINT AS organic_traffic, first_seen,
               TIMESTAMP '{LOAD_TIME}' AS last_updated FROM fx_domains""",
)
def ingest_domains(spark: SparkSession, sf: str) -> DataFrame:
    state = ingest(_backlinks_export(spark, sf),
                   _domains_export(spark, sf), _old_state(spark, sf), LOAD_TIME)
    return state.domains


_COUNTERS = """
    SELECT regexp_extract(url_main, '[^.]+[.][^.]+[.][^.]+$', 0) AS domain, count(*) AS total_backlinks,
           count(*) FILTER (backlink_status IS NULL) AS live_backlinks,
           count(*) FILTER (url_www = 'www.') AS url_www,
           count(*) FILTER (url_https = 'https://') AS url_https, min(first_seen) AS first_seen
    FROM fx_backlinks
    WHERE regexp_extract(url_main, '[^.]+[.][^.]+[.][^.]+$', 0) IN (SELECT referring_domain FROM fx_domains)
    GROUP BY 1"""


@query(
    "ingest_queue",
    f"""SELECT domain, total_backlinks, live_backlinks, url_www, url_https, first_seen,
               s.last_scrape_date
        FROM ({_COUNTERS}) JOIN (SELECT domain, last_scrape_date FROM fx_scraped) s USING (domain)""",
)
def ingest_queue(spark: SparkSession, sf: str) -> DataFrame:
    state = ingest(_backlinks_export(spark, sf),
                   _domains_export(spark, sf), _old_state(spark, sf), LOAD_TIME)
    return state.scraped.select("domain", *crawl.COUNTERS, "first_seen", "last_scrape_date")


def _uploaded_twice(spark: SparkSession, sf: str) -> State:
    """Two uploads in turn: two thirds of the backlinks, all still live, then the rest and what was lost."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    links, domains = _backlinks_export(spark, sf), _domains_export(spark, sf)
    page, even = F.col("#").cast("long"), F.length("Referring Domain") % 2 == 0
    first = links.where(page % 3 != 0).withColumn("Backlink Status", F.lit(""))
    ingest_into(folder, first, domains.where(even), LOAD_TIME)
    second = links.where((page % 3 == 0) | (F.col("Backlink Status") != ""))
    return ingest_into(folder, second, domains.where(~even), LOAD_TIME)


@query("ingest_twice_backlinks", _INGESTED)
def ingest_twice_backlinks(spark: SparkSession, sf: str) -> DataFrame:
    return _uploaded_twice(spark, sf).backlinks


# a domain keeps the first sight that it came into the queue with
_QUEUE_TWICE = _COUNTERS.replace("min(first_seen) AS first_seen", """
           CASE WHEN length(domain) % 2 = 0 AND count(*) FILTER (page_id % 3 <> 0) > 0
                THEN min(first_seen) FILTER (page_id % 3 <> 0) ELSE min(first_seen) END AS first_seen""")


@query("ingest_twice_queue", f"SELECT domain, total_backlinks, live_backlinks, url_www, url_https, first_seen FROM ({_QUEUE_TWICE})")
def ingest_twice_queue(spark: SparkSession, sf: str) -> DataFrame:
    return _uploaded_twice(spark, sf).scraped.select("domain", *crawl.COUNTERS, "first_seen")


@query("ingest_twice_matches", """
    SELECT DISTINCT url_main, referring_domain AS matching_domain
    FROM fx_backlinks LEFT JOIN fx_domains ON regexp_extract(url_main, '[^.]+[.][^.]+[.][^.]+$', 0) = referring_domain
    WHERE url_main IS NOT NULL""")
def ingest_twice_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _uploaded_twice(spark, sf).url_matches.select("url_main", "matching_domain")


@query(
    "queue_of_types",
    f"""SELECT domain, total_backlinks, live_backlinks, url_www, url_https, first_seen
        FROM ({_COUNTERS.replace("GROUP BY 1", "AND link_anchor IS NOT NULL GROUP BY 1")})""",
)
def queue_of_types(spark: SparkSession, sf: str) -> DataFrame:
    """The crawl queue from backlinks with an anchor only."""
    state = _old_state(spark, sf)
    state.scraped = spark.createDataFrame([], SCRAPED_DOMAINS)
    state.backlinks = spark.createDataFrame([], BACKLINKS)
    links, domains = _backlinks_export(spark, sf), _domains_export(spark, sf)
    result = ingest(links, domains, state, LOAD_TIME, types=[C.HAS_ANCHOR])
    return result.scraped.select("domain", *crawl.COUNTERS, "first_seen")


@query(
    "rejected_times",
    """SELECT 'backlinks' AS "table", 'first_seen' AS "column", 0 AS n
       UNION ALL SELECT 'backlinks', 'last_check', count(*) FILTER (page_id % 5 = 0) FROM fx_backlinks
       UNION ALL SELECT 'backlinks', 'day_lost', 0
       UNION ALL SELECT 'domains', 'first_seen', 0""",
)
def rejected_times(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_times(_backlinks_export(spark, sf), _domains_export(spark, sf))


@query(
    "link_types",
    """SELECT page_id, CASE WHEN link_anchor LIKE '%1%' THEN 'numbered'
                            WHEN link_anchor IS NOT NULL THEN 'Has anchor' ELSE 'No anchor' END AS link_type
       FROM fx_backlinks""",
)
def link_types(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("numbered", F.col("link_anchor").contains("1"))]
    return view(spark, sf, "fx_backlinks").select(
        "page_id", C.link_type(F.col("link_anchor"), rules).alias("link_type")
    )


_URL = "'(https?://)(wwww?[0-9]?.)?([^/?]*)/?([^?]*)[?]?(.*)'"
_SPLIT = ", ".join(
    f"nullif(trim(regexp_extract(url, {_URL}, {i + 1})), '') AS {name}"
    for i, name in enumerate(("scheme", "www", "host", "path", "params"))
)


@query("split_url", f"SELECT page_id, {_SPLIT}, NULL::VARCHAR AS error FROM pages")
def split_url(spark: SparkSession, sf: str) -> DataFrame:
    quoted = F.concat(F.lit('" '), F.col("url"), F.lit(' "'))
    return table(spark, sf, "pages").select("page_id", U.split_url(quoted).alias("u")).select(
        "page_id", "u.*"
    )


@query("url_main", "SELECT page_id, regexp_extract(url, '^(https?://)(www.)?([^/]*)', 3) AS host FROM pages")
def url_main(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.url_main(F.col("url")).alias("host"))


@query("distinct_hosts", "SELECT DISTINCT url_main FROM fx_backlinks")
def distinct_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(U.split_url(F.col("url"))["host"].alias("url_main")).distinct()


_MATCHES = """
    SELECT url_main, CASE WHEN url_main IN (SELECT referring_domain FROM fx_domains) THEN url_main
                          WHEN url_main LIKE '%.%.%.%'
                           AND regexp_extract(url_main, '[^.]+[.][^.]+[.][^.]+$', 0) IN (SELECT referring_domain FROM fx_domains)
                          THEN regexp_extract(url_main, '[^.]+[.][^.]+[.][^.]+$', 0) END AS matching_domain,
           NULL::VARCHAR AS match_error
    FROM (SELECT DISTINCT url_main FROM fx_backlinks)"""


@query("match_domain", _MATCHES)
def match_domain(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_domain(
        view(spark, sf, "fx_backlinks"), view(spark, sf, "fx_domains"), "url_main", "referring_domain"
    )


@query("domain_matches", f"SELECT * FROM ({_MATCHES}) WHERE url_main IS NOT NULL")
def domain_matches(spark: SparkSession, sf: str) -> DataFrame:
    return matching.build_domain_matches(
        view(spark, sf, "fx_backlinks"), view(spark, sf, "fx_domains")
    )


@query("crawl_counters", _COUNTERS)
def crawl_counters(spark: SparkSession, sf: str) -> DataFrame:
    backlinks = view(spark, sf, "fx_backlinks")
    matches = matching.build_domain_matches(backlinks, view(spark, sf, "fx_domains"))
    return crawl.crawl_counters(backlinks, matches)


# --- crawl ------------------------------------------------------------------------------------


@query(
    "candidate_urls",
    """SELECT domain, pos - 1 AS pos, url FROM (
         SELECT domain, unnest(urls) AS url, generate_subscripts(urls, 1) AS pos FROM (
           SELECT domain, list_filter([
             CASE WHEN url_www > 0 AND url_https > 0 THEN concat('https://www.', domain) END,
             CASE WHEN url_www > 0 AND url_https < total_backlinks THEN concat('http://www.', domain) END,
             CASE WHEN url_www < total_backlinks AND url_https > 0 THEN concat('https://', domain) END,
             CASE WHEN url_www < total_backlinks AND url_https < total_backlinks THEN concat('http://', domain) END
           ], lambda x: x IS NOT NULL) AS urls FROM fx_scraped))""",
)
def candidate_urls(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.candidates(view(spark, sf, "fx_scraped"))


@query("crawl_queue", "SELECT domain, first_seen FROM fx_scraped WHERE last_scrape_date IS NULL")
def crawl_queue(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.crawl_queue(view(spark, sf, "fx_scraped")).select("domain", "first_seen")


_BATCH = "SELECT domain, first_seen FROM fx_scraped WHERE last_scrape_date IS NULL ORDER BY first_seen DESC, domain LIMIT 10"


@query("next_batch", _BATCH)
def next_batch(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.next_batch(crawl_queue(spark, sf), 10)


@query(
    "remaining_queue",
    f"""SELECT domain, first_seen FROM fx_scraped WHERE last_scrape_date IS NULL
        AND domain NOT IN (SELECT domain FROM ({_BATCH}))""",
)
def remaining_queue(spark: SparkSession, sf: str) -> DataFrame:
    queue = crawl_queue(spark, sf)
    return crawl.remaining(queue, crawl.next_batch(queue, 10))


@query(
    "scrape_outcome",
    """SELECT domain, coalesce(last_scrape_date = last_successful_scrape_date, false) AS success
       FROM fx_scraped""",
)
def scrape_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.split_outcome(view(spark, sf, "fx_scraped")).select("domain", "success")


# attempts of a host: its own pages in page order, answered as fx_responses says
_ATTEMPTS = """
    SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS pos, url, status_code,
           request_error, fetched_at, html FROM fx_responses"""


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    view(spark, sf, "fx_responses").createOrReplaceTempView("fx_responses")
    return spark.sql(_ATTEMPTS)


_PICKED = f"""
    SELECT domain, last_scrape_code, last_scrape_request_error, last_scrape_date,
           CASE WHEN chosen.status_code = 200 THEN chosen.url END AS url,
           CASE WHEN chosen.status_code = 200 THEN chosen.html END AS html
    FROM (SELECT domain, arg_max_null(status_code, pos) AS last_scrape_code,
                 arg_max_null(request_error, pos) AS last_scrape_request_error,
                 arg_max_null(fetched_at, pos) AS last_scrape_date,
                 arg_max({{'url': url, 'status_code': status_code, 'html': html}}, pos)
                   FILTER (request_error IS NULL) AS chosen
          FROM ({_ATTEMPTS}) GROUP BY domain)"""


@query("pick_response", _PICKED)
def pick_response(spark: SparkSession, sf: str) -> DataFrame:
    attempts = _attempts(spark, sf)
    return crawl.pick_response(attempts.select("domain", "pos", "url"), attempts)


# the text and links of a page in SQL; correct for the markup of the pages table only
_REDUCED = """regexp_replace(regexp_replace(regexp_replace(html, '<head>.*?</head>', '', 's'),
                '<header>.*?</header>', '', 's'), '<footer>.*?(</footer>|$)', '', 's')"""
_PAGE_TEXT = """trim(regexp_replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace({part}, '<!--.*?-->', ' ', 'gs'),
        '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'gs'),
      '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\n\\t\\r]+', ' ', 'g'))"""
_PAGE_COLUMNS = f"""
           {_PAGE_TEXT.format(part=f"CASE WHEN html LIKE '%<main>%' THEN regexp_extract(html, '<main>(.*?)</main>', 1, 's') ELSE {_REDUCED} END")} AS main,
           list_filter(regexp_extract_all(CASE WHEN html LIKE '%<main>%' THEN html ELSE {_REDUCED} END,
             '<a href="(https?://[^"]*)"', 1), lambda x: NOT contains(x, domain)) AS links,
           {_PAGE_TEXT.format(part="regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title"""
_PAGES = f"SELECT page_id, url, domain, html, status_code, fetched_at, {_PAGE_COLUMNS} FROM fx_responses"


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.extract_pages(view(spark, sf, "fx_responses"))


@query("page_title", f"SELECT page_id, title FROM ({_PAGES})")
def page_title(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("page_id", F.trim("title").alias("title"))


@query("page_text", f"SELECT page_id, main FROM ({_PAGES})")
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("page_id", "main")


@query("page_links", f"SELECT page_id, array_to_string(links, ' ') AS links FROM ({_PAGES})")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("page_id", F.array_join("links", " ").alias("links"))


_LINK_HOSTS = "list_sort(list_distinct(list_transform(links, lambda x: regexp_extract(x, '^(https?://)(www.)?([^/]*)', 3))))"


@query("page_link_hosts", f"SELECT page_id, array_to_string({_LINK_HOSTS}, ' ') AS hosts FROM ({_PAGES})")
def page_link_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select(
        "page_id", F.array_join("links_main_domains", " ").alias("hosts")
    )


@query(
    "extract_pages",
    f"""SELECT page_id, title, main, array_to_string(links, ' ') AS links,
               array_to_string({_LINK_HOSTS}, ' ') AS links_main_domains, NULL::VARCHAR AS parse_error
        FROM ({_PAGES})""",
)
def extract_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select(
        "page_id", F.trim("title").alias("title"), "main", F.array_join("links", " ").alias("links"),
        F.array_join("links_main_domains", " ").alias("links_main_domains"), "parse_error",
    )


_KNOWN = f"""
    SELECT page_id, coalesce(string_agg(known, ' ' ORDER BY known), '') AS known_links FROM (
      SELECT DISTINCT page_id, d.referring_domain AS known
      FROM (SELECT page_id, unnest(CASE WHEN len({_LINK_HOSTS}) > 0 THEN {_LINK_HOSTS} ELSE [NULL] END) AS host
            FROM ({_PAGES}))
      LEFT JOIN fx_domains d ON regexp_extract(host, '[^.]+[.][^.]+[.][^.]+$', 0) = d.referring_domain)
    GROUP BY page_id"""


@query("page_known_links", _KNOWN)
def page_known_links(spark: SparkSession, sf: str) -> DataFrame:
    known = crawl.known_links(_extracted(spark, sf), view(spark, sf, "fx_domains"), "page_id")
    return known.select("page_id", F.array_join("links_known_domains", " ").alias("known_links"))


@query(
    "utf8_guard",
    """SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN url END AS main,
              CASE WHEN page_id % 5 = 0 THEN 'Scraped nonutf8 characters failed pg upload.' END AS last_scrape_parse_error
       FROM pages""",
)
def utf8_guard(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.unhex(F.concat(F.hex("url"), F.lit("FF"))).cast("string")
    rows = table(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 5 == 0, broken).otherwise(F.col("url")).alias("main"),
        F.lit(None).cast("string").alias("last_scrape_parse_error"),
    )
    return crawl.utf8_guard(rows)


_RESULTS = f"""
    SELECT domain, last_scrape_code, last_scrape_request_error, last_scrape_date,
           CASE WHEN html IS NOT NULL THEN last_scrape_date END AS last_successful_scrape_date,
           html AS main, NULL::VARCHAR AS last_scrape_parse_error FROM ({_PICKED})"""
_CRAWL_COLUMNS = [
    "domain", "total_backlinks", "last_scrape_code", "last_scrape_request_error", "last_scrape_date",
    "last_successful_scrape_date", "last_scrape_parse_error", "main",
]


@query(
    "apply_scrape",
    f"""SELECT coalesce(s.domain, r.domain) AS domain, s.total_backlinks::BIGINT AS total_backlinks,
               r.last_scrape_code, r.last_scrape_request_error,
               CASE WHEN r.domain IS NULL THEN s.last_scrape_date ELSE r.last_scrape_date END AS last_scrape_date,
               CASE WHEN r.main IS NOT NULL THEN r.last_successful_scrape_date
                    ELSE s.last_successful_scrape_date END AS last_successful_scrape_date,
               r.last_scrape_parse_error, r.main
        FROM fx_scraped s FULL JOIN ({_RESULTS}) r ON s.domain = r.domain""",
)
def apply_scrape(spark: SparkSession, sf: str) -> DataFrame:
    picked = pick_response(spark, sf)
    results = picked.select(
        "domain", "last_scrape_code", "last_scrape_request_error", "last_scrape_date",
        F.when(F.col("html").isNotNull(), F.col("last_scrape_date")).alias("last_successful_scrape_date"),
        F.col("html").alias("main"),
        F.lit(None).cast("string").alias("last_scrape_parse_error"),
    )
    scraped = _conform(view(spark, sf, "fx_scraped"), SCRAPED_DOMAINS)
    return crawl.apply_scrape(scraped, results).select(*_CRAWL_COLUMNS)


# --- languages --------------------------------------------------------------------------------

_LANGUAGE_MODEL = """
    words AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS word FROM documents),
    counts AS (SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL),
    by_lang AS (SELECT lang, word, count(*) AS n FROM words GROUP BY ALL),
    vocabulary AS (SELECT DISTINCT word FROM words),
    grams AS (
      SELECT word, substr(concat(' ', word, ' '), i, k) AS gram
      FROM vocabulary, unnest([1, 2, 3]) AS s(k), unnest(range(1, length(word) + 4 - k)) AS r(i)
      WHERE substr(concat(' ', word, ' '), i, k) <> ' '),
    seen AS (SELECT lang, gram, sum(n) AS n FROM by_lang JOIN grams USING (word) GROUP BY ALL),
    totals AS (SELECT lang, sum(n) AS total FROM seen GROUP BY lang),
    model AS (
      SELECT gram, t.lang, ln((coalesce(s.n, 0) + 1) / (t.total + (SELECT count(DISTINCT gram) FROM seen))) AS weight
      FROM (SELECT DISTINCT gram FROM seen) g CROSS JOIN totals t LEFT JOIN seen s USING (gram, lang))"""


@query(
    "language_model",
    f"WITH {_LANGUAGE_MODEL} SELECT gram, lang, round(weight, 6) AS weight FROM model",
)
def language_model(spark: SparkSession, sf: str) -> DataFrame:
    model = language.train_language_model(
        table(spark, sf, "documents", spread=True), "lang", "text"
    )
    return language.every_weight(model).select("gram", "lang", F.round("weight", 6).alias("weight"))


@query(
    "detect_language",
    f"""WITH {_LANGUAGE_MODEL},
        word_scores AS (SELECT word, lang, sum(weight) AS score FROM grams JOIN model USING (gram) GROUP BY ALL),
        scores AS (SELECT doc_id, lang, sum(n * score) AS score FROM counts JOIN word_scores USING (word) GROUP BY ALL)
        SELECT doc_id, coalesce(arg_max(s.lang, (round(score, 6), s.lang)),
                 'Can''t detect language - no text, or langdetect not installed') AS lang
        FROM documents LEFT JOIN scores s USING (doc_id) GROUP BY doc_id""",
)
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents", spread=True)
    model = language.train_language_model(documents, "lang", "text")
    return language.detect_language(documents, model, "doc_id", "text")


_CRAWLED = f"""
    captured AS (SELECT * REPLACE (concat('p', page_id, '.', domain) AS domain) FROM fx_responses WHERE domain IS NOT NULL),
    queue AS (
      SELECT concat('p', page_id, '.', url_main) AS domain, count(*) AS total_backlinks, count(*) FILTER (url_www = 'www.') AS www,
             count(*) FILTER (url_https = 'https://') AS https
      FROM fx_backlinks WHERE url_main IS NOT NULL GROUP BY 1),
    tries AS (
      SELECT domain, total_backlinks, (www > 0)::INT * ((https > 0)::INT + (https < total_backlinks)::INT)
             + (www < total_backlinks)::INT * ((https > 0)::INT + (https < total_backlinks)::INT) AS tries FROM queue),
    attempts AS (SELECT a.* FROM ({_ATTEMPTS.replace("fx_responses", "captured")}) a JOIN tries USING (domain) WHERE pos <= tries),
    picked AS ({_PICKED.replace(f"({_ATTEMPTS})", "attempts")}),
    read AS (SELECT domain, {_PAGE_COLUMNS} FROM picked),
    known AS (
      SELECT domain, coalesce(string_agg(known, ' ' ORDER BY known), '') AS links_known_domains FROM (
        SELECT DISTINCT domain, d.referring_domain AS known
        FROM (SELECT domain, unnest(CASE WHEN len({_LINK_HOSTS}) > 0 THEN {_LINK_HOSTS} ELSE [NULL] END) AS host FROM read)
        LEFT JOIN fx_domains d ON regexp_extract(host, '[^.]+[.][^.]+[.][^.]+$', 0) = d.referring_domain)
      GROUP BY domain),
    page_words AS (SELECT domain, unnest(regexp_extract_all(lower(main), '[\\p{{L}}]+')) AS word FROM read),
    page_counts AS (SELECT domain, word, count(*) AS n FROM page_words GROUP BY ALL),
    page_grams AS (
      SELECT word, substr(concat(' ', word, ' '), i, k) AS gram
      FROM (SELECT DISTINCT word FROM page_words), unnest([1, 2, 3]) AS s(k), unnest(range(1, length(word) + 4 - k)) AS r(i)
      WHERE substr(concat(' ', word, ' '), i, k) <> ' '),
    page_scores AS (
      SELECT domain, lang, sum(n * weight) AS score
      FROM page_counts JOIN page_grams USING (word) JOIN model USING (gram) GROUP BY ALL),
    page_lang AS (SELECT domain, arg_max(lang, (round(score, 6), lang)) AS lang FROM page_scores GROUP BY domain)"""


@query(
    "crawl",
    f"""WITH {_LANGUAGE_MODEL}, {_CRAWLED}
        SELECT p.domain, total_backlinks, last_scrape_code, last_scrape_request_error, last_scrape_date,
               CASE WHEN p.html IS NOT NULL THEN last_scrape_date END AS last_successful_scrape_date,
               NULL::VARCHAR AS last_scrape_parse_error, r.main,
               CASE WHEN p.html IS NOT NULL THEN coalesce(l.lang, 'Can''t detect language - no text, or langdetect not installed') END AS lang,
               CASE WHEN p.html IS NOT NULL THEN k.links_known_domains END AS links_known_domains
        FROM picked p JOIN tries USING (domain) JOIN read r USING (domain) LEFT JOIN known k USING (domain)
             LEFT JOIN page_lang l USING (domain)""",
)
def crawl_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The whole crawl over all pages: each is the front page of a domain of its own, named by page and host."""
    backlinks = view(spark, sf, "fx_backlinks").where("url_main IS NOT NULL")
    hosts = backlinks.groupBy(F.concat(F.lit("p"), "page_id", F.lit("."), "url_main").alias("domain")).agg(
        F.count("*").alias("total_backlinks"),
        F.count_if(F.isnull("backlink_status")).alias("live_backlinks"),
        F.count_if(F.col("url_www") == U.WWW).alias("url_www"),
        F.count_if(F.col("url_https") == U.HTTPS).alias("url_https"),
        F.min("first_seen").alias("first_seen"),
    )
    scraped = _conform(hosts, SCRAPED_DOMAINS)
    captured = view(spark, sf, "fx_responses").where("domain IS NOT NULL").select(
        F.concat(F.lit("p"), "page_id", F.lit("."), "domain").alias("domain"),
        F.lit(0).alias("pos"), "status_code", "request_error", "fetched_at", "html",
    )
    responses = crawl.candidates(scraped).join(captured, ["domain", "pos"]).drop("domain", "pos")
    documents = table(spark, sf, "documents", spread=True)
    model = language.train_language_model(documents, "lang", "text")
    result = run_crawl(scraped, responses, view(spark, sf, "fx_domains"), model)
    return result.select(
        *_CRAWL_COLUMNS, "lang", F.array_join("links_known_domains", " ").alias("links_known_domains")
    )


# --- graph ------------------------------------------------------------------------------------


def _linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Crawled pages with their three kinds of links, several rows per domain."""
    pages = _extracted(spark, sf)
    known = crawl.known_links(pages, view(spark, sf, "fx_domains"), "page_id")
    return pages.join(known, "page_id")


def _edges_oracle(column: str) -> str:
    return f"SELECT DISTINCT domain AS src, dst FROM (SELECT domain, unnest({column}) AS dst FROM ({_PAGES})) WHERE domain <> dst"


@query("edges_links", _edges_oracle("links"))
def edges_links(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_edges(_extracted(spark, sf), "all_links")


@query("edges_hosts", _edges_oracle(_LINK_HOSTS))
def edges_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_edges(_extracted(spark, sf), "all_domains")


@query(
    "edges_known",
    f"""SELECT DISTINCT src, d.referring_domain AS dst
        FROM (SELECT domain AS src, unnest({_LINK_HOSTS}) AS host FROM ({_PAGES}))
        JOIN fx_domains d ON regexp_extract(host, '[^.]+[.][^.]+[.][^.]+$', 0) = d.referring_domain
        WHERE src <> d.referring_domain""",
)
def edges_known(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_edges(_linked_pages(spark, sf))


def _network(spark: SparkSession, sf: str) -> DataFrame:
    return graph.network_domains(
        view(spark, sf, "fx_domains"), _conform(view(spark, sf, "fx_scraped"), SCRAPED_DOMAINS)
    )


@query(
    "network_domains",
    """SELECT d.referring_domain AS domain, domain_rating, organic_traffic, live_backlinks::BIGINT AS live_backlinks,
              total_backlinks::BIGINT AS total_backlinks, d.first_seen, last_updated, last_successful_scrape_date
       FROM fx_domains d JOIN fx_scraped s ON d.referring_domain = s.domain
       UNION ALL
       SELECT NULL, domain_rating, organic_traffic, NULL, NULL, first_seen, last_updated, NULL
       FROM fx_domains WHERE referring_domain NOT IN (SELECT domain FROM fx_scraped)""",
)
def network_domains(spark: SparkSession, sf: str) -> DataFrame:
    return _network(spark, sf).drop("links", "links_known_domains", "links_main_domains")


def _graph(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, DataFrame]:
    edges = materialize(view(spark, sf, name).where("src <> dst").distinct())
    return materialize(graph.edge_nodes(edges)), edges


def _graph_sql(edges: str, removed: str = "''", head: str = "") -> str:
    """Recursive SQL for nodes, degrees and numbered components of an edge view."""
    return f"""WITH RECURSIVE {head}
      e0 AS (SELECT DISTINCT src, dst FROM {edges} WHERE src <> dst),
      e AS (SELECT * FROM e0 WHERE src <> {removed} AND dst <> {removed}),
      v AS (SELECT DISTINCT domain FROM (SELECT src AS domain FROM e0 UNION SELECT dst FROM e0) WHERE domain <> {removed}),
      both_ways AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
      reach(domain, label) USING KEY (domain) AS (
        SELECT domain, domain FROM v
        UNION
        SELECT b.y, min(r.label) FROM reach r JOIN both_ways b ON b.x = r.domain
          JOIN recurring.reach old ON old.domain = b.y
        WHERE r.label < old.label GROUP BY b.y),
      numbers AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS component FROM reach GROUP BY label),
      members AS (SELECT domain, component FROM reach JOIN numbers USING (label)),
      deg AS (SELECT domain, (SELECT 0) + count(o.dst) AS out_links FROM v LEFT JOIN e o ON o.src = v.domain GROUP BY domain),
      deg_in AS (SELECT domain, count(i.src) AS in_links FROM v LEFT JOIN e i ON i.dst = v.domain GROUP BY domain),
      info AS (
        SELECT domain, component, in_links + out_links AS all_links, in_links, out_links, domain_rating, organic_traffic
        FROM members JOIN deg USING (domain) JOIN deg_in USING (domain)
        LEFT JOIN (SELECT d.referring_domain AS domain, domain_rating, organic_traffic
                   FROM fx_domains d JOIN fx_scraped s ON d.referring_domain = s.domain) USING (domain)),
      stats AS (
        SELECT component, count(*) AS size, sum(out_links)::BIGINT AS links,
               round(sum(out_links) / count(*), 6) AS density, sum(out_links) = max(all_links) AS star,
               arg_min(domain, (-all_links, domain)) AS centroid, max(all_links) AS centroid_links,
               round(avg(domain_rating), 6) AS mean_domain_rating, round(avg(organic_traffic), 6) AS mean_organic_traffic,
               max(domain_rating) AS max_domain_rating, max(organic_traffic) AS max_organic_traffic
        FROM info GROUP BY component)"""


_INFO_COLUMNS = "domain, component, all_links, in_links, out_links, domain_rating, organic_traffic"
_STATS_COLUMNS = "component, size, links, density, star, centroid, centroid_links"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f.name: F.round(f.name, 6) for f in df.schema if f.dataType.simpleString() == "double"
    })


@query("degrees", _graph_sql("fx_edges_large") + " SELECT domain, all_links, in_links, out_links FROM info")
def degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(*_graph(spark, sf, "fx_edges_large"))


@query("components", _graph_sql("fx_edges_large") + " SELECT domain, component FROM members")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(*_graph(spark, sf, "fx_edges_large"))


@query("domain_info", _graph_sql("fx_edges_small") + f" SELECT {_INFO_COLUMNS} FROM info")
def domain_info(spark: SparkSession, sf: str) -> DataFrame:
    return graph.domain_info(*_graph(spark, sf, "fx_edges_small"), _network(spark, sf))


@query("component_stats", _graph_sql("fx_edges_large") + f" SELECT {_STATS_COLUMNS} FROM stats")
def component_stats(spark: SparkSession, sf: str) -> DataFrame:
    info = graph.domain_info(*_graph(spark, sf, "fx_edges_large"), _network(spark, sf))
    return _rounded(graph.component_stats(info))


@query("component_info", _graph_sql("fx_edges_small") + " SELECT * FROM stats")
def component_info(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(graph.component_info(domain_info(spark, sf)))


@query("get_component", _graph_sql("fx_edges_large") + f" SELECT {_INFO_COLUMNS} FROM info WHERE component = 0")
def get_component(spark: SparkSession, sf: str) -> DataFrame:
    info = graph.domain_info(*_graph(spark, sf, "fx_edges_large"), _network(spark, sf))
    return graph.component(info, 0)


@query(
    "component_of",
    _graph_sql("fx_edges_large")
    + f" SELECT {_INFO_COLUMNS} FROM info WHERE component IN (SELECT component FROM info WHERE domain = 'n7')",
)
def component_of(spark: SparkSession, sf: str) -> DataFrame:
    info = graph.domain_info(*_graph(spark, sf, "fx_edges_large"), _network(spark, sf))
    return graph.component_of(info, ["n7"])


@query(
    "remove_node",
    _graph_sql("fx_edges_large", "'n7'") + " SELECT * FROM stats",
)
def remove_node(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf, "fx_edges_large")
    names = nodes.where(F.col("domain") == "n7")
    kept_nodes, kept_edges = graph.remove_nodes(nodes, edges, names)
    info = graph.domain_info(kept_nodes, kept_edges, _network(spark, sf))
    return _rounded(graph.component_info(info))


@query("remove_node_update", _graph_sql("fx_edges_large", "'n7'") + " SELECT * FROM stats")
def remove_node_update(spark: SparkSession, sf: str) -> DataFrame:
    """The same removal from stored members: only the component that held the node is connected again."""
    nodes, edges = _graph(spark, sf, "fx_edges_large")
    names = nodes.where(F.col("domain") == "n7")
    left, _ = graph.members_without(graph.members(nodes, edges), edges, names)
    return _rounded(graph.component_info(graph.members_info(left, _network(spark, sf))))


_KNOWN_EDGES = f"""(
    SELECT DISTINCT src, d.referring_domain AS dst
    FROM (SELECT domain AS src, unnest({_LINK_HOSTS}) AS host FROM ({_PAGES}))
    JOIN fx_domains d ON regexp_extract(host, '[^.]+[.][^.]+[.][^.]+$', 0) = d.referring_domain
    WHERE src IN (SELECT referring_domain FROM fx_domains))"""
_FIRST_DOMAIN = "(SELECT min(referring_domain) FROM fx_domains)"


@query("network_report", _graph_sql(_KNOWN_EDGES, _FIRST_DOMAIN) + " SELECT * FROM stats")
def network_report(spark: SparkSession, sf: str) -> DataFrame:
    """The network of known domains from stored crawl columns, without its first domain."""
    domains = view(spark, sf, "fx_domains")
    links = _linked_pages(spark, sf).select("domain", F.explode("links_known_domains").alias("known")).distinct()
    per_domain = links.groupBy("domain").agg(F.collect_list("known").alias("links_known_domains"))
    crawled = view(spark, sf, "fx_scraped").join(per_domain, "domain", "left")
    report = NetworkReport(domains, _conform(crawled, SCRAPED_DOMAINS))
    first = domains.agg(F.min("referring_domain")).first()[0]
    return _rounded(report.remove_node(first).component_info)


@query(
    "component_subgraph",
    _graph_sql("fx_edges_large")
    + " SELECT src, dst FROM e WHERE src IN (SELECT domain FROM members WHERE component = 0)",
)
def component_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(spark, sf, "fx_edges_large")
    return graph.component_subgraph(graph.components(nodes, edges), edges, 0)[1]


# --- cluster reports --------------------------------------------------------------------------

_REAL = "cluster IS NOT NULL AND cluster NOT LIKE '%-%'"


def _with_new(spark: SparkSession, sf: str) -> DataFrame:
    members = reports.real_clusters(view(spark, sf, "fx_clusters"))
    return reports.flag_new(members, reports.new_threshold(members, "last_upload"))


@query("real_clusters", f"SELECT domain, cluster FROM fx_clusters WHERE {_REAL}")
def real_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return reports.real_clusters(view(spark, sf, "fx_clusters")).select("domain", "cluster")


# clusters of hosts: the crawl table's domains in clusters by name length
_HOST_CLUSTERS = """
    SELECT referring_domain AS domain, 'en' AS lang,
           CASE WHEN length(referring_domain) % 4 = 3 THEN 'en-1'
                ELSE concat('en', CAST(length(referring_domain) % 4 AS STRING)) END AS cluster,
           CAST(length(referring_domain) AS DOUBLE) AS mean_distance
    FROM fx_domains
    UNION ALL
    SELECT concat('d', CAST(doc_id AS STRING)), lang, concat(lang, CAST(doc_id % 5 AS STRING)), NULL FROM documents"""


def _host_clusters(spark: SparkSession, sf: str) -> DataFrame:
    view(spark, sf, "fx_domains").createOrReplaceTempView("fx_domains")
    table(spark, sf, "documents").createOrReplaceTempView("documents")
    return spark.sql(_HOST_CLUSTERS)


@query(
    "cluster_domains",
    f"""SELECT c.*, s.last_successful_scrape_date, s.live_backlinks::BIGINT AS live_backlinks,
               s.total_backlinks::BIGINT AS total_backlinks, d.domain_rating, d.organic_traffic,
               d.first_seen, d.last_updated
        FROM ({_HOST_CLUSTERS}) c LEFT JOIN fx_scraped s ON c.domain = s.domain
             LEFT JOIN fx_domains d ON c.domain = d.referring_domain WHERE {_REAL}""",
)
def cluster_domains(spark: SparkSession, sf: str) -> DataFrame:
    return reports.cluster_domains(
        _host_clusters(spark, sf), view(spark, sf, "fx_scraped"), view(spark, sf, "fx_domains")
    )


_CLUSTER_LINKS = f"""
    SELECT c.cluster, b.url_main, b.page_id, b.referring_page_url, b.link_url, b.link_anchor, b.backlink_status
    FROM ({_HOST_CLUSTERS}) c LEFT JOIN ({_MATCHES}) m ON c.domain = m.matching_domain
         LEFT JOIN fx_backlinks b ON b.url_main = m.url_main WHERE {_REAL}"""


@query("cluster_backlinks", _CLUSTER_LINKS)
def cluster_backlinks(spark: SparkSession, sf: str) -> DataFrame:
    backlinks = view(spark, sf, "fx_backlinks").select(
        "url_main", "page_id", "referring_page_url", "link_url", "link_anchor", "backlink_status"
    )
    matches = matching.build_domain_matches(backlinks, view(spark, sf, "fx_domains"))
    return reports.cluster_backlinks(_host_clusters(spark, sf), matches, backlinks)


@query("new_threshold", f"SELECT min(last_updated) AS threshold FROM fx_clusters WHERE {_REAL}")
def new_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return reports.new_threshold(reports.real_clusters(view(spark, sf, "fx_clusters")))


_NEW = f"""
    SELECT *, coalesce(last_updated >= (SELECT max(last_updated) FROM fx_clusters WHERE {_REAL}), false) AS new
    FROM fx_clusters WHERE {_REAL}"""


@query("flag_new", f"SELECT domain, new FROM ({_NEW})")
def flag_new(spark: SparkSession, sf: str) -> DataFrame:
    return _with_new(spark, sf).select("domain", "new")


_CLUSTER_INFO = """SELECT cluster, substr(cluster, 1, 2) AS language, count(*) AS num_domains,
               count(*) FILTER (new) AS num_new_domains,
               coalesce(sum(live_backlinks), 0)::BIGINT AS total_live_backlinks,
               coalesce(sum(total_backlinks), 0)::BIGINT AS total_backlinks,
               coalesce(sum(organic_traffic), 0)::BIGINT AS total_organic_traffic,
               median(mean_distance) AS mean_distance, median(live_backlinks) AS mean_live_backlinks,
               median(total_backlinks) AS mean_backlinks, median(domain_rating) AS mean_domain_rating,
               median(organic_traffic) AS mean_organic_traffic,
               max(live_backlinks) AS max_live_backlinks, max(f.total_backlinks) AS max_backlinks,
               max(domain_rating) AS max_domain_rating, max(organic_traffic) AS max_organic_traffic"""


@query(
    "cluster_info",
    f"{_CLUSTER_INFO} FROM ({_NEW}) f GROUP BY cluster",
)
def cluster_info(spark: SparkSession, sf: str) -> DataFrame:
    return reports.cluster_info(_with_new(spark, sf))


# the same clusters with a hyphen in one language's code
_HYPHENATED = f"""
    SELECT domain, CASE WHEN lang = 'fr' THEN 'zh-cn' ELSE lang END AS lang,
           CASE WHEN lang = 'fr' THEN concat('zh-cn', substr(cluster, 3)) ELSE cluster END AS cluster, mean_distance
    FROM ({_HOST_CLUSTERS}) h"""
_REPORTED = f"""
    SELECT c.*, s.live_backlinks::BIGINT AS live_backlinks, s.total_backlinks::BIGINT AS total_backlinks,
           d.domain_rating, d.organic_traffic, d.last_updated
    FROM ({_HYPHENATED}) c LEFT JOIN fx_scraped s ON c.domain = s.domain
         LEFT JOIN fx_domains d ON c.domain = d.referring_domain
    WHERE cluster <> concat(lang, '-1') AND cluster <> concat(lang, '-clustering-failed')"""


@query(
    "cluster_report",
    f"""WITH m AS ({_REPORTED}),
        f AS (SELECT *, coalesce(last_updated >= (SELECT max(last_updated) FROM m), false) AS new FROM m)
        {_CLUSTER_INFO} FROM f GROUP BY cluster""",
)
def cluster_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report object over clusters of which some have a hyphen in their language."""
    _host_clusters(spark, sf)
    backlinks = view(spark, sf, "fx_backlinks").withColumn("last_updated", F.lit(LOAD_TIME).cast("timestamp"))
    report = ClusterReport(
        spark.sql(_HYPHENATED), view(spark, sf, "fx_scraped"), spark.createDataFrame([], URL_MATCHES), backlinks,
        view(spark, sf, "fx_domains"), mode="last_upload",
    )
    return report.cluster_info


@query("get_cluster", f"SELECT domain, cluster, new FROM ({_NEW}) WHERE cluster = 'en3'")
def get_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return reports.get_cluster(_with_new(spark, sf), "en3").select("domain", "cluster", "new")


@query(
    "cluster_of_domain",
    f"""SELECT domain, cluster FROM fx_clusters WHERE {_REAL} AND cluster IN
        (SELECT cluster FROM fx_clusters WHERE {_REAL} AND domain = 'd12')""",
)
def cluster_of_domain(spark: SparkSession, sf: str) -> DataFrame:
    members = reports.real_clusters(view(spark, sf, "fx_clusters"))
    return reports.cluster_of_domain(members, "d12").select("domain", "cluster")


@query(
    "cluster_of_url",
    f"""SELECT cluster, url_main, page_id FROM ({_CLUSTER_LINKS}) WHERE cluster IN
        (SELECT cluster FROM ({_CLUSTER_LINKS}) WHERE referring_page_url = 'http://ththre.example.com/fr/825?page=2&ref=x')""",
)
def cluster_of_url(spark: SparkSession, sf: str) -> DataFrame:
    url = "http://ththre.example.com/fr/825?page=2&ref=x"
    return reports.cluster_of_url(cluster_backlinks(spark, sf), url).select(
        "cluster", "url_main", "page_id"
    )


# --- text clustering --------------------------------------------------------------------------

MIN_SAMPLES = 10
EPS = 1.2
_WEIGHTS = """
    words AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
    counts AS (SELECT doc_id, lang, term, count(*) AS tf FROM words GROUP BY ALL),
    sizes AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
    vocabulary AS (SELECT lang, term, count(*) AS df FROM counts GROUP BY ALL HAVING count(*) >= 2),
    raw AS (SELECT doc_id, lang, term, tf, tf * (ln((1 + n) / (1 + df)) + 1) AS w
            FROM counts JOIN vocabulary USING (lang, term) JOIN sizes USING (lang)),
    weights AS (SELECT doc_id, lang, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""
_DISTANCES = _WEIGHTS + """,
    dots AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.weight * y.weight) AS dot
             FROM weights x JOIN weights y USING (lang, term) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
    squares AS (SELECT d.doc_id, d.lang, d.n_chars, CASE WHEN w.doc_id IS NULL THEN 0 ELSE 1 END AS sq
                FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM weights) w USING (doc_id)),
    gaps AS (SELECT p.lang, p.doc_id AS a, q.doc_id AS b, p.n_chars AS na, q.n_chars AS nb,
                    p.sq + q.sq - 2 * coalesce(dot, 0) AS d2
             FROM squares p JOIN squares q ON p.lang = q.lang AND p.doc_id <> q.doc_id
             LEFT JOIN dots ON dots.a = p.doc_id AND dots.b = q.doc_id),
    pairs AS (SELECT lang, a, b, na, nb, CASE WHEN d2 < 1e-12 THEN 0 ELSE sqrt(d2) END AS d FROM gaps),
    cores AS (SELECT lang, a AS doc_id, max(d) AS core
              FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM pairs)
              WHERE r <= 10 GROUP BY ALL)"""


@query(
    "tfidf",
    f"WITH {_WEIGHTS} SELECT doc_id, lang, term, tf, round(weight, 6) AS weight FROM weights",
)
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(text.tfidf(table(spark, sf, "documents", spread=True)))


def _text_points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents with the representative of their text, and the points of all texts."""
    documents = table(spark, sf, "documents", spread=True)
    members, groups = text.copies(documents, "doc_id", "lang", "text")
    groups = materialize(groups)
    rep = groups.select("lang", "digest", F.col("doc_id").alias("rep"))
    points = materialize(text.vectors(groups, "doc_id", "lang"))
    return members.join(rep, ["lang", "digest"]).select("doc_id", "lang", "rep"), points


@query(
    "core_distance",
    f"WITH {_DISTANCES} SELECT doc_id, lang, round(core, 6) AS core FROM cores",
)
def core_distance(spark: SparkSession, sf: str) -> DataFrame:
    members, points = _text_points(spark, sf)
    cores = density.core_distances(points, MIN_SAMPLES)
    return members.join(cores.withColumnRenamed("id", "rep"), "rep").select(
        "doc_id", "lang", F.round("core", 6).alias("core")
    )


def _tree(spark: SparkSession, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    cores = materialize(density.core_distances(points, MIN_SAMPLES))
    edges = materialize(density.reachability_forest(points, cores))
    return cores, density.tree_edges(density.boruvka(edges), edges)


# Prim's algorithm as a recursive query: each step adds the nearest document of every language
@query(
    "spanning_tree",
    f"""WITH RECURSIVE {_DISTANCES},
        weighed AS MATERIALIZED (
          SELECT p.a, p.b, greatest(p.d, x.core, y.core) AS w FROM pairs p
          JOIN cores x ON x.doc_id = p.a JOIN cores y ON y.doc_id = p.b),
        tree(doc_id, lang, best, inside) USING KEY (doc_id) AS (
          SELECT doc_id, lang, (CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY lang) THEN 0 ELSE 9 END)::DOUBLE, false
          FROM documents
          UNION
          SELECT r.doc_id, r.lang, CASE WHEN r.doc_id = p.next THEN r.best ELSE w.w END, r.doc_id = p.next
          FROM (SELECT lang, arg_min(doc_id, (best, doc_id)) AS next FROM recurring.tree WHERE NOT inside GROUP BY lang) p
          JOIN recurring.tree r ON r.lang = p.lang AND NOT r.inside
          LEFT JOIN weighed w ON w.a = p.next AND w.b = r.doc_id
          WHERE r.doc_id = p.next OR w.w < r.best)
        SELECT lang, count(*) - 1 AS edges, round(sum(best), 4) AS total FROM tree GROUP BY lang""",
)
def spanning_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Weight of the minimum spanning tree under mutual reachability, per language.

    The copies of a text join each other at its core distance.
    """
    _, points = _text_points(spark, sf)
    cores, tree = _tree(spark, points)
    inside = points.where("mult > 1").join(cores.select("id", "core"), "id").select(
        "part", ((F.col("mult") - 1) * F.col("core")).alias("w"), (F.col("mult") - 1).alias("n")
    )
    return tree.select("part", "w", F.lit(1).cast("long").alias("n")).union(inside).groupBy(
        F.col("part").alias("lang")
    ).agg(F.sum("n").alias("edges"), F.round(F.sum("w"), 4).alias("total"))


@query(
    "density_components",
    f"""WITH RECURSIVE {_DISTANCES},
        close AS (SELECT p.a, p.b FROM pairs p JOIN cores x ON x.doc_id = p.a JOIN cores y ON y.doc_id = p.b
                  WHERE greatest(p.d, x.core, y.core) <= {EPS}),
        reach(doc_id, label) USING KEY (doc_id) AS (
          SELECT doc_id, doc_id FROM documents
          UNION
          SELECT c.b, min(r.label) FROM reach r JOIN close c ON c.a = r.doc_id
            JOIN recurring.reach old ON old.doc_id = c.b
          WHERE r.label < old.label GROUP BY c.b)
        SELECT doc_id, label FROM reach""",
)
def density_components(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents that are connected at mutual reachability up to ``EPS``.

    The spanning tree cut at that weight gives the same groups as all pairs. Copies of a text are
    connected once their core distance is within ``EPS``; otherwise each stands alone.
    """
    members, points = _text_points(spark, sf)
    cores, tree = _tree(spark, points)
    edges = tree.where(F.col("w") <= EPS).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = graph.connected(points.select(F.col("id").alias("domain")), edges)
    linked = groups.join(cores.select(F.col("id").alias("domain"), "core"), "domain").select(
        F.col("domain").alias("rep"), "root", (F.col("core") <= EPS).alias("linked")
    )
    return members.join(linked, "rep").select(
        "doc_id", F.when(F.col("linked"), F.col("root")).otherwise(F.col("doc_id")).alias("label")
    )


@query(
    "cluster_mean_distance",
    f"""WITH {_DISTANCES}
        SELECT d.lang, d.n_chars % 5 AS label, round(coalesce(any_value(s.total), 0) / count(*) / count(*), 6) AS mean_distance
        FROM documents d LEFT JOIN (SELECT lang, na % 5 AS label, sum(d) AS total FROM pairs
                                    WHERE na % 5 = nb % 5 GROUP BY ALL) s
          ON s.lang = d.lang AND s.label = d.n_chars % 5
        GROUP BY d.lang, d.n_chars % 5""",
)
def cluster_mean_distance(spark: SparkSession, sf: str) -> DataFrame:
    _, points = _text_points(spark, sf)
    sizes = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), (F.col("n_chars") % 5).alias("label")
    )
    means = density.mean_distances(points.join(sizes, "id"))
    return means.select(
        F.col("part").alias("lang"), "label", F.round("mean_distance", 6).alias("mean_distance")
    )


def _vector_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.lit("all").alias("part"),
        F.col("vec_id").alias("id"),
        F.lit(1).cast("long").alias("mult"),
        F.sequence(F.lit(0).cast("long"), F.size("embedding").cast("long") - 1).alias("idx"),
        F.col("embedding").cast("array<double>").alias("val"),
        "label",
    )


_VECTOR_PAIRS = """
    SELECT x.vec_id AS a, y.vec_id AS b, x.label AS la, y.label AS lb,
           list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS d
    FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id"""


@query(
    "nearest_vectors",
    f"""SELECT a AS vec_id, b AS other, round(d, 6) AS dist FROM (
          SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM ({_VECTOR_PAIRS})) WHERE r <= 10""",
)
def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return density.nearest(_vector_points(spark, sf), MIN_SAMPLES).select(
        F.col("id").alias("vec_id"), "other", F.round("dist", 6).alias("dist")
    )


@query(
    "core_distance_vectors",
    f"""SELECT a AS vec_id, round(max(d), 6) AS core FROM (
          SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM ({_VECTOR_PAIRS})) WHERE r <= 10
        GROUP BY a""",
)
def core_distance_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return density.core_distances(_vector_points(spark, sf), MIN_SAMPLES).select(
        F.col("id").alias("vec_id"), F.round("core", 6).alias("core")
    )


@query(
    "mean_distance_vectors",
    f"""SELECT e.label, round(coalesce(any_value(total), 0) / count(*) / count(*), 6) AS mean_distance
        FROM embeddings e LEFT JOIN (SELECT la AS label, sum(d) AS total FROM ({_VECTOR_PAIRS})
                                     WHERE la = lb GROUP BY la) USING (label) GROUP BY e.label""",
)
def mean_distance_vectors(spark: SparkSession, sf: str) -> DataFrame:
    points = _vector_points(spark, sf).withColumn("label", F.col("label").cast("long"))
    return density.mean_distances(points).select(
        "label", F.round("mean_distance", 6).alias("mean_distance")
    )


# The labels in recursive SQL, from lb_points (id, part, mult, core) and lb_pairs (part, a, b, d, ca, cb): the minimum
# spanning tree by Prim's algorithm in the order (w, lo, hi); its edges merged one by one (kind 0: the next
# merge of a part, 1: a point with its component and the cluster and distance at which it falls out, 2: a
# cluster that becomes part of another); and the selection by stability, from the innermost clusters outwards.
_LABELS = """
    names AS (SELECT id, part, mult, core, row_number() OVER (ORDER BY id) AS n FROM lb_points),
    weighed AS MATERIALIZED (
      SELECT x.part, x.n AS a, y.n AS b, greatest(p.d, p.ca, p.cb) AS w
      FROM lb_pairs p JOIN names x ON x.id = p.a JOIN names y ON y.id = p.b),
    tree(n, part, w, lo, hi, inside) USING KEY (n) AS (
      SELECT n, part, (CASE WHEN n = min(n) OVER (PARTITION BY part) THEN -1 ELSE 9 END)::DOUBLE, n, n, false FROM names
      UNION
      SELECT r.n, r.part, CASE WHEN r.n = p.next THEN r.w ELSE e.w END, CASE WHEN r.n = p.next THEN r.lo ELSE least(r.n, p.next) END,
        CASE WHEN r.n = p.next THEN r.hi ELSE greatest(r.n, p.next) END, r.n = p.next
      FROM (SELECT part, arg_min(n, (w, lo, hi)) AS next FROM recurring.tree WHERE NOT inside GROUP BY part) p
      JOIN recurring.tree r ON r.part = p.part AND NOT r.inside
      LEFT JOIN weighed e ON e.a = p.next AND e.b = r.n
      WHERE r.n = p.next OR (e.w, least(r.n, p.next), greatest(r.n, p.next)) < (r.w, r.lo, r.hi)),
    steps AS MATERIALIZED (
      SELECT part, w, lo, hi, row_number() OVER (PARTITION BY part ORDER BY w, lo, hi) AS s FROM tree WHERE w >= 0),
    merged(kind, part, n, root, size, cl, fell, at_w) USING KEY (kind, part, n) AS (
      SELECT 1, part, n, n, mult::BIGINT, own, own, CASE WHEN own IS NOT NULL THEN core END
      FROM (SELECT *, CASE WHEN mult >= {m} AND core < (SELECT min(w) FROM weighed e WHERE e.a = names.n) THEN -n END AS own FROM names)
      UNION ALL
      SELECT DISTINCT 0, part, 0::BIGINT, 1::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM names
      UNION
      (WITH here AS (
         SELECT e.part, e.s, e.w, x.root AS rx, y.root AS ry, x.size AS sx, y.size AS sy, x.cl AS cx, y.cl AS cy,
           CASE WHEN x.cl IS NOT NULL AND y.cl IS NOT NULL THEN e.s ELSE coalesce(x.cl, y.cl, CASE WHEN x.size + y.size >= {m} THEN e.s END) END AS cl
         FROM merged g JOIN steps e ON g.kind = 0 AND e.part = g.part AND e.s = g.root
         JOIN recurring.merged x ON x.kind = 1 AND x.part = e.part AND x.n = e.lo
         JOIN recurring.merged y ON y.kind = 1 AND y.part = e.part AND y.n = e.hi)
       SELECT 0, part, 0, s + 1, NULL, NULL, NULL, NULL FROM here
       UNION ALL
       SELECT 1, h.part, x.n, -h.s, sx + sy, h.cl, CASE WHEN x.cl IS NULL THEN h.cl ELSE x.fell END,
         CASE WHEN x.cl IS NULL AND h.cl IS NOT NULL THEN h.w ELSE x.at_w END
       FROM here h JOIN recurring.merged x ON x.kind = 1 AND x.part = h.part AND x.root IN (h.rx, h.ry)
       UNION ALL
       SELECT 2, part, cx, s, sx, NULL, NULL, w FROM here WHERE cx IS NOT NULL AND cy IS NOT NULL
       UNION ALL
       SELECT 2, part, cy, s, sy, NULL, NULL, w FROM here WHERE cx IS NOT NULL AND cy IS NOT NULL)),
    masses AS (
      SELECT part, c, sum(k / greatest(w, 1e-12)) AS mass, sum(k) AS size FROM (
        SELECT part, fell AS c, mult AS k, at_w AS w FROM merged JOIN names USING (part, n) WHERE kind = 1 AND fell IS NOT NULL
        UNION ALL SELECT part, root, size, at_w FROM merged WHERE kind = 2) GROUP BY part, c),
    clusters AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY x.part, x.c) AS i, x.part, x.c, k.root AS up,
        mass - x.size * coalesce(1 / greatest(k.at_w, 1e-12), 0) AS own
      FROM masses x LEFT JOIN merged k ON k.kind = 2 AND k.part = x.part AND k.n = x.c),
    ups AS MATERIALIZED (
      SELECT c.i, c.part, c.c, c.own, p.i AS up FROM clusters c LEFT JOIN clusters p ON p.part = c.part AND p.c = c.up),
    sums(i, inside) USING KEY (i) AS (
      SELECT i, 0::DOUBLE FROM ups UNION ALL SELECT 0, 1::DOUBLE
      UNION
      (WITH here AS (SELECT u.i, u.up, greatest(u.own, x.inside) AS worth FROM sums z JOIN ups u ON z.i = 0 AND u.i = z.inside
                     JOIN recurring.sums x ON x.i = u.i)
       SELECT 0, i + 1 FROM here
       UNION ALL
       SELECT h.up, x.inside + h.worth FROM here h JOIN recurring.sums x ON x.i = h.up)),
    chosen(i, top) AS (
      SELECT i, NULL::BIGINT FROM ups WHERE up IS NULL
      UNION ALL
      SELECT u.i, coalesce(t.top, CASE WHEN u.own >= s.inside THEN u.i END)
      FROM chosen t JOIN ups u ON u.up = t.i JOIN sums s ON s.i = u.i),
    inside_ AS (
      SELECT m.part, m.n, x.mult, h.top FROM merged m JOIN names x ON x.n = m.n JOIN ups u ON u.part = m.part AND u.c = m.fell JOIN chosen h ON h.i = u.i
      WHERE m.kind = 1 AND h.top IS NOT NULL),
    numbers AS (
      SELECT part, top, row_number() OVER (PARTITION BY part ORDER BY sum(mult) DESC, min(n)) - 1 AS label FROM inside_ GROUP BY part, top),
    labels AS (
      SELECT x.id, x.part, coalesce(k.label, -1) AS label
      FROM names x LEFT JOIN inside_ j ON j.n = x.n LEFT JOIN numbers k ON k.part = j.part AND k.top = j.top)"""


def _labels(min_size: int) -> str:
    return _LABELS.replace("{m}", str(min_size))


@query(
    "hdbscan",
    f"""WITH RECURSIVE gaps AS MATERIALIZED (SELECT a, b, round(d, 12) AS d FROM ({_VECTOR_PAIRS})),
        cores AS (SELECT a AS id, max(d) AS core FROM (
                    SELECT *, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM gaps) WHERE r <= 5 GROUP BY a),
        lb_points AS (SELECT vec_id AS id, 'all' AS part, 1 AS mult, core FROM embeddings JOIN cores ON id = vec_id),
        lb_pairs AS (SELECT 'all' AS part, a, b, d, x.core AS ca, y.core AS cb
                     FROM gaps JOIN cores x ON x.id = a JOIN cores y ON y.id = b),
        {_labels(5)}
        SELECT id AS vec_id, label FROM labels""",
)
def hdbscan(spark: SparkSession, sf: str) -> DataFrame:
    labels = density.hdbscan(_vector_points(spark, sf), min_cluster_size=5)
    return labels.select(F.col("id").alias("vec_id"), "label")


def _crawled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as successfully crawled pages of one domain each."""
    return table(spark, sf, "documents", spread=True).select(
        F.concat(F.lit("d"), "doc_id").alias("domain"), F.col("text").alias("main"), "lang",
        F.to_timestamp(F.lit(LOAD_TIME)).alias("last_successful_scrape_date"),
    )


def _recluster_oracle(crawled: str, min_size: int) -> str:
    """Clusters of the pages in ``crawled`` (domain, main, lang); the copies of a text are one weighted point."""
    samples = _DISTANCES.replace("r <= 10", f"r <= {min_size}").replace("FROM documents", "FROM pool")
    return f"""WITH RECURSIVE crawled AS ({crawled}),
        pool AS (SELECT domain AS doc_id, main AS text, lang, 0 AS n_chars FROM crawled WHERE length(lang) < 10),
        {samples},
        reps AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY lang, lower(text)) AS rep FROM pool),
        lb_points AS (SELECT rep AS id, any_value(r.lang) AS part, count(*) AS mult, round(coalesce(any_value(core), 0), 12) AS core
                      FROM reps r LEFT JOIN cores c USING (doc_id) GROUP BY rep),
        lb_pairs AS (SELECT p.lang AS part, a, b, round(d, 12) AS d, x.core AS ca, y.core AS cb
                     FROM pairs p JOIN lb_points x ON x.id = a JOIN lb_points y ON y.id = b),
        {_labels(min_size)},
        doc_labels AS (SELECT doc_id AS id, part, label FROM reps JOIN labels l ON l.id = rep),
        failed AS (SELECT lang FROM pool WHERE lang NOT IN (SELECT lang FROM weights)),
        means AS (
          SELECT part, label, coalesce(any_value(total), 0) / count(*) / count(*) AS mean_distance
          FROM doc_labels LEFT JOIN (SELECT x.part, x.label, sum(d) AS total FROM pairs JOIN doc_labels x ON x.id = a
                                     JOIN doc_labels y ON y.id = b AND y.label = x.label GROUP BY ALL) USING (part, label)
          WHERE label >= 0 GROUP BY part, label)
        SELECT domain, c.lang,
               CASE WHEN f.lang IS NOT NULL THEN concat(c.lang, '-clustering-failed')
                    WHEN l.id IS NOT NULL THEN concat(c.lang, label) END AS cluster,
               CASE WHEN f.lang IS NULL THEN round(mean_distance, 6) END AS mean_distance
        FROM crawled c LEFT JOIN doc_labels l ON l.id = c.domain LEFT JOIN means m USING (part, label)
             LEFT JOIN (SELECT DISTINCT lang FROM failed) f ON f.lang = c.lang"""


_DOCUMENTS_CRAWLED = "SELECT concat('d', doc_id) AS domain, text AS main, lang FROM documents WHERE text IS NOT NULL"


@query("recluster", _recluster_oracle(_DOCUMENTS_CRAWLED, 10))
def recluster(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(run_recluster(_crawled_documents(spark, sf)))


@query("recluster_small", _recluster_oracle(_DOCUMENTS_CRAWLED, 3))
def recluster_small(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of three and more, which the test documents do have."""
    return _rounded(run_recluster(_crawled_documents(spark, sf), min_cluster_size=3))


@query("recluster_planted", _recluster_oracle(
    "SELECT domain, main, lang FROM fx_crawled WHERE last_successful_scrape_date IS NOT NULL AND main IS NOT NULL", 10
))
def recluster_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Real clusters of near copies among noise, a language that fails, unusable languages and unread pages."""
    return _rounded(run_recluster(view(spark, sf, "fx_crawled")))

"""Input views in the shape of the engine's tables, derived from the given tables as a whole.

The texts run unchanged in Spark SQL and in DuckDB, so queries and their SQL checks share them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from webweave.sources.tables import read_table

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_URL = "'(https?://)(wwww?[0-9]?.)?([^/?]*)/?([^?]*)[?]?(.*)'"


def _part(i: int) -> str:
    return f"nullif(trim(regexp_extract(url, {_URL}, {i})), '')"


VIEWS = {
    "fx_backlinks": f"""
        SELECT page_id, url AS referring_page_url,
               concat('https://target', CAST(page_id % 7 AS STRING), '.example.com/') AS link_url,
               CASE WHEN page_id % 3 <> 0 THEN concat('anchor ', CAST(page_id % 11 AS STRING)) END AS link_anchor,
               CASE WHEN page_id % 4 = 0 THEN 'Lost' END AS backlink_status,
               CAST(DATE '2020-01-01' + CAST(page_id % 400 AS INT) AS TIMESTAMP) AS first_seen,
               {_part(1)} AS url_https, {_part(2)} AS url_www, {_part(3)} AS url_main
        FROM pages""",
    # a registered domain is known once two of its pages link
    "fx_domains": """
        SELECT referring_domain, CAST(length(referring_domain) * 7 % 100 AS DOUBLE) AS domain_rating,
               CASE WHEN length(referring_domain) % 5 <> 0 THEN n * 13 END AS organic_traffic,
               first_seen, CAST(DATE '2024-01-01' + CAST(n % 3 AS INT) AS TIMESTAMP) AS last_updated
        FROM (SELECT regexp_extract(url_main, '[^.]+[.][^.]+[.][^.]+$', 0) AS referring_domain,
                     count(*) AS n, min(first_seen) AS first_seen
              FROM fx_backlinks GROUP BY 1) AS d
        WHERE n >= 2""",
    # every page answers; the links of page p get one absolute link to another page of the table
    "fx_responses": f"""
        SELECT p.page_id, p.url, {_part(3).replace('url', 'p.url', 1)} AS domain,
               CASE WHEN p.page_id % 10 = 0 THEN NULL WHEN p.page_id % 10 = 1 THEN 404 ELSE 200 END AS status_code,
               CASE WHEN p.page_id % 10 = 0 THEN 'timeout' END AS request_error,
               CAST(DATE '2024-05-01' + CAST(p.page_id % 30 AS INT) AS TIMESTAMP) AS fetched_at,
               CASE WHEN p.page_id % 10 > 1 THEN
                 replace(replace(replace(replace(replace(p.html,
                   'href="/', 'href="https://'),
                   '<nav>', '<header><a href="https://header.example.com/">h</a></header><nav>'),
                   '<footer>', '<footer><a href="https://footer.example.com/">f</a>'),
                   '<article>', concat(CASE WHEN p.page_id % 4 = 3 THEN '<main>' ELSE '' END,
                                       '<article><a href="', q.url, '">x</a><a href="/relative">r</a>')),
                   '</article>', concat('</article>', CASE WHEN p.page_id % 4 = 3 THEN '</main>' ELSE '' END))
               END AS html
        FROM (SELECT *, (page_id * 31 + 17) % (SELECT count(*) FROM pages) AS other FROM pages) AS p
        JOIN pages q ON q.page_id = p.other""",
    "fx_edges_small": """
        SELECT DISTINCT a.url_main AS src, b.url_main AS dst
        FROM (SELECT url_main, (page_id * 31 + 17) % (SELECT count(*) FROM pages) AS other
              FROM fx_backlinks) AS a
        JOIN fx_backlinks b ON b.page_id = a.other
        WHERE a.url_main <> b.url_main""",
    "fx_edges_large": """
        SELECT concat('o', CAST(o_orderkey AS STRING)) AS src, concat('c', CAST(o_custkey AS STRING)) AS dst
        FROM orders
        UNION ALL
        SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)) FROM supplier
        UNION ALL
        SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM nation""",
    "fx_clusters": """
        SELECT concat('d', CAST(doc_id AS STRING)) AS domain, lang,
               CASE WHEN doc_id % 9 = 8 THEN NULL WHEN doc_id % 9 = 7 THEN concat(lang, '-1')
                    ELSE concat(lang, CAST(doc_id % 9 AS STRING)) END AS cluster,
               CASE WHEN doc_id % 9 < 7 THEN CAST(doc_id % 9 AS DOUBLE) / 8 END AS mean_distance,
               n_chars % 50 AS live_backlinks, n_chars % 50 + doc_id % 5 AS total_backlinks,
               CASE WHEN doc_id % 6 <> 0 THEN CAST(n_chars % 90 AS DOUBLE) END AS domain_rating,
               CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS organic_traffic,
               CASE WHEN doc_id % 8 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS TIMESTAMP) END AS last_updated
        FROM documents""",
    # the crawl table: one row per known domain that backlinks point from
    "fx_scraped": """
        SELECT d.referring_domain AS domain,
               count(*) AS total_backlinks,
               sum(CASE WHEN b.backlink_status IS NULL THEN 1 ELSE 0 END) AS live_backlinks,
               sum(CASE WHEN b.url_www = 'www.' THEN 1 ELSE 0 END) AS url_www,
               sum(CASE WHEN b.url_https = 'https://' THEN 1 ELSE 0 END) AS url_https,
               min(b.first_seen) AS first_seen,
               CASE WHEN count(*) % 3 = 0 THEN CAST(DATE '2024-03-01' AS TIMESTAMP) END AS last_scrape_date,
               CASE WHEN count(*) % 6 = 0 THEN CAST(DATE '2024-03-01' AS TIMESTAMP)
                    WHEN count(*) % 4 = 0 THEN CAST(DATE '2024-02-01' AS TIMESTAMP) END AS last_successful_scrape_date
        FROM fx_backlinks b JOIN fx_domains d
          ON regexp_extract(b.url_main, '[^.]+[.][^.]+[.][^.]+$', 0) = d.referring_domain
        GROUP BY d.referring_domain""",
}


def _near_copy(n: int) -> str:
    return f"""
        SELECT concat('p', CAST(doc_id AS STRING), 'x{n}') AS domain, concat(text, ' extra{n} extra{(n + 1) % 15}') AS main,
               lang, CAST(DATE '2024-05-01' AS TIMESTAMP) AS last_successful_scrape_date
        FROM documents WHERE doc_id % 40 = 3 AND n_chars BETWEEN 500 AND 4000"""


# crawled pages: the documents, fifteen near copies of some, and pages that cannot be clustered
VIEWS["fx_crawled"] = """
        SELECT concat('d', CAST(doc_id AS STRING)) AS domain,
               CASE WHEN doc_id % 50 = 9 THEN NULL ELSE text END AS main,
               CASE WHEN doc_id % 50 = 7 THEN 'Can''t detect language - no text, or langdetect not installed'
                    WHEN doc_id % 50 = 8 THEN NULL
                    WHEN doc_id % 50 = 6 THEN concat('x', CAST(doc_id AS STRING)) ELSE lang END AS lang,
               CASE WHEN doc_id % 50 <> 10 THEN CAST(DATE '2024-05-01' AS TIMESTAMP) END AS last_successful_scrape_date
        FROM documents""" + "".join(f" UNION ALL {_near_copy(n)}" for n in range(15))


def needed(*names: str) -> list[str]:
    """The views that the given ones build on, in order, the given ones included."""
    found: list[str] = []

    def visit(name: str) -> None:
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                visit(other)
        if name not in found:
            found.append(name)

    for name in names:
        visit(name)
    return found


def with_views(body: str) -> str:
    """SQL with the views it names as common table expressions."""
    names = needed(*[v for v in VIEWS if re.search(rf"\b{v}\b", body)])
    if not names:
        return body
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if body.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, " + body.lstrip()[len("WITH RECURSIVE "):]
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes}, " + body.lstrip()[len("WITH "):]
    return f"WITH {ctes} {body}"


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A given table; ``spread`` deals its rows out to all cores."""
    cores = spark.sparkContext.defaultParallelism if spread else None
    return read_table(spark, f"{sf_dir}/{name}.parquet", cores)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views, or a base table, as a DataFrame."""
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    for other in needed(name):
        for base in BASE_TABLES:
            if re.search(rf"\b{base}\b", VIEWS[other]):
                # pages are parsed row by row, so their rows are dealt out to all cores first
                spread = base == "pages" and other == "fx_responses"
                table(spark, sf_dir, base, spread).createOrReplaceTempView(base)
        df = spark.sql(VIEWS[other])
        if other == name:
            return df
        df.createOrReplaceTempView(other)
    raise KeyError(name)

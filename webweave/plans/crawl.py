"""The crawl as data: queue, candidates, captured responses, extraction, results, new queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweave.operators import crawl as ops
from webweave.operators.language import detect_language
from webweave.session import materialize


def crawl_results(
    scraped: DataFrame,
    responses: DataFrame,
    domains: DataFrame,
    language_model: DataFrame,
    condition: str = ops.NEVER_SCRAPED,
    mode: str = "last",
) -> DataFrame:
    """Result rows for the domains that the condition selects, in crawl-table columns.

    Extraction runs once; its rows are stored because links and language both start from them.
    """
    queue = ops.crawl_queue(scraped, condition)
    picked = ops.pick_response(ops.candidates(queue), responses, mode)
    pages = materialize(ops.extract_pages(picked))
    known = ops.known_links(pages, domains)
    texts = pages.where("url IS NOT NULL AND parse_error IS NULL").select(
        "domain", F.coalesce("main", F.lit("")).alias("main")
    )
    languages = detect_language(texts, language_model, "domain", "main")
    success = F.col("url").isNotNull() & F.col("parse_error").isNull()
    rows = (
        pages.join(known, "domain", "left")
        .join(languages.select("domain", "lang"), "domain", "left")
        .withColumns({
            "last_successful_scrape_date": F.when(success, F.col("last_scrape_date")),
            "last_scrape_parse_error": F.col("parse_error"),
            "html": F.col("html").cast("binary"),
        })
        .drop("url", "title", "parse_error")
    )
    return ops.utf8_guard(rows)


def crawl(
    scraped: DataFrame,
    responses: DataFrame,
    domains: DataFrame,
    language_model: DataFrame,
    condition: str = ops.NEVER_SCRAPED,
    mode: str = "last",
) -> DataFrame:
    """Crawl table after applying the captured responses to the selected domains."""
    results = crawl_results(scraped, responses, domains, language_model, condition, mode)
    return ops.apply_scrape(scraped, results)

"""Fixed schemas of the stored tables; extra export columns pass through as strings."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B, _TS, _I = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.IntegerType(),
)
_STRINGS = T.ArrayType(_S)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


BACKLINKS = _struct(
    referring_page_url=_S, link_url=_S, link_anchor=_S, backlink_status=_S, first_seen=_TS,
    last_check=_TS, day_lost=_TS, live=_B, link_type=_S, last_updated=_TS, url_main=_S,
)
DOMAINS = _struct(
    referring_domain=_S, domain_rating=_D, organic_traffic=_L, first_seen=_TS, last_updated=_TS,
)
URL_MATCHES = _struct(url_main=_S, matching_domain=_S, match_error=_S)
SCRAPED_DOMAINS = _struct(
    domain=_S, total_backlinks=_L, live_backlinks=_L, url_www=_L, url_https=_L, first_seen=_TS,
    last_scrape_date=_TS, last_successful_scrape_date=_TS, last_scrape_code=_I,
    last_scrape_request_error=_S, last_scrape_parse_error=_S, lang=_S, html=T.BinaryType(), main=_S,
    links=_STRINGS, links_main_domains=_STRINGS, links_known_domains=_STRINGS,
)
CLUSTERS = _struct(domain=_S, lang=_S, cluster=_S, mean_distance=_D)

BACKLINK_KEYS = ["referring_page_url", "link_url", "first_seen"]
DOMAIN_KEYS = ["referring_domain"]
URL_MATCH_KEYS = ["url_main"]
SCRAPED_KEYS = ["domain"]
CLUSTER_KEYS = ["domain"]

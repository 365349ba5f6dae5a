"""URL columns: splitting, hosts, suffixes and crawl candidates, all as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two URL patterns. (?d) lets '.' stop at '\n' only; \p{Nd} is any decimal digit.
SPLIT_PATTERN = r"(?d)(https?://)(wwww?\p{Nd}?.)?([^/?]*)/?([^?]*)[?]?(.*)"
HOST_PATTERN = r"(?d)^(https?://)(www.)?([^/]*)"
WWW = "www."
HTTPS = "https://"
HTTP = "http://"

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_PARTS = ("scheme", "www", "host", "path", "params")


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, _EDGE_SPACE, "")


def clean_link(col: Column) -> Column:
    """Double each backslash, the form a text bulk load un-escapes again."""
    return F.replace(col, F.lit("\\"), F.lit("\\\\"))


def _unquoted(col: Column) -> Column:
    tail = F.substring(col, 2, 2147483647)
    closed = F.when(
        tail.endswith('"'), F.substring(tail, F.lit(1), F.length(tail) - 1)
    ).otherwise(tail)
    return F.when(col.startswith('"'), closed).otherwise(col)


def split_url(col: Column) -> Column:
    """Struct of scheme, www, host, path, params and error.

    Fields that a query does not use are never computed: the optimizer takes single fields straight
    out of the struct expression.
    """
    text = strip(_unquoted(col))
    fields = [
        F.nullif(strip(F.regexp_extract(text, SPLIT_PATTERN, i + 1)), F.lit("")).alias(name)
        for i, name in enumerate(_PARTS)
    ]
    error = F.when(col.isNull(), F.lit("missing url")).when(
        ~F.rlike(text, F.lit("https?://")), F.lit("no http scheme in url")
    )
    return F.struct(*fields, error.alias("error"))


def url_main(col: Column) -> Column:
    """Host of a page link; null where the link does not start with an http scheme."""
    return F.when(F.rlike(col, F.lit("^https?://")), F.regexp_extract(col, HOST_PATTERN, 3))


def host_suffixes(col: Column) -> Column:
    """All suffixes of a host that still hold a dot, longest first."""
    labels = F.split(col, "[.]")
    count = F.size(labels)
    return F.when(
        count > 1,
        F.transform(
            F.sequence(F.lit(0), count - 2),
            lambda i: F.concat_ws(".", F.slice(labels, i + 1, count - i)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def candidate_urls(domain: Column, https: Column, www: Column, total: Column) -> Column:
    """Ordered URLs to try for a domain: www forms before bare ones, https before http."""
    secure = F.when(https > 0, F.lit(HTTPS))
    plain = F.when(https < total, F.lit(HTTP))
    forms = [
        F.when(condition, F.concat(scheme, F.lit(prefix), domain))
        for condition, prefix in ((www > 0, WWW), (www < total, ""))
        for scheme in (secure, plain)
    ]
    return F.filter(F.array(*forms), lambda url: url.isNotNull())

"""Tables: ad-hoc SQL, keyed storage (``store``) and the encoded form of the crawl table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webweave.sources.store import KeyViolation, read_stored, replace_table, upsert_table

__all__ = [
    "KeyViolation", "export_crawl_table", "import_crawl_table", "read_stored", "read_table", "replace_table", "sql",
    "upsert_table",
]

# The columns that the encoded crawl table stores as base64.
TEXT_COLUMNS = ("html", "main")
LIST_COLUMNS = ("links", "links_main_domains", "links_known_domains")


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Read a stored table, dealt out to so many partitions if a number is given and fewer are read.

    The number is for CPU-heavy work on a table whose few files would leave most cores idle.
    """
    df = spark.read.parquet(path)
    return df if partitions is None or df.rdd.getNumPartitions() >= partitions else df.repartition(partitions)


def sql(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """Run SQL in which ``{name}`` stands for a DataFrame given by that name."""
    return spark.sql(text, **views)


def _decoded(col: Column) -> Column:
    return F.decode(F.unbase64(col), "UTF-8")


def _encoded(col: Column) -> Column:
    # Spark breaks base64 into lines of 76 characters; the stored form is one line
    return F.translate(F.base64(F.encode(col, "UTF-8")), "\r\n", "")


def import_crawl_table(df: DataFrame) -> DataFrame:
    """Decode base64 texts and base64 JSON lists into strings and arrays; null cells stay null."""
    columns = {c: _decoded(F.col(c)) for c in TEXT_COLUMNS if c in df.columns}
    columns |= {
        c: F.from_json(_decoded(F.col(c)), "array<string>") for c in LIST_COLUMNS if c in df.columns
    }
    return df.withColumns(columns)


def export_crawl_table(df: DataFrame) -> DataFrame:
    """The inverse of ``import_crawl_table``."""
    columns = {c: _encoded(F.col(c).cast("string")) for c in TEXT_COLUMNS if c in df.columns}
    columns |= {c: _encoded(F.to_json(F.col(c))) for c in LIST_COLUMNS if c in df.columns}
    return df.withColumns(columns)

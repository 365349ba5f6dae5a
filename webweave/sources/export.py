"""Reader of crawler exports: UTF-16, tab separated, quoted, with a header line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The export format.
ENCODING = "UTF-16LE"
SEPARATOR = "\t"


def read_export(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    multiline: bool = False,
    encoding: str = ENCODING,
) -> DataFrame:
    """Read one or more export files as strings.

    The line-based form splits large files over tasks. ``multiline`` is for exports whose quoted
    fields hold line breaks; a file is then read by one task, so split such exports into files.
    ``encoding`` is ``UTF-16LE`` or ``UTF-16BE``; a file in another byte order than stated raises.
    Lines may end in CR and LF: the CR is taken off the last name and value.
    """
    options = {"sep": SEPARATOR, "header": True, "quote": '"', "escape": '"'}
    if multiline:
        options |= {"encoding": "UTF-16", "multiLine": True}
    else:
        options |= {"encoding": encoding, "lineSep": "\n"}
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.csv(path)
    if any(ord(c) >= 0x3000 or c == "\0" for name in rows.columns for c in name.removeprefix("\ufeff")):
        raise ValueError(f"the header is not readable as {encoding}: {rows.columns[0][:20]!r}")
    return without_returns(rows)


def without_returns(rows: DataFrame) -> DataFrame:
    """Rows without the CR of a line's end in the last column and its name."""
    *others, last = rows.columns
    return rows.withColumn(last, F.regexp_replace(F.col(f"`{last}`"), "\r$", "")).toDF(*others, last.rstrip("\r"))

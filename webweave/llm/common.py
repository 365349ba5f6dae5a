"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webweave.session import materialize

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) only, so that no other column can clash; a null text is the empty text."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def plain_names(rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names that clash with nothing, and the new name of each column."""
    renamed = rows.toDF(*(f"d_{i}" for i in range(len(rows.columns))))
    return renamed, dict(zip(rows.columns, renamed.columns))


def with_ids(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is in the one column of ``ids``; a null id is one of its own."""
    renamed, at = plain_names(rows)
    kept = renamed.join(ids.toDF("_id"), F.col(at[id_col]).cast("long").eqNullSafe(F.col("_id")), "left_semi")
    return kept.toDF(*rows.columns)


class Memory:
    """What a worker remembers of pieces of text: the last ones used, in two generations of ``most``."""

    def __init__(self, most: int) -> None:
        self.most, self.now, self.before = most, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that are not known; all others are in ``now`` after this."""
        new = keys.difference(self.now)
        if len(self.now) + len(new) > self.most:
            self.before, self.now, new = self.now, {}, keys
        old = new & self.before.keys()
        self.now.update((key, self.before[key]) for key in old)
        return list(new - old)


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle has in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Spark deletes the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``materialize``, and the shuffles behind the table are deleted once it is written.

    Otherwise Spark deletes them when the driver's garbage collector has found their plans unused, and
    a chain of large shuffles holds those of one table until another is written.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return materialize(df)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)

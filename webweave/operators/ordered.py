"""Running aggregates and exact medians over ordered groups of any size.

A window over a whole group sends the group to one task. Here the rows are range-partitioned by
group and order instead, each slice is scanned on its own, and one small row per slice carries the
running value from slice to slice. A group that holds most of the rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webweave.session import materialize


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], **specs: tuple[str, str]
) -> DataFrame:
    """Add running aggregates, each given as ``name=(kind, column)``.

    Kinds: ``sum``, and ``last`` for the last non-null value up to and including the row. ``order``
    must be unique within ``keys``; keys must not be null.
    """
    keys, order = list(keys), list(order)
    sliced = materialize(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    position = F.struct(*order)

    def total(kind: str, column: str) -> Column:
        if kind == "sum":
            return F.sum(column)
        return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), position))

    def combined(kind: str, column: str, window: Window) -> Column:
        return F.sum(column).over(window) if kind == "sum" else F.last(column, True).over(window)

    totals = sliced.groupBy(*keys, "_slice").agg(
        *[total(kind, column).alias(f"_{name}") for name, (kind, column) in specs.items()]
    )
    # at most one row per slice and group; only groups that cross slices need a carry
    slices = Window.partitionBy(*keys).orderBy("_slice")
    before = slices.rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *keys,
        "_slice",
        F.row_number().over(slices).alias("_nth"),
        *[combined(kind, f"_{name}", before).alias(f"_{name}") for name, (kind, _) in specs.items()],
    ).where("_nth > 1").drop("_nth")

    inside = Window.partitionBy("_slice", *keys).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = {}
    for name, (kind, column) in specs.items():
        own = combined(kind, column, inside)
        if kind == "sum":
            values[name] = own + F.coalesce(F.col(f"_{name}"), F.lit(0))
        else:
            values[name] = F.coalesce(own, F.col(f"_{name}"))
    joined = sliced.join(carries, [*keys, "_slice"], "left")
    return joined.withColumns(values).drop("_slice", *[f"_{name}" for name in specs])


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number all rows 0, 1, … in a unique order without gathering them in one task."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), [], order, **{name: ("sum", "_one")}) \
        .withColumn(name, F.col(name) - 1).drop("_one")


def group_medians(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Exact medians of ``cols`` per ``key``, nulls skipped, as one row per key."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in cols])
    )
    counts = (
        df.where(F.col(key).isNotNull())
        .select(key, pairs.alias("p"))
        .select(key, "p.m", "p.v")
        .where("v IS NOT NULL")
        .groupBy(key, "m", "v")
        .agg(F.count("*").alias("n"))
    )
    ranked = running(counts, [key, "m"], ["v"], upto=("sum", "n"))
    sizes = ranked.groupBy(key, "m").agg(F.sum("n").alias("size"))
    low, high = F.floor((F.col("size") + 1) / 2), F.floor(F.col("size") / 2) + 1

    def holds(rank: Column) -> Column:
        return ((rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto"))).cast("int")

    middle = ranked.join(sizes, [key, "m"]).withColumn("hits", holds(low) + holds(high))
    return middle.where("hits > 0").groupBy(key).agg(
        *[F.sum(F.when(F.col("m") == c, F.col("v") * F.col("hits") / 2)).alias(c) for c in cols]
    )

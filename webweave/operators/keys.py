"""Key checks and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of (keys, n) that break the key: repeated, or with a null part."""
    null_part = F.lit(False)
    for key in keys:
        null_part = null_part | F.col(key).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null_part)


def latest_rows(rows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per key: the one that is last by ``by``, and of ties by all other columns.

    Rows with a null in the key are left out; see ``without_key``.
    """
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(*by, *[c for c in rest if c not in by])
    last = rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.`{c}`").alias(c) for c in rest]).select(*rows.columns)


def without_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that cannot be stored, as a part of their key is null."""
    return rows.where(" OR ".join(f"`{k}` IS NULL" for k in keys))


def upsert(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | str | None = None,
    add_columns: bool = False,
) -> DataFrame:
    """Target after the updates: matched rows take ``update_cols``, unmatched updates are added.

    ``update_cols`` is a list, ``"all"`` or None (insert only). Both sides must be unique on the
    keys (see ``check_keys``); a null in an update overwrites. Columns that only the target has are
    null for added rows. ``add_columns`` takes up columns that only the updates have; without it
    they raise.
    """
    keys = list(keys)
    if add_columns:
        new = [f for f in updates.schema if f.name not in target.columns]
        target = target.withColumns({f.name: F.lit(None).cast(f.dataType) for f in new})
    extra = [c for c in updates.columns if c not in target.columns]
    if extra:
        raise ValueError(f"updates have columns unknown to the target: {extra}")
    if isinstance(update_cols, str) and update_cols != "all":
        raise ValueError("update_cols must be a list of columns, None or 'all'")
    if update_cols == "all":
        update_cols = updates.columns
    changing = {c for c in update_cols or [] if c not in keys}
    unknown = changing - set(updates.columns)
    if unknown:
        raise ValueError(f"updates lack the columns {sorted(unknown)}")

    if not changing:
        added = updates.join(target.select(*keys), keys, "left_anti")
        return target.unionByName(added, allowMissingColumns=True).select(*target.columns)

    old = target.withColumn("_old", F.lit(True)).alias("t")
    new = updates.withColumn("_new", F.lit(True)).alias("u")
    same = [F.col(f"t.{k}") == F.col(f"u.{k}") for k in keys]
    columns = []
    for c in target.columns:
        before, after = F.col(f"t.`{c}`"), F.col(f"u.`{c}`")
        if c in keys:
            value = F.coalesce(before, after)
        elif c in changing:
            value = F.when(F.col("_new"), after).otherwise(before)
        elif c in updates.columns:
            value = F.when(F.col("_old"), before).otherwise(after)
        else:
            value = before
        columns.append(value.cast(target.schema[c].dataType).alias(c))
    return old.join(new, same, "full_outer").select(*columns)

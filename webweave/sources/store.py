"""Stored tables: rows in buckets of a key's hash, versioned folders behind one numbered manifest.

A write goes to a new folder and counts once its manifest is there, which happens in one step: a
failed write leaves the table as it was, and a reader never sees half of one. An upsert writes the
buckets of its keys only; the manifest goes on naming the old folders of all others. Tables have one
writer at a time. Folders and manifests older than the one before are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Sequence
from dataclasses import asdict, dataclass, field

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webweave.operators.keys import check_keys, upsert

BUCKETS = 32
_MANIFEST = "_manifest-"


class KeyViolation(ValueError):
    """A table to be stored has duplicate or null keys."""


@dataclass(frozen=True)
class Manifest:
    """What a version of a table consists of.

    ``folders``: for each bucket with rows its folder below the table's; ``batches``: per stream the
    last batch that is in the table.
    """

    number: int
    keys: list[str]
    by: list[str]
    buckets: int
    schema: str
    folders: dict[str, str]
    batches: dict[str, int] = field(default_factory=dict)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _children(path: str, kind: fs.FileType) -> list[str]:
    system, at = _system(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == kind)


def read_manifest(path: str) -> Manifest | None:
    """The manifest of the table's present version; None if there is no table."""
    names = [n for n in _children(path, fs.FileType.File) if n.startswith(_MANIFEST) and n.endswith(".json")]
    if not names:
        return None
    system, at = _system(path)
    with system.open_input_file(f"{at}/{names[-1]}") as source:
        return Manifest(**json.loads(source.read()))


def _switch(path: str, manifest: Manifest) -> None:
    """Make this the present version, then delete what only older ones than the last had."""
    before = read_manifest(path)
    system, at = _system(path)
    system.create_dir(at, recursive=True)
    name = f"{_MANIFEST}{manifest.number:012d}.json"
    draft = f"{at}/_draft-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as sink:
        sink.write(json.dumps(asdict(manifest)).encode())
    system.move(draft, f"{at}/{name}")
    kept = {*manifest.folders.values(), *(before.folders.values() if before else ())}
    last = f"{_MANIFEST}{before.number:012d}.json" if before else name
    for old in _children(path, fs.FileType.File):
        if old.startswith((_MANIFEST, "_draft-")) and old not in (name, last):
            system.delete_file(f"{at}/{old}")
    for version in _children(path, fs.FileType.Directory):
        here = _children(f"{path}/{version}", fs.FileType.Directory)
        gone = [b for b in here if f"{version}/{b}" not in kept]
        if len(gone) == len(here):
            system.delete_dir(f"{at}/{version}")
            continue
        for bucket in gone:
            system.delete_dir(f"{at}/{version}/{bucket}")


def bucket_of(by: Sequence[str], buckets: int) -> Column:
    """The bucket of a row: its hash over the columns, a null being a value like others."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, keys: Sequence[str], by: Sequence[str], buckets: int) -> dict[str, str]:
    """Write a version folder and return its buckets' folders; raises if the keys are violated.

    Rows are dealt by ranges of bucket and key, so one bucket with most of the rows has many writers.
    """
    version = f"v-{uuid.uuid4().hex}"
    dealt = df.withColumn("_bucket", bucket_of(by, buckets)).repartitionByRange("_bucket", *keys)
    dealt.write.partitionBy("_bucket").parquet(f"{path}/{version}")
    names = _children(f"{path}/{version}", fs.FileType.Directory)
    folders = {n.partition("=")[2]: f"{version}/{n}" for n in names}
    written = _folders(df.sparkSession, path, list(folders.values()), df.schema)
    broken = check_keys(written, keys).limit(5).collect()
    if broken:
        system, at = _system(path)
        system.delete_dir(f"{at}/{version}")
        raise KeyViolation(f"keys {list(keys)} violated, for example {broken}")
    return folders


def _folders(spark: SparkSession, path: str, folders: Sequence[str], schema: T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def read_stored(spark: SparkSession, path: str, buckets: Collection[int] | None = None) -> DataFrame:
    """The present version of a stored table, or only some of its buckets."""
    manifest = read_manifest(path)
    if manifest is None:
        raise FileNotFoundError(f"no stored table at {path}")
    folders = [f for b, f in manifest.folders.items() if buckets is None or int(b) in buckets]
    return _folders(spark, path, folders, T.StructType.fromJson(json.loads(manifest.schema)))


def _next(
    df: DataFrame, path: str, keys: Sequence[str], by: Sequence[str], buckets: int, folders: dict[str, str],
    before: Manifest | None, batch: tuple[str, int] | None,
) -> DataFrame:
    batches = {**(before.batches if before else {}), **(dict([batch]) if batch else {})}
    _switch(path, Manifest(
        (before.number if before else 0) + 1, list(keys), list(by), buckets, df.schema.json(), folders, batches
    ))
    return read_stored(df.sparkSession, path)


def has_batch(path: str, batch: tuple[str, int] | None) -> bool:
    """Is this batch, as (stream, number), in the table already?"""
    manifest = read_manifest(path)
    return batch is not None and manifest is not None and manifest.batches.get(batch[0], -1) >= batch[1]


def replace_table(
    df: DataFrame, path: str, keys: Sequence[str], by: Sequence[str] | None = None, buckets: int = BUCKETS,
    batch: tuple[str, int] | None = None,
) -> DataFrame:
    """Replace the table at ``path``, once the keys are known to be unique and not null.

    ``by``: columns that the key determines and that rows are dealt to buckets by; the keys if not
    given. A plan that reads the table may replace it. A batch that is in the table changes nothing.
    """
    if has_batch(path, batch):
        return read_stored(df.sparkSession, path)
    by = list(by or keys)
    folders = _write(df, path, keys, by, buckets)
    return _next(df, path, keys, by, buckets, folders, read_manifest(path), batch)


def buckets_of(rows: DataFrame, path: str) -> list[int]:
    """The buckets of a stored table that hold the keys of these rows."""
    manifest = read_manifest(path)
    found = rows.select(bucket_of(manifest.by, manifest.buckets).alias("b")).distinct()
    return sorted(r.b for r in found.collect())


def upsert_table(
    updates: DataFrame, path: str, update_cols: Sequence[str] | str | None = "all", add_columns: bool = False,
    batch: tuple[str, int] | None = None,
) -> DataFrame:
    """The stored table after an upsert (see ``upsert``) that reads and writes the updates' buckets only.

    The updates are read twice; store them first where they are costly to compute.
    """
    spark = updates.sparkSession
    before = read_manifest(path)
    if has_batch(path, batch):
        return read_stored(spark, path)
    touched = buckets_of(updates, path)
    merged = upsert(read_stored(spark, path, touched), updates, before.keys, update_cols, add_columns)
    folders = _write(merged, path, before.keys, before.by, before.buckets) if touched else {}
    others = {b: f for b, f in before.folders.items() if int(b) not in touched}
    return _next(merged, path, before.keys, before.by, before.buckets, {**others, **folders}, before, batch)

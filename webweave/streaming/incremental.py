"""Ingest export files as they arrive: each micro-batch is one upload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from webweave.operators.keys import latest_rows, upsert
from webweave.plans.ingest import BACKLINK_ORDER, clean_backlinks
from webweave.schemas import BACKLINK_KEYS
from webweave.session import materialize
from webweave.sources.export import ENCODING, SEPARATOR, without_returns
from webweave.sources.store import has_batch, upsert_table


def export_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """New export files in a folder, read line by line like ``read_export``."""
    return without_returns(
        spark.readStream.schema(schema)
        .options(sep=SEPARATOR, header=True, quote='"', escape='"', encoding=ENCODING, lineSep="\n")
        .csv(folder)
    )


def stream_into_table(
    exports: DataFrame, path: str, load_time: Callable[[int], str], checkpoint: str, name: str = "backlinks",
) -> StreamingQuery:
    """Upsert every batch of export rows into the stored backlinks at ``path`` (see ``store``).

    A batch writes the buckets of its hosts only. The table's ledger names the last batch of the stream
    ``name``, so a batch that is repeated after a failure is recognised and left out.
    """

    def upload(batch: DataFrame, number: int) -> None:
        if has_batch(path, (name, number)):
            return
        rows = clean_backlinks(batch, load_time(number))
        latest = materialize(latest_rows(rows, BACKLINK_KEYS, BACKLINK_ORDER))
        upsert_table(latest, path, "all", add_columns=True, batch=(name, number))

    return (
        exports.writeStream.foreachBatch(upload)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_backlinks(
    exports: DataFrame,
    read_state: Callable[[], DataFrame],
    write_state: Callable[[DataFrame], None],
    load_time: Callable[[int], str],
    checkpoint: str,
) -> StreamingQuery:
    """Upsert every batch of export rows into the stored backlinks.

    The upsert is idempotent, so a batch that is repeated after a failure leaves the same table.
    Within a batch the last of several rows with one key, by check time, is kept. Further export
    columns pass into the state.
    """

    def upload(batch: DataFrame, number: int) -> None:
        rows = clean_backlinks(batch, load_time(number))
        latest = latest_rows(rows, BACKLINK_KEYS, BACKLINK_ORDER)
        write_state(upsert(read_state(), latest, BACKLINK_KEYS, "all", add_columns=True))

    return (
        exports.writeStream.foreachBatch(upload)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

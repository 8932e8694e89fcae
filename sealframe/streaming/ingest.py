"""Streams of documents into an encrypted table.

Each micro-batch is one durable batch of the table, tagged with the query's name and the batch's number, so a batch that
is tried again after a failure is stored once. What a stream writes becomes searchable at the table's refresh, or with
each batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sealframe.sources.table import Table


def ingest(stream: DataFrame, table: Table, checkpoint: str, id_column: str = "_id", order: str | None = None, refresh: bool = False, name: str = "ingest", **trigger) -> StreamingQuery:
    """Start writing a stream of documents into the table; `order` decides between rows of one id in a micro-batch."""

    def store(batch: DataFrame, number: int) -> None:
        table.upsert(batch, id_column, order, refresh, tag=f"{name}-{number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """key, window start and count of a stream, where rows later than `late` are dropped by the watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).count().select(F.col("w.start").alias("start"), key, "count")

"""Streams into a store, and a streaming view of the newest record per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.operators.resolve import SET
from tideline.store import Store


def newest_per_key(batch: DataFrame) -> DataFrame:
    """(key, seq, op, value): the last change of each key in a batch of (key, seq, op, value)."""
    order = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return batch.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("key", "seq", "op", "value")


def ingest(changes: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes a stream of (key, seq, op, value) to a store, a micro-batch per commit.

    Records keep their seq, so one that comes late does not bury a newer one of an earlier batch,
    and a batch that is replayed after a failure changes nothing, whatever was written meanwhile.
    """

    def commit(batch: DataFrame, _: int) -> None:
        rows = newest_per_key(batch)
        if not rows.isEmpty():
            store.write(rows, own_seq=True)

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_view(changes: DataFrame) -> DataFrame:
    """Streaming aggregate of the newest record per key, for complete or update mode."""
    newest = changes.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("r"))
    return newest.select("key", "r.seq", "r.op", "r.value")


def live_view(changes: DataFrame) -> DataFrame:
    """Live pairs of a stream, for complete mode."""
    return latest_view(changes).where(F.col("op") == SET).select("key", "value")

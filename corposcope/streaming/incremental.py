"""Incremental indexing from a stream of file versions.

Each micro-batch holds (path, content, deleted, at) rows.  The newest row of a path
wins inside a batch; the batch becomes one segment of the index, whose size follows
the batch.  A batch that is replayed after a failure finds its rows unchanged.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from corposcope.operators.indexing import IndexStore
from corposcope.session import staged


def newest(batch: DataFrame) -> DataFrame:
    """One row per path: the newest; of equal times a deletion wins."""
    pick = F.max(F.struct(F.coalesce("at", F.lit("0001-01-01").cast("timestamp")), F.coalesce("deleted", F.lit(False)).alias("deleted"), "content"))
    return (batch.where("path is not null").groupBy("path").agg(pick.alias("p"))
                 .select("path", F.col("p.content").alias("content"), F.col("p.deleted").alias("deleted")))


def apply_batch(store: IndexStore, batch: DataFrame) -> dict[str, int]:
    """Merge one batch into the index and publish it."""
    now = staged(newest(batch), "batch")
    kept = "not deleted and content is not null"
    return store.update(now.where(kept).select("path", "content", F.xxhash64("content").alias("hash")), now.where(f"not ({kept})").select("path"))


def run(stream: DataFrame, store: IndexStore, checkpoint: str) -> StreamingQuery:
    """Start indexing a stream of file versions; offsets and state live in ``checkpoint``."""
    return (stream.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch))
                  .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


class Progress(StreamingQueryListener):
    """Calls ``on_batch(batch id, input rows)`` after each micro-batch; register with spark.streams.addListener."""

    def __init__(self, on_batch):
        self.on_batch = on_batch

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.on_batch(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

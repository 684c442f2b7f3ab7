"""Streams of hashed entries into the cache.

Each micro-batch is one atomic commit of the cache, keyed by the batch's number,
so a batch that is delivered again after a failure is not added twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.operators import cache as caches
from siltmark.operators.versioned import retrying


def put_batch(store: caches.HashCache, batch: DataFrame, number: int, stream: str) -> bool:
    """First write wins; returns whether the batch was new."""
    table = store.tables["files"]
    version = table.latest()
    v = version
    while v:
        meta = table.meta(v)
        if meta.get("stream") == stream:
            if meta["batch"] >= number:
                return False
            break
        v -= 1
    rows = caches.first_written(batch.select(*[f.name for f in table.schema.fields]), F.struct("updated_at", "hash"))
    new = caches.new_entries(rows, table.read(version))
    table.commit(added=table.write_files(new), meta={"stream": stream, "batch": number}, parent=version)
    return True


def stream_into(entries: DataFrame, store: caches.HashCache, checkpoint: str, stream: str = "entries", **trigger):
    """Start a query that adds a stream of entries to the cache."""

    def write(batch: DataFrame, number: int) -> None:
        retrying(lambda: put_batch(store, batch, number, stream))

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

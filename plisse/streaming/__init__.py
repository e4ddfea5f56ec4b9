"""Compaction of a stream of payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plisse.plans.compress import compress
from plisse.plans.options import Options


def compress_stream(payloads: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, options: Options = Options(), **trigger) -> StreamingQuery:
    """Compact a stream of payloads(payload_id, body), batch by batch, into sink(result, batch id).

    A payload is compacted by itself, so no state crosses batches, and a batch that is run again gives the same result.
    """

    def batch(df: DataFrame, number: int) -> None:
        sink(compress(df, options), number)
        df.sparkSession.catalog.clearCache()

    return payloads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

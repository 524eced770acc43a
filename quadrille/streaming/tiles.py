"""Rasters that arrive tile by tile: running histograms of a stream, exact under retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

__all__ = ["stream_histogram", "append_tiles"]


def stream_histogram(cells: DataFrame) -> DataFrame:
    """``v, n`` of all cells so far; a streaming aggregation with one row of state a value."""
    return cells.groupBy("v").agg(F.count("*").alias("n"))


def append_tiles(tiles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write arriving tiles once, each micro-batch in a folder of its own that a repeated batch replaces."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return tiles.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

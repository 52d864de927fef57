"""Certainty scores on streams: the score columns have no state, so a stream takes the same expressions as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from certamap.functions.certainty import labels, score


def scored_stream(addresses: DataFrame) -> DataFrame:
    return labels(score(addresses))


def method_counts(addresses: DataFrame, time_col: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean certainty by window and coordinate method; rows later than `late` are dropped with their state."""
    s = scored_stream(addresses).withWatermark(time_col, late)
    return s.groupBy(F.window(time_col, width), "nv_geo_label").agg(F.count(F.lit(1)).alias("n"), F.avg("gci").alias("gci_mean"))


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

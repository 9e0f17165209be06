"""An extension beyond the batch engine: the tumbling counts that baselines are made of, over a stream of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_counts(events: DataFrame, keys: Sequence[str] = ("src_ip",), seconds: int = 300, delay: str = "10 minutes", event_types: Sequence[str] = ("http_request", "network_connection")) -> DataFrame:
    """keys, bucket, n and bytes of each tumbling bucket. Buckets are epoch-aligned as in the batch detectors; events later
    than the delay are dropped, and in append mode a bucket comes out once the watermark has passed its end."""
    seen = events.where(F.col("event_type").isin(*event_types)).withWatermark("timestamp", delay)
    for k in keys:
        seen = seen.where(F.col(k).isNotNull() & (F.col(k) != ""))
    counts = seen.groupBy(F.window("timestamp", f"{seconds} seconds").alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"))
    return counts.select(*keys, F.col("w.start").alias("bucket"), "n", "bytes")

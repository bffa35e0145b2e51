"""Streaming forms of the tumbling counts, activity runs, running figures and deduplication. Undated rows never enter an event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The epoch was a Thursday; windows that begin on Tuesday start five days later.
TUESDAY = "5 days"


def bucket_counts(stream: DataFrame, step: int, lateness: str = "7 days") -> DataFrame:
    """(cluster, bucket, c) per day (step 1) or week from Tuesday (step 7), over a stream with a timestamp column ts."""
    w = F.window("ts", "1 day") if step == 1 else F.window("ts", "7 days", startTime=TUESDAY)
    return stream.where("ts is not null").withWatermark("ts", lateness).groupBy("cluster", w.alias("w")).agg(F.count("*").alias("c")).select("cluster", F.to_date(F.col("w.start")).alias("bucket"), "c")


def activity_runs(stream: DataFrame, gap: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """(cluster, start, end, n): runs of activity without a pause of `gap`."""
    s = stream.where("ts is not null").withWatermark("ts", lateness).groupBy("cluster", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("cluster", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_documents(stream: DataFrame, key: str = "document", lateness: str = "7 days") -> DataFrame:
    """Each document once, while the watermark remembers it."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def running_figures(stream: DataFrame) -> DataFrame:
    """(cluster, n, dated, first_ts, last_ts, sites): figures of every cluster so far, for update or complete output; undated rows count in n.

    The state is one row a cluster; the number of sites is approximate, by a sketch of bounded size.
    """
    return stream.groupBy("cluster").agg(F.count("*").alias("n"), F.count("ts").alias("dated"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.approx_count_distinct("domain", 0.05).alias("sites"))

"""Seconds of the stages of a run, as a table with one row a topic and one for the whole."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Stopwatch:
    """Collects seconds by topic and stage; the stages of a topic add up."""

    def __init__(self) -> None:
        self._rows: list[tuple[str, str, float]] = []
        self._began = time.time()

    @contextmanager
    def stage(self, topic: str, name: str) -> Iterator[None]:
        began = time.time()
        try:
            yield
        finally:
            self._rows.append((topic, name, time.time() - began))

    def table(self, spark: SparkSession, sizes: dict[str, int], stages: list[str]) -> DataFrame:
        """(topic_group, topic_size, one column of seconds a stage, topic_total_seconds, rows_per_second), with a row `__GLOBAL__`."""
        rows = spark.createDataFrame(self._rows, "topic_group string, stage string, seconds double")
        seconds = rows.groupBy("topic_group").pivot("stage", stages).sum("seconds").withColumnsRenamed({s: f"{s}_seconds" for s in stages})
        total = sum((F.coalesce(F.col(f"{s}_seconds"), F.lit(0.0)) for s in stages), F.lit(0.0))
        size = spark.createDataFrame(list(sizes.items()), "topic_group string, topic_size long")
        topics = size.join(seconds, "topic_group", "left").withColumn("topic_total_seconds", total)
        whole = topics.agg(F.lit("__GLOBAL__").alias("topic_group"), F.sum("topic_size").alias("topic_size"), *[F.sum(f"{s}_seconds").alias(f"{s}_seconds") for s in stages], F.lit(time.time() - self._began).alias("topic_total_seconds"))
        rate = F.when(F.col("topic_total_seconds") > 0, F.col("topic_size") / F.col("topic_total_seconds"))
        return topics.unionByName(whole).withColumn("rows_per_second", rate)

"""Queries: the streaming operators, run to the end of what is there, each with the SQL of the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.tables import table
from ..streaming import windows
from .common import register

QUERIES, ORACLE, query = register()


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """The dated and undated articles of real clusters as a stream of files."""
    source = f"{d}/clustered_data.parque[t]"  # a pattern may stand for a file as for a folder, a plain path for a folder only
    s = spark.readStream.schema(table(spark, d, "clustered_data").schema).parquet(source)
    return s.where("cluster <> -1").select("cluster", F.col("published_at").cast("timestamp").alias("ts"), F.coalesce("source_domain", F.lit("unknown_domain")).alias("domain"), "document")


def _finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream once all that is there has been read; each batch of a complete output takes the place of the one before."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/newsgrain/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out")

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


_REAL = "s AS (SELECT cluster, published_at AS ts, coalesce(source_domain, 'unknown_domain') AS domain, document FROM clustered_data WHERE cluster <> -1)"


@query("ST_daily_counts", f"WITH {_REAL} SELECT cluster, CAST(ts AS DATE) AS bucket, count(*) AS c FROM s WHERE ts IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return _finished(windows.bucket_counts(_articles(spark, d), 1))


@query("ST_weekly_counts", f"WITH {_REAL} SELECT cluster, CAST(date_trunc('week', CAST(ts AS DATE) - INTERVAL 1 DAY) + INTERVAL 1 DAY AS DATE) AS bucket, count(*) AS c FROM s WHERE ts IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return _finished(windows.bucket_counts(_articles(spark, d), 7))


@query("ST_activity_runs", f"""
    WITH {_REAL}, n AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY cluster ORDER BY ts) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM s WHERE ts IS NOT NULL),
        g AS (SELECT *, sum(fresh) OVER (PARTITION BY cluster ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM n)
    SELECT cluster, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS n FROM g GROUP BY cluster, g""")
def _(spark, d):
    """Runs of articles of a cluster without a pause of a day."""
    out = _finished(windows.activity_runs(_articles(spark, d)))
    return out.select("cluster", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("ST_running_figures", f"WITH {_REAL} SELECT cluster, count(*) AS n, count(ts) AS dated, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1")
def _(spark, d):
    """Figures of every cluster so far (without the number of sites, which is a sketch)."""
    out = _finished(windows.running_figures(_articles(spark, d)))
    return out.select("cluster", "n", "dated", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


@query("ST_first_documents", f"WITH {_REAL} SELECT DISTINCT md5(document) AS document FROM s WHERE ts IS NOT NULL AND document IS NOT NULL")
def _(spark, d):
    """Each document of the stream once."""
    s = _articles(spark, d).where("ts is not null and document is not null").withColumn("document", F.md5("document"))
    return _finished(windows.first_documents(s), "append").select("document")


@query("ST_late_rows", f"WITH {_REAL} SELECT count(*) AS kept FROM s WHERE ts IS NOT NULL")
def _(spark, d):
    """Rows of the first batch are never late, however old: the watermark has not moved yet."""
    return _finished(windows.bucket_counts(_articles(spark, d), 1)).agg(F.sum("c").alias("kept"))

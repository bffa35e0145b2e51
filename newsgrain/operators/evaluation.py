"""Reports on clusterings: cosine within clusters, burst scoring on and off, methods compared, coverage of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import serving, temporal, vectors

METHOD = "sbert_hdbscan"
COMPARED = "tfidf_vs_embeddings|kmeans_vs_hdbscan"
#: The rows of the evaluation report.
REPORT = "section string, topic_group string, cluster long, method string, silhouette double, noise_percent double, num_clusters long, mean_intra_cosine double, burst_score long, suspicion_score double"
#: The rows of the ablation report.
ABLATION = (
    "topic_group string, n_articles long, k long, requested_k long, method string, silhouette double, davies_bouldin double, num_clusters long, runtime_seconds double, ablation_family string, comparison_group string, "
    "burst_enabled boolean, mean_cluster_suspicion double, median_cluster_suspicion double, topk_mean_suspicion double"
)


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in its order, absent ones as typed nulls."""
    wanted = [x.strip().split(" ") for x in schema.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted])


def intra_cosine(labelled: DataFrame) -> DataFrame:
    """(topic_group, cluster, cluster_size, mean_intra_cosine) of clusters of two or more vectors, over all their pairs.

    labelled: (topic_group, cluster, vec); noise (-1) is left out.
    """
    c = vectors.intra_cluster_cosine(labelled.where("cluster <> -1"), ["topic_group", "cluster"], "vec").where("n > 1")
    return c.select("topic_group", "cluster", F.col("n").alias("cluster_size"), F.round("mean_cosine", 4).alias("mean_intra_cosine"))


def evaluation_report(sweep: DataFrame, cosine: DataFrame, stats: DataFrame) -> DataFrame:
    """The three sections in one table: silhouette of each topic's best configuration, cosine of each cluster, burst scores with that cosine."""
    best = serving.best_config(sweep, parity=True).withColumn("section", F.lit("silhouette"))
    close = cosine.withColumn("section", F.lit("intra_cosine"))
    burst = stats.join(cosine.drop("cluster_size"), ["topic_group", "cluster"], "left").withColumn("section", F.lit("burst"))
    keep = {"silhouette": ["silhouette", "noise_percent", "num_clusters"], "intra_cosine": ["cluster", "mean_intra_cosine"], "burst": ["cluster", "mean_intra_cosine", "burst_score", "suspicion_score"]}
    parts = [_shaped(df.select("section", "topic_group", *keep[name]).withColumn("method", F.lit(METHOD)), REPORT) for name, df in (("silhouette", best), ("intra_cosine", close), ("burst", burst))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def burst_ablation(stats: DataFrame, top: int = 5) -> DataFrame:
    """Per topic two rows, scores with the burst signal and without it: mean, median and the mean of the `top` highest."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0))
    both = temporal.burst_off(stats).select("topic_group", "cluster", "total_articles", F.explode(F.array(
        F.struct(F.lit(True).alias("burst_enabled"), zero("suspicion_score").alias("s")), F.struct(F.lit(False).alias("burst_enabled"), F.col("score_without_bursts").alias("s"))
    )).alias("x")).select("topic_group", "cluster", "total_articles", "x.*")
    ranked = both.withColumn("r", F.row_number().over(Window.partitionBy("topic_group", "burst_enabled").orderBy(F.desc("s"), "cluster")))
    out = ranked.groupBy("topic_group", "burst_enabled").agg(
        F.sum(F.coalesce("total_articles", F.lit(0))).alias("n_articles"), F.count_distinct("cluster").alias("num_clusters"), F.round(F.avg("s"), 6).alias("mean_cluster_suspicion"),
        F.round(F.median("s"), 6).alias("median_cluster_suspicion"), F.round(F.avg(F.when(F.col("r") <= top, F.col("s"))), 6).alias("topk_mean_suspicion"),
    )
    name = F.when(F.col("burst_enabled"), f"{METHOD}_with_burst").otherwise(f"{METHOD}_without_burst")
    return out.select("topic_group", name.alias("method"), "burst_enabled", "n_articles", "num_clusters", "mean_cluster_suspicion", "median_cluster_suspicion", "topk_mean_suspicion")


def with_winners(points: DataFrame) -> DataFrame:
    """Methods of a topic with their quality index and rank, and the topic's winner (ties go to the first name)."""
    q = serving.quality_index(points)
    best = q.groupBy("topic_group").agg(F.min_by("method", F.struct((-F.col("quality_index")).alias("q"), "method")).alias("topic_winner_method"))
    return q.join(best, "topic_group")


def ablation_report(clustering: DataFrame, bursts: DataFrame) -> DataFrame:
    """Clustering methods and burst rows in one table; quality columns are those of clustering rows, the winner stands in all rows of its topic.

    clustering: (topic_group, method, n_articles, k, requested_k, num_clusters, silhouette, davies_bouldin, runtime_seconds).
    """
    scored = with_winners(clustering.withColumns({"ablation_family": F.lit("clustering"), "comparison_group": F.lit(COMPARED)}))
    first = _shaped(scored, ABLATION + ", sil_norm double, db_norm_inv double, quality_index double, quality_rank long, topic_winner_method string")
    winners = scored.select("topic_group", "topic_winner_method").distinct()
    burst = bursts.withColumns({"ablation_family": F.lit("burst_scoring"), "comparison_group": F.lit("with_without_burst")}).join(winners, "topic_group", "left")
    out = first.unionByName(_shaped(burst, ABLATION + ", topic_winner_method string"), allowMissingColumns=True)
    return out.withColumnsRenamed({"sil_norm": "silhouette_norm", "db_norm_inv": "davies_bouldin_norm_inv", "quality_rank": "quality_rank_topic"})


def domain_summary(df: DataFrame) -> DataFrame:
    """(domain, rows, dated rows, rows by date source, coverage in percent)."""
    by = [F.count_if(F.col("timestamp_source") == s).alias(f"n_{s}") for s in ("url", "text", "htmldate", "missing")]
    agg = df.groupBy("domain").agg(F.count("*").alias("n_rows"), F.count("published_at").alias("timestamped"), *by)
    return agg.withColumn("coverage_pct", F.round(100 * F.col("timestamped") / F.col("n_rows"), 6))

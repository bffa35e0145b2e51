"""Query-ready tables for exploration: overviews, daily counts, topic summaries, samples, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import serving_domain


def mode_by_count(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Most frequent non-empty value per key; the smaller value on ties."""
    n = df.where(F.col(value).isNotNull() & (F.trim(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))["v"].alias(out))


def daily_counts(df: DataFrame) -> DataFrame:
    """(topic_group, cluster, day, articles) of real clusters."""
    return df.where("cluster <> -1 and published_at is not null").groupBy("topic_group", "cluster", F.to_date("published_at").alias("day")).agg(F.count("*").alias("articles"))


def representative(df: DataFrame, best: bool = True) -> DataFrame:
    """One row a cluster: the strongest member (best) or the weakest (edge), outlier score next, then the smaller row."""
    s, o = F.col("cluster_membership_strength"), F.col("cluster_outlier_score")
    order = [s.desc_nulls_last(), o.asc_nulls_last(), F.col("row_idx")] if best else [s.asc_nulls_last(), o.desc_nulls_last(), F.col("row_idx")]
    w = Window.partitionBy("topic_group", "cluster").orderBy(*order)
    return df.where("cluster <> -1").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def cluster_overview(df: DataFrame) -> DataFrame:
    """The overview of every cluster: sizes, dates, days, strengths, reasons and the representative article.

    Means count a null strength or outlier score as 0; undated clusters have span and peak 0.
    """
    keys = ["topic_group", "cluster"]
    real = df.where("cluster <> -1")
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0))
    agg = real.groupBy(*keys).agg(
        F.count("*").alias("article_count"), F.count("published_at").alias("timestamped_articles"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"),
        (F.sum(zero("cluster_membership_strength")) / F.count("*")).alias("mean_membership_strength"), (F.sum(zero("cluster_outlier_score")) / F.count("*")).alias("mean_outlier_score"),
    )
    days = daily_counts(df).groupBy(*keys).agg(F.count("*").alias("active_days"), F.max("articles").alias("peak_day_count"))
    topic_reason = mode_by_count(real, keys, "topic_group_reason", "topic_group_reason_mode")
    assigned = mode_by_count(real, keys, "cluster_assignment_reason", "cluster_assignment_reason_mode")
    best = representative(df).select(
        *keys, F.coalesce("title", F.lit("")).alias("representative_title"), F.coalesce("url", F.lit("")).alias("representative_url"), F.col("published_at").alias("representative_timestamp"),
        serving_domain(F.col("url")).alias("representative_domain"), F.col("cluster_membership_strength").alias("representative_membership_strength"), F.col("cluster_outlier_score").alias("representative_outlier_score"),
    )
    out = agg
    for part in (days, topic_reason, assigned, best):
        out = out.join(part, keys, "left")
    n, dated = F.col("article_count"), F.col("timestamped_articles")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = out.withColumns({"active_days": F.coalesce("active_days", F.lit(0)), "peak_day_count": F.coalesce("peak_day_count", F.lit(0))})
    return out.select(
        *keys, "article_count", n.alias("total_articles"), n.alias("cluster_size"), "timestamped_articles", (n - dated).alias("undated_articles"), (dated / n).alias("timestamp_coverage_ratio"), "first_seen", "last_seen",
        F.coalesce(F.floor((micros("last_seen") - micros("first_seen")) / F.lit(86_400_000_000)), F.lit(0)).alias("span_days"), "active_days", "peak_day_count",
        F.when(dated > 0, F.col("peak_day_count") / dated).otherwise(0.0).alias("peak_day_share"), "mean_membership_strength", "mean_outlier_score", "topic_group_reason_mode", "cluster_assignment_reason_mode",
        "representative_title", "representative_url", "representative_timestamp", "representative_domain", "representative_membership_strength", "representative_outlier_score",
    ).orderBy(F.desc("article_count"), F.desc("timestamped_articles"), *keys)


def topic_summary(df: DataFrame) -> DataFrame:
    """Counts of a topic in one conditional aggregate."""
    real = F.col("cluster") != -1
    agg = df.groupBy("topic_group").agg(
        F.count("*").alias("total"), F.count_if(real).alias("clustered"), F.count_if(~real).alias("noise"), F.count("published_at").alias("dated"),
        F.count_distinct(F.when(real, F.col("cluster"))).alias("clusters"),
    )
    sizes = df.where(real).groupBy("topic_group", "cluster").agg(F.count("*").alias("n"))
    per = sizes.groupBy("topic_group").agg(F.avg("n").alias("mean_size"), F.median("n").alias("median_size"), F.max("n").alias("max_size"), F.min_by("cluster", F.struct(-F.col("n"), "cluster")).alias("top_cluster"))
    return agg.withColumn("noise_pct", F.round(100 * F.col("noise") / F.col("total"), 6)).join(per, "topic_group", "left")


def scatter_sample(df: DataFrame, cap: int, noise_per_topic: int, seed: int = 42) -> DataFrame:
    """A display sample: all representatives, then clustered rows by hash up to `cap`, and some noise of every topic."""
    anchors = representative(df).select("row_idx").withColumn("kind", F.lit("anchor"))
    noise = df.where("cluster = -1").withColumn("r", F.row_number().over(Window.partitionBy("topic_group").orderBy(F.xxhash64("row_idx", F.lit(seed)), "row_idx"))).where(F.col("r") <= noise_per_topic)
    rest = df.where("cluster <> -1").join(anchors, "row_idx", "left_anti").select("row_idx").withColumn("kind", F.lit("member"))
    ranked = anchors.unionByName(rest).orderBy(F.when(F.col("kind") == "anchor", 0).otherwise(1), F.xxhash64("row_idx", F.lit(seed)), "row_idx").limit(cap)
    return ranked.unionByName(noise.select("row_idx").withColumn("kind", F.lit("noise"))).join(df.select("row_idx", "topic_group", "cluster", "umap_x", "umap_y"), "row_idx")


def visible_clusters(overview: DataFrame, daily: DataFrame, topics: list[str], least: int, first: str, last: str) -> DataFrame:
    """Clusters under filters: articles in the date range plus undated ones."""
    inside = daily.where(F.col("day").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).groupBy("cluster").agg(F.sum("articles").alias("in_range"))
    kept = overview.where(F.col("topic_group").isin(topics) & (F.col("articles") >= least))
    return kept.join(inside, "cluster", "left").select("topic_group", "cluster", "articles", (F.col("articles") - F.col("dated") + F.coalesce("in_range", F.lit(0))).alias("articles_shown")).where("articles_shown > 0")


def best_config(sweep: DataFrame, parity: bool = False) -> DataFrame:
    """The best row of every topic by selection score. parity: the first non-null value of each column in that order instead."""
    order = [F.desc_nulls_last("selection_score"), F.col("min_cluster_size"), F.col("min_samples")]
    w = Window.partitionBy("topic_group").orderBy(*order)
    if not parity:
        return sweep.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    ranked = sweep.withColumn("r", F.row_number().over(w))
    cols = [c for c in sweep.columns if c != "topic_group"]
    return ranked.groupBy("topic_group").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("r"))).alias(c) for c in cols])


def quality_index(points: DataFrame) -> DataFrame:
    """Min-max within topic: .65 silhouette + .35 inverted Davies-Bouldin, nulls and flat ranges 0; dense rank; winner."""
    w = Window.partitionBy("topic_group")

    def scaled(c: str, invert: bool = False):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        x = (hi - F.col(c)) / (hi - lo) if invert else (F.col(c) - lo) / (hi - lo)
        return F.when(hi > lo, x)

    q = points.withColumn("sil_norm", scaled("silhouette")).withColumn("db_norm_inv", scaled("davies_bouldin", True))
    q = q.withColumn("quality_index", 0.65 * F.coalesce("sil_norm", F.lit(0.0)) + 0.35 * F.coalesce("db_norm_inv", F.lit(0.0)))
    return q.withColumn("quality_rank", F.dense_rank().over(Window.partitionBy("topic_group").orderBy(F.desc("quality_index"))).cast("long"))


TEXT_COLUMNS = ("title", "summary", "topics", "url", "author", "timestamp_source", "timestamp_quality", "topic_group_reason", "cluster_assignment_reason")


def normalised(df: DataFrame) -> DataFrame:
    """The columns the serving tables are built from, with one form of absence: texts empty, clusters -1, topics `necunoscut`, numbers null."""
    text = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c)
    number = lambda c, t: F.expr(f"try_cast({c} AS {t})").alias(c)
    return df.select(
        "row_idx", F.coalesce(F.nullif(F.trim("topic_group"), F.lit("")), F.lit("necunoscut")).alias("topic_group"), F.coalesce(F.expr("try_cast(cluster AS long)"), F.lit(-1)).alias("cluster"), "published_at", F.to_date("published_at").alias("published_on"),
        serving_domain(F.col("url")).alias("source_domain"), *[text(c) for c in TEXT_COLUMNS], F.coalesce("topic_is_eligible", F.lit(False)).alias("topic_is_eligible"),
        number("cluster_membership_strength", "double"), number("cluster_outlier_score", "double"), number("cluster_size", "long"), number("topic_row_idx", "long"),
    )


def repair(df: DataFrame, clean: DataFrame, keys: list[str], wanted: list[str], order: list[Column]) -> DataFrame:
    """`df` with the wanted columns completed from the first row of `clean` (by `order`) under the same keys; columns neither has are null."""
    held = [c for c in wanted if c in clean.columns]
    first = clean.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").select(*keys, *[F.col(c).alias(f"__{c}") for c in held])
    joined = df.join(first, keys, "left")
    whole = {c: F.coalesce(*[x for x in ([F.col(c)] if c in df.columns else []) + ([F.col(f"__{c}")] if c in held else [])]) if c in df.columns or c in held else F.lit(None).cast("string") for c in wanted}
    return joined.select(*[c for c in df.columns if c not in wanted], *[x.alias(c) for c, x in whole.items()])


def global_meta(df: DataFrame, stats: DataFrame, vectors: DataFrame, scatter_cap: int) -> DataFrame:
    """One row of figures about the serving tables."""
    real = F.col("cluster") != -1
    when = F.when(real, F.col("published_at"))
    a = df.agg(
        F.count("*").alias("total_rows"), F.count_if(real).alias("real_rows"), F.count_if(~real).alias("noise_rows"), F.count("published_at").alias("timestamped_rows"), F.count_distinct("topic_group").alias("topic_count"),
        F.count_distinct(F.when(real, F.struct("topic_group", "cluster"))).alias("real_cluster_count"), F.min(when).alias("min_timestamp"), F.max(when).alias("max_timestamp"),
    )
    parts = [daily_counts(df).agg(F.count("*").alias("daily_count_rows")), stats.agg(F.count("*").alias("temporal_rows")), vectors.agg(F.count("*").alias("vector_rows"))]
    for p in parts:
        a = a.crossJoin(p)  # one row each
    share = lambda c: F.when(F.col("total_rows") > 0, F.round(F.col(c) / F.col("total_rows"), 6)).otherwise(0.0)
    return a.withColumns({"noise_rate": share("noise_rows"), "timestamp_coverage_ratio": share("timestamped_rows"), "scatter_cap": F.lit(scatter_cap)})

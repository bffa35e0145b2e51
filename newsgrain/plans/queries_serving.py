"""Queries: aggregates, windows, serving tables, vectors, text models, campaign scores and figure inputs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import ROUTINE_HEALTH_TERMS, normalize_text, shorten
from ..operators import campaign, curation, density, evaluation, serving, text_model, vectors
from ..operators.ranks import row_numbers
from ..session import materialize, spread
from ..sources.tables import table
from .common import articles_table as cd
from .common import register, stats
from .queries_core import NOSTOP_SQL, NOSTOP_WITH

QUERIES, ORACLE, query = register()
_NORMAL = "trim(regexp_replace(lower(strip_accents(coalesce(representative_title, ''))), '[^a-z0-9]+', ' ', 'g'))"



# --- aggregates -------------------------------------------------------------------------------------------------------


@query("A3_topic_counts", "SELECT topic_group, count(*) AS n FROM clustered_data GROUP BY 1")
def _(spark, d):
    return cd(spark, d).groupBy("topic_group").agg(F.count("*").alias("n"))


@query("A4_cluster_size", "SELECT row_idx, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM clustered_data")
def _(spark, d):
    """Size of each row's cluster; noise counts as one group. By aggregate and join, so that the large noise group is pre-aggregated."""
    df = cd(spark, d).select("row_idx", "cluster")
    return df.join(df.groupBy("cluster").agg(F.count("*").alias("cluster_size")), "cluster").select("row_idx", "cluster_size")


@query("A5_cluster_aggregate", """
    SELECT topic_group, cluster, count(*) AS n, round(sum(CAST(cluster_membership_strength AS DOUBLE)), 6) AS strength, min(published_at) AS first_ts, max(published_at) AS last_ts
    FROM clustered_data WHERE cluster <> -1 GROUP BY 1, 2""")
def _(spark, d):
    return cd(spark, d).where("cluster <> -1").groupBy("topic_group", "cluster").agg(F.count("*").alias("n"), F.round(F.sum(F.col("cluster_membership_strength").cast("double")), 6).alias("strength"), F.min("published_at").alias("first_ts"), F.max("published_at").alias("last_ts"))


@query("A6_R2_daily_counts", "SELECT topic_group, cluster, CAST(published_at AS DATE) AS day, count(*) AS articles FROM clustered_data WHERE cluster <> -1 AND published_at IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return serving.daily_counts(cd(spark, d))


@query("A7_active_days", """
    SELECT topic_group, cluster, count(*) AS days, max(n) AS peak FROM (SELECT topic_group, cluster, CAST(published_at AS DATE) AS day, count(*) AS n FROM clustered_data WHERE cluster <> -1 AND published_at IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
def _(spark, d):
    return serving.daily_counts(cd(spark, d)).groupBy("topic_group", "cluster").agg(F.count("*").alias("days"), F.max("articles").alias("peak"))


@query("A8_mode_domain", """
    SELECT topic_group, cluster, source_domain AS top_domain FROM (
        SELECT topic_group, cluster, source_domain, row_number() OVER (PARTITION BY topic_group, cluster ORDER BY c DESC, source_domain) AS r
        FROM (SELECT topic_group, cluster, source_domain, count(*) AS c FROM clustered_data WHERE cluster <> -1 AND trim(source_domain) <> '' GROUP BY ALL)) WHERE r = 1""")
def _(spark, d):
    return serving.mode_by_count(cd(spark, d).where("cluster <> -1"), ["topic_group", "cluster"], "source_domain", "top_domain")


_TOPIC = """
    t AS (SELECT topic_group, count(*) AS total, count(*) FILTER (cluster <> -1) AS clustered, count(*) FILTER (cluster = -1) AS noise, count(published_at) AS dated,
        count(DISTINCT cluster) FILTER (cluster <> -1) AS clusters FROM clustered_data GROUP BY 1),
    s AS (SELECT topic_group, cluster, count(*) AS n FROM clustered_data WHERE cluster <> -1 GROUP BY 1, 2),
    p AS (SELECT topic_group, avg(n) AS mean_size, median(n) AS median_size, max(n) AS max_size FROM s GROUP BY 1),
    f AS (SELECT topic_group, cluster AS top_cluster FROM (SELECT *, row_number() OVER (PARTITION BY topic_group ORDER BY n DESC, cluster) AS r FROM s) WHERE r = 1)"""


@query("A10_A11_R3_topic_summary", f"WITH {_TOPIC} SELECT t.*, round(100.0::DOUBLE * noise / total, 6) AS noise_pct, mean_size, median_size, max_size, top_cluster FROM t LEFT JOIN p USING (topic_group) LEFT JOIN f USING (topic_group)")
def _(spark, d):
    return serving.topic_summary(cd(spark, d))


@query("A12_R8_meta", """
    WITH a AS (SELECT count(*) AS total_rows, count(*) FILTER (cluster <> -1) AS real_rows, count(*) FILTER (cluster = -1) AS noise_rows, count(published_at) AS timestamped_rows, count(DISTINCT topic_group) AS topic_count,
            count(DISTINCT (topic_group, cluster)) FILTER (cluster <> -1) AS real_cluster_count, min(published_at) FILTER (cluster <> -1) AS min_timestamp, max(published_at) FILTER (cluster <> -1) AS max_timestamp FROM clustered_data),
        d AS (SELECT count(DISTINCT (topic_group, cluster, CAST(published_at AS DATE))) AS daily_count_rows FROM clustered_data WHERE cluster <> -1 AND published_at IS NOT NULL), t AS (SELECT count(*) AS temporal_rows FROM cluster_temporal_stats), v AS (SELECT count(*) AS vector_rows FROM article_vectors)
    SELECT *, CASE WHEN total_rows > 0 THEN round(noise_rows / total_rows::DOUBLE, 6) ELSE 0 END AS noise_rate, CASE WHEN total_rows > 0 THEN round(timestamped_rows / total_rows::DOUBLE, 6) ELSE 0 END AS timestamp_coverage_ratio, 10000 AS scatter_cap FROM a, d, t, v""")
def _(spark, d):
    """One row about all serving tables."""
    return serving.global_meta(cd(spark, d), stats(spark, d), table(spark, d, "article_vectors"), scatter_cap=10_000)


@query("A18_best_config", """
    SELECT topic_group, min_cluster_size, min_samples, silhouette, selection_score FROM (SELECT *, row_number() OVER (PARTITION BY topic_group ORDER BY selection_score DESC NULLS LAST, min_cluster_size, min_samples) AS r FROM sweep_results) WHERE r = 1""")
def _(spark, d):
    return serving.best_config(table(spark, d, "sweep_results")).select("topic_group", "min_cluster_size", "min_samples", "silhouette", "selection_score")


@query("A18_best_config_parity", """
    SELECT topic_group, first(silhouette ORDER BY r) FILTER (silhouette IS NOT NULL) AS silhouette, first(davies_bouldin ORDER BY r) FILTER (davies_bouldin IS NOT NULL) AS davies_bouldin, first(num_clusters ORDER BY r) AS num_clusters
    FROM (SELECT *, row_number() OVER (PARTITION BY topic_group ORDER BY selection_score DESC NULLS LAST, min_cluster_size, min_samples) AS r FROM sweep_results) GROUP BY 1""")
def _(spark, d):
    return serving.best_config(table(spark, d, "sweep_results"), parity=True).select("topic_group", "silhouette", "davies_bouldin", "num_clusters")


INTRA_SQL = """(
    SELECT topic_group, cluster, cluster_size, round((s - cluster_size) / (cluster_size * (cluster_size - 1)), 4) AS mean_intra_cosine FROM (
        SELECT g AS topic_group, k AS cluster, max(n) AS cluster_size, sum(z * z) AS s FROM (
            SELECT g, k, j, sum(z) AS z, count(*) AS n FROM (SELECT g, k, unnest(u) AS z, generate_subscripts(u, 1) AS j FROM (
                SELECT c.topic_group AS g, c.cluster AS k, list_transform(x, lambda q: q / sqrt(list_inner_product(x, x))) AS u FROM clustered_data c JOIN (
                    SELECT topic_group, topic_row_idx, vec::DOUBLE[] AS x FROM article_vectors WHERE vec IS NOT NULL AND len(list_filter(vec, lambda q: q IS NULL)) = 0 AND list_sum(list_transform(vec, lambda q: abs(q))) > 0) v
                ON v.topic_group = c.topic_group AND v.topic_row_idx = c.topic_row_idx WHERE c.cluster <> -1)) GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE cluster_size > 1)"""


@query("A20_weighted_mean", f"SELECT topic_group, count(*) AS clusters, round(avg(mean_intra_cosine), 6) AS mean_cosine, round(sum(mean_intra_cosine * cluster_size) / sum(cluster_size), 6) AS weighted_cosine FROM {INTRA_SQL} GROUP BY 1")
def _(spark, d):
    """Mean cosine within the clusters of a topic, plain and weighted by their size."""
    c = evaluation.intra_cosine(labelled(spark, d))
    return c.groupBy("topic_group").agg(F.count("*").alias("clusters"), F.round(F.avg("mean_intra_cosine"), 6).alias("mean_cosine"), F.round(F.sum(F.col("mean_intra_cosine") * F.col("cluster_size")) / F.sum("cluster_size"), 6).alias("weighted_cosine"))


_CORR = ("domain_entropy", "peak_day_share", "active_day_ratio", "concentration")


@query("A21_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM cluster_temporal_stats WHERE " + " AND ".join(f"{c} IS NOT NULL AND isfinite({c})" for c in _CORR) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]))
def _(spark, d):
    s = stats(spark, d)
    for c in _CORR:
        s = s.where(F.col(c).isNotNull() & ~F.isnan(c))
    pairs = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]
    one = s.agg(*[F.round(F.corr(a, b), 6).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


BURST_SQL = """(
    WITH t AS (SELECT topic_group, cluster, total_articles, coalesce(suspicion_score, 0) AS s_on, greatest(0.0::DOUBLE, (coalesce(suspicion_score_raw, 0) - (4 * coalesce(burst_score_daily, 0) + 3 * coalesce(burst_score_weekly, 0) + 4 * coalesce(burst_stable, 0)))
            * (coalesce(support_weight, 0) * coalesce(coverage_weight, 0) * coalesce(source_weight, 0) * coalesce(domain_weight, 0)) - coalesce(suspicion_penalty_total, 0)) AS s_off FROM cluster_temporal_stats),
        u AS (SELECT topic_group, cluster, total_articles, true AS burst_enabled, s_on AS s FROM t UNION ALL SELECT topic_group, cluster, total_articles, false, s_off FROM t),
        r AS (SELECT *, row_number() OVER (PARTITION BY topic_group, burst_enabled ORDER BY s DESC, cluster) AS r FROM u)
    SELECT topic_group, CASE WHEN burst_enabled THEN 'sbert_hdbscan_with_burst' ELSE 'sbert_hdbscan_without_burst' END AS method, burst_enabled, CAST(sum(coalesce(total_articles, 0)) AS BIGINT) AS n_articles, count(DISTINCT cluster) AS num_clusters,
        round(avg(s), 6) AS mean_cluster_suspicion, round(median(s), 6) AS median_cluster_suspicion, round(avg(s) FILTER (r <= 5), 6) AS topk_mean_suspicion FROM r GROUP BY topic_group, burst_enabled)"""


@query("A23_W8_burst_on_off", f"SELECT * FROM {BURST_SQL}")
def _(spark, d):
    """Mean, median and top-5 mean score of every topic with and without the burst signal."""
    return evaluation.burst_ablation(stats(spark, d))


QUALITY_WITH = """
    e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_group, cluster_selection_method ORDER BY selection_score DESC NULLS LAST, min_cluster_size, min_samples) AS r FROM sweep_results) WHERE r = 1),
    p AS (SELECT topic_group, cluster_selection_method AS method, silhouette, davies_bouldin, min(silhouette) OVER w AS a, max(silhouette) OVER w AS b, min(davies_bouldin) OVER w AS c, max(davies_bouldin) OVER w AS d FROM e WINDOW w AS (PARTITION BY topic_group)),
    q AS (SELECT topic_group, method, silhouette, davies_bouldin, 0.65::DOUBLE * coalesce(CASE WHEN b > a THEN (silhouette - a) / (b - a) END, 0) + 0.35::DOUBLE * coalesce(CASE WHEN d > c THEN (d - davies_bouldin) / (d - c) END, 0) AS q FROM p),
    w AS (SELECT topic_group, method AS topic_winner_method FROM (SELECT *, row_number() OVER (PARTITION BY topic_group ORDER BY q DESC, method) AS r FROM q) WHERE r = 1)"""


@query("A24_W2_V22_quality_index", """
    WITH p AS (SELECT topic_group, min_cluster_size, silhouette, davies_bouldin, min(silhouette) OVER w AS a, max(silhouette) OVER w AS b, min(davies_bouldin) OVER w AS e, max(davies_bouldin) OVER w AS f FROM sweep_results WINDOW w AS (PARTITION BY topic_group)),
         q AS (SELECT topic_group, min_cluster_size, 0.65::DOUBLE * coalesce(CASE WHEN b > a THEN (silhouette - a) / (b - a) END, 0) + 0.35::DOUBLE * coalesce(CASE WHEN f > e THEN (f - davies_bouldin) / (f - e) END, 0) AS q FROM p)
    SELECT topic_group, min_cluster_size, round(q, 6) AS quality_index, dense_rank() OVER (PARTITION BY topic_group ORDER BY q DESC) AS quality_rank FROM q""")
def _(spark, d):
    return serving.quality_index(table(spark, d, "sweep_results")).select("topic_group", "min_cluster_size", F.round("quality_index", 6).alias("quality_index"), "quality_rank")


def methods(spark, d):
    """The best sweep row of every topic and selection method, with its quality index."""
    w = Window.partitionBy("topic_group", "cluster_selection_method").orderBy(F.desc_nulls_last("selection_score"), "min_cluster_size", "min_samples")
    best = table(spark, d, "sweep_results").withColumn("r", F.row_number().over(w)).where("r = 1")
    return evaluation.with_winners(best.select("topic_group", F.col("cluster_selection_method").alias("method"), "silhouette", "davies_bouldin"))


@query("J10_V22_winners", f"WITH {QUALITY_WITH} SELECT topic_group, method, round(q, 6) AS quality_index, dense_rank() OVER (PARTITION BY topic_group ORDER BY q DESC) AS quality_rank_topic, topic_winner_method FROM q JOIN w USING (topic_group)")
def _(spark, d):
    """The quality index of the methods of every topic, and the method that wins it."""
    return methods(spark, d).select("topic_group", "method", F.round("quality_index", 6).alias("quality_index"), F.col("quality_rank").alias("quality_rank_topic"), "topic_winner_method")


@query("A25_W14_source_share", """
    SELECT topic_group, round(count(*) FILTER (timestamp_source = 'url') / count(*)::DOUBLE, 6) AS url, round(count(*) FILTER (timestamp_source = 'text') / count(*)::DOUBLE, 6) AS text,
        round(count(*) FILTER (timestamp_source = 'htmldate') / count(*)::DOUBLE, 6) AS htmldate, round(count(*) FILTER (timestamp_source = 'missing') / count(*)::DOUBLE, 6) AS missing FROM clustered_data GROUP BY 1""")
def _(spark, d):
    kinds = ["url", "text", "htmldate", "missing"]
    p = cd(spark, d).groupBy("topic_group").pivot("timestamp_source", kinds).count().fillna(0)
    total = sum((F.col(k) for k in kinds), F.lit(0))
    return p.select("topic_group", *[F.round(F.col(k) / total, 6).alias(k) for k in kinds])


@query("A26_pivot_max", """
    SELECT min_samples, max(silhouette) FILTER (min_cluster_size = 8) AS s8, max(silhouette) FILTER (min_cluster_size = 10) AS s10, max(silhouette) FILTER (min_cluster_size = 12) AS s12, max(silhouette) FILTER (min_cluster_size = 15) AS s15 FROM sweep_results GROUP BY 1""")
def _(spark, d):
    p = table(spark, d, "sweep_results").groupBy("min_samples").pivot("min_cluster_size", [8, 10, 12, 15]).max("silhouette")
    return p.select("min_samples", *[F.col(f"`{k}`").alias(f"s{k}") for k in (8, 10, 12, 15)])


@query("A27_F18_pivot_mean", f"""
    WITH {QUALITY_WITH}, v AS (SELECT topic_group, round(avg(q) FILTER (method = 'eom'), 6) AS eom, round(avg(q) FILTER (method = 'leaf'), 6) AS leaf FROM q GROUP BY 1)
    SELECT topic_group, eom, leaf, row_number() OVER (ORDER BY round((coalesce(eom, 0) + coalesce(leaf, 0)) / ((eom IS NOT NULL)::INT + (leaf IS NOT NULL)::INT), 6) DESC, topic_group) AS place FROM v""")
def _(spark, d):
    """Quality index by topic and method, topics ordered by their mean."""
    p = methods(spark, d).groupBy("topic_group").pivot("method", ["eom", "leaf"]).avg("quality_index").select("topic_group", F.round("eom", 6).alias("eom"), F.round("leaf", 6).alias("leaf"))
    held = F.col("eom").isNotNull().cast("int") + F.col("leaf").isNotNull().cast("int")
    mean = F.round((F.coalesce("eom", F.lit(0.0)) + F.coalesce("leaf", F.lit(0.0))) / held, 6)
    return p.withColumn("place", F.row_number().over(Window.orderBy(mean.desc(), "topic_group")).cast("long"))  # one row a topic


@query("A28_F17_single_multi", "SELECT topic_group, count(*) FILTER (domain_count = 1) AS single, count(*) FILTER (domain_count <> 1) AS multi FROM cluster_temporal_stats GROUP BY 1")
def _(spark, d):
    one = F.col("domain_count") == 1
    return stats(spark, d).groupBy("topic_group").agg(F.count_if(one).alias("single"), F.count_if(~one).alias("multi"))


@query("A29_F5_log_histogram", """
    WITH s AS (SELECT cluster, count(*) AS n FROM clustered_data WHERE cluster <> -1 GROUP BY 1), e AS (SELECT log10(greatest(min(n), 2)) AS a, log10(max(n)) AS b, median(n) AS m FROM s)
    SELECT CAST(least(floor(round((log10(n) - a) / (b - a) * 39, 9)), 38) AS BIGINT) AS bin, count(*) AS n, max(m) AS median_size FROM s, e WHERE log10(n) >= a GROUP BY 1""")
def _(spark, d):
    """Cluster sizes in 39 bins between 40 edges that are even in their logarithm, and their median."""
    s = cd(spark, d).where("cluster <> -1").groupBy("cluster").agg(F.count("*").alias("n"))
    e = s.agg(F.log10(F.greatest(F.min("n"), F.lit(2))).alias("a"), F.log10(F.max("n")).alias("b"), F.median("n").alias("median_size"))
    bin_ = F.least(F.floor(F.round((F.log10("n") - F.col("a")) / (F.col("b") - F.col("a")) * 39, 9)), F.lit(38)).cast("long")
    return s.crossJoin(F.broadcast(e)).where(F.log10("n") >= F.col("a")).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.max("median_size").alias("median_size"))  # e is one row


@query("A30_F8_quartiles", f"""
    WITH c AS (SELECT topic_group, quantile_cont(mean_intra_cosine, 0.25) AS q1, quantile_cont(mean_intra_cosine, 0.5) AS q2, quantile_cont(mean_intra_cosine, 0.75) AS q3 FROM {INTRA_SQL} GROUP BY 1),
        b AS (SELECT topic_group, silhouette FROM (SELECT *, row_number() OVER (PARTITION BY topic_group ORDER BY selection_score DESC NULLS LAST, min_cluster_size, min_samples) AS r FROM sweep_results) WHERE r = 1)
    SELECT c.topic_group, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, silhouette, row_number() OVER (ORDER BY round(q2, 6) DESC, c.topic_group) AS place FROM c LEFT JOIN b USING (topic_group)""")
def _(spark, d):
    """Quartiles of the cosine within clusters by topic, ordered by their median, beside the silhouette of the best configuration."""
    p = F.percentile("mean_intra_cosine", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    q = evaluation.intra_cosine(labelled(spark, d)).groupBy("topic_group").agg(p.alias("p")).select("topic_group", *[F.round(F.col("p")[k], 6).alias(f"q{k + 1}") for k in range(3)])
    best = serving.best_config(table(spark, d, "sweep_results")).select("topic_group", "silhouette")
    return q.join(best, "topic_group", "left").withColumn("place", F.row_number().over(Window.orderBy(F.desc("q2"), "topic_group")).cast("long"))  # one row a topic


@query("A31_F23_loglog_fit", "SELECT round(regr_slope(ln(topic_total_seconds), ln(topic_size)), 6) AS slope, round(regr_intercept(ln(topic_total_seconds), ln(topic_size)), 6) AS intercept FROM topic_runtime WHERE topic_group <> '__GLOBAL__'")
def _(spark, d):
    t = table(spark, d, "topic_runtime").where("topic_group <> '__GLOBAL__'")
    y, x = F.ln("topic_total_seconds"), F.ln("topic_size")
    return t.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"))


_NARR = "CASE " + " ".join("WHEN regexp_matches(n, '" + "|".join(w) + f"') THEN '{t}'" for t, w in campaign.NARRATIVES) + f" ELSE '{campaign.OTHER_NARRATIVE}' END"


@query("X8_A32_J20_F15_narratives", f"""
    WITH t AS (SELECT cluster, campaign_candidate_score AS s, representative_title AS title, {_NARR} AS kind FROM (SELECT *, {_NORMAL} AS n FROM cluster_temporal_stats) WHERE campaign_candidate_score > 0 AND isfinite(campaign_candidate_score)),
         r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY s DESC, cluster) AS r FROM t)
    SELECT kind, count(*) AS n, round(sum(s), 6) AS total, max(s) AS best, max(CASE WHEN r = 1 THEN cluster END) AS example FROM r GROUP BY 1""")
def _(spark, d):
    s = F.col("campaign_candidate_score")
    t = stats(spark, d).where((s > 0) & ~F.isnan(s)).withColumn("kind", campaign.narrative_type(normalize_text(F.col("representative_title"))))
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum(s), 6).alias("total"), F.max(s).alias("best"), F.max_by("cluster", F.struct(s, -F.col("cluster"))).alias("example"))


@query("A35_F21_winner_counts", f"WITH {QUALITY_WITH} SELECT topic_winner_method AS method, count(*) AS wins FROM w GROUP BY 1")
def _(spark, d):
    """How many topics each method wins by the quality index."""
    return methods(spark, d).select("topic_group", F.col("topic_winner_method").alias("method")).distinct().groupBy("method").agg(F.count("*").alias("wins"))


@query("rollup_topics", "SELECT coalesce(topic_group, '__GLOBAL__') AS topic_group, count(*) AS n FROM clustered_data GROUP BY ROLLUP (topic_group)")
def _(spark, d):
    return cd(spark, d).rollup("topic_group").agg(F.count("*").alias("n")).select(F.coalesce("topic_group", F.lit("__GLOBAL__")).alias("topic_group"), "n")


# --- windows and set operations ---------------------------------------------------------------------------------------


@query("W1_topic_row_idx", "SELECT row_idx, row_number() OVER (PARTITION BY topic_group ORDER BY row_idx) - 1 AS topic_row_idx FROM clustered_data")
def _(spark, d):
    """Row numbers within topics; a topic may be a third of all rows, so they are range-partitioned, not gathered."""
    return row_numbers(cd(spark, d).select("row_idx", "topic_group"), "topic_group", [F.col("row_idx")], "topic_row_idx").select("row_idx", "topic_row_idx")


@query("W3_W4_edges", """
    SELECT topic_group, cluster, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY topic_group, cluster ORDER BY cluster_membership_strength ASC NULLS LAST, cluster_outlier_score DESC NULLS LAST, row_idx) AS r FROM clustered_data WHERE cluster <> -1) WHERE r = 1""")
def _(spark, d):
    return serving.representative(cd(spark, d), best=False).select("topic_group", "cluster", "row_idx")


@query("W5_moving_average", """
    WITH n AS (SELECT CAST(published_at AS DATE) AS day, topic_group, count(*) AS n FROM clustered_data WHERE published_at IS NOT NULL GROUP BY ALL)
    SELECT topic_group, day, n, round(avg(n) OVER (PARTITION BY topic_group ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS avg3 FROM n""")
def _(spark, d):
    n = cd(spark, d).where("published_at is not null").groupBy("topic_group", F.to_date("published_at").alias("day")).agg(F.count("*").alias("n"))
    return n.withColumn("avg3", F.round(F.avg("n").over(Window.partitionBy("topic_group").orderBy("day").rowsBetween(-2, 0)), 6))


@query("W7_rank_by_metric", """
    SELECT topic_group, cluster, row_number() OVER (PARTITION BY topic_group ORDER BY num_burst_periods DESC NULLS LAST, article_count DESC NULLS LAST, cluster) AS place FROM cluster_temporal_stats""")
def _(spark, d):
    w = Window.partitionBy("topic_group").orderBy(F.desc_nulls_last("num_burst_periods"), F.desc_nulls_last("article_count"), "cluster")
    return stats(spark, d).select("topic_group", "cluster", F.row_number().over(w).cast("long").alias("place"))


@query("W10_noise_reservoir")
def _(spark, d):
    """The 50 noise rows of smallest hash of every topic (a sampling operator)."""
    w = Window.partitionBy("topic_group").orderBy(F.xxhash64("row_idx", F.lit(42)), "row_idx")
    return cd(spark, d).where("cluster = -1").withColumn("r", F.row_number().over(w)).where("r <= 50").select("topic_group", "row_idx")


@query("W11_argmax", "SELECT topic_group, arg_max(min_cluster_size, selection_score) AS min_cluster_size FROM sweep_results GROUP BY 1")
def _(spark, d):
    return table(spark, d, "sweep_results").groupBy("topic_group").agg(F.max_by("min_cluster_size", "selection_score").alias("min_cluster_size"))


@query("W13_global_offset", """
    WITH t AS (SELECT topic_group, count(*) AS n, count(DISTINCT cluster) FILTER (cluster <> -1) AS k FROM clustered_data GROUP BY 1)
    SELECT topic_group, k, CAST(coalesce(sum(k) OVER (ORDER BY n DESC, topic_group ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_cluster FROM t""")
def _(spark, d):
    t = cd(spark, d).groupBy("topic_group").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("k"))
    w = Window.orderBy(F.desc("n"), "topic_group").rowsBetween(Window.unboundedPreceding, -1)  # one row a topic
    return t.select("topic_group", "k", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("first_cluster"))


@query("T2_top_campaigns", "SELECT cluster, topic_group, campaign_candidate_score FROM cluster_temporal_stats ORDER BY campaign_candidate_score DESC NULLS LAST, cluster LIMIT 15")
def _(spark, d):
    return stats(spark, d).select("cluster", "topic_group", "campaign_candidate_score").orderBy(F.desc_nulls_last("campaign_candidate_score"), "cluster").limit(15)


@query("T5_seeded_sample")
def _(spark, d):
    """1000 rows by the order of a seeded hash (a sampling operator)."""
    return cd(spark, d).select("row_idx").orderBy(F.xxhash64("row_idx", F.lit(42)), "row_idx").limit(1000)


@query("T8_table_cells", "SELECT row_idx, CASE WHEN length(short_document) > 220 THEN rtrim(substr(short_document, 1, 219)) || '…' ELSE short_document END AS cell FROM clustered_data ORDER BY row_idx LIMIT 500")
def _(spark, d):
    return cd(spark, d).select("row_idx", shorten(F.col("short_document"), 220).alias("cell")).orderBy("row_idx").limit(500)


@query("T9_option_labels", "SELECT cluster, printf('#%d | %s | %d articles', cluster, topic_group, article_count) AS label FROM cluster_temporal_stats WHERE article_count IS NOT NULL")
def _(spark, d):
    return stats(spark, d).where("article_count is not null").select("cluster", F.format_string("#%d | %s | %d articles", "cluster", "topic_group", "article_count").alias("label"))


@query("T10_severity", "SELECT cluster, CASE WHEN campaign_candidate_score >= 5 THEN 'HIGH' WHEN campaign_candidate_score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM cluster_temporal_stats WHERE isfinite(campaign_candidate_score)")
def _(spark, d):
    s = F.col("campaign_candidate_score")
    return stats(spark, d).where(s.isNotNull() & ~F.isnan(s)).select("cluster", F.when(s >= 5, "HIGH").when(s >= 2, "MEDIUM").otherwise("LOW").alias("severity"))


@query("U1_union_by_name", "SELECT topic_group, topic_size, silhouette, NULL::DOUBLE AS topic_total_seconds FROM sweep_results UNION ALL SELECT topic_group, topic_size, NULL, topic_total_seconds FROM topic_runtime")
def _(spark, d):
    a, b = table(spark, d, "sweep_results").select("topic_group", "topic_size", "silhouette"), table(spark, d, "topic_runtime").select("topic_group", "topic_size", "topic_total_seconds")
    return a.unionByName(b, allowMissingColumns=True)


@query("U4_distinct_keys", """
    SELECT row_idx FROM (SELECT row_idx, row_number() OVER (PARTITION BY title, document, short_document, topics ORDER BY row_idx) AS r FROM clustered_data) WHERE r = 1""")
def _(spark, d):
    key = F.xxhash64("title", "document", "short_document", "topics")
    w = Window.partitionBy(key, "title", "document", "short_document", "topics").orderBy("row_idx")
    return cd(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("row_idx")


_EIGHT = ("topic_group", "cluster", "title", "url", "published_at", "source_domain", "umap_x", "umap_y")


@query("U4_distinct_eight_keys", f"SELECT min(row_idx) AS row_idx FROM clustered_data GROUP BY {', '.join(_EIGHT)}")
def _(spark, d):
    """Points of the scatter plot, each once."""
    return cd(spark, d).groupBy(*_EIGHT).agg(F.min("row_idx").alias("row_idx")).select("row_idx")


@query("U5_distinct_pairs", "SELECT topic_group, count(DISTINCT source_domain) AS domains FROM clustered_data GROUP BY 1")
def _(spark, d):
    return cd(spark, d).groupBy("topic_group").agg(F.count_distinct("source_domain").alias("domains"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("J1_repair_join", """
    WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY crawled_at) AS n FROM raw_articles) WHERE n = 1)
    SELECT c.row_idx, coalesce(c.title, r.title) AS title, coalesce(c.topics, r.topics) AS topics, r.author FROM clustered_data c LEFT JOIN r USING (row_idx)""")
def _(spark, d):
    """Rows completed from the raw table by id, first delivery only."""
    w = Window.partitionBy("row_idx").orderBy("crawled_at")
    raw = table(spark, d, "raw_articles").withColumn("n", F.row_number().over(w)).where("n = 1").select("row_idx", F.col("title").alias("t"), F.col("topics").alias("p"), "author")
    return cd(spark, d).join(raw, "row_idx", "left").select("row_idx", F.coalesce("title", "t").alias("title"), F.coalesce("topics", "p").alias("topics"), "author")


@query("J9_temporal_cosine", f"SELECT s.cluster, s.topic_group, s.burst_score, s.suspicion_score, c.mean_intra_cosine FROM cluster_temporal_stats s LEFT JOIN {INTRA_SQL} c ON c.topic_group = s.topic_group AND c.cluster = s.cluster")
def _(spark, d):
    """Temporal statistics with the mean cosine within each cluster."""
    c = evaluation.intra_cosine(labelled(spark, d)).drop("cluster_size")
    return stats(spark, d).select("cluster", "topic_group", "burst_score", "suspicion_score").join(c, ["topic_group", "cluster"], "left")


@query("J13_topic_health", """
    WITH b AS (SELECT topic_group, silhouette, noise_percent FROM (SELECT *, row_number() OVER (PARTITION BY topic_group ORDER BY selection_score DESC NULLS LAST, min_cluster_size, min_samples) AS r FROM sweep_results) WHERE r = 1)
    SELECT t.topic_group, t.n, b.silhouette, b.noise_percent FROM (SELECT topic_group, count(*) AS n FROM clustered_data GROUP BY 1) t LEFT JOIN b USING (topic_group)""")
def _(spark, d):
    best = serving.best_config(table(spark, d, "sweep_results")).select("topic_group", "silhouette", "noise_percent")
    return cd(spark, d).groupBy("topic_group").agg(F.count("*").alias("n")).join(best, "topic_group", "left")


@query("J14_F20_runtime_quality", """
    WITH b AS (SELECT topic_group, max(silhouette) AS silhouette FROM sweep_results GROUP BY 1)
    SELECT b.topic_group, b.silhouette, coalesce(r.topic_total_seconds, r.umap_seconds + r.hdbscan_sweep_seconds + r.embedding_seconds) AS seconds FROM b LEFT JOIN topic_runtime r USING (topic_group)""")
def _(spark, d):
    b = table(spark, d, "sweep_results").groupBy("topic_group").agg(F.max("silhouette").alias("silhouette"))
    r = table(spark, d, "topic_runtime").select("topic_group", F.coalesce("topic_total_seconds", F.col("umap_seconds") + F.col("hdbscan_sweep_seconds") + F.col("embedding_seconds")).alias("seconds"))
    return b.join(r, "topic_group", "left")


@query("J17_semi_anti", """
    SELECT topic_group, count(*) AS n, true AS swept FROM clustered_data WHERE topic_group IN (SELECT topic_group FROM sweep_results) GROUP BY 1
    UNION ALL SELECT topic_group, count(*), false FROM clustered_data WHERE topic_group NOT IN (SELECT topic_group FROM sweep_results) GROUP BY 1""")
def _(spark, d):
    """Articles of topics with and without a sweep: a semi and an anti join."""
    swept = table(spark, d, "sweep_results").select("topic_group")
    part = lambda how: cd(spark, d).join(swept, "topic_group", f"left_{how}").groupBy("topic_group").agg(F.count("*").alias("n")).withColumn("swept", F.lit(how == "semi"))
    return part("semi").unionByName(part("anti"))


_REPS = """reps AS (SELECT topic_group, cluster, CAST(umap_x AS DOUBLE) AS x, CAST(umap_y AS DOUBLE) AS y FROM (SELECT *, row_number() OVER (PARTITION BY topic_group, cluster ORDER BY cluster_membership_strength DESC NULLS LAST, cluster_outlier_score ASC NULLS LAST, row_idx) AS r
    FROM clustered_data WHERE cluster <> -1) WHERE r = 1 AND umap_x IS NOT NULL AND umap_y IS NOT NULL)"""


@query("J15_V20_R7_similarity", f"""
    WITH {_REPS}, p AS (SELECT a.topic_group, a.cluster, b.cluster AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM reps a JOIN reps b ON a.topic_group = b.topic_group AND a.cluster <> b.cluster),
        r AS (SELECT *, row_number() OVER (PARTITION BY topic_group, cluster ORDER BY dist, other) AS rank FROM p)
    SELECT topic_group, cluster, other, rank, round(1 / (1 + dist), 6) AS similarity FROM r WHERE rank <= 6""")
def _(spark, d):
    reps = serving.representative(cd(spark, d)).where("umap_x is not null and umap_y is not null").select("topic_group", "cluster", F.col("umap_x").alias("x"), F.col("umap_y").alias("y"))
    return vectors.nearest_representatives(reps)


# --- serving tables ---------------------------------------------------------------------------------------------------


@query("R1_cluster_overview", """
    WITH c AS (SELECT *, CASE WHEN isfinite(cluster_membership_strength) THEN CAST(cluster_membership_strength AS DOUBLE) ELSE 0 END AS st, CASE WHEN isfinite(cluster_outlier_score) THEN CAST(cluster_outlier_score AS DOUBLE) ELSE 0 END AS ou FROM clustered_data WHERE cluster <> -1),
        a AS (SELECT topic_group, cluster, count(*) AS article_count, count(published_at) AS timestamped_articles, min(published_at) AS first_seen, max(published_at) AS last_seen, sum(st) / count(*) AS ms, sum(ou) / count(*) AS mo FROM c GROUP BY 1, 2),
        p AS (SELECT topic_group, cluster, count(*) AS active_days, max(n) AS peak FROM (SELECT topic_group, cluster, CAST(published_at AS DATE) AS day, count(*) AS n FROM c WHERE published_at IS NOT NULL GROUP BY ALL) GROUP BY 1, 2),
        tr AS (SELECT topic_group, cluster, v FROM (SELECT topic_group, cluster, topic_group_reason AS v, row_number() OVER (PARTITION BY topic_group, cluster ORDER BY count(*) DESC, topic_group_reason) AS r FROM c WHERE trim(topic_group_reason) <> '' GROUP BY 1, 2, 3) WHERE r = 1),
        ar AS (SELECT topic_group, cluster, v FROM (SELECT topic_group, cluster, cluster_assignment_reason AS v, row_number() OVER (PARTITION BY topic_group, cluster ORDER BY count(*) DESC, cluster_assignment_reason) AS r FROM c WHERE trim(cluster_assignment_reason) <> '' GROUP BY 1, 2, 3) WHERE r = 1),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_group, cluster ORDER BY cluster_membership_strength DESC NULLS LAST, cluster_outlier_score ASC NULLS LAST, row_idx) AS r FROM c) WHERE r = 1)
    SELECT a.topic_group, a.cluster, article_count, article_count AS total_articles, article_count AS cluster_size, timestamped_articles, article_count - timestamped_articles AS undated_articles, round(timestamped_articles / article_count::DOUBLE, 6) AS timestamp_coverage_ratio, first_seen, last_seen,
        CAST(coalesce(floor((epoch_us(last_seen) - epoch_us(first_seen)) / 86400000000), 0) AS BIGINT) AS span_days, coalesce(active_days, 0) AS active_days, coalesce(peak, 0) AS peak_day_count, round(CASE WHEN timestamped_articles > 0 THEN coalesce(peak, 0) / timestamped_articles::DOUBLE ELSE 0 END, 6) AS peak_day_share,
        round(ms, 6) AS mean_membership_strength, round(mo, 6) AS mean_outlier_score, tr.v AS topic_group_reason_mode, ar.v AS cluster_assignment_reason_mode, coalesce(title, '') AS representative_title, coalesce(url, '') AS representative_url, published_at AS representative_timestamp,
        CASE WHEN trim(coalesce(url, '')) = '' THEN '' ELSE regexp_replace(regexp_extract(lower(CASE WHEN contains(trim(url), '://') THEN trim(url) ELSE 'https://' || trim(url) END), '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1), '^www\\.', '') END AS representative_domain,
        cluster_membership_strength AS representative_membership_strength, cluster_outlier_score AS representative_outlier_score
    FROM a LEFT JOIN p USING (topic_group, cluster) LEFT JOIN tr USING (topic_group, cluster) LEFT JOIN ar USING (topic_group, cluster) LEFT JOIN b USING (topic_group, cluster)""")
def _(spark, d):
    o = serving.cluster_overview(cd(spark, d))
    return o.withColumns({c: F.round(c, 6) for c in ("timestamp_coverage_ratio", "peak_day_share", "mean_membership_strength", "mean_outlier_score")})


@query("R4_cluster_articles", "SELECT topic_group, cluster, row_idx, coalesce(title, '') AS title, published_at FROM clustered_data WHERE cluster <> -1")
def _(spark, d):
    return cd(spark, d).where("cluster <> -1").select("topic_group", "cluster", "row_idx", F.coalesce("title", F.lit("")).alias("title"), "published_at")


@query("R5_scatter_sample")
def _(spark, d):
    return serving.scatter_sample(cd(spark, d), cap=5000, noise_per_topic=50)


@query("R9_visible_clusters", """
    WITH o AS (SELECT topic_group, cluster, count(*) AS articles, count(published_at) AS dated FROM clustered_data WHERE cluster <> -1 GROUP BY 1, 2),
        i AS (SELECT cluster, count(*) AS k FROM clustered_data WHERE cluster <> -1 AND CAST(published_at AS DATE) BETWEEN DATE '2022-01-01' AND DATE '2023-12-31' GROUP BY 1)
    SELECT * FROM (SELECT topic_group, o.cluster, articles, articles - dated + coalesce(k, 0) AS articles_shown FROM o LEFT JOIN i ON o.cluster = i.cluster WHERE topic_group IN ('social', 'politica') AND articles >= 5) WHERE articles_shown > 0""")
def _(spark, d):
    df = cd(spark, d)
    overview = df.where("cluster <> -1").groupBy("topic_group", "cluster").agg(F.count("*").alias("articles"), F.count("published_at").alias("dated"))
    return serving.visible_clusters(overview, serving.daily_counts(df), ["social", "politica"], 5, "2022-01-01", "2023-12-31")


@query("R10_filtered_stats", "SELECT cluster, topic_group, article_count, burst_score FROM cluster_temporal_stats WHERE topic_group IN ('social', 'sport') AND article_count >= 10 AND burst_score >= 1")
def _(spark, d):
    return stats(spark, d).where(F.col("topic_group").isin("social", "sport") & (F.col("article_count") >= 10) & (F.col("burst_score") >= 1)).select("cluster", "topic_group", "article_count", "burst_score")


@query("R13_month_series", "SELECT cluster, last_day(published_at) AS month_end, count(*) AS n FROM clustered_data WHERE cluster <> -1 AND published_at IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return cd(spark, d).where("cluster <> -1 and published_at is not null").groupBy("cluster", F.last_day("published_at").alias("month_end")).agg(F.count("*").alias("n"))


_W = ["campaign_support_weight", "campaign_recurrence_weight", "campaign_active_days_weight", "campaign_source_diversity_weight", "campaign_span_weight", "campaign_narrative_weight"]
_SEVERITY = "CASE WHEN campaign_candidate_score >= 5 THEN 'HIGH' WHEN campaign_candidate_score >= 2 THEN 'MEDIUM' ELSE 'LOW' END"


@query("R15_X15_top_campaigns", "WITH t AS (SELECT * FROM cluster_temporal_stats ORDER BY campaign_candidate_score DESC NULLS LAST, cluster LIMIT 15) " + " UNION ALL ".join(
    f"SELECT cluster, '#' || cluster || ' ' || topic_group AS label, {_SEVERITY} AS severity, '{w.replace('_', ' ')}' AS component, {w} AS weight FROM t" for w in _W))
def _(spark, d):
    """The fifteen first campaign candidates, each weight of theirs a row, with a severity."""
    s = F.col("campaign_candidate_score")
    top = stats(spark, d).orderBy(s.desc_nulls_last(), "cluster").limit(15)
    top = top.select("cluster", F.concat(F.lit("#"), F.col("cluster").cast("string"), F.lit(" "), F.col("topic_group")).alias("label"), F.when(s >= 5, "HIGH").when(s >= 2, "MEDIUM").otherwise("LOW").alias("severity"), *_W)
    return top.unpivot(["cluster", "label", "severity"], _W, "component", "weight").withColumn("component", F.replace("component", F.lit("_"), F.lit(" ")))


@query("T4_top_suspicious", "SELECT cluster, suspicion_score FROM (SELECT cluster, suspicion_score FROM cluster_temporal_stats ORDER BY suspicion_score DESC NULLS LAST, cluster LIMIT 15) ORDER BY suspicion_score ASC, cluster DESC")
def _(spark, d):
    """The highest scores in reverse, as a bar chart draws them."""
    top = stats(spark, d).select("cluster", "suspicion_score").orderBy(F.desc_nulls_last("suspicion_score"), "cluster").limit(15)
    return top.orderBy(F.asc("suspicion_score"), F.desc("cluster"))


@query("R17_F22_runtime_long", """
    SELECT topic_group, stage, coalesce(seconds, 0.0) AS seconds FROM (SELECT topic_group, embedding_seconds, faiss_seconds, umap_seconds, hdbscan_sweep_seconds, label_apply_seconds FROM topic_runtime WHERE topic_group <> '__GLOBAL__')
    UNPIVOT INCLUDE NULLS (seconds FOR stage IN (embedding_seconds, faiss_seconds, umap_seconds, hdbscan_sweep_seconds, label_apply_seconds))""")
def _(spark, d):
    cols = ["embedding_seconds", "faiss_seconds", "umap_seconds", "hdbscan_sweep_seconds", "label_apply_seconds"]
    t = table(spark, d, "topic_runtime").where("topic_group <> '__GLOBAL__'").select("topic_group", *cols)
    return t.unpivot("topic_group", cols, "stage", "seconds").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))


_DOMAINS = """
    d AS (SELECT domain, count(*) AS n_rows, count(published_at) AS timestamped, count(*) FILTER (timestamp_source = 'url') AS n_url, count(*) FILTER (timestamp_source = 'text') AS n_text, count(*) FILTER (timestamp_source = 'htmldate') AS n_htmldate,
            count(*) FILTER (timestamp_source = 'missing') AS n_missing FROM (SELECT *, coalesce(nullif(trim(source_domain), ''), 'missing') AS domain FROM clustered_data) GROUP BY 1),
    p AS (SELECT *, round(100.0::DOUBLE * timestamped / n_rows, 6) AS coverage_pct FROM d)"""


@query("R21_domain_report", f"""
    WITH {_DOMAINS} SELECT 'volume' AS list, row_number() OVER (ORDER BY n_rows DESC, timestamped DESC, domain) AS place, * FROM p QUALIFY place <= 15
    UNION ALL SELECT 'weak', row_number() OVER (ORDER BY coverage_pct, n_rows DESC, domain) AS place, * FROM p WHERE n_rows >= 20 QUALIFY place <= 15""")
def _(spark, d):
    """The largest sites with their coverage by date source, and the weakest ones of twenty rows or more."""
    df = cd(spark, d).withColumn("domain", F.coalesce(F.nullif(F.trim("source_domain"), F.lit("")), F.lit("missing")))
    p = evaluation.domain_summary(df)
    first = lambda x, name, *order: x.orderBy(*order).limit(15).select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"), "*")
    return first(p, "volume", F.desc("n_rows"), F.desc("timestamped"), "domain").unionByName(first(p.where("n_rows >= 20"), "weak", "coverage_pct", F.desc("n_rows"), "domain"))


# --- campaign ---------------------------------------------------------------------------------------------------------


def _any(terms):
    return f"regexp_matches(' ' || n || ' ', ' ({'|'.join(terms)}) ')"


_ORGANIC = f"({_any(campaign.HARD_EVENT_TERMS)} OR (regexp_matches(n, 'covid|coronavirus|vaccin|carantin|pcr') AND {_any(ROUTINE_HEALTH_TERMS)}))"
_Z = "coalesce(CASE WHEN isfinite(CAST({0} AS DOUBLE)) THEN CAST({0} AS DOUBLE) END, 0)"


B8_SQL = f"""
    WITH b AS (SELECT *, {_NORMAL} AS n FROM cluster_temporal_stats), f AS (SELECT *, {_ORGANIC} AS organic, {_any(campaign.PUBLIC_AFFAIRS_TERMS)} AS pub FROM b)
    SELECT cluster, organic AS organic_event_title, pub AS public_affairs_title, round(greatest(0.0::DOUBLE, {_Z.format('suspicion_score')} * least(1, {_Z.format('total_articles')} / 50) * least(1, {_Z.format('burst_periods_daily')} / 5) * least(1, {_Z.format('active_days')} / 20)
        * (0.65::DOUBLE + 0.35::DOUBLE * least(1, greatest(0, ({_Z.format('domain_count')} - 1) / 5))) * least(1, greatest(0, 1 - greatest(0, coalesce(CAST(span_days AS DOUBLE), 10000) - 180) / 185))
        * CASE WHEN {_Z.format('domain_count')} <= 1 THEN 0 WHEN organic THEN 0 WHEN pub OR topic_group IN ('politica', 'economie', 'justitie') THEN 1 ELSE 0.55::DOUBLE END), 3) AS score FROM f"""


@query("B8_campaign", B8_SQL)
def _(spark, d):
    base = stats(spark, d).select("cluster", "topic_group", "representative_title", "suspicion_score", "total_articles", "burst_periods_daily", "active_days", "domain_count", "span_days")
    return campaign.campaign_columns(base).select("cluster", "organic_event_title", "public_affairs_title", F.col("campaign_candidate_score").alias("score"))


@query("B10_rescore_top", f"SELECT cluster, score AS campaign_candidate_score FROM ({B8_SQL}) ORDER BY score DESC, cluster LIMIT 20")
def _(spark, d):
    s = campaign.campaign_columns(stats(spark, d))
    return s.select("cluster", "campaign_candidate_score").orderBy(F.desc("campaign_candidate_score"), "cluster").limit(20)


_COVID = "|".join(campaign.NARRATIVES[0][1])


@query("X9_F13_timelines", f"""
    WITH t AS (SELECT cluster FROM (SELECT cluster, campaign_candidate_score AS s, {_NORMAL} AS n FROM cluster_temporal_stats) WHERE NOT regexp_matches(n, '{_COVID}') AND isfinite(s) ORDER BY s DESC, cluster LIMIT 3)
    SELECT cluster, CAST(published_at AS DATE) AS day, count(*) AS articles FROM clustered_data WHERE published_at IS NOT NULL AND cluster IN (SELECT cluster FROM t) GROUP BY ALL""")
def _(spark, d):
    s = F.col("campaign_candidate_score")
    top = stats(spark, d).where(s.isNotNull() & ~F.isnan(s) & ~campaign.is_covid(normalize_text(F.col("representative_title")))).orderBy(F.desc("campaign_candidate_score"), "cluster").limit(3).select("cluster")
    return serving.daily_counts(cd(spark, d)).join(top, "cluster", "left_semi").groupBy("cluster", "day").agg(F.sum("articles").alias("articles"))


# --- vectors ----------------------------------------------------------------------------------------------------------

_V = "v AS (SELECT topic_group AS g, topic_row_idx AS i, vec::DOUBLE[] AS x FROM article_vectors WHERE vec IS NOT NULL AND len(list_filter(vec, lambda z: z IS NULL)) = 0 AND list_sum(list_transform(vec, lambda z: abs(z))) > 0)"


def av(spark, d):
    v = table(spark, d, "article_vectors")
    return v.where(F.col("vec").isNotNull() & (F.size(F.filter("vec", lambda x: x.isNull())) == 0) & (vectors.norm(F.col("vec")) > 0))


@query("V2_exact_knn", f"""
    WITH {_V}, p AS (SELECT a.g AS grp, a.i AS id, b.i AS neighbour, round(list_inner_product(a.x, b.x), 6) AS score FROM v a JOIN v b ON a.g = b.g AND a.i <> b.i WHERE a.i % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY grp, id ORDER BY score DESC, neighbour) AS rank FROM p)
    SELECT grp, id, neighbour, rank, score FROM r WHERE rank <= 10""")
def _(spark, d):
    """Exact neighbours of a stated query set (ids divisible by 20) among all rows of their topic."""
    v = av(spark, d)
    return vectors.exact_knn(v, v.where("topic_row_idx % 20 = 0"), "topic_row_idx", "vec", "topic_group")


_LAB = "l AS (SELECT c.topic_group AS g, c.topic_row_idx AS i, c.cluster AS k, v.x FROM clustered_data c JOIN v ON v.g = c.topic_group AND v.i = c.topic_row_idx)"


def labelled(spark, d):
    return av(spark, d).join(cd(spark, d).select("topic_group", "topic_row_idx", "cluster"), ["topic_group", "topic_row_idx"])


@query("A19_V13_intra_cosine", f"""
    WITH {_V}, {_LAB}, u AS (SELECT k, list_transform(x, lambda z: z / sqrt(list_inner_product(x, x))) AS u FROM l WHERE k <> -1),
        e AS (SELECT k, unnest(u) AS z, generate_subscripts(u, 1) AS j FROM u), s AS (SELECT k, j, sum(z) AS z, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT k AS cluster, max(n) AS n, round(CASE WHEN max(n) > 1 THEN (sum(z * z) - max(n)) / (max(n) * (max(n) - 1)) END, 6) AS mean_cosine FROM s GROUP BY 1""")
def _(spark, d):
    return vectors.intra_cluster_cosine(labelled(spark, d).where("cluster <> -1"), ["cluster"], "vec").select("cluster", "n", F.round("mean_cosine", 6).alias("mean_cosine"))


_SUMS = """u AS (SELECT g, i, k, list_transform(x, lambda z: z / sqrt(list_inner_product(x, x))) AS u FROM l WHERE k <> -1),
    ue AS (SELECT g, k, unnest(u) AS z, generate_subscripts(u, 1) AS j FROM u), us AS (SELECT g, k, j, sum(z) AS z, count(*) AS n FROM ue GROUP BY 1, 2, 3), sums AS (SELECT g, k, list(z ORDER BY j) AS s, max(n) AS n FROM us GROUP BY 1, 2)"""


@query("V8_silhouette", f"""
    WITH {_V}, {_LAB}, {_SUMS}, d AS (SELECT u.g, u.i, u.k, s.k AS o, s.n, CASE WHEN u.k = s.k THEN (s.n - list_inner_product(u.u, s.s)) / greatest(s.n - 1, 1) ELSE 1 - list_inner_product(u.u, s.s) / s.n END AS d FROM u JOIN sums s ON u.g = s.g),
        p AS (SELECT g, i, k, max(d) FILTER (k = o) AS a, min(d) FILTER (k <> o) AS b, max(n) FILTER (k = o) AS n FROM d GROUP BY 1, 2, 3)
    SELECT g AS grp, round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM p GROUP BY 1""")
def _(spark, d):
    s = vectors.silhouette_cosine(labelled(spark, d).where("cluster <> -1"), "topic_group", "topic_row_idx", "cluster", "vec")
    return s.groupBy("grp").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query("V9_davies_bouldin", f"""
    WITH {_V}, {_LAB}, e AS (SELECT g, k, i, unnest(x) AS z, generate_subscripts(x, 1) AS j FROM l WHERE k <> -1), cj AS (SELECT g, k, j, avg(z) AS c FROM e GROUP BY 1, 2, 3),
        s AS (SELECT g, k, avg(r) AS s FROM (SELECT e.g, e.k, e.i, sqrt(sum((e.z - cj.c) * (e.z - cj.c))) AS r FROM e JOIN cj ON e.g = cj.g AND e.k = cj.k AND e.j = cj.j GROUP BY 1, 2, 3) GROUP BY 1, 2),
        c AS (SELECT g, k, list(c ORDER BY j) AS c FROM cj GROUP BY 1, 2), p AS (SELECT c.g, c.k, c.c, s.s FROM c JOIN s ON c.g = s.g AND c.k = s.k),
        w AS (SELECT a.g, a.k, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM p a JOIN p b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2)
    SELECT g AS grp, round(avg(r), 6) AS davies_bouldin FROM w GROUP BY 1""")
def _(spark, d):
    s = vectors.davies_bouldin(labelled(spark, d).where("cluster <> -1"), "topic_group", "cluster", "vec")
    return s.select("grp", F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query("V10_calinski_harabasz", f"""
    WITH {_V}, {_LAB}, e AS (SELECT g, k, i, unnest(x) AS z, generate_subscripts(x, 1) AS j FROM l WHERE k <> -1),
        c AS (SELECT g, k, j, avg(z) AS m, count(*) AS n FROM e GROUP BY 1, 2, 3), t AS (SELECT g, j, avg(z) AS m FROM e GROUP BY 1, 2),
        w AS (SELECT e.g, sum((z - c.m) * (z - c.m)) AS within, count(DISTINCT e.i) AS n, count(DISTINCT e.k) AS k FROM e JOIN c ON e.g = c.g AND e.k = c.k AND e.j = c.j GROUP BY 1),
        b AS (SELECT c.g, sum(c.n * (c.m - t.m) * (c.m - t.m)) AS between FROM c JOIN t ON c.g = t.g AND c.j = t.j GROUP BY 1)
    SELECT w.g AS grp, w.k, w.n, round(within, 4) AS within, round(between, 4) AS between, round(CASE WHEN w.k > 1 AND within > 0 THEN (between / (w.k - 1)) / (within / (w.n - w.k)) END, 4) AS calinski_harabasz FROM w JOIN b ON w.g = b.g""")
def _(spark, d):
    s = vectors.dispersion(labelled(spark, d).where("cluster <> -1"), "topic_group", "cluster", "vec")
    return s.select("grp", "k", "n", F.round("within", 4).alias("within"), F.round("between", 4).alias("between"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


@query("V11_cluster_counts", """
    WITH c AS (SELECT topic_group, cluster, count(*) AS n FROM clustered_data GROUP BY 1, 2)
    SELECT topic_group, count(*) FILTER (cluster <> -1) AS clusters, round(100.0::DOUBLE * coalesce(sum(n) FILTER (cluster = -1), 0) / sum(n), 6) AS noise_pct, coalesce(max(n) FILTER (cluster <> -1), 0) AS largest FROM c GROUP BY 1""")
def _(spark, d):
    real = F.col("cluster") != -1
    n = cd(spark, d).groupBy("topic_group", "cluster").agg(F.count("*").alias("n"))
    noise = F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0))
    return n.groupBy("topic_group").agg(F.count_if(real).alias("clusters"), F.round(100 * noise / F.sum("n"), 6).alias("noise_pct"), F.coalesce(F.max(F.when(real, F.col("n"))), F.lit(0)).alias("largest"))


@query("V7_selection_score", """
    SELECT topic_group, min_cluster_size, round((100 - noise_percent) - CASE WHEN topic_size < 1000 THEN 120 ELSE 150 END * largest_real_cluster / topic_size::DOUBLE + CASE WHEN topic_size < 1000 THEN 30 ELSE 20 END * coalesce(silhouette, 0)
        + least(num_clusters, 100) / 10.0::DOUBLE - CASE WHEN num_clusters < 3 THEN 100 ELSE 0 END, 6) AS score FROM sweep_results""")
def _(spark, d):
    small = F.col("topic_size") < 1000
    s = (100 - F.col("noise_percent")) - F.when(small, 120).otherwise(150) * F.col("largest_real_cluster") / F.col("topic_size") + F.when(small, 30).otherwise(20) * F.coalesce("silhouette", F.lit(0.0)) + F.least("num_clusters", F.lit(100)) / 10
    return table(spark, d, "sweep_results").select("topic_group", "min_cluster_size", F.round(s - F.when(F.col("num_clusters") < 3, 100).otherwise(0), 6).alias("score"))


@query("V18_requested_k", """
    SELECT topic_group, greatest(2, least(greatest(num_clusters, 3), topic_size - 1)) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY topic_group ORDER BY selection_score DESC NULLS LAST, min_cluster_size, min_samples) AS r FROM sweep_results) WHERE r = 1""")
def _(spark, d):
    """Clusters to ask k-means for: those of the best configuration, at least three, bounded by the topic."""
    best = serving.best_config(table(spark, d, "sweep_results"))
    return best.select("topic_group", text_model.bounded_k(F.greatest("num_clusters", F.lit(3)), F.col("topic_size")).alias("k"))


def nostop(spark, d):
    df = spread(cd(spark, d).select("topic_group", "row_idx", "cluster", "document"))
    kept = text.document_nostop(F.col("document"), curation.corpus_stopwords(df, "document"))
    return materialize(df.select("topic_group", "row_idx", "cluster", kept.alias("document_nostop")), "documents-nostop")  # read several times


#: TF-IDF of documents without stopwords by topic, in SQL.
TFIDF_WITH = f"""
    {NOSTOP_WITH}, ns AS ({NOSTOP_SQL}),
    w AS (SELECT topic_group, row_idx, regexp_extract_all(lower(kept), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM ns),
    t AS (SELECT topic_group, row_idx, unnest(list_concat(w, list_transform(list_zip(w[1:-2], w[2:]), lambda z: z[1] || ' ' || z[2]))) AS term FROM w),
    f AS (SELECT topic_group, row_idx, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT topic_group, count(*) AS n FROM clustered_data GROUP BY 1),
    d AS (SELECT *, row_number() OVER (PARTITION BY topic_group ORDER BY cf DESC, term) AS r FROM (SELECT topic_group, term, count(*) AS df, sum(tf) AS cf FROM f GROUP BY 1, 2 HAVING count(*) >= 2)),
    x AS (SELECT f.topic_group, row_idx, f.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM f JOIN d ON f.topic_group = d.topic_group AND f.term = d.term JOIN n ON n.topic_group = f.topic_group WHERE r <= 10000),
    tfidf AS (SELECT topic_group, row_idx AS id, term, w / sqrt(sum(w * w) OVER (PARTITION BY topic_group, row_idx)) AS weight FROM x)"""


@query("V14_tfidf", f"WITH {TFIDF_WITH} SELECT topic_group, id, term, round(weight, 6) AS weight FROM tfidf")
def _(spark, d):
    """TF-IDF of whole documents without stopwords, in any script."""
    return text_model.tfidf(nostop(spark, d), "row_idx", "document_nostop", ["topic_group"]).withColumn("weight", F.round("weight", 6))


@query("V19_top_terms", f"""
    WITH {TFIDF_WITH}, s AS (SELECT topic_group, cluster AS label, count(*) AS n FROM clustered_data WHERE cluster <> -1 GROUP BY 1, 2),
        m AS (SELECT t.topic_group, c.cluster AS label, term, round(sum(weight) / max(s.n), 6) AS mean_weight FROM tfidf t JOIN clustered_data c ON c.row_idx = t.id AND c.cluster <> -1 JOIN s ON s.topic_group = t.topic_group AND s.label = c.cluster GROUP BY 1, 2, 3)
    SELECT topic_group, label, rank, term, mean_weight FROM (SELECT *, row_number() OVER (PARTITION BY topic_group, label ORDER BY mean_weight DESC, term) AS rank FROM m) WHERE rank <= 10""")
def _(spark, d):
    """Top terms of every cluster, from whole documents without stopwords."""
    df = nostop(spark, d)
    w = text_model.tfidf(df, "row_idx", "document_nostop", ["topic_group"])
    labels = df.where("cluster <> -1").select("topic_group", F.col("row_idx").alias("id"), F.col("cluster").alias("label"))
    return text_model.top_terms(w, labels, ["topic_group"])


@query("V4_reduced")
def _(spark, d):
    return text_model.reduce_dimensions(av(spark, d), "vec", 15).select("topic_group", "topic_row_idx", "reduced")


def topic_kmeans(spark, d):
    """(grp, id, label): k-means of each topic, with the number of clusters of its best sweep row, at least three."""
    k = serving.best_config(table(spark, d, "sweep_results")).select(F.col("topic_group").alias("grp"), F.greatest("num_clusters", F.lit(3)).alias("k"))
    return text_model.kmeans_by_topic(topic_vectors(spark, d), "topic_group", "topic_row_idx", "vec", k)


@query("V16_V17_kmeans")
def _(spark, d):
    """K-means of every topic apart; labels count from 0 within a topic."""
    return topic_kmeans(spark, d).select(F.col("grp").alias("topic_group"), F.col("id").alias("topic_row_idx"), "label")


def topic_vectors(spark, d):
    """Unit vectors of the articles, and whether their topic is large enough to be clustered."""
    eligible = cd(spark, d).where("topic_is_eligible").select("topic_group", F.lit(True).alias("eligible")).distinct()
    v = av(spark, d).join(eligible, "topic_group", "left")
    return v.select("topic_group", "topic_row_idx", vectors.unit(F.col("vec")).alias("vec"), F.coalesce("eligible", F.lit(False)).alias("eligible"))


@query("V5_density_clusters")
def _(spark, d):
    """Density clusters of every eligible topic; the articles of other topics are noise."""
    v = topic_vectors(spark, d)
    found = density.global_labels(density.density_clusters(v.where("eligible"), "topic_group", "topic_row_idx", "vec"))
    rest = v.where("not eligible").select(F.col("topic_group").alias("grp"), F.col("topic_row_idx").alias("id"), F.lit(-1).cast("long").alias("cluster"), F.lit(0.0).alias("strength"))
    return found.unionByName(rest)


@query("V12_graph_cohesion", f"""
    WITH {_V}, {_LAB}, u AS (SELECT g, i, k, list_transform(x, lambda z: z / sqrt(list_inner_product(x, x))) AS u FROM l),
        p AS (SELECT a.g, a.i, a.k, b.k AS o, row_number() OVER (PARTITION BY a.g, a.i ORDER BY round(list_inner_product(a.u, b.u), 6) DESC, b.i) AS r FROM u a JOIN u b ON a.g = b.g AND a.i <> b.i),
        s AS (SELECT g, i, k, avg((k = o)::DOUBLE) AS s FROM p WHERE r <= 10 GROUP BY 1, 2, 3)
    SELECT g AS topic_group, round(avg(s), 6) AS cohesion, round(avg(s) FILTER (k <> -1), 6) AS cohesion_real FROM s GROUP BY 1""")
def _(spark, d):
    """Cohesion of every topic over all its labelled articles: each with its ten nearest by cosine in its topic."""
    v = materialize(labelled(spark, d).select("topic_group", "topic_row_idx", "cluster", vectors.unit(F.col("vec")).alias("vec")), "cohesion-vectors")  # read several times
    edges = vectors.all_nearest(v, "topic_row_idx", "vec", "topic_group")
    labels = v.select(F.col("topic_group").alias("grp"), F.col("topic_row_idx").alias("id"), F.col("cluster").alias("label"))
    c = vectors.graph_cohesion(edges.select("grp", "id", "neighbour"), labels, ["grp"])
    return c.select(F.col("grp").alias("topic_group"), F.round("cohesion", 6).alias("cohesion"), F.round("cohesion_real", 6).alias("cohesion_real"))


# --- figure inputs not covered above ----------------------------------------------------------------------------------


@query("F3_coverage", "SELECT topic_group, round(100.0::DOUBLE * count(published_at) / count(*), 6) AS coverage_pct FROM clustered_data GROUP BY 1")
def _(spark, d):
    return cd(spark, d).groupBy("topic_group").agg(F.round(100 * F.count("published_at") / F.count("*"), 6).alias("coverage_pct"))


@query("F9_sweep_best", "SELECT topic_group, min_cluster_size, silhouette, noise_percent, selection_score = max(selection_score) OVER (PARTITION BY topic_group) AS best FROM sweep_results")
def _(spark, d):
    w = Window.partitionBy("topic_group")
    return table(spark, d, "sweep_results").select("topic_group", "min_cluster_size", "silhouette", "noise_percent", (F.col("selection_score") == F.max("selection_score").over(w)).alias("best"))


@query("F11_score_histograms", """
    WITH s AS (SELECT suspicion_score AS s, CASE WHEN domain_count > 1 THEN suspicion_score ELSE 0.0 END AS m FROM cluster_temporal_stats), e AS (SELECT greatest(max(s), max(m)) + 0.5::DOUBLE AS top FROM s),
        v AS (SELECT 'all' AS kind, s AS v FROM s WHERE s IS NOT NULL UNION ALL SELECT 'multi', m FROM s WHERE m IS NOT NULL)
    SELECT kind, CAST(least(floor(round(v / top * 39, 9)), 38) AS BIGINT) AS bin, count(*) AS n FROM v, e GROUP BY ALL""")
def _(spark, d):
    """Scores of all clusters and of those of several sites (others count as 0), in 39 bins between 40 even edges."""
    s = stats(spark, d).select(F.col("suspicion_score").alias("s"), F.when(F.col("domain_count") > 1, F.col("suspicion_score")).otherwise(0.0).alias("m"))
    top = s.agg((F.greatest(F.max("s"), F.max("m")) + 0.5).alias("top"))
    v = s.select(F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.col("s").alias("v")), F.struct(F.lit("multi").alias("kind"), F.col("m").alias("v")))).alias("x")).select("x.*").where("v is not null")
    bin_ = F.least(F.floor(F.round(F.col("v") / F.col("top") * 39, 9)), F.lit(38)).cast("long")
    return v.crossJoin(F.broadcast(top)).groupBy("kind", bin_.alias("bin")).agg(F.count("*").alias("n"))  # top is one row


@query("F16_entropy_points", "SELECT cluster, domain_entropy, suspicion_score, domain_count = 1 AS single_source, round(greatest(4, least(50, sqrt(article_count))), 6) AS size FROM cluster_temporal_stats WHERE article_count IS NOT NULL")
def _(spark, d):
    size = F.greatest(F.lit(4.0), F.least(F.lit(50.0), F.sqrt("article_count")))
    return stats(spark, d).where("article_count is not null").select("cluster", "domain_entropy", "suspicion_score", (F.col("domain_count") == 1).alias("single_source"), F.round(size, 6).alias("size"))

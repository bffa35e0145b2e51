"""Temporal profiles of clusters: bursts, gaps, source mix, entropy, and the scores built on them.

Everything is aggregation and windows keyed by cluster; no calendar is filled with zeros, because an empty bucket can
never burst, and no Python runs.

Input columns: cluster, ts (timestamp, null if undated), domain, timestamp_source, topic_group, title, row_idx.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import tuesday_week, whole_days
from ..session import materialize


@dataclass(frozen=True)
class BurstParams:
    scale: float = 2.0
    gamma: float = 1.0
    least_articles: int = 3
    least_buckets: int = 2


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or absent."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def bucket_counts(df: DataFrame, step: int) -> DataFrame:
    """(cluster, bucket, c): dated articles per day (step 1) or per week from Tuesday (step 7)."""
    day = F.to_date("ts")
    bucket = day if step == 1 else tuesday_week(day)
    return df.where("ts is not null").groupBy("cluster", bucket.alias("bucket")).agg(F.count("*").alias("c"))


def burst_levels(counts: DataFrame, step: int, p: BurstParams = BurstParams()) -> DataFrame:
    """Per bucket of a cluster its level, 1 where the count speaks for the raised rate by more than gamma."""
    w = Window.partitionBy("cluster")
    n = F.sum("c").over(w)
    t = F.datediff(F.max("bucket").over(w), F.min("bucket").over(w)) / step + 1
    rate = n / t
    gain = F.col("c") * (F.ln(p.scale * rate + 1e-10) - F.ln(rate + 1e-10)) - (p.scale * rate - rate) - p.gamma
    level = F.when((n >= p.least_articles) & (t >= p.least_buckets) & (gain > 0), 1).otherwise(0)
    return counts.select("cluster", "bucket", "c", level.alias("level"))


def burst_periods(levels: DataFrame, step: int) -> DataFrame:
    """(cluster, start, end, buckets): maximal runs of bursting buckets, by gaps and islands."""
    w = Window.partitionBy("cluster").orderBy("bucket")
    island = F.datediff("bucket", F.to_date(F.lit("1970-01-01"))) / step - F.row_number().over(w)
    hot = levels.where("level = 1").withColumn("island", island)
    return hot.groupBy("cluster", "island").agg(F.min("bucket").alias("start"), F.max("bucket").alias("end"), F.count("*").alias("buckets")).drop("island")


def burst_summary(df: DataFrame, step: int) -> DataFrame:
    """burst_figures of articles."""
    return burst_figures(bucket_counts(df, step), step)


def burst_figures(counts: DataFrame, step: int) -> DataFrame:
    """(cluster, score, periods, duration) of counts by bucket: level reached, number of periods, their days or weeks."""
    return burst_periods(burst_levels(counts, step), step).groupBy("cluster").agg(F.lit(1).cast("long").alias("score"), F.count("*").alias("periods"), F.sum("buckets").alias("duration"))


def dense_levels(df: DataFrame, step: int, p: BurstParams = BurstParams()) -> DataFrame:
    """burst_levels over an explicit zero-filled calendar: the same bursts, kept to test that the calendar is not needed."""
    counts = bucket_counts(df, step)
    span = counts.groupBy("cluster").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    calendar = span.select("cluster", F.explode(F.expr(f"sequence(a, b, interval {step} day)")).alias("bucket"))
    return burst_levels(calendar.join(counts, ["cluster", "bucket"], "left").withColumn("c", F.coalesce("c", F.lit(0))), step, p)


def normalized_entropy(counts: DataFrame, key: str, count: str) -> DataFrame:
    """(key, entropy): Shannon entropy of the shares divided by its maximum; 0 for a single value; 4 decimals."""
    share = F.col(count) / F.sum(count).over(Window.partitionBy(key))
    agg = counts.withColumn("p", share).groupBy(key).agg(F.sum(-F.col("p") * F.ln(F.col("p") + 1e-12)).alias("h"), F.count("*").alias("k"))
    return agg.select(key, F.when(F.col("k") <= 1, 0.0).otherwise(F.round(F.col("h") / F.ln(F.col("k")), 4)).alias("entropy"))


def profile(df: DataFrame) -> DataFrame:
    """The temporal measures of every cluster that has dated articles (noise, cluster -1, left out).

    The articles are read twice: once into counts by cluster, day, site, source and topic, from which nearly everything
    follows, and once for the spread of their days, which takes the hour of each.
    """
    real = df.where("cluster <> -1")
    source = F.lower(F.coalesce("timestamp_source", F.lit("missing"))).alias("source")
    cells = real.groupBy("cluster", F.to_date("ts").alias("day"), "domain", source, "topic_group").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min(F.struct("row_idx", F.substring(F.coalesce("title", F.lit("")), 1, 200).alias("title"))).alias("first_row")
    )
    cells = materialize(cells, "temporal-cells")
    dated = F.col("day").isNotNull()
    held = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    base = cells.groupBy("cluster").agg(
        F.sum("n").alias("total_articles"), held(dated).alias("timestamped_articles"), *[held(F.col("source") == s).alias(f"n_{s}") for s in ("url", "text", "missing")],
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min("first_row")["title"].alias("representative_title"),
    ).where("timestamped_articles > 0")
    topics = cells.where(dated & F.col("topic_group").isNotNull()).groupBy("cluster", "topic_group").agg(F.sum("n").alias("n"))
    topics = topics.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "topic_group"))["topic_group"].alias("topic_group"))
    # from sums of whole days, which are the same however the rows are divided
    day = whole_days(F.col("ts"), F.col("first_ts"))
    sums = real.where("ts is not null").join(base.select("cluster", "first_ts"), "cluster").groupBy("cluster").agg(F.count("*").alias("k"), F.sum(day).cast("double").alias("s"), F.sum(day * day).cast("double").alias("q"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("k")) / (F.col("k") - 1))
    offsets = sums.select("cluster", F.when(F.col("k") > 1, spread).otherwise(0.0).alias("temporal_spread_days"))
    daily = cells.where(dated).groupBy("cluster", F.col("day").alias("bucket")).agg(F.sum("n").alias("c"))
    weekly = cells.where(dated).groupBy("cluster", tuesday_week(F.col("day")).alias("bucket")).agg(F.sum("n").alias("c"))
    gap = F.greatest(F.datediff("bucket", F.lag("bucket").over(Window.partitionBy("cluster").orderBy("bucket"))) - 1, F.lit(0))
    gap = F.when(F.lag("bucket").over(Window.partitionBy("cluster").orderBy("bucket")).isNotNull(), gap)
    days = daily.withColumn("gap", gap).groupBy("cluster").agg(
        F.count("*").alias("active_days"), F.max("c").alias("peak_day_count"), F.coalesce(F.median("gap"), F.lit(0.0)).alias("median_gap_days"), F.coalesce(F.max("gap"), F.lit(0)).cast("double").alias("max_gap_days")
    )
    per_domain = cells.groupBy("cluster", "domain").agg(F.sum("n").alias("n"), held(dated).alias("n_dated"))
    domains = per_domain.groupBy("cluster").agg(
        F.count("*").alias("domain_count"), (F.max("n") / F.sum("n")).alias("top_domain_share"), F.count_if(F.col("n_dated") > 0).alias("timestamped_domain_count"),
        (F.max("n_dated") / F.greatest(F.sum("n_dated"), F.lit(1))).alias("top_timestamp_domain_share"),
    )
    entropy = normalized_entropy(per_domain, "cluster", "n").withColumnRenamed("entropy", "domain_entropy")
    out = base.join(topics, "cluster", "left").join(offsets, "cluster").join(days, "cluster").join(domains, "cluster").join(entropy, "cluster")
    for counts, step, name in ((daily, 1, "daily"), (weekly, 7, "weekly")):
        b = burst_figures(counts, step).select("cluster", F.col("score").alias(f"burst_score_{name}"), F.col("periods").alias(f"burst_periods_{name}"), F.col("duration").alias(f"burst_duration_{name}"))
        out = out.join(b, "cluster", "left").fillna(0, [f"burst_score_{name}", f"burst_periods_{name}", f"burst_duration_{name}"])
    n, total = F.col("timestamped_articles"), F.col("total_articles")
    span = F.greatest(whole_days(F.col("last_ts"), F.col("first_ts")), F.lit(1))
    return (
        out.withColumn("span_days", span).withColumn("first_seen", F.to_date("first_ts")).withColumn("last_seen", F.to_date("last_ts"))
        .withColumn("timestamp_coverage_ratio", n / F.greatest(total, F.lit(1)))
        .withColumns({f"timestamp_source_{s}_share": safe_div(F.col(f"n_{s}"), total) for s in ("url", "text", "missing")})
        .withColumn("timestamp_source_reliability", F.col("timestamp_source_url_share") + 0.35 * F.col("timestamp_source_text_share"))
        .withColumn("active_day_ratio", safe_div(F.col("active_days"), F.col("span_days")))
        .withColumn("peak_day_share", F.col("peak_day_count") / F.greatest(n, F.lit(1)))
        .withColumn("concentration", safe_div(n, F.col("span_days")))
        .withColumn("peak_to_baseline_ratio", F.col("peak_day_count") / F.greatest(F.col("concentration"), F.lit(1e-9)))
        .withColumn("days_per_timestamped_article", safe_div(F.col("span_days"), n))
        .withColumn("compactness_index", F.col("active_day_ratio") * F.col("timestamp_coverage_ratio"))
        .withColumn("burst_stable", F.when((F.col("burst_duration_daily") > 0) & (F.col("burst_duration_weekly") > 0), 1).otherwise(0))
        .withColumn("burst_duration_share_daily", F.col("burst_duration_daily") / F.col("span_days"))
        .withColumn("burst_duration_share_weekly", F.least(7 * F.col("burst_duration_weekly") / F.col("span_days"), F.lit(1.0)))
        .drop("n_url", "n_text", "n_missing", "first_ts", "last_ts")
    )


def penalties() -> dict[str, Column]:
    """The penalties of a profile by name."""
    span, active = F.col("span_days"), F.col("active_day_ratio")
    return {
        "support_penalty": 0.75 * F.greatest(F.lit(0), 6 - F.col("timestamped_articles")),
        "long_sparse_span_penalty": F.log1p(span) * F.greatest(F.lit(0), span - 90) / 90 * (1 - active) * (1 - F.col("timestamp_coverage_ratio")) * 1.8,
        "single_domain_penalty": 4 * F.greatest(F.lit(0.0), F.col("top_domain_share") - 0.5) + F.when(F.col("domain_count") == 1, 1.75).otherwise(0.0) + 2 * F.greatest(F.lit(0.0), F.col("top_timestamp_domain_share") - 0.6),
        "source_reliability_penalty": 3 * (1 - F.col("timestamp_source_reliability")),
        "compact_penalty": 3 * F.greatest(F.lit(0.0), 0.20 - active),
    }


def suspicion(df: DataFrame) -> DataFrame:
    """A profile with its weights, penalties and the suspicion score."""
    raw = (
        4 * F.col("burst_score_daily") + 3 * F.col("burst_score_weekly") + 4 * F.col("burst_stable") + 2 * F.log1p("concentration") + 2.5 * F.log1p("peak_to_baseline_ratio")
        + 3 * F.col("peak_day_share") + 2.5 * F.col("burst_duration_share_daily") + 1.5 * F.col("burst_duration_share_weekly") + 0.75 * F.log1p("total_articles")
    )
    out = df.withColumns({
        "support_weight": F.least(F.lit(1.0), F.col("timestamped_articles") / 10),
        "coverage_weight": F.least(F.lit(1.0), 0.35 + 0.65 * F.col("timestamp_coverage_ratio")),
        "source_weight": 0.45 + 0.55 * F.least(F.lit(1.0), F.col("timestamp_source_reliability")),
        "domain_weight": 0.60 + 0.40 * F.least(F.lit(1.0), 1 - F.greatest(F.lit(0.0), F.col("top_domain_share") - 0.5)),
        "suspicion_score_raw": raw,
        **penalties(),
    })
    off = F.col("support_penalty") + F.col("long_sparse_span_penalty") + F.col("single_domain_penalty") + F.col("source_reliability_penalty") + F.col("compact_penalty")
    gated = F.col("suspicion_score_raw") * F.col("support_weight") * F.col("coverage_weight") * F.col("source_weight") * F.col("domain_weight")
    return out.withColumn("suspicion_penalty_total", F.round(off, 4)).withColumn("suspicion_score", F.round(F.greatest(F.lit(0.0), gated - off), 3))


def top_bursty(df: DataFrame, k: int = 20) -> DataFrame:
    """The k clusters of highest suspicion score."""
    cols = ["cluster", "topic_group", "total_articles", "timestamped_articles", "span_days", "burst_score_daily", "burst_periods_daily", "burst_score_weekly", "domain_count", "suspicion_score"]
    return suspicion(profile(df)).select(*cols).orderBy(F.desc("suspicion_score"), "cluster").limit(k)


def multiyear_repair(stats: DataFrame) -> DataFrame:
    """Recompute scores from stored columns with the long-span penalty lifted from robustly recurring clusters.

    Robustly recurring: 5 or more daily periods, 50 or more articles, 20 or more active days, 3 or more sites.
    """
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0))
    robust = (zero("burst_periods_daily") >= 5) & (zero("total_articles") >= 50) & (zero("active_days") >= 20) & (zero("domain_count") >= 3)
    span = zero("span_days")
    fresh = F.log1p(span) * F.greatest(F.lit(0.0), span - 90) / 90 * (1 - zero("active_day_ratio")) * (1 - zero("timestamp_coverage_ratio")) * 1.8
    total = zero("suspicion_penalty_total") - zero("long_sparse_span_penalty") + F.when(robust, 0.0).otherwise(fresh)
    gates = zero("support_weight") * zero("coverage_weight") * zero("source_weight") * zero("domain_weight")
    return stats.withColumn("robust_recurring", robust).withColumn("repaired_score", F.round(F.greatest(F.lit(0.0), zero("suspicion_score_raw") * gates - total), 3))


#: The columns of the temporal table in its order, but for those of campaign scoring, which follow.
TABLE_COLUMNS = (
    "cluster", "topic_group", "total_articles", "timestamped_articles", "timestamp_coverage_ratio", "timestamp_source_url_share", "timestamp_source_text_share", "timestamp_source_missing_share", "timestamp_source_reliability",
    "domain_count", "top_domain_share", "timestamped_domain_count", "top_timestamp_domain_share", "domain_entropy", "first_seen", "last_seen", "span_days", "temporal_spread_days", "active_days", "active_day_ratio",
    "median_gap_days", "max_gap_days", "days_per_timestamped_article", "compactness_index", "peak_day_count", "peak_day_share", "peak_to_baseline_ratio", "burst_score_daily", "burst_duration_daily", "burst_periods_daily",
    "burst_duration_share_daily", "burst_score_weekly", "burst_duration_weekly", "burst_periods_weekly", "burst_duration_share_weekly", "burst_stable", "concentration", "support_weight", "coverage_weight", "source_weight",
    "domain_weight", "long_sparse_span_penalty", "single_domain_penalty", "source_reliability_penalty", "suspicion_score_raw", "suspicion_penalty_total", "suspicion_score", "representative_title", "burst_score",
    "burst_duration_days", "article_count", "num_burst_periods",
)
CAMPAIGN_COLUMNS = (
    "organic_event_title", "public_affairs_title", "public_affairs_signal", "campaign_support_weight", "campaign_recurrence_weight", "campaign_active_days_weight", "campaign_source_diversity_weight", "campaign_span_weight",
    "campaign_narrative_weight", "campaign_candidate_score", "campaign_candidate",
)
#: The places the doubles of the table are rounded to, where not four.
PLACES = {"temporal_spread_days": 2, "median_gap_days": 2, "max_gap_days": 2, "suspicion_score": 3}


def temporal_table(df: DataFrame) -> DataFrame:
    """The temporal table of articles: profiles, scores, the older names of four columns and the campaign columns, by falling score."""
    from .campaign import campaign_columns

    s = suspicion(profile(df))
    s = s.withColumns({c: F.round(c, PLACES.get(c, 4)) for c, t in s.dtypes if t == "double"})
    s = s.withColumns({"burst_score": F.col("burst_score_daily"), "burst_duration_days": F.col("burst_duration_daily"), "article_count": F.col("total_articles"), "num_burst_periods": F.col("burst_periods_daily")})
    return campaign_columns(s).select(*TABLE_COLUMNS, *CAMPAIGN_COLUMNS).orderBy(F.desc("suspicion_score"), "cluster")


def burst_off(stats: DataFrame) -> DataFrame:
    """The suspicion score had there been no burst signal (the counterfactual of the ablation); absent values count as 0."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0))
    bursts = 4 * zero("burst_score_daily") + 3 * zero("burst_score_weekly") + 4 * zero("burst_stable")
    gates = zero("support_weight") * zero("coverage_weight") * zero("source_weight") * zero("domain_weight")
    return stats.withColumn("score_without_bursts", F.greatest(F.lit(0.0), (zero("suspicion_score_raw") - bursts) * gates - zero("suspicion_penalty_total")))

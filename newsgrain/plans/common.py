"""What the query modules share: the registers, and the temporal table with NaN and infinities as null."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: The columns of the temporal table that are doubles.
STATS_DOUBLES = (
    "timestamp_coverage_ratio", "timestamp_source_url_share", "timestamp_source_text_share", "timestamp_source_missing_share", "timestamp_source_reliability", "top_domain_share", "top_timestamp_domain_share",
    "domain_entropy", "temporal_spread_days", "active_day_ratio", "median_gap_days", "max_gap_days", "days_per_timestamped_article", "compactness_index", "peak_day_share", "peak_to_baseline_ratio",
    "burst_duration_share_daily", "burst_duration_share_weekly", "concentration", "support_weight", "coverage_weight", "source_weight", "domain_weight", "long_sparse_span_penalty", "single_domain_penalty",
    "source_reliability_penalty", "suspicion_score_raw", "suspicion_penalty_total", "suspicion_score", "campaign_support_weight", "campaign_recurrence_weight", "campaign_active_days_weight",
    "campaign_source_diversity_weight", "campaign_span_weight", "campaign_narrative_weight", "campaign_candidate_score",
)
_STATS_SQL = "(SELECT * REPLACE (" + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in STATS_DOUBLES) + ") FROM cluster_temporal_stats)"


def articles_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "clustered_data")


def stats(spark: SparkSession, d: str) -> DataFrame:
    """cluster_temporal_stats as it is served: NaN and infinities are null."""
    s = table(spark, d, "cluster_temporal_stats")
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in STATS_DOUBLES if c in s.columns}
    return s.withColumns(finite)


def register() -> tuple[dict, dict[str, str], Callable]:
    """(queries, their SQL, the decorator that fills both). In the SQL cluster_temporal_stats is as `stats` gives it."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(name: str, sql: str | None = None) -> Callable:
        def keep(fn: Callable) -> Callable:
            queries[name] = fn
            if sql:
                oracle[name] = re.sub(r"\bcluster_temporal_stats\b", lambda _: _STATS_SQL, sql)
            return fn

        return keep

    return queries, oracle, query

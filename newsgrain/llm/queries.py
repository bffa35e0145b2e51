"""Queries over the operators of this subpackage, as the driver calls them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .encode import encode_corpus
from .grid_clusters import group_pairs, group_report, occurrence_groups
from .leaks import leaked_spans, leaks
from .lookalike import look_classes, look_pairs
from .near_dups import classes, near_duplicates, row_pairs
from .oracle import ORACLE as EXACT
from .permutation_index import nearest, similar_pairs
from .personal import personal_data, redacted
from .ranking import combined_ranking, weighting_report
from .site_lines import confirmed_set, marked_lines, remove_lines, repeated_lines


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_pairs(_t(spark, d, "article_vectors"), "topic_row_idx", "vec", "topic_group")
    return pairs.select(F.col("grp").alias("topic_group"), F.col("a").alias("idx_a"), F.col("b").alias("idx_b"))


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar articles of every article, however similar."""
    return nearest(_t(spark, d, "article_vectors"), "topic_row_idx", "vec", "topic_group").withColumnsRenamed({"grp": "topic_group", "id": "topic_row_idx"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return marked_lines(_t(spark, d, "clustered_data")).select(F.col("row_id").alias("row_idx"), "line_no")


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    articles = _t(spark, d, "clustered_data")
    _, confirmed = repeated_lines(articles)
    lines = confirmed_set(confirmed)
    if lines is None:
        articles = remove_lines(articles, out_col="document")
    return near_duplicates(articles, "row_idx", "document", run=3, threshold=0.5, source_col="source_domain", lines=lines)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return row_pairs(*_copies(spark, d)).select(F.col("a").alias("row_a"), F.col("b").alias("row_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per article that is taken over: its class of equal texts, and how many other classes that is near to."""
    return classes(*_copies(spark, d)).withColumnRenamed("id", "row_idx")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = look_pairs(_t(spark, d, "clustered_data"), "row_idx", ["title", "document"])
    return pairs.select("field_name", F.col("a").alias("row_a"), F.col("b").alias("row_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per article and field whose look is stored in several ways: its class and its number of links."""
    return look_classes(_t(spark, d, "clustered_data"), "row_idx", ["title", "document"]).withColumnRenamed("id", "row_idx")


SCORES = ["burst_score", "suspicion_score", "domain_entropy", "peak_to_baseline_ratio"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    stats = _t(spark, d, "cluster_temporal_stats").select("cluster", *SCORES)
    ranked = combined_ranking(stats, "cluster", SCORES, weights="equal")
    return ranked.where(F.col("place") <= (2 * stats.count() + 99) // 100).select(F.col("id").alias("cluster"))


def p5_pc1_ranking(spark: SparkSession, d: str) -> DataFrame:
    stats = _t(spark, d, "cluster_temporal_stats").select("cluster", *SCORES)
    return combined_ranking(stats, "cluster", SCORES, weights="pc1").withColumnRenamed("id", "cluster")


def p5_weightings(spark: SparkSession, d: str) -> DataFrame:
    """The loadings of the component, and how its ranking and that of p5_found compare."""
    return weighting_report(_t(spark, d, "cluster_temporal_stats").select("cluster", *SCORES), "cluster", SCORES)


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    articles = _t(spark, d, "clustered_data")
    _, confirmed = repeated_lines(articles)
    lines = confirmed_set(confirmed)
    if lines is None:
        articles = remove_lines(articles, out_col="document")
    return occurrence_groups(articles, "row_idx", "document", "source_domain", lines)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return group_pairs(_occurrences(spark, d)).select(F.col("a").alias("row_a"), F.col("b").alias("row_b"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    strengths = _t(spark, d, "clustered_data").select(F.col("row_idx").alias("id"), F.col("cluster_membership_strength").alias("strength"))
    return group_report(_occurrences(spark, d), strengths)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_t(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans of words to take out of each document."""
    return leaked_spans(_t(spark, d, "documents"), _t(spark, d, "eval_items")).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_data(_t(spark, d, "documents")).withColumnsRenamed({"id": "doc_id", "kind": "pii_kind", "found": "pii_text"})


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "redacted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_nearest": p1_nearest,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_pc1_ranking": p5_pc1_ranking,
    "p5_weightings": p5_weightings,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}
_STANDING = ", ".join(f"(rank() OVER (ORDER BY CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END NULLS FIRST) - 1) / n AS s{k}" for k, c in enumerate(SCORES))
ORACLE: dict[str, str] = EXACT | {
    "p1_found": """
        WITH v AS (SELECT topic_group AS t, topic_row_idx AS i, vec FROM article_vectors
                   WHERE vec IS NOT NULL AND len(list_filter(vec, lambda x: x IS NULL)) = 0
                     AND list_sum(list_transform(vec, lambda x: abs(x))) > 0),
             s AS (SELECT a.t, a.i, b.i AS j, round(list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]), 7) AS c
                   FROM v a JOIN v b ON a.t = b.t AND a.i <> b.i),
             r AS (SELECT *, row_number() OVER (PARTITION BY t, i ORDER BY c DESC, j) AS place FROM s)
        SELECT DISTINCT t AS topic_group, least(i, j) AS idx_a, greatest(i, j) AS idx_b FROM r WHERE place <= 10 AND c >= 0.85""",
    "p5_found": f"""
        WITH s AS (SELECT cluster, n, {_STANDING} FROM (SELECT *, count(*) OVER () AS n FROM cluster_temporal_stats)),
             r AS (SELECT cluster, n, row_number() OVER (ORDER BY (0.0::DOUBLE + s0 + s1 + s2 + s3) / 4.0::DOUBLE DESC, cluster) AS place FROM s)
        SELECT cluster FROM r WHERE place <= (2 * n + 99) // 100""",
}

"""Queries: the remaining scans, predicates, joins, reports and figure inputs, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import ann, campaign, curation, density, encoder, evaluation, runtime, serving, temporal, text_model, vectors
from ..session import materialize, shared_dir
from ..sources import tables
from ..sources.tables import table
from .common import articles_table as cd
from .common import register, stats
from .queries_core import AS_OF, DUCK_HOST, REPAIRED_SQL, duck_url_date
from .queries_serving import _V, B8_SQL, INTRA_SQL, av, labelled, methods, nostop, topic_kmeans, topic_vectors

QUERIES, ORACLE, query = register()


@query("S7_neighbour_scan", "SELECT topic_group, topic_row_idx, title FROM clustered_data WHERE topic_group = 'sport' AND topic_row_idx = 3")
def _(spark, d):
    return cd(spark, d).where((F.col("topic_group") == "sport") & (F.col("topic_row_idx") == 3)).select("topic_group", "topic_row_idx", "title")


@query("S9_vector_rows", "SELECT topic_group, count(*) AS n_rows, count(vec) AS vectors FROM article_vectors GROUP BY 1")
def _(spark, d):
    return table(spark, d, "article_vectors").groupBy("topic_group").agg(F.count("*").alias("n_rows"), F.count("vec").alias("vectors"))


def _folder(spark, name):
    return f"{shared_dir(spark)}/newsgrain/{name}-{uuid.uuid4().hex}"


@query("S9_vectors_reused", "SELECT * FROM (VALUES ('first', false, (SELECT count(*) FROM article_vectors)), ('same rows', true, (SELECT count(*) FROM article_vectors)), ('other rows', false, (SELECT count(*) FROM article_vectors))) v(call, reused, n)")
def _(spark, d):
    """Stored vectors serve again only while their number of rows is the one expected."""
    v = table(spark, d, "article_vectors")
    n, path = v.count(), _folder(spark, "vectors")
    rows = []
    for call, expected in (("first", n), ("same rows", n), ("other rows", n + 1)):
        stored, again = tables.reused(spark, path, expected, lambda: v)
        rows.append((call, again, stored.count()))
    return spark.createDataFrame(rows, "call string, reused boolean, n long")


@query("S8_union_files", "SELECT topic_group, topic_size, silhouette, NULL::DOUBLE AS topic_total_seconds, 1 AS unreadable FROM sweep_results UNION ALL SELECT topic_group, topic_size, NULL, topic_total_seconds, 1 FROM topic_runtime")
def _(spark, d):
    """Two tables of different columns and a missing one, read as one; how many could not be read stands in every row."""
    root = _folder(spark, "union")
    tables.write(table(spark, d, "sweep_results").select("topic_group", "topic_size", "silhouette"), f"{root}/a")
    tables.write(table(spark, d, "topic_runtime").select("topic_group", "topic_size", "topic_total_seconds"), f"{root}/b")
    whole, unreadable = tables.union_files(spark, [f"{root}/a", f"{root}/b", f"{root}/absent"])
    return whole.select("topic_group", "topic_size", "silhouette", "topic_total_seconds", F.lit(len(unreadable)).alias("unreadable"))


@query("S13_S14_S16_round_trip", "SELECT topic_group, cluster, CAST(published_at AS DATE) AS day, count(*) AS articles FROM clustered_data WHERE cluster <> -1 AND published_at IS NOT NULL GROUP BY ALL")
def _(spark, d):
    """Daily counts written in one folder a topic, sorted within, and read back."""
    path = _folder(spark, "daily")
    tables.write(serving.daily_counts(cd(spark, d)), path, partition_by=["topic_group"], sort_by=["cluster", "day"])
    return spark.read.parquet(path).select("topic_group", "cluster", "day", "articles")


@query("S15_S19_catalogue", "SELECT * FROM (VALUES ('sweep_results', true, true, (SELECT count(*) FROM sweep_results)), ('topic_runtime', true, true, (SELECT count(*) FROM topic_runtime)), ('no_such_table', false, false, NULL)) v(name, present, copied, n)")
def _(spark, d):
    """Which tables are there, and their copies in the serving folder."""
    root = tables.layout(spark, _folder(spark, "catalogue"))["serving"]
    names = ["sweep_results", "topic_runtime", "no_such_table"]
    held, rows = tables.present(spark, d, names), []
    for n in names:
        copied = tables.passthrough(spark, f"{d}/{n}.parquet", f"{root}/{n}.parquet")
        rows.append((n, held[n], copied, table(spark, root, n).count() if copied else None))
    return spark.createDataFrame(rows, "name string, present boolean, copied boolean, n long")


@query("S18_layout", "SELECT unnest(['curated', 'vectors', 'clusters', 'temporal', 'serving', 'reports']) AS folder, true AS made")
def _(spark, d):
    """The folders of an output root."""
    made = tables.layout(spark, _folder(spark, "root"))
    fs = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return spark.createDataFrame([(n, fs(p).getFileSystem(conf).exists(fs(p))) for n, p in made.items()], "folder string, made boolean")


@query("S12_U6_dictionary", "WITH t AS (SELECT DISTINCT lower(trim(topics)) AS w FROM clustered_data WHERE trim(topics) <> '' AND NOT contains(topics, chr(10)) AND NOT contains(topics, chr(13))) SELECT DISTINCT w AS word FROM (SELECT w FROM t UNION ALL SELECT strip_accents(w) FROM t)")
def _(spark, d):
    """A word file, one entry a line, and its entries without marks, each once."""
    path = _folder(spark, "words")
    lines = cd(spark, d).where("trim(topics) <> '' and not contains(topics, char(10)) and not contains(topics, char(13))").select("topics").distinct()
    lines.write.text(path)
    return tables.stopword_table(spark, path)


@query("P6_canonical_columns", "SELECT coalesce(title, '') AS title, coalesce(text, '') AS text, coalesce(summary, '') AS summary, coalesce(keywords, '') AS keywords, coalesce(topics, '') AS topics, coalesce(dialect, '') AS dialect, coalesce(url, '') AS url, coalesce(author, '') AS author, '' AS document, '' AS short_document, '' AS document_nostop, '' AS \"timestamp\", '' AS timestamp_source, '' AS timestamp_quality FROM raw_articles".replace('\\"', '"'))
def _(spark, d):
    """The columns of the clean table in their order, absent ones as empty text."""
    return curation.canonical(table(spark, d, "raw_articles")).na.fill("")


@query("P4_non_blank", "SELECT row_idx FROM clustered_data WHERE trim(coalesce(title, '')) <> '' AND trim(coalesce(document, '')) <> ''")
def _(spark, d):
    return cd(spark, d).where("trim(coalesce(title, '')) <> '' and trim(coalesce(document, '')) <> ''").select("row_idx")


@query("P9_normalised", f"""
    SELECT row_idx, coalesce(nullif(trim(topic_group), ''), 'necunoscut') AS topic_group, coalesce(cluster, -1) AS cluster, published_at, CAST(published_at AS DATE) AS published_on,
        CASE WHEN trim(coalesce(url, '')) = '' THEN '' ELSE regexp_replace({DUCK_HOST.format("CASE WHEN contains(trim(url), '://') THEN trim(url) ELSE 'https://' || trim(url) END")}, '^www\\.', '') END AS source_domain,
        coalesce(title, '') AS title, '' AS summary, coalesce(topics, '') AS topics, coalesce(url, '') AS url, '' AS author, coalesce(timestamp_source, '') AS timestamp_source, coalesce(timestamp_quality, '') AS timestamp_quality,
        coalesce(topic_group_reason, '') AS topic_group_reason, coalesce(cluster_assignment_reason, '') AS cluster_assignment_reason, coalesce(topic_is_eligible, false) AS topic_is_eligible, CAST(cluster_membership_strength AS DOUBLE) AS cluster_membership_strength,
        CAST(cluster_outlier_score AS DOUBLE) AS cluster_outlier_score, cluster_size, topic_row_idx, try_cast(left(regexp_extract(coalesce(url, ''), '([0-9]+)[^0-9]*$', 1), 18) AS BIGINT) AS number_in_url FROM clustered_data""")
def _(spark, d):
    """The serving columns with nulls, blanks and numbers in one form; a number read from text that may hold none."""
    n = serving.normalised(cd(spark, d))
    number = F.expr("try_cast(left(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), 18) AS BIGINT)")
    return n.withColumn("number_in_url", number)


@query("P12_P13_filters", "SELECT row_idx FROM clustered_data WHERE topic_group IN ('social', 'sport') AND (published_at IS NULL OR CAST(published_at AS DATE) BETWEEN DATE '2021-01-01' AND DATE '2022-12-31')")
def _(spark, d):
    day = F.to_date("published_at")
    return cd(spark, d).where(F.col("topic_group").isin("social", "sport") & (day.isNull() | day.between(F.lit("2021-01-01").cast("date"), F.lit("2022-12-31").cast("date")))).select("row_idx")


@query("P13_range_filters", """
    SELECT cluster FROM cluster_temporal_stats WHERE article_count BETWEEN 5 AND 500 AND burst_score >= 1 AND suspicion_score >= 0.5 AND (first_seen IS NULL OR last_seen IS NULL OR (last_seen >= DATE '2019-01-01' AND first_seen <= DATE '2024-12-31'))""")
def _(spark, d):
    """Size, burst, score and dates in one predicate; undated clusters stay."""
    date = lambda x: F.lit(x).cast("date")
    dated = F.col("first_seen").isNull() | F.col("last_seen").isNull() | ((F.col("last_seen") >= date("2019-01-01")) & (F.col("first_seen") <= date("2024-12-31")))
    return stats(spark, d).where(F.col("article_count").between(5, 500) & (F.col("burst_score") >= 1) & (F.col("suspicion_score") >= 0.5) & dated).select("cluster")


@query("P14_temporal_defaults", "SELECT row_idx, lower(coalesce(timestamp_source, 'missing')) AS source, published_at IS NOT NULL AS dated FROM clustered_data")
def _(spark, d):
    return cd(spark, d).select("row_idx", F.lower(F.coalesce("timestamp_source", F.lit("missing"))).alias("source"), F.col("published_at").isNotNull().alias("dated"))


@query("P15_robust_recurring", "SELECT cluster FROM cluster_temporal_stats WHERE burst_periods_daily >= 5 AND total_articles >= 50 AND active_days >= 20 AND domain_count >= 3")
def _(spark, d):
    return temporal.multiyear_repair(stats(spark, d)).where("robust_recurring").select("cluster")


@query("P16_finite", "SELECT cluster, suspicion_score, domain_entropy FROM cluster_temporal_stats WHERE isfinite(suspicion_score) AND isfinite(domain_entropy)")
def _(spark, d):
    return stats(spark, d).select("cluster", "suspicion_score", "domain_entropy").replace(float("nan"), None).replace(float("inf"), None).dropna()


@query("A22_R11_topic_totals", "SELECT topic_group, count(DISTINCT cluster) AS clusters, CAST(sum(article_count) AS BIGINT) AS articles FROM cluster_temporal_stats GROUP BY 1")
def _(spark, d):
    return stats(spark, d).groupBy("topic_group").agg(F.count_distinct("cluster").alias("clusters"), F.sum("article_count").alias("articles"))


@query("R11_explorer", """
    SELECT count(*) AS clusters, CAST(sum(article_count) AS BIGINT) AS articles, round(median(article_count), 6) AS median_size, count(*) FILTER (burst_score > 0) AS bursting, count(*) FILTER (domain_count > 1) AS multi_source, round(max(suspicion_score), 6) AS highest,
        min(first_seen) AS first_day, max(last_seen) AS last_day, count(DISTINCT topic_group) AS topics FROM cluster_temporal_stats""")
def _(spark, d):
    """The figures above the explorer."""
    return stats(spark, d).agg(
        F.count("*").alias("clusters"), F.sum("article_count").alias("articles"), F.round(F.median("article_count"), 6).alias("median_size"), F.count_if(F.col("burst_score") > 0).alias("bursting"), F.count_if(F.col("domain_count") > 1).alias("multi_source"),
        F.round(F.max("suspicion_score"), 6).alias("highest"), F.min("first_seen").alias("first_day"), F.max("last_seen").alias("last_day"), F.count_distinct("topic_group").alias("topics"),
    )


_REPS = """reps AS (SELECT topic_group, cluster, CAST(umap_x AS DOUBLE) AS x, CAST(umap_y AS DOUBLE) AS y FROM (SELECT *, row_number() OVER (PARTITION BY topic_group, cluster ORDER BY cluster_membership_strength DESC NULLS LAST, cluster_outlier_score ASC NULLS LAST, row_idx) AS r
    FROM clustered_data WHERE cluster <> -1) WHERE r = 1 AND umap_x IS NOT NULL AND umap_y IS NOT NULL),
    p AS (SELECT a.topic_group, a.cluster, b.cluster AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM reps a JOIN reps b ON a.topic_group = b.topic_group AND a.cluster <> b.cluster),
    e AS (SELECT topic_group, cluster, other, round(1 / (1 + dist), 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY topic_group, cluster ORDER BY dist, other) AS rank FROM p) WHERE rank <= 6)"""


def _edges(spark, d):
    reps = serving.representative(cd(spark, d)).where("umap_x is not null and umap_y is not null").select("topic_group", "cluster", F.col("umap_x").alias("x"), F.col("umap_y").alias("y"))
    return vectors.nearest_representatives(reps)


@query("A33_edges_per_topic", f"WITH {_REPS} SELECT topic_group, count(*) AS edges, median(similarity) AS median_similarity FROM e GROUP BY 1")
def _(spark, d):
    return _edges(spark, d).groupBy("topic_group").agg(F.count("*").alias("edges"), F.median("similarity").alias("median_similarity"))


_ANCHORS = "n AS (SELECT topic_group, cluster, round(avg(CAST(umap_x AS DOUBLE)), 6) AS x, round(avg(CAST(umap_y AS DOUBLE)), 6) AS y FROM clustered_data WHERE cluster <> -1 AND umap_x IS NOT NULL AND umap_y IS NOT NULL GROUP BY 1, 2)"


@query("T3_J16_R16_top_edges", f"""
    WITH {_REPS}, {_ANCHORS}, t AS (SELECT topic_group, cluster, other, similarity FROM e ORDER BY similarity DESC, cluster, other LIMIT 2000)
    SELECT t.topic_group, t.cluster, t.other, similarity, a.x AS x, a.y AS y, b.x AS other_x, b.y AS other_y FROM t JOIN n a ON a.topic_group = t.topic_group AND a.cluster = t.cluster JOIN n b ON b.topic_group = t.topic_group AND b.cluster = t.other""")
def _(spark, d):
    """The edges of greatest similarity with the positions of both ends; an edge without one is left out."""
    top = _edges(spark, d).select("topic_group", "cluster", "other", "similarity").orderBy(F.desc("similarity"), "cluster", "other").limit(2000)
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    at = cd(spark, d).where("cluster <> -1 and umap_x is not null and umap_y is not null").groupBy("topic_group", "cluster").agg(mean("umap_x").alias("x"), mean("umap_y").alias("y"))
    return top.join(at, ["topic_group", "cluster"]).join(at.withColumnsRenamed({"cluster": "other", "x": "other_x", "y": "other_y"}), ["topic_group", "other"])


@query("A34_anchor_position", "SELECT cluster, round(avg(CAST(umap_x AS DOUBLE)), 6) AS x, round(avg(CAST(umap_y AS DOUBLE)), 6) AS y FROM clustered_data WHERE cluster <> -1 GROUP BY 1")
def _(spark, d):
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return cd(spark, d).where("cluster <> -1").groupBy("cluster").agg(mean("umap_x").alias("x"), mean("umap_y").alias("y"))


@query("A37_R13_cluster_days", """
    WITH n AS (SELECT cluster, CAST(published_at AS DATE) AS day, count(*) AS n FROM clustered_data WHERE cluster <> -1 AND published_at IS NOT NULL GROUP BY 1, 2),
        g AS (SELECT *, datediff('day', lag(day) OVER (PARTITION BY cluster ORDER BY day), day) AS gap FROM n)
    SELECT cluster, count(*) AS days, max(n) AS peak, arg_max(day, (n, -epoch(day))) AS peak_day, median(gap) AS median_gap FROM g GROUP BY 1""")
def _(spark, d):
    n = serving.daily_counts(cd(spark, d)).groupBy("cluster", "day").agg(F.sum("articles").alias("n"))
    n = n.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("cluster").orderBy("day"))))
    return n.groupBy("cluster").agg(F.count("*").alias("days"), F.max("n").alias("peak"), F.max_by("day", F.struct("n", (-F.unix_date("day")).alias("d"))).alias("peak_day"), F.median("gap").alias("median_gap"))


_KNN = f"""{_V}, p AS (SELECT a.g AS grp, a.i AS id, b.i AS neighbour, round(list_inner_product(a.x, b.x), 6) AS score FROM v a JOIN v b ON a.g = b.g AND a.i <> b.i WHERE a.i % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY grp, id ORDER BY score DESC, neighbour) AS rank FROM p)"""


@query("J8_R6_neighbour_titles", f"""
    WITH {_KNN} SELECT grp, id, neighbour, rank, score, a.title AS source_title, b.title AS neighbour_title FROM r LEFT JOIN clustered_data a ON a.topic_group = grp AND a.topic_row_idx = id LEFT JOIN clustered_data b ON b.topic_group = grp AND b.topic_row_idx = neighbour WHERE rank <= 10""")
def _(spark, d):
    """Neighbours of a stated query set with the titles of both sides."""
    v = av(spark, d)
    edges = vectors.exact_knn(v, v.where("topic_row_idx % 20 = 0"), "topic_row_idx", "vec", "topic_group")
    look = cd(spark, d).select(F.col("topic_group").alias("grp"), F.col("topic_row_idx").alias("i"), "title")
    a, b = look.select("grp", F.col("i").alias("id"), F.col("title").alias("source_title")), look.select("grp", F.col("i").alias("neighbour"), F.col("title").alias("neighbour_title"))
    return edges.join(a, ["grp", "id"], "left").join(b, ["grp", "neighbour"], "left")


@query("V21_neighbour_preview", f"""
    WITH {_V}, p AS (SELECT a.g AS grp, a.i AS id, b.i AS neighbour, round(list_inner_product(a.x, b.x), 6) AS score FROM v a JOIN v b ON a.g = b.g AND a.i <> b.i WHERE a.i < 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY grp, id ORDER BY score DESC, neighbour) AS rank FROM p)
    SELECT grp, id, rank, score, left(coalesce(c.title, ''), 100) AS neighbour_title FROM r LEFT JOIN clustered_data c ON c.topic_group = grp AND c.topic_row_idx = neighbour WHERE rank <= 5""")
def _(spark, d):
    """The five nearest of the first three articles of every topic, with their titles (a preview)."""
    v = av(spark, d)
    edges = vectors.exact_knn(v, v.where("topic_row_idx < 3"), "topic_row_idx", "vec", "topic_group", 5)
    look = cd(spark, d).select(F.col("topic_group").alias("grp"), F.col("topic_row_idx").alias("neighbour"), F.substring(F.coalesce("title", F.lit("")), 1, 100).alias("neighbour_title"))
    return edges.join(look, ["grp", "neighbour"], "left").select("grp", "id", "rank", "score", F.coalesce("neighbour_title", F.lit("")).alias("neighbour_title"))


@query("V3_approximate_knn")
def _(spark, d):
    """About the ten nearest of a stated query set (ids divisible by 20) among all rows of their topic, by coarse lists."""
    v = av(spark, d).withColumn("vec", vectors.unit(F.col("vec")))
    return ann.ivf_knn(v, v.where("topic_row_idx % 20 = 0"), "topic_row_idx", "vec", "topic_group")


@query("V3_recall", f"SELECT count(DISTINCT v.g || ' ' || v.i) AS queries, true AS recall_at_least_90 FROM (SELECT topic_group AS g, topic_row_idx AS i FROM article_vectors WHERE vec IS NOT NULL AND len(list_filter(vec, lambda z: z IS NULL)) = 0 AND list_sum(list_transform(vec, lambda z: abs(z))) > 0 AND topic_row_idx % 20 = 0) v")
def _(spark, d):
    """The share of the exact neighbours of those queries that the coarse lists find."""
    v = av(spark, d).withColumn("vec", vectors.unit(F.col("vec")))
    asked = v.where("topic_row_idx % 20 = 0")
    exact = vectors.exact_knn(v, asked, "topic_row_idx", "vec", "topic_group").select("grp", "id", "neighbour")
    found = ann.ivf_knn(v, asked, "topic_row_idx", "vec", "topic_group").select("grp", "id", "neighbour", F.lit(1).alias("hit"))
    hits = exact.join(found, ["grp", "id", "neighbour"], "left").agg(F.count("hit").alias("h"), F.count("*").alias("n"))
    return asked.agg(F.count("*").alias("queries")).crossJoin(hits).select("queries", (F.col("h") >= 0.9 * F.col("n")).alias("recall_at_least_90"))  # one row each


@query("V1_encoded_texts")
def _(spark, d):
    """Unit vectors of short documents by the provider that needs no model; blank texts have none."""
    return encoder.encode_texts(cd(spark, d), "row_idx", "short_document").withColumnRenamed("id", "row_idx")


@query("V15_reduced_terms")
def _(spark, d):
    """Documents of every topic in the space of its first hundred singular directions of TF-IDF."""
    return text_model.truncated_svd(text_model.tfidf(nostop(spark, d), "row_idx", "document_nostop", ["topic_group"]), "topic_group")


def _best_k(spark, d):
    return serving.best_config(table(spark, d, "sweep_results")).select(F.col("topic_group").alias("grp"), F.greatest("num_clusters", F.lit(3)).alias("k"))


def term_kmeans(spark, d):
    """(topic_group, id, label, vec): mini-batch k-means of every topic over its reduced term space."""
    reduced = text_model.truncated_svd(text_model.tfidf(nostop(spark, d), "row_idx", "document_nostop", ["topic_group"]), "topic_group")
    reduced = materialize(reduced, "reduced-terms")
    labels = text_model.kmeans_by_topic(reduced, "topic_group", "id", "reduced", _best_k(spark, d), batches=True)
    return reduced.join(labels.withColumnRenamed("grp", "topic_group"), ["topic_group", "id"]).select("topic_group", "id", "label", F.col("reduced").alias("vec"))


@query("V16_term_kmeans")
def _(spark, d):
    """Mini-batch k-means of every topic over whole documents without stopwords."""
    return term_kmeans(spark, d).select("topic_group", F.col("id").alias("row_idx"), "label")


@query("V23_stage_seconds")
def _(spark, d):
    """Seconds of two stages of every topic, measured, with rows a second."""
    watch, df = runtime.Stopwatch(), cd(spark, d).select("topic_group", "topic_row_idx", "document")
    sizes = {r["topic_group"]: r["count"] for r in df.groupBy("topic_group").count().collect()}
    for topic in sorted(sizes):
        own = df.where(F.col("topic_group") == topic)
        with watch.stage(topic, "scan"):
            own.agg(F.max("topic_row_idx")).collect()
        with watch.stage(topic, "words"):
            own.agg(F.sum(F.size(F.split("document", " ")))).collect()
    return watch.table(spark, sizes, ["scan", "words"])


@query("J2_serving_repair", """
    WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY crawled_at) AS n FROM raw_articles) WHERE n = 1)
    SELECT c.row_idx, coalesce(c.title, r.title) AS title, coalesce(c.url, r.url) AS url, r.summary, r.keywords, NULL::VARCHAR AS editor FROM clustered_data c LEFT JOIN r USING (row_idx)""")
def _(spark, d):
    """Serving columns completed from the raw table by id; columns no table has are null."""
    clean = table(spark, d, "raw_articles")
    return serving.repair(cd(spark, d).select("row_idx", "title", "url"), clean, ["row_idx"], ["title", "url", "summary", "keywords", "editor"], [F.col("crawled_at")])


@query("J11_in_range", "SELECT s.cluster, coalesce(n, 0) AS in_range FROM cluster_temporal_stats s LEFT JOIN (SELECT cluster, count(*) AS n FROM clustered_data WHERE published_at >= TIMESTAMP '2022-01-01' GROUP BY 1) c ON s.cluster = c.cluster")
def _(spark, d):
    n = cd(spark, d).where(F.to_date("published_at") >= F.lit("2022-01-01").cast("date")).groupBy("cluster").agg(F.count("*").alias("n"))
    return stats(spark, d).join(n, "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("in_range"))


@query("J19_topic_lookup", "SELECT c.row_idx, r.rows_per_second FROM clustered_data c LEFT JOIN topic_runtime r USING (topic_group)")
def _(spark, d):
    """A lookup of a few dozen rows, broadcast by AQE from its size."""
    return cd(spark, d).join(table(spark, d, "topic_runtime").select("topic_group", "rows_per_second"), "topic_group", "left").select("row_idx", "rows_per_second")


@query("B14_columns_present", "SELECT cluster, score AS campaign_candidate_score, score > 0 AS campaign_candidate FROM (" + B8_SQL + ")")
def _(spark, d):
    """The campaign columns of a table that lacks them, and those of one that has them left as they are."""
    bare = stats(spark, d).drop("organic_event_title", "public_affairs_title", "public_affairs_signal", "campaign_candidate_score", "campaign_candidate", *[c for c in stats(spark, d).columns if c.startswith("campaign_") and c.endswith("_weight")])
    return campaign.ensure_campaign_columns(campaign.ensure_campaign_columns(bare)).select("cluster", "campaign_candidate_score", "campaign_candidate")


@query("B9_repair_rescored", "WITH r AS (SELECT * FROM (" + REPAIRED_SQL + ")) SELECT s.cluster, s.repaired_score, c.score FROM r s JOIN (" + B8_SQL.replace("cluster_temporal_stats", "(SELECT t.* REPLACE (r.repaired_score AS suspicion_score) FROM cluster_temporal_stats t JOIN r ON r.cluster = t.cluster)") + ") c USING (cluster)")
def _(spark, d):
    """Scores after the repair of recurring clusters, the campaign score worked out from them, in the order of both."""
    r = temporal.multiyear_repair(stats(spark, d)).withColumn("suspicion_score", F.col("repaired_score"))
    return campaign.campaign_columns(r).select("cluster", "repaired_score", F.col("campaign_candidate_score").alias("score")).orderBy(F.desc("score"), F.desc("repaired_score"), "cluster")


@query("D14_tolerant_parse", """
    SELECT row_idx, try_cast(substr(CASE WHEN row_idx % 3 = 0 THEN coalesce(title, '') WHEN row_idx % 3 = 1 THEN strftime(published_at, '%Y-%m-%d %H:%M:%S') ELSE '2021-02-' || (25 + row_idx % 10) END, 1, 10) AS DATE) AS day FROM clustered_data""")
def _(spark, d):
    """Dates read from texts of which some are dates, some days that do not exist and some no dates at all."""
    stamp, k = F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.col("row_idx") % 3
    mixed = F.when(k == 0, F.coalesce("title", F.lit(""))).when(k == 1, stamp).otherwise(F.concat(F.lit("2021-02-"), (25 + F.col("row_idx") % 10).cast("string")))
    return cd(spark, d).select("row_idx", F.try_to_date(F.substring(mixed, 1, 10), "yyyy-MM-dd").alias("day"))


@query("D4_url_dates", f"SELECT row_idx, {duck_url_date('url')} AS day FROM clustered_data")
def _(spark, d):
    return cd(spark, d).select("row_idx", dates.url_date(F.col("url"), AS_OF).alias("day"))


def sweep(spark, d):
    """The measures of every density configuration of every eligible topic."""
    v = materialize(topic_vectors(spark, d).where("eligible").select("topic_group", "topic_row_idx", "vec"), "sweep-vectors")
    return density.sweep(v, "topic_group", "topic_row_idx", "vec")


@query("V6_density_sweep")
def _(spark, d):
    """Every configuration of every eligible topic, measured, scored, and the best marked."""
    return sweep(spark, d)


@query("V24_sweep_defaults", "SELECT topic_group, min_cluster_size, coalesce(cluster_selection_method, 'eom') AS method, coalesce(cluster_selection_epsilon, 0.0) AS epsilon FROM sweep_results")
def _(spark, d):
    return table(spark, d, "sweep_results").select("topic_group", "min_cluster_size", F.coalesce("cluster_selection_method", F.lit("eom")).alias("method"), F.coalesce("cluster_selection_epsilon", F.lit(0.0)).alias("epsilon"))


@query("R12_article_viewer", f"""
    WITH {_KNN}, m AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY cluster_membership_strength DESC NULLS LAST, row_idx) AS place FROM clustered_data WHERE cluster <> -1)
    SELECT cluster, row_idx, title, place, NULL::BIGINT AS rank, NULL::VARCHAR AS neighbour_title FROM m WHERE place <= 20
    UNION ALL SELECT m.cluster, m.row_idx, m.title, place, rank, b.title FROM m JOIN r ON r.grp = m.topic_group AND r.id = m.topic_row_idx AND rank <= 20 LEFT JOIN clustered_data b ON b.topic_group = r.grp AND b.topic_row_idx = r.neighbour WHERE place <= 20""")
def _(spark, d):
    """The twenty strongest articles of every cluster, and the twenty nearest articles of those in the stated query set (ids divisible by 20)."""
    w = Window.partitionBy("cluster").orderBy(F.desc_nulls_last("cluster_membership_strength"), "row_idx")
    m = cd(spark, d).where("cluster <> -1").select("cluster", "topic_group", "topic_row_idx", "row_idx", "title", F.row_number().over(w).cast("long").alias("place")).where("place <= 20")
    v = av(spark, d)
    asked = v.where("topic_row_idx % 20 = 0").join(m.select("topic_group", "topic_row_idx"), ["topic_group", "topic_row_idx"], "left_semi")
    edges = vectors.exact_knn(v, asked, "topic_row_idx", "vec", "topic_group", 20).select(F.col("grp").alias("topic_group"), F.col("id").alias("topic_row_idx"), "neighbour", "rank")
    titles = cd(spark, d).select("topic_group", F.col("topic_row_idx").alias("neighbour"), F.col("title").alias("neighbour_title"))
    near = m.join(edges, ["topic_group", "topic_row_idx"]).join(titles, ["topic_group", "neighbour"], "left").select("cluster", "row_idx", "title", "place", "rank", "neighbour_title")
    return m.select("cluster", "row_idx", "title", "place").unionByName(near, allowMissingColumns=True)


@query("R14_burst_landscape", "SELECT cluster, num_burst_periods, burst_duration_days, suspicion_score FROM cluster_temporal_stats WHERE isfinite(suspicion_score) ORDER BY num_burst_periods DESC NULLS LAST, cluster LIMIT 50")
def _(spark, d):
    s = stats(spark, d).where(F.col("suspicion_score").isNotNull() & ~F.isnan("suspicion_score"))
    return s.select("cluster", "num_burst_periods", "burst_duration_days", "suspicion_score").orderBy(F.desc_nulls_last("num_burst_periods"), "cluster").limit(50)


@query("R19_evaluation_report", f"""
    WITH b AS (SELECT topic_group, first(silhouette ORDER BY r) FILTER (silhouette IS NOT NULL) AS silhouette, first(noise_percent ORDER BY r) FILTER (noise_percent IS NOT NULL) AS noise_percent, first(num_clusters ORDER BY r) FILTER (num_clusters IS NOT NULL) AS num_clusters
            FROM (SELECT *, row_number() OVER (PARTITION BY topic_group ORDER BY selection_score DESC NULLS LAST, min_cluster_size, min_samples) AS r FROM sweep_results) GROUP BY 1), c AS (SELECT * FROM {INTRA_SQL})
    SELECT 'silhouette' AS section, topic_group, NULL::BIGINT AS cluster, 'sbert_hdbscan' AS method, silhouette, noise_percent, num_clusters, NULL::DOUBLE AS mean_intra_cosine, NULL::BIGINT AS burst_score, NULL::DOUBLE AS suspicion_score FROM b
    UNION ALL SELECT 'intra_cosine', topic_group, cluster, 'sbert_hdbscan', NULL, NULL, NULL, mean_intra_cosine, NULL, NULL FROM c
    UNION ALL SELECT 'burst', s.topic_group, s.cluster, 'sbert_hdbscan', NULL, NULL, NULL, mean_intra_cosine, burst_score, suspicion_score FROM cluster_temporal_stats s LEFT JOIN c ON c.topic_group = s.topic_group AND c.cluster = s.cluster""")
def _(spark, d):
    """The evaluation report, with its three sections."""
    return evaluation.evaluation_report(table(spark, d, "sweep_results"), evaluation.intra_cosine(labelled(spark, d)), stats(spark, d))


@query("R20_ablation")
def _(spark, d):
    """The ablation report: k-means over terms and over vectors, the density clusters of the sweep, and bursts on and off."""
    k = serving.best_config(table(spark, d, "sweep_results")).select("topic_group", F.greatest("num_clusters", F.lit(3)).alias("requested_k"))

    def measured(points, method):
        quality = vectors.silhouette_cosine(points, "topic_group", "id", "label", "vec").groupBy(F.col("grp").alias("topic_group")).agg(F.avg("silhouette").alias("silhouette"))
        db = vectors.davies_bouldin(points, "topic_group", "label", "vec").withColumnRenamed("grp", "topic_group")
        n = points.groupBy("topic_group").agg(F.count("*").alias("n_articles"), F.count_distinct("label").alias("num_clusters"))
        out = n.join(quality, "topic_group", "left").join(db, "topic_group", "left").join(F.broadcast(k), "topic_group", "left").withColumn("requested_k", F.coalesce("requested_k", F.lit(10)))  # one row a topic
        return out.withColumns({"method": F.lit(method), "k": text_model.bounded_k(F.col("requested_k"), F.col("n_articles")), "runtime_seconds": F.lit(None).cast("double")})

    words = materialize(term_kmeans(spark, d), "term-clusters")
    own = topic_kmeans(spark, d).select(F.col("grp").alias("topic_group"), F.col("id").alias("topic_row_idx"), "label")
    vecs = materialize(topic_vectors(spark, d).join(own, ["topic_group", "topic_row_idx"]).select("topic_group", F.col("topic_row_idx").alias("id"), "label", "vec"), "vector-clusters")
    best = serving.best_config(table(spark, d, "sweep_results"), parity=True)
    best = best.select("topic_group", F.col("topic_size").alias("n_articles"), F.col("num_clusters").alias("requested_k"), "num_clusters", "silhouette", "davies_bouldin", F.lit("sbert_hdbscan").alias("method"))
    rows = measured(words, "tfidf_kmeans").unionByName(measured(vecs, "sbert_kmeans")).unionByName(best, allowMissingColumns=True)
    return evaluation.ablation_report(rows, evaluation.burst_ablation(stats(spark, d)))


@query("R18_evaluation_view", """
    WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_group ORDER BY selection_score DESC NULLS LAST, min_cluster_size, min_samples) AS r FROM sweep_results) WHERE r = 1)
    SELECT topic_group, selection_score, silhouette, noise_percent, davies_bouldin, num_clusters, row_number() OVER (ORDER BY selection_score DESC NULLS LAST, topic_group) AS place FROM b WHERE topic_group IN ('social', 'politica', 'economie', 'sport')""")
def _(spark, d):
    """The best configurations of the selected topics, ordered by their score."""
    best = serving.best_config(table(spark, d, "sweep_results").where(F.col("topic_group").isin("social", "politica", "economie", "sport")))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("selection_score"), "topic_group"))  # one row a topic
    return best.select("topic_group", "selection_score", "silhouette", "noise_percent", "davies_bouldin", "num_clusters", place.cast("long").alias("place"))


@query("R18_sweep_points", "SELECT topic_group, min_cluster_size, min_samples, noise_percent, silhouette, selection_score, num_clusters FROM sweep_results WHERE topic_group IN ('social', 'politica', 'economie', 'sport')")
def _(spark, d):
    """All configurations of the selected topics: noise against silhouette."""
    return table(spark, d, "sweep_results").where(F.col("topic_group").isin("social", "politica", "economie", "sport")).select("topic_group", "min_cluster_size", "min_samples", "noise_percent", "silhouette", "selection_score", "num_clusters")


@query("R22_global_summary", """
    WITH c AS (SELECT cluster, count(*) AS n FROM clustered_data GROUP BY 1), f AS (SELECT cluster FROM c WHERE cluster <> -1 ORDER BY cluster LIMIT 5), g AS (SELECT cluster FROM c WHERE cluster <> -1 ORDER BY n DESC, cluster LIMIT 1),
        t AS (SELECT cluster, left(coalesce(title, ''), 100) AS title, row_number() OVER (PARTITION BY cluster ORDER BY row_idx) AS r FROM clustered_data)
    SELECT 'clusters' AS part, NULL::BIGINT AS cluster, count(*) FILTER (cluster <> -1) AS n, NULL::DOUBLE AS pct, NULL::VARCHAR AS title FROM c
    UNION ALL SELECT 'noise', -1, coalesce(sum(n) FILTER (cluster = -1), 0), round(100.0::DOUBLE * coalesce(sum(n) FILTER (cluster = -1), 0) / sum(n), 6), NULL FROM c
    UNION ALL SELECT * FROM (SELECT 'largest', cluster, n, NULL, NULL FROM c ORDER BY n DESC, cluster LIMIT 20)
    UNION ALL SELECT 'title of the largest', t.cluster, r, NULL, title FROM t JOIN g ON g.cluster = t.cluster WHERE r <= 10
    UNION ALL SELECT 'sample', t.cluster, r, NULL, title FROM t JOIN f ON f.cluster = t.cluster WHERE r <= 5""")
def _(spark, d):
    """Numbers of clusters and noise, the twenty largest, titles of the largest and of the first five clusters (a report)."""
    df = cd(spark, d)
    c = materialize(df.groupBy("cluster").agg(F.count("*").alias("n")), "cluster-sizes")
    real = c.where("cluster <> -1")
    noise = F.coalesce(F.sum(F.when(F.col("cluster") == -1, F.col("n"))), F.lit(0))
    shape = lambda x, part, *cols: x.select(F.lit(part).alias("part"), *cols)
    none, text = F.lit(None).cast("double").alias("pct"), F.lit(None).cast("string").alias("title")
    first = real.orderBy("cluster").limit(5).select("cluster", F.lit("sample").alias("part"), F.lit(5).alias("most"))
    top = real.orderBy(F.desc("n"), "cluster").limit(1).select("cluster", F.lit("title of the largest").alias("part"), F.lit(10).alias("most"))
    titles = df.join(F.broadcast(first.unionByName(top)), "cluster")  # six rows
    titles = titles.withColumn("n", F.row_number().over(Window.partitionBy("part", "cluster").orderBy("row_idx")).cast("long")).where("n <= most")
    return (
        shape(c.agg(F.count_if(F.col("cluster") != -1).alias("n")), "clusters", F.lit(None).cast("long").alias("cluster"), "n", none, text)
        .unionByName(shape(c.agg(noise.alias("n"), F.round(100 * noise / F.sum("n"), 6).alias("pct")), "noise", F.lit(-1).cast("long").alias("cluster"), "n", "pct", text))
        .unionByName(shape(c.orderBy(F.desc("n"), "cluster").limit(20), "largest", "cluster", "n", none, text))
        .unionByName(titles.select("part", "cluster", "n", none, F.substring(F.coalesce("title", F.lit("")), 1, 100).alias("title")))
    )


@query("F1_topic_rows", "SELECT topic_group, count(*) AS total_rows FROM clustered_data GROUP BY 1 ORDER BY 2, 1")
def _(spark, d):
    return cd(spark, d).groupBy("topic_group").agg(F.count("*").alias("total_rows")).orderBy("total_rows", "topic_group")


@query("F7_scatter_kinds", """
    WITH s AS (SELECT * FROM clustered_data WHERE topic_group IN ('politica', 'sport')), n AS (SELECT topic_group, cluster, row_number() OVER (PARTITION BY topic_group ORDER BY count(*) DESC, cluster) AS r FROM s WHERE cluster <> -1 GROUP BY 1, 2)
    SELECT row_idx, s.topic_group, CASE WHEN s.cluster = -1 THEN 'noise' WHEN r <= 10 THEN 'cluster ' || s.cluster ELSE 'other' END AS kind FROM s LEFT JOIN n ON n.topic_group = s.topic_group AND n.cluster = s.cluster""")
def _(spark, d):
    """Points of two topics as noise, member of one of the ten largest clusters, or other."""
    df = cd(spark, d).where(F.col("topic_group").isin("politica", "sport"))
    n = df.where("cluster <> -1").groupBy("topic_group", "cluster").agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("topic_group").orderBy(F.desc("n"), "cluster"))).where("r <= 10").select("topic_group", "cluster", F.lit(True).alias("top"))
    return df.join(top, ["topic_group", "cluster"], "left").select("row_idx", "topic_group", F.when(F.col("cluster") == -1, "noise").when(F.col("top"), F.concat(F.lit("cluster "), F.col("cluster").cast("string"))).otherwise("other").alias("kind"))


_GATES = ("support_weight", "coverage_weight", "source_weight", "domain_weight", "campaign_support_weight", "campaign_recurrence_weight", "campaign_active_days_weight", "campaign_source_diversity_weight", "campaign_span_weight", "campaign_narrative_weight")


@query("F14_components", "WITH t AS (SELECT *, coalesce(suspicion_score_raw, 0) * coalesce(support_weight, 1) * coalesce(coverage_weight, 1) * coalesce(source_weight, 1) * coalesce(domain_weight, 1) AS gated FROM cluster_temporal_stats ORDER BY campaign_candidate_score DESC NULLS LAST, cluster LIMIT 12) " + " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS component, round(coalesce({c}, 0), 6) AS value FROM t" for c in ("suspicion_score_raw", "gated", "suspicion_score", "campaign_candidate_score", *_GATES)))
def _(spark, d):
    """The twelve first candidates: raw score, what the gates leave, both scores, and all ten weights, a row each."""
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    gated = F.coalesce("suspicion_score_raw", F.lit(0.0)) * one("support_weight") * one("coverage_weight") * one("source_weight") * one("domain_weight")
    top = stats(spark, d).orderBy(F.desc_nulls_last("campaign_candidate_score"), "cluster").limit(12).withColumn("gated", gated)
    cols = ["suspicion_score_raw", "gated", "suspicion_score", "campaign_candidate_score", *_GATES]
    return top.select("cluster", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in cols]).unpivot("cluster", cols, "component", "value")


@query("F19_method_points", "SELECT topic_group, cluster_selection_method AS method, silhouette, davies_bouldin FROM (SELECT *, row_number() OVER (PARTITION BY topic_group, cluster_selection_method ORDER BY selection_score DESC NULLS LAST, min_cluster_size, min_samples) AS r FROM sweep_results) WHERE r = 1 AND silhouette IS NOT NULL AND davies_bouldin IS NOT NULL")
def _(spark, d):
    """The best configuration of every topic and method that has both measures."""
    return methods(spark, d).dropna(subset=["silhouette", "davies_bouldin"]).select("topic_group", "method", "silhouette", "davies_bouldin")


@query("F12_top_titles", "SELECT cluster, CASE WHEN length(representative_title) > 60 THEN rtrim(substr(representative_title, 1, 59)) || '…' ELSE representative_title END AS title, campaign_candidate_score FROM cluster_temporal_stats WHERE isfinite(campaign_candidate_score) ORDER BY campaign_candidate_score DESC, cluster LIMIT 15")
def _(spark, d):
    from ..functions.text import shorten

    s = F.col("campaign_candidate_score")
    return stats(spark, d).where(s.isNotNull() & ~F.isnan(s)).select("cluster", shorten(F.col("representative_title")).alias("title"), "campaign_candidate_score").orderBy(F.desc("campaign_candidate_score"), "cluster").limit(15)

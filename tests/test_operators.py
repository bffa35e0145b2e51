import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgrain.operators import campaign, curation, density, serving, temporal, text_model, vectors
from newsgrain.sources import pages, tables

DAY = dt.datetime(2023, 1, 2)


def rows(spark, seed=1, clusters=12):
    rng = random.Random(seed)
    out, i = [], 0
    for c in range(-1, clusters):
        for _ in range(rng.choice([1, 2, 3, 8, 40])):
            ts = None if rng.random() < 0.1 else DAY + dt.timedelta(days=rng.choice([0, 1, 2, 3, 30, 31, 60]), hours=rng.randrange(24))
            out.append((i, c, ts, rng.choice(["a.md", "b.md", "c.md"]), rng.choice(["url", "text", "missing"]), rng.choice(["x", "y"]), f"t{i}"))
            i += 1
    return out


SCHEMA = "row_idx long, cluster long, ts timestamp, domain string, timestamp_source string, topic_group string, title string"


def brute_bursts(data, step):
    """Bursting buckets on an explicit calendar."""
    out = set()
    by = {}
    for _, c, ts, *_ in data:
        if ts is not None:
            d = ts.date()
            b = d if step == 1 else d - dt.timedelta(days=(d.weekday() - 1) % 7)
            by.setdefault(c, []).append(b)
    for c, days in by.items():
        n, t = len(days), (max(days) - min(days)).days // step + 1
        if n < 3 or t < 2:
            continue
        for k in range(t):
            b = min(days) + dt.timedelta(days=k * step)
            x = days.count(b)
            if x * (math.log(2 * n / t + 1e-10) - math.log(n / t + 1e-10)) - n / t - 1 > 0:
                out.add((c, b))
    return out


@pytest.mark.parametrize("step", [1, 7])
def test_bursts_equal_brute_force(spark, step):
    data = rows(spark)
    df = spark.createDataFrame(data, SCHEMA)
    for levels in (temporal.burst_levels(temporal.bucket_counts(df, step), step), temporal.dense_levels(df, step)):
        assert {(r["cluster"], r["bucket"]) for r in levels.where("level = 1").collect()} == brute_bursts(data, step)


def test_profile_ignores_partitioning_and_order(spark):
    data = rows(spark, 3)
    a = sorted(map(repr, temporal.suspicion(temporal.profile(spark.createDataFrame(data, SCHEMA).coalesce(1))).collect()))
    random.Random(0).shuffle(data)
    b = sorted(map(repr, temporal.suspicion(temporal.profile(spark.createDataFrame(data, SCHEMA).repartition(7))).collect()))
    assert a == b and a


def test_profile_of_nothing(spark):
    out = temporal.suspicion(temporal.profile(spark.createDataFrame([], SCHEMA)))
    assert out.count() == 0 and "suspicion_score" in out.columns


def test_single_rows_and_undated(spark):
    data = [(1, 1, DAY, "a", "url", "x", "t"), (2, 2, None, "a", "url", "x", "t")]
    out = temporal.profile(spark.createDataFrame(data, SCHEMA)).collect()
    assert [r["cluster"] for r in out] == [1] and out[0]["temporal_spread_days"] == 0 and out[0]["burst_score_daily"] == 0


def test_campaign_arithmetic(spark):
    """44 articles, 27 active days, 5 sites, 141 days, 12 periods weigh .8184 together."""
    s = spark.createDataFrame([("politica", "guvernul anunta", 10.979, 44, 12, 27, 5, 141)], "topic_group string, representative_title string, suspicion_score double, total_articles long, burst_periods_daily long, active_days long, domain_count long, span_days long")
    assert abs(campaign.campaign_columns(s).first()["campaign_candidate_score"] - 8.985) < 0.002


def test_campaign_null_inputs(spark):
    s = spark.createDataFrame([(None, None, float("nan"), None, None, None, None, None)], "topic_group string, representative_title string, suspicion_score double, total_articles long, burst_periods_daily long, active_days long, domain_count long, span_days long")
    r = campaign.campaign_columns(s).first()
    assert r["campaign_candidate_score"] == 0 and r["campaign_candidate"] is False


def test_first_document_kept(spark):
    df = spark.createDataFrame([(2, "T", "same"), (1, "T", "same"), (3, "", "x"), (4, "T", "  ")], "row_idx long, title string, document string")
    assert [r["row_idx"] for r in curation.keep_first_documents(df).collect()] == [1]


def test_curate_empty_and_nulls(spark):
    schema = "row_idx long, title string, text string, summary string, keywords string, topics string, dialect string, url string, author string"
    assert curation.curate(spark.createDataFrame([], schema), "2024-06-30").count() == 0
    out = curation.curate(spark.createDataFrame([(1, None, None, None, None, None, None, None, None), (2, "A", "b", None, None, None, None, "a.b/2024/07/05", None)], schema), "2024-06-30").collect()
    assert [(r["row_idx"], r["timestamp"], r["timestamp_source"], r["timestamp_quality"]) for r in out] == [(2, None, "missing", "rejected_future")]


def test_page_dates(spark):
    p = spark.createDataFrame([("u", '<meta property="article:published_time" content="2021-03-04T1">'), ("v", None)], "url string, html string")
    assert {r["url"]: str(r["page_date"]) for r in pages.page_dates(p).collect()} == {"u": "2021-03-04", "v": "None"}


def test_fingerprint_sees_order_and_text(spark):
    make = lambda a: tables.index_fingerprint(spark.createDataFrame(a, "g string, i long, t string"), "g", "i", "t").first()["fingerprint"]
    assert make([("g", 0, "a"), ("g", 1, "b")]) == make([("g", 1, "b"), ("g", 0, "a")]) != make([("g", 0, "b"), ("g", 1, "a")])


def vec_rows(spark, n=60, dim=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + np.repeat(np.eye(dim)[:3] * 6, n // 3, axis=0)
    return x, spark.createDataFrame([("g", i, i // (n // 3), v.astype("float32").tolist()) for i, v in enumerate(x)], "g string, id long, label long, vec array<float>")


def test_vector_measures_equal_brute_force(spark):
    x, df = vec_rows(spark)
    x = x.astype("float32").astype(float)
    lab = np.repeat(np.arange(3), 20)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    got = {r["label"]: r["mean_cosine"] for r in vectors.intra_cluster_cosine(df, ["label"], "vec").collect()}
    for k in range(3):
        c = cos[np.ix_(lab == k, lab == k)]
        assert abs(got[k] - (c.sum() - 20) / 380) < 1e-6
    d = 1 - cos
    want = []
    for i in range(60):
        a = d[i][(lab == lab[i])].sum() / 19
        b = min(d[i][lab == k].mean() for k in range(3) if k != lab[i])
        want.append((b - a) / max(a, b))
    sil = {r["id"]: r["silhouette"] for r in vectors.silhouette_cosine(df, "g", "id", "label", "vec").collect()}
    assert np.allclose([sil[i] for i in range(60)], want, atol=1e-6)
    cent = np.stack([x[lab == k].mean(axis=0) for k in range(3)])
    s = [np.linalg.norm(x[lab == k] - cent[k], axis=1).mean() for k in range(3)]
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cent[i] - cent[j]) for j in range(3) if j != i) for i in range(3)])
    assert abs(vectors.davies_bouldin(df, "g", "label", "vec").first()["davies_bouldin"] - db) < 1e-6
    within = sum(((x[lab == k] - cent[k]) ** 2).sum() for k in range(3))
    between = sum(20 * ((cent[k] - x.mean(axis=0)) ** 2).sum() for k in range(3))
    assert abs(vectors.dispersion(df, "g", "label", "vec").first()["calinski_harabasz"] - (between / 2) / (within / 57)) < 1e-3


def test_density_clusters_find_blobs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, size=(30, 2)) for c in ((0, 0), (5, 5), (0, 8))] + [rng.uniform(-20, 20, size=(6, 2))])
    df = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "g string, id long, vec array<double>")
    for method in ("eom", "leaf"):
        out = {r["id"]: (r["label"], r["strength"]) for r in density.density_clusters(df, "g", "id", "vec", method=method).collect()}
        for k in range(3):
            top = max(set(out[i][0] for i in range(30 * k, 30 * k + 30)), key=[out[i][0] for i in range(30 * k, 30 * k + 30)].count)
            assert top >= 0 and sum(out[i][0] == top for i in range(30 * k, 30 * k + 30)) >= 25
        assert all(0 <= s <= 1 for _, s in out.values())


def test_density_of_one_row(spark):
    df = spark.createDataFrame([("g", 1, [1.0, 2.0]), ("g", 2, None)], "g string, id long, vec array<double>")
    assert [(r["id"], r["label"]) for r in density.density_clusters(df, "g", "id", "vec").collect()] == [(1, -1)]


def test_tfidf_unit_length(spark):
    df = spark.createDataFrame([("g", 1, "ana are mere"), ("g", 2, "ana are pere"), ("g", 3, None)], "g string, id long, t string")
    out = text_model.tfidf(df, "id", "t", ["g"]).groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert len(out) == 2 and all(abs(r["s"] - 1) < 1e-9 for r in out)


def test_mode_takes_smaller_on_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "z"), (2, "z"), (2, "a")], "k long, v string")
    assert {r["k"]: r["m"] for r in serving.mode_by_count(df, ["k"], "v", "m").collect()} == {1: "a", 2: "z"}


def test_streaming_counts_equal_batch(spark, tmp_path):
    from newsgrain.streaming.windows import bucket_counts

    df = spark.createDataFrame(rows(spark, 5), SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    for step in (1, 7):
        q = bucket_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), step).writeStream.outputMode("complete").format("memory").queryName(f"s{step}").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(f"s{step}").collect())) == sorted(map(tuple, temporal.bucket_counts(df, step).collect()))

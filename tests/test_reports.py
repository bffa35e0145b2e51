"""Reports, term spaces, coarse lists, encoders, sources and streams, on small tables."""

import datetime as dt

import numpy as np
import pytest

from newsgrain.functions.register import register
from newsgrain.operators import ann, curation, encoder, evaluation, runtime, serving, text_model, vectors
from newsgrain.sources import tables
from newsgrain.streaming import windows

DAY = dt.datetime(2023, 1, 2)


def test_reduced_terms_span_the_singular_directions(spark):
    rng = np.random.default_rng(0)
    dense = np.where(rng.random((40, 25)) < 0.4, rng.random((40, 25)), 0) + np.outer(rng.random(40), rng.random(25))
    cells = [("g", i, f"t{j:02d}", float(dense[i, j])) for i in range(40) for j in range(25)] + [("tiny", 1, "x", 1.0), ("tiny", 2, "x", 1.0)]
    out = text_model.truncated_svd(spark.createDataFrame(cells, "g string, id long, term string, weight double"), "g", k=5).collect()
    assert {r["g"] for r in out} == {"g"} and len(out) == 40
    got = np.array([r["reduced"] for r in sorted(out, key=lambda r: r["id"])])
    want = np.linalg.svd(dense)[1][:5]
    assert np.allclose(np.sort(np.linalg.norm(got, axis=0))[::-1], want, rtol=0.02)
    none = text_model.truncated_svd(spark.createDataFrame([], "g string, id long, term string, weight double"), "g")
    assert none.count() == 0 and none.columns == ["g", "id", "reduced"]


def test_mini_batches_find_blobs():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, size=(50, 2)) for c in ((0, 0), (5, 5), (0, 8))])
    labels, cost = min((text_model.minibatch(x, 3, s) for s in range(42, 47)), key=lambda f: f[1])
    assert all(len(set(labels[50 * k : 50 * k + 50])) == 1 for k in range(3)) and len(set(labels)) == 3 and cost < 10


def test_coarse_lists_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "PROBES", 8)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 8))[rng.integers(0, 30, 900)] + rng.normal(size=(900, 8)) * 0.2
    rows = [("g", i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))] + [("few", i, [1.0, float(i)] + [0.0] * 6) for i in range(5)]
    df = spark.createDataFrame(rows, "topic string, id long, vec array<double>").repartition(3)
    asked = df.where("id % 20 = 0")
    key = lambda d: {(r["grp"], r["id"], r["neighbour"]) for r in d.collect()}
    exact, found = key(vectors.exact_knn(df, asked, "id", "vec", "topic")), key(ann.ivf_knn(df, asked, "id", "vec", "topic"))
    assert len(exact & found) >= 0.9 * len(exact) and {n for g, _, n in found if g == "few"} == {1, 2, 3, 4}
    assert ann.ivf_knn(df.where("false"), asked.where("false"), "id", "vec", "topic").count() == 0


def test_encoders(spark):
    df = spark.createDataFrame([(1, "guvernul voteaza bugetul"), (2, "Guvernul voteaza bugetul"), (3, "echipa castiga meciul"), (4, None), (5, "")], "id long, t string").repartition(2)
    v = {r["id"]: r["vec"] for r in encoder.encode_texts(df, "id", "t", encoder.hashed(64)).collect()}
    assert v[1] == v[2] and v[4] is None and v[5] is None and abs(np.linalg.norm(v[1]) - 1) < 1e-5 and abs(np.dot(v[1], v[3])) < 0.7
    made = spark.createDataFrame([(1, [3.0, 4.0])], "id long, vec array<float>")
    assert {r["id"]: r["vec"] for r in encoder.encode_texts(df, "id", "t", encoder.stored(made)).collect()}[1] == pytest.approx([0.6, 0.8])
    length = {r["id"]: r["vec"] for r in encoder.encode_texts(df, "id", "t", encoder.of_model(lambda ts: [[float(len(t)), 0.0] for t in ts])).collect()}
    assert length[1] == [1.0, 0.0] and length[4] is None


STATS = "topic_group string, cluster long, total_articles long, suspicion_score double, suspicion_score_raw double, burst_score_daily long, burst_score_weekly long, burst_stable int, support_weight double, coverage_weight double, source_weight double, domain_weight double, suspicion_penalty_total double"


def test_bursts_on_and_off(spark):
    s = spark.createDataFrame([("a", 1, 10, 6.0, 20.0, 1, 1, 1, 1.0, 1.0, 1.0, 0.5, 1.0), ("a", 2, 5, None, 3.0, 0, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", 3, None, float("nan"), None, None, None, None, None, None, None, None, None)], STATS)
    rows = {r["burst_enabled"]: r for r in evaluation.burst_ablation(s).collect()}
    assert (rows[True]["mean_cluster_suspicion"], rows[True]["median_cluster_suspicion"], rows[True]["n_articles"]) == (2.0, 0.0, 15)
    assert rows[False]["mean_cluster_suspicion"] == pytest.approx((3.5 + 2.0 + 0.0) / 3, abs=1e-6) and rows[False]["topk_mean_suspicion"] == rows[False]["mean_cluster_suspicion"]


def test_ablation_winner_stands_in_all_rows(spark):
    points = spark.createDataFrame([("a", "x", 0.5, 1.0), ("a", "y", 0.1, 2.0), ("b", "x", None, None)], "topic_group string, method string, silhouette double, davies_bouldin double")
    bursts = spark.createDataFrame([("a", "m_with_burst", True, 3, 1, 0.1, 0.1, 0.1), ("c", "m_with_burst", True, 3, 1, 0.1, 0.1, 0.1)], "topic_group string, method string, burst_enabled boolean, n_articles long, num_clusters long, mean_cluster_suspicion double, median_cluster_suspicion double, topk_mean_suspicion double")
    out = {(r["topic_group"], r["method"]): r for r in evaluation.ablation_report(points, bursts).collect()}
    assert out["a", "x"]["quality_index"] == 1.0 and out["a", "y"]["quality_index"] == 0.0 and out["a", "y"]["quality_rank_topic"] == 2
    assert out["a", "m_with_burst"]["topic_winner_method"] == "x" and out["a", "m_with_burst"]["quality_index"] is None and out["c", "m_with_burst"]["topic_winner_method"] is None


def test_best_configuration_goes_by_selection_score(spark):
    rows = [("a", 8, 3, 0.1, 9.0, None), ("a", 10, 4, 0.9, 1.0, 7.0), ("b", 8, 3, None, None, None)]
    df = spark.createDataFrame(rows, "topic_group string, min_cluster_size long, min_samples long, silhouette double, selection_score double, davies_bouldin double")
    assert {r["topic_group"]: r["min_cluster_size"] for r in serving.best_config(df).collect()} == {"a": 8, "b": 8}
    assert {r["topic_group"]: (r["silhouette"], r["davies_bouldin"]) for r in serving.best_config(df, parity=True).collect()} == {"a": (0.1, 7.0), "b": (None, None)}


CD = "row_idx long, topic_group string, cluster long, title string, url string, published_at timestamp, cluster_membership_strength float, cluster_outlier_score float, topic_group_reason string, cluster_assignment_reason string"


def test_overview_counts_absent_strengths_as_zero(spark):
    rows = [(1, "a", 5, "T", "www.x.ro/p", None, None, None, "r", "c"), (2, "a", 5, None, None, None, 0.5, float("nan"), "", "c"), (3, "a", -1, "n", None, DAY, 1.0, 0.0, "r", "c")]
    (r,) = serving.cluster_overview(spark.createDataFrame(rows, CD)).collect()
    assert (r["article_count"], r["mean_membership_strength"], r["mean_outlier_score"], r["span_days"], r["peak_day_share"], r["undated_articles"]) == (2, 0.25, 0.0, 0, 0.0, 2)
    assert (r["representative_title"], r["topic_group_reason_mode"]) == ("", "r") and len(r) == 24
    assert serving.cluster_overview(spark.createDataFrame([], CD)).count() == 0


def test_sources(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, 0.5)], "i int, v double")
    a.write.parquet(f"{tmp_path}/a")
    b.write.parquet(f"{tmp_path}/b")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "part.parquet").write_text("broken")
    whole, bad = tables.union_files(spark, [f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/c", f"{tmp_path}/none"])
    assert bad == [f"{tmp_path}/c", f"{tmp_path}/none"] and {tuple(r) for r in whole.select("i", "s", "v").collect()} == {(1, "x", None), (2, None, 0.5)}
    assert tables.union_files(spark, [f"{tmp_path}/none"]) == (None, [f"{tmp_path}/none"])
    (tmp_path / "w.txt").write_text("Și\n\n și \nșI\nfara\n")
    assert sorted(r["word"] for r in tables.stopword_table(spark, f"file://{tmp_path}/w.txt").collect()) == ["fara", "si", "și"]
    assert set(tables.layout(spark, f"file://{tmp_path}/root")) == set(tables.FOLDERS) and (tmp_path / "root" / "serving").is_dir()
    assert tables.passthrough(spark, f"{tmp_path}/none", f"{tmp_path}/copy") is False


def test_clean_columns_and_page_dates(spark):
    df = spark.createDataFrame([("T", None)], "title string, url string")
    assert curation.canonical(df, ["url", "title", "author"]).collect()[0].asDict() == {"url": None, "title": "T", "author": ""}
    schema = "row_idx long, title string, text string, url string"
    pages = spark.createDataFrame([("x.ro/p", dt.date(2021, 3, 4))], "url string, page_date date")
    (r,) = curation.curate(spark.createDataFrame([(1, "A", "b c", "x.ro/p")], schema), "2024-06-30", (), pages).collect()
    assert (str(r["timestamp"]), r["timestamp_source"], r["timestamp_quality"]) == ("2021-03-04", "htmldate", "high")


def test_stage_seconds(spark):
    w = runtime.Stopwatch()
    with w.stage("a", "one"):
        pass
    out = {r["topic_group"]: r for r in w.table(spark, {"a": 10, "b": 0}, ["one", "two"]).collect()}
    assert out["a"]["one_seconds"] >= 0 and out["a"]["two_seconds"] is None and out["__GLOBAL__"]["topic_size"] == 10 and out["b"]["rows_per_second"] is None


def stream_of(spark, tmp_path, rows, schema):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def result(spark, stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    at = lambda h: DAY + dt.timedelta(hours=h)
    rows = [(1, at(0), "x.ro", "d1"), (1, at(3), "y.ro", "d2"), (1, at(60), "x.ro", "d1"), (2, None, "z.ro", "d3"), (2, at(1), "z.ro", "d2")]
    schema = "cluster long, ts timestamp, domain string, document string"
    (tmp_path / "a").mkdir()
    s = stream_of(spark, tmp_path / "a", rows, schema)
    runs = {(r["cluster"], r["start"], r["n"]) for r in result(spark, windows.activity_runs(s), "runs", "complete")}
    assert runs == {(1, at(0), 2), (1, at(60), 1), (2, at(1), 1)}
    so_far = {r["cluster"]: (r["n"], r["dated"], r["first_ts"], r["last_ts"], r["sites"]) for r in result(spark, windows.running_figures(s), "so_far", "complete")}
    assert so_far == {1: (3, 3, at(0), at(60), 2), 2: (2, 1, at(1), at(1), 1)}
    firsts = result(spark, windows.first_documents(s.where("ts is not null")), "firsts", "append")
    assert sorted(r["document"] for r in firsts) == ["d1", "d2"]


def test_registered_function(spark):
    register(spark)
    assert spark.sql("SELECT strip_diacritics_exact('ﬁnă') AS x, strip_diacritics_exact(NULL) AS y").collect()[0].asDict() == {"x": "fina", "y": None}


ARTICLES = "row_idx long, cluster long, ts timestamp, domain string, timestamp_source string, topic_group string, title string"


def test_temporal_table(spark):
    from newsgrain.operators import temporal

    rows = [(i, 1, DAY + dt.timedelta(days=i % 3), "a.md", "url" if i % 2 else None, "x", f"t{i}") for i in range(8)] + [(20, 1, None, "b.md", "Missing", "y", "late"), (30, -1, DAY, "a.md", "url", "x", "noise"), (31, 2, None, "a.md", "url", "x", "undated")]
    (r,) = temporal.temporal_table(spark.createDataFrame(rows, ARTICLES)).collect()
    assert len(r) == 63 and (r["cluster"], r["total_articles"], r["timestamped_articles"], r["representative_title"], r["topic_group"]) == (1, 9, 8, "t0", "x")
    assert (r["timestamp_source_url_share"], r["timestamp_source_missing_share"]) == (round(4 / 9, 4), round(5 / 9, 4))
    assert r["burst_score"] == r["burst_score_daily"] and r["article_count"] == 9
    assert temporal.temporal_table(spark.createDataFrame([], ARTICLES)).columns == [*temporal.TABLE_COLUMNS, *temporal.CAMPAIGN_COLUMNS]

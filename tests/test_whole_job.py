"""Queries that once covered a part of their rows or texts, on small tables of their own."""

import math
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from newsgrain.operators import density, text_model


@pytest.fixture
def run(spark, tmp_path):
    """Run a query over tables given as name=(rows, schema)."""

    spark.conf.set("spark.newsgrain.stopwords", f"file://{tmp_path}/stopwords.txt")
    (tmp_path / "stopwords.txt").write_text("pentru\n\ndupă\neste\naceastă\nmare\niar\ndouă\n")

    def of(query, **tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return entry.queries()[query](spark, str(tmp_path)).collect()

    yield of
    spark.conf.unset("spark.newsgrain.stopwords")


DOCS = "row_idx long, topic_group string, cluster long, title string, short_document string, document string"


def docs():
    bodies = ["pentru buget guvernul voteaza", "Guvernul voteaza după buget", "meci echipa castiga", "echipa pierde meci pentru cupa", None, "meci buget"]
    return [(i, "ab"[i % 2], i // 2, "Titlu scurt", (b or "")[:4], b and f"Titlu scurt\n{b}") for i, b in enumerate(bodies)]


def brute_tfidf(rows):
    """{(topic, row, term): weight} of documents without the two stopwords that stand in them."""
    out, by = {}, {}
    for i, topic, _, _, _, d in rows:
        w = [x for x in re.findall("[a-z]+", (d or "").lower().replace("ă", "a")) if x not in ("pentru", "dupa")]
        by.setdefault(topic, {})[i] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    for topic, counts in by.items():
        df = Counter(t for c in counts.values() for t in c)
        for i, c in counts.items():
            x = {t: (1 + math.log(n)) * (math.log((1 + len(counts)) / (1 + df[t])) + 1) for t, n in c.items() if df[t] >= 2}
            length = math.sqrt(sum(v * v for v in x.values()))
            out |= {(topic, i, t): round(v / length, 6) for t, v in x.items()}
    return out


def test_tfidf_of_whole_documents(run):
    got = {(r["topic_group"], r["id"], r["term"]): r["weight"] for r in run("V14_tfidf", clustered_data=(docs(), DOCS))}
    want = brute_tfidf(docs())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_top_terms_of_whole_documents(run):
    found = {r["term"] for r in run("V19_top_terms", clustered_data=(docs(), DOCS))}
    assert {"meci", "buget"} <= found and not found & {"pentru", "dupa"}


VECTORS = "topic_group string, topic_row_idx long, vec array<float>"
LABELS = "topic_group string, topic_row_idx long, cluster long, topic_is_eligible boolean"


def blobs():
    """Two eligible topics, of three and two blobs with noise and repeated rows, and a small one."""
    rng = np.random.default_rng(7)
    out = []
    for topic, k in (("a", 3), ("b", 2)):
        x = np.concatenate([rng.normal(np.eye(4)[c] * 5, 0.3, size=(30, 4)) for c in range(k)] + [rng.uniform(-5, 5, size=(8, 4))])
        x[5] = x[4]
        out += [(topic, i, v.tolist()) for i, v in enumerate(x)]
    return out + [("small", i, [1.0, float(i), 0.0, 0.0]) for i in range(10)]


def tables_of(vecs):
    labels = [(t, i, -1 if t == "small" else i // 30 if i % 7 else -1, t != "small") for t, i, _ in vecs]
    return {"article_vectors": (vecs, VECTORS), "clustered_data": (labels, LABELS)}


def test_density_clusters_of_topics_divided(run, monkeypatch):
    key = lambda rows: sorted((r["grp"], r["id"], r["cluster"], round(r["strength"], 9)) for r in rows)
    whole = key(run("V5_density_clusters", **tables_of(blobs())))
    monkeypatch.setattr(density, "MAX_ROWS", 40)
    assert key(run("V5_density_clusters", **tables_of(blobs()))) == whole
    assert len(whole) == len(blobs()) and len({c for g, _, c, _ in whole if g == "a" and c >= 0}) == 3
    assert {c for g, _, c, _ in whole if g == "small"} == {-1}


def test_density_sweep_of_topics(run):
    got = run("V6_density_sweep", **tables_of(blobs()))
    assert len(got) == 8 and {r["topic_group"] for r in got} == {"a", "b"}
    assert sum(r["best"] for r in got) == 2 and all(r["num_clusters"] + 0 >= 2 and r["silhouette"] > 0.5 for r in got if r["best"])
    for t in "ab":
        own = [r for r in got if r["topic_group"] == t]
        assert max(r["selection_score"] for r in own) == next(r["selection_score"] for r in own if r["best"])


def test_frequent_words_of_whole_documents(run):
    words = {r["word"]: r["n_docs"] for r in run("S12_frequent_words", clustered_data=(docs(), DOCS))}
    assert words["meci"] == 3 and words["buget"] == 3 and words["titlu"] == 5


def test_graph_cohesion_counts_every_point(run):
    vecs = blobs()
    labels = {(t, i): k for t, i, k, _ in tables_of(vecs)["clustered_data"][0]}
    shares = {}
    for t in {t for t, _, _ in vecs}:
        ids = [i for u, i, _ in vecs if u == t]
        x = np.array([v for u, _, v in vecs if u == t], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(x @ x.T, 6)
        for a, i in enumerate(ids):
            near = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:10]
            shares[t, i] = np.mean([labels[t, ids[b]] == labels[t, i] for b in near])
    for r in run("V12_graph_cohesion", **tables_of(vecs)):
        own = {k: v for k, v in shares.items() if k[0] == r["topic_group"]}
        true = [v for k, v in own.items() if labels[k] != -1]
        assert abs(r["cohesion"] - np.mean(list(own.values()))) < 1e-6 and (not true or abs(r["cohesion_real"] - np.mean(true)) < 1e-6)


SWEEP = "topic_group string, num_clusters long, selection_score double, min_cluster_size long, min_samples long"


@pytest.mark.parametrize("large", [50_000, 60])
def test_kmeans_of_each_topic(run, monkeypatch, large):
    """Topic a asks for 3 clusters in its best row and b for 2, which the least of three raises; the small one for 10, bounded by its rows."""
    monkeypatch.setattr(text_model, "LARGE_TOPIC", large)
    vecs = [v for v in blobs() if v[0] == "small" or v[1] < (90 if v[0] == "a" else 60)]
    sweep = [("a", 3, 9.0, 8, 3), ("a", 50, 1.0, 10, 3), ("b", 2, 9.0, 8, 3)]
    got = run("V16_V17_kmeans", sweep_results=(sweep, SWEEP), **tables_of(vecs))
    by = {}
    for r in got:
        by.setdefault(r["topic_group"], {})[r["topic_row_idx"]] = r["label"]
    assert len(got) == len(vecs) and {t: len(set(x.values())) for t, x in by.items()} == {"a": 3, "b": 3, "small": 9}
    assert all(len({by["a"][i] for i in range(30 * c, 30 * c + 30)}) == 1 for c in range(3))


RAW = "row_idx long, crawled_at timestamp, title string, text string, summary string, keywords string, topics string, dialect string, url string, author string"


def test_curated_corpus_has_documents_without_stopwords(run):
    body = "Această casă este mare, " * 40 + "iar la final Guvernul votează 2021."
    rows = [(1, None, "Două știri pentru oraș", body, None, None, None, None, None, None), (2, None, "", "x", None, None, None, None, None, None)]
    got = {r["row_idx"]: r["document_nostop"] for r in run("curated_corpus", raw_articles=(rows, RAW))}
    assert got == {1: "stiri oras " + "casa " * 40 + "final guvernul voteaza"}

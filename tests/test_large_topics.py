"""Operators over topics of a size that once took hours: the same results by less work."""

import numpy as np
import pytest
from test_whole_job import SWEEP, blobs, run, tables_of  # noqa: F401

from newsgrain.operators import density, text_model, vectors


def plain_lloyd(x, k, seed, max_iter):
    """k-means that compares every row with every centre in each round."""
    c = x[text_model._starts(x, x.astype(np.float32), k, np.random.default_rng(seed))].copy()
    labels = None
    for _ in range(max_iter):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        new, cost = d.argmin(axis=1), d.min(axis=1).sum()
        if labels is not None and (new == labels).all():
            break
        labels = new
        for j in np.unique(labels):
            c[j] = x[labels == j].mean(axis=0)
    return labels, cost


@pytest.mark.parametrize("n, k, rounds", [(60, 5, 300), (200, 30, 300), (200, 30, 3), (300, 1, 300), (500, 60, 300), (500, 60, 1)])
def test_kmeans_as_if_all_were_compared(n, k, rounds):
    for seed in range(4):
        x = np.random.default_rng(seed).normal(size=(n, 6)) * 3
        x[5] = x[4]
        labels, cost = text_model.lloyd(x, k, seed, rounds)
        want, least = plain_lloyd(x, k, seed, rounds)
        assert (labels == want).all() and abs(cost - least) < 1e-6 * least


def no_library(*_, **__):
    raise AssertionError("fitted by the library's k-means, a job for every round")


@pytest.mark.parametrize("divided", [250_000, 80])
def test_kmeans_of_large_topics(run, monkeypatch, divided):  # noqa: F811
    """Topics of many rows have five starts in tasks of their own; only from DIVIDED_TOPIC rows on they go to the library."""
    monkeypatch.setattr(text_model, "LARGE_TOPIC", 60)
    monkeypatch.setattr(text_model, "DIVIDED_TOPIC", divided, raising=False)
    if divided > 100:
        monkeypatch.setattr(text_model, "kmeans", no_library)
    vecs = [v for v in blobs() if v[0] == "small" or v[1] < (90 if v[0] == "a" else 60)]
    got = run("V16_V17_kmeans", sweep_results=([("a", 3, 9.0, 8, 3), ("b", 2, 9.0, 8, 3)], SWEEP), **tables_of(vecs))
    by = {}
    for r in got:
        by.setdefault(r["topic_group"], {})[r["topic_row_idx"]] = r["label"]
    assert len(got) == len(vecs) and {t: len(set(x.values())) for t, x in by.items()} == {"a": 3, "b": 3, "small": 9}
    assert all(len({by["a"][i] for i in range(30 * c, 30 * c + 30)}) == 1 for c in range(3))


def test_mini_batches_of_large_topics(spark, monkeypatch):
    """They too are fitted in tasks, and every row has its nearest centre's label."""
    monkeypatch.setattr(text_model, "LARGE_TOPIC", 60)
    monkeypatch.setattr(text_model, "kmeans", no_library)
    vecs = [(t, i, v) for t, i, v in blobs() if t == "a" and i < 90]
    df, k = spark.createDataFrame(vecs, "g string, id long, vec array<double>"), spark.createDataFrame([("a", 3)], "grp string, k long")
    got = {r["id"]: r["label"] for r in text_model.kmeans_by_topic(df, "g", "id", "vec", k, batches=True).collect()}
    assert len(got) == 90 and [len({got[i] for i in range(30 * c, 30 * c + 30)}) for c in range(3)] == [1, 1, 1] and len(set(got.values())) == 3


@pytest.mark.parametrize("pairs", [500_000_000, 2_000])
def test_all_nearest_without_pairs_of_blocks(spark, monkeypatch, pairs):
    """The rows of the search of single rows, ties too, in one task a group and in several."""
    monkeypatch.setattr(vectors, "PAIRS_A_CELL", pairs)
    rows = [(t, i, [round(z, 1) for z in v]) for t, i, v in blobs()] + [("one", 1, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, id long, vec array<double>")
    key = lambda x: sorted((r["grp"], r["id"], r["neighbour"], r["rank"], r["score"]) for r in x.collect())
    for k in (1, 10):
        assert key(vectors.all_nearest(df, "id", "vec", "g", k)) == key(vectors.exact_knn(df, df, "id", "vec", "g", k))


def spread_points(n=400):
    """Dense and thin places, far ones, and repeated rows: the near rows of this do not hang together."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, s, size=(n // 4, 5)) for c, s in ((0, 1), (9, 0.2), (-40, 0.1), (3, 4))])
    x[10:30] = x[10]
    return [("t", i * 3, v.tolist()) for i, v in enumerate(x)]


def no_pairs(*_):
    raise AssertionError("a tree of every pair of blocks, row by row")


@pytest.mark.parametrize("pairs", [500_000_000, 30_000])
@pytest.mark.parametrize("config", [(8, 3, "eom", 0.0), (12, 6, "leaf", 0.5)])
def test_density_of_a_large_topic_by_two_passes(spark, monkeypatch, pairs, config):
    monkeypatch.setattr(vectors, "PAIRS_A_CELL", pairs)
    df = spark.createDataFrame(spread_points(), "g string, id long, vec array<double>")
    key = lambda: sorted((r["id"], r["label"], round(r["strength"], 9)) for r in density.density_clusters(df, "g", "id", "vec", *config).collect())
    whole = key()
    monkeypatch.setattr(density, "MAX_ROWS", 100)
    monkeypatch.setattr(density, "spanning_tree", no_pairs)
    assert key() == whole and len({x[1] for x in whole}) > 2


def test_density_sweep_of_large_topics(spark, monkeypatch):
    """All configurations of a large topic from the same two passes, with the rows of the small path."""
    df = spark.createDataFrame([x for x in blobs() if x[0] == "a"], "g string, id long, vec array<double>")
    found = lambda: sorted(density.sweep(df, "g", "id", "vec").collect(), key=lambda r: r["min_cluster_size"])
    whole = found()
    monkeypatch.setattr(density, "MAX_ROWS", 80)
    monkeypatch.setattr(density, "density_clusters", no_pairs)
    got = found()
    assert len(got) == len(whole) == 4
    for one, other in zip(got, whole):
        assert all(a == b or isinstance(a, float) and abs(a - b) <= 1e-9 * abs(b) for a, b in zip(one, other)), [x for x in zip(one, other) if x[0] != x[1]]  # sums are in another order

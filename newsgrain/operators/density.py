"""Hierarchical density clustering per topic.

Published algorithm (Campello, Moulavi, Sander 2013): core distances, mutual reachability, minimum spanning tree,
hierarchy condensed by a least cluster size, clusters chosen by stability (`eom`) or as leaves (`leaf`). A topic is one
group of vectors; its tree is built in Prim's order with memory linear in the rows, so one task holds one topic's
vectors. In a topic beyond `MAX_ROWS` every row first gets its core distances and some near rows, in tasks of some rows
each. A spanning tree of those near rows tells, for every row, the largest edge on the way to one root; an edge longer
than that on both its ends is on a circle of shorter ones and not of the least tree. The others, which are few, are
found by a second pass over all pairs, and the least tree is that of these. The result is the same: distances are
rounded, and equal ones are ordered by id. Only the near rows, the edges and the hierarchy of one topic, all linear in
its rows, stand in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import nearest_rows, side_by_side

MAX_ROWS = 8_000
#: Near rows that the first tree of a large topic is made of, at least; rows its parts are joined through.
NEAR, JOINS = 12, 4_096
BLOCK = 512
#: Distances are rounded, so that they are the same in whichever block they are computed.
DECIMALS = 6


def nearest_distances(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The k least distances, in no order, of every row of x to the rows of y."""
    out = np.empty((len(x), k))
    sq = (y * y).sum(axis=1)
    for a in range(0, len(x), BLOCK):
        part = x[a : a + BLOCK]
        d = np.maximum((part * part).sum(axis=1)[:, None] + sq[None] - 2 * part @ y.T, 0)
        out[a : a + BLOCK] = np.round(np.sqrt(np.partition(d, k - 1, axis=1)[:, :k]), DECIMALS)
    return out


def core_distances(x: np.ndarray, k: int) -> np.ndarray:
    """Distance of every row to its k-th nearest row, itself counted."""
    return nearest_distances(x, x, min(k, len(x))).max(axis=1)


def spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (i, j, distance), i < j, of the minimum spanning tree under mutual reachability, by Prim's algorithm.

    Edges are ordered by (distance, i, j), in which the tree is the only one.
    """
    n = len(x)
    sq = (x * x).sum(axis=1)
    rest = np.arange(1, n)  # rows outside the tree, with their best edge into it
    best, source = np.full(len(rest), np.inf), np.zeros(len(rest), dtype=np.int64)
    y, ysq, ycore = x[1:].copy(), sq[1:].copy(), core[1:].copy()
    edges = np.empty((max(n - 1, 0), 3))
    at, m = 0, n - 1
    for k in range(n - 1):
        d = np.round(np.sqrt(np.maximum(ysq[:m] + sq[at] - 2 * (y[:m] @ x[at]), 0)), DECIMALS)
        d = np.maximum(np.maximum(d, ycore[:m]), core[at])
        b, s, r = best[:m], source[:m], rest[:m]
        near = d < b
        tie = np.flatnonzero(d == b)
        if len(tie):
            lo, hi, old_lo, old_hi = np.minimum(at, r[tie]), np.maximum(at, r[tie]), np.minimum(s[tie], r[tie]), np.maximum(s[tie], r[tie])
            near[tie] = (lo < old_lo) | ((lo == old_lo) & (hi < old_hi))
        b[near], s[near] = d[near], at
        least = np.flatnonzero(b == b.min())
        lo, hi = np.minimum(s[least], r[least]), np.maximum(s[least], r[least])
        p = int(least[np.lexsort((hi, lo))[0]])
        i, j = sorted((int(source[p]), int(rest[p])))
        edges[k] = i, j, best[p]
        at, m = int(rest[p]), m - 1
        for v in (rest, best, source, y, ysq, ycore):  # the last row takes the place of the one that joined
            v[p] = v[m]
    return edges[np.lexsort((edges[:, 1], edges[:, 0], edges[:, 2]))]


def forest(edges: np.ndarray) -> np.ndarray:
    """Of edges (i, j, distance) those of the minimum spanning forest, by Kruskal's algorithm in the order of spanning_tree."""
    if not len(edges):
        return edges
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0], edges[:, 2]))]
    names, ends = np.unique(edges[:, :2].astype(np.int64), return_inverse=True)
    ends = ends.reshape(-1, 2).tolist()
    parent = list(range(len(names)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    keep = []
    for e, (i, j) in enumerate(ends):
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            keep.append(e)
    return edges[keep]


def condensed_labels(edges: np.ndarray, n: int, least: int, method: str = "eom", epsilon: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(label of every row, -1 for noise; membership strength) from the spanning tree."""
    labels, strength = np.full(n, -1), np.zeros(n)
    if n < 2:
        return labels, strength
    order = np.argsort(edges[:, 2], kind="stable")
    parent = np.arange(2 * n - 1)
    left, right, height, size = np.zeros(n - 1, int), np.zeros(n - 1, int), np.zeros(n - 1), np.ones(2 * n - 1, int)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, e in enumerate(order):
        a, b = find(int(edges[e, 0])), find(int(edges[e, 1]))
        left[k], right[k], height[k] = a, b, edges[e, 2]
        parent[a] = parent[b] = n + k
        size[n + k] = size[a] + size[b]
    # walk down from the root: a split into two large parts makes two clusters, small parts fall out
    birth, children, fallen = {0: 0.0}, {0: []}, {0: []}
    stack, nxt = [(2 * n - 2, 0)], 1

    def rows_below(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += [left[v - n], right[v - n]]
        return out

    while stack:
        node, cluster = stack.pop()
        if node < n:
            fallen[cluster].append((node, np.inf))
            continue
        a, b, h = left[node - n], right[node - n], height[node - n]
        lam = 1 / h if h > 0 else np.inf
        big = [c for c in (a, b) if size[c] >= least]
        if len(big) == 2:
            for c in big:
                birth[nxt], children[nxt], fallen[nxt] = lam, [], []
                children[cluster].append(nxt)
                stack.append((c, nxt))
                nxt += 1
        else:
            for c in (a, b):
                if size[c] < least:
                    fallen[cluster] += [(r, lam) for r in rows_below(c)]
                else:
                    stack.append((c, cluster))
    def finite(lam: float, cluster: int) -> float:
        return min(lam, 1e12) - min(birth[cluster], 1e12)

    members = {c: len(fallen[c]) for c in birth}
    for c in sorted(birth, reverse=True):
        members[c] += sum(members[k] for k in children[c])
    stability = {c: sum(finite(lam, c) for _, lam in fallen[c]) + sum(members[k] * finite(birth[k], c) for k in children[c]) for c in birth}
    chosen: dict[int, bool] = {}
    for c in sorted(birth, reverse=True):  # children have greater numbers
        below = sum(stability[k] for k in children[c])
        if method == "leaf":
            chosen[c] = not children[c]
        else:
            chosen[c] = c != 0 and (not children[c] or stability[c] >= below)
            if children[c] and not chosen[c]:
                stability[c] = below
    if method == "leaf" and not children[0]:
        chosen[0] = False
    roots: list[int] = []
    todo = [0]
    while todo:
        c = todo.pop()
        near = epsilon > 0 and c != 0 and children[c] and all(birth[k] >= 1 / epsilon for k in children[c])
        if c != 0 and (chosen[c] or near):
            roots.append(c)
        else:
            todo += children[c]
    for number, c in enumerate(sorted(roots)):
        own, todo = [], [c]
        while todo:
            k = todo.pop()
            own += fallen[k]
            todo += children[k]
        top = max((lam for _, lam in own if np.isfinite(lam)), default=0.0)
        for r, lam in own:
            labels[r] = number
            strength[r] = 1.0 if top <= 0 or not np.isfinite(lam) else min(lam, top) / top
    return labels, strength


def _matrix(vecs) -> np.ndarray:  # noqa: ANN001
    return np.stack(vecs.to_numpy()).astype(np.float64)


def _first_tree(x: np.ndarray, core: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Edges (i, j, distance) of a spanning tree, nearly the least, from the near rows of each row."""
    n = len(x)
    i, j = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    keep = (j >= 0) & (i != j)
    i, j = np.minimum(i[keep], j[keep]), np.maximum(i[keep], j[keep])
    i, j = np.divmod(np.unique(i * n + j), n)
    edges = forest(np.column_stack([i, j, _reach(x, core, i, j)]))
    part = _parts(edges, n)
    names, sizes = np.unique(part, return_counts=True)
    if len(names) > 1:  # every part is joined to the largest through its row nearest to some of that
        main = names[sizes.argmax()]
        own = np.flatnonzero(part == main)
        own = own[:: max(1, len(own) // JOINS)]
        rest = np.flatnonzero(part != main)
        sq = (x * x).sum(axis=1)
        to, d = np.empty(len(rest), dtype=np.int64), np.empty(len(rest))
        for a in range(0, len(rest), BLOCK):
            rows = rest[a : a + BLOCK]
            far = np.maximum(sq[rows, None] + sq[own] - 2 * x[rows] @ x[own].T, core[own] ** 2)
            to[a : a + BLOCK] = own[far.argmin(axis=1)]
        d = _reach(x, core, rest, to)
        order = np.lexsort((d, part[rest]))
        _, first = np.unique(part[rest][order], return_index=True)
        pick = order[first]
        edges = np.vstack([edges, np.column_stack([np.minimum(rest[pick], to[pick]), np.maximum(rest[pick], to[pick]), d[pick]])])
    return edges


def _reach(x: np.ndarray, core: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Mutual reachability of rows i and j."""
    sq = np.einsum("ij,ij->i", x, x)
    d = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.empty(0)])
    d = np.round(np.sqrt(np.maximum(sq[i] + sq[j] - 2 * d, 0)), DECIMALS)
    return np.maximum(np.maximum(core[i], core[j]), d)


def _parts(edges: np.ndarray, n: int) -> np.ndarray:
    """The least row of each row's connected part."""
    i, j = edges[:, 0].astype(np.int64), edges[:, 1].astype(np.int64)
    part = np.arange(n)
    while True:
        low = np.minimum(part[i], part[j])
        new = part.copy()
        np.minimum.at(new, part[i], low)
        np.minimum.at(new, part[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == part).all():
            return part
        part = new


def _to_root(edges: np.ndarray, n: int) -> np.ndarray:
    """Of a spanning tree: the largest edge on the way from each row to a root, which stands where most edges are short."""
    short = edges[edges[:, 2] <= np.quantile(edges[:, 2], 0.9)] if len(edges) else edges
    names, sizes = np.unique(_parts(short, n), return_counts=True)
    i, j, d = np.concatenate([edges[:, 0], edges[:, 1]]).astype(np.int64), np.concatenate([edges[:, 1], edges[:, 0]]).astype(np.int64), np.concatenate([edges[:, 2], edges[:, 2]])
    order = np.argsort(i, kind="stable")
    begin, to, d = np.searchsorted(i[order], np.arange(n + 1)).tolist(), j[order].tolist(), d[order].tolist()
    largest = [-1.0] * n
    root = int(names[sizes.argmax()])
    largest[root] = 0.0
    todo = [root]
    while todo:
        v = todo.pop()
        for e in range(begin[v], begin[v + 1]):
            w = to[e]
            if largest[w] < 0:
                largest[w] = max(largest[v], d[e])
                todo.append(w)
    return np.array(largest)


def _divided(rows: DataFrame, configs: dict[str, list[tuple]]) -> DataFrame:
    """(grp, id, label, strength) of groups of more than MAX_ROWS rows. configs: by group (name, least size, samples, method, epsilon); the names are the groups that come out."""
    import pyarrow as pa

    from ..session import materialize

    k = max([NEAR, *(c[2] for own in configs.values() for c in own)])

    def near(grp, own, others):  # noqa: ANN001, ANN202
        found, value = nearest_rows(own, others, k, distance=True)
        d = np.round(np.sqrt(np.maximum(-value, 0)), DECIMALS)  # missing ones are infinite
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel())) for v in (own["vec"], found, d)]
        for a in range(0, len(d), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([grp] * len(d[a : a + 10_000]), pa.string()), pa.array(own["id"][a : a + 10_000]), *[x.slice(a, 10_000) for x in lists]], names=["grp", "id", "vec", "near", "d"])

    rows = rows.select(F.col("grp").cast("string").alias("grp"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    found = materialize(side_by_side(rows, near, "grp string, id long, vec array<double>, near array<long>, d array<double>"), "density-near")

    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, ids, d = _matrix(pdf["vec"]), pdf["id"].to_numpy(), np.stack(pdf["d"].to_numpy())
        near = np.stack(pdf["near"].to_numpy()).astype(np.int64)
        near = np.where(near >= 0, np.minimum(np.searchsorted(ids, near), len(ids) - 1), -1)
        cores = [d[:, c[2] - 1] for c in configs[pdf["grp"].iloc[0]]]
        tops = [_to_root(_first_tree(x, core, near), len(x)) for core in cores]
        return pd.DataFrame({"grp": pdf["grp"], "id": ids, "vec": pdf["vec"], "pos": np.arange(len(ids)), "core": list(np.stack(cores, axis=1)), "top": list(np.stack(tops, axis=1))})

    bounds = materialize(found.groupBy("grp").applyInPandas(reach, "grp string, id long, vec array<double>, pos long, core array<double>, top array<double>"), "density-bounds")

    def edges(grp, own, others):  # noqa: ANN001, ANN202
        names = [c[0] for c in configs[grp]]
        x, most = own["vec"], own["top"].max(axis=1)
        sq = np.einsum("ij,ij->i", x, x)
        x32 = x.astype(np.float32)
        kept = {name: [] for name in names}
        for other in others:
            y, most_y = other["vec"], other["top"].max(axis=1)
            ysq = np.einsum("ij,ij->i", y, y)
            y32, half = y.astype(np.float32), (ysq / 2).astype(np.float32)
            margin = 1e-5 * max(float(sq.max()), float(ysq.max()), 1e-30)
            floor = ((sq - (most + 2e-6) ** 2) / 2 - margin).astype(np.float32)
            buffer, mask = np.empty((256, len(y)), np.float32), np.empty((256, len(y)), bool)
            hits = []
            for a in range(0, len(x), 256):
                m = min(256, len(x) - a)
                s = np.matmul(x32[a : a + m], y32.T, out=buffer[:m])
                s -= half
                hit = np.flatnonzero(np.greater_equal(s, floor[a : a + m, None], out=mask[:m]))
                r, c = a + hit // len(y), hit % len(y)
                first = (most[r] > most_y[c]) | ((most[r] == most_y[c]) & (own["pos"][r] < other["pos"][c]))  # of its two ends one tells of an edge
                hits.append((r[first], c[first]))
            r, c = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
            dots = np.concatenate([np.einsum("ij,ij->i", x[r[a : a + 65536]], y[c[a : a + 65536]]) for a in range(0, len(r), 65536)] or [np.empty(0)])
            d = np.round(np.sqrt(np.maximum(sq[r] + ysq[c] - 2 * dots, 0)), DECIMALS)
            p, q = own["pos"][r], other["pos"][c]
            for at, name in enumerate(names):
                m = np.maximum(np.maximum(own["core"][r, at], other["core"][c, at]), d)
                keep = (m <= np.maximum(own["top"][r, at], other["top"][c, at])) & (p != q)
                kept[name].append(np.column_stack([np.minimum(p, q)[keep], np.maximum(p, q)[keep], m[keep]]))
                if sum(map(len, kept[name])) > 4 * len(x) + 1_000_000:
                    kept[name] = [forest(np.concatenate(kept[name]))]
        for name in names:
            e = forest(np.concatenate(kept[name])) if kept[name] else np.empty((0, 3))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(e), pa.string()), pa.array([grp] * len(e), pa.string()), pa.array(e[:, 0].astype(np.int64)), pa.array(e[:, 1].astype(np.int64)), pa.array(e[:, 2])], names=["name", "grp", "i", "j", "d"])

    passed = bounds.select("grp", "id", "vec", "pos", "core", "top")
    trees = side_by_side(passed, edges, "name string, grp string, i long, j long, d double")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        e = forest(pdf[["i", "j", "d"]].to_numpy(np.float64))
        grp, name = pdf["grp"].iloc[0], pdf["name"].iloc[0]
        _, least, _, method, epsilon = next(c for c in configs[grp] if c[0] == name)
        labels, strength = condensed_labels(e, len(e) + 1, least, method, epsilon)
        return pd.DataFrame({"name": name, "grp": grp, "pos": np.arange(len(labels)), "label": labels, "strength": strength})

    labelled = trees.groupBy("name", "grp").applyInPandas(label, "name string, grp string, pos long, label long, strength double")
    return bounds.select("grp", "pos", "id").join(labelled, ["grp", "pos"]).select(F.col("name").alias("grp"), "id", "label", "strength")


def density_clusters(df: DataFrame, group_col: str, id_col: str, vec_col: str, min_cluster_size: int = 8, min_samples: int = 3, method: str = "eom", epsilon: float = 0.0) -> DataFrame:
    """(grp, id, label, strength) of every row with a vector; labels count from 0 within each group, -1 is noise."""
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    large = {r["grp"]: r["count"] for r in rows.groupBy("grp").count().where(F.col("count") > MAX_ROWS).collect()}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = _matrix(pdf["vec"])
        core = core_distances(x, min_samples)
        labels, strength = condensed_labels(spanning_tree(x, core), len(x), min_cluster_size, method, epsilon)
        return pd.DataFrame({"grp": pdf["grp"], "id": pdf["id"], "label": labels, "strength": strength})

    whole = rows.where(~F.col("grp").isin(list(large))) if large else rows
    out = whole.groupBy("grp").applyInPandas(fit, "grp string, id long, label long, strength double")
    return out.unionByName(_divided(rows.where(F.col("grp").isin(list(large))), {g: [(g, min_cluster_size, min_samples, method, epsilon)] for g in large})) if large else out


#: Configurations (least cluster size, samples, selection, epsilon) tried for every topic, and those of some topics in their stead.
DEFAULT_CONFIGS = ((8, 3, "eom", 0.0), (10, 4, "eom", 0.0), (12, 6, "eom", 0.0), (15, 8, "eom", 0.0))
TOPIC_CONFIGS = {
    "politica": ((12, 4, "leaf", 0.0), (15, 6, "leaf", 0.0), (20, 8, "leaf", 0.02), (25, 10, "eom", 0.05)),
    "social": ((10, 3, "eom", 0.0), (15, 6, "leaf", 0.0), (20, 8, "leaf", 0.02), (25, 10, "eom", 0.05)),
    "international": ((10, 3, "eom", 0.0), (15, 6, "leaf", 0.0), (20, 8, "leaf", 0.02), (25, 10, "eom", 0.05)),
    "economie": ((8, 3, "eom", 0.0), (12, 4, "leaf", 0.0), (15, 6, "leaf", 0.02), (20, 8, "eom", 0.05)),
}


def selection_score(noise_percent: Column, largest: Column, size: Column, silhouette: Column, clusters: Column) -> Column:
    """How good a configuration is: little noise, no giant cluster, separated clusters, and several of them."""
    small = size < 1000
    s = (100 - noise_percent) - F.when(small, 120).otherwise(150) * largest / size + F.when(small, 30).otherwise(20) * F.coalesce(silhouette, F.lit(0.0)) + F.least(clusters, F.lit(100)) / 10
    return s - F.when(clusters < 3, 100).otherwise(0)


def sweep(df: DataFrame, group_col: str, id_col: str, vec_col: str) -> DataFrame:
    """(topic_group, configuration, its measures, selection_score, best): every configuration of every topic; of equal scores the first is best.

    Each pair of topic and configuration is a group of its own, so all of them run side by side. Measures are over all
    rows, not a sample; noise is left out of the silhouette, the two dispersion measures and graph_cohesion_real.
    """
    from pyspark.sql import Window

    from ..session import materialize
    from . import vectors

    spark = df.sparkSession
    names = [r[group_col] for r in df.select(group_col).distinct().collect()]
    configs = [(t, k, *c) for t in names for k, c in enumerate(TOPIC_CONFIGS.get(t, DEFAULT_CONFIGS))]
    table = spark.createDataFrame(configs, "topic string, number int, min_cluster_size int, min_samples int, cluster_selection_method string, cluster_selection_epsilon double")
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(group_col).alias("topic"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    large = {r["topic"] for r in rows.groupBy("topic").count().where(F.col("count") > MAX_ROWS).collect()}
    parts = []
    if large:  # one pass serves all configurations
        parts.append(_divided(rows.where(F.col("topic").isin(list(large))).withColumnRenamed("topic", "grp"), {t: [(f"{t}\u0001{k}", *c) for u, k, *c in configs if u == t] for t in large}))
    for c in sorted({c[2:] for c in configs if c[0] not in large}):  # a bounded number of configurations
        own = [(t, k) for t, k, *rest in configs if tuple(rest) == c and t not in large]
        of = spark.createDataFrame([(t, f"{t}\u0001{k}") for t, k in own], "topic string, grp string")
        parts.append(density_clusters(rows.join(F.broadcast(of), "topic"), "grp", "id", "vec", *c))  # at most one row a topic
    found = parts[0] if parts else None
    for p in parts[1:]:
        found = found.unionByName(p)
    if found is None:
        found = spark.createDataFrame([], "grp string, id long, label long, strength double")
    found = materialize(found.select("grp", "id", "label"), "sweep-labels")
    topic = F.substring_index("grp", "\u0001", 1).alias("topic")
    labelled = materialize(found.withColumn("topic", topic).join(rows, ["topic", "id"]).select("grp", "topic", "id", "label", "vec"), "sweep-points")
    real = labelled.where("label >= 0")
    counts = found.groupBy("grp", "label").agg(F.count("*").alias("n")).groupBy("grp").agg(
        F.sum("n").alias("topic_size"), F.count_if(F.col("label") >= 0).alias("num_clusters"), F.coalesce(F.sum(F.when(F.col("label") < 0, F.col("n"))), F.lit(0)).alias("num_noise"), F.coalesce(F.max(F.when(F.col("label") >= 0, F.col("n"))), F.lit(0)).alias("largest_real_cluster")
    )
    sil = vectors.silhouette_cosine(real, "grp", "id", "label", "vec").groupBy("grp").agg(F.avg("silhouette").alias("silhouette"))
    db = vectors.davies_bouldin(real, "grp", "label", "vec")
    ch = vectors.dispersion(real, "grp", "label", "vec").select("grp", "calinski_harabasz")
    edges = vectors.all_nearest(rows, "id", "vec", "topic").select(F.col("grp").alias("topic"), "id", "neighbour")
    keyed = spark.createDataFrame([(t, f"{t}\u0001{k}") for t, k, *_ in configs], "topic string, grp string")
    edges = materialize(edges, "sweep-edges").join(F.broadcast(keyed), "topic")  # four rows a topic
    cohesion = vectors.graph_cohesion(edges, found, ["grp"]).withColumnsRenamed({"cohesion": "graph_cohesion", "cohesion_real": "graph_cohesion_real"})
    out = counts.join(sil, "grp", "left").join(db, "grp", "left").join(ch, "grp", "left").join(cohesion, "grp", "left")
    several = F.col("num_clusters") > 1
    out = out.withColumns({"silhouette": F.when(several, F.col("silhouette")), "noise_percent": 100 * F.col("num_noise") / F.col("topic_size"), "topic": topic, "number": F.substring_index("grp", "\u0001", -1).cast("int")})
    out = out.join(F.broadcast(table), ["topic", "number"])  # the configurations
    out = out.withColumn("selection_score", selection_score(F.col("noise_percent"), F.col("largest_real_cluster"), F.col("topic_size"), F.col("silhouette"), F.col("num_clusters")))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("selection_score"), "number"))
    return out.withColumn("best", place == 1).select(
        F.col("topic").alias("topic_group"), "topic_size", "min_cluster_size", "min_samples", "cluster_selection_method", "cluster_selection_epsilon", "num_clusters", "num_noise", "noise_percent", "largest_real_cluster",
        "silhouette", "davies_bouldin", "calinski_harabasz", "graph_cohesion", "graph_cohesion_real", "selection_score", "best",
    )


def global_labels(local: DataFrame) -> DataFrame:
    """Labels made unique over groups: each group's labels start after those of all larger groups."""
    from pyspark.sql import Window

    per = local.groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n"), "grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a group
    return local.join(per.select("grp", before.alias("offset")), "grp").select("grp", "id", F.when(F.col("label") >= 0, F.col("label") + F.col("offset")).otherwise(-1).alias("cluster"), "strength")

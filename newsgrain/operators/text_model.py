"""TF-IDF as tables, and the models that Spark's own library fits on vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(df: DataFrame, id_col: str, text_col: str, keys: list[str]) -> DataFrame:
    """(keys, id, term, tf): words of two or more letters, digits or underscores, in any script, and pairs of neighbouring ones, with their counts."""
    words = F.regexp_extract_all(F.lower(F.coalesce("__t", F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    # documents are spread by id before they are opened: their terms are then counted where they stand
    w = df.select(*keys, F.col(id_col).alias("id"), F.col(text_col).alias("__t")).repartition(parts, *keys, "id").select(*keys, "id", words.alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return w.select(*keys, "id", F.explode(F.concat("w", pairs)).alias("term")).groupBy(*keys, "id", "term").agg(F.count("*").alias("tf"))


def tfidf(df: DataFrame, id_col: str, text_col: str, keys: list[str], min_df: int = 2, max_terms: int = 10_000) -> DataFrame:
    """(keys, id, term, weight): (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), unit length per document, within each group of `keys`.

    Terms of fewer than `min_df` documents are left out, then the `max_terms` most frequent are kept (a feature limit).
    """
    t = terms(df, id_col, text_col, keys)
    n = df.groupBy(*keys).agg(F.count("*").alias("n_docs"))
    freq = t.groupBy(*keys, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)
    top = Window.partitionBy(*keys).orderBy(F.desc("cf"), "term")
    freq = freq.withColumn("r", F.row_number().over(top)).where(F.col("r") <= max_terms)
    idf = freq.join(n, keys).select(*keys, "term", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    # idf has at most max_terms rows a group; the planner broadcasts it where it is small
    w = t.join(idf, [*keys, "term"]).withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys, "id")))
    return w.withColumn("weight", F.col("w") / length).select(*keys, "id", "term", "weight")


def top_terms(weights: DataFrame, labels: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Per cluster its k terms of greatest mean weight. labels: (keys, id, label)."""
    size = labels.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    mean = weights.join(labels, [*keys, "id"]).groupBy(*keys, "label", "term").agg(F.sum("weight").alias("s")).join(size, [*keys, "label"]).withColumn("mean_weight", F.round(F.col("s") / F.col("n"), 6))
    rank = F.row_number().over(Window.partitionBy(*keys, "label").orderBy(F.desc("mean_weight"), "term"))
    return mean.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select(*keys, "label", "rank", "term", "mean_weight")


def _features(df: DataFrame, vec_col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.where(F.col(vec_col).isNotNull()).withColumn("features", array_to_vector(F.col(vec_col).cast("array<double>")))


def reduce_dimensions(df: DataFrame, vec_col: str, k: int = 15) -> DataFrame:
    """`df` with `reduced`: the first k principal components. A linear stand-in for a neighbourhood embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    f = _features(df, vec_col)
    model = PCA(k=k, inputCol="features", outputCol="__pc").fit(f)
    return model.transform(f).withColumn("reduced", vector_to_array("__pc")).drop("features", "__pc")


def kmeans(df: DataFrame, vec_col: str, k: int, seeds: tuple[int, ...] = (42,), max_iter: int = 20) -> DataFrame:
    """`df` with `label`: the clustering of least cost over the seeds."""
    from pyspark.ml.clustering import KMeans

    f = _features(df, vec_col).cache()
    try:
        models = [KMeans(k=k, seed=s, maxIter=max_iter, featuresCol="features", predictionCol="label").fit(f) for s in seeds]
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        f.unpersist()
    return best.transform(_features(df, vec_col)).drop("features")


def bounded_k(requested: Column, size: Column) -> Column:
    """effective_k as an expression."""
    return F.greatest(F.lit(2), F.least(requested, size - 1))


def effective_k(requested: int, size: int, cap: int | None = None) -> int:
    """Clusters to ask for: at least 2, below the number of rows, and no more than the cap."""
    k = max(2, min(requested, size - 1))
    return min(k, cap) if cap else k


#: Rows from which a topic has fewer initialisations, and from which it is fitted by Spark's own k-means and not in one task.
LARGE_TOPIC, DIVIDED_TOPIC = 50_000, 250_000
SEEDS, SEEDS_LARGE, ITERATIONS = tuple(range(42, 52)), tuple(range(42, 47)), 300
#: Initialisations that one task takes, so that the vectors travel once for them.
SEEDS_A_TASK = 2


def _starts(x, y, k: int, rng):  # noqa: ANN001, ANN202
    """Positions of k rows of x by k-means++; y: the rows in single precision, enough for the chances."""
    import numpy as np

    sq = np.einsum("ij,ij->i", x, x)
    chosen = [int(rng.integers(len(x)))]
    d = np.full(len(x), np.inf)
    for _ in range(k - 1):
        at = chosen[-1]
        np.minimum(d, np.maximum(sq + sq[at] - 2 * (y @ y[at]), 0), out=d)
        d[at] = 0
        total = d.cumsum()
        chosen.append(min(int(np.searchsorted(total, rng.random() * total[-1], side="right")), len(x) - 1) if total[-1] > 0 else int(rng.integers(len(x))))
    return chosen


def _two_nearest(x, y, centres, margin: float):  # noqa: ANN001, ANN202
    """(nearest centre of every row, the first of equal ones; |c|^2 / 2 - x c of the next one, within the margin).

    y: the rows in single precision, in which the products are taken; rows whose two nearest are closer than the margin
    are taken again in double.
    """
    import numpy as np

    half = np.einsum("ij,ij->i", centres, centres) / 2
    c, h = centres.astype(np.float32), half.astype(np.float32)
    near, second = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for a in range(0, len(x), 512):
        s = h - y[a : a + 512] @ c.T
        rows, best = np.arange(len(s)), s.argmin(axis=1)
        low = s[rows, best]
        s[rows, best] = np.inf
        other = s.min(axis=1)
        close = np.flatnonzero(other - low < margin)
        if len(close):
            s[rows, best] = low
            best[close] = (half - x[a + close] @ centres.T).argmin(axis=1)
            s[rows, best] = np.inf
            other = s.min(axis=1)
        near[a : a + 512], second[a : a + 512] = best, other
    return near, second


def lloyd(x, k: int, seed: int, max_iter: int = ITERATIONS):  # noqa: ANN001, ANN201
    """(label of every row of x, cost) of k-means from one k-means++ start.

    Every row goes to its nearest centre, as if all were compared in each round. But a row is compared only if its own
    centre may no longer be the nearest, by a bound on its distance to all others less how far those moved, and while its
    own centre stands, only with the centres that moved.
    """
    import numpy as np

    y = x.astype(np.float32)
    centres = x[_starts(x, y, k, np.random.default_rng(seed))].copy()
    sq = np.einsum("ij,ij->i", x, x)
    margin = 8e-6 * max(float(sq.max(initial=0)), 1e-30)

    def own(rows):  # noqa: ANN001, ANN202
        gap = x[rows] - centres[labels[rows]]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def least(rows, second):  # noqa: ANN001, ANN202
        return np.sqrt(np.maximum(sq[rows] + 2 * (second - margin), 0))

    labels, second = _two_nearest(x, y, centres, margin)
    bound, mine = least(slice(None), second), own(slice(None))
    moved = np.ones(k, dtype=bool)
    for _ in range(max_iter - 1):
        rows = np.flatnonzero(moved[labels])
        order = rows[np.argsort(labels[rows], kind="stable")]
        used, first = np.unique(labels[order], return_index=True)
        fresh = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(order)))[:, None]
        drift = np.zeros(k)
        drift[used] = np.sqrt(((fresh - centres[used]) ** 2).sum(axis=1))
        centres[used] = fresh
        mine[rows] = own(rows)
        before, (lower, upper) = bound, np.sort(np.append(drift, 0))[-2:]
        bound = bound - np.where(drift[labels] == upper, lower, upper)
        todo = np.flatnonzero(mine >= bound - 1e-9)
        changed = np.zeros(k, dtype=bool)
        far, still, m = todo[moved[labels[todo]]], todo[~moved[labels[todo]]], np.flatnonzero(moved)
        if len(far):
            new, second = _two_nearest(x[far], y[far], centres, margin)
            other = far[new != labels[far]]
            changed[labels[other]] = True
            labels[far], bound[far] = new, least(far, second)
            changed[labels[other]] = True
            mine[other] = own(other)
        if len(still):
            new, second = _two_nearest(x[still], y[still], centres[m], margin)
            new, rest = m[new], np.minimum(before[still], least(still, second))
            gap = x[still] - centres[new]
            d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            better = (d < mine[still]) | ((d == mine[still]) & (new < labels[still]))
            bound[still] = np.where(better, np.minimum(rest, mine[still]), np.minimum(before[still], d)) - 1e-9
            other = still[better]
            changed[labels[other]] = True
            labels[other], mine[other] = new[better], d[better]
            changed[labels[other]] = True
        moved = changed
        if not changed.any():
            break
    return labels, float((mine * mine).sum())


def minibatch(x, k: int, seed: int, max_iter: int = 80):  # noqa: ANN001, ANN201
    """(label of every row of x, cost) of mini-batch k-means from one k-means++ start; stops after ten batches without a better cost."""
    import numpy as np

    rng = np.random.default_rng(seed)
    y, margin = x.astype(np.float32), 8e-6 * max(float((x * x).sum(axis=1).max(initial=0)), 1e-30)
    size = min(len(x), max(2048, 16 * k))
    start = x[rng.choice(len(x), min(len(x), max(4096, 4 * k)), replace=False)]
    labels, _ = lloyd(start, min(k, len(start)), seed, 1)
    centres = np.stack([start[labels == c].mean(axis=0) if (labels == c).any() else start[rng.integers(len(start))] for c in range(min(k, len(start)))])
    seen = np.zeros(len(centres))
    best, waited = np.inf, 0
    for _ in range(max_iter):
        drawn = rng.choice(len(x), size, replace=False)
        part = x[drawn]
        near, _ = _two_nearest(part, y[drawn], centres, margin)
        gap = part - centres[near]
        cost = float((gap * gap).sum(axis=1).mean())
        order = np.argsort(near, kind="stable")
        used, first, n = np.unique(near[order], return_index=True, return_counts=True)
        seen[used] += n
        centres[used] += (np.add.reduceat(part[order], first, axis=0) - n[:, None] * centres[used]) / seen[used, None]
        best, waited = (cost, 0) if cost < best - 1e-4 * abs(best) or best == np.inf else (best, waited + 1)
        if waited >= 10:
            break
    labels, _ = _two_nearest(x, y, centres, margin)
    gap = x - centres[labels]
    return labels, float((gap * gap).sum())


#: Components of the reduced term space, rounds of the iteration, and topics whose bases travel with one pass.
COMPONENTS, SPARE, ROUNDS, TOPICS_A_PASS = 100, 10, 4, 16


def truncated_svd(weights: DataFrame, key: str, k: int = COMPONENTS) -> DataFrame:
    """(key, id, reduced): documents in the space of the first k singular directions of each group's TF-IDF matrix.

    Subspace iteration on the matrix of term products: every pass multiplies it with a block of k + SPARE directions, task
    by task over the documents, and the tasks' sums are added before they reach the driver. The directions are bounded by
    the terms of a group (a feature limit) and by TOPICS_A_PASS groups a pass. Groups of fewer than three documents or
    terms have no such space and are left out. weights: (key, id, term, weight).
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from ..session import materialize

    spark = weights.sparkSession
    weights = materialize(weights, "term-weights")
    terms = weights.select(key, "term").distinct().withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("term")) - 1)  # at most the feature limit a group
    docs = weights.join(terms, [key, "term"]).groupBy(key, "id").agg(F.collect_list(F.struct("at", "weight")).alias("x"))
    # a task holds the documents of few groups, so that it adds up few matrices
    docs = docs.select(F.col(key).alias("grp"), "id", F.col("x.at").alias("at"), F.col("x.weight").alias("w")).repartitionByRange("grp", "id")
    docs = materialize(docs, "term-rows")
    sizes = {r["grp"]: (r["n"], r["m"]) for r in docs.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.array_max("at") + 1).alias("m")).collect()}
    wide = {g: min(k, n - 1, m - 1) for g, (n, m) in sizes.items()}
    groups = sorted((g for g in sizes if wide[g] >= 2), key=str)
    id_type = docs.schema["id"].dataType.simpleString()

    def chunks_of(batch: pa.RecordBatch):  # noqa: ANN202
        """(group, its first row, places and weights of the terms of some of its neighbouring documents, where each begins)."""
        at, w = batch.column(2), batch.column(3)
        ends = at.offsets.to_numpy().astype(np.int64)
        places, weights = at.values.to_numpy(), w.values.to_numpy()
        grp = batch.column(0).to_pylist()
        a = 0
        while a < len(grp):
            b = a + 1
            while b < len(grp) and b < a + 256 and grp[b] == grp[a]:
                b += 1
            own = slice(ends[a], ends[b])
            yield grp[a], a, places[own].astype(np.int64), weights[own], ends[a : b + 1] - ends[a]
            a = b

    def times(basis, at, w, ends):  # noqa: ANN001, ANN202
        return np.add.reduceat(w[:, None] * basis[at], ends[:-1], axis=0)

    def product(sent):  # noqa: ANN001, ANN202
        def work(batches):  # noqa: ANN001, ANN202
            total: dict = {}
            for batch in batches:
                for g, _, at, w, ends in chunks_of(batch):
                    basis = sent.value.get(g)
                    if basis is None:
                        continue
                    if g not in total:
                        total[g] = np.zeros(basis.shape)
                    by_term = np.argsort(at, kind="stable")
                    used, first = np.unique(at[by_term], return_index=True)
                    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[by_term]
                    total[g][used] += np.add.reduceat(w[by_term, None] * times(basis, at, w, ends)[doc], first, axis=0)
            for g, z in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.string()), pa.array([z.astype(np.float32).tobytes()], pa.binary())], names=["grp", "z"])

        return work

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(z, np.float32).astype(np.float64) for z in pdf["z"])
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "z": [total.astype(np.float32).tobytes()]})

    def projected(sent):  # noqa: ANN001, ANN202
        def work(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                for g, a, at, w, ends in chunks_of(batch):
                    if g in sent.value:
                        found, n = times(sent.value[g], at, w, ends), len(ends) - 1
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), lists], names=["grp", "id", "reduced"])

        return work

    out = spark.createDataFrame([], f"grp string, id {id_type}, reduced array<double>")
    rng = np.random.default_rng(42)
    for lo in range(0, len(groups), TOPICS_A_PASS):
        basis = {g: np.linalg.qr(rng.normal(size=(sizes[g][1], min(wide[g] + SPARE, sizes[g][1]))))[0] for g in groups[lo : lo + TOPICS_A_PASS]}
        own = docs.where(F.col("grp").isin(list(basis)))
        for turn in range(ROUNDS):
            sent = spark.sparkContext.broadcast(basis)
            sums = own.mapInArrow(product(sent), "grp string, z binary").groupBy("grp").applyInPandas(added, "grp string, z binary").collect()
            fresh = {r["grp"]: np.frombuffer(bytes(r["z"]), np.float32).astype(np.float64).reshape(basis[r["grp"]].shape) for r in sums}
            if turn + 1 < ROUNDS:
                basis = {g: np.linalg.qr(z)[0] for g, z in fresh.items()}
            else:  # the directions within the block
                for g, z in fresh.items():
                    values, vectors = np.linalg.eigh(basis[g].T @ z)
                    basis[g] = basis[g] @ vectors[:, np.argsort(-values)[: wide[g]]]
            sent.unpersist()
        out = out.unionByName(own.mapInArrow(projected(spark.sparkContext.broadcast(basis)), f"grp string, id {id_type}, reduced array<double>"))
    return out.withColumnRenamed("grp", key)


def kmeans_by_topic(df: DataFrame, group_col: str, id_col: str, vec_col: str, requested: DataFrame, default_k: int = 10, batches: bool = False) -> DataFrame:
    """(grp, id, label): k-means of every group apart, the one of least cost over the seeds.

    requested: (grp, k), the clusters asked for, bounded by effective_k; groups it lacks ask for `default_k`. A group up
    to DIVIDED_TOPIC rows is fitted in tasks of SEEDS_A_TASK starts, a larger one by Spark's own k-means. batches: by
    mini-batches, with five starts.
    """
    import numpy as np
    import pandas as pd

    from ..session import materialize

    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(group_col).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.join(F.broadcast(requested.select("grp", F.col("k").cast("long").alias("k"))), "grp", "left").withColumn("k", F.coalesce("k", F.lit(default_k).cast("long")))
    large = rows.groupBy("grp").agg(F.count("*").alias("n"), F.max("k").alias("k")).where(F.col("n") >= min(LARGE_TOPIC, DIVIDED_TOPIC)).collect()
    divided = [r for r in large if r["n"] >= DIVIDED_TOPIC]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        fitted = minibatch if batches else lloyd
        (labels, cost), seed = min(((fitted(x, min(effective_k(int(pdf["k"].iloc[0]), len(x)), len(x)), int(s)), int(s)) for s in pdf["seeds"].iloc[0]), key=lambda f: (f[0][1], f[1]))
        return pd.DataFrame({"grp": pdf["grp"], "id": pdf["id"], "label": labels, "seed": seed, "cost": cost})

    tasks = lambda seeds: F.array(*[F.array(*[F.lit(s) for s in seeds[a : a + SEEDS_A_TASK]]) for a in range(0, len(seeds), SEEDS_A_TASK)])
    few = F.lit(batches) | F.col("grp").isin([r["grp"] for r in large])
    whole = rows.where(~F.col("grp").isin([r["grp"] for r in divided])).withColumn("seeds", F.explode(F.when(few, tasks(SEEDS_LARGE)).otherwise(tasks(SEEDS))))
    fits = materialize(whole.repartition(len(SEEDS) * 12, "grp", "seeds").groupBy("grp", "seeds").applyInPandas(fit, "grp string, id long, label long, seed int, cost double"), "kmeans-fits")
    best = fits.groupBy("grp").agg(F.min(F.struct("cost", "seed")).alias("b")).select("grp", F.col("b.seed").alias("seed"))
    out = fits.join(F.broadcast(best), ["grp", "seed"]).select("grp", "id", "label")
    for r in divided:
        one = kmeans(rows.where(F.col("grp") == r["grp"]), "vec", effective_k(r["k"], r["n"]), SEEDS_LARGE, ITERATIONS)
        out = out.unionByName(one.select("grp", "id", F.col("label").cast("long").alias("label")))
    return out

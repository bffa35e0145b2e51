"""Exact vector operators: neighbours by blocks, and cluster quality measures in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, summed in array order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of length 1; null for null or zero vectors."""
    # the norm as an array beside the elements, so that it is computed once a row and not once an element
    return F.when(norm(a) > 0, F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: x.cast("double") / n))


def vector_sums(df: DataFrame, keys: list[str], vec: str, weight: str | None = None) -> DataFrame:
    """(keys, n, sums): element-wise sums of vectors (times `weight`), aggregated on both sides of the shuffle."""
    x = F.col("x").cast("double") * F.col(weight) if weight else F.col("x").cast("double")
    at = df.select(*keys, *([weight] if weight else []), F.posexplode(vec).alias("k", "x")).groupBy(*keys, "k").agg(F.sum(x).alias("x"), F.count("*").alias("n"))
    return at.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("sums"))


BLOCK = 1024


def _blocks(df: DataFrame, prefix: str) -> DataFrame:
    """(grp, <prefix>ids, <prefix>vecs): the rows of each group in blocks of about BLOCK rows."""
    n = df.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cut = df.join(n, "grp").groupBy("grp", F.pmod(F.xxhash64("id"), "blocks").alias("block"))
    return cut.agg(F.collect_list(F.struct("id", "vec")).alias("rows")).select("grp", F.col("rows.id").alias(f"{prefix}ids"), F.col("rows.vec").alias(f"{prefix}vecs"))


def exact_knn(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, group_col: str, k: int = 10) -> DataFrame:
    """(group, id, neighbour, rank, score): the k nearest of each query row by inner product, itself left out.

    A stated query set against all rows of its group, block by block: a pair of blocks is one matrix product, and only
    its k best of each query go on. Vectors must not be null and of one length; ties go to the smaller id.
    """
    pick = lambda x: x.select(F.col(group_col).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    pairs = _blocks(pick(queries), "q").join(_blocks(pick(df), "c"), "grp")

    def products(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(batch.schema.get_field_index(name))[row].values  # noqa: B023, E731
                qi, ci = get("qids").to_numpy(), get("cids").to_numpy()
                q = get("qvecs").flatten().to_numpy(zero_copy_only=False).reshape(len(qi), -1)
                c = get("cvecs").flatten().to_numpy(zero_copy_only=False).reshape(len(ci), -1)
                s = np.where(qi[:, None] == ci[None, :], -np.inf, np.round(q @ c.T, 6))
                m = min(k, len(ci))
                kth = np.partition(s, len(ci) - m, axis=1)[:, len(ci) - m]
                x, y = np.nonzero((s >= kth[:, None]) & np.isfinite(s))
                grp = batch.column(0)[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([grp] * len(x), pa.string()), pa.array(qi[x]), pa.array(ci[y]), pa.array(s[x, y])], names=["grp", "id", "neighbour", "score"])

    best = pairs.select(F.col("grp").cast("string").alias("grp"), "qids", "qvecs", "cids", "cvecs").mapInArrow(products, "grp string, id long, neighbour long, score double")
    rank = F.row_number().over(Window.partitionBy("grp", "id").orderBy(F.desc("score"), "neighbour"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


#: Pairs of rows that are work for one task, and tasks that the rows of a group travel to at most, unless one would hold over CELL_ROWS.
PAIRS_A_CELL, CELLS, CELL_ROWS = 500_000_000, 6, 65_536


def side_by_side(df: DataFrame, kernel, schema: str) -> DataFrame:  # noqa: ANN001
    """The rows of every group beside all rows of the group, in tasks that hold some of them and see the others pass.

    df: (grp, id, vec, ...) without nulls. kernel(grp, own, others) gets the columns of a task's own rows as arrays (vec
    as a matrix, lists as Arrow) and an iterator over those of all rows of the group, and yields record batches.
    """
    sizes = df.where("grp is not null").groupBy("grp").count().collect()
    cells, first = [], 0
    for r in sorted(sizes, key=lambda r: (-r["count"], str(r["grp"]))):
        n = max(1, min(CELLS, -(-r["count"] ** 2 // PAIRS_A_CELL)), -(-r["count"] // CELL_ROWS))
        cells.append((r["grp"], first, n))
        first += n
    spark = df.sparkSession
    named = F.broadcast(spark.createDataFrame(cells, "grp string, first int, cells int"))  # one row a group
    keyed = df.join(named, "grp")
    names = df.columns
    own = keyed.select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("cells"))).cast("int").alias("cell"), F.lit(0).alias("side"), *names)
    others = keyed.select(F.explode(F.sequence("first", F.col("first") + F.col("cells") - 1)).alias("cell"), F.lit(1).alias("side"), *names)
    parts = max(1, min(first, 1000))

    def arrays(batch):  # noqa: ANN001, ANN202
        out = {}
        for name in names[1:]:
            c = batch.column(batch.schema.get_field_index(name))
            out[name] = c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if str(c.type).startswith("list") else c.to_numpy(zero_copy_only=False)
        return out

    def work(batches):  # noqa: ANN001, ANN202
        import itertools

        import numpy as np

        def pieces():  # noqa: ANN202
            for batch in batches:
                cell, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
                for a, b in itertools.pairwise([0, *cuts.tolist(), len(cell)]):
                    if b > a:
                        yield int(cell[a]), int(side[a]), batch.slice(a, b - a)

        for _, of in itertools.groupby(pieces(), key=lambda x: x[0]):
            mine, grp = [], None
            for side, run in itertools.groupby(of, key=lambda x: x[1]):
                if side == 0:
                    for _, _, batch in run:
                        grp = batch.column(2)[0].as_py()
                        mine.append(arrays(batch))
                elif mine:
                    held = {name: np.concatenate([m[name] for m in mine]) for name in mine[0]}
                    mine = []
                    yield from kernel(grp, held, (arrays(batch) for _, _, batch in run))

    return own.unionByName(others).repartitionById(parts, F.col("cell") % parts).sortWithinPartitions("cell", "side").mapInArrow(work, schema)


def nearest_rows(own: dict, others, k: int, distance: bool = False):  # noqa: ANN001, ANN201
    """(ids, values), k a row, of the rows nearest to each own one, best first; fewer than k have id -1.

    By inner product rounded to six decimals, the row itself left out, ties to the smaller id; or by distance, the row
    itself among them. Products are taken in single precision, and whatever comes near the best k again in double.
    """
    import numpy as np

    x, ids = own["vec"].astype(np.float64), own["id"]
    n, lift = len(x), 1 if distance else 0
    sq = np.einsum("ij,ij->i", x, x)
    x32 = np.hstack([x, np.ones((n, lift))]).astype(np.float32)
    best, found = np.full((n, k), -np.inf), np.full((n, k), -1, dtype=np.int64)
    floor, seen = np.full(n, -np.inf, dtype=np.float32), 0  # what a product must reach; rows that went by
    for other in others:
        y, names = other["vec"].astype(np.float64), other["id"]
        ysq = np.einsum("ij,ij->i", y, y)
        y32 = np.hstack([y, -ysq[:, None] / 2] if distance else [y]).astype(np.float32)
        margin = 1e-5 * max(float(sq.max()), float(ysq.max()), 1e-30) + (0 if distance else 1e-6)
        buffer, mask = np.empty((256, len(y)), np.float32), np.empty((256, len(y)), bool)
        rows, cols = [], []
        for a in range(0, n, 256):
            m = min(256, n - a)
            s = np.matmul(x32[a : a + m], y32.T, out=buffer[:m])
            low = floor[a : a + m]
            if len(y) > max(seen, k + 1):  # more rows than went before them
                np.maximum(low, np.partition(s, len(y) - k - 1, axis=1)[:, len(y) - k - 1] - np.float32(margin), out=low)
            hit = np.flatnonzero(np.greater_equal(s, low[:, None], out=mask[:m]))
            rows.append(a + hit // len(y))
            cols.append(hit % len(y))
        seen += len(y)
        r, c = np.concatenate(rows), np.concatenate(cols)
        dots = np.concatenate([np.einsum("ij,ij->i", x[r[a : a + 65536]], y[c[a : a + 65536]]) for a in range(0, len(r), 65536)] or [np.empty(0)])
        value = -np.maximum(sq[r] + ysq[c] - 2 * dots, 0) if distance else np.round(dots, 6)
        if not distance:
            keep = names[c] != ids[r]
            r, c, value = r[keep], c[keep], value[keep]
        held = np.repeat(np.arange(n), k)
        r, value, who = np.concatenate([held, r]), np.concatenate([best.ravel(), value]), np.concatenate([found.ravel(), names[c]])
        order = np.lexsort((who, -value, r))
        starts = np.searchsorted(r[order], np.arange(n))
        pick = order[(starts[:, None] + np.arange(k)).ravel()]
        best, found = value[pick].reshape(n, k), who[pick].reshape(n, k)
        last = best[:, -1]
        np.maximum(floor, ((last + sq) / 2 if distance else last).astype(np.float32) - np.float32(margin), out=floor)
    return found, best


def all_nearest(df: DataFrame, id_col: str, vec_col: str, group_col: str, k: int = 10) -> DataFrame:
    """exact_knn of all rows: (grp, id, neighbour, rank, score)."""

    def kernel(grp, own, others):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        found, score = nearest_rows(own, others, k)
        i, rank = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array([grp] * len(i), pa.string()), pa.array(own["id"][i]), pa.array(found[i, rank]), pa.array(rank + 1), pa.array(score[i, rank])], names=["grp", "id", "neighbour", "rank", "score"])

    rows = df.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return side_by_side(rows, kernel, "grp string, id long, neighbour long, rank long, score double")


def intra_cluster_cosine(df: DataFrame, keys: list[str], vec_col: str) -> DataFrame:
    """Mean cosine over all pairs of a cluster without forming pairs: (|sum of unit vectors|^2 - n) / (n (n - 1))."""
    sums = vector_sums(df.withColumn("__n", norm(F.col(vec_col))).where("__n > 0").withColumn("__w", 1 / F.col("__n")), keys, vec_col, "__w")
    n = F.col("n")
    return sums.select(*keys, "n", F.when(n > 1, (dot(F.col("sums"), F.col("sums")) - n) / (n * (n - 1))).alias("mean_cosine"))


def _pair_blocks(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Rows of `left` and `right` of each group in blocks of about BLOCK rows, every pair of blocks one row (l, r: arrays of structs)."""

    def blocks(df: DataFrame, out: str) -> DataFrame:
        n = df.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        cut = df.join(n, "grp").groupBy("grp", F.pmod(F.xxhash64(by), "blocks").alias("block"))
        return cut.agg(F.collect_list(F.struct(*[c for c in df.columns if c != "grp"])).alias(out)).select("grp", out)

    return blocks(left, "l").join(blocks(right, "r"), "grp").select("grp", "l", "r")


def _matrix(structs, name: str):  # noqa: ANN001, ANN202
    """A field of an array of structs as numpy; lists of one length as a matrix."""
    field = structs.field(name)
    if hasattr(field, "flatten") and str(field.type).startswith("list"):
        return field.flatten().to_numpy(zero_copy_only=False).reshape(len(field), -1)
    return field.to_numpy(zero_copy_only=False)


def silhouette_cosine(df: DataFrame, group_col: str, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(grp, id, label, silhouette) by cosine distance within a group.

    Distances to clusters come from their vector sums, not from pairs of points, and are taken block by block as matrix
    products of points and sums, of which a point's nearest other cluster alone goes on.
    """
    u = df.select(F.col(group_col).alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), unit(F.col(vec_col)).alias("u")).where("u is not null")
    sums = vector_sums(u, ["grp", "label"], "u")

    def products(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                points, clusters = (batch.column(batch.schema.get_field_index(c))[row].values for c in ("l", "r"))
                label, other, n = _matrix(points, "label"), _matrix(clusters, "label"), _matrix(clusters, "n")
                s = _matrix(points, "u") @ _matrix(clusters, "sums").T
                own = label[:, None] == other[None, :]
                d = np.where(own, (n - s) / np.maximum(n - 1, 1), 1 - s / n)
                near = np.where(own, np.inf, d).min(axis=1)
                mine = np.where(own, d, -np.inf).max(axis=1)
                size = np.where(own, n, 0).max(axis=1)
                grp = pa.array([batch.column(0)[row].as_py()] * len(label), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [grp, pa.array(_matrix(points, "id")), pa.array(label), pa.array(mine, mask=~np.isfinite(mine)), pa.array(near, mask=~np.isfinite(near)), pa.array(size)], names=["grp", "id", "label", "a", "b", "n"]
                )

    pairs = _pair_blocks(u.withColumn("grp", F.col("grp").cast("string")), sums.select(F.col("grp").cast("string").alias("grp"), "label", F.col("n").cast("long").alias("n"), "sums"), "label")
    best = pairs.mapInArrow(products, "grp string, id long, label long, a double, b double, n long").groupBy("grp", "id", "label").agg(F.max("a").alias("a"), F.min("b").alias("b"), F.max("n").alias("n"))
    return best.select("grp", "id", "label", F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0).alias("silhouette"))


def dispersion(df: DataFrame, group_col: str, label_col: str, vec_col: str) -> DataFrame:
    """Per group (k, n, within, between, calinski_harabasz) from sums of vectors and of squared lengths."""
    lab = df.select(F.col(group_col).alias("grp"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    sq = lab.groupBy("grp", "label").agg(F.sum(dot(F.col("v"), F.col("v"))).alias("sq"))
    parts = vector_sums(lab, ["grp", "label"], "v").join(sq, ["grp", "label"])
    agg = parts.withColumn("c", dot(F.col("sums"), F.col("sums")) / F.col("n")).groupBy("grp").agg(F.count("*").alias("k"), F.sum(F.col("sq") - F.col("c")).alias("within"), F.sum("c").alias("c"))
    total = vector_sums(lab, ["grp"], "v")
    one = agg.join(total, "grp").withColumn("between", F.col("c") - dot(F.col("sums"), F.col("sums")) / F.col("n"))
    score = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return one.select("grp", "k", "n", "within", "between", F.when((F.col("k") > 1) & (F.col("within") > 0), score).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, group_col: str, label_col: str, vec_col: str) -> DataFrame:
    """Per group (davies_bouldin): mean over clusters of the worst ratio of scatters to centroid distance."""
    lab = df.select(F.col(group_col).alias("grp"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    cent = vector_sums(lab, ["grp", "label"], "v").select("grp", "label", F.transform("sums", lambda x: x / F.col("n")).alias("c"))
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))
    scatter = lab.join(cent, ["grp", "label"]).groupBy("grp", "label").agg(F.avg(gap(F.transform("v", lambda x: x.cast("double")), F.col("c"))).alias("s"))
    own = cent.join(scatter, ["grp", "label"]).select(F.col("grp").cast("string").alias("grp"), "label", "c", "s")

    def ratios(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (batch.column(batch.schema.get_field_index(c))[row].values for c in ("l", "r"))
                a, b, la, lb = _matrix(x, "c"), _matrix(y, "c"), _matrix(x, "label"), _matrix(y, "label")
                gap = np.sqrt(np.stack([((b - v) ** 2).sum(axis=1) for v in a]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = (_matrix(x, "s")[:, None] + _matrix(y, "s")[None, :]) / gap
                r[(la[:, None] == lb[None, :]) | np.isnan(r)] = -1
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(la), pa.string()), pa.array(la), pa.array(r.max(axis=1))], names=["grp", "label", "r"])

    worst = _pair_blocks(own, own, "label").mapInArrow(ratios, f"grp string, label {own.schema['label'].dataType.simpleString()}, r double").where("r >= 0").groupBy("grp", "label").agg(F.max("r").alias("r"))
    return worst.groupBy("grp").agg(F.avg("r").alias("davies_bouldin"))


def graph_cohesion(edges: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, cohesion, cohesion_real): mean share of a point's neighbours that carry its label; all points, and without noise.

    edges: (grp, id, neighbour); labels: (grp, id, label); keys: ["grp"] for a row a group, none for one row.
    """
    a, b = labels.select("grp", "id", F.col("label").alias("la")), labels.select("grp", F.col("id").alias("neighbour"), F.col("label").alias("lb"))
    per = edges.join(a, ["grp", "id"]).join(b, ["grp", "neighbour"]).groupBy("grp", "id", "la").agg(F.avg((F.col("la") == F.col("lb")).cast("double")).alias("s"))
    return per.groupBy(*(keys or [])).agg(F.avg("s").alias("cohesion"), F.avg(F.when(F.col("la") != -1, F.col("s"))).alias("cohesion_real"))


def nearest_representatives(reps: DataFrame, k: int = 6) -> DataFrame:
    """Per cluster its k nearest clusters of the topic by position of their representatives, block by block; similarity 1 / (1 + distance).

    reps: (topic_group, cluster, x, y), one row a cluster.
    """
    points = reps.select(F.col("topic_group").alias("grp"), F.col("cluster").cast("long").alias("cluster"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def near(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                p, q = (batch.column(batch.schema.get_field_index(c))[row].values for c in ("l", "r"))
                a, b = _matrix(p, "cluster"), _matrix(q, "cluster")
                dx, dy = _matrix(p, "x")[:, None] - _matrix(q, "x")[None, :], _matrix(p, "y")[:, None] - _matrix(q, "y")[None, :]
                d = np.where(a[:, None] == b[None, :], np.inf, np.sqrt(dx * dx + dy * dy))
                m = min(k, len(b))
                i, j = np.nonzero((d <= np.partition(d, m - 1, axis=1)[:, m - 1 : m]) & np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[row].as_py()] * len(i), pa.string()), pa.array(a[i]), pa.array(b[j]), pa.array(d[i, j])], names=["topic_group", "cluster", "other", "distance"])

    best = _pair_blocks(points, points, "cluster").mapInArrow(near, "topic_group string, cluster long, other long, distance double")
    rank = F.row_number().over(Window.partitionBy("topic_group", "cluster").orderBy("distance", "other"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("topic_group", "cluster", "other", "rank", F.round(1 / (1 + F.col("distance")), 6).alias("similarity"))

"""The k most similar vectors of every vector.

Method: permutation index. Pivots are drawn from the collection by hash. A vector is represented by its nearest pivots
in order; it is posted, with that permutation, in the inverted files of the first `POSTED` of them. Vectors that meet in
an inverted file are ranked by the footrule distance of their permutations, and those within `FOOTRULE` are reranked by
exact cosine. A pair that meets in several files is taken in one of them only. Vectors are compared within a group (a
topic) only.

Copies of one vector are one class: the index holds one of them, and the answer lists are opened again at the end.

Size: one vector in `ROWS_A_PIVOT` is a pivot, in every group and at every size, so files do not grow with the rows. To
keep the search for a vector's nearest pivots bounded, a group of more than `REGION_ROWS` vectors is divided into regions
around as many coarse pivots (a bounded sample, broadcast), a vector belongs to the `SPREAD` regions nearest to it, and
each region is a permutation index of its own. Pivots travel to the rows of their region, in front of them, and are
never gathered. An inverted file longer than `HOT_FILE` is divided into blocks and the pairs of blocks are joined apart.
Every vector is indexed and every vector is a query.

Defined cases: null vectors, vectors of another dimension, with null or NaN elements or all zero are neither queries nor
answers; lengths do not matter; a null group is a group of its own; ties go to the smaller id; of rows that repeat a
group and id the one with the least hash of its vector counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .arrowio import column, hash_sample, int64
from .fold import mix

ROWS_A_PIVOT = 64
#: Vectors of a region, so that it has some 4 000 pivots; regions a vector of a larger group belongs to; coarse pivots at most.
REGION_ROWS, SPREAD, MAX_REGIONS = 262_144, 4, 65_536
#: Rows of a region that one task posts.
CHUNK_ROWS = 16_384
#: Sizes of groups and regions up to this number of rows travel as a broadcast; beyond it Spark joins them by shuffle.
BROADCAST_SIZES = 200_000
PREFIX = 8
POSTED = 6
FOOTRULE = 64
HOT_FILE = 8192
TILE = 2048


def _normalised(dim: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = column(batch, "vec")
            n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(vec), -1))
            at = np.flatnonzero(n == dim)
            x = pa.compute.list_flatten(vec.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.sqrt((x * x).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            at, x = at[ok], x[ok] / norm[ok, None]
            if not len(at):
                continue
            grid = np.round(x * 1e6).astype(np.int64).astype(np.uint64)
            cls = np.zeros(len(at), dtype=np.uint64)
            for k in range(dim):
                cls = mix(cls * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
            flat = pa.array(np.ascontiguousarray(x, dtype=np.float32).ravel())
            offsets = pa.array(np.arange(0, len(at) * dim + 1, dim), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "grp").take(pa.array(at)), column(batch, "id").take(pa.array(at)), int64(cls), pa.ListArray.from_arrays(offsets, flat)],
                names=["grp", "id", "cls", "vec"],
            )

    return work


def _stacked(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:  # noqa: ANN001
    """Rows of equal length, held as binary, as one matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return np.frombuffer(b"".join(whole.to_pylist()), dtype=dtype).reshape(len(whole), -1)


def _in_regions(coarse, spread: int):
    """Every vector with the regions it belongs to; coarse: {group: matrix of coarse pivots}, broadcast."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, TILE):
                batch = whole.slice(lo, TILE)
                groups = column(batch, "grp").to_pylist()
                x = column(batch, "vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                rows, region = [], []
                for g in dict.fromkeys(groups):
                    at = np.flatnonzero([y == g for y in groups])
                    centres = coarse.value.get(g)
                    if centres is None:
                        near = np.zeros((len(at), 1), dtype=np.int64)
                    else:
                        m = min(spread, len(centres))
                        near = np.argpartition(-(x[at] @ centres.T), m - 1, axis=1)[:, :m]
                    rows.append(np.repeat(at, near.shape[1]))
                    region.append(near.ravel())
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([column(batch, "grp").take(take), int64(np.concatenate(region)), column(batch, "id").take(take), column(batch, "vec").take(take)], names=["grp", "region", "id", "vec"])

    return work


def _posted(prefix: int, posted: int):
    """Postings of a stream in which the pivots of a region stand before its vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, piv = None, [], None
        for whole in batches:
            if not whole.num_rows:
                continue
            code = column(whole, "grp").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            keys = np.stack((code, column(whole, "region").to_numpy(), column(whole, "chunk").to_numpy(), column(whole, "pivot").to_numpy(zero_copy_only=False).astype(np.int64)))
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
                part = whole.slice(lo, hi - lo)
                key = (column(part, "grp")[0].as_py(), int(keys[1, lo]), int(keys[2, lo]))
                if key != now:
                    now, held, piv = key, [], None
                x = column(part, "vec").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(part.num_rows, -1)
                if keys[3, lo]:
                    held.append(x)
                    continue
                if piv is None:
                    piv = np.concatenate(held) if held else x[:0]
                if not len(piv):
                    continue
                for at in range(0, part.num_rows, TILE):
                    yield from _postings(part.slice(at, TILE), x[at : at + TILE], piv, prefix, posted)

    return work


def _postings(batch: pa.RecordBatch, x: np.ndarray, piv: np.ndarray, prefix: int, posted: int) -> Iterator[pa.RecordBatch]:
    sim = x @ piv.T
    near = np.argpartition(-sim, prefix - 1, axis=1)[:, :prefix] if prefix < len(piv) else np.tile(np.arange(len(piv)), (len(x), 1))
    order = np.lexsort((near, -np.take_along_axis(sim, near, axis=1)), axis=1)
    perm = np.take_along_axis(near, order, axis=1).astype(np.int16)
    m = min(posted, perm.shape[1])
    take = pa.array(np.repeat(np.arange(len(x)), m))
    vec = pa.array([v.tobytes() for v in x], pa.binary())
    code = pa.array([p.tobytes() for p in perm], pa.binary())
    yield pa.RecordBatch.from_arrays(
        [column(batch, "grp").take(take), column(batch, "region").take(take), pa.array(perm[:, :m].ravel().astype(np.int32)), column(batch, "id").take(take), code.take(take), vec.take(take)],
        names=["grp", "region", "pivot", "id", "perm", "vec"],
    )


def footrule_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two blocks of permutations (n x L, m x L): the n x m sums of min(L - rank) over shared pivots.

    The footrule distance of two prefixes, with absent pivots at rank L, is L (L + 1) minus twice this sum.
    """
    n, length = a.shape
    used, code = np.unique(np.concatenate((a.ravel(), b.ravel())), return_inverse=True)
    ca, cb = code[: a.size].reshape(a.shape), code[a.size :].reshape(b.shape)
    weight = np.zeros((len(used), n), dtype=np.uint8)  # weight of each pivot in each row of a
    weight[ca, np.arange(n)[:, None]] = (length - np.arange(length))[None, :].astype(np.uint8)
    out = np.zeros((len(b), n), dtype=np.uint8)
    for k in range(length):
        out += np.minimum(weight[cb[:, k]], np.uint8(length - k))
    return out.T


def _best(sim: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their row (with ties)."""
    rows = np.flatnonzero(ok.sum(axis=1) > k)
    if len(rows):
        ok = ok.copy()
        s = np.where(ok[rows], sim[rows], -2.0)
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        ok[rows] &= s >= kth[:, None] - 1e-6
    return ok


def _meet(k: int, least: float, footrule: int, posted: int):
    def one_file(ids, perm, vec, block, pair, pivot) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        length = perm.shape[1]
        for i in range(0, len(ids), TILE):
            for j in range(i, len(ids), TILE):
                a, b = slice(i, i + TILE), slice(j, j + TILE)
                ok = length * (length + 1) - 2 * footrule_overlap(perm[a], perm[b]).astype(np.int32) <= footrule
                sim = vec[a] @ vec[b].T
                ok &= sim >= least - 1e-5
                if i == j:
                    ok &= ~np.eye(len(ids[a]), dtype=bool)
                if pair is not None:
                    ok &= (block[a][:, None] == pair[0]) & (block[b][None, :] == pair[1]) | (block[a][:, None] == pair[1]) & (block[b][None, :] == pair[0])
                if not ok.any():
                    continue
                ok = _best(sim, ok, k) | _best(sim.T, ok.T, k).T
                x, y = np.nonzero(ok)
                x, y = x + i, y + j
                if i == j:
                    x, y = x[x < y], y[x < y]
                pa_, pb = perm[x, :posted], perm[y, :posted]
                same = pa_[:, :, None] == pb[:, None, :]
                first = np.where(same.any(axis=2), pa_, np.int16(32767)).min(axis=1)
                own = first == pivot  # of the files both stand in, this is the one that takes the pair
                x, y = x[own], y[own]
                cos = (vec[x].astype(np.float64) * vec[y].astype(np.float64)).sum(axis=1)
                yield ids[x], ids[y], cos

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        del parts
        group = t.column("grp").combine_chunks()
        names = group.dictionary_encode()
        names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
        code = np.asarray(names.indices.fill_null(-1)).astype(np.int64)
        s, u = t.column("lo").to_numpy(), t.column("hi").to_numpy()
        keys = np.stack((u, s, t.column("pivot").to_numpy(), t.column("region").to_numpy(), code))
        order = np.lexsort(keys)
        cuts = np.flatnonzero((np.diff(keys[:, order], axis=1) != 0).any(axis=0)) + 1
        ids, block = t.column("id").to_numpy(), t.column("own").to_numpy()
        for at in np.split(order, cuts):
            if len(at) < 2:
                continue
            rows = t.take(pa.array(at))
            perm, vec = _stacked(rows.column("perm"), np.int16), _stacked(rows.column("vec"), np.float32)
            lo, hi = int(s[at[0]]), int(u[at[0]])
            pair = None if lo == hi == 0 and int(block[at].max()) == 0 else (lo, hi)
            name = rows.column("grp").slice(0, 1).to_pylist()[0]
            for x, y, cos in one_file(ids[at], perm, vec, block[at], pair, int(rows.column("pivot")[0].as_py())):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), int64(x), int64(y), pa.array(cos)], names=["grp", "a", "b", "cos"])

    return work


def _split_hot(postings: DataFrame) -> DataFrame:
    hot = postings.groupBy("grp", "region", "pivot").count().where(F.col("count") > HOT_FILE)
    hot = hot.select(F.col("grp").alias("hg"), F.col("region").alias("hr"), F.col("pivot").alias("hp"), (1 + F.floor(F.col("count") / HOT_FILE)).alias("g"))
    hot = materialize(hot, "hot-files")
    if hot.isEmpty():
        zero = F.lit(0).cast("long")
        return postings.withColumn("own", zero).withColumn("lo", zero).withColumn("hi", zero)
    j = postings.join(hot, F.col("grp").eqNullSafe(F.col("hg")) & (F.col("region") == F.col("hr")) & (F.col("pivot") == F.col("hp")), "left").withColumn("g", F.coalesce("g", F.lit(1)).cast("long"))
    j = j.withColumn("own", F.pmod(F.xxhash64("id"), F.col("g"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    return j.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("hg", "hr", "hp", "g", "other")


def _coarse(reps: DataFrame, sizes: DataFrame) -> dict[str | None, np.ndarray]:
    """Coarse pivots of the groups that need regions: one for every REGION_ROWS vectors a region shall hold, MAX_REGIONS at most."""
    out = {}
    for r in sizes.where(F.col("rows") > REGION_ROWS).collect():
        regions = min(MAX_REGIONS, -(-SPREAD * r["rows"] // REGION_ROWS))
        drawn = hash_sample(reps.where(F.col("grp").eqNullSafe(F.lit(r["grp"]))), F.struct("grp", "id"), [F.col("vec")], regions, r["rows"])
        out[r["grp"]] = np.array([x["vec"] for x in drawn], dtype=np.float32)
    return out


def _all_postings(reps: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grp, region, pivot, id, perm, vec): the inverted files."""
    spark = reps.sparkSession
    coarse = _coarse(reps, sizes)
    if coarse:
        sent = spark.sparkContext.broadcast(coarse)
        reps = materialize(reps.mapInArrow(_in_regions(sent, SPREAD), "grp string, region long, id long, vec array<float>"), "vector-regions")
    else:
        reps = reps.select("grp", F.lit(0).cast("long").alias("region"), "id", "vec")
    n = reps.groupBy("grp", "region").agg(F.count("*").alias("rows")).select(F.col("grp").alias("g2"), F.col("region").alias("r2"), "rows")
    # one row in ROWS_A_PIVOT is a pivot, in small groups some two dozen; short permutations name them by 16 bits
    share = F.least(F.greatest(F.lit(1 / ROWS_A_PIVOT), 3 * PREFIX / F.col("rows")), 30_000 / F.col("rows"))
    chunks = (1 + F.floor(F.col("rows") / CHUNK_ROWS)).cast("long")
    n = materialize(n, "region-sizes")
    small = n.limit(BROADCAST_SIZES + 1).count() <= BROADCAST_SIZES
    sized = reps.join(F.broadcast(n) if small else n, F.col("grp").eqNullSafe(F.col("g2")) & (F.col("region") == F.col("r2"))).withColumn("chunks", chunks)
    drawn = F.pmod(F.xxhash64(F.lit("pivot"), "grp", "id"), F.lit(1 << 40)) <= (share * (1 << 40)).cast("long")
    own = sized.select("grp", "region", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), F.lit(False).alias("pivot"), "id", "vec")
    pivots = sized.where(drawn).select("grp", "region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("pivot"), "id", "vec")
    stream = own.unionByName(pivots).repartition("grp", "region", "chunk").sortWithinPartitions("grp", "region", "chunk", F.desc("pivot"), "id")
    return stream.mapInArrow(_posted(PREFIX, POSTED), "grp string, region long, pivot int, id long, perm binary, vec binary")


def nearest(df: DataFrame, id_col: str, vec_col: str, group_col: str | None = None, k: int = 10, least: float = -1.0, dim: int = 64) -> DataFrame:
    """(grp, id, neighbour, cos, place): for every vector its k most similar ones of its group, of cosine `least` or more."""
    spark = df.sparkSession
    group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    base = df.select(group.alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("id is not null and vec is not null")
    base = materialize(base.mapInArrow(_normalised(dim), "grp string, id long, cls long, vec array<float>").groupBy("grp", "id").agg(F.min(F.struct("cls", "vec")).alias("v")).select("grp", "id", "v.cls", "v.vec"), "vectors")
    classes = base.groupBy("grp", "cls").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    shared = classes.where("n > 1").select(F.col("grp").alias("g2"), F.col("cls").alias("c2"), "rep")
    same_class = F.col("grp").eqNullSafe(F.col("g2")) & (F.col("cls") == F.col("c2"))
    members = materialize(base.select("grp", "cls", "id").join(shared, same_class).select("grp", "rep", "id").distinct(), "vector-copies")
    copies = members.where("id <> rep").select(F.col("grp").alias("g2"), F.col("id").alias("i2"))
    reps = base.select("grp", "id", "vec").join(copies, F.col("grp").eqNullSafe(F.col("g2")) & (F.col("id") == F.col("i2")), "left_anti")
    reps = materialize(reps, "vector-classes")
    sizes = reps.groupBy("grp").agg(F.count("*").alias("rows"))
    n = sizes.agg(F.sum("rows")).first()[0] or 0
    postings = _all_postings(reps, sizes)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * POSTED // 150_000)
    spread = _split_hot(postings).repartition(parts, "grp", "region", "pivot", "lo", "hi")
    cross = spread.mapInArrow(_meet(k, least, FOOTRULE, POSTED), "grp string, a long, b long, cos double")
    both = materialize(cross, "vector-pairs")
    both = both.select("grp", F.col("a").alias("id"), F.col("b").alias("nb"), "cos").unionByName(both.select("grp", F.col("b").alias("id"), F.col("a").alias("nb"), "cos"))
    first = Window.partitionBy("grp", "rep").orderBy("id")
    heads = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select(F.col("grp").alias("g2"), F.col("rep").alias("r2"), F.col("id").alias("member"))
    order = [F.round("cos", 7).desc(), F.col("nb").asc()]
    # a class answers with its first members, and one list serves all members of the asking class
    opened = both.distinct().join(heads, F.col("grp").eqNullSafe(F.col("g2")) & (F.col("nb") == F.col("r2")), "left").select("grp", "id", F.coalesce("member", "nb").alias("nb"), "cos")
    opened = opened.withColumn("r", F.row_number().over(Window.partitionBy("grp", "id").orderBy(*order))).where(F.col("r") <= k).drop("r")
    askers = members.select(F.col("grp").alias("g2"), F.col("rep").alias("r2"), F.col("id").alias("asker"))
    lists = opened.join(askers, F.col("grp").eqNullSafe(F.col("g2")) & (F.col("id") == F.col("r2")), "left").select("grp", F.coalesce("asker", "id").alias("id"), "nb", "cos")
    own = askers.join(heads.withColumnRenamed("g2", "g3").withColumnRenamed("r2", "r3"), F.col("g2").eqNullSafe(F.col("g3")) & (F.col("r2") == F.col("r3")) & (F.col("asker") != F.col("member")))
    lists = lists.unionByName(own.select(F.col("g2").alias("grp"), F.col("asker").alias("id"), F.col("member").alias("nb"), F.lit(1.0).alias("cos")))
    ranked = lists.withColumn("place", F.row_number().over(Window.partitionBy("grp", "id").orderBy(*order)))
    return ranked.where((F.col("place") <= k) & (F.col("cos") >= least)).select("grp", "id", F.col("nb").alias("neighbour"), "cos", "place")


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, group_col: str, k: int = 10, least: float = 0.85, dim: int = 64) -> DataFrame:
    """(grp, a, b): pairs of cosine `least` or more of which one is among the k most similar of the other."""
    found = nearest(df, id_col, vec_col, group_col, k, least, dim)
    return found.select("grp", F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()

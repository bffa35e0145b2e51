"""Near-duplicate records with small edits.

Method: binary trie self-join. Every record becomes a bit string: the bits of a band key (a few min-hashes that must
agree, budget 0) followed by a 128-bit sketch, one bit from each min-hash. Pairs of trie nodes are walked down together
and dropped when the differing sketch bits exceed the Hamming budget. A record stands in one trie for each band, and a
pair is found if one trie holds both; the pairs left over are then verified on the exact sets of word runs.

Records with the same set of runs are one class; the join works on one record a class, and classes are opened again at
the end, so a group of exact copies costs the join nothing. Band keys that one record holds alone are dropped after an
exact count, before any sketch is sent; keys that very many hold are divided into blocks.

Defined cases: null and blank texts, and texts with fewer words than a run, are in no pair; of rows that repeat an id the
one with the least hash of its set counts; an empty table gives an empty result; columns of any other name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize
from .arrowio import chunks, column, int64
from .blocks import pairs_within
from .fold import mix, words
from .trie_join import LEVEL_BITS, trie_self_join

SKETCH_BITS = 128
#: A band key held by more records than this is divided into blocks, and pairs of blocks are joined apart.
HOT_KEY = 20_000


def banding(threshold: float) -> tuple[int, int, int]:
    """(min-hashes a band, bands, Hamming budget). At similarity s a trie holds a pair with probability s ** rows."""
    rows, bands = (4, 48) if threshold < 0.7 else (8, 24)
    share = (1 - threshold) / 2  # of sketch bits that differ at the threshold
    return rows, bands, int(SKETCH_BITS * share + 3.3 * (SKETCH_BITS * share * (1 - share)) ** 0.5)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seed[:n] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1), (seed[n:] >> np.uint64(32)).astype(np.uint32)[:, None]


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the runs of n words."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint32)
    h = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
    return np.unique((mix(h) >> np.uint64(32)).astype(np.uint32))


def _sketches(id_: str, text: str, source: str | None, lines, run: int, rows: int, bands: int):
    n_hashes = max(rows * bands, SKETCH_BITS)
    mul, add = _constants(n_hashes)
    odd = mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(977))[None, :]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, id_).to_numpy(zero_copy_only=False)
            texts = [t or "" for t in column(batch, text).to_pylist()]
            if lines is not None:
                from .site_lines import bare_texts

                texts = bare_texts(texts, column(batch, source).to_pylist(), lines.value)
            for a, b in chunks(texts):
                h, off = words(texts[a:b])
                sets, at = [], []
                for k in range(b - a):
                    s = runs_of(h[off[k] : off[k + 1]], run)
                    if len(s):
                        sets.append(s)
                        at.append(a + k)
                if not sets:
                    continue
                low = np.empty((len(sets), n_hashes), dtype=np.uint32)
                one = np.empty(len(sets), dtype=np.uint64)
                two = np.empty(len(sets), dtype=np.uint64)
                for k, s in enumerate(sets):
                    np.min(mul * s + add, axis=1, out=low[k])
                    m = mix(s.astype(np.uint64))
                    one[k], two[k] = m.sum(), np.bitwise_xor.reduce(m * np.uint64(0xC2B2AE3D27D4EB4F))
                keys = np.zeros((len(sets), bands), dtype=np.uint64)
                for k in range(rows):
                    keys = mix(keys + low[:, k : rows * bands : rows].astype(np.uint64) + odd)
                sketch = np.packbits(((low[:, :SKETCH_BITS] >> np.uint32(9)) & np.uint32(1)).astype(np.uint8), axis=1).view(np.uint64)
                sizes = np.array([len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        int64(ids[at]), int64(one), int64(two), int64(sketch[:, 0]), int64(sketch[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands), pa.int32()), int64(keys.ravel())),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(sets).view(np.int32))),
                    ],
                    names=["id", "set1", "set2", "sk1", "sk2", "bands", "runs"],
                )

    return work


SKETCH_SCHEMA = "id long, set1 long, set2 long, sk1 long, sk2 long, bands array<long>, runs array<int>"


def _join(budget: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        key, ids = (table.column(c).to_numpy() for c in ("key", "id"))
        sketch = np.stack([table.column(c).to_numpy() for c in ("sk1", "sk2")], axis=1)
        del table, parts
        order = np.argsort(key, kind="stable")
        k = key[order]
        twin = np.zeros(len(k), dtype=bool)
        twin[1:] = k[1:] == k[:-1]
        twin[:-1] |= twin[1:]
        at = order[twin]  # rows that share their key with another one
        bits = np.ascontiguousarray(sketch[at]).view(">u2").astype(np.uint16).reshape(len(at), SKETCH_BITS // LEVEL_BITS)
        for i, j in trie_self_join(key[at].view(np.uint64), bits, budget):
            a, b = ids[at[i]], ids[at[j]]
            ok = a != b
            yield pa.RecordBatch.from_arrays([int64(np.minimum(a, b)[ok]), int64(np.maximum(a, b)[ok])], names=["a", "b"])

    return work


def _shared_keys(banded: DataFrame) -> DataFrame:
    """Records of the keys that several hold; those of hot keys in blocks, and every pair of blocks under a key of its own."""
    held = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", (1 + F.floor(F.col("n") / HOT_KEY)).cast("long").alias("g"))
    own = banded.join(held, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("g"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return own.select(F.when(F.col("g") > 1, pair).otherwise(F.col("key")).alias("key"), "id", "sk1", "sk2")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, run: int = 5, threshold: float = 0.8, source_col: str | None = None, lines=None) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives (a, b, jaccard), members (rep, id)) of the records of `df`.

    run: words in a run; threshold: least share of common runs. `lines`: broadcast set of repeated lines to leave out.
    Ids must be unique and not null (rows without one are left out); of rows that repeat an id one counts.
    """
    rows, bands, budget = banding(threshold)
    cols = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    if lines is not None:
        cols.append(F.col(source_col).cast("string").alias("source"))
    sketched = df.select(*cols).where("id is not null and text is not null").mapInArrow(_sketches("id", "text", "source", lines, run, rows, bands), SKETCH_SCHEMA)
    sketched = materialize(sketched, "near-dup-sketches")
    sets = sketched.groupBy("id").agg(F.min(F.struct("set1", "set2")).alias("s")).select("id", "s.set1", "s.set2")
    least = sets.groupBy("set1", "set2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    members = materialize(sets.join(least, ["set1", "set2"]).select("rep", "id"), "near-dup-members")
    copies = materialize(members.where("rep <> id").select("id"), "near-dup-copies")
    # how the small tables below travel is left to the planner, which knows the size of their files
    banded = sketched.join(copies, "id", "left_anti").select(F.explode("bands").alias("key"), "id", "sk1", "sk2")
    shared = materialize(_shared_keys(banded), "near-dup-keys")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), shared.count() // 2_000_000)
    pairs = shared.repartition(parts, "key").mapInArrow(_join(budget), "a long, b long").distinct()
    pairs = materialize(pairs, "near-dup-candidates")
    drop_materialized(shared)
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-dup-ids")
    runs = sketched.join(wanted, "id", "left_semi").groupBy("id").agg(F.min(F.struct("set1", "set2", "runs")).alias("s")).select("id", "s.runs")
    runs = materialize(runs, "near-dup-runs")
    left, right = runs.select(F.col("id").alias("a"), F.col("runs").alias("ra")), runs.select(F.col("id").alias("b"), F.col("runs").alias("rb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("c", F.size(F.array_intersect("ra", "rb")))
    jaccard = F.col("c") / (F.size("ra") + F.size("rb") - F.col("c"))
    return both.withColumn("jaccard", jaccard).where(F.col("jaccard") >= threshold).select("a", "b", "jaccard"), members


def row_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids: those between classes and those within one."""
    rep_a, rep_b = members.select(F.col("rep").alias("a"), F.col("id").alias("ia")), members.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = pairs.join(rep_a, "a", "left").join(rep_b, "b", "left").select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"))
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return across.unionByName(pairs_within(members, ["rep"], "id").select("a", "b"))


def classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, members, links): one row per record that is a copy or linked: its class, the records of that, and its number of linked classes."""
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("members"))
    heads = links.join(sizes, "rep", "full").select("rep", F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("links", F.lit(0)).alias("links"))
    return heads.join(members, "rep", "left").select(F.coalesce("id", "rep").alias("id"), F.col("rep").alias("class_id"), F.col("members").cast("long").alias("members"), F.col("links").cast("long").alias("links"))

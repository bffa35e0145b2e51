"""Approximate neighbours by coarse lists: for topic tables, where every query against every row is too much.

Vectors of a group are divided into lists around coarse centroids, fitted on a bounded sample; a query looks into the
`nprobe` lists nearest to it and ranks their rows exactly, block by block. Groups of fewer than FLAT rows are one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text_model import lloyd
from .vectors import exact_knn

#: Rows below which a group is not divided; rows a list; lists at most; lists a query looks into at most.
FLAT, ROWS_A_LIST, MAX_LISTS, PROBES = 200, 40, 1024, 32
#: Vectors of a group the centroids are fitted on at most, drawn by the order of a hash.
SAMPLE = 20_000


def _centroids(rows: DataFrame) -> dict:
    """{group: centroids} of the groups that are divided."""
    import numpy as np

    out = {}
    for r in rows.groupBy("grp").count().where(F.col("count") >= FLAT).collect():
        lists = min(MAX_LISTS, r["count"] // ROWS_A_LIST)
        drawn = rows.where(F.col("grp").eqNullSafe(F.lit(r["grp"]))).select(F.xxhash64("id").alias("h"), "vec").orderBy("h").limit(min(SAMPLE, 40 * lists)).collect()
        x = np.array([d["vec"] for d in drawn], dtype=np.float64)
        labels, _ = lloyd(x, lists, 42, 10)
        out[r["grp"]] = np.stack([x[labels == c].mean(axis=0) if (labels == c).any() else x[c] for c in range(lists)])
    return out


def _listed(sent, probes: int):  # noqa: ANN001, ANN202
    """Every row with the key of each of the `probes` lists nearest to it."""

    def work(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            groups = batch.column(0).to_pylist()
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else None
            rows, keys = [], []
            for g in dict.fromkeys(groups):
                at = np.flatnonzero([y == g for y in groups])
                c = sent.value.get(g)
                if c is None:
                    near = np.zeros((len(at), 1), dtype=np.int64)
                else:
                    d = (c * c).sum(axis=1)[None] - 2 * x[at] @ c.T
                    m = min(probes, len(c))
                    near = np.argpartition(d, m - 1, axis=1)[:, :m]
                for row, own in zip(at, near):
                    rows += [row] * len(own)
                    keys += [f"{g}\u0001{n}" for n in own]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(keys, pa.string())], names=["grp", "id", "vec", "list"])

    return work


def ivf_knn(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, group_col: str, k: int = 10) -> DataFrame:
    """(grp, id, neighbour, rank, score): about the k nearest of each query row by inner product, itself left out."""
    pick = lambda x: x.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = pick(df)
    sent = df.sparkSession.sparkContext.broadcast(_centroids(rows))
    shape = "grp string, id long, vec array<double>, list string"
    found = exact_knn(rows.mapInArrow(_listed(sent, 1), shape), pick(queries).mapInArrow(_listed(sent, PROBES), shape), "id", "vec", "list", k)
    rank = F.row_number().over(Window.partitionBy("grp", "id").orderBy(F.desc("score"), "neighbour"))
    whole = found.select(F.substring_index("grp", "\u0001", 1).alias("grp"), "id", "neighbour", "score")
    return whole.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("grp", "id", "neighbour", "rank", "score")

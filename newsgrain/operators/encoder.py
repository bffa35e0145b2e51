"""Texts as unit vectors behind one interface: stored vectors, a model's own, or hashed TF-IDF with a random projection.

A provider takes (id, text) and gives (id, vec). `hashed` needs no model and is the same on every run; `stored` joins
vectors made elsewhere; `of_model` wraps a function of texts, which runs over Arrow batches beside the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import unit

BUCKETS, DIM = 1 << 15, 384
Provider = Callable[[DataFrame], DataFrame]


def hashed(dim: int = DIM, seed: int = 42) -> Provider:
    """Words hashed to BUCKETS, weighted by tf and idf over the corpus, projected on random signs."""

    def encode(texts: DataFrame) -> DataFrame:
        import numpy as np
        import pyarrow as pa

        words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
        hashed_ = texts.select("id", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")).alias("b"))
        df = hashed_.select(F.explode(F.array_distinct("b")).alias("b")).groupBy("b").count().collect()  # at most BUCKETS rows
        n = texts.count()
        idf = np.full(BUCKETS, np.log(1 + n) + 1)
        for r in df:
            idf[r["b"]] = np.log((1 + n) / (1 + r["count"])) + 1
        signs = (np.random.default_rng(seed).integers(0, 2, size=(BUCKETS, dim), dtype=np.int8) * 2 - 1).astype(np.int8)
        sent = texts.sparkSession.sparkContext.broadcast((idf, signs))

        def work(batches):  # noqa: ANN001, ANN202
            idf, signs = sent.value
            for batch in batches:
                out = []
                for x in batch.column(1):
                    b, tf = np.unique(x.values.to_numpy(zero_copy_only=False), return_counts=True) if x.is_valid else (np.empty(0, int), np.empty(0))
                    v = ((1 + np.log(tf)) * idf[b]) @ signs[b] if len(b) else np.zeros(dim)
                    length = np.linalg.norm(v)
                    out.append(v / length if length else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], names=["id", "vec"])

        return hashed_.mapInArrow(work, f"id {texts.schema['id'].dataType.simpleString()}, vec array<float>")

    return encode


def stored(vectors: DataFrame, id_col: str = "id", vec_col: str = "vec") -> Provider:
    """Vectors made elsewhere, brought to unit length; texts without one have null."""
    own = vectors.select(F.col(id_col).alias("id"), unit(F.col(vec_col)).cast("array<float>").alias("vec"))
    return lambda texts: texts.select("id").join(own, "id", "left")


def of_model(function: Callable[[list[str]], list[list[float]]]) -> Provider:
    """The vectors a function gives for a list of texts, brought to unit length."""

    def encode(texts: DataFrame) -> DataFrame:
        import pyarrow as pa

        def work(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                found = function([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(map(float, v)) for v in found], pa.list_(pa.float32()))], names=["id", "vec"])

        made = texts.select("id", "text").mapInArrow(work, f"id {texts.schema['id'].dataType.simpleString()}, vec array<float>")
        return made.select("id", unit(F.col("vec")).cast("array<float>").alias("vec"))

    return encode


def encode_texts(df: DataFrame, id_col: str, text_col: str, provider: Provider | None = None) -> DataFrame:
    """(id, vec) of every row; blank texts have null."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return (provider or hashed())(texts)

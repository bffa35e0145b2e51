"""Small helpers between Arrow batches and the vectorised kernels."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters handled at a time, so that the kernels' arrays stay in a core's cache.
CHUNK_CHARS = 150_000


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about `limit` characters; a longer text is a range of its own, whole."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def int64(x: np.ndarray) -> pa.Array:
    """Any 64-bit array as Arrow int64, unsigned ones by their bits."""
    x = np.ascontiguousarray(x)
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))


@contextmanager
def caches_kept() -> Iterator[None]:
    """No search for cycles in here, nor later in what stays: a worker looks through all its objects after every task, caches too."""
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        gc.enable()


def keeping(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work`, which fills caches that later tasks use, with `caches_kept`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with caches_kept():
            yield from work(batches)

    return run


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def hash_sample(df: DataFrame, key: Column, columns: list[Column], size: int, rows: int | None = None) -> list:
    """About `size` rows of `df` and never more, chosen by a hash of their key alone.

    Every task keeps only rows whose hash falls below the share wanted, so what reaches the driver does not grow with
    the number of tasks.
    """
    rows = df.count() if rows is None else rows
    share = min(1.0, (size + 4 * size**0.5) / max(rows, 1))
    h = F.xxhash64(key)
    kept = df.where(F.pmod(h, F.lit(1 << 40)) <= F.lit(int(share * (1 << 40)))).select(h.alias("__h"), *columns)
    return sorted(kept.collect(), key=lambda r: r["__h"])[:size]

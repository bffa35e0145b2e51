"""Lines repeated across one site's documents.

Method: mergeable heavy-hitter summaries per source name the lines that can be frequent, a second pass counts those
exactly, and the confirmed lines are removed with broadcast sets.

The summaries are Misra-Gries counters. Each source's lines are divided by hash into `SUBSTREAMS` streams; every task
keeps at most `counters` counters a stream and reports, with them, by how much it may have undercounted. Summaries
merge by adding counters and errors, so a line whose count plus its stream's error stays below the threshold cannot be
frequent: no frequent line is lost. Where a stream's error alone reaches the threshold all its lines are candidates.

Two lines are the same if their letters are the same, case and marks on letters aside. A line counts once a document.

Defined cases: null and empty documents have no lines; rows without a source (null or blank) neither count nor are removed from;
lines with fewer than `min_letters` letters are never removed; rows that repeat an id count as one row; an empty table gives an empty result; columns of any other name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .arrowio import chunks, column, int64
from .fold import line_letters, mix

SUBSTREAMS = 64
COUNTERS = 4096
#: Confirmed lines up to this number travel as a broadcast set (16 bytes each); beyond it a join takes over.
BROADCAST_LINES = 1_000_000


def reduce_counters(kept: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries in its mergeable form: subtract the (counters + 1)-th count from all; also returns that undercount."""
    if len(kept) <= counters:
        return kept, counts, 0
    off = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
    left = counts > off
    return kept[left], counts[left] - off, off


def _source_ids(sources: list[str | None]) -> np.ndarray:
    """A 64-bit id per source name; 0 for none (null or blank)."""
    import xxhash

    seen = {None: 0}
    for s in sources:
        if s not in seen:
            seen[s] = (xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) or 1) if s.strip() else 0
    return np.array([seen[s] for s in sources], dtype=np.uint64)


def _lines(batch: pa.RecordBatch, text: str, source: str, min_letters: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of rows: (first row, row within the batch, line number, line key, source id) of the lines that may count."""
    texts = [t or "" for t in column(batch, text).to_pylist()]
    ids = _source_ids(column(batch, source).to_pylist())
    for a, b in chunks(texts):
        t, line, h, n = line_letters(texts[a:b], lookalikes=False)
        own = ids[a:b][t]
        ok = (n >= min_letters) & (own != 0)
        t, line, h, own = t[ok], line[ok], h[ok], own[ok]
        yield a, t + a, line, mix(h ^ own), own


def _summaries(text: str, source: str, min_letters: int, counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, int]] = {}

        def fold_in(own: np.ndarray, key: np.ndarray) -> None:
            stream = (key >> np.uint64(58)).astype(np.int64)
            group = mix(own) ^ stream.astype(np.uint64)
            order = np.argsort(group, kind="stable")
            own, key, stream, group = own[order], key[order], stream[order], group[order]
            cuts = np.flatnonzero(np.diff(group)) + 1 if len(group) else []
            for part in np.split(np.arange(len(group)), cuts):
                if not len(part):
                    continue
                at = (int(own[part[0]]), int(stream[part[0]]))
                k, c = np.unique(key[part], return_counts=True)
                if at in total:
                    k0, c0, e0 = total[at]
                    k, inverse = np.unique(np.concatenate((k0, k)), return_inverse=True)
                    c = np.bincount(inverse, weights=np.concatenate((c0, c))).astype(np.int64)
                else:
                    e0 = 0
                k, c, off = reduce_counters(k, c, counters)
                total[at] = (k, c, e0 + off)

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, row, _, key, own in _lines(batch, text, source, min_letters):
                first = np.unique(np.stack((row.astype(np.uint64), key)), axis=1, return_index=True)[1] if len(row) else []
                waiting.append((own[first], key[first]))
            if sum(len(k) for _, k in waiting) > 500_000:
                fold_in(*(np.concatenate(x) for x in zip(*waiting)))
                waiting = []
        if waiting:
            fold_in(*(np.concatenate(x) for x in zip(*waiting)))
        for (own, stream), (k, c, err) in total.items():
            n = len(k)
            yield pa.RecordBatch.from_arrays(
                [int64(np.full(n, own, np.uint64)), pa.array(np.full(n, stream, np.int32)), int64(k), int64(c), pa.nulls(n, pa.int64())],
                names=["source_id", "stream", "line", "n", "err"],
            )
            if err:
                yield pa.RecordBatch.from_arrays(
                    [int64(np.array([own], np.uint64)), pa.array([stream], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([err], pa.int64())],
                    names=["source_id", "stream", "line", "n", "err"],
                )

    return run


def candidate_lines(df: DataFrame, text: str, source: str, min_rows: int, min_letters: int, counters: int) -> tuple[DataFrame, DataFrame]:
    """Merged summaries: the lines that can reach `min_rows`, and the streams whose error alone reaches it."""
    s = df.select(text, source).mapInArrow(_summaries(text, source, min_letters, counters), "source_id long, stream int, line long, n long, err long")
    s = materialize(s, "line-summaries")
    errors = s.where("err is not null").groupBy("source_id", "stream").agg(F.sum("err").alias("err"))
    counters_ = s.where("line is not null").groupBy("source_id", "stream", "line").agg(F.sum("n").alias("n"))
    open_streams = errors.where(F.col("err") >= min_rows)
    lines = counters_.join(errors, ["source_id", "stream"], "left").where(F.col("n") + F.coalesce("err", F.lit(0)) >= min_rows)
    return lines.select("source_id", "line"), open_streams.select("source_id", "stream")


def _occurrences(id_: str, text: str, source: str, min_letters: int, wanted, streams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value if wanted is not None else None
        open_ = streams.value if streams is not None else None
        for batch in batches:
            ids = column(batch, id_).to_numpy(zero_copy_only=False)
            for _, row, line, key, own in _lines(batch, text, source, min_letters):
                if keep is not None:
                    at = np.searchsorted(keep, key)
                    ok = keep[np.minimum(at, len(keep) - 1)] == key if len(keep) else np.zeros(len(key), bool)
                    if len(open_):
                        ok |= np.isin(mix(own) ^ (key >> np.uint64(58)), open_)
                    row, line, key, own = row[ok], line[ok], key[ok], own[ok]
                if len(row):
                    yield pa.RecordBatch.from_arrays([int64(ids[row]), int64(line), int64(own), int64(key)], names=["row_id", "line_no", "source_id", "line"])

    return run


def repeated_lines(
    df: DataFrame, id_col: str = "row_idx", text_col: str = "document", source_col: str = "source_domain", min_rows: int = 5, min_letters: int = 12, counters: int = COUNTERS
) -> tuple[DataFrame, DataFrame]:
    """Occurrences (row_id, line_no, source_id, line) of candidate lines, and the confirmed lines with their exact row counts.

    `id_col` must be unique; rows delivered twice under one id count once.
    """
    spark = df.sparkSession
    cols = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col), F.col(source_col).alias(source_col))
    lines, open_streams = candidate_lines(cols, text_col, source_col, min_rows, min_letters, counters)
    small = lines.limit(BROADCAST_LINES + 1).toPandas()
    loose = open_streams.limit(BROADCAST_LINES + 1).toPandas()
    if max(len(small), len(loose)) <= BROADCAST_LINES:
        wanted = spark.sparkContext.broadcast(np.sort(small["line"].to_numpy(np.int64).view(np.uint64)))
        sid = loose["source_id"].to_numpy(np.int64).view(np.uint64)
        streams = spark.sparkContext.broadcast(np.sort(mix(sid) ^ loose["stream"].to_numpy(np.int64).astype(np.uint64)))
    else:  # too many to broadcast: every line goes to the exact count
        wanted = streams = None
    found = cols.mapInArrow(_occurrences(id_col, text_col, source_col, min_letters, wanted, streams), "row_id long, line_no long, source_id long, line long")
    found = materialize(found, "line-occurrences")
    per_row = found.select("source_id", "line", "row_id").distinct()
    confirmed = per_row.groupBy("source_id", "line").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= min_rows)
    return found, materialize(confirmed, "lines-confirmed")


def marked_lines(df: DataFrame, **options) -> DataFrame:
    """One row for every occurrence of a repeated line: (row_id, line_no)."""
    found, confirmed = repeated_lines(df, **options)
    return found.join(confirmed.select("source_id", "line"), ["source_id", "line"], "left_semi").select("row_id", "line_no")


def confirmed_set(confirmed: DataFrame):
    """The confirmed lines as a broadcast sorted array, or None where they are too many for one."""
    spark = confirmed.sparkSession
    small = confirmed.select("line").limit(BROADCAST_LINES + 1).toPandas()
    if len(small) > BROADCAST_LINES:
        return None
    return spark.sparkContext.broadcast(np.sort(small["line"].to_numpy(np.int64).view(np.uint64)))


def bare_texts(texts: list[str], sources: list[str | None], lines: np.ndarray, min_letters: int = 12) -> list[str]:
    """The texts without the given lines (`lines`: a sorted array of line keys)."""
    ids = _source_ids(sources)
    out = list(texts)
    if not len(lines):
        return out
    for a, b in chunks(texts):
        t, line, h, n = line_letters(texts[a:b], lookalikes=False)
        own = ids[a:b][t]
        key = mix(h ^ own)
        at = np.minimum(np.searchsorted(lines, key), len(lines) - 1)
        hit = (n >= min_letters) & (own != 0) & (lines[at] == key)
        for i in np.unique(t[hit]).tolist():
            drop = set(line[hit & (t == i)].tolist())
            out[a + i] = "\n".join(x for k, x in enumerate(texts[a + i].split("\n")) if k not in drop)
    return out


def remove_lines(df: DataFrame, id_col: str = "row_idx", text_col: str = "document", source_col: str = "source_domain", out_col: str = "bare_text", **options) -> DataFrame:
    """`df` with `out_col`: the text without its repeated lines (null stays null)."""
    found, confirmed = repeated_lines(df, id_col, text_col, source_col, **options)
    lines = confirmed_set(confirmed)
    if lines is None:
        drop = found.join(confirmed, ["source_id", "line"], "left_semi").groupBy(F.col("row_id").alias("__row")).agg(F.collect_set("line_no").alias("__drop"))
        joined = df.join(drop, df[id_col] == drop["__row"], "left")
        return joined.withColumn(out_col, _without(F.col(text_col), F.col("__drop"))).drop("__row", "__drop")
    min_letters = options.get("min_letters", 12)

    @F.pandas_udf("string")
    def bare(text, source):
        import pandas as pd

        cleaned = bare_texts([t if isinstance(t, str) else "" for t in text], [s if isinstance(s, str) else None for s in source], lines.value, min_letters)
        return pd.Series([c if isinstance(t, str) else None for c, t in zip(cleaned, text)])

    return df.withColumn(out_col, bare(F.col(text_col).cast("string"), F.col(source_col).cast("string")))


def _without(text: Column, drop: Column) -> Column:
    parts = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i")))
    kept = F.filter(parts, lambda p: ~F.coalesce(F.array_contains(drop, p["i"]), F.lit(False)))
    return F.array_join(F.transform(kept, lambda p: p["x"]), "\n")

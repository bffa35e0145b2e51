"""Reading and writing the tables of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_diacritics

#: The folders of an output root, and the version of the index layout.
FOLDERS = ("curated", "vectors", "clusters", "temporal", "serving", "reports")
INDEX_VERSION = 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def validated(df: DataFrame, required: list[str]) -> DataFrame:
    """The required text columns as strings, null as empty; an error if one is absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in required})


def union_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """(several parquet files as one table, the paths that cannot be read); columns that a file lacks are null.

    A file is unreadable if its footer is; the caller decides what to do about it.
    """
    from functools import reduce

    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JJavaError

    frames, unreadable = [], []
    for path in paths:
        try:
            frames.append(spark.read.parquet(path))
        except (PySparkException, Py4JJavaError):
            unreadable.append(path)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None, unreadable


def stopword_table(spark: SparkSession, path: str) -> DataFrame:
    """(word): a stopword file, one word a line, and its words without marks, each once."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''")
    return words.union(words.select(strip_diacritics(F.col("word")))).distinct()


def layout(spark: SparkSession, root: str, names: tuple[str, ...] = FOLDERS) -> dict[str, str]:
    """The folders of an output root, made where they are absent."""
    out = {}
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        out[name] = f"{root}/{name}"
    return out


def reused(spark: SparkSession, path: str, rows: int, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(the table stored at `path` if it has `rows` rows, else a newly made and stored one; whether it was reused)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        stored = spark.read.parquet(path)
        if stored.count() == rows:
            return stored, True
    write(make(), path)
    return spark.read.parquet(path), False


def index_state(df: DataFrame, group: str, order: str, text: str, dims: int, version: int = INDEX_VERSION) -> DataFrame:
    """(group, n, fingerprint, dims, version): what an index of a group was made from."""
    return index_fingerprint(df, group, order, text).select(group, "n", "fingerprint", F.lit(dims).alias("dims"), F.lit(version).alias("version"))


def index_reuse(stored: DataFrame, now: DataFrame, group: str) -> DataFrame:
    """(group, n, reuse): whether the stored index of a group still holds, which takes the same texts, order, dimensions and version."""
    same = ["n", "fingerprint", "dims", "version"]
    old = stored.select(F.col(group).alias("__g"), *[F.col(c).alias(f"__{c}") for c in same])
    joined = now.join(old, F.col(group).eqNullSafe(F.col("__g")), "left")
    equal = F.lit(True)
    for c in same:
        equal = equal & F.coalesce(F.col(c) == F.col(f"__{c}"), F.lit(False))
    return joined.select(group, "n", equal.alias("reuse"))


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """zstd parquet under Spark's commit protocol; sorting within files lets readers skip row groups."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def passthrough(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a table; False where the source does not exist."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return False
    write(spark.read.parquet(source), target)
    return True


def present(spark: SparkSession, folder: str, names: list[str]) -> dict[str, bool]:
    """Which tables of a folder exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = {n: jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}.parquet") for n in names}
    return {n: p.getFileSystem(conf).exists(p) for n, p in paths.items()}


def index_fingerprint(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, n, fingerprint): changes when a text of the group, or their order, changes. Hashes of texts are hashed, so no text is gathered."""
    h = df.select(group, order, F.sha2(F.coalesce(text, F.lit("")), 256).alias("h"), F.floor(F.col(order) / 10_000).alias("block"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda e: e["h"]), "")
    blocks = h.groupBy(group, "block").agg(F.sha2(joined(F.collect_list(F.struct(order, "h"))), 256).alias("h"), F.count("*").alias("n"))
    return blocks.groupBy(group).agg(F.sum("n").alias("n"), F.sha2(joined(F.collect_list(F.struct("block", "h"))), 256).alias("fingerprint"))

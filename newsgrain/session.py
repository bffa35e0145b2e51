"""Session construction and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "newsgrain", cores: str | int = "*", **conf: str) -> SparkSession:
    """Local session with the settings the library assumes (UTC, AQE, Arrow); `conf` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(os.cpu_count() or 8) if cores == "*" else str(cores),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only where that setting is absent (tests, a laptop) a local folder takes its place.
    """
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "newsgrain-shared")


def _session_folder(spark: SparkSession) -> str:
    """The folder of this session's tables, marked to be deleted when the driver ends."""
    context = spark.sparkContext
    if not hasattr(context, "_newsgrain_folder"):
        folder = f"{shared_dir(spark)}/newsgrain/{context.applicationId}-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._newsgrain_folder = folder
    return context._newsgrain_folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of `df`: write it once as parquet into the shared folder and read it back.

    Unlike `localCheckpoint` the copy outlives the executors that made it, and unlike `checkpoint` it is columnar,
    compressed and pruned by later readers. The tables of a session stand in one folder, which goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where it has hardly more partitions than those; for steps whose work on a row far exceeds the exchange of it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/newsgrain/" in f}:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_newsgrain_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="newsgrain-"), "newsgrain.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("newsgrain", os.path.relpath(path, root)))
    context.addPyFile(archive)
    context._newsgrain_shipped = True

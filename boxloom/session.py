"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "boxloom", memory: str = "16g") -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for reliable checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return configured or current
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="boxloom-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


_scratch: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; removed when the driver program ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_remove_scratch)
    _scratch[path] = spark
    return path


def _remove_scratch() -> None:
    for path, spark in _scratch.items():
        context = spark.sparkContext
        if context._jsc is None or context._jvm is None:  # the session has ended; a local folder can still be removed
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)
            continue
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and continue from the written rows.

    A checkpoint computes its rows twice and carries the size that the optimizer guessed for the plan above it, which a loop of joins
    multiplies in every round; a written table is computed once and has the size of its files. What Parquet can't hold is checkpointed.
    """
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or "void" in df.schema.simpleString():
        checkpoint_root(df.sparkSession)
        return df.checkpoint(eager=True)
    path = scratch(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

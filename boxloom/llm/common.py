"""Tables, shared storage and size-checked broadcasts for the training-data operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.session import checkpoint_root

#: A side of a join is broadcast up to this many bytes of its own rows; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

_folders: dict[str, SparkSession] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; removed when the driver program ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_remove)
    _folders[path] = spark
    return path


def _remove() -> None:
    for path, spark in _folders.items():
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan is cut and any executor may be lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its rows measure at most ``BROADCAST_BYTES``."""
    size = F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)
    measured = df.agg(size.alias("n")).first()["n"] or 0
    return F.broadcast(df) if measured <= BROADCAST_BYTES else df

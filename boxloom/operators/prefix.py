"""Running totals that do not pass one key through one task.

A window over a hot key runs in a single task. Here rows are range-partitioned by (keys, order), the
ranges are frozen in a checkpoint, each range sums locally, and the totals of the earlier ranges
(one row per range and key) are added on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.session import cut


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums over ``order`` (which must be total) inside ``keys``.

    The input is written once before it is range-partitioned: choosing the range bounds reads it a
    second time, and that must not repeat the work above it.
    """
    held = cut(df).select("*", *[v.alias(f"_v_{n}") for n, v in sums.items()])
    ranged = cut(held.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums]
    )
    local = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = ranged.select("*", *[F.sum(f"_v_{n}").over(local).alias(f"_l_{n}") for n in sums])
    joined = inner.join(starts, [*keys, "_range"])
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums])

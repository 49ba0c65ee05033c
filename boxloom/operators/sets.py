"""Set comparisons between id, pair and row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_subset(df: DataFrame, removed: DataFrame, added: DataFrame, node: str = "id") -> DataFrame:
    return df.join(removed.select(node), node, "left_anti").unionByName(added)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (with multiplicity) on one side only, tagged with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def shared_ids(a: DataFrame, b: DataFrame, node: str = "id") -> DataFrame:
    """Ids in both sets; empty when they are disjoint."""
    return a.select(node).intersect(b.select(node))


def uncovered(instances: DataFrame, view_targets: DataFrame) -> DataFrame:
    """Instances no view shows, or none shows completely."""
    seen = view_targets.groupBy("instance_id").agg(F.max("visible_fraction").alias("best"))
    joined = instances.select("instance_id").join(seen, "instance_id", "left")
    problem = F.when(F.col("best").isNull(), "never_seen").when(F.col("best") < 1 - 1e-12, "never_complete")
    return joined.select("instance_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def annotation_signatures(objects: DataFrame, node: str, parts: list[str]) -> DataFrame:
    """Order-free digest of all annotations of a record.

    Row digests are summed (128 bits in two halves) with their count, so a record with very many
    annotations is a partial aggregate and not one long list.
    """
    row = F.sha2(F.to_json(F.struct(*parts)), 256)

    def half(start: int):
        return F.sum(F.conv(F.substring(row, start, 15), 16, 10).cast("decimal(38,0)"))

    return objects.groupBy(node).agg(
        F.concat_ws(":", F.count("*").cast("string"), half(1).cast("string"), half(16).cast("string")).alias("signature")
    )


def quarantine_conflicts(records: DataFrame, digest: str, signature: str, valid: str) -> DataFrame:
    """All copies of a digest whose signatures differ or of which one is invalid."""
    bad = records.groupBy(digest).agg(
        F.count_distinct(F.coalesce(signature, F.lit("none"))).alias("signatures"),
        F.count_if(~F.col(valid)).alias("invalid"), F.count("*").alias("copies"),
    ).filter((F.col("copies") > 1) & ((F.col("signatures") > 1) | (F.col("invalid") > 0)))
    return records.join(bad.select(digest), digest, "left_semi")


def list_digest(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Digest of the multiset of lines of each key, in any order: ``keys, n, digest``.

    SHA-256 of the number of lines and of four sums, each over 60 bits of the SHA-256 of every line. The sums are
    partial aggregates, so no line list is ever gathered, and the definition is the same at every size.
    """
    hashed = F.sha2(F.col(line), 256)
    sums = [F.sum(F.conv(F.substring(hashed, at, 15), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 16, 31, 46)]
    n = F.count("*")
    return df.groupBy(*keys).agg(n.alias("n"), F.sha2(F.concat_ws(":", n.cast("string"), *sums), 256).alias("digest"))


def list_digest_sql(line: str) -> str:
    """The digest of ``list_digest`` as an aggregate in SQL."""
    sums = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(sha256({line}), {at}, 15) AS BIGINT)) AS VARCHAR)" for at in (1, 16, 31, 46))
    return f"sha256(CAST(count(*) AS VARCHAR) || ':' || {sums})"


def dataset_fingerprint(files: DataFrame, keys: list[str]) -> DataFrame:
    """Order-insensitive digest of a file list: lines of path, NUL, digest, newline."""
    line = F.concat("path", F.decode(F.unhex(F.lit("00")), "UTF-8"), "sha256", F.lit("\n"))
    return list_digest(files.withColumn("_line", line), keys, "_line")

"""Exact copies by a 128-bit content hash, with the bytes compared inside every group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import small_side, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] = lower_ascii,
    digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows are grouped by the 128-bit ``digest`` of the normalised text. ``keep`` ("min" or "max") names
    the stable id that stays. Every member of a group of several rows is compared byte by byte with the
    row that would stay; a group in which one differs is grouped anew by its texts themselves.

    Only ids and digests are grouped, after a map-side partial aggregate, so a group with a third of all
    rows costs one row per task; the comparison is a join whose hot partitions adaptive execution splits.

    Defined results: a null text equals an empty one. A null id never stays while the group has another;
    a group of null ids only keeps them all (``keep_id`` null). Rows that repeat an id are one document:
    they count in ``group_size`` and share its verdict. Other columns of ``docs`` are ignored. An empty
    table gives no rows.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    norm = normalise(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).select("id", "norm", digest("norm").alias("h"))
    hashed = rows.select("id", "h", F.sha2("norm", 256).alias("sha"))
    groups = rows.groupBy("h").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = small_side(written(groups, "copies"), 100)
    # one text per group to compare with; two rows may carry the id that stays
    first = rows.join(groups, "h").filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("h").agg(F.min("norm").alias("first"))
    compared = rows.join(groups, "h").join(first, "h").select(
        "h", "id", "keep_id", "group_size", F.sha2("norm", 256).alias("sha"), (F.col("norm") == F.col("first")).alias("same")
    )
    compared = written(compared, "compared")
    single = hashed.join(groups.select("h"), "h", "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"
    )
    clash = written(compared.filter(~F.col("same")).select("h").distinct(), "clash")
    if clash.isEmpty():
        out = single.unionByName(compared.select("id", "keep_id", "group_size", "sha"))
    else:  # a collision: in its group the texts themselves are the key
        clash = small_side(clash, 60)
        sound = compared.join(clash, "h", "left_anti").select("id", "keep_id", "group_size", "sha")
        mixed = rows.join(clash, "h", "left_semi")
        parts = mixed.groupBy("norm").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
        settled = mixed.join(parts, "norm").select("id", "keep_id", "group_size", F.sha2("norm", 256).alias("sha"))
        out = single.unionByName(sound).unionByName(settled)
    return out.select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.

    A row is named by its id and the digest of its normalised text, so an id that stands for several texts loses only
    those that are copies. A repeated row of one id and text stays once; rows with a null id can't be named and all stay.
    Only ids and digests are shuffled, and of the texts those of repeated rows.
    """
    groups = exact_groups(docs, id_col, text_col, keep)
    gone = groups.filter(~F.col("kept")).select(F.col("id").alias("_gone_id"), F.col("text_sha256").alias("_gone_text")).distinct()
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.sha2(lower_ascii(F.col(text_col)), 256).alias("text"))
    one = (F.col("id") == F.col("_gone_id")) & (F.col("text") == F.col("_gone_text"))
    left = named.join(small_side(written(gone, "gone"), 90), one, "left_anti")
    again = named.filter("id IS NOT NULL").groupBy(F.col("id").alias("_again_id"), F.col("text").alias("_again_text")).count().filter("count > 1")
    again = small_side(written(again.drop("count"), "again"), 90)
    same = (F.col("id") == F.col("_again_id")) & (F.col("text") == F.col("_again_text"))
    repeated = left.join(again, same, "left_semi").dropDuplicates(["id", "text"])
    return left.join(again, same, "left_anti").unionByName(repeated).select("row.*")

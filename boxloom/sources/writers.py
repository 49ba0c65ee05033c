"""Dataset export, manifest ids, exclusive-create output and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.boxes import box, box_to_yolo
from boxloom.functions.text import safe_stem


def label_index(images: DataFrame, objects: DataFrame) -> DataFrame:
    """Export rows: one per image with its label text, SHA-256 and box count.

    Boxes below one pixel on a side are left out; images without boxes keep an empty label. Lines
    follow ``object_index``. ``images``: id, split, width, height; ``objects``: id, object_index,
    class_id, x1..y2.
    """
    size = images.select("id", "width", "height")
    kept = objects.join(size, "id").filter((box().width >= 1) & (box().height >= 1))
    parts = box_to_yolo(box(), F.col("width"), F.col("height"))
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", *[parts[c] for c in ("cx", "cy", "w", "h")])
    texts = kept.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("object_index", line.alias("line")))).alias("l")
    ).select("id", F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("label"), F.size("l").alias("boxes"))
    return images.join(texts, "id", "left").select(
        *images.columns, safe_stem(F.col("id").cast("string")).alias("stem"), F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce("boxes", F.lit(0)).alias("boxes"), F.sha2(F.coalesce("label", F.lit("")), 256).alias("label_sha256"),
    )


def stem_collisions(index: DataFrame) -> DataFrame:
    return index.groupBy(F.lower("stem").alias("stem")).agg(F.count("*").alias("n")).filter("n > 1")


def write_dataset(index: DataFrame, path: str) -> None:
    """Write the export once, one folder per split: the index as Parquet, the labels as text."""
    index.drop("label").write.mode("errorifexists").partitionBy("split").parquet(f"{path}/index")
    lines = index.select("split", F.to_json(F.struct("stem", "label")).alias("value"))
    lines.write.mode("errorifexists").partitionBy("split").text(f"{path}/labels")


def split_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("split").agg(F.count("*").alias("images"), F.sum("boxes").alias("boxes"))


def materialize(manifest: DataFrame) -> DataFrame:
    """Stable ids from path and bytes; a repeated id makes the query fail.

    ``manifest``: path, sha256.
    """
    ident = F.concat_ws("_", F.substring(F.sha2("path", 256), 1, 16), F.substring("sha256", 1, 12))
    rows = manifest.withColumn("id", ident)
    repeated = rows.groupBy("id").agg(F.count("*").alias("_n"))
    guard = F.when(F.col("_n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("id collision: "), F.col("id"))))
    return rows.join(repeated, "id").withColumn("id", guard).drop("_n")


def write_once(df: DataFrame, path: str) -> None:
    """Create the output or fail; an existing one is never replaced."""
    df.write.mode("errorifexists").parquet(path)


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """A metric table (already aggregated) as one CSV file with a header."""
    df.coalesce(1).write.mode("errorifexists").csv(path, header=True)


def write_archive(docs: DataFrame, path: str) -> None:
    """Documents (``path``, ``content``) as rows of a few large files, which ``annotations.archived_text`` reads."""
    docs.select(F.col("path").cast("string").alias("path"), "content").write.option("compression", "zstd").parquet(path)

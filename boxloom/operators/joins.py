"""Pairing, mapping, inventory and evidence joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.functions.boxes import box, box_clip, visible_fraction
from boxloom.operators.spatial import overlap_join, points_in_boxes, prefixed


def pair_files(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images and labels by ``stem``: paired, missing on a side, or ambiguous."""
    a = images.groupBy("stem").agg(F.count("*").alias("images"), F.min("path").alias("image"))
    b = labels.groupBy("stem").agg(F.count("*").alias("labels"), F.min("path").alias("label"))
    both = a.join(b, "stem", "full_outer").na.fill(0, ["images", "labels"])
    status = (
        F.when((F.col("images") > 1) | (F.col("labels") > 1), "ambiguous").when(F.col("labels") == 0, "label_missing")
        .when(F.col("images") == 0, "image_missing").otherwise("paired")
    )
    return both.select("stem", "images", "labels", "image", "label", status.alias("status"))


def apply_class_map(annotations: DataFrame, class_map: DataFrame, overrides: DataFrame) -> DataFrame:
    """Target of every annotation: its own override, else the map of its source and native name.

    The map is a dimension and the overrides are few; Spark broadcasts either only while its size
    allows it. ``mapping`` says which one applied, ``unmapped`` when neither did.
    """
    m = class_map.select("source", "native", F.col("target").alias("m_target"), F.col("status").alias("m_status"))
    o = overrides.select(
        "record_id", "native_index", F.col("target").alias("o_target"), F.col("status").alias("o_status"), "reason"
    )
    joined = annotations.join(m, ["source", "native"], "left").join(o, ["record_id", "native_index"], "left")
    overridden = F.col("o_target").isNotNull()
    return joined.select(
        *annotations.columns,
        F.coalesce("o_target", "m_target").alias("target"),
        F.when(overridden, F.col("o_status")).otherwise(F.col("m_status")).alias("status"),
        F.when(overridden, "override").when(F.col("m_target").isNotNull(), "map").otherwise("unmapped").alias("mapping"),
        F.when(overridden, F.col("reason")).alias("reason"),
    )


def override_errors(annotations: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides without a reason or without an annotation."""
    unused = overrides.join(annotations, ["record_id", "native_index"], "left_anti").withColumn("error", F.lit("unused"))
    bare = overrides.filter(F.coalesce(F.trim("reason"), F.lit("")) == "").withColumn("error", F.lit("no_reason"))
    return unused.unionByName(bare).select("record_id", "native_index", "error")


def unknown_natives(annotations: DataFrame, class_map: DataFrame) -> DataFrame:
    return annotations.select("source", "native").distinct().join(class_map, ["source", "native"], "left_anti")


def clip_objects(crops: DataFrame, objects: DataFrame, cell: int = 256) -> DataFrame:
    """Objects that show in a crop, clipped to it, with the visible share of their area.

    ``crops``: image_id, view_id, x1..y2; ``objects``: image_id, instance_id, x1..y2 and more.
    """
    views = prefixed(crops, "c_", ["image_id"])
    pairs = overlap_join(objects, views, ["image_id"], "", "c_", cell)
    crop = box("c_")
    clipped = box_clip(box(), crop)
    keep = [c for c in objects.columns if c not in ("x1", "y1", "x2", "y2")]
    more = [F.col(c).alias(c[2:]) for c in views.columns if c.startswith("c_") and c[2:] not in ("x1", "y1", "x2", "y2")]
    return pairs.select(
        *keep, *more, visible_fraction(box(), crop).alias("visible_fraction"), *clipped.columns(),
        *box().columns("o_"), *crop.columns("c_"),
    )


def pick_at(points: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box that holds each click (ties by box id); NULL when none does."""
    once = boxes.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.min("box_id").alias("box_id"))
    hits = points_in_boxes(points, once, keys)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    best = hits.groupBy("point_id").agg(F.min(F.struct(area.alias("area"), F.col("box_id"))).alias("b"))
    return points.select("point_id").join(best, "point_id", "left").select(
        "point_id", F.col("b.box_id").alias("box_id"), F.col("b.area").alias("area")
    )


def follow(previous: DataFrame, current: DataFrame, keys: list[str], reach: float = 80.0) -> DataFrame:
    """Nearest current centre of the same class within ``reach`` on both axes of a previous one.

    Both sides meet in square cells of that width: a previous centre looks into its 3 x 3
    neighbourhood and the band test decides.
    """
    def cell(v):
        return F.floor(v / reach).cast("long")

    p = previous.withColumn("_cx", F.explode(F.sequence(cell(F.col("px")) - 1, cell(F.col("px")) + 1)))
    p = p.withColumn("_cy", F.explode(F.sequence(cell(F.col("py")) - 1, cell(F.col("py")) + 1)))
    once = current.groupBy(*keys, "class_id", "cx", "cy").agg(F.min("current_id").alias("current_id"))
    c = once.withColumn("_cx", cell(F.col("cx"))).withColumn("_cy", cell(F.col("cy")))
    dx, dy = F.col("cx") - F.col("px"), F.col("cy") - F.col("py")
    near = p.join(c, [*keys, "class_id", "_cx", "_cy"]).filter((F.abs(dx) <= reach) & (F.abs(dy) <= reach))
    best = near.groupBy("previous_id").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), F.col("current_id"))).alias("b"))
    return previous.select("previous_id").join(best, "previous_id", "left").select(
        "previous_id", F.col("b.current_id").alias("current_id"), F.col("b.d2").alias("distance_sq")
    )


def diff_inventory(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing, unexpected, changed and equal files by path and digest."""
    a = expected.select("path", F.col("sha256").alias("expected"))
    b = actual.select("path", F.col("sha256").alias("actual"))
    both = a.join(b, "path", "full_outer")
    status = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected")
        .when(F.col("expected") != F.col("actual"), "changed").otherwise("equal")
    )
    return both.select("path", status.alias("status"))


def check_bindings(files: DataFrame, records: DataFrame) -> DataFrame:
    """Per document: recorded hashes that hold, differ, or name a file that is not there."""
    f = files.select("path", F.col("sha256").alias("actual"))
    joined = records.join(f, "path", "left")
    return joined.groupBy("document").agg(
        F.count_if(F.col("actual") == F.col("sha256")).alias("bound"),
        F.count_if(F.col("actual") != F.col("sha256")).alias("changed"),
        F.count_if(F.col("actual").isNull()).alias("absent"),
    )


def actual_epochs(callbacks: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Callback rows of logged epochs, and the spurious rest."""
    known = log.select("run", "epoch").distinct()
    return callbacks.join(known, ["run", "epoch"], "left_semi"), callbacks.join(known, ["run", "epoch"], "left_anti")


def object_completeness(source: DataFrame, records: DataFrame) -> DataFrame:
    """Every source object is recorded exactly once, as a target or as an excluded one."""
    a = source.groupBy("image_id", "source_index").agg(F.count("*").alias("in_source"))
    b = records.groupBy("image_id", "source_index").agg(
        F.count("*").alias("in_records"), F.count_if("is_target").alias("targets")
    )
    both = a.join(b, ["image_id", "source_index"], "full_outer").na.fill(0, ["in_source", "in_records", "targets"])
    one = (F.col("in_source") == 1) & (F.col("in_records") == 1)
    return both.groupBy("image_id").agg(
        F.count_if(one & (F.col("targets") == 1)).alias("targets"), F.count_if(one & (F.col("targets") == 0)).alias("excluded"),
        F.count_if(~one).alias("broken"),
    )


def paired_deltas(a: DataFrame, b: DataFrame, keys: list[str], value: str, budget: str) -> DataFrame:
    """Value of ``b`` minus ``a`` for equal keys, and whether both had the same budget."""
    right = b.select(*keys, F.col(value).alias("_v"), F.col(budget).alias("_b"))
    return a.join(right, keys).select(
        *keys, (F.col("_v") - F.col(value)).alias("delta"), (F.col("_b") == F.col(budget)).alias("equal_budget")
    )

"""Masks as run-length rows ``image_id, instance, y, x_start, x_end`` (half-open pixel spans).

A run that goes on over several rows may say so once, with ``y_end`` (half-open, ``y + 1`` without it). Masks are never
rasterised: intersections are those of such rectangles, as arrays where a group has up to ``matching.CROWD`` runs, else by joins on (image, cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxloom.operators import matching
from boxloom.operators.grouped import mask_groups
from boxloom.operators.matching import deal, suppressed
from boxloom.session import cut

CELL = 64


def area() -> Column:
    """Pixels of a run with ``y_end``."""
    return ((F.col("x_end") - F.col("x_start")) * (F.col("y_end") - F.col("y"))).cast("long")


def box_runs(boxes: DataFrame, keep: list[str]) -> DataFrame:
    """Runs of axis-aligned boxes with integer corners, one per box."""
    return boxes.filter((F.col("y2") > F.col("y1")) & (F.col("x2") > F.col("x1"))).select(
        *keep, *(F.col(c).cast("int").alias(n) for c, n in (("y1", "y"), ("y2", "y_end"), ("x1", "x_start"), ("x2", "x_end")))
    )


def _tall(runs: DataFrame) -> DataFrame:
    return runs if "y_end" in runs.columns else runs.withColumn("y_end", F.col("y") + 1)


def _celled(runs: DataFrame) -> DataFrame:
    """One row per cell that a run touches."""
    def span(lo, hi):
        return F.explode(F.sequence(F.floor(F.col(lo) / CELL).cast("int"), F.floor((F.col(hi) - 1) / CELL).cast("int")))

    return runs.withColumn("_cx", span("x_start", "x_end")).withColumn("_cy", span("y", "y_end"))


def run_overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping run pieces of ``a`` and ``b`` (columns of ``b`` prefixed ``b_``) with ``pixels``."""
    right = _celled(_tall(b))
    right = right.select(*[F.col(c) if c in keys or c in ("_cx", "_cy") else F.col(c).alias("b_" + c) for c in right.columns])
    (left, right_end), (top, bottom) = (
        (F.greatest(lo, "b_" + lo), F.least(hi, "b_" + hi)) for lo, hi in (("x_start", "x_end"), ("y", "y_end"))
    )
    pairs = _celled(_tall(a)).join(right, [*keys, "_cx", "_cy"]).filter((right_end > left) & (bottom > top))
    # a piece that spans cells is counted once, in the cell of its first corner
    once = (F.floor(left / CELL) == F.col("_cx")) & (F.floor(top / CELL) == F.col("_cy"))
    return pairs.filter(once).withColumn("pixels", ((right_end - left) * (bottom - top)).cast("long"))


def mask_iou_pairs(a: DataFrame, b: DataFrame, keys: list[str], self_join: bool = False, least: float = 0.0) -> DataFrame:
    """IoU, at least ``least``, of every overlapping (instance, b_instance); ``self_join`` keeps unordered pairs once. Instances are whole numbers.

    Runs of a group meet once, in one task, and only pairs leave it; larger groups are joined by cells.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    corners = {"x1": "x_start", "y1": "y", "x2": "x_end", "y2": "y_end"}
    sides = [
        _tall(runs).select(*keys, F.lit(side).alias("_truth"), F.col("instance").cast("long").alias("_index"), *[F.when(known, F.col(c).cast("double")).alias(n) for n, c in corners.items()])
        for side, runs in ((True, b), (False, a))
    ]
    both = sides[0].unionByName(sides[1])
    names, crowd = both.columns, matching.CROWD
    schema = StructType([*both.schema, *StructType.fromDDL("b_index long, iou double, _settled boolean")])
    dealt = deal(both, keys, [F.col("_truth").desc(), F.col("_index")])
    found = cut(dealt.mapInArrow(lambda rows: mask_groups(rows, names, self_join, least, crowd), schema))
    kinds = [runs.schema["instance"].dataType for runs in (a, b)]
    pairs = found.filter("_settled").select(*keys, F.col("_index").cast(kinds[0]).alias("instance"), F.col("b_index").cast(kinds[1]).alias("b_instance"), "iou")
    left = found.filter("NOT _settled")
    if left.isEmpty():
        return pairs
    runs = [
        left.filter(F.col("_truth") == side).select(*keys, F.col("_index").cast(kind).alias("instance"), *[F.col(n).cast("int").alias(c) for n, c in corners.items()])
        for side, kind in zip((False, True), kinds, strict=True)
    ]
    return pairs.unionByName(_spread_pairs(*runs, keys, self_join).filter(F.col("iou") >= least))


def _spread_pairs(a: DataFrame, b: DataFrame, keys: list[str], self_join: bool) -> DataFrame:
    """``mask_iou_pairs`` by cells, for groups of any size."""
    pairs = run_overlaps(a, b, keys)
    if self_join:
        pairs = pairs.filter(F.col("instance") < F.col("b_instance"))
    inter = pairs.groupBy(*keys, "instance", "b_instance").agg(F.sum("pixels").alias("inter"))
    area_a = _tall(a).groupBy(*keys, "instance").agg(F.sum(area()).alias("area"))
    area_b = _tall(b).groupBy(*keys, F.col("instance").alias("b_instance")).agg(F.sum(area()).alias("b_area"))
    joined = inter.join(area_a, [*keys, "instance"]).join(area_b, [*keys, "b_instance"])
    return joined.select(
        *keys, "instance", "b_instance",
        (F.col("inter") / (F.col("area") + F.col("b_area") - F.col("inter"))).alias("iou"),
    )


def mask_nms(instances: DataFrame, runs: DataFrame, iou: float = 0.6) -> DataFrame:
    """Drop an instance whose mask overlaps a kept, higher-scored one of its class by >= ``iou``.

    ``instances``: image_id, class_id, instance, score (ties by instance); ``runs`` carry the same
    keys. Nothing is merged.
    """
    keys = ["image_id", "class_id"]
    pairs = mask_iou_pairs(runs, runs, keys, self_join=True).filter(F.col("iou") >= iou)
    s = instances.select(*keys, "instance", "score")
    scored = pairs.join(s, [*keys, "instance"]).join(
        s.select(*keys, F.col("instance").alias("b_instance"), F.col("score").alias("b_score")), [*keys, "b_instance"]
    )
    # the pair's lower instance wins equal scores
    first = F.col("score") >= F.col("b_score")
    edges = scored.select(
        *keys, F.when(first, F.col("instance")).otherwise(F.col("b_instance")).alias("pred_index"),
        F.greatest("score", "b_score").alias("score"), F.when(first, F.col("b_instance")).otherwise(F.col("instance")).alias("lower"),
    )
    removed = suppressed(edges, keys)
    return instances.join(removed.withColumnRenamed("pred_index", "instance"), [*keys, "instance"], "left_anti")


def _pieces(runs: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """The runs clipped to cells and cut at the ends of all runs of their cell: any two of the result coincide or are disjoint.

    Rows meet once, by (keys, cell). A cell has at most ``CELL`` + 1 cuts either way, however many runs it holds.
    """
    cell = [*keys, "_cx", "_cy"]
    runs = _celled(_tall(runs))
    clip = [(F.greatest(lo, F.col(at) * CELL).alias(lo), F.least(hi, (F.col(at) + 1) * CELL).alias(hi)) for at, lo, hi in (("_cx", "x_start", "x_end"), ("_cy", "y", "y_end"))]
    runs = runs.select(*cell, *kept, *clip[0], *clip[1]).repartition(*cell)
    for lo, hi, inside in (("y", "y_end", cell), ("x_start", "x_end", [*cell, "y", "y_end"])):
        w = W.partitionBy(*inside)
        ends = F.array_sort(F.array_union(F.collect_set(lo).over(w), F.collect_set(hi).over(w)))
        mine = F.filter("_ends", lambda v: (v >= F.col(lo)) & (v <= F.col(hi)))  # noqa: B023
        parts = F.zip_with(F.slice("_mine", 1, F.size("_mine") - 1), F.slice("_mine", 2, F.size("_mine") - 1), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
        runs = runs.withColumn("_ends", ends).withColumn("_mine", mine).withColumn("_part", F.explode(parts))
        runs = runs.withColumn(lo, F.col("_part.s")).withColumn(hi, F.col("_part.e")).drop("_ends", "_mine", "_part")
    return runs


PIECE = ["_cx", "_cy", "y", "y_end", "x_start", "x_end"]


def _owner() -> Column:
    return F.struct("score", (-F.col("instance")).alias("order"), "class_id")


def paint(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Give every pixel to the run with the highest score, the earlier instance on a tie.

    ``runs``: keys, y, x_start, x_end, class_id, score, instance, maybe y_end. Each cell of an image is cut at
    all run ends; every elementary piece takes the best run over it.
    """
    pieces = _pieces(runs, keys, ["class_id", "score", "instance"])
    return pieces.groupBy(*keys, *PIECE).agg(F.max(_owner()).alias("o")).select(
        *keys, *PIECE[2:], F.col("o.class_id").alias("class_id"), (-F.col("o.order")).alias("instance")
    )


def confusion(gt_runs: DataFrame, pred_runs: DataFrame, pixels: DataFrame, classes: int) -> DataFrame:
    """Pixel confusion of two sets of runs, each painted as ``paint`` does; class 0 is what no run covers.

    Both are cut and painted in one pass. ``pixels`` has one column ``total``. Rows: gt_class, pred_class, n.
    """
    names = ["class_id", "score", "instance"]
    rows = [
        _tall(runs).select("image_id", "y", "y_end", "x_start", "x_end", F.col("class_id").cast("int").alias("class_id"),
                           F.col("score").cast("double").alias("score"), F.col("instance").cast("long").alias("instance"), F.lit(side).alias("truth"))
        for runs, side in ((gt_runs, True), (pred_runs, False))
    ]
    pieces = _pieces(rows[0].unionByName(rows[1]), ["image_id"], [*names, "truth"])
    owned = pieces.groupBy("image_id", *PIECE).agg(F.max(F.when(F.col("truth"), _owner())).alias("g"), F.max(F.when(~F.col("truth"), _owner())).alias("p"))
    zero = F.lit(0)
    both = owned.groupBy(F.coalesce("g.class_id", zero).alias("gt_class"), F.coalesce("p.class_id", zero).alias("pred_class")).agg(F.sum(area()).alias("n"))
    both = cut(both)  # at most classes x classes rows, read twice below
    covered = both.agg(F.sum("n").alias("covered"))
    empty = pixels.join(covered, F.lit(True)).select(
        zero.alias("gt_class"), zero.alias("pred_class"), (F.col("total").cast("long") - F.coalesce("covered", zero)).alias("n")
    )
    grid = pixels.select(F.explode(F.sequence(zero, F.lit(classes - 1))).alias("gt_class")).select(
        "gt_class", F.explode(F.sequence(zero, F.lit(classes - 1))).alias("pred_class"), zero.cast("long").alias("n")
    )
    return both.unionByName(empty).unionByName(grid).groupBy("gt_class", "pred_class").agg(F.sum("n").alias("n"))


def class_iou(table: DataFrame) -> DataFrame:
    """IoU per class (NULL when the class is absent on both sides) from a confusion table."""
    diag = F.col("gt_class") == F.col("pred_class")
    as_gt = table.select(F.col("gt_class").alias("class_id"), F.col("n").alias("gt"), F.lit(0).alias("pred"),
                         F.when(diag, F.col("n")).otherwise(0).alias("hit"))
    as_pred = table.select(F.col("pred_class").alias("class_id"), F.lit(0).alias("gt"), F.col("n").alias("pred"),
                           F.lit(0).alias("hit"))
    sums = as_gt.unionByName(as_pred).groupBy("class_id").agg(*[F.sum(c).alias(c) for c in ("gt", "pred", "hit")])
    union = F.col("gt") + F.col("pred") - F.col("hit")
    return sums.select("class_id", F.when(union > 0, F.col("hit") / union).alias("iou"))


def pixel_summary(table: DataFrame) -> DataFrame:
    """Pixel accuracy and the mean IoU over the foreground classes that occur."""
    table = cut(table)  # classes x classes rows, read twice below
    iou = class_iou(table).filter(F.col("class_id") > 0).agg(F.avg("iou").alias("m")).scalar()
    right = F.sum(F.when(F.col("gt_class") == F.col("pred_class"), F.col("n")).otherwise(0))
    return table.agg((right / F.sum("n")).alias("pixel_accuracy")).select("pixel_accuracy", iou.alias("foreground_miou"))

"""The taxonomy and paired outcomes compute the matching and the predictions once."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.operators import errors as er
from boxloom.operators import matching as mt


def boxes(seed, n, index, **more):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(300), rng.randrange(150)
        rows.append({"image_id": i % 3, "class_id": rng.randrange(2), index: i, "x1": float(x), "y1": float(y), "x2": x + 150.0, "y2": y + 130.0,
                     **{k: v(rng) for k, v in more.items()}})
    return rows


BOX = "x1 double, y1 double, x2 double, y2 double"


def data(spark):
    gt = spark.createDataFrame(boxes(1, 30, "gt_index"), f"image_id long, class_id int, gt_index int, {BOX}")
    pred = spark.createDataFrame(boxes(2, 40, "pred_index", score=lambda r: r.randrange(9) / 10), f"image_id long, class_id int, pred_index int, {BOX}, score double")
    return gt, pred


def test_matched_pairs_are_the_matches(spark):
    gt, pred = data(spark)
    for tie in ("last", "first"):
        want = {(r.image_id, r.class_id, r.pred_index, r.gt_index, r.iou) for r in mt.greedy_match(pred, gt, tie=tie).collect() if r.gt_index is not None}
        got = [tuple(r) for r in mt.matched_pairs(pred, gt, tie=tie).collect()]
        assert want and len(got) == len(want) and set(got) == want


def test_taxonomy_reads_written_rows(spark):
    """What lies above the predictions (here a window) is not in the plan of the result."""
    gt, pred = data(spark)
    pred = pred.withColumn("n", F.count("*").over(W.partitionBy("image_id", "score")))
    ex = gt.select("image_id", F.lit("unknown").alias("source_type"), F.col("gt_index").alias("source_index"), "x1", "y1", "x2", "y2").limit(4)
    matches = mt.greedy_match(pred, gt)
    rows = er.fp_taxonomy(matches, pred.filter("n > 0"), gt, ex)
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    false = {r.pred_index for r in matches.collect() if r.gt_index is None}
    assert false and {r.pred_index for r in rows.collect()} == false

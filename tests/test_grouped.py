"""Groups matched as arrays inside tasks, next to groups that are spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from boxloom.operators import grouped
from boxloom.operators import matching as mt
from tests import brute


@pytest.fixture
def small_batches(spark, monkeypatch):
    """Groups lie across the batches of a task."""
    monkeypatch.setattr(grouped, "ROWS", 8)
    monkeypatch.setattr(grouped, "COMPARED", 4)
    monkeypatch.setattr(grouped, "PRODUCTS", 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("tie", ["last", "first"])
def test_groups_are_settled_inside_tasks(spark, monkeypatch, small_batches, tie):
    monkeypatch.setattr(mt, "settle", None)  # the distributed rounds take no part
    preds, gts = brute.scene(random.Random(17), images=9)
    p, g = brute.frames(spark, preds, gts)
    rows = mt.greedy_match(p, g, [0.4, 0.7], tie=tie, ranked=True).collect()
    assert len(rows) == 2 * len(preds)
    for level in (0.4, 0.7):
        assert {(r.image_id, r.class_id, r.pred_index): r.gt_index for r in rows if r.iou_level == level} == brute.match(preds, gts, level, tie)


@pytest.mark.parametrize("crowd", [3, 9, 12])
def test_crowds_stand_beside_groups(spark, monkeypatch, small_batches, crowd):
    """Some groups are larger than ``CROWD``; their rows meet the distributed operators, with the same caps and ranks."""
    preds, gts = brute.scene(random.Random(23), images=5)
    p, g = brute.frames(spark, preds, gts)
    run = lambda: (
        sorted(map(str, mt.greedy_match(p, g, ranked=True).collect())), sorted(map(str, mt.coco_match(p, g, [0.5, 0.6], 4).collect())),
        sorted(map(str, mt.coco_hits(p, g, [0.5, 0.6], 4).collect())), sorted(map(str, mt.matched_pairs(p, g).collect())),
    )
    whole = run()
    monkeypatch.setattr(mt, "CROWD", crowd)
    assert run() == whole


def test_missing_keys_meet_nothing(spark):
    p, g = brute.frames(spark, [(0, 0, 0, 0.9, (0.0, 0.0, 9.0, 9.0)), (0, 0, 1, 0.8, (0.0, 0.0, 9.0, 9.0))], [(0, 0, 0, (0.0, 0.0, 9.0, 9.0))])
    none = lambda df: df.withColumn("class_id", F.lit(None).cast("int"))
    assert [r.gt_index for r in mt.greedy_match(none(p), none(g)).collect()] == [None, None]


def test_tables_dealt_by_image_are_not_shuffled_again(spark, folder, monkeypatch):
    """The windows that number the boxes of an image deal them; the matching finds them there."""
    from boxloom.plans.derive import Tables

    plans = []
    plain_cut = mt.cut
    monkeypatch.setattr(mt, "cut", lambda df: (plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")), plain_cut(df))[1])
    t = Tables(spark, folder)
    assert mt.greedy_match(t.pred(), t.gt()).count() == 2 * t.gt().count()
    assert len(plans) == 1 and plans[0].count("Exchange") == 2 and plans[0].count("Window ") == 3


def test_given_pairs_match_as_boxes_do(spark, monkeypatch, small_batches):
    preds, gts = brute.scene(random.Random(31), images=6)
    p, g = brute.frames(spark, preds, gts)
    pairs = mt.match_candidates(p, g, 0.1).select(*mt.GROUP, "pred_index", F.col("g_gt_index").alias("gt_index"), "iou")
    want = sorted(map(str, mt.coco_hits(p, g, [0.3, 0.6], 9).collect()))
    assert sorted(map(str, mt.coco_hits(p, g, [0.3, 0.6], 9, pairs=pairs).collect())) == want
    monkeypatch.setattr(mt, "CROWD", 8)
    assert sorted(map(str, mt.coco_hits(p, g, [0.3, 0.6], 9, pairs=pairs).collect())) == want


@pytest.mark.parametrize("key", ["ag4", "ag13", "ag5", "mt3", "dq6_full"])
def test_queries_settle_groups_and_blocks(spark, folder, monkeypatch, key):
    """Small blocks of predictions, no distributed rounds and no running sums of predictions; rows as the SQL gives them."""
    import __spark_entry__ as entry
    from boxloom.operators import metrics as ag
    from tests.compare import compare, duck

    monkeypatch.setattr(mt, "settle", None)
    monkeypatch.setattr(ag, "running", None)
    monkeypatch.setattr(ag, "BLOCK", 7)
    monkeypatch.setattr(ag, "HELD", 50)
    n, problem = compare(entry.queries()[key](spark, folder), entry.oracle_sql()[key], duck(folder))
    assert n and problem is None


def test_ap_of_hits_at_every_level(spark, monkeypatch):
    """Missing names of a group and blocks of one prediction; levels without a hit count as 0."""
    from boxloom.operators import metrics as ag

    preds, gts = brute.scene(random.Random(41), images=4)
    p, g = brute.frames(spark, preds, gts)
    hits = mt.coco_hits(p, g, [0.5, 0.99], 3).withColumn("site", F.when(F.col("image_id") > 0, F.col("image_id").cast("string")))
    npos = ag.truth_counts(g.withColumn("site", F.when(F.col("image_id") > 0, F.col("image_id").cast("string"))), ["site"])
    run = lambda: sorted(map(str, ag.ap_by_level(hits, npos, ["site"], [0.5, 0.99], (2, 3)).collect()))
    whole = run()
    monkeypatch.setattr(ag, "BLOCK", 1)
    assert run() == whole and any("ap=0.0" in r for r in whole)


def test_groups_of_copies_are_settled_apart(monkeypatch):
    """Every pair of a group of copies is a candidate; a batch of such groups is never held at once."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(grouped, "PRODUCTS", 100)
    truth = np.tile(np.repeat([True, False], [8, 9]), 6)
    rows = pa.record_batch({"_first": pa.array(np.arange(len(truth)) % 17 == 0), "_truth": pa.array(truth)})
    parts = list(grouped.whole_groups(iter([rows]), 100))
    assert [p.num_rows for p, _ in parts] == [17] * 6 and not any(crowded for _, crowded in parts)

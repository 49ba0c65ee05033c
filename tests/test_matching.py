import random

import pytest

from boxloom.operators import matching as mt
from boxloom.operators import metrics as ag
from tests import brute

BOX = (0.0, 0.0, 10.0, 10.0)


def matched(df):
    return {(r.image_id, r.class_id, r.pred_index): r.gt_index for r in df.collect()}


def one_image(spark, preds, gts):
    return brute.frames(spark, [(0, c, i, s, b) for i, (c, s, b) in enumerate(preds)], [(0, c, i, b) for i, (c, b) in enumerate(gts)])


@pytest.mark.parametrize("tie,expected", [("last", 1), ("first", 0)])
def test_equal_overlap_tie(spark, tie, expected):
    p, g = one_image(spark, [(0, 0.9, BOX)], [(0, BOX), (0, BOX)])
    assert matched(mt.greedy_match(p, g, tie=tie)) == {(0, 0, 0): expected}


def test_duplicate_and_wrong_class(spark):
    p, g = one_image(spark, [(0, 0.9, BOX), (0, 0.8, BOX), (1, 0.7, BOX)], [(0, BOX)])
    row = ag.operating_point(mt.greedy_match(p, g), g).filter("class_id IS NULL").first()
    assert (row.tp, row.fp, row.fn) == (1, 2, 0)


def test_iou_exactly_half_matches(spark):
    p, g = one_image(spark, [(0, 0.9, (0.0, 0.0, 10.0, 5.0))], [(0, BOX)])
    assert matched(mt.greedy_match(p, g)) == {(0, 0, 0): 0}


def test_score_at_threshold_is_kept(spark):
    p, g = one_image(spark, [(0, 0.5, BOX)], [(0, BOX)])
    assert ag.operating_point(mt.greedy_match(p, g), g, 0.5).filter("class_id IS NULL").first().tp == 1


@pytest.mark.parametrize("tie", ["last", "first"])
@pytest.mark.parametrize("rounds", [0, 2, 6])
def test_random_scenes_equal_brute_force(spark, monkeypatch, tie, rounds):
    """No rounds: every contested component is folded."""
    monkeypatch.setattr(mt, "ROUNDS", rounds)
    preds, gts = brute.scene(random.Random(7), images=4)
    p, g = brute.frames(spark, preds, gts)
    assert matched(mt.greedy_match(p, g, tie=tie)) == brute.match(preds, gts, tie=tie)


def test_rounds_shuffle_pairs_once_and_crowds_apart(spark, monkeypatch):
    """All rounds of ordinary groups are one job whose windows find the pairs in place; crowded groups give the same pairs."""
    rng = random.Random(5)
    box = lambda: (x := rng.randrange(30), y := rng.randrange(30), x + 20, y + 20)
    gts = spark.createDataFrame([(i, k, 0, *map(float, box())) for i in range(3) for k in range(12)], "image_id int, gt_index int, class_id int, x1 double, y1 double, x2 double, y2 double")
    preds = spark.createDataFrame(
        [(i, k, 0, rng.random(), *map(float, box())) for i in range(3) for k in range(24)],
        "image_id int, pred_index int, class_id int, score double, x1 double, y1 double, x2 double, y2 double",
    )
    plans, plain_cut = [], mt.cut

    def noted(df):
        if "_settled" in df.columns:
            plans.append(spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple"))
        return plain_cut(df)

    monkeypatch.setattr(mt, "cut", noted)
    run = lambda: sorted(map(str, mt.greedy_match(preds, gts, [0.3, 0.5, 0.7]).collect()))
    common = run()
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(mt, "CROWD", 20)
    assert run() == common and len(common) == 3 * 72


@pytest.mark.parametrize("rounds", [0, 6])
def test_levels_ranks_and_bits(spark, monkeypatch, rounds):
    monkeypatch.setattr(mt, "ROUNDS", rounds)
    preds, gts = brute.scene(random.Random(3), images=2, n_gt=9, n_pred=20)
    p, g = brute.frames(spark, preds, gts)
    levels = [0.5, 0.75]
    rows = mt.greedy_match(p, g, levels, ranked=True).collect()
    for t in levels:
        assert {(r.image_id, r.class_id, r.pred_index): r.gt_index for r in rows if r.iou_level == t} == brute.match(preds, gts, t)
    by_group = {}
    for im, c, i, s, _ in sorted(preds, key=lambda x: (-x[3], x[2])):
        by_group.setdefault((im, c), []).append(i)
    assert all(by_group[r.image_id, r.class_id][r["rank"] - 1] == r.pred_index for r in rows)
    bits = {(r.image_id, r.class_id, r.pred_index): r.hits for r in mt.coco_hits(p, g, levels).collect()}
    want = {}
    for k, t in enumerate(levels):
        for key, gt in brute.match(preds, gts, t).items():
            want[key] = want.get(key, 0) + ((gt is not None) << k)
    assert bits == want


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_nms_equals_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(mt, "ROUNDS", rounds)
    preds, _ = brute.scene(random.Random(11), images=3, n_gt=3, n_pred=25)
    p, _ = brute.frames(spark, preds, [(0, 0, 0, BOX)])
    kept = {(r.image_id, r.class_id, r.pred_index) for r in mt.nms(p).collect()}
    assert kept == brute.suppress(preds)


def test_nms_cap_and_strict_limit(spark):
    p, _ = one_image(spark, [(0, 0.9, BOX), (0, 0.8, (0.0, 0.0, 10.0, 5.0)), (1, 0.7, BOX)], [(0, BOX)])
    assert mt.nms(p).count() == 3  # IoU of exactly .5 stays, classes do not touch each other
    assert mt.nms(p, cap=2).count() == 2


def test_crowded_image(spark):
    """One image holds all rows; each overlap is settled on its own."""
    rng = random.Random(5)
    gts = [(0, 0, i, (x := rng.randrange(2000), y := rng.randrange(2000)) and (float(x), float(y), x + 20.0, y + 20.0)) for i in range(400)]
    preds = [(0, 0, i, rng.random(), tuple(v + 1 for v in g[3])) for i, g in enumerate(gts)]
    p, g = brute.frames(spark, preds, gts)
    a = matched(mt.greedy_match(p, g))
    assert a == brute.match(preds, gts) and sum(v is not None for v in a.values()) >= 399


def test_long_chains_are_folded(spark):
    """Copies of one box take one truth a round; the component fold ends it."""
    p, g = one_image(spark, [(0, 0.9, BOX)] * 30, [(0, BOX)] * 25)
    got = matched(mt.greedy_match(p, g))
    assert got == {(0, 0, i): 24 - i if i < 25 else None for i in range(30)}
    steps = [(0, 1 - i / 100, (float(4 * i), 0.0, 4.0 * i + 10, 10.0)) for i in range(40)]
    p, _ = one_image(spark, steps, [(0, BOX)])
    assert {r.pred_index for r in mt.nms(p, iou=0.3).collect()} == set(range(0, 40, 2))


# ---------------------------------------------------------------- average precision


def perfect(spark, n):
    boxes = [(float(20 * i), 0.0, 20.0 * i + 10, 10.0) for i in range(n)]
    return one_image(spark, [(0, 1 - i / 1000, b) for i, b in enumerate(boxes)], [(0, b) for b in boxes])


def test_dense_image_needs_the_larger_cap(spark):
    p, g = perfect(spark, 150)
    rows = ag.coco_ap(mt.coco_match(p, g), ag.truth_counts(g)).filter("class_id IS NULL").collect()
    assert {r.max_det: round(r.ap50_95, 12) for r in rows} == {100: round(67 / 101, 12), 300: 1.0}


def test_leave_one_out_equals_a_new_run(spark, monkeypatch):
    """Every omitted group against AP over the rows that are left, with blocks of a few positions."""
    monkeypatch.setattr(ag, "BLOCK", 7)
    preds, gts = brute.scene(random.Random(8), images=7, n_gt=8, n_pred=14)
    p, g = brute.frames(spark, preds, gts)
    hits = mt.coco_hits(p, g).withColumn("site", mt.F.col("image_id") % 3)
    npos = ag.truth_counts(g.withColumn("site", mt.F.col("image_id") % 3), ["site"])
    got = {(r.omitted, r.max_det, r.class_id): (r.ap50_95, r.ap50, r.ap75) for r in ag.leave_one_out_ap(hits, npos, "site", caps=(2, 300)).collect()}
    want = {}
    for site in range(3):
        left = ag.coco_ap(hits.filter(f"site != {site}"), ag.truth_counts(g.filter(f"image_id % 3 != {site}")), (2, 300))
        want |= {(site, r.max_det, r.class_id): (r.ap50_95, r.ap50, r.ap75) for r in left.collect()}
    assert got.keys() == want.keys()
    assert all(a == pytest.approx(b) for k in want for a, b in zip(got[k], want[k], strict=True))


def test_no_predictions_and_no_truth(spark):
    p, g = perfect(spark, 3)
    none = ag.coco_ap(mt.coco_match(p.limit(0), g), ag.truth_counts(g), (100,)).filter("class_id = 0").first()
    assert none.ap50_95 == 0
    empty = ag.coco_ap(mt.coco_match(p, g.limit(0)), ag.truth_counts(g.limit(0)), (100,)).filter("class_id IS NULL")
    assert [r.ap50_95 for r in empty.collect()] in ([], [None])


def test_empty_sweep_picks_highest_threshold(spark):
    p, g = perfect(spark, 2)
    best = ag.best_confidence(ag.threshold_sweep(mt.greedy_match(p.limit(0), g), g)).first()
    assert best.confidence == 0.95 and best.f1 == 0


def test_sweep_equals_direct_counts(spark):
    preds, gts = brute.scene(random.Random(2), images=6)
    p, g = brute.frames(spark, preds, gts)
    m = mt.greedy_match(p, g)
    sweep = {round(r.confidence, 2): (r.tp, r.fp, r.fn) for r in ag.threshold_sweep(m, g).filter("class_id IS NULL").collect()}
    for step in range(1, 20):
        t = step / 20
        found = brute.match([x for x in preds if x[3] >= t], gts)
        tp = sum(v is not None for v in found.values())
        assert sweep[round(t, 2)] == (tp, len(found) - tp, len(gts) - tp)


def test_bootstrap_refuses_one_group(spark):
    one = spark.createDataFrame([(1, 5, 2)], "group_id int, tp bigint, fn bigint")
    row = ag.bootstrap_recall(one, 20).first()
    assert row.lower is None and row.refused == "fewer than two groups"


def test_size_bins_by_short_side(spark):
    from boxloom.functions.boxes import box, size_bin

    rows = spark.createDataFrame([(0.0, 0.0, 99.0, float(s)) for s in (7, 8, 16, 32)], "x1 double, y1 double, x2 double, y2 double")
    assert [r[0] for r in rows.select(size_bin(box())).collect()] == ["lt8", "8to16", "16to32", "ge32"]


def test_negative_image_rate(spark):
    p, g = brute.frames(spark, [(1, 0, 0, 0.9, BOX), (1, 0, 1, 0.9, BOX)], [(0, 0, 0, BOX)])
    images = spark.createDataFrame([(i,) for i in (0, 1, 2)], "image_id bigint")
    assert ag.negative_fp_rate(images, g, p, 0.5).first().rate == 0.5


def test_copies_of_a_box_do_not_pair_in_nms(spark):
    rows = [(0, 0, i, 0.5, BOX) for i in range(300)] + [(0, 0, 300, 0.9, BOX), (0, 0, 301, 0.1, (5.0, 5.0, 5.0, 9.0)), (0, 0, 302, 0.1, (5.0, 5.0, 5.0, 9.0))]
    p, _ = brute.frames(spark, rows, [(0, 0, 0, BOX)])
    assert {r.pred_index for r in mt.nms(p).collect()} == {300, 301, 302}

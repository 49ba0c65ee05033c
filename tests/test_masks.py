"""Masks held as rectangles, against single pixels."""

import random

import pytest

from boxloom.operators import masks as mk


def pixels(run):
    return {(x, y) for y in range(run["y"], run["y_end"]) for x in range(run["x_start"], run["x_end"])}


def random_runs(seed, n):
    rng = random.Random(seed)
    runs = []
    for i in range(n):
        x, y = rng.randrange(150), rng.randrange(150)
        runs.append({"image_id": i % 2, "class_id": rng.randint(1, 3), "score": rng.choice([0.2, 0.5]), "instance": i,
                     "y": y, "y_end": y + rng.randint(1, 90), "x_start": x, "x_end": x + rng.randint(1, 90)})
    return runs


SCHEMA = "image_id bigint, class_id int, score double, instance int, y int, y_end int, x_start int, x_end int"


def owners(runs):
    best = {}
    for r in runs:
        for p in pixels(r):
            key = (r["image_id"], *p)
            best[key] = max(best.get(key, (-1,)), (r["score"], -r["instance"], r["class_id"]))
    return {k: (v[2], -v[1]) for k, v in best.items()}


def test_a_box_is_one_run(spark):
    boxes = spark.createDataFrame([(0, 1.0, 2.0, 5.0, 40.0), (1, 3.0, 3.0, 3.0, 9.0)], "i int, x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in mk.box_runs(boxes, ["i"]).collect()] == [(0, 2, 40, 1, 5)]


def test_paint_of_tall_runs(spark):
    runs = random_runs(3, 14)
    got = {}
    for r in mk.paint(spark.createDataFrame(runs, SCHEMA), ["image_id"]).collect():
        for p in pixels(r):
            assert (r.image_id, *p) not in got
            got[(r.image_id, *p)] = (r.class_id, r.instance)
    assert got == owners(runs)


@pytest.mark.parametrize("tall", [True, False])
def test_iou_of_tall_runs(spark, tall):
    runs = [dict(r, instance=r["instance"] // 3) for r in random_runs(5, 12)]
    for r in runs:  # the runs of an instance lie apart
        r["y"], r["y_end"] = r["y"] + 300 * r["class_id"], r["y_end"] + 300 * r["class_id"]
    runs = list({(r["image_id"], r["instance"], r["class_id"]): r for r in runs}.values())
    rows = runs if tall else [dict(r, y=y, y_end=y + 1) for r in runs for y in range(r["y"], r["y_end"])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.image_id, r.instance, r.b_instance): r.iou for r in mk.mask_iou_pairs(df if tall else df.drop("y_end"), df, ["image_id"], self_join=True).collect()}
    sets = {}
    for r in runs:
        sets.setdefault((r["image_id"], r["instance"]), set()).update(pixels(r))
    want = {(i, a, b): len(s & t) / len(s | t) for (i, a), s in sets.items() for (j, b), t in sets.items() if i == j and a < b and s & t}
    assert want and got == pytest.approx(want)


def test_confusion_paints_both_sides(spark):
    truth, pred = random_runs(7, 9), random_runs(8, 9)
    total = 2 * 300 * 300
    want = {(g, p): 0 for g in range(4) for p in range(4)}
    a, b = owners(truth), owners(pred)
    for key in a.keys() | b.keys():
        want[a.get(key, (0,))[0], b.get(key, (0,))[0]] += 1
    want[0, 0] = total - len(a.keys() | b.keys())
    table = mk.confusion(spark.createDataFrame(truth, SCHEMA), spark.createDataFrame(pred, SCHEMA), spark.range(1).selectExpr(f"{total} AS total"), 4)
    assert {(r.gt_class, r.pred_class): r.n for r in table.collect()} == want


@pytest.mark.parametrize("crowd", [4, 8192])
def test_pairs_of_groups_and_crowds(spark, monkeypatch, crowd):
    """Runs meet inside a task, with no join by cells; larger groups are joined and give the same pairs."""
    from boxloom.operators import matching as mt

    if crowd > 100:
        monkeypatch.setattr(mk, "run_overlaps", None)
    monkeypatch.setattr(mt, "CROWD", crowd)
    runs = [dict(r, instance=r["instance"] // 2) for r in random_runs(9, 24)]
    for r in runs:
        r["y"], r["y_end"] = r["y"] + 300 * r["class_id"], r["y_end"] + 300 * r["class_id"]
    runs = list({(r["image_id"], r["instance"], r["class_id"]): r for r in runs}.values())
    df = spark.createDataFrame(runs, SCHEMA)
    got = {(r.image_id, r.instance, r.b_instance): r.iou for r in mk.mask_iou_pairs(df, df, ["image_id"], least=0.02).collect()}
    sets = {}
    for r in runs:
        sets.setdefault((r["image_id"], r["instance"]), set()).update(pixels(r))
    want = {(i, a, b): len(s & t) / len(s | t) for (i, a), s in sets.items() for (j, b), t in sets.items() if i == j and len(s & t) / len(s | t) >= 0.02}
    assert any(a != b for _, a, b in want) and got == pytest.approx(want)

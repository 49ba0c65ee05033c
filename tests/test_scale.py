"""Mechanisms that keep a hot key out of one task, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.operators import components as gr
from boxloom.operators import metrics as ag
from boxloom.operators import selection as wn
from boxloom.operators import similarity as sim
from boxloom.operators import splits as sp
from boxloom.operators import views as vw


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_inversions(spark, n):
    rng = random.Random(n)
    rows = []
    for key in ("a", "b"):
        order = rng.sample(range(1, 3 * n), n)
        rows += [(key, i + 1, v) for i, v in enumerate(order)]
    df = spark.createDataFrame(rows, "k string, rank int, full_rank int")
    got = {r.k: r.inverted for r in wn.inversions(df, ["k"], "rank", "full_rank").collect()}
    for key in ("a", "b"):
        v = [x for k, _, x in rows if k == key]
        assert got[key] == sum(v[i] > v[j] for j in range(n) for i in range(j))


def test_rank_stability_of_reversed_order(spark):
    full = spark.createDataFrame([(f"c{i}", i) for i in range(1, 6)], "candidate_id string, full_rank int")
    omitted = spark.createDataFrame([("x", f"c{i}", 6 - i) for i in range(1, 6)] + [("y", "c1", 1)], "omitted string, candidate_id string, rank int")
    frozen = full.filter("full_rank = 1").select("candidate_id")
    got = {r.omitted: (r.winner, r.same_as_frozen, r.frozen_rank, r.kendall_tau) for r in wn.rank_stability(omitted, full, frozen).collect()}
    assert got == {"x": ("c5", False, 5, -1.0), "y": ("c1", True, 1, None)}


@pytest.mark.parametrize("ranges", [64, 1024])
def test_exact_quantiles(spark, monkeypatch, ranges):
    """Uniform, repeated, exponentially spread, constant and huge values, with nulls and NaN."""
    monkeypatch.setattr(ag, "RANGES", ranges)
    rng = random.Random(1)
    values = {
        "uniform": [rng.random() for _ in range(301)], "few": [rng.choice([1.0, 2.0, 2.0, 9.0]) for _ in range(200)],
        "spread": [10.0 ** rng.uniform(-12, 12) * rng.choice([1, -1]) for _ in range(150)], "constant": [3.5] * 40, "one": [7.0],
        "huge": [1.7e308, -1.7e308, 0.0, 1.0],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("uniform", None), ("few", math.nan), ("none", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    at = [0.0, 0.5, 0.95, 1.0]
    got = {r.key: (r.n, [r[f"q_{i}"] for i in range(len(at))]) for r in ag.exact_quantiles(df, "v", ["key"], at).collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        assert got[k][0] == len(vs)
        if k != "huge":
            assert got[k][1] == pytest.approx([float(np.quantile(vs, q)) for q in at])
        else:
            assert got[k][1] == [-1.7e308, 0.5, pytest.approx(1.7e308 * 0.85), 1.7e308]


def graph(spark, n, edges):
    return spark.createDataFrame([(i,) for i in range(n)], "id bigint"), spark.createDataFrame(edges, "src bigint, dst bigint")


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_contraction_gives_the_same_components(spark, kind):
    rng = random.Random(4)
    n = 80
    edges = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(50)], "chain": [(i, i + 1) for i in range(n - 1)],
        "star": [(n - 1, i) for i in range(0, n - 1, 2)], "none": [],
    }[kind]
    nodes, e = graph(spark, n, edges)
    a = gr.connected_components(nodes, e).collect()
    b = gr.contracted_components(nodes, e).collect()
    assert {(r.id, r.component) for r in a} == {(r.id, r.component) for r in b}


def test_check_finds_faults(spark):
    nodes, e = graph(spark, 6, [(0, 1), (1, 2), (3, 4)])
    good = gr.connected_components(nodes, e)
    assert tuple(gr.verify_components(good, e).first()) == (3, 0, 0, 0)
    # two components merged: no edge crosses, but a second labelling differs
    merged = good.withColumn("component", F.when(F.col("component") == 3, 0).otherwise(F.col("component")))
    assert tuple(gr.verify_components(merged, e).first()) == (2, 0, 0, 2)
    cut_off = good.withColumn("component", F.when(F.col("id") == 2, 2).otherwise(F.col("component")))
    assert tuple(gr.verify_components(cut_off, e).first()) == (4, 1, 0, 1)


@pytest.mark.parametrize("spread", [4, 64])
def test_nearest_reference_in_a_dense_reference(spark, spread):
    """Near neighbours (flipped probes) and far ones (values of a part compared), with ties."""
    rng = random.Random(spread)
    ref = [rng.getrandbits(64) for _ in range(400)]
    near = [ref[rng.randrange(400)] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(spread // 2))) for _ in range(40)]
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    q = spark.createDataFrame([(i, signed(c)) for i, c in enumerate(near)], "id bigint, code bigint")
    r = spark.createDataFrame([(i, signed(c)) for i, c in enumerate(ref)], "order bigint, code bigint")
    got = {x.id: (x.distance, x.nearest, x.exact) for x in sim.nearest_reference(q, r).collect()}
    want = {i: min((bin(c ^ b).count("1"), o) for o, b in enumerate(ref)) for i, c in enumerate(near)}
    assert got == {i: (d, o, d == 0) for i, (d, o) in want.items()}
    assert sim.nearest_reference(q, r.limit(0)).count() == 0


def test_places_of_a_long_run_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sp, "PIECE", 7)
    groups = spark.createDataFrame([("s", i, 1) for i in range(100)] + [("s", 200, 9)], "stratum string, group_id bigint, size bigint")
    rows = sp.stratified_split(groups).collect()
    assert Counter(r.group_id for r in rows) == Counter([*range(100), 200])
    sizes = Counter()
    for r in rows:
        sizes[r.split] += r.size
    assert all(abs(sizes[k] - s * 109) <= 1 for k, s in sp.STRATIFIED_SHARES)


def plain_views(objects, width, height, native, chosen, tiles):
    """Crops of the sequential rule for one image: objects (order, class, box) in order."""
    complete = lambda b, c: b[0] >= c[0] and b[1] >= c[1] and b[2] <= c[2] and b[3] <= c[3]
    crops = list(tiles)
    for _, cls, b in sorted(objects):
        if cls in chosen or not any(complete(b, c) for c in crops):
            side = max(native, math.ceil(max(b[2] - b[0], b[3] - b[1]) * 1.1 / 32) * 32)
            w, h = min(side, width), min(side, height)
            x, y = min(max(int((b[0] + b[2] - w) / 2), 0), width - w), min(max(int((b[1] + b[3] - h) / 2), 0), height - h)
            crops.append((x, y, x + w, y + h))
    return set(crops)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_centred_views_follow_the_order_of_objects(spark, seed):
    rng = random.Random(seed)
    objects = []
    for image in range(3):
        for i in range(40):
            x, y = rng.randrange(380), rng.randrange(280)
            objects.append((image, f"{image}.{i}", i, rng.randrange(6), float(x), float(y), float(x + rng.randrange(5, 120)), float(y + rng.randrange(5, 100))))
    o = spark.createDataFrame(objects, "image_id bigint, instance_id string, at int, class_id int, x1 double, y1 double, x2 double, y2 double")
    images = spark.createDataFrame([(i, 500, 380, 0) for i in range(3)], "image_id bigint, width int, height int, group_id int")
    grids = [(r.image_id, (r.x1, r.y1, r.x2, r.y2)) for size in (96, 160) for r in vw.tiles(images, size).collect()]
    got = vw.make_views(images, o, 96, 160, [5], "at").collect()
    for image in range(3):
        mine = [(r[2], r[3], r[4:]) for r in objects if r[0] == image]
        want = plain_views(mine, 500, 380, 96, [5], [c for i, c in grids if i == image])
        assert {(r.x1, r.y1, r.x2, r.y2) for r in got if r.image_id == image} == want


def test_draws_of_one_heavy_view(spark):
    """One view with 99 % of the weight, many light ones, and one without weight; counts as by a search in the sorted starts."""
    weights = [0.0] + [0.01 / 500] * 250 + [0.99] + [0.01 / 500] * 250
    views = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "view_id int, sampling_weight double")
    got = {r.view_id: r.n for r in vw.weighted_draws(views, 4000, 3).collect()}
    u = [r[0] for r in spark.range(4000).select(vw.hash_unit(F.lit(3), F.col("id"))).collect()]
    starts = np.concatenate([[0], np.cumsum(weights)[:-1]]) / np.sum(weights)
    want = Counter(int(np.flatnonzero((starts <= x) & (np.array(weights) > 0))[-1]) for x in u)
    assert got == dict(want) and got[251] > 3900 and 0 not in got


def test_boxes_are_made_after_their_shuffle(spark, folder):
    """Only the four numbers of a line item that its box is made from, and its image, are shuffled."""
    from boxloom.plans.derive import Tables

    for rows in (Tables(spark, folder).gt(), Tables(spark, folder).excluded()):
        lines = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        below = "\n".join(lines[next(i for i, x in enumerate(lines) if "Window [" in x) + 1 :])
        assert not any(f" AS {c}#" in below for c in ("ox", "oy", "bw", "bh"))


def test_leave_one_out_writes_predictions_twice(spark, monkeypatch):
    """Once as they come, once in order; no further table of all predictions for their places."""
    from boxloom.operators import prefix

    wrote = []
    for module in (ag, prefix):
        cut = module.cut
        monkeypatch.setattr(module, "cut", lambda df, cut=cut: (wrote.append(df.columns), cut(df))[1])
    hits = spark.createDataFrame([(k % 3, 0, k, k / 50.0, 1, k % 2, 1, k % 5) for k in range(40)], "image_id long, class_id int, pred_index int, score double, rank int, hits int, seen int, site long")
    npos = spark.createDataFrame([(0, s, 10) for s in range(5)], "class_id int, site long, npos long")
    assert ag.leave_one_out_ap(hits, npos, "site", levels=[0.5]).count() == 5 * 2 * 2
    assert sum("hits" in columns for columns in wrote) == 2

import pytest
from pyspark.sql import functions as F

from boxloom.operators import audit as dq
from boxloom.operators import errors as er
from boxloom.operators import masks as mk
from boxloom.operators import matching as mt
from boxloom.operators import views as vw
from tests import brute

IMAGES = "image_id bigint, width int, height int, group_id int"


def test_tiles_cover_the_edges_without_repeats(spark):
    t = vw.tiles(spark.createDataFrame([(1, 2049, 3001, 0)], IMAGES), 1024).collect()
    bounds = {(r.x1, r.y1, r.x2, r.y2) for r in t}
    assert len(bounds) == len(t) and sorted(r.tile for r in t) == list(range(len(t)))
    assert max(r.x2 for r in t) == 2049 and max(r.y2 for r in t) == 3001 and min(r.x1 for r in t) == 0


def test_small_image_is_one_smaller_tile(spark):
    rows = vw.tiles(spark.createDataFrame([(1, 300, 200, 0)], IMAGES), 1024).collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in rows] == [(0, 0, 300, 200)]


def test_tiles_of_a_region(spark):
    images = spark.createDataFrame([(1, 300, 200, (10, 20, 110, 500)), (2, 300, 200, None), (3, 300, 200, (5, 5, 5, 9))], "image_id int, width int, height int, roi struct<x1:int,y1:int,x2:int,y2:int>")
    rows = {}
    for r in sorted(vw.tiles(images, (100, 80), 0.2, "roi").collect(), key=lambda r: (r.image_id, r.tile)):
        rows.setdefault(r.image_id, []).append((r.x1, r.y1, r.x2, r.y2))
    assert rows[1] == [(10, 20, 90, 120), (30, 20, 110, 120), (10, 100, 90, 200), (30, 100, 110, 200)]
    assert len(rows[2]) == 5 * 3 and max(r[3] for r in rows[2]) == 200 and 3 not in rows


def test_weights_sum_to_one_per_group_and_draws_follow_them(spark):
    views = spark.createDataFrame([(f"v{i}", i % 3) for i in range(30)], "view_id string, group_id int")
    liked = spark.createDataFrame([("v0", 2)], "view_id string, class_id int")
    w = vw.sampling_weight(views, liked, [2])
    sums = [r[1] for r in w.groupBy("group_id").agg(F.sum("sampling_weight")).collect()]
    assert sums == pytest.approx([1.0] * 3)
    heavy = w.withColumn("sampling_weight", F.when(F.col("view_id") == "v1", 100.0).otherwise(F.col("sampling_weight")))
    d = {r.view_id: r.n for r in vw.weighted_draws(heavy, 5000, 1).collect()}
    assert sum(d.values()) == 5000 and d["v1"] > 4700


PRED = "image_id bigint, class_id int, pred_index int, score double, x1 double, y1 double, x2 double, y2 double"
EXCL = "image_id bigint, source_index int, source_type string, x1 double, y1 double, x2 double, y2 double"


def taxonomy(spark, box, excluded):
    p, g = brute.frames(spark, [(0, 0, 0, 0.9, box)], [(0, 0, 0, (500.0, 500.0, 510.0, 510.0))])
    rows = er.fp_taxonomy(mt.greedy_match(p, g), p, g, spark.createDataFrame(excluded, EXCL)).collect()
    return {r.variant: r for r in rows}


def test_unknown_wins_a_tie(spark):
    t = taxonomy(spark, (0.0, 0.0, 10.0, 10.0), [(0, 0, "pads", 0.0, 0.0, 10.0, 10.0), (0, 1, "unknown", 0.0, 0.0, 10.0, 10.0)])
    assert t["strict_iou"].category == "source_unknown"


def test_small_box_inside_a_large_excluded_object(spark):
    t = taxonomy(spark, (10.0, 10.0, 20.0, 20.0), [(0, 0, "pads", 0.0, 0.0, 100.0, 100.0)])
    assert t["strict_iou"].category == "other_background"
    assert (t["sensitivity_ioa"].category, t["sensitivity_ioa"].subtotal) == ("known_non_target", "pins_pads")


def test_mask_nms_is_inclusive(spark, monkeypatch):
    def run(i, y, a, b):
        return (0, 0, i, y, a, b)

    runs = [run(0, 0, 0, 8), run(1, 0, 2, 10), run(2, 1, 0, 8)]  # IoU of 0 and 1 is 6/10
    r = spark.createDataFrame(runs, "image_id bigint, class_id int, instance int, y int, x_start int, x_end int")
    s = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate((0.5, 0.9, 0.1))], "image_id bigint, class_id int, instance int, score double")
    for rounds in (6, 0):
        monkeypatch.setattr(mt, "ROUNDS", rounds)
        assert {x.instance for x in mk.mask_nms(s, r, 0.6).collect()} == {1, 2}


def test_paint_gives_pixels_to_the_higher_score(spark):
    runs = spark.createDataFrame(
        [(0, 1, 0.5, 0, 0, 0, 100), (0, 2, 0.9, 1, 0, 40, 60), (0, 3, 0.5, 2, 0, 90, 130)],
        "image_id bigint, class_id int, score double, instance int, y int, x_start int, x_end int",
    )
    got = sorted((r.x_start, r.x_end, r.class_id) for r in mk.paint(runs, ["image_id"]).collect())
    flat = {x: c for a, b, c in got for x in range(a, b)}
    assert [flat[x] for x in (0, 39, 40, 59, 60, 95, 129)] == [1, 1, 2, 2, 1, 1, 3]


def test_metadata_contract(spark):
    sha = "a" * 64
    ok = ("s", "g", "i1", "a/b.jpg", sha, sha, "complete_ic_bbox", "CC0", "local_use_verified")
    rows = [(0, *ok), (1, *ok), (2, "s", "g", "i3", "../x", "b" * 64, "zz", "complete_ic_bbox", "CC0", "local_use_verified")]
    cols = "row_id int, source_id string, group_id string, image_id string, relative_path string, image_sha256 string, annotation_sha256 string, label_status string, license_id string, license_review string"
    got = {(r.row_id, r.problem) for r in dq.validate_rows(spark.createDataFrame(rows, cols)).collect()}
    assert got == {(i, p) for i in (0, 1) for p in ("duplicate_image_id", "duplicate_path", "duplicate_hash")} | {(2, "bad_path"), (2, "bad_hash")}


def test_epoch_log_gaps_and_values(spark):
    rows = [("a", 1, 0.5), ("a", 2, float("nan")), ("b", 1, 1.0), ("b", 1, 1.0), ("b", 3, 1.0)]
    got = {r.run: (r.not_finite, r.repeated, r.contiguous) for r in dq.check_epochs(spark.createDataFrame(rows, "run string, epoch int, loss double"), ["run"], ["loss"]).collect()}
    assert got == {"a": (1, 0, True), "b": (0, 1, False)}


KINDS = "schema string, names array<string>, domain string, annotation_policy string, source_url string, class_mapping map<string,string>"


@pytest.mark.parametrize(
    "change,problem",
    [
        ({}, None), ({"schema": "s2"}, "schema_unknown"), ({"schema": None}, "schema_unknown"), ({"names": []}, "names_invalid"), ({"names": ["a", "a"]}, "names_invalid"),
        ({"names": ["a", " b"]}, "names_invalid"), ({"names": ["a", None]}, "names_invalid"), ({"domain": "other"}, "domain_unknown"), ({"annotation_policy": None}, "policy_unknown"),
        ({"source_url": " "}, "source_url_missing"), ({"class_mapping": {}}, "class_mapping_missing"), ({"class_mapping": None}, "class_mapping_missing"),
    ],
)
def test_manifest_head(spark, change, problem):
    head = {"schema": "s1", "names": ["a", "b"], "domain": "proxy", "annotation_policy": "native", "source_url": "u", "class_mapping": {"x": "y"}} | change
    row = spark.createDataFrame([tuple(head.values())], KINDS)
    assert [r.problem for r in dq.header_problems(row, "s1", ["proxy", "own"], ["native", "weak_masks"]).collect()] == ([problem] if problem else [])


def test_manifest_eligibility(spark):
    head = ("s1", ["a"], "proxy", "native", "u", {"x": "y"})
    records = spark.createDataFrame([("r1", "train", "weak"), ("r2", "val", "reviewed")], "record_id string, split string, annotation_status string")
    none = spark.createDataFrame([("warning",)], "level string")

    def verdict(records, head=head, problems=none):
        return tuple(dq.manifest_eligibility(spark.createDataFrame([head], KINDS), records, problems).first())

    assert verdict(records) == (0, True, True, True, "proxy_validation_only")
    assert verdict(records, (*head[:3], "weak_masks", *head[4:])) == (0, True, False, True, None)
    assert verdict(records.withColumn("split", F.lit("val"))) == (0, True, False, True, None)
    assert verdict(records, problems=spark.createDataFrame([("error",), ("error",)], "level string")) == (2, False, False, True, None)
    assert verdict(records.limit(0)) == (0, True, True, True, "proxy_validation_only")


def test_splits_of_an_empty_manifest(spark):
    records = spark.createDataFrame([], "record_id string, split string")
    got = dq.split_problems(records, spark.createDataFrame([], "record_id string, class_id int"), ["a"]).collect()
    assert {(r.split, r.level, r.problem) for r in got} == {("train", "error", "split_absent"), ("val", "error", "split_absent"), ("test", "warning", "test_absent")}

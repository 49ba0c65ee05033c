"""Repeated keys of the metadata contract are found without moving whole rows."""

import re

from boxloom.operators import audit as dq

COLS = "row_id int, source_id string, group_id string, image_id string, relative_path string, image_sha256 string, annotation_sha256 string, label_status string, license_id string, license_review string"


def test_repeated_keys(spark):
    rest = ("b" * 64, "complete_ic_bbox", "CC0", "local_use_verified")
    hashes = ["a" * 64, "a" * 64, "A" * 64, None, None, "", "", "#" + "a" * 31]
    rows = [(i, "s", "g", f"i{i}" if i else "i1", f"p/{i}.jpg", h, *rest) for i, h in enumerate(hashes)]
    got = dq.validate_rows(spark.createDataFrame(rows, COLS))
    pairs = sorted((r.row_id, r.problem) for r in got.collect() if r.problem.startswith("duplicate"))
    assert pairs == [(0, "duplicate_hash"), (0, "duplicate_image_id"), (1, "duplicate_hash"), (1, "duplicate_image_id"), (5, "duplicate_hash"), (6, "duplicate_hash")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if re.search(r"Join", line):
            assert "annotation_sha256" not in line
    joined = [p for p in plan.split("Join")[1:]]
    assert joined and "annotation_sha256" not in "".join(p.split("LocalRelation")[0].split("LogicalRDD")[0] for p in joined)

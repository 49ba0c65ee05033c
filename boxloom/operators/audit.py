"""Rule checks on manifests, datasets, jobs, logs and stored results.

Checks return rows that name the problem; bad rows never stop the others. Duplicate and leak tests
are aggregates joined back to the rows, so a key that many rows share is not windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.boxes import box, box_from_yolo, box_to_yolo, max_difference
from boxloom.functions.numeric import is_finite, near
from boxloom.operators import metrics
from boxloom.operators.matching import coco_hits, found_truth, greedy_match
from boxloom.operators.similarity import cross_split_leaks, screen_holdout, similar_pairs_dihedral
from boxloom.session import cut

SPLITS = ["train", "val", "test"]
# fixed values: manifest vocabularies and identifier patterns
STATUSES = ["reviewed", "source_provided", "weak"]
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"
SHA256_PATTERN = r"^[0-9a-f]{64}$"
LABEL_STATUS = "complete_ic_bbox"
LICENSE_REVIEW = "local_use_verified"


def _problems(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(n)) for n, bad in rules]))


def _shared(df: DataFrame, key: str, split: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias(f"_{key}_n")]
    if split:
        aggs.append(F.count_distinct(split).alias(f"_{key}_splits"))
    return df.groupBy(key).agg(*aggs)


def validate_manifest(df: DataFrame) -> DataFrame:
    """Every broken rule of every record: ``record_id, level, problem``.

    ``df``: record_id, image, label, sha256, group_id, split, annotation_status.
    """
    known = df.withColumn("_split", F.when(F.col("split").isin(SPLITS), F.col("split")))
    rows = known
    for key in ("image", "label"):
        rows = rows.join(_shared(known, key), key, "left")
    for key in ("group_id", "sha256"):
        rows = rows.join(_shared(known, key, "_split"), key, "left")
    no = F.lit(False)
    errors = _problems([
        ("split_unknown", F.col("_split").isNull()),
        ("group_missing", F.trim("group_id") == ""),
        ("group_leak", F.coalesce(F.col("_group_id_splits") > 1, no)),
        ("status_unknown", ~F.col("annotation_status").isin(STATUSES)),
        ("weak_outside_train", F.coalesce((F.col("annotation_status") == "weak") & (F.col("split") != "train"), no)),
        ("duplicate_image", F.coalesce(F.col("_image_n") > 1, no)),
        ("duplicate_label", F.coalesce(F.col("_label_n") > 1, no)),
        ("hash_leak", F.coalesce(F.col("_sha256_splits") > 1, no)),
    ])
    warnings = _problems([
        ("duplicate_content", F.coalesce((F.col("_sha256_n") > 1) & (F.col("_sha256_splits") <= 1), no)),
    ])
    tagged = F.concat(
        F.transform(errors, lambda p: F.struct(F.lit("error").alias("level"), p.alias("problem"))),
        F.transform(warnings, lambda p: F.struct(F.lit("warning").alias("level"), p.alias("problem"))),
    )
    return rows.select("record_id", F.explode(tagged).alias("p")).select("record_id", "p.level", "p.problem")


def header_problems(header: DataFrame, schema: str, domains: list[str], policies: list[str]) -> DataFrame:
    """Broken rules of a manifest's head, one row (``schema, names, domain, annotation_policy, source_url, class_mapping``): ``level, problem``.

    ``names`` is an array of different names without outer blanks, ``class_mapping`` a map with an entry at least.
    """
    names = F.col("names")
    good_names = (F.size(names) > 0) & F.forall(names, lambda n: F.coalesce((n != "") & (F.trim(n) == n), F.lit(False))) & (F.size(F.array_distinct(names)) == F.size(names))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = _problems([
        ("schema_unknown", F.col("schema") != schema),
        ("names_invalid", ~good_names),
        ("domain_unknown", ~F.col("domain").isin(domains)),
        ("policy_unknown", ~F.col("annotation_policy").isin(policies)),
        ("source_url_missing", blank(F.col("source_url"))),
        ("class_mapping_missing", F.size("class_mapping") < 1),
    ])
    return header.select(F.lit("error").alias("level"), F.explode(rules).alias("problem"))


def content_problems(records: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """What the files of a manifest show: ``record_id, level, problem, detail``.

    ``records``: record_id, image, label; ``files``: path, and ``width`` and ``height`` (0 or null if it doesn't decode) of
    what can be read; ``lines``: path, line_number, problem, as ``parse_yolo`` gives them for the label files.
    """
    disk = files.select("path", (F.coalesce("width", F.lit(0)) > 0).alias("_w"), (F.coalesce("height", F.lit(0)) > 0).alias("_h"))
    image = records.join(disk.withColumnRenamed("path", "image"), "image", "left")
    label = records.join(files.select(F.col("path").alias("label"), F.lit(True).alias("_there")), "label", "left")
    error = F.lit("error").alias("level")
    seen = F.when(F.col("_w").isNull(), "image_unreadable").when(~F.col("_w") | ~F.col("_h"), "image_not_decoded")
    none = F.lit(None).cast("int").alias("detail")
    parts = image.select("record_id", error, seen.alias("problem"), none).filter("problem IS NOT NULL")
    parts = parts.unionByName(label.filter("_there IS NULL").select("record_id", error, F.lit("label_unreadable").alias("problem"), none))
    bad = lines.filter("problem IS NOT NULL").select(F.col("path").alias("label"), F.concat(F.lit("label_"), "problem").alias("problem"), F.col("line_number").alias("detail"))
    return parts.unionByName(records.select("record_id", "label").join(bad, "label").select("record_id", error, "problem", "detail"))


def split_problems(records: DataFrame, instances: DataFrame, names: list[str]) -> DataFrame:
    """Splits without records, without instances, or without some class: ``split, level, problem, class_name``.

    ``records``: record_id, split; ``instances``: record_id, class_id of the valid label lines. Train and val are required.
    """
    spark = records.sparkSession
    counts = records.filter(F.col("split").isin(SPLITS)).groupBy("split").agg(F.count("*").alias("images"))
    boxes = records.select("record_id", "split").join(instances, "record_id").groupBy("split", "class_id").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(s, i, c) for s in SPLITS for i, c in enumerate(names)], "split string, class_id int, class_name string")
    filled = grid.join(counts, "split", "left").join(boxes, ["split", "class_id"], "left").na.fill(0, ["images", "n"])
    whole = filled.groupBy("split").agg(F.first("images").alias("images"), F.sum("n").alias("n"))
    needed = F.col("split") != "test"
    problem = F.when(F.col("images") == 0, F.when(needed, "split_absent").otherwise("test_absent")).when(needed & (F.col("n") == 0), "no_instances")
    of_split = whole.select("split", F.when(needed, "error").otherwise("warning").alias("level"), problem.alias("problem"), F.lit(None).cast("string").alias("class_name"))
    of_class = filled.filter("images > 0 AND n = 0").select("split", F.lit("warning").alias("level"), F.lit("class_without_instances").alias("problem"), "class_name")
    return of_split.filter("problem IS NOT NULL").unionByName(of_class)


def manifest_eligibility(header: DataFrame, records: DataFrame, problems: DataFrame) -> DataFrame:
    """One row: ``errors, valid, evaluation_eligible, partial_evaluation, scope``. ``problems`` (``level``) are all that were found.

    Weak labels outside train, by a record's status or by a ``weak`` policy, bar evaluation; ``scope`` names the domain.
    """
    errors = problems.agg(F.count_if(F.col("level") == "error").alias("errors"))
    weak = (F.col("annotation_status") == "weak") & (F.col("split") != "train")
    seen = records.agg(F.coalesce(F.bool_or(weak), F.lit(False)).alias("_weak"), F.count_if(F.col("split").isin("val", "test")).alias("_evaluated"), (F.count_if(F.col("split") == "test") == 0).alias("partial_evaluation"))
    one = header.select("domain", F.col("annotation_policy").startswith("weak").alias("_policy")).join(F.broadcast(errors), F.lit(True)).join(F.broadcast(seen), F.lit(True))
    valid = F.col("errors") == 0
    eligible = valid & ~F.col("_weak") & ~(F.coalesce("_policy", F.lit(False)) & (F.col("_evaluated") > 0))
    kind = F.when(F.col("partial_evaluation"), "validation_only").otherwise("validation_and_test")
    return one.select("errors", valid.alias("valid"), eligible.alias("evaluation_eligible"), "partial_evaluation", F.when(eligible, F.concat_ws("_", "domain", kind)).alias("scope"))


def manifest_verdict(df: DataFrame, problems: DataFrame) -> DataFrame:
    """Whether the manifest may be evaluated, and on which splits."""
    errors = problems.agg(F.count_if(F.col("level") == "error")).scalar()
    counts = df.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    valid = (F.col("errors") == 0) & (F.col("train") > 0) & (F.col("val") > 0)
    return counts.withColumn("errors", errors).select(
        *SPLITS, "errors", valid.alias("valid"), (F.col("test") == 0).alias("partial_evaluation"),
        F.when(valid, F.when(F.col("test") == 0, "validation_only").otherwise("validation_and_test")).alias("scope"),
    )


def validate_rows(df: DataFrame) -> DataFrame:
    """Contract of the metadata table: one row per broken rule, ``row_id, problem``."""
    path = F.col("relative_path")
    text = ["source_id", "group_id", "image_id", "relative_path", "image_sha256", "annotation_sha256",
            "label_status", "license_id", "license_review"]
    empty = F.lit(False)
    for c in text:
        empty = empty | F.coalesce(F.trim(c) == "", F.lit(True))
    bad_id = F.lit(False)
    for c in ("source_id", "group_id", "image_id", "license_id"):
        bad_id = bad_id | ~F.col(c).rlike(ID_PATTERN)
    bad_hash = ~F.col("image_sha256").rlike(SHA256_PATTERN) | ~F.col("annotation_sha256").rlike(SHA256_PATTERN)
    bad_path = path.startswith("/") | path.contains("\\") | path.contains(":") | path.rlike(r"(^|/)(\.\.?)?(/|$)")
    rules = [
        ("empty_value", empty), ("bad_id", bad_id), ("bad_path", bad_path), ("bad_hash", bad_hash),
        ("labels_incomplete", F.col("label_status") != LABEL_STATUS),
        ("rights_unverified", F.col("license_review") != LICENSE_REVIEW),
    ]
    found = df.select("row_id", F.explode(_problems(rules)).alias("problem"))
    # a rule on several rows moves its own key only; a digest travels as bytes, and the first byte keeps other texts apart
    sha, plain = F.col("image_sha256"), F.col("image_sha256").rlike("^[0-9a-f]{64}$")
    digest = F.when(plain, F.concat(F.lit(bytearray(b"#")), F.unhex(sha))).otherwise(F.concat(F.lit(bytearray(b"!")), sha.cast("binary")))
    dup = {
        "duplicate_image_id": [F.col("source_id"), F.col("image_id")], "duplicate_path": [F.col("source_id"), path], "duplicate_hash": [digest],
    }
    for name, columns in dup.items():
        keys = [f"_k{i}" for i in range(len(columns))]
        keyed = df.select("row_id", *(c.alias(k) for k, c in zip(keys, columns, strict=True)))
        often = keyed.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
        found = found.unionByName(keyed.join(often, keys, "left_semi").select("row_id", F.lit(name).alias("problem")))
    return found


def quarantine(df: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame]:
    """(good, held): records without and with problems; held ones keep the reasons."""
    marked = df.withColumn("problems", problems)
    return marked.filter(F.size("problems") == 0).drop("problems"), marked.filter(F.size("problems") > 0)


def verify_dataset(index: DataFrame, files: DataFrame, labels: DataFrame, n_classes: int) -> DataFrame:
    """All problems of an exported dataset: ``kind, key``.

    ``index``: id, split, source_group, family, image, image_sha256, width, height;
    ``files``: path, sha256, width, height (what is on disk);
    ``labels``: id, class_id, cx, cy, w, h.
    """
    disk = files.select(F.col("path").alias("image"), F.col("sha256").alias("f_sha"),
                        F.col("width").alias("f_w"), F.col("height").alias("f_h"))
    both = index.join(disk, "image", "full_outer")
    per_file = _problems([
        ("missing_file", F.col("f_sha").isNull()),
        ("orphan_file", F.col("id").isNull()),
        ("changed_bytes", F.coalesce(F.col("f_sha") != F.col("image_sha256"), F.lit(False))),
        ("dimension_drift", F.coalesce((F.col("f_w") != F.col("width")) | (F.col("f_h") != F.col("height")), F.lit(False))),
    ])
    a = both.select(F.explode(per_file).alias("kind"), F.col("image").alias("key"))
    parts = [a]
    for col in ("source_group", "family"):
        spanning = index.groupBy(col).agg(F.count_distinct("split").alias("n")).filter("n > 1")
        parts.append(spanning.select(F.lit(f"{col}_spans_splits").alias("kind"), F.col(col).cast("string").alias("key")))
    repeated = index.groupBy("image_sha256").agg(F.count_distinct("split").alias("n")).filter("n > 1")
    parts.append(repeated.select(F.lit("bytes_span_splits").alias("kind"), F.col("image_sha256").alias("key")))
    inside = F.lit(True)
    for c, size in (("cx", "w"), ("cy", "h")):
        inside = inside & (F.col(c) - F.col(size) / 2 >= -1e-6) & (F.col(c) + F.col(size) / 2 <= 1 + 1e-6)
    bad = ~F.col("class_id").between(0, n_classes - 1) | (F.col("w") <= 0) | (F.col("h") <= 0) | ~inside
    parts.append(labels.filter(bad).select(F.lit("bad_label").alias("kind"), F.col("id").cast("string").alias("key")))
    empty = index.join(labels.select("id"), "id", "left_anti")
    parts.append(empty.select(F.lit("no_labels").alias("kind"), F.col("id").cast("string").alias("key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Bits within which pictures count as near copies of each other, and of a holdout picture.
NEAR_BITS, HOLDOUT_BITS = 6, 8


def near_copy_problems(index: DataFrame, holdout: DataFrame, inventory: DataFrame | None = None, bits: int = 64) -> DataFrame:
    """What ``verify_dataset`` can't see in bytes: ``kind, key, pairs``.

    ``index``: id, split, ``code``, ``variants`` (the picture's turned and mirrored codes); ``holdout``: ``name``, ``variants``;
    ``inventory``: the holdout ``name`` list that the dataset was made with. Kinds: ``near_copies_span_splits`` (key: ids
    of two classes of equal codes, ``pairs``: rows across splits), ``near_holdout`` (key: id), ``holdout_changed`` (key: a name on one side only) and
    ``holdout_empty``.
    """
    alike = cut(similar_pairs_dihedral(index, NEAR_BITS, bits=bits))
    leaks = cross_split_leaks(alike, index).groupBy("id_a", "id_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("pairs"))
    one = F.lit(1).cast("long").alias("pairs")
    parts = [leaks.select(F.lit("near_copies_span_splits").alias("kind"), F.concat_ws("~", "id_a", "id_b").alias("key"), "pairs")]
    hits = screen_holdout(index, holdout, HOLDOUT_BITS, bits=bits)
    parts.append(hits.select(F.lit("near_holdout").alias("kind"), F.col("id").cast("string").alias("key"), one))
    if inventory is not None:
        sides = holdout.select("name", F.lit(1).alias("side")).unionByName(inventory.select("name", F.lit(2).alias("side")))
        changed = sides.groupBy("name").agg(F.count_distinct("side").alias("n")).filter("n = 1")
        parts.append(changed.select(F.lit("holdout_changed").alias("kind"), F.col("name").alias("key"), one))
    none = holdout.agg(F.count("*").alias("n")).filter("n = 0")
    parts.append(none.select(F.lit("holdout_empty").alias("kind"), F.lit(None).cast("string").alias("key"), one))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def readiness(objects: DataFrame, classes: DataFrame, splits: list[str]) -> DataFrame:
    """Split x class cells without a box; an empty result means ready."""
    grid = classes.select("class_id", F.explode(F.array(*[F.lit(s) for s in splits])).alias("split"))
    return grid.join(objects.select("class_id", "split").distinct(), ["class_id", "split"], "left_anti")


def check_chronology(jobs: DataFrame) -> DataFrame:
    """Validation ends no later than the freeze, the freeze comes before the first test start, and
    no job ends before it starts. ``jobs``: phase (train/val/freeze/test), started, finished."""
    def when(phase, c):
        return F.when(F.col("phase") == phase, F.col(c))

    t = jobs.agg(
        F.max(when("train", "finished")).alias("train_end"), F.min(when("val", "started")).alias("val_start"),
        F.max(when("val", "finished")).alias("val_end"), F.max(when("freeze", "finished")).alias("freeze_end"),
        F.min(when("test", "started")).alias("test_start"),
        F.count_if(F.col("finished") < F.col("started")).alias("reversed_jobs"),
    )
    def ok(c):
        return F.coalesce(c, F.lit(False))

    return t.select(
        "*", ok(F.col("train_end") <= F.col("val_start")).alias("train_before_val"),
        ok(F.col("val_end") <= F.col("freeze_end")).alias("val_before_freeze"),
        ok(F.col("freeze_end") < F.col("test_start")).alias("freeze_before_test"),
    )


def audit_results(stored: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """Rows whose stored values differ from the recomputed ones, or exist on one side only.

    Keys may be NULL (totals) and are compared null-safe.
    """
    a = stored.select(*[F.col(k).alias(f"a_{k}") for k in keys], *[F.col(v).alias(f"a_{v}") for v in values], F.lit(1).alias("_a"))
    b = recomputed.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(v).alias(f"b_{v}") for v in values], F.lit(1).alias("_b"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    j = a.join(b, on, "full_outer")
    differing = F.array_compact(F.array(*[
        F.when(~near(F.col(f"a_{v}").cast("double"), F.col(f"b_{v}").cast("double"), tolerance), F.lit(v)) for v in values
    ]))
    status = F.when(F.col("_b").isNull(), "stored_only").when(F.col("_a").isNull(), "recomputed_only").when(
        F.size(differing) > 0, F.concat_ws(",", differing)
    )
    rows = j.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys], status.alias("problem"))
    return rows.filter(F.col("problem").isNotNull())


#: What ``audit_evaluation`` compares: table -> (keys, values).
EVALUATION = {
    "ap": (["max_det", "class_id"], ["ap50_95", "ap50", "ap75"]),
    "operating": (["class_id"], ["tp", "fp", "fn", "precision", "recall", "f1"]),
    "per_image": (["image_id", "class_id"], ["tp", "fp", "fn"]),
    "sizes": (["class_id", "size_bin"], ["detected", "total"]),
    "curve": (["class_id", "confidence"], ["tp", "fp", "fn", "f1"]),
    "threshold": ([], ["confidence", "f1"]),
}


def evaluation_tables(pred: DataFrame, gt: DataFrame, confidence: float) -> dict[str, DataFrame]:
    """The tables of ``EVALUATION``, from one matching for the counts and one for AP."""
    matches = cut(greedy_match(pred, gt))
    sweep = cut(metrics.threshold_sweep(matches, gt))
    return {
        "ap": metrics.coco_ap(coco_hits(pred, gt), metrics.truth_counts(gt)),
        "operating": metrics.operating_point(matches, gt, confidence),
        "per_image": metrics.operating_point(matches, gt, confidence, ["image_id"]),
        "sizes": metrics.size_recall(found_truth(matches, gt), confidence),
        "curve": sweep,
        "threshold": metrics.best_confidence(sweep),
    }


def audit_evaluation(pred: DataFrame, gt: DataFrame, images: DataFrame, stored: dict[str, DataFrame], confidence: float, tolerance: float = 1e-9) -> DataFrame:
    """Everything in stored result tables that a new evaluation does not give: ``table, key, problem``.

    ``stored`` holds tables of ``EVALUATION``; the ``problem`` of a row names its differing values, or the side on which it is missing. Predictions that
    leave their image (``images``: image_id, width, height), have no area or a score outside 0 to 1 are told as ``predictions``.
    """
    fresh = evaluation_tables(pred, gt, confidence)
    out = pred.join(images.select("image_id", "width", "height"), "image_id", "left").filter(~F.coalesce(
        (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= F.col("width")) & (F.col("y2") <= F.col("height"))
        & (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")) & F.col("score").between(0, 1), F.lit(False)))
    told = out.select(F.lit("predictions").alias("table"), F.concat_ws("/", "image_id", "pred_index").alias("key"), F.lit("out_of_bounds").alias("problem"))
    for name, table in stored.items():
        keys, values = EVALUATION[name]
        rows = audit_results(table, fresh[name], keys, values, tolerance)
        shown = [F.coalesce(F.col(k).cast("string"), F.lit("all")) for k in keys]
        told = told.unionByName(rows.select(F.lit(name).alias("table"), F.concat_ws("/", *shown).alias("key"), "problem"))
    return told


def audit_selection(candidates: DataFrame, stored: DataFrame, grid: DataFrame, tests: DataFrame) -> DataFrame:
    """Stored winners against recomputed ones, holes in the candidate grid, and test-job counts."""
    from boxloom.operators.selection import select_candidate

    now = select_candidate(candidates).select("arm", "candidate_id")
    wrong = stored.join(now, ["arm", "candidate_id"], "left_anti").select(
        F.lit("winner_differs").alias("problem"), F.col("candidate_id").alias("key")
    )
    holes = grid.join(candidates, grid.columns, "left_anti").select(
        F.lit("candidate_missing").alias("problem"), F.concat_ws("/", *grid.columns).alias("key")
    )
    cells = tests.groupBy("arm", "cohort").agg(F.count("*").alias("n")).filter("n <> 1").select(
        F.lit("not_one_test_job").alias("problem"), F.concat_ws("/", "arm", "cohort").alias("key")
    )
    return wrong.unionByName(holes).unionByName(cells)


def roundtrip_error(boxes: DataFrame, width: Column, height: Column, digits: int | None = None) -> DataFrame:
    """Largest coordinate change of pixels -> normalised (printed with ``digits``) -> pixels."""
    parts = box_to_yolo(box(), width, height)
    if digits is not None:
        parts = {n: F.round(c, digits) for n, c in parts.items()}
    back = box_from_yolo(parts["cx"], parts["cy"], parts["w"], parts["h"], width, height)
    return boxes.agg(F.count("*").alias("boxes"), F.max(max_difference(back, box())).alias("max_error"))


def unchanged_truth(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either version without an equal row in the other; empty when the truth is the same."""
    from boxloom.operators.sets import symmetric_difference

    return symmetric_difference(a, b)


def detection_parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two detection lists joined by position: class agreement, count and largest differences."""
    right = b.select(*keys, "rank", F.col("class_id").alias("_c"), F.col("score").alias("_s"),
                     *[F.col(n).alias("_" + n) for n in ("x1", "y1", "x2", "y2")])
    j = a.join(right, [*keys, "rank"], "full_outer")
    return j.agg(
        F.count("*").alias("positions"),
        F.count_if(F.col("class_id").isNull() | F.col("_c").isNull()).alias("unpaired"),
        F.count_if(F.col("class_id") != F.col("_c")).alias("class_changes"),
        F.max(F.abs(F.col("score") - F.col("_s"))).alias("max_score_diff"),
        F.max(max_difference(box(), box("_"))).alias("max_box_diff"),
    )


def reusable_jobs(jobs: DataFrame, outputs: DataFrame, files: DataFrame) -> DataFrame:
    """Completed jobs whose binding still holds and all of whose recorded outputs are unchanged.

    ``jobs``: job, status, binding, expected_binding; ``outputs``: job, path, sha256.
    """
    f = files.select("path", F.col("sha256").alias("_now"))
    broken = outputs.join(f, "path", "left").groupBy("job").agg(
        F.count_if(~F.coalesce(F.col("_now") == F.col("sha256"), F.lit(False))).alias("broken")
    )
    j = jobs.join(broken, "job", "left")
    reason = (
        F.when(F.col("status") != "completed", "not_completed").when(F.col("binding") != F.col("expected_binding"), "binding_changed")
        .when(F.col("broken").isNull(), "no_outputs").when(F.col("broken") > 0, "output_changed")
    )
    return j.select("job", reason.alias("reason"), reason.isNull().alias("reusable"))


def check_epochs(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Log problems per run: values that are not finite, repeated epochs, gaps in 1..n."""
    finite = F.lit(True)
    for v in values:
        finite = finite & is_finite(F.col(v))
    per = df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_distinct("epoch").alias("epochs"), F.min("epoch").alias("first"),
        F.max("epoch").alias("last"), F.count_if(~finite).alias("not_finite"),
    )
    return per.select(
        *keys, "rows", "not_finite", (F.col("rows") - F.col("epochs")).alias("repeated"),
        ((F.col("first") == 1) & (F.col("last") == F.col("epochs"))).alias("contiguous"),
    )


def views_agree(detect: DataFrame, segment: DataFrame) -> DataFrame:
    """Differences between two task views of one dataset: ``id, problem``.

    Shared ids must have equal digest, split, group and objects; the segment view must hold exactly
    the rows whose every object has one polygon part.
    """
    cols = ["sha256", "split", "group_id", "objects"]
    s = segment.select("id", *[F.col(c).alias("_" + c) for c in cols])
    j = detect.join(s, "id", "full_outer")
    single = F.forall("objects", lambda o: F.size(o["parts"]) == 1)
    rules = [
        ("not_in_detect", F.col("sha256").isNull()),
        ("should_be_in_segment", F.coalesce(F.col("_sha256").isNull() & single, F.lit(False))),
        ("should_not_be_in_segment", F.coalesce(F.col("_sha256").isNotNull() & ~single, F.lit(False))),
        *[(f"{c}_differs", F.coalesce(F.col(c) != F.col("_" + c), F.lit(False))) for c in cols],
    ]
    return j.select("id", F.explode(_problems(rules)).alias("problem"))


def assert_single_eval(results: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Runs evaluated more than once or on other weights than their summary names."""
    per = results.groupBy("run").agg(F.count("*").alias("evaluations"), F.max("weights_sha").alias("sha"))
    j = per.join(checkpoints.select("run", F.col("sha256").alias("_now")), "run", "left")
    problem = F.when(F.col("evaluations") > 1, "evaluated_twice").when(
        ~F.coalesce(F.col("sha") == F.col("_now"), F.lit(False)), "weights_changed"
    )
    return j.select("run", "evaluations", problem.alias("problem")).filter(F.col("problem").isNotNull())

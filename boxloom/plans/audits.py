"""Queries on manifest, dataset, job and result audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions.boxes import box, box_problems
from boxloom.operators import audit as dq
from boxloom.operators import metrics as ag
from boxloom.operators import sets as st
from boxloom.plans.curation import DIHEDRAL_SQL, FILES_SQL, RANK, files, files_later, with_variants
from boxloom.plans.derive import IMAGE_HEIGHT, IMAGE_WIDTH, Tables, with_sql
from boxloom.plans.matching import PRF_SQL, match_with, matches, rounded
from boxloom.plans.metrics import point_sql
from boxloom.plans.registry import query
from boxloom.sources import annotations as an

HASH_SPLIT = """CASE WHEN sha256('boxloom|' || {k}) <= 'b333333333333333333333333333333333333333333333333333333333333333' THEN 'train'
  WHEN sha256('boxloom|' || {k}) <= 'd999999999999999999999999999999999999999999999999999999999999999' THEN 'val' ELSE 'test' END"""
MANIFEST_SQL = with_sql("records") + f""", man AS (SELECT doc_id AS record_id, 'i/' || CASE WHEN toxic = 1 THEN n_chars ELSE doc_id END AS image, 'l/' || doc_id AS label, sha AS sha256,
  CASE WHEN quality = 0 THEN source ELSE lang || (doc_id // 4) END AS group_id, CASE WHEN lang = 'es' AND n_chars < 300 THEN 'dev' ELSE {HASH_SPLIT.format(k='(doc_id // 4)')} END AS split,
  CASE WHEN n_chars % 10 = 0 THEN 'weak' WHEN n_chars % 10 = 1 THEN 'guess' ELSE 'reviewed' END AS annotation_status FROM records)"""


def manifest(t: Tables):
    from boxloom.operators.splits import hash_split_of

    block = F.expr("doc_id div 4")
    s = F.col
    return t.records().select(
        s("doc_id").alias("record_id"),
        F.concat(F.lit("i/"), F.when(s("toxic") == 1, s("n_chars")).otherwise(s("doc_id")).cast("string")).alias("image"),
        F.concat(F.lit("l/"), s("doc_id").cast("string")).alias("label"), s("sha").alias("sha256"),
        F.when(s("quality") == 0, s("source")).otherwise(F.concat("lang", block.cast("string"))).alias("group_id"),
        F.when((s("lang") == "es") & (s("n_chars") < 300), "dev").otherwise(hash_split_of(block, "boxloom")).alias("split"),
        F.when(s("n_chars") % 10 == 0, "weak").when(s("n_chars") % 10 == 1, "guess").otherwise("reviewed").alias("annotation_status"),
    )


PROBLEM_SQL = MANIFEST_SQL + """, k AS (SELECT *, CASE WHEN split IN ('train','val','test') THEN split END AS sp FROM man),
gs AS (SELECT group_id, count(DISTINCT sp) AS n FROM k GROUP BY 1), hs AS (SELECT sha256, count(DISTINCT sp) AS s, count(*) AS n FROM k GROUP BY 1),
im AS (SELECT image, count(*) AS n FROM k GROUP BY 1),
prob AS (
  SELECT record_id, 'error' AS level, 'split_unknown' AS problem FROM k WHERE sp IS NULL
  UNION ALL SELECT record_id, 'error', 'group_leak' FROM k JOIN gs USING (group_id) WHERE gs.n > 1
  UNION ALL SELECT record_id, 'error', 'status_unknown' FROM k WHERE annotation_status = 'guess'
  UNION ALL SELECT record_id, 'error', 'weak_outside_train' FROM k WHERE annotation_status = 'weak' AND split <> 'train'
  UNION ALL SELECT record_id, 'error', 'duplicate_image' FROM k JOIN im USING (image) WHERE im.n > 1
  UNION ALL SELECT record_id, 'error', 'hash_leak' FROM k JOIN hs USING (sha256) WHERE hs.s > 1
  UNION ALL SELECT record_id, 'warning', 'duplicate_content' FROM k JOIN hs USING (sha256) WHERE hs.n > 1 AND hs.s <= 1)"""


@query("dq1", PROBLEM_SQL + " SELECT * FROM prob")
def manifest_rules(t):
    return dq.validate_manifest(manifest(t))


@query("dq1_verdict", PROBLEM_SQL + """ SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test,
  (SELECT count(*) FROM prob WHERE level = 'error') AS errors, (SELECT count(*) FROM prob WHERE level = 'error') = 0 AS valid, count(*) FILTER (split = 'test') = 0 AS partial_evaluation,
  CASE WHEN (SELECT count(*) FROM prob WHERE level = 'error') = 0 THEN 'validation_and_test' END AS scope FROM man""")
def verdict(t):
    return dq.manifest_verdict(manifest(t), dq.validate_manifest(manifest(t)))


NAMES = ["resistor", "capacitor", "ic", "connector", "led"]
# a label line per record and step; class 5 is none, and one record in seven has a point outside the image
LINES_SQL = """, ln AS (SELECT record_id, split, s, CAST((record_id::BIGINT + s) % 6 AS INTEGER) AS c, record_id::BIGINT % 7 = 0 AS far
  FROM man, range(0, 3) r(s) WHERE s < record_id::BIGINT % 4 AND record_id::BIGINT % 9 <> 0)"""


def head_of(t: Tables, **other):
    row = {"schema": "s1", "names": NAMES, "domain": "proxy", "annotation_policy": "native", "source_url": "u", "class_mapping": {"a": "b"}} | other
    kinds = "schema string, names array<string>, domain string, annotation_policy string, source_url string, class_mapping map<string,string>"
    return t.spark.createDataFrame([tuple(row[k.split()[0]] for k in kinds.split(", "))], kinds)


def label_lines(t: Tables):
    """The polygon lines of every record, as its label file, and what the parser says of each."""
    k = F.col("record_id").cast("long")
    step = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s")
    rows = manifest(t).select("record_id", "label", step).filter((F.col("s") < k % 4) & (k % 9 != 0))
    point = F.when(k % 7 == 0, "1.5").otherwise("0.5")
    line = F.concat_ws(" ", ((k + F.col("s")) % 6).cast("string"), F.lit("0.1 0.1 0.9 0.1"), point, F.lit("0.9"))
    docs = rows.groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    return an.parse_yolo(docs.select(F.col("label").alias("path"), "content", F.lit(100).alias("width"), F.lit(100).alias("height")), len(NAMES), "polygon")


@query("dq1_content", MANIFEST_SQL + LINES_SQL + """ SELECT record_id, 'error' AS level, 'image_unreadable' AS problem, CAST(NULL AS INTEGER) AS detail FROM man WHERE record_id::BIGINT % 13 = 0
  UNION ALL SELECT record_id, 'error', 'image_not_decoded', NULL FROM man WHERE record_id::BIGINT % 13 <> 0 AND record_id::BIGINT % 17 = 0
  UNION ALL SELECT record_id, 'error', 'label_unreadable', NULL FROM man WHERE record_id::BIGINT % 9 = 0
  UNION ALL SELECT record_id, 'error', CASE WHEN c = 5 THEN 'label_unknown_class' ELSE 'label_out_of_range' END, CAST(s + 1 AS INTEGER) FROM ln WHERE c = 5 OR far""")
def manifest_contents(t):
    """Files that are missing or don't decode, and label lines that break a rule."""
    m, k = manifest(t).withColumn("image", F.concat(F.lit("i/"), "record_id")), F.col("record_id").cast("long")
    images = m.filter(k % 13 != 0).select(F.col("image").alias("path"), F.when(k % 17 == 0, 0).otherwise(64).alias("width"), F.lit(64).alias("height"))
    labels = m.filter(k % 9 != 0).select(F.col("label").alias("path"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    return dq.content_problems(m.select("record_id", "image", "label"), images.unionByName(labels), label_lines(t))


@query("dq1_splits", MANIFEST_SQL + LINES_SQL + """, lab AS (SELECT record_id, split, c FROM ln WHERE c < 5 AND NOT far AND (split <> 'test' OR c < 3)),
  g AS (SELECT s.split, c.c FROM (SELECT unnest(['train', 'val', 'test']) AS split) s, range(0, 5) c(c))
  SELECT g.split, 'warning' AS level, 'class_without_instances' AS problem, ['resistor', 'capacitor', 'ic', 'connector', 'led'][g.c + 1] AS class_name
  FROM g WHERE EXISTS (SELECT 1 FROM man WHERE man.split = g.split) AND NOT EXISTS (SELECT 1 FROM lab WHERE lab.split = g.split AND lab.c = g.c)
  UNION ALL SELECT s, CASE s WHEN 'test' THEN 'warning' ELSE 'error' END, CASE s WHEN 'test' THEN 'test_absent' ELSE 'split_absent' END, NULL FROM (SELECT unnest(['train', 'val', 'test']) AS s) WHERE s NOT IN (SELECT split FROM man)
  UNION ALL SELECT s, 'error', 'no_instances', NULL FROM (SELECT unnest(['train', 'val']) AS s) WHERE s IN (SELECT split FROM man) AND s NOT IN (SELECT split FROM lab)""")
def manifest_splits(t):
    """Splits and classes without instances; of the test split only three classes are labelled."""
    m = manifest(t)
    good = label_lines(t).filter("problem IS NULL").select(F.col("path").alias("label"), F.col("native_class_id").alias("class_id"))
    rows = m.join(good, "label").filter("split <> 'test' OR class_id < 3").select("record_id", "class_id")
    return dq.split_problems(m.select("record_id", "split"), rows, NAMES)


INDEX_SQL = f"""{FILES_SQL}, idx AS (SELECT p_partkey AS id, {HASH_SPLIT.format(k='p_partkey')} AS split, CASE WHEN p_size < 3 THEN 's' || p_size ELSE 'p' || p_partkey END AS source_group,
  'f' || p_partkey AS family, path AS image, sha256 AS image_sha256, p_size * 10 AS width, 300 AS height FROM files),
disk AS (SELECT path, sha256, p_size * 10 + (p_size = 20)::INT AS width, 300 AS height FROM files2),
lab AS (SELECT l_partkey AS id, l_linenumber - 1 AS class_id, l_discount * 5 AS cx, 0.5::DOUBLE AS cy, l_quantity / 100 AS w, l_tax AS h FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-01-01')"""


def index(t: Tables):
    from boxloom.operators.splits import hash_split_of

    size = F.col("p_size")
    return files(t).select(
        F.col("p_partkey").alias("id"), hash_split_of(F.col("p_partkey"), "boxloom").alias("split"),
        F.when(size < 3, F.concat(F.lit("s"), size.cast("string"))).otherwise(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("source_group"),
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("family"), F.col("path").alias("image"),
        F.col("sha256").alias("image_sha256"), (size * 10).alias("width"), F.lit(300).alias("height"),
    )


@query("dq2", f"""WITH {INDEX_SQL},
f AS (SELECT idx.*, disk.path, disk.sha256 AS fs, disk.width AS fw, coalesce(image, path) AS k FROM idx FULL JOIN disk ON disk.path = idx.image)
SELECT 'missing_file' AS kind, k AS key FROM f WHERE path IS NULL UNION ALL SELECT 'orphan_file', k FROM f WHERE id IS NULL
UNION ALL SELECT 'changed_bytes', k FROM f WHERE fs <> image_sha256 UNION ALL SELECT 'dimension_drift', k FROM f WHERE fw <> width
UNION ALL SELECT 'source_group_spans_splits', source_group FROM idx GROUP BY source_group HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'bytes_span_splits', image_sha256 FROM idx GROUP BY image_sha256 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'bad_label', CAST(id AS VARCHAR) FROM lab WHERE class_id > 5 OR w <= 0 OR h <= 0 OR cx - w/2 < -1e-6 OR cx + w/2 > 1 + 1e-6 OR cy - h/2 < -1e-6 OR cy + h/2 > 1 + 1e-6
UNION ALL SELECT 'no_labels', CAST(id AS VARCHAR) FROM idx WHERE id NOT IN (SELECT id FROM lab)""")
def dataset(t):
    disk = files_later(t).select(
        "path", "sha256", (F.col("p_size") * 10 + (F.col("p_size") == 20).cast("int")).alias("width"), F.lit(300).alias("height")
    )
    labels = t.read("lineitem").filter("l_shipdate < TIMESTAMP '2001-01-01'").select(
        F.col("l_partkey").alias("id"), (F.col("l_linenumber") - 1).alias("class_id"), (F.col("l_discount") * 5).alias("cx"),
        F.lit(0.5).alias("cy"), (F.col("l_quantity") / 100).alias("w"), F.col("l_tax").alias("h"),
    )
    return dq.verify_dataset(index(t), disk, labels, 6)


@query("dq2_near", DIHEDRAL_SQL + """, sp AS (SELECT vec_id, code, label, CASE WHEN label < 5 THEN 'train' WHEN label < 7 THEN 'val' ELSE 'test' END AS split FROM codes WHERE label <> 9),
  c2 AS (SELECT code, min(vec_id) AS id FROM sp GROUP BY code), members AS (SELECT id, split, count(*) AS n FROM sp JOIN c2 USING (code) GROUP BY ALL),
  turned2 AS (SELECT c2.id, v.variant FROM c2 JOIN var v ON v.vec_id = c2.id),
  near2 AS (SELECT DISTINCT least(a.id, b.id) AS x, greatest(a.id, b.id) AS y FROM turned2 a JOIN c2 b ON a.id <> b.id AND bit_count(xor(a.variant, b.code)) <= 6 UNION ALL SELECT id, id FROM c2),
  leaks AS (SELECT x, y, CAST(sum(a.n * b.n) AS BIGINT) AS pairs FROM near2 JOIN members a ON a.id = x JOIN members b ON b.id = y WHERE a.split <> b.split AND (x <> y OR a.split < b.split) GROUP BY x, y),
  hold AS (SELECT 'h' || vec_id AS name, vec_id FROM codes WHERE label = 9)
  SELECT 'near_copies_span_splits' AS kind, x || '~' || y AS key, pairs FROM leaks
  UNION ALL SELECT DISTINCT 'near_holdout', CAST(s.vec_id AS VARCHAR), 1 FROM sp s JOIN var a ON a.vec_id = s.vec_id, hold h JOIN var b ON b.vec_id = h.vec_id WHERE bit_count(xor(a.variant, b.variant)) <= 8
  UNION ALL SELECT 'holdout_changed', name, 1 FROM hold WHERE vec_id % 11 = 0""")
def near_copies_of_a_dataset(t):
    """Vectors of one label are the holdout, of which the stored inventory lacks some; the others are the dataset."""
    v = with_variants(t)
    split = F.when(F.col("label") < 5, "train").when(F.col("label") < 7, "val").otherwise("test")
    hold = v.filter("label = 9").select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("name"), "variants", "id")
    return dq.near_copy_problems(v.filter("label <> 9").withColumn("split", split), hold, hold.filter("id % 11 <> 0"))


META_SQL = """m AS (SELECT o_orderkey AS row_id, 'src:' || o_orderstatus AS source_id, 'g.' || o_custkey AS group_id,
  CASE WHEN o_custkey % 97 = 0 THEN '-bad' ELSE 'img' || (o_orderkey // 2 * 2 + (o_custkey % 50 > 0)::INT * (o_orderkey % 2)) END AS image_id,
  CASE o_custkey % 53 WHEN 0 THEN '/abs/' WHEN 1 THEN 'a/../' WHEN 2 THEN 'a//' WHEN 3 THEN './' ELSE 'a/b/' END || o_orderkey || '.jpg' AS relative_path,
  sha256(CAST(CASE WHEN o_custkey % 40 = 0 THEN o_custkey ELSE -o_orderkey END AS VARCHAR)) AS image_sha256,
  CASE WHEN o_custkey % 61 = 0 THEN 'ABC' ELSE sha256(CAST(o_orderkey AS VARCHAR)) END AS annotation_sha256,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'draft' ELSE 'complete_ic_bbox' END AS label_status, 'CC-BY-4.0' AS license_id,
  CASE WHEN o_custkey % 71 = 0 THEN ' ' ELSE 'local_use_verified' END AS license_review FROM orders)"""


def metadata(t: Tables):
    c, k = F.col("o_custkey"), F.col("o_orderkey")

    def s(v):
        return v.cast("string")

    image = F.expr("o_orderkey div 2") * 2 + (c % 50 > 0).cast("int") * (k % 2)
    folder = F.when(c % 53 == 0, "/abs/").when(c % 53 == 1, "a/../").when(c % 53 == 2, "a//").when(c % 53 == 3, "./").otherwise("a/b/")
    return t.read("orders").select(
        k.alias("row_id"), F.concat(F.lit("src:"), "o_orderstatus").alias("source_id"), F.concat(F.lit("g."), s(c)).alias("group_id"),
        F.when(c % 97 == 0, "-bad").otherwise(F.concat(F.lit("img"), s(image))).alias("image_id"),
        F.concat(folder, s(k), F.lit(".jpg")).alias("relative_path"),
        F.sha2(s(F.when(c % 40 == 0, c).otherwise(-k)), 256).alias("image_sha256"),
        F.when(c % 61 == 0, "ABC").otherwise(F.sha2(s(k), 256)).alias("annotation_sha256"),
        F.when(F.col("o_orderpriority") == "5-LOW", "draft").otherwise("complete_ic_bbox").alias("label_status"),
        F.lit("CC-BY-4.0").alias("license_id"), F.when(c % 71 == 0, " ").otherwise("local_use_verified").alias("license_review"),
    )


@query("dq3", f"""WITH {META_SQL}, a AS (SELECT *, count(*) OVER (PARTITION BY source_id, image_id) AS n1, count(*) OVER (PARTITION BY source_id, relative_path) AS n2,
    count(*) OVER (PARTITION BY image_sha256) AS n3 FROM m)
SELECT row_id, 'empty_value' AS problem FROM a WHERE license_review = ' ' UNION ALL SELECT row_id, 'bad_id' FROM a WHERE image_id = '-bad'
UNION ALL SELECT row_id, 'bad_path' FROM a WHERE relative_path NOT LIKE 'a/b/%' UNION ALL SELECT row_id, 'bad_hash' FROM a WHERE annotation_sha256 = 'ABC'
UNION ALL SELECT row_id, 'labels_incomplete' FROM a WHERE label_status = 'draft' UNION ALL SELECT row_id, 'rights_unverified' FROM a WHERE license_review = ' '
UNION ALL SELECT row_id, 'duplicate_image_id' FROM a WHERE n1 > 1 UNION ALL SELECT row_id, 'duplicate_path' FROM a WHERE n2 > 1 UNION ALL SELECT row_id, 'duplicate_hash' FROM a WHERE n3 > 1""")
def contract(t):
    return dq.validate_rows(metadata(t))


@query("dq4", with_sql("gt") + """ SELECT image_id, gt_index, list_filter([CASE WHEN x2 > 440 OR y2 > 340 THEN 'outside_image' END, CASE WHEN class_id > 2 THEN 'unknown_class' END], lambda p: p IS NOT NULL) AS problems
  FROM gt WHERE x2 > 440 OR y2 > 340 OR class_id > 2""")
def held(t):
    problems = box_problems(box(), F.lit(440), F.lit(340), F.col("class_id"), 3)
    return dq.quarantine(t.gt(), problems)[1].select("image_id", "gt_index", "problems")


JOBS_SQL = """jobs AS (SELECT CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'val' WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'freeze' ELSE 'test' END AS phase,
  o_orderdate AS started, o_orderdate + to_days(CAST(o_custkey % 3 AS INTEGER)) AS finished FROM orders)"""


@query("dq5", f"""WITH {JOBS_SQL}, a AS (SELECT max(finished) FILTER (phase = 'train') AS train_end, min(started) FILTER (phase = 'val') AS val_start, max(finished) FILTER (phase = 'val') AS val_end,
  max(finished) FILTER (phase = 'freeze') AS freeze_end, min(started) FILTER (phase = 'test') AS test_start, count(*) FILTER (finished < started) AS reversed_jobs FROM jobs)
  SELECT *, train_end <= val_start AS train_before_val, val_end <= freeze_end AS val_before_freeze, freeze_end < test_start AS freeze_before_test FROM a""")
def chronology(t):
    d = F.col("o_orderdate")
    phase = F.when(d < "1996-01-01", "train").when(d < "1998-01-01", "val").when(d < "1999-01-01", "freeze").otherwise("test")
    jobs = t.read("orders").select(
        phase.alias("phase"), d.alias("started"), F.expr("o_orderdate + make_dt_interval(cast(o_custkey % 3 as int))").alias("finished")
    )
    return dq.check_chronology(jobs)


@query("dq6", match_with() + point_sql("", where="score >= 0.5") + f""", st AS (SELECT *{PRF_SQL} FROM op)
  SELECT class_id, 'fn,recall' AS problem FROM st WHERE class_id = 1""")
def parity(t):
    now = ag.operating_point(matches(t), t.gt(), 0.5)
    wrong = F.col("class_id") == 1
    stored = now.withColumn("fn", F.when(wrong, F.col("fn") + 1).otherwise(F.col("fn"))).withColumn(
        "recall", F.when(wrong, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.col("recall"))
    )
    return dq.audit_results(stored, now, ["class_id"], ["tp", "fp", "fn", "precision", "recall"], 1e-9)


@query("dq6_full", with_sql("gt", "pred", "images") + """, sz AS (SELECT DISTINCT CASE WHEN least(x2-x1, y2-y1) < 8 THEN 'lt8' WHEN least(x2-x1, y2-y1) < 16 THEN '8to16' WHEN least(x2-x1, y2-y1) < 32 THEN '16to32' ELSE 'ge32' END AS b FROM gt WHERE class_id = 3)
  SELECT 'ap' AS "table", '100/2' AS key, 'ap50' AS problem UNION ALL SELECT 'operating', '99', 'stored_only'
  UNION ALL SELECT 'per_image', image_id || '/' || class_id, 'tp,fn' FROM (SELECT image_id, CAST(class_id AS VARCHAR) AS class_id FROM gt UNION SELECT image_id, CAST(class_id AS VARCHAR) FROM pred WHERE score >= 0.5 UNION SELECT image_id, 'all' FROM gt) WHERE image_id % 97 = 0
  UNION ALL SELECT 'sizes', '3/' || b, 'recomputed_only' FROM sz UNION ALL SELECT 'sizes', '3/all', 'recomputed_only'
  UNION ALL SELECT 'curve', 'all/0.5', 'f1' UNION ALL SELECT 'threshold', '', 'confidence'
  UNION ALL SELECT 'predictions', p.image_id || '/' || pred_index, 'out_of_bounds' FROM pred p JOIN images i ON i.image_id = p.image_id
    WHERE NOT (x1 >= 0 AND y1 >= 0 AND x2 <= width AND y2 <= height AND x1 < x2 AND y1 < y2 AND score BETWEEN 0 AND 1)""")
def full_parity(t):
    """Every stored table with some fault: a value, a row too many, rows too few."""
    stored = dict(dq.evaluation_tables(t.pred(), t.gt(), 0.5))
    bump = lambda df, name, where, by: df.withColumn(name, F.when(where, F.col(name) + by).otherwise(F.col(name)))
    stored["ap"] = bump(stored["ap"], "ap50", F.coalesce((F.col("class_id") == 2) & (F.col("max_det") == 100), F.lit(False)), 0.01)
    stored["operating"] = stored["operating"].unionByName(stored["operating"].filter("class_id = 1").withColumn("class_id", F.lit(99)))
    odd = F.col("image_id") % 97 == 0
    stored["per_image"] = bump(bump(stored["per_image"], "tp", odd, 1), "fn", odd, -1)
    stored["sizes"] = stored["sizes"].filter("class_id IS NULL OR class_id <> 3")
    stored["curve"] = bump(stored["curve"], "f1", F.col("class_id").isNull() & (F.abs(F.col("confidence") - 0.5) < 1e-9), 0.1)
    stored["threshold"] = stored["threshold"].withColumn("confidence", F.col("confidence") + 0.05)
    return dq.audit_evaluation(t.pred(), t.gt(), t.images(), stored, 0.5)


@query("dq7", with_sql("candidates") + f""", w AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY {RANK}) AS rn FROM candidates)
  SELECT 'winner_differs' AS problem, candidate_id AS key FROM w WHERE arm = 'b' AND rn = 2
  UNION ALL SELECT 'candidate_missing', 'a/' || e || '/' || p FROM (SELECT DISTINCT epoch AS e FROM candidates) CROSS JOIN (SELECT DISTINCT pipeline AS p FROM candidates)
    WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.arm = 'a' AND c.epoch = e AND c.pipeline = p)
  UNION ALL SELECT 'not_one_test_job', arm || '/' || pipeline FROM candidates GROUP BY arm, pipeline HAVING count(*) <> 1""")
def selection(t):
    from boxloom.operators.selection import ranks

    c = t.candidates()
    second = ranks(c, ["arm"]).filter("(arm = 'b' AND rank = 2) OR (arm = 'a' AND rank = 1)").select("arm", "candidate_id")
    pipelines = c.agg(F.collect_set("pipeline")).scalar()
    grid = c.select(F.lit("a").alias("arm"), "epoch").distinct().withColumn("_p", pipelines).select(
        "arm", "epoch", F.explode("_p").alias("pipeline")
    )
    tests = c.select("arm", F.col("pipeline").cast("string").alias("cohort"))
    return dq.audit_selection(c, second, grid, tests)


@query("dq9", with_sql("gt") + f""", y AS (SELECT *, round((x1+x2)/(2*{IMAGE_WIDTH}), 6) AS cx, round((x2-x1)/{IMAGE_WIDTH}, 6) AS w, round((y1+y2)/(2*{IMAGE_HEIGHT}), 6) AS cy, round((y2-y1)/{IMAGE_HEIGHT}, 6) AS h FROM gt)
  SELECT count(*) AS boxes, round(max(greatest(abs((cx-w/2)*{IMAGE_WIDTH}-x1), abs((cx+w/2)*{IMAGE_WIDTH}-x2), abs((cy-h/2)*{IMAGE_HEIGHT}-y1), abs((cy+h/2)*{IMAGE_HEIGHT}-y2))), 9) AS max_error FROM y""")
def round_trip(t):
    rows = dq.roundtrip_error(t.gt(), F.lit(float(IMAGE_WIDTH)), F.lit(float(IMAGE_HEIGHT)), 6)
    return rounded(rows, ("max_error",))


@query("dq10", f"WITH {FILES_SQL} SELECT path, sha256, 'left' AS side FROM (SELECT path, sha256 FROM files EXCEPT ALL SELECT path, sha256 FROM files2) UNION ALL SELECT path, sha256, 'right' FROM (SELECT path, sha256 FROM files2 EXCEPT ALL SELECT path, sha256 FROM files)")
def truth_versions(t):
    return dq.unchanged_truth(files(t).select("path", "sha256"), files_later(t).select("path", "sha256"))


@query("dq11", with_sql("pred") + """ SELECT count(*) AS positions, CAST(0 AS BIGINT) AS unpaired, CAST(0 AS BIGINT) AS class_changes, CAST(0.0 AS DOUBLE) AS max_score_diff, 0.25::DOUBLE AS max_box_diff FROM pred""")
def replay(t):
    a = t.pred().withColumnRenamed("pred_index", "rank")
    return dq.detection_parity(a, a.withColumn("x1", F.col("x1") + 0.25), ["image_id"])


@query("dq12", f"""WITH {FILES_SQL}, b AS (SELECT f.p_size AS job, count(*) FILTER (n.sha256 IS DISTINCT FROM f.sha256) AS broken FROM files f LEFT JOIN files2 n ON n.path = f.path GROUP BY 1),
  j AS (SELECT DISTINCT p_size AS job, CASE WHEN p_size % 10 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN p_size = 13 THEN 'x' ELSE 'y' END AS binding FROM files)
  SELECT job, CASE WHEN status <> 'completed' THEN 'not_completed' WHEN binding <> 'y' THEN 'binding_changed' WHEN broken > 0 THEN 'output_changed' END AS reason,
    status = 'completed' AND binding = 'y' AND broken = 0 AS reusable FROM j LEFT JOIN b USING (job)""")
def reuse(t):
    f = files(t).withColumn("job", F.col("p_size"))
    jobs = f.select("job").distinct().select(
        "job", F.when(F.col("job") % 10 == 0, "failed").otherwise("completed").alias("status"),
        F.when(F.col("job") == 13, "x").otherwise("y").alias("binding"), F.lit("y").alias("expected_binding"),
    )
    return dq.reusable_jobs(jobs, f.select("job", "path", "sha256"), files_later(t))


@query("dq13", """WITH l AS (SELECT l_suppkey AS run, l_linenumber AS epoch, l_quantity > 49.5 AS bad FROM lineitem)
  SELECT run, count(*) AS rows, count(*) FILTER (bad) AS not_finite, count(*) - count(DISTINCT epoch) AS repeated, min(epoch) = 1 AND max(epoch) = count(DISTINCT epoch) AS contiguous FROM l GROUP BY run""")
def logs(t):
    loss = F.when(F.col("l_quantity") > 49.5, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    log = t.read("lineitem").select(
        F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch"), loss.alias("loss")
    )
    return dq.check_epochs(log, ["run"], ["loss"])


@query("dq14", """WITH o AS (SELECT o_custkey AS id, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS multi FROM orders GROUP BY 1)
  SELECT id, 'should_be_in_segment' AS problem FROM o WHERE multi = 0 AND id % 41 = 0
  UNION ALL SELECT id, 'split_differs' FROM o WHERE multi = 0 AND id % 41 <> 0 AND id % 5 = 0""")
def task_views(t):
    parts = F.when(F.col("o_orderstatus") == "P", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    detect = t.read("orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", parts.alias("parts")))).alias("objects")
    ).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.lit("train").alias("split"), F.lit("g").alias("group_id"), "objects")
    single = detect.filter(F.forall("objects", lambda o: F.size(o["parts"]) == 1))
    segment = single.filter("id % 41 <> 0").withColumn("split", F.when(F.col("id") % 5 == 0, "val").otherwise("train"))
    return dq.views_agree(detect, segment)


@query("dq15", """WITH r AS (SELECT o_custkey AS run, count(*) AS evaluations FROM orders GROUP BY 1)
  SELECT run, evaluations, CASE WHEN evaluations > 1 THEN 'evaluated_twice' ELSE 'weights_changed' END AS problem FROM r JOIN customer ON c_custkey = run WHERE evaluations > 1 OR c_nationkey = 4""")
def single_evaluation(t):
    results = t.read("orders").select(
        F.col("o_custkey").alias("run"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("weights_sha")
    )
    now = F.when(F.col("c_nationkey") == 4, "x").otherwise(F.sha2(F.col("c_custkey").cast("string"), 256))
    return dq.assert_single_eval(results, t.read("customer").select(F.col("c_custkey").alias("run"), now.alias("sha256")))


@query("ag24", f"WITH {FILES_SQL} SELECT p_size AS dataset, count(*) AS n, {st.list_digest_sql("path || chr(0) || sha256 || chr(10)")} AS digest FROM files GROUP BY p_size")
def dataset_digests(t):
    return st.dataset_fingerprint(files(t).withColumnRenamed("p_size", "dataset"), ["dataset"])


@query("ag25", with_sql("gt") + """, s AS (SELECT DISTINCT class_id, split FROM gt WHERE NOT (class_id = 2 AND split = 'val'))
  SELECT class_id, split FROM (SELECT DISTINCT class_id FROM gt) CROSS JOIN (VALUES ('train'), ('val'), ('test')) v(split) EXCEPT SELECT class_id, split FROM s""")
def missing_classes(t):
    g = t.gt()
    return dq.readiness(g.filter("NOT (class_id = 2 AND split = 'val')"), g.select("class_id").distinct(), dq.SPLITS)

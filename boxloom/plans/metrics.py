"""Queries on average precision, recall tables, summaries and caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.operators import masks as mk
from boxloom.operators import matching as mt
from boxloom.operators import metrics as ag
from boxloom.plans.derive import IMAGE_HEIGHT, IMAGE_WIDTH, Tables, with_sql
from boxloom.plans.matching import PRF_SQL, ROUNDED_SQL, greedy_sql, level_list, match_with, matches, rounded
from boxloom.plans.registry import query

SIZE_SQL = """CASE WHEN least(x2 - x1, y2 - y1) < 8 THEN 'lt8' WHEN least(x2 - x1, y2 - y1) < 16 THEN '8to16'
  WHEN least(x2 - x1, y2 - y1) < 32 THEN '16to32' ELSE 'ge32' END"""


def point_sql(key: str, matched: str = "m", where: str = "TRUE") -> str:
    """Rows (key, class_id, tp, fp, fn) with NULL class for all classes, as table ``op``."""
    k = f"{key}, " if key else ""
    return f""", pc AS (
  SELECT {k}class_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(gt) AS BIGINT) AS gt FROM (
    SELECT {k}class_id, (gt_index IS NOT NULL)::INT AS tp, (gt_index IS NULL)::INT AS fp, 0 AS gt FROM {matched} WHERE {where}
    UNION ALL SELECT {k}class_id, 0, 0, 1 FROM gt) GROUP BY {k}class_id),
op AS (
  SELECT {k}class_id, tp, fp, gt - tp AS fn FROM pc UNION ALL
  SELECT {k}NULL, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(gt) - sum(tp) AS BIGINT) FROM pc
  {'GROUP BY ' + key if key else ''})"""


@query("ag1", match_with() + point_sql("", where="score >= 0.5")
       + f" SELECT class_id, tp, fp, fn, {ROUNDED_SQL} FROM (SELECT *{PRF_SQL} FROM op)")
def operating(t):
    return rounded(ag.operating_point(matches(t), t.gt(), 0.5))


@query("ag1_images", match_with() + point_sql("image_id", where="score >= 0.5")
       + f" SELECT image_id, class_id, tp, fp, fn, {ROUNDED_SQL} FROM (SELECT *{PRF_SQL} FROM op)")
def operating_by_image(t):
    return rounded(ag.operating_point(matches(t), t.gt(), 0.5, ["image_id"]))


@query("ag12", match_with() + ", mg AS (SELECT *, image_id % 29 AS group_id FROM m)"
       + point_sql("group_id", "mg", "score >= 0.5")
       + f" SELECT group_id, class_id, tp, fp, fn, {ROUNDED_SQL} FROM (SELECT *{PRF_SQL} FROM op)")
def operating_by_group(t):
    by_group = matches(t).withColumn("group_id", F.col("image_id") % 29)
    return rounded(ag.operating_point(by_group, t.gt(), 0.5, ["group_id"]))


def ap_sql(keys: str, npos: str, source: str = "m") -> str:
    """AP per (keys, class_id, iou_level) as table ``ap``; ``npos`` is a table (keys, class_id, npos)."""
    k = f"{keys}, " if keys else ""
    return f""", flags AS (
  SELECT {k}class_id, iou_level, gt_index IS NOT NULL AS hit,
    row_number() OVER w AS n, sum((gt_index IS NOT NULL)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS tp
  FROM {source} WINDOW w AS (PARTITION BY {k}class_id, iou_level ORDER BY score DESC, image_id, rank)),
pts AS (
  SELECT {k}class_id, iou_level, tp / npos::DOUBLE AS reach, tp / n::DOUBLE AS prec
  FROM flags JOIN {npos} USING ({k}class_id) WHERE hit),
q AS (
  SELECT {k}class_id, iou_level, i, max(prec) FILTER (reach >= i * 0.01::DOUBLE) AS q
  FROM pts, range(0, 101) r(i) GROUP BY ALL),
ap AS (SELECT {k}class_id, iou_level, sum(coalesce(q, 0)) / 101 AS ap FROM q GROUP BY ALL)"""


COUNTS_SQL = ", npos AS (SELECT class_id, count(*) AS npos FROM gt GROUP BY class_id)"


def _capped_ap(cap: int) -> str:
    """AP of the first ``cap`` predictions of a group; its matches are the prefix of ``m``."""
    return (
        f"SELECT {cap} AS max_det, class_id, iou_level, ap FROM (WITH mm AS (SELECT * FROM m WHERE rank <= {cap})"
        + ap_sql("", "npos", "mm") + " SELECT * FROM ap)"
    )


@query("ag3", match_with(levels=mt.COCO_IOUS) + COUNTS_SQL
       + f", every AS ({_capped_ap(100)} UNION ALL {_capped_ap(300)}), "
       + """res AS (SELECT max_det, class_id, avg(ap) AS ap50_95, avg(ap) FILTER (abs(iou_level - 0.5) < 1e-9) AS ap50,
    avg(ap) FILTER (abs(iou_level - 0.75) < 1e-9) AS ap75 FROM every GROUP BY GROUPING SETS ((max_det, class_id), (max_det)))
  SELECT max_det, class_id, round(ap50_95, 9) AS ap50_95, round(ap50, 9) AS ap50, round(ap75, 9) AS ap75 FROM res""")
def average_precision(t):
    m = mt.coco_hits(t.pred(), t.gt(), max_det=300)
    return rounded(ag.coco_ap(m, ag.truth_counts(t.gt())), ("ap50_95", "ap50", "ap75"))


AREA_SQL = with_sql("gt", "pred", recursive=True) + "," + ",".join(
    f"""
gt_{name} AS (SELECT *, (x2-x1)*(y2-y1) BETWEEN {low} AND {high} AS regular FROM gt)"""
    for name, (low, high) in ag.AREA_RANGES.items()
)


def area_sql() -> str:
    """Matching that prefers in-range truth, then drops ignored rows, per area range."""
    parts = []
    for name, (low, high) in ag.AREA_RANGES.items():
        inner = greedy_sql(levels=mt.COCO_IOUS, cap=300, out=f"m_{name}")
        inner = inner.replace("LEFT JOIN gt g", f"LEFT JOIN gt_{name} g").replace("{'iou':", "{'r': g.regular, 'iou':")
        inner = inner.replace("CAST(NULL AS DOUBLE) AS iou,", "CAST(NULL AS DOUBLE) AS iou, CAST(NULL AS BOOLEAN) AS reg,")
        inner = inner.replace("b.g, b.iou,", "b.g, b.iou, b.r,").replace("gt_index, iou FROM", "gt_index, iou, reg FROM")
        parts.append(inner + f""",
k_{name} AS (SELECT m.* FROM m_{name} m JOIN pred p USING (image_id, class_id, pred_index)
  WHERE coalesce(m.reg, (p.x2-p.x1)*(p.y2-p.y1) BETWEEN {low} AND {high})),
n_{name} AS (SELECT class_id, count(*) AS npos FROM gt_{name} WHERE regular GROUP BY class_id)""")
    finals = " UNION ALL ".join(
        f"SELECT '{name}' AS area, class_id, round(avg(coalesce(ap, 0)), 9) AS ap50_95 FROM n_{name} LEFT JOIN "
        f"(WITH kk AS (SELECT * FROM k_{name}){ap_sql('', f'n_{name}', 'kk')} SELECT * FROM ap) USING (class_id) GROUP BY class_id"
        for name in ag.AREA_RANGES
    )
    return AREA_SQL + ",\n" + ",\n".join(parts) + " " + finals


@query("ag4", area_sql())
def ap_by_area(t):
    return rounded(ag.coco_ap_area(t.pred(), t.gt(), 300), ("ap50_95",))


@query("ag5", match_with(levels=mt.COCO_IOUS) + COUNTS_SQL + ap_sql("", "npos")
       + " SELECT class_id, round(iou_level, 4) AS iou_level, round(ap, 9) AS ap FROM ap")
def mask_ap(t):
    keys = ["image_id", "class_id"]
    p = mk.box_runs(t.pred().withColumnRenamed("pred_index", "instance"), [*keys, "instance"])
    g = mk.box_runs(t.gt().withColumnRenamed("gt_index", "instance"), [*keys, "instance"])
    pairs = mk.mask_iou_pairs(p, g, keys, least=min(mt.COCO_IOUS)).select(
        *keys, F.col("instance").alias("pred_index"), F.col("b_instance").alias("gt_index"), "iou"
    )
    m = mt.coco_hits(t.pred(), t.gt(), max_det=10**6, pairs=pairs)
    ap = ag.ap_by_level(m, ag.truth_counts(t.gt()), [], mt.COCO_IOUS)
    return rounded(ap.withColumn("iou_level", F.round("iou_level", 4)), ("ap",))


@query("ag6", match_with() + f""", found AS (
  SELECT g.class_id, {SIZE_SQL.replace('x2', 'g.x2').replace('x1', 'g.x1').replace('y2', 'g.y2').replace('y1', 'g.y1')} AS size_bin, coalesce(m.score >= 0.5, FALSE) AS seen
  FROM gt g LEFT JOIN m ON m.image_id = g.image_id AND m.class_id = g.class_id AND m.gt_index = g.gt_index)
  SELECT class_id, size_bin, count(*) FILTER (seen) AS detected, count(*) AS total,
    round(count(*) FILTER (seen) / count(*)::DOUBLE, 9) AS recall FROM found GROUP BY CUBE (class_id, size_bin)""")
def recall_by_size(t):
    return rounded(ag.size_recall(mt.found_truth(matches(t), t.gt()), 0.5), ("recall",))


@query("ag7", with_sql("gt", "pred", "images") + """, targets AS (SELECT * FROM gt WHERE class_id = 0 AND least(x2 - x1, y2 - y1) >= 48),
neg AS (SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM targets)),
res AS (SELECT count(*) AS negative_images, count(*) FILTER (image_id IN (SELECT image_id FROM pred WHERE score >= 0.97)) AS images_with_fp FROM neg)
SELECT negative_images, images_with_fp, round(images_with_fp / negative_images::DOUBLE, 9) AS rate FROM res""")
def negative_images(t):
    targets = t.gt().filter("class_id = 0 AND least(x2 - x1, y2 - y1) >= 48")
    return rounded(ag.negative_fp_rate(t.images(), targets, t.pred(), 0.97), ("rate",))


def group_counts(t: Tables):
    """tp/fn per group at threshold .5."""
    found = mt.found_truth(matches(t), t.gt())
    hit = F.coalesce(F.col("matched_score") >= 0.5, F.lit(False))
    return found.groupBy("group_id").agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fn"))


@query("ag8", match_with() + """, pg AS (
  SELECT g.group_id, count(*) FILTER (m.score >= 0.5) AS tp, count(*) - count(*) FILTER (m.score >= 0.5) AS fn,
    row_number() OVER (ORDER BY g.group_id) - 1 AS ordinal
  FROM gt g LEFT JOIN m ON m.image_id = g.image_id AND m.class_id = g.class_id AND m.gt_index = g.gt_index GROUP BY g.group_id),
n AS (SELECT count(*) AS groups FROM pg),
draws AS (
  SELECT i, ('0x' || substr(md5('42|' || i || '|' || pg.ordinal), 1, 8))::BIGINT % groups AS ordinal FROM pg, n, range(0, 500) r(i)),
vals AS (SELECT i, sum(tp) / (sum(tp) + sum(fn))::DOUBLE AS r FROM draws JOIN pg USING (ordinal) GROUP BY i)
SELECT round(quantile_cont(r, 0.025), 9) AS lower, round(quantile_cont(r, 0.975), 9) AS upper, count(*) AS resamples,
  (SELECT groups FROM n) AS groups, CAST(NULL AS VARCHAR) AS refused FROM vals""")
def bootstrap(t):
    return rounded(ag.bootstrap_recall(group_counts(t), 500), ("lower", "upper"))


@query("ag9", with_sql("gt", "images") + """, src AS (SELECT *, 'src' || CAST(image_id % 3 AS VARCHAR) AS source FROM images),
b AS (SELECT src.*, coalesce(c.boxes, 0) AS boxes FROM src LEFT JOIN (SELECT image_id, count(*) AS boxes FROM gt GROUP BY image_id) c USING (image_id))
SELECT split, source, CAST(NULL AS INTEGER) AS class_id, count(*) AS images, count(DISTINCT group_id) AS groups,
  CAST(sum(boxes) AS BIGINT) AS boxes, count(*) FILTER (boxes > 0) AS positive_images FROM b GROUP BY GROUPING SETS ((split), (split, source))
UNION ALL
SELECT split, NULL, class_id, count(DISTINCT image_id), count(DISTINCT group_id), count(*), count(DISTINCT image_id) FROM gt GROUP BY split, class_id""")
def summary(t):
    images = t.images().withColumn("source", F.concat(F.lit("src"), (F.col("image_id") % 3).cast("string")))
    return ag.split_summary(images, t.gt())


@query("ag10", with_sql("gt", "images") + f""", s AS (SELECT group_id, class_id AS c, {SIZE_SQL} AS s FROM gt)
SELECT group_id, concat_ws('/', 'class=' || c, 'size=' || s) AS feature, count(*) AS value
FROM s GROUP BY GROUPING SETS ((group_id, c), (group_id, s), (group_id, c, s))
UNION ALL SELECT group_id, 'images', count(*) FROM images GROUP BY group_id""")
def features(t):
    return ag.group_features(t.images(), t.gt())


@query("ag11", with_sql("gt") + """ SELECT split, class_id, count(DISTINCT image_id) AS images, count(*) AS boxes,
  count(DISTINCT group_id) AS groups FROM gt GROUP BY split, class_id""")
def support(t):
    return ag.class_support(t.gt(), ["split", "class_id"])


GROUP_AP_SQL = (
    match_with(levels=mt.COCO_IOUS, cap=300) + ", mg AS (SELECT *, image_id % 29 AS group_id FROM m), "
    "npos AS (SELECT group_id, class_id, count(*) AS npos FROM gt GROUP BY ALL)"
)


def grouped(t: Tables):
    hits = mt.coco_hits(t.pred(), t.gt(), max_det=300)
    return hits.withColumn("group_id", F.col("image_id") % 29), ag.truth_counts(t.gt(), ["group_id"])


@query("ag13", GROUP_AP_SQL + ap_sql("group_id", "npos", "mg") + """,
  ga AS (SELECT group_id, avg(ap) AS ap FROM ap GROUP BY group_id)
  SELECT round(avg(ap), 9) AS macro_ap, count(ap) AS groups FROM ga""")
def macro(t):
    m, npos = grouped(t)
    per_group = ag.ap_by_level(m, npos, ["group_id"], mt.COCO_IOUS).groupBy("group_id").agg(F.avg("ap").alias("ap"))
    return rounded(ag.macro_ap(per_group), ("macro_ap",))


def _left_out(cap: int) -> str:
    """AP with each group left out: one order of all rows, counts less the group's own, best precision per recall step."""
    own = "count(*) OVER v AS on_, CAST(sum(hit::INT) OVER v AS BIGINT) AS ot"
    return f"""c{cap} AS (SELECT class_id, iou_level, group_id, gt_index IS NOT NULL AS hit, row_number() OVER w AS n,
    CAST(sum((gt_index IS NOT NULL)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp
  FROM mg WHERE rank <= {cap} WINDOW w AS (PARTITION BY class_id, iou_level ORDER BY score DESC, image_id, rank)),
g{cap} AS (SELECT class_id, iou_level, group_id, n, {own} FROM c{cap} WINDOW v AS (PARTITION BY class_id, iou_level, group_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
h{cap} AS (SELECT o.group_id AS omitted, o.npos, h.* FROM c{cap} h JOIN left_ o ON o.class_id = h.class_id AND o.group_id <> h.group_id WHERE hit),
s{cap} AS (SELECT h.omitted, h.class_id, h.iou_level, (h.tp - coalesce(g.ot, 0)) / h.npos::DOUBLE AS reach, (h.tp - coalesce(g.ot, 0)) / (h.n - coalesce(g.on_, 0))::DOUBLE AS prec
  FROM h{cap} h ASOF LEFT JOIN g{cap} g ON g.class_id = h.class_id AND g.iou_level = h.iou_level AND g.group_id = h.omitted AND h.n >= g.n),
b{cap} AS (SELECT omitted, class_id, iou_level, max(prec) AS prec, CASE WHEN (floor(reach * 100) + 1) * 0.01::DOUBLE <= reach THEN floor(reach * 100) + 1
  WHEN floor(reach * 100) * 0.01::DOUBLE <= reach THEN floor(reach * 100) ELSE floor(reach * 100) - 1 END AS step FROM s{cap} GROUP BY ALL),
q{cap} AS (SELECT omitted, class_id, iou_level, i, max(prec) AS q FROM b{cap}, range(0, 101) r(i) WHERE step >= i GROUP BY ALL),
a{cap} AS (SELECT l.group_id AS omitted, l.class_id, v.t AS iou_level, coalesce(sum(q), 0) / 101 AS ap FROM left_ l CROSS JOIN (SELECT unnest({level_list(mt.COCO_IOUS)}) AS t) v
  LEFT JOIN q{cap} q ON q.omitted = l.group_id AND q.class_id = l.class_id AND q.iou_level = v.t GROUP BY ALL)"""


@query("ag14", GROUP_AP_SQL + """, every AS (SELECT class_id, sum(npos) AS npos FROM npos GROUP BY class_id),
  left_ AS (SELECT g.group_id, e.class_id, CAST(e.npos - coalesce(n.npos, 0) AS BIGINT) AS npos FROM every e CROSS JOIN (SELECT DISTINCT group_id FROM gt) g
    LEFT JOIN npos n ON n.group_id = g.group_id AND n.class_id = e.class_id WHERE e.npos > coalesce(n.npos, 0)), """ + _left_out(100) + ", " + _left_out(300) + """,
  both_caps AS (SELECT 100 AS max_det, * FROM a100 UNION ALL SELECT 300, * FROM a300)
  SELECT omitted, max_det, class_id, round(avg(ap), 9) AS ap50_95, round(avg(ap) FILTER (abs(iou_level - 0.5) < 1e-9), 9) AS ap50,
    round(avg(ap) FILTER (abs(iou_level - 0.75) < 1e-9), 9) AS ap75 FROM both_caps GROUP BY GROUPING SETS ((omitted, max_det, class_id), (omitted, max_det))""")
def leave_one_out(t):
    m, npos = grouped(t)
    return rounded(ag.leave_one_out_ap(m, npos, "group_id"), ("ap50_95", "ap50", "ap75"))


@query("ag15", """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95, round(sum(value), 4) AS total
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS warm_up FROM events) WHERE NOT warm_up GROUP BY event_type""")
def latency(t):
    first = t.read("events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    timed = t.read("events").join(first, "user_id").withColumn(
        "warm_up", F.struct("ts", "event_id") == F.col("_first")
    )
    rows = ag.latency_stats(timed, "value", ["event_type"])
    return rounded(rows.withColumn("total", F.round("total", 4)), ("mean", "p50", "p95"), 6)


def class_runs(t: Tables):
    keep = ["image_id", "class_id", "score", "instance"]
    ex = t.excluded().select(
        "image_id",
        F.when(F.col("source_type") == "unknown", 1).when(F.col("source_type").isin("pins", "pads"), 2).otherwise(3).alias("class_id"),
        F.lit(1.0).alias("score"), F.col("source_index").alias("instance"), "x1", "y1", "x2", "y2",
    )
    gt = t.gt().select(
        "image_id", (F.col("class_id") % 3 + 1).alias("class_id"),
        (F.col("gt_index") % 10 / F.lit(10.0)).alias("score"), F.col("gt_index").alias("instance"), "x1", "y1", "x2", "y2",
    )
    return mk.box_runs(ex, keep), mk.box_runs(gt, keep)


# reference SQL works on single pixels, the engine on runs
PIXELS_SQL = with_sql("gt", "excluded") + """, ge AS (
  SELECT image_id, y, x, arg_max(class_id, {'s': score, 'o': -instance}) AS class_id FROM (
    SELECT image_id, CASE WHEN source_type = 'unknown' THEN 1 WHEN source_type IN ('pins','pads') THEN 2 ELSE 3 END AS class_id,
      1.0 AS score, source_index AS instance, y, unnest(range(x1::BIGINT, x2::BIGINT)) AS x
    FROM (SELECT *, unnest(range(y1::BIGINT, y2::BIGINT)) AS y FROM excluded)) GROUP BY ALL),
gp AS (
  SELECT image_id, y, x, arg_max(class_id, {'s': score, 'o': -instance}) AS class_id FROM (
    SELECT image_id, class_id % 3 + 1 AS class_id, (gt_index % 10) / 10.0 AS score, gt_index AS instance, y,
      unnest(range(x1::BIGINT, x2::BIGINT)) AS x
    FROM (SELECT *, unnest(range(y1::BIGINT, y2::BIGINT)) AS y FROM gt)) GROUP BY ALL)"""


@query("ag17", PIXELS_SQL + " SELECT image_id, CAST(class_id AS INTEGER) AS class_id, count(*) AS pixels FROM gp GROUP BY ALL")
def painting(t):
    runs = mk.paint(class_runs(t)[1], ["image_id"])
    return runs.groupBy("image_id", F.col("class_id").cast("int").alias("class_id")).agg(F.sum(mk.area()).alias("pixels"))


CONFUSION_SQL = PIXELS_SQL + f""", pairs AS (
  SELECT coalesce(ge.class_id, 0) AS g, coalesce(gp.class_id, 0) AS p, count(*) AS n FROM ge FULL JOIN gp USING (image_id, y, x) GROUP BY ALL),
total AS (SELECT (SELECT count(DISTINCT l_orderkey // 8) FROM lineitem) * {IMAGE_WIDTH} * {IMAGE_HEIGHT} AS total),
conf AS (
  SELECT g AS gt_class, p AS pred_class, n FROM pairs
  UNION ALL SELECT 0, 0, (SELECT total FROM total) - (SELECT sum(n) FROM pairs)),
grid AS (SELECT a.c AS gt_class, b.c AS pred_class FROM range(0, 4) a(c), range(0, 4) b(c)),
cm AS (SELECT CAST(gt_class AS INTEGER) AS gt_class, CAST(pred_class AS INTEGER) AS pred_class, CAST(coalesce(sum(n), 0) AS BIGINT) AS n
  FROM grid LEFT JOIN conf USING (gt_class, pred_class) GROUP BY ALL)"""


def confusion(t: Tables):
    pixels = t.images().agg((F.count("*") * IMAGE_WIDTH * IMAGE_HEIGHT).alias("total"))
    gt, pred = class_runs(t)
    return mk.confusion(gt, pred, pixels, 4)


@query("ag16", CONFUSION_SQL + " SELECT * FROM cm")
def pixel_confusion(t):
    return confusion(t)


@query("ag16_iou", CONFUSION_SQL + """ SELECT c AS class_id, round(h / nullif(g + p - h, 0)::DOUBLE, 9) AS iou FROM (
  SELECT c, sum(n) FILTER (gt_class = c) AS g, sum(n) FILTER (pred_class = c) AS p, sum(n) FILTER (gt_class = c AND pred_class = c) AS h
  FROM cm, (SELECT CAST(c AS INTEGER) AS c FROM range(0, 4) r(c)) GROUP BY c)""")
def pixel_iou(t):
    return rounded(mk.class_iou(confusion(t)), ("iou",))


@query("ag16_summary", CONFUSION_SQL + """, ci AS (SELECT c AS class_id, h / nullif(g + p - h, 0)::DOUBLE AS iou FROM (
  SELECT c, sum(n) FILTER (gt_class = c) AS g, sum(n) FILTER (pred_class = c) AS p, sum(n) FILTER (gt_class = c AND pred_class = c) AS h
  FROM cm, (SELECT CAST(c AS INTEGER) AS c FROM range(0, 4) r(c)) GROUP BY c))
  SELECT round(sum(n) FILTER (gt_class = pred_class) / sum(n)::DOUBLE, 9) AS pixel_accuracy,
    (SELECT round(avg(iou), 9) FROM ci WHERE class_id > 0) AS foreground_miou FROM cm""")
def pixel_metrics(t):
    return rounded(mk.pixel_summary(confusion(t)), ("pixel_accuracy", "foreground_miou"))


@query("ag20", with_sql("gt") + """ SELECT image_id, class_id, count(*) AS boxes, round(10 / count(*)::DOUBLE, 9) AS recall_ceiling
  FROM gt GROUP BY image_id, class_id HAVING count(*) > 10""")
def dense(t):
    return rounded(ag.dense_cells(t.gt(), 10), ("recall_ceiling",))


@query("ag21", with_sql("gt", "pred") + """, c AS (SELECT image_id, class_id, count(*) AS n, min(score) AS low FROM pred GROUP BY ALL),
i AS (SELECT image_id, sum(n) AS n, min(low) AS low, count(*) FILTER (n > 10) AS o10, count(*) FILTER (n > 20) AS o20 FROM c GROUP BY image_id)
SELECT count(*) AS images, count(*) FILTER (n >= 60) AS images_at_cap, CAST(sum(o10) AS BIGINT) AS cells_over_10,
  CAST(sum(o20) AS BIGINT) AS cells_over_20, min(low) FILTER (n >= 60) AS lowest_kept_score FROM i""")
def caps(t):
    return ag.cap_audit(t.pred(), 60, (10, 20))


@query("ag28", match_with() + point_sql("", where="score >= 0.5") + f""", st AS (SELECT *{PRF_SQL} FROM op),
  ro AS (SELECT tp, fp, fn, round(precision, 3) AS p3, round(recall, 3) AS r3, round(f1, 3) AS f3, precision, recall, f1 FROM st)
  SELECT count(*) AS rows, round(max(abs(p3 - precision)), 9) AS max_error_precision, round(max(abs(r3 - recall)), 9) AS max_error_recall,
    round(max(abs(f3 - f1)), 9) AS max_error_f1 FROM ro""")
def recheck(t):
    stored = rounded(ag.operating_point(matches(t), t.gt(), 0.5), digits=3)
    return rounded(ag.recheck_prf(stored), ("max_error_precision", "max_error_recall", "max_error_f1"))

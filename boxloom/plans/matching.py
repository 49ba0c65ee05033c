"""Queries on matching, suppression and detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.operators import errors as er
from boxloom.operators import masks as mk
from boxloom.operators import matching as mt
from boxloom.operators import metrics as ag
from boxloom.plans.derive import Tables, with_sql
from boxloom.plans.registry import query

def iou_sql(a: str, b: str) -> str:
    """IoU of two aliased box rows as SQL text."""
    def c(alias, name):
        return f"{alias}.{name}"

    inter = (
        f"(greatest(least({c(a, 'x2')},{c(b, 'x2')})-greatest({c(a, 'x1')},{c(b, 'x1')}),0)"
        f"*greatest(least({c(a, 'y2')},{c(b, 'y2')})-greatest({c(a, 'y1')},{c(b, 'y1')}),0))"
    )
    area = "(({0}.x2-{0}.x1)*({0}.y2-{0}.y1))"
    union = f"({area.format(a)}+{area.format(b)}-{inter})"
    return f"(CASE WHEN {union} > 0 THEN {inter}/{union} ELSE 0.0 END)"


def level_list(levels) -> str:
    return "[" + ", ".join(repr(float(v)) for v in levels) + "]::DOUBLE[]"


def greedy_sql(tie: str = "last", levels=(0.5,), cap: int | None = None, pred: str = "pred", out: str = "m",
               where: str = "TRUE") -> str:
    """Sequential greedy matching as a recursive table ``out``; needs ``gt`` and ``pred``.

    Columns: image_id, class_id, pred_index, score, rank, iou_level, gt_index, iou (NULL gt_index =
    unmatched).
    """
    sign = "" if tie == "last" else "-"
    return f"""{out}_r AS (
  SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, pred_index) AS rank
  FROM {pred} WHERE {where}),
{out}_c AS (
  SELECT p.image_id, p.class_id, p.pred_index, p.score, p.rank,
    list({{'iou': {iou_sql('p', 'g')}, 'o': {sign}g.gt_index, 'g': g.gt_index}})
      FILTER (g.gt_index IS NOT NULL AND {iou_sql('p', 'g')} >= {min(levels)}) AS c
  FROM {out}_r p LEFT JOIN gt g ON g.image_id = p.image_id AND g.class_id = p.class_id
  {'WHERE p.rank <= ' + str(cap) if cap else ''}
  GROUP BY p.image_id, p.class_id, p.pred_index, p.score, p.rank),
{out}_w AS (
  SELECT image_id, class_id, unnest({level_list(levels)}) AS iou_level, 0::BIGINT AS rank,
    CAST(NULL AS INTEGER) AS pred_index, CAST(NULL AS DOUBLE) AS score,
    CAST(NULL AS INTEGER) AS gt_index, CAST(NULL AS DOUBLE) AS iou, CAST([] AS INTEGER[]) AS found
  FROM (SELECT DISTINCT image_id, class_id FROM {out}_c)
  UNION ALL
  SELECT image_id, class_id, iou_level, rank, pred_index, score, b.g, b.iou,
    CASE WHEN b IS NULL THEN found ELSE list_append(found, b.g) END
  FROM (SELECT c.image_id, c.class_id, w.iou_level, c.rank, c.pred_index, c.score, w.found,
          list_sort(list_filter(c.c, lambda x: x.iou >= w.iou_level AND NOT list_contains(w.found, x.g)), 'desc')[1] AS b
        FROM {out}_w w JOIN {out}_c c ON c.image_id = w.image_id AND c.class_id = w.class_id AND c.rank = w.rank + 1)),
{out} AS (SELECT image_id, class_id, pred_index, score, rank, iou_level, gt_index, iou FROM {out}_w WHERE rank > 0)"""


def match_with(*more: str, **kw) -> str:
    return with_sql("gt", "pred", *more, recursive=True) + ",\n" + greedy_sql(**kw)


PRF_SQL = """,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS recall,
  CASE WHEN tp > 0 THEN 2 * (tp/(tp+fp)::DOUBLE) * (tp/(tp+fn)::DOUBLE) / ((tp/(tp+fp)::DOUBLE) + (tp/(tp+fn)::DOUBLE)) ELSE 0.0 END AS f1"""


def rounded(df, names=("precision", "recall", "f1"), digits: int = 9):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def matches(t: Tables):
    return mt.greedy_match(t.pred(), t.gt())


MATCH_COLUMNS = ["image_id", "class_id", "pred_index", "score", "rank", "gt_index", "iou"]


@query("mt1", match_with() + " SELECT image_id, class_id, pred_index, score, CAST(rank AS INTEGER) AS rank, gt_index, iou FROM m")
def greedy_last(t):
    return mt.greedy_match(t.pred(), t.gt(), ranked=True).select(*MATCH_COLUMNS)


@query("mt2", match_with(tie="first") + " SELECT image_id, class_id, pred_index, score, CAST(rank AS INTEGER) AS rank, gt_index, iou FROM m")
def greedy_first(t):
    return mt.greedy_match(t.pred(), t.gt(), tie="first", ranked=True).select(*MATCH_COLUMNS)


SWEEP_SQL = """, steps AS (SELECT step, step / 20.0::DOUBLE AS confidence FROM range(1, 20) r(step)),
curve AS (
  SELECT c.class_id, s.confidence,
    count(*) FILTER (m.score >= s.confidence AND m.gt_index IS NOT NULL) AS tp,
    count(*) FILTER (m.score >= s.confidence AND m.gt_index IS NULL) AS fp,
    any_value(c.gt) AS gt
  FROM (SELECT class_id, count(*) AS gt FROM gt GROUP BY class_id) c
  JOIN m ON m.class_id = c.class_id, steps s GROUP BY c.class_id, s.confidence),
both_rows AS (
  SELECT class_id, confidence, tp, fp, gt - tp AS fn FROM curve
  UNION ALL
  SELECT NULL, confidence, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(gt) - sum(tp) AS BIGINT) FROM curve GROUP BY confidence),
sweep AS (SELECT *""" + PRF_SQL + " FROM both_rows)"
ROUNDED_SQL = "round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1"


@query("ag2", match_with() + SWEEP_SQL + f" SELECT class_id, confidence, tp, fp, fn, {ROUNDED_SQL} FROM sweep")
def sweep(t):
    return rounded(ag.threshold_sweep(matches(t), t.gt()))


@query("ag2_best", match_with() + SWEEP_SQL + """
  SELECT confidence, round(f1, 9) AS f1 FROM sweep WHERE class_id IS NULL ORDER BY sweep.f1 DESC, confidence DESC LIMIT 1""")
def best_threshold(t):
    return rounded(ag.best_confidence(ag.threshold_sweep(matches(t), t.gt())))


@query("mt3", match_with(levels=mt.COCO_IOUS, cap=300) + """
  SELECT image_id, class_id, pred_index, round(iou_level, 4) AS iou_level, gt_index FROM m""")
def coco_matches(t):
    rows = mt.coco_match(t.pred(), t.gt(), max_det=300)
    return rows.select("image_id", "class_id", "pred_index", F.round("iou_level", 4).alias("iou_level"), "gt_index")


@query("mt4", match_with() + """
  SELECT image_id, class_id, count(*) FILTER (score >= 0.05) AS kept_at_05, count(gt_index) FILTER (score >= 0.05) AS tp_at_05,
    count(*) FILTER (score >= 0.5) AS kept_at_50, count(gt_index) FILTER (score >= 0.5) AS tp_at_50,
    count(*) FILTER (score >= 0.95) AS kept_at_95, count(gt_index) FILTER (score >= 0.95) AS tp_at_95
  FROM m GROUP BY image_id, class_id""")
def thresholds_from_one_match(t):
    rows = mt.match_once(t.pred(), t.gt())
    out = []
    for name, level in (("05", 0.05), ("50", 0.5), ("95", 0.95)):
        kept = F.col("score") >= level
        out += [F.count_if(kept).alias(f"kept_at_{name}"),
                F.count_if(kept & F.col("gt_index").isNotNull()).alias(f"tp_at_{name}")]
    return rows.groupBy("image_id", "class_id").agg(*out)


def suppress_sql(level: str, test: str, kind: str, order: str = "score DESC, pred_index") -> str:
    return f"""r AS (SELECT image_id, class_id, pred_index, CAST(x1 AS {kind}) AS x1, CAST(y1 AS {kind}) AS y1, CAST(x2 AS {kind}) AS x2,
  CAST(y2 AS {kind}) AS y2, row_number() OVER (PARTITION BY image_id, class_id ORDER BY {order}) AS rank FROM pred),
blocked AS (
  SELECT p.image_id, p.class_id, p.pred_index, p.rank, list(q.rank) FILTER (q.rank IS NOT NULL) AS by
  FROM r p LEFT JOIN r q ON q.image_id = p.image_id AND q.class_id = p.class_id AND q.rank < p.rank
    AND {iou_sql('p', 'q')} {test} {level}
  GROUP BY p.image_id, p.class_id, p.pred_index, p.rank),
w AS (
  SELECT image_id, class_id, 0::BIGINT AS rank, CAST(NULL AS INTEGER) AS pred_index, TRUE AS keep, CAST([] AS BIGINT[]) AS kept
  FROM (SELECT DISTINCT image_id, class_id FROM pred)
  UNION ALL
  SELECT b.image_id, b.class_id, b.rank, b.pred_index, NOT coalesce(list_has_any(b.by, w.kept), FALSE),
    CASE WHEN coalesce(list_has_any(b.by, w.kept), FALSE) THEN w.kept ELSE list_append(w.kept, b.rank) END
  FROM w JOIN blocked b ON b.image_id = w.image_id AND b.class_id = w.class_id AND b.rank = w.rank + 1),
kept AS (SELECT image_id, class_id, pred_index FROM w WHERE rank > 0 AND keep)"""


@query("mt5", with_sql("gt", "pred", recursive=True) + ", " + suppress_sql("0.5", ">", "DOUBLE")
       + " SELECT p.image_id, p.class_id, p.pred_index, p.score FROM kept JOIN pred p USING (image_id, class_id, pred_index)")
def box_nms(t):
    return mt.nms(t.pred()).select("image_id", "class_id", "pred_index", "score")


@query("tk1", with_sql("gt", "pred") + """
  SELECT image_id, class_id, pred_index, score FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, pred_index) AS rn FROM pred)
  WHERE rn <= 5""")
def top_predictions(t):
    rows = mt.top_per_group(t.pred(), mt.GROUP, mt.score_order(), 5)
    return rows.select("image_id", "class_id", "pred_index", "score")


@query("mt6", with_sql("gt", "pred", recursive=True) + ", " + suppress_sql("0.6", ">=", "DOUBLE")
       + " SELECT image_id, class_id, pred_index AS instance FROM kept")
def mask_suppression(t):
    boxes = t.pred().withColumnRenamed("pred_index", "instance")
    keep = ["image_id", "class_id", "instance"]
    return mk.mask_nms(boxes.select(*keep, "score"), mk.box_runs(boxes, keep)).select(*keep)


MISS_SQL = match_with(where="score >= 0.5") + f""", near AS (
  SELECT g.image_id, g.class_id, g.gt_index,
    max(p.score) FILTER (p.class_id = g.class_id) AS same_score, max(p.score) FILTER (p.class_id <> g.class_id) AS wrong_score
  FROM gt g JOIN pred p ON p.image_id = g.image_id AND {iou_sql('g', 'p')} >= 0.5 GROUP BY ALL)
SELECT g.image_id, g.class_id, g.gt_index,
  CASE WHEN m.gt_index IS NOT NULL THEN 'found' WHEN n.same_score < 0.5 THEN 'below_threshold'
       WHEN n.same_score IS NOT NULL THEN 'lost_assignment' WHEN n.wrong_score >= 0.5 THEN 'wrong_class' ELSE 'none' END AS diagnosis
FROM gt g LEFT JOIN m ON m.image_id = g.image_id AND m.class_id = g.class_id AND m.gt_index = g.gt_index
LEFT JOIN near n ON n.image_id = g.image_id AND n.class_id = g.class_id AND n.gt_index = g.gt_index"""


@query("mt7", MISS_SQL)
def misses(t):
    kept = mt.greedy_match(t.pred().filter(F.col("score") >= 0.5), t.gt())
    return er.diagnose_misses(kept, t.pred(), t.gt(), 0.5)


def ioa_sql(a: str, b: str) -> str:
    inter = f"(greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0)*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0))"
    return f"({inter}/(({a}.x2-{a}.x1)*({a}.y2-{a}.y1)))"


OVERLAP_SQL = f"""bo AS (
  SELECT p.image_id, p.pred_index,
    max({{'iou': {iou_sql('p', 'g')}, 'o': -g.gt_index}}) FILTER (g.class_id = p.class_id) AS s,
    max({{'iou': {iou_sql('p', 'g')}, 'o': -g.gt_index}}) FILTER (g.class_id <> p.class_id) AS d
  FROM pred p JOIN gt g ON g.image_id = p.image_id AND {iou_sql('p', 'g')} > 0 GROUP BY ALL)"""


@query("jn5", with_sql("gt", "pred") + ", " + OVERLAP_SQL + """
  SELECT image_id, pred_index, s.iou AS same_iou, -s.o AS same_gt, d.iou AS other_iou, -d.o AS other_gt FROM bo""")
def overlaps_of_predictions(t):
    return er.best_overlaps(t.pred(), t.gt()).drop("other_class")


TAXONOMY_SQL = match_with("excluded") + f""", {OVERLAP_SQL},
be AS (
  SELECT p.image_id, p.pred_index,
    max({{'k': {iou_sql('p', 'e')}, 'u': e.source_type = 'unknown', 'o': -e.source_index, 't': e.source_type}}) AS strict,
    max({{'k': {ioa_sql('p', 'e')}, 'i': {iou_sql('p', 'e')}, 'u': e.source_type = 'unknown', 'o': -e.source_index, 't': e.source_type}}) AS ioa,
    bool_or({iou_sql('p', 'e')} >= 0.5 AND e.source_type = 'unknown') AS u_iou,
    bool_or({iou_sql('p', 'e')} >= 0.5 AND e.source_type <> 'unknown') AS k_iou,
    bool_or({ioa_sql('p', 'e')} >= 0.5 AND e.source_type = 'unknown') AS u_ioa,
    bool_or({ioa_sql('p', 'e')} >= 0.5 AND e.source_type <> 'unknown') AS k_ioa
  FROM pred p JOIN excluded e ON e.image_id = p.image_id AND {iou_sql('p', 'e')} > 0 GROUP BY ALL),
fp AS (
  SELECT m.image_id, m.class_id, m.pred_index, m.score, coalesce(bo.s.iou >= 0.1, FALSE) AS same_class,
    coalesce(bo.d.iou >= 0.5, FALSE) AS other_class,
    CASE WHEN bo.s.iou >= 0.5 AND tk.rank < m.rank THEN 'duplicate' WHEN bo.s.iou >= 0.1 THEN 'localization' END AS kind,
    be.strict, be.ioa, be.u_iou, be.k_iou, be.u_ioa, be.k_ioa
  FROM m LEFT JOIN bo USING (image_id, pred_index) LEFT JOIN be USING (image_id, pred_index)
  LEFT JOIN m tk ON tk.image_id = m.image_id AND tk.class_id = m.class_id AND tk.gt_index = -bo.s.o
  WHERE m.gt_index IS NULL),
long AS (
  SELECT image_id, class_id, pred_index, score, same_class, other_class, kind, 'strict_iou' AS variant,
    coalesce(strict.k >= 0.5, FALSE) AS hit, strict.u AS u, strict.t AS t, coalesce(u_iou, FALSE) AS unknown_overlap, coalesce(k_iou, FALSE) AS non_target_overlap FROM fp
  UNION ALL
  SELECT image_id, class_id, pred_index, score, same_class, other_class, kind, 'sensitivity_ioa',
    coalesce(ioa.k >= 0.5, FALSE), ioa.u, ioa.t, coalesce(u_ioa, FALSE), coalesce(k_ioa, FALSE) FROM fp),
tax AS (
  SELECT image_id, class_id, pred_index, score, same_class, other_class, kind, variant,
    CASE WHEN same_class THEN 'other_same_class' WHEN other_class THEN 'other_class_confusion'
         WHEN hit AND u THEN 'source_unknown' WHEN hit THEN 'known_non_target' ELSE 'other_background' END AS category,
    CASE WHEN NOT same_class AND NOT other_class AND hit THEN t END AS source_type,
    CASE WHEN NOT same_class AND NOT other_class AND hit AND NOT u THEN
      CASE WHEN t IN ('ferrite bead','inductor','fuse') THEN 'passive_lookalike' WHEN t IN ('pins','pads') THEN 'pins_pads'
           WHEN t = 'text' THEN 'text' ELSE 'rest' END END AS subtotal,
    unknown_overlap, non_target_overlap FROM long)"""


def taxonomy(t):
    return er.fp_taxonomy(matches(t), t.pred(), t.gt(), t.excluded())


@query("mt8", TAXONOMY_SQL + " SELECT * FROM tax")
def false_positives(t):
    return taxonomy(t)


@query("ag22", TAXONOMY_SQL + """
  SELECT variant, category, class_id, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY variant))::DOUBLE, 9) AS fraction,
    count(*) FILTER (category LIKE 'other%' AND unknown_overlap) AS hid_unknown,
    count(*) FILTER (category LIKE 'other%' AND non_target_overlap) AS hid_non_target
  FROM tax GROUP BY variant, category, class_id""")
def false_positive_summary(t):
    return rounded(er.fp_summary(taxonomy(t)), ("fraction",))


@query("ag22_conditions", TAXONOMY_SQL + """
  SELECT variant, 'non_target_overlap=' || non_target_overlap::INT || '|other_class=' || other_class::INT || '|same_class='
    || same_class::INT || '|unknown_overlap=' || unknown_overlap::INT AS conditions, count(*) AS n FROM tax GROUP BY ALL""")
def false_positive_conditions(t):
    return er.condition_table(taxonomy(t))


def shifted(pred):
    """The second arm: the same detector with every box one pixel further right."""
    return pred.withColumn("x1", F.col("x1") + 1).withColumn("x2", F.col("x2") + 1)


PAIRED_SQL = (
    with_sql("gt", "pred", recursive=True)
    + ", pred_b AS (SELECT * REPLACE (x1 + 1 AS x1, x2 + 1 AS x2) FROM pred),\n" + greedy_sql(out="ma")
    + ",\n" + greedy_sql(pred="pred_b", out="mb")
    + """, outcomes AS (
  SELECT g.image_id, g.class_id, g.gt_index, CASE WHEN a.gt_index IS NOT NULL AND b.gt_index IS NOT NULL THEN 'both'
    WHEN a.gt_index IS NOT NULL THEN 'a_only' WHEN b.gt_index IS NOT NULL THEN 'b_only' ELSE 'neither' END AS state
  FROM gt g LEFT JOIN ma a ON a.image_id = g.image_id AND a.class_id = g.class_id AND a.gt_index = g.gt_index
  LEFT JOIN mb b ON b.image_id = g.image_id AND b.class_id = g.class_id AND b.gt_index = g.gt_index)"""
)


def outcomes(t):
    return er.paired_outcomes(mt.matched_pairs(t.pred(), t.gt()), mt.matched_pairs(shifted(t.pred()), t.gt()), t.gt())


@query("jn13", PAIRED_SQL + " SELECT * FROM outcomes")
def paired(t):
    return outcomes(t)


@query("ag23", PAIRED_SQL + """
  SELECT class_id, count(*) FILTER (state = 'both') AS both, count(*) FILTER (state = 'a_only') AS a_only,
    count(*) FILTER (state = 'b_only') AS b_only, count(*) FILTER (state = 'neither') AS neither, count(*) AS total
  FROM outcomes GROUP BY ROLLUP (class_id)""")
def paired_counts(t):
    return er.paired_summary(outcomes(t))


@query("jn3", with_sql("gt", "pred") + f"""
  SELECT p.image_id, p.class_id, p.pred_index, g.gt_index, {iou_sql('p', 'g')} AS iou FROM pred p
  JOIN gt g ON g.image_id = p.image_id AND g.class_id = p.class_id AND {iou_sql('p', 'g')} >= 0.5""")
def candidate_pairs(t):
    pairs = mt.match_candidates(t.pred(), t.gt())
    return pairs.select("image_id", "class_id", "pred_index", F.col("g_gt_index").alias("gt_index"), "iou")

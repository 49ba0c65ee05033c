"""Order-dependent one-to-one matching and non-maximum suppression.

Both are greedy over a score order inside one (image, class) group, but a box only depends on what it overlaps. Groups of up to
``CROWD`` boxes are matched as arrays (``grouped``), thousands of them in a call. A larger one is never gathered: its boxes meet in grid cells, pairs that are
each other's only candidate are settled by counting, and the others in rounds, each of which settles every pair that no higher-ranked box can change. What a few rounds
leave (long chains) is split into the components of its overlap graph, and only a component is folded in order. NMS goes this way at every size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxloom.functions.boxes import box, box_iou
from boxloom.operators.components import connected_components, star_edges
from boxloom.operators.grouped import match_groups
from boxloom.operators.prefix import running
from boxloom.operators.spatial import overlap_join, prefixed
from boxloom.session import cut

GROUP = ["image_id", "class_id"]
#: Rounds before the components of what is left are folded; a choice of plan, the result is the same.
ROUNDS = 6
#: Boxes of a group up to which it is matched as arrays, and pairs up to which its rounds stay in one partition; larger groups spread over tasks. A choice of plan, too.
CROWD = 4096

# fixed values: ten IoU levels, as numpy.linspace(.5, .95, 10) yields them
COCO_IOUS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.8999999999999999, 0.95]
CLOSE_TO_ONE = 1 - 1e-10


def match_candidates(pred: DataFrame, gt: DataFrame, iou: float = 0.5, cell: int = 128) -> DataFrame:
    """All same-image, same-class (prediction, truth) pairs with IoU of at least ``iou`` > 0."""
    pairs = overlap_join(pred, prefixed(gt, "g_", GROUP), GROUP, "", "g_", cell)
    return pairs.withColumn("iou", box_iou(box(), box("g_"))).filter(F.col("iou") >= iou)


def _tie(tie: str, index: Column) -> Column:
    if tie not in ("last", "first"):
        raise ValueError("tie must be 'last' or 'first'")
    return index if tie == "last" else -index


def match_edges(pred: DataFrame, gt: DataFrame, lowest: float, tie: str, by: list[str], variants: dict[str, Column]) -> DataFrame:
    """Pairs that may match: the keys, ``pred_index, score, gt_index, iou``, ``order`` (largest wins) and the variants' flags."""
    truth = gt.select(*GROUP, "gt_index", *box(), *(v.alias(f"is_{k}") for k, v in variants.items()))
    pairs = match_candidates(pred.select(*by, *GROUP, "pred_index", "score", *box()), truth, min(lowest, CLOSE_TO_ONE))
    flags = [F.col(f"g_is_{k}").alias(k) for k in variants]
    return pairs.select(*by, *GROUP, "pred_index", "score", F.col("g_gt_index").alias("gt_index"), "iou", _tie(tie, F.col("g_gt_index")).alias("order"), *flags)


def settle(edges: DataFrame, levels: list[float], by: list[str], variants: list[str]) -> tuple[DataFrame, DataFrame]:
    """Greedy choice among ``edges``: (pairs without a rival, matched pairs of the others).

    A pair without a rival matches at every level that its IoU reaches, whatever the variant; the others come with
    ``iou_level``, ``variant`` and ``on_regular`` (the variant's flag). A flagged truth is preferred to one that isn't.
    """
    keys = [*by, *GROUP]
    sides = W.partitionBy(*keys, "pred_index"), W.partitionBy(*keys, "gt_index")
    counted = edges.withColumn("_p", F.count("*").over(sides[0])).withColumn("_g", F.count("*").over(sides[1]))
    counted = cut(counted.withColumn("_lone", (F.col("_p") == 1) & (F.col("_g") == 1)).drop("_p", "_g"))
    level = F.explode(F.array(*[F.lit(float(t)) for t in levels])).alias("iou_level")
    variant = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("on_regular")) for v in variants])).alias("v")
    one = [*keys, "iou_level", "variant"]

    def spread(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", level).filter(F.col("iou") >= F.least(F.col("iou_level"), F.lit(CLOSE_TO_ONE)))
        rows = rows.select(*keys, "iou_level", variant, "pred_index", "score", "gt_index", "iou", "order").select("*", "v.*").drop("v")
        return rows.select(
            *one, "pred_index", "gt_index", "iou", "on_regular", F.lit(False).alias("_settled"),
            F.struct("on_regular", "iou", "order").alias("_want"), F.struct((-F.col("score")).alias("neg"), "pred_index").alias("_rank"),
        )

    rivals = counted.filter("NOT _lone")
    crowded = cut(rivals.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > CROWD).select(*keys))
    # pairs of a group meet before levels and variants multiply them, and every round's windows find them there
    common = rivals.join(crowded, keys, "left_anti").repartition(*keys)
    settled = _in_rounds(spread(common), one, ROUNDS)
    if not crowded.isEmpty():
        settled = settled.unionByName(_in_rounds(spread(rivals.join(crowded, keys, "left_semi")), one, 2))
    return counted.filter("_lone"), settled.select(*one, "pred_index", "gt_index", "iou", "on_regular")


def _in_rounds(edges: DataFrame, keys: list[str], per_job: int) -> DataFrame:
    """The matched pairs of ``edges``; a job takes ``per_job`` rounds.

    A pair settles when the truth is the best one left for the prediction and no other prediction that still wants this truth ranks
    higher; its prediction and its truth take no part any more. The top-ranked prediction of every group settles in each round.
    """
    pred, truth = W.partitionBy(*keys, "pred_index"), W.partitionBy(*keys, "gt_index")
    still = ~F.col("_settled")
    for turn in range(ROUNDS):
        edges = edges.withColumn("_best", F.max(F.when(still, F.col("_want"))).over(pred))
        edges = edges.withColumn("_first", F.min(F.when(still, F.col("_rank"))).over(truth))
        edges = edges.withColumn("_won", still & (F.col("_want") == F.col("_best")) & (F.col("_rank") == F.col("_first")))
        edges = edges.withColumn("_out", F.max("_won").over(truth)).withColumn("_out", F.col("_out") | F.max("_won").over(pred))
        edges = edges.withColumn("_settled", F.col("_settled") | F.col("_won")).filter("_settled OR NOT _out").drop("_best", "_first", "_won", "_out")
        if turn % per_job == per_job - 1:
            edges = cut(edges)
            if edges.filter(still).isEmpty():
                return edges
    return edges.filter("_settled").unionByName(_by_components(edges.filter(still), keys))


def _by_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Truth boxes that share a prediction, however far apart, are one component; each is folded in rank order."""
    named = edges.withColumn("id", F.to_json(F.struct(*keys, "gt_index"))).withColumn("_p", F.to_json(F.struct(*keys, "pred_index")))
    named = cut(named)
    labelled = connected_components(named.select("id").distinct(), star_edges(named.select("id", "_p"), "_p"))
    placed = named.join(labelled, "id").drop("id", "_p")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rank, want = pdf["_rank"].map(lambda r: (r["neg"], r["pred_index"])), pdf["_want"].map(lambda w: (not w["on_regular"], -w["iou"], -w["order"]))
        order = sorted(range(len(pdf)), key=lambda k: (rank.iat[k], want.iat[k]))
        preds, truths, won = set(), set(), []
        for k in order:
            p, g = pdf["pred_index"].iat[k], pdf["gt_index"].iat[k]
            if p not in preds and g not in truths:
                preds.add(p)
                truths.add(g)
                won.append(k)
        return pdf.iloc[won].drop(columns="component").assign(_settled=True)

    return placed.groupBy("component").applyInPandas(fold, edges.schema)


def deal(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with the groups of ``keys`` together and in ``order``, and ``_first`` at the first row of each, for ``mapInArrow``.

    A window deals them, so tables that are dealt by some of the keys are not shuffled again."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1
    return rows.withColumn("_first", first).sortWithinPartitions(*keys, *order)


def _as_arrays(
    pred: DataFrame, others: DataFrame, levels: list[float], tie: str, keys: list[str], kept: list[str], made: dict[str, str],
    variants: int = 1, cap: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Greedy matching inside tasks: (predictions of groups of at most ``CROWD`` rows, rows of larger groups or None).

    ``others`` are truths (``_index``, box, ``_flags``: a bit per variant) or pairs (``_index`` of the prediction, ``_other``, ``_iou``); ``pred`` has ``pred_index``, ``score``,
    ``kept`` and, for truths, its box. Rows of a group meet once, where a window finds them in order; tables that are dealt by image are not shuffled again.
    The predictions come with the columns ``made``. Rows of larger groups come as they are: ``_truth`` tells the two sides.
    """
    lowest = [min(t, CLOSE_TO_ONE) for t in levels]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()  # boxes without a key meet nothing
    mine = pred.withColumn("_index", F.col("pred_index").cast("long")).withColumn("score", F.col("score").cast("double"))
    theirs = others.withColumn("score", F.lit(None).cast("double"))
    sides = []
    for side, rows in ((True, theirs), (False, mine)):
        space = [F.when(known, F.col(c).cast("double")).alias(c) for c in ("x1", "y1", "x2", "y2", "_iou") if c in others.columns and c in rows.columns]
        more = [c for c in ("_flags", "_other") if c in rows.columns] if side else kept
        sides.append(rows.select(*keys, F.lit(side).alias("_truth"), "_index", "score", *space, *more))
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    order = [F.col("_truth").desc(), F.col("score").desc(), F.col("_index")]
    added = StructType.fromDDL(", ".join(f"{k} {v}" for k, v in made.items()) + ", _settled boolean")
    names, crowd, rounds = both.columns, CROWD, ROUNDS
    made = [f.name for f in added][:-1]
    schema = StructType([*both.schema, *added])
    found = cut(deal(both, keys, order).mapInArrow(lambda rows: match_groups(rows, names, made, lowest, tie, variants, cap, crowd, rounds), schema))
    left = found.filter("NOT _settled").select(*names)
    settled = found.filter("_settled").withColumn("pred_index", F.col("_index")).select(*keys, "pred_index", "score", *kept, *made)
    types = {f.name: f.dataType for f in pred.schema}
    settled = settled.select(*[F.col(c).cast(types[c]).alias(c) if c in types and c not in made else F.col(c) for c in settled.columns])
    return settled, None if left.isEmpty() else left


def _sides_of(left: DataFrame, pred: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """(predictions, the others) of the rows of crowded groups, with the types of ``pred``."""
    types = {f.name: f.dataType for f in pred.schema}
    wanted = [c for c in (*GROUP, "score", *kept) if c in types]
    space = [c for c in ("x1", "y1", "x2", "y2") if c in left.columns]
    mine = left.filter("NOT _truth").select(*[F.col(c).cast(types[c]).alias(c) for c in wanted], F.col("_index").cast(types["pred_index"]).alias("pred_index"), *space)
    return mine, left.filter("_truth")


def _truths(gt: DataFrame, variants: dict[str, Column]) -> DataFrame:
    flags = F.lit(0)
    for i, v in enumerate(variants.values()):
        flags = flags + F.when(v, 1 << i).otherwise(0)
    return gt.select(*GROUP, F.col("gt_index").cast("long").alias("_index"), *box(), flags.alias("_flags"))


def _crowded_truths(theirs: DataFrame, gt: DataFrame, variants: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in gt.schema}
    flags = [(F.shiftright("_flags", i).bitwiseAND(1) == 1).alias(v) for i, v in enumerate(variants)]
    return theirs.select(*GROUP, F.col("_index").cast(types["gt_index"]).alias("gt_index"), *box(), *flags)


def _matches(pred: DataFrame, gt: DataFrame, levels: list[float], tie: str, kept: list[str], cap: int | None = None, ranked: bool = False) -> DataFrame:
    """``greedy_match`` of one run, of the first ``cap`` predictions of a group."""
    _tie(tie, F.lit(0))
    variants = {"regular": F.col("regular") if "regular" in gt.columns else F.lit(True)}
    index = gt.schema["gt_index"].dataType
    one = len(levels) == 1
    rank = {"rank": "int"} if ranked else {}
    found = {"gt_index": "long", "iou": "double", "on_regular": "boolean"}
    made = rank | (found if one else {"_at": "array<struct<gt_index:bigint,iou:double,levels:int,on_regular:boolean>>"})
    wide = pred.select(*GROUP, "pred_index", "score", *box(), *kept)
    rows, left = _as_arrays(wide, _truths(gt, variants), levels, tie, GROUP, kept, made, cap=cap)
    shown = [*GROUP, "pred_index", "score", *kept, *rank]
    if one:
        rows = rows.withColumn("iou_level", F.lit(float(levels[0])))
    else:
        level = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("iou_level"), F.lit(1 << i).alias("bit")) for i, t in enumerate(levels)])).alias("_level")
        rows = rows.select(*shown, "_at", level)
        rows = rows.withColumn("_m", F.get(F.filter("_at", lambda m: m["levels"].bitwiseAND(F.col("_level.bit")) != 0), F.lit(0))).select(*shown, "_level.iou_level", *(F.col(f"_m.{c}").alias(c) for c in found))
    rows = rows.select(*shown, "iou_level", F.col("gt_index").cast(index).alias("gt_index"), "iou", "on_regular")
    if left is None:
        return rows
    mine, theirs = _sides_of(left, pred, kept)
    if cap is not None:
        mine = top_per_group(mine, GROUP, score_order(), cap, "rank")
    elif ranked:
        mine = running(mine, GROUP, score_order(), {"rank": F.lit(1)}).withColumn("rank", F.col("rank").cast("int"))
    truths = _crowded_truths(theirs, gt, ["regular"])
    edges = match_edges(mine, truths, min(levels), tie, [], {"regular": F.col("regular")})
    return rows.unionByName(_per_level(mine.select(*shown), edges, levels, []).select(*rows.columns))


def variant_hits(pred: DataFrame, gt: DataFrame, levels: list[float], variants: dict[str, Column], kept: list[str], cap: int) -> DataFrame:
    """The first ``cap`` predictions of a group: GROUP, ``pred_index, score, rank``, ``kept``, ``variant``, and the bits ``hits`` and ``regular_hits``."""
    made = {"rank": "int"} | {f"{k}_{i}": "int" for i in range(len(variants)) for k in ("_hits", "_regular")}
    wide = pred.select(*GROUP, "pred_index", "score", *box(), *kept)
    rows, left = _as_arrays(wide, _truths(gt, variants), levels, "last", GROUP, kept, made, len(variants), cap)
    bits = [F.struct(F.lit(v).alias("variant"), F.col(f"_hits_{i}").alias("hits"), F.col(f"_regular_{i}").alias("regular_hits")) for i, v in enumerate(variants)]
    shown = [*GROUP, "pred_index", "score", "rank", *kept]
    rows = rows.select(*shown, F.inline(F.array(*bits))) if len(bits) > 1 else rows.select(*shown, bits[0].alias("v")).select(*shown, "v.*")
    if left is None:
        return rows
    mine, theirs = _sides_of(left, pred, kept)
    mine = top_per_group(mine, GROUP, score_order(), cap, "rank")
    edges = match_edges(mine, _crowded_truths(theirs, gt, list(variants)), min(levels), "last", [], {v: F.col(v) for v in variants})
    return rows.unionByName(match_bits(mine.select(*shown), edges, levels, [], list(variants)).select(*rows.columns))


def _hits_of_pairs(pred: DataFrame, pairs: DataFrame, levels: list[float], cap: int) -> DataFrame:
    """``variant_hits`` where the overlaps are given."""
    near = pairs.filter(F.col("iou") >= min(min(levels), CLOSE_TO_ONE))
    near = near.select(*GROUP, F.col("pred_index").cast("long").alias("_index"), F.col("gt_index").cast("long").alias("_other"), F.col("iou").alias("_iou"))
    made = {"rank": "int", "_hits_0": "int", "_regular_0": "int"}
    rows, left = _as_arrays(pred.select(*GROUP, "pred_index", "score"), near, levels, "last", GROUP, [], made, cap=cap)
    rows = rows.select(*GROUP, "pred_index", "score", "rank", F.col("_hits_0").alias("hits"))
    if left is None:
        return rows
    mine, theirs = _sides_of(left, pred, [])
    mine = top_per_group(mine, GROUP, score_order(), cap, "rank")
    given = theirs.select(*GROUP, F.col("_index").cast(pred.schema["pred_index"].dataType).alias("pred_index"), F.col("_other").alias("gt_index"), F.col("_iou").alias("iou"))
    found = match_bits(mine, _given(mine, given, levels, "last", []), levels, [])
    return rows.unionByName(found.select(*rows.columns))


def greedy_match(
    pred: DataFrame,
    gt: DataFrame,
    iou: float | list[float] = 0.5,
    tie: str = "last",
    by: list[str] | None = None,
    ranked: bool = False,
) -> DataFrame:
    """Each prediction, best score first, takes the unmatched truth of its class with most IoU.

    Equal scores keep ``pred_index`` order; equal IoUs take the last or first truth index.
    ``by`` names further prediction columns that separate independent runs (candidates).
    ``iou`` may be a list: the result then has one row per prediction and level in ``iou_level``. A boolean truth column
    ``regular`` makes boxes with False the second choice (area ranges); ``on_regular`` reports it.

    Returns ``by + image_id, class_id, pred_index, score, iou_level, gt_index, iou, on_regular`` with
    NULL ``gt_index`` for an unmatched prediction, and with ``ranked`` the ``rank`` from 1 inside the group, a prefix count;
    a ``rank`` that ``pred`` has is kept.
    """
    by, levels = by or [], list(iou) if isinstance(iou, (list, tuple)) else [iou]
    if not by:
        return _matches(pred, gt, levels, tie, ["rank"] if "rank" in pred.columns and not ranked else [], ranked=ranked)
    regular = F.col("regular") if "regular" in gt.columns else F.lit(True)
    edges = match_edges(pred, gt, min(levels), tie, by, {"regular": regular})
    if ranked:
        pred = running(pred.select(*by, *GROUP, "pred_index", "score"), [*by, *GROUP], score_order(), {"rank": F.lit(1)}).withColumn("rank", F.col("rank").cast("int"))
    return _per_level(pred, edges, levels, by)


def matched_pairs(pred: DataFrame, gt: DataFrame, iou: float = 0.5, tie: str = "last", by: list[str] | None = None) -> DataFrame:
    """Only the matched pairs of ``greedy_match`` at one level: ``by, image_id, class_id, pred_index, gt_index, iou``.

    Predictions without a match aren't wanted, so the predictions are not joined again."""
    by = by or []
    if not by:
        one = _matches(pred, gt, [iou], tie, []).filter("gt_index IS NOT NULL")
        return one.select(*GROUP, "pred_index", "gt_index", "iou")
    lone, rivals = settle(match_edges(pred, gt, iou, tie, by, {"regular": F.lit(True)}), [iou], by, ["regular"])
    columns = [*by, *GROUP, "pred_index", "gt_index", "iou"]
    return lone.select(*columns).unionByName(rivals.select(*columns))


def greedy_match_pairs(
    pred: DataFrame, pairs: DataFrame, levels: list[float], tie: str = "last", by: list[str] | None = None
) -> DataFrame:
    """Greedy matching where the overlaps are given (masks): ``pairs`` has the group columns,
    ``pred_index``, ``gt_index`` and ``iou``."""
    by = by or []
    return _per_level(pred, _given(pred, pairs, levels, tie, by), levels, by)


def _given(pred: DataFrame, pairs: DataFrame, levels: list[float], tie: str, by: list[str]) -> DataFrame:
    keys = [*by, *GROUP, "pred_index"]
    near = pairs.filter(F.col("iou") >= min(min(levels), CLOSE_TO_ONE)).join(pred.select(*keys, "score"), keys)
    return near.select(*keys, "score", "gt_index", "iou", _tie(tie, F.col("gt_index")).alias("order"), F.lit(True).alias("regular"))


def _per_level(pred: DataFrame, edges: DataFrame, levels: list[float], by: list[str]) -> DataFrame:
    lone, rivals = settle(edges, levels, by, ["regular"])
    keys = [*by, *GROUP, "pred_index"]
    match = F.struct("iou_level", "gt_index", "iou", F.col("regular").alias("on_regular"))
    reached = F.array(*[
        F.when(F.col("iou") >= min(t, CLOSE_TO_ONE), match.withField("iou_level", F.lit(float(t)))) for t in levels
    ])
    alone = lone.withColumn("iou_level", F.lit(0.0)).select(*keys, F.array_compact(reached).alias("_at"))
    others = rivals.groupBy(*keys).agg(F.collect_list(F.struct("iou_level", "gt_index", "iou", "on_regular")).alias("_at"))
    kept = [*by, *GROUP, "pred_index", "score", *(["rank"] if "rank" in pred.columns else [])]
    # a prediction is joined once, not once per level
    rows = pred.select(*kept).join(alone.unionByName(others), keys, "left")
    level = F.explode(F.array(*[F.lit(float(t)) for t in levels])).alias("iou_level")
    rows = rows.select(*kept, "_at", level)
    rows = rows.withColumn("_m", F.get(F.filter("_at", lambda m: m["iou_level"] == F.col("iou_level")), F.lit(0)))
    return rows.select(*kept, "iou_level", *(F.col(f"_m.{c}").alias(c) for c in ("gt_index", "iou", "on_regular")))


def level_bit(levels: list[float], level: Column) -> Column:
    """Bit of an IoU level in ``hits`` and ``seen``."""
    at = F.lit(None).cast("int")
    for i, t in enumerate(levels):
        at = F.when(F.abs(level - t) < 1e-9, i).otherwise(at)
    return F.call_function("shiftleft", F.lit(1), at)


def match_bits(pred: DataFrame, edges: DataFrame, levels: list[float], by: list[str], variants: list[str] | None = None) -> DataFrame:
    """One row per prediction of ``pred`` (and, with several ``variants``, per variant): its columns and, a bit per level, ``hits``
    (it matched) and ``regular_hits`` (it matched a flagged truth)."""
    names = variants or ["regular"]
    lone, rivals = settle(edges, levels, by, names)
    keys = [*by, *GROUP, "pred_index"]
    reached = sum((F.when(F.col("iou") >= min(t, CLOSE_TO_ONE), 1 << i).otherwise(0) for i, t in enumerate(levels)), F.lit(0))
    variant = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("flag")) for v in names])).alias("v")
    alone = lone.select(*keys, reached.alias("hits"), variant).select(*keys, "v.variant", "hits", F.when(F.col("v.flag"), F.col("hits")).otherwise(0).alias("regular_hits"))
    bit = level_bit(levels, F.col("iou_level"))
    others = rivals.groupBy(*keys, "variant").agg(F.sum(bit).cast("int").alias("hits"), F.sum(F.when(F.col("on_regular"), bit).otherwise(0)).cast("int").alias("regular_hits"))
    rows = pred if variants is None else pred.withColumn("variant", F.explode(F.array(*map(F.lit, names))))
    found = alone.unionByName(others)
    joined = rows.join(found.drop("variant") if variants is None else found, keys + ([] if variants is None else ["variant"]), "left")
    return joined.na.fill(0, ["hits", "regular_hits"])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each key in the given order (limited on the map side by Catalyst); ``rank`` names a column for their places."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = df.withColumn(rank or "_rn", F.row_number().over(w)).filter(F.col(rank or "_rn") <= k)
    return first if rank else first.drop("_rn")


def score_order() -> list[Column]:
    return [F.col("score").desc(), F.col("pred_index")]


def coco_match(
    pred: DataFrame, gt: DataFrame, ious: list[float] | None = None, max_det: int = 300, by: list[str] | None = None,
) -> DataFrame:
    """Greedy matching at each IoU level over the first ``max_det`` predictions of a group."""
    if not by:
        return _matches(pred, gt, ious or COCO_IOUS, "last", [], max_det, ranked=True)
    return greedy_match(top_per_group(pred, [*by, *GROUP], score_order(), max_det, "rank"), gt, ious or COCO_IOUS, "last", by)


def coco_hits(
    pred: DataFrame, gt: DataFrame, ious: list[float] | None = None, max_det: int = 300, by: list[str] | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """``coco_match`` with one row per prediction for AP: ``by, image_id, class_id, pred_index, score, rank``, and a bit per level in ``hits`` and ``seen``.

    ``pairs`` (masks) gives the overlaps as in ``greedy_match_pairs``.
    """
    by, levels = by or [], ious or COCO_IOUS
    every = F.lit((1 << len(levels)) - 1)
    if not by:
        rows = variant_hits(pred, gt, levels, {"regular": F.lit(True)}, [], max_det) if pairs is None else _hits_of_pairs(pred, pairs, levels, max_det)
        return rows.select(*GROUP, "pred_index", "score", "rank", "hits", every.alias("seen"))
    kept = top_per_group(pred, [*by, *GROUP], score_order(), max_det, "rank")
    edges = match_edges(kept, gt, min(levels), "last", by, {"regular": F.lit(True)}) if pairs is None else _given(kept, pairs, levels, "last", by)
    rows = match_bits(kept.select(*by, *GROUP, "pred_index", "score", "rank"), edges, levels, by)
    return rows.drop("regular_hits").withColumn("seen", every)


def match_once(pred: DataFrame, gt: DataFrame, lowest: float = 0.0, **kw) -> DataFrame:
    """One pass at the lowest score; any higher threshold is then only a filter on ``score``."""
    return greedy_match(pred.filter(F.col("score") >= lowest), gt, **kw)


def nms(pred: DataFrame, iou: float = 0.5, cap: int = 1000, by: list[str] | None = None) -> DataFrame:
    """Class-aware suppression of IoU strictly above ``iou`` in single precision, then the first
    ``cap`` rows of an image by score."""
    by = by or []
    keys = [*by, *GROUP]
    every = pred.select(*keys, "pred_index", "score", *box().cast("float").columns())
    # of copies of one box only the best-ranked can stay (IoU 1), so copies never form pairs;
    # boxes without area overlap nothing and are kept apart by their index
    flat = F.when((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(None)).otherwise(F.col("pred_index"))
    nodes = every.withColumn("_flat", flat).groupBy(*keys, "x1", "y1", "x2", "y2", "_flat").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "pred_index")).alias("_b")
    ).select(*keys, F.col("_b.pred_index").alias("pred_index"), (-F.col("_b.neg")).alias("score"), *box())
    pairs = overlap_join(nodes, prefixed(nodes, "q_", keys), keys, "", "q_")
    rank, other = F.struct(-F.col("score"), "pred_index"), F.struct(-F.col("q_score"), "q_pred_index")
    conflict = box_iou(box(), box("q_")).cast("float") > F.lit(iou).cast("float")
    edges = pairs.filter((rank < other) & conflict).select(*keys, "pred_index", "score", F.col("q_pred_index").alias("lower"))
    removed = suppressed(edges, keys)
    firsts = nodes.select(*keys, "pred_index").join(removed, [*keys, "pred_index"], "left_anti")
    kept = pred.join(firsts, [*keys, "pred_index"], "left_semi")
    return top_per_group(kept, [*by, "image_id"], score_order(), cap)


def suppressed(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes removed when each kept box, best score first, removes what it conflicts with: ``keys, pred_index``.

    ``edges``: ``keys``, ``pred_index`` and its ``score``, and ``lower``, the lower-ranked box in conflict. In a round
    a box without a higher-ranked conflict left is kept and removes its conflicts; their own conflicts are void then.
    """
    high, low = [*keys, "pred_index"], [*keys, "lower"]
    edges, gone = cut(edges), None
    for _ in range(ROUNDS):
        below = edges.select(*keys, F.col("lower").alias("pred_index"), F.lit(True).alias("_below")).distinct()
        marked = edges.join(below, high, "left").withColumn("_kept", F.col("_below").isNull()).drop("_below")
        marked = cut(marked.withColumn("_out", F.max("_kept").over(W.partitionBy(*low))))
        out = marked.filter("_out").select(*keys, F.col("lower").alias("pred_index")).distinct()
        gone = out if gone is None else gone.unionByName(out)
        edges = marked.filter("NOT _out AND NOT _kept").drop("_out", "_kept").join(out, high, "left_anti")
        edges = cut(edges)
        if edges.isEmpty():
            return gone
    folded = _suppressed_components(edges, keys)
    return folded if gone is None else gone.unionByName(folded)


def _suppressed_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """What ``suppressed`` gives, with every component of the conflicts that are left folded in rank order."""
    name = lambda index: F.to_json(F.struct(*keys, F.col(index).alias("i")))
    named = cut(edges.withColumn("src", name("pred_index")).withColumn("dst", name("lower")))
    nodes = named.select(F.col("src").alias("id")).unionByName(named.select(F.col("dst").alias("id"))).distinct()
    labelled = connected_components(nodes, named.select("src", "dst"))
    placed = named.join(labelled.withColumnRenamed("id", "src"), "src").drop("src", "dst")
    one = edges.select(*keys, "pred_index").schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        gone = set()
        ordered = pdf.assign(neg=-pdf["score"]).sort_values(["neg", "pred_index"])
        for high_index, low_index in zip(ordered["pred_index"], ordered["lower"], strict=True):
            if high_index not in gone:
                gone.add(low_index)
        group = pdf[keys].iloc[[0] * len(gone)].reset_index(drop=True)
        return group.assign(pred_index=list(gone))

    return placed.groupBy("component").applyInPandas(fold, one)


def found_truth(matches: DataFrame, gt: DataFrame) -> DataFrame:
    """Every truth box of one run with the prediction that matched it (NULL when missed)."""
    hit = matches.filter(F.col("gt_index").isNotNull()).select(
        *GROUP, "gt_index", F.col("score").alias("matched_score"), "pred_index", "iou",
    )
    return gt.join(hit, [*GROUP, "gt_index"], "left")

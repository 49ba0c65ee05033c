"""Detection metrics over match rows: counts, sweeps, average precision, recall tables.

Everything first reduces the match rows with partial aggregation (per class, threshold bin, recall
step ...) and only orders or windows the reduced rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.functions.boxes import box, box_area, size_bin
from boxloom.functions.hashing import hash_pick
from boxloom.functions.numeric import f1, precision, recall
from boxloom.operators.matching import COCO_IOUS, GROUP, level_bit, variant_hits
from boxloom.operators.prefix import running
from boxloom.session import cut

SWEEP_STEPS = 20  # thresholds step/20 for step 1..19


def with_prf(df: DataFrame) -> DataFrame:
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return df.select("*", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def _with_micro(sums: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Add the sum over classes as rows with a NULL class."""
    micro = sums.groupBy(*keys).agg(
        F.lit(None).cast("int").alias("class_id"), *[F.sum(c).alias(c) for c in counts]
    )
    return sums.unionByName(micro)


def operating_point(
    matches: DataFrame, gt: DataFrame, threshold: float = 0.0, extra: list[str] | None = None
) -> DataFrame:
    """TP/FP/FN with precision, recall and F1 per class and, with NULL class, over all classes.

    ``extra`` names columns of both inputs (image, group, source) that split the result.
    """
    extra = extra or []
    hit = F.col("gt_index").isNotNull().cast("long")
    zero = F.lit(0).cast("long")
    counted = matches.filter(F.col("score") >= threshold).select(
        *extra, "class_id", hit.alias("tp"), (1 - hit).alias("fp"), zero.alias("gt")
    )
    truth = gt.select(*extra, "class_id", zero.alias("tp"), zero.alias("fp"), F.lit(1).cast("long").alias("gt"))
    sums = counted.unionByName(truth).groupBy(*extra, "class_id").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "gt")]
    )
    rows = _with_micro(sums, extra, ["tp", "fp", "gt"])
    return with_prf(rows.select(*extra, "class_id", "tp", "fp", (F.col("gt") - F.col("tp")).alias("fn")))


def threshold_sweep(matches: DataFrame, gt: DataFrame) -> DataFrame:
    """Counts and P/R/F1 per class and over all classes (NULL class) at .05 to .95.

    Match rows are reduced to one row per (class, number of thresholds passed); the curve is a
    running sum over at most 20 such rows, so the matches are read once whatever the grid.
    """
    passed = F.lit(0)
    for step in range(1, SWEEP_STEPS):
        passed = passed + (F.col("score") >= F.lit(step / 20.0)).cast("int")
    hit = F.col("gt_index").isNotNull().cast("long")
    bins = matches.groupBy("class_id", passed.alias("step")).agg(
        F.sum(hit).alias("tp"), F.sum(1 - hit).alias("fp")
    )
    truth = gt.groupBy("class_id").agg(F.count("*").alias("gt"))
    classes = truth.select("class_id").unionByName(bins.select("class_id")).distinct()
    grid = classes.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(SWEEP_STEPS - 1))))
    filled = (
        grid.join(bins, ["class_id", "step"], "left").join(truth, "class_id", "left").na.fill(0, ["tp", "fp", "gt"])
    )
    above = W.partitionBy("class_id").orderBy(F.col("step").desc()).rowsBetween(W.unboundedPreceding, 0)
    curve = filled.select(
        "class_id", "step", "gt", F.sum("tp").over(above).alias("tp"), F.sum("fp").over(above).alias("fp")
    )
    rows = _with_micro(curve, ["step"], ["tp", "fp", "gt"]).select(
        "class_id", (F.col("step") / F.lit(20.0)).alias("confidence"),
        "tp", "fp", (F.col("gt") - F.col("tp")).alias("fn"),
    )
    return with_prf(rows)


def best_confidence(sweep: DataFrame) -> DataFrame:
    """Confidence of the best F1 over all classes; the highest wins a tie."""
    best = sweep.filter(F.col("class_id").isNull()).agg(F.max(F.struct("f1", "confidence")).alias("b"))
    return best.select(
        F.coalesce("b.confidence", F.lit(0.95)).alias("confidence"), F.coalesce("b.f1", F.lit(0.0)).alias("f1")
    )


# ---------------------------------------------------------------- average precision


def _pack(matches: DataFrame, extra: list[str], levels: list[float]) -> DataFrame:
    """One row per prediction with a bit per IoU level at which it matched (``hits``) and took part (``seen``)."""
    if "hits" in matches.columns:
        packed = matches
    else:
        bit = level_bit(levels, F.col("iou_level"))
        rank = ["rank"] if "rank" in matches.columns else []
        packed = matches.groupBy("image_id", "class_id", *extra, "pred_index", *rank, "score").agg(
            F.sum(F.when(F.col("gt_index").isNotNull(), bit).otherwise(0)).cast("int").alias("hits"),
            F.sum(bit).cast("int").alias("seen"),
        )
    return packed.withColumn("neg", -F.col("score"))


ORDER = ["neg", "image_id", "pred_index"]
#: Consecutive predictions of a class that are one block, at most.
BLOCK = 4096
#: Predictions whose blocks are evaluated at once.
HELD = 1 << 17


def _hit(i: int):
    return F.shiftright("hits", i).bitwiseAND(1).cast("long")


def _recall_step(reach: np.ndarray) -> np.ndarray:
    """Largest i with i * 0.01 <= reach in doubles; the first guess may be off by one."""
    guess = np.floor(reach * 100)
    return np.where((guess + 1) * 0.01 <= reach, guess + 1, np.where(guess * 0.01 <= reach, guess, guess - 1)).astype(np.int32)


def _cells(levels: list[float], caps: list, ragged: bool) -> list[tuple[int, int, str, str]]:
    """(level, cap, name of its count of predictions, name of its count of hits)."""
    return [(i, j, f"n_{i}_{j}" if ragged else f"n_{j}", f"t_{i}_{j}") for i in range(len(levels)) for j in range(len(caps))]


def _words(bits: int) -> type:
    return np.int16 if bits < 16 else np.int32 if bits < 32 else np.int64


def _packed_blocks(batches: Iterator[pa.RecordBatch], keys: list[str], levels: list[float], caps: list, ragged: bool, block: int) -> Iterator[pa.RecordBatch]:
    """Rows in order, as blocks of consecutive rows of one key: keys, ``pos`` (ascends), the block's counts, and its bits as bytes."""
    kind, part, made = _words(max(len(levels), len(caps))), TaskContext.get().partitionId() << 40, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        change[0] = True
        for k in keys:
            c = batch.column(k)
            change[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(change)
        start = np.concatenate([np.arange(x, y, block) for x, y in zip(first, np.append(first[1:], n), strict=True)])
        bits = {c: batch.column(c).to_numpy() for c in ("hits", "seen")}
        if caps == [None]:
            inside = np.ones(n, np.int64)
        else:
            rank = batch.column("rank").to_numpy()
            inside = sum((rank <= c).astype(np.int64) << j for j, c in enumerate(caps))
        counts = {}
        for i, j, seen, hit in _cells(levels, caps, ragged):
            within = inside >> j & 1
            counts[hit] = np.add.reduceat(bits["hits"] >> i & within, start).astype(np.int64)
            if seen not in counts:
                counts[seen] = np.add.reduceat((bits["seen"] >> i if ragged else 1) & within, start)
        ends = np.append(start[1:], n)
        texts = {"_hits": bits["hits"], "_seen": bits["seen"] if ragged else None, "_inside": inside}
        blobs = [pa.nulls(len(start), pa.binary()) if v is None else pa.array([v[x:y].astype(kind).tobytes() for x, y in zip(start, ends, strict=True)], pa.binary()) for v in texts.values()]
        names = sorted(counts)
        pos = pa.array(part + made + np.arange(len(start)))
        made += len(start)
        at = pa.array(start)
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pos, *(pa.array(counts[c].astype(np.int64)) for c in names), *blobs], names=[*keys, "pos", *names, *texts])


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Some blocks, of at most about ``HELD`` predictions together."""
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column("_hits")).to_numpy() // width), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _reached(batches: Iterator[pa.RecordBatch], keys: list[str], levels: list[float], caps: list, ragged: bool) -> Iterator[pa.RecordBatch]:
    """Best precision per recall step that a block's hits reach, from its bits, the truths (``npos``) and the counts before it (``s_...``)."""
    kind = _words(max(len(levels), len(caps)))
    for batch in _pieces(batches, np.dtype(kind).itemsize):
        flat = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c in ("_hits", "_inside", *(["_seen"] if ragged else []))}
        sizes = pc.binary_length(batch.column("_hits")).to_numpy() // np.dtype(kind).itemsize
        owner, begin = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        npos = batch.column("npos").to_numpy()
        out, count, seen_of = [], None, None
        for i, j, seen, hit in sorted(_cells(levels, caps, ragged), key=lambda c: c[2]):
            within = flat["_inside"] >> j & 1
            if seen != seen_of:  # predictions up to each row, those of earlier blocks of the batch taken off
                seen_of, here = seen, np.cumsum((flat["_seen"] >> i if ragged else 1) & within, dtype=np.int64)
                count = here + (batch.column(f"s_{seen}").to_numpy() - np.append(0, here)[begin])[owner]
            at = np.flatnonzero(flat["_hits"] >> i & within)
            if not len(at):
                continue
            mine = owner[at]
            found = np.arange(1, len(at) + 1) + (batch.column(f"s_{hit}").to_numpy() - np.searchsorted(at, begin))[mine]
            step = _recall_step(found / npos[mine])
            head = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (step[1:] != step[:-1])]))
            best = np.maximum.reduceat(found / count[at], head)
            out.append((mine[head], np.full(len(head), i, np.int32), np.full(len(head), j, np.int32), step[head], best))
        if out:
            mine, *columns = (np.concatenate(c) for c in zip(*out, strict=True))
            place = pa.array(mine)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(place) for k in keys), *map(pa.array, columns)], names=[*keys, "_level", "_cap", "step", "precision"])


def _mean_of_best(reached: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over the 101 recall steps of the best precision at that step or later; a step may have several rows."""
    spread = reached.select(*keys, "precision", F.explode(F.sequence(F.lit(0), F.col("step"))).alias("step"))
    best = spread.groupBy(*keys, "step").agg(F.max("precision").alias("q"))
    return best.groupBy(*keys).agg((F.sum("q") / 101).alias("ap"))


def ap_by_level(
    matches: DataFrame, npos: DataFrame, by: list[str], levels: list[float], caps: tuple[int, ...] | None = None,
    ragged: bool = False,
) -> DataFrame:
    """101-point AP per (by, class, IoU level) and, with ``caps``, per number of predictions kept.

    Predictions are ordered once by score, image, rank inside the image, over ranges, so a class that holds most of the rows still
    spreads over all tasks. A range is written as blocks of up to ``BLOCK`` predictions, a row each with their bits and counts. The
    counts before a block are sums over blocks; a block then gives at most 101 recall steps per level and cap. ``ragged`` inputs lack some
    predictions at some levels (ignored ones), so those levels are counted apart.
    """
    packed = _pack(matches, by, levels)
    cuts, one = list(caps or [None]), [*by, "class_id"]
    cells = _cells(levels, cuts, ragged)
    counts = sorted({c for cell in cells for c in cell[2:]})
    # choosing the ranges reads the rows a second time
    held = cut(packed.select(*one, *ORDER, F.col("hits").cast("int").alias("hits"), F.col("seen").cast("int").alias("seen"), *(["rank"] if caps else [])))
    ranged = held.repartitionByRange(*one, *ORDER).sortWithinPartitions(*one, *ORDER)
    rows = ranged.select(*one, "hits", "seen", *(["rank"] if caps else []))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*one).schema]
    block = BLOCK
    fields = [*kinds, "pos long", *(f"{c} long" for c in counts), "_hits binary", "_seen binary", "_inside binary"]
    blocks = cut(rows.mapInArrow(lambda b: _packed_blocks(b, one, levels, cuts, ragged, block), ", ".join(fields)))
    before = W.partitionBy(*one).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("pos", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"s_{c}") for c in counts])
    shared = [k for k in one if k in npos.columns]
    ready = blocks.join(starts, "pos").join(npos, shared).select(*one, "npos", *[f"s_{c}" for c in counts], "_hits", "_seen", "_inside")
    reached = ready.mapInArrow(lambda b: _reached(b, one, levels, cuts, ragged), ", ".join([*kinds, "_level int", "_cap int", "step int", "precision double"]))
    best = reached.groupBy(*one, "_level", "_cap", "step").agg(F.max("precision").alias("precision"))
    named = best.withColumn("iou_level", F.element_at(F.array(*[F.lit(float(t)) for t in levels]), F.col("_level") + 1))
    if caps:
        named = named.withColumn("max_det", F.element_at(F.array(*map(F.lit, caps)), F.col("_cap") + 1))
    keys = [*one, "iou_level", *(["max_det"] if caps else [])]
    areas = _mean_of_best(named, keys)
    grid = npos.withColumn("iou_level", F.explode(F.array(*[F.lit(float(t)) for t in levels])))
    if caps:
        grid = grid.withColumn("max_det", F.explode(F.array(*[F.lit(c) for c in caps])))
    joined = grid.join(areas, keys, "left")
    return joined.select(*keys, F.when(F.col("npos") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


def coco_ap(
    matches: DataFrame, npos: DataFrame, max_dets: tuple[int, ...] = (100, 300), by: list[str] | None = None,
    levels: list[float] | None = None,
) -> DataFrame:
    """AP50-95, AP50 and AP75 per class and over classes (NULL class) for every ``max_det``.

    ``matches`` come from one ``coco_match`` at the largest cap: the first ``m`` predictions of a
    group match the same way whatever follows them. ``npos`` holds truth counts per (by, class).
    """
    by = by or []
    per_level = ap_by_level(matches, npos, by, levels or COCO_IOUS, max_dets)
    keys = [*by, "max_det"]

    def at(level: float):
        return F.avg(F.when(F.abs(F.col("iou_level") - level) < 1e-9, F.col("ap")))

    parts = [F.avg("ap").alias("ap50_95"), at(0.5).alias("ap50"), at(0.75).alias("ap75")]
    per_class = per_level.groupBy(*keys, "class_id").agg(*parts)
    overall = per_level.groupBy(*keys).agg(F.lit(None).cast("int").alias("class_id"), *parts)
    return per_class.unionByName(overall)


def truth_counts(gt: DataFrame, by: list[str] | None = None) -> DataFrame:
    return gt.groupBy(*(by or []), "class_id").agg(F.count("*").alias("npos"))


# fixed values: COCO area ranges in square pixels
AREA_RANGES = {"small": (0, 1024), "medium": (1024, 9216), "large": (9216, 10_000_000_000)}


def coco_ap_area(pred: DataFrame, gt: DataFrame, max_det: int = 100, levels: list[float] | None = None) -> DataFrame:
    """AP per area range: out-of-range truth and what matches it is ignored, as are unmatched
    out-of-range predictions."""
    levels = levels or COCO_IOUS
    area = box_area(box())
    inside = {name: area.between(low, high) for name, (low, high) in AREA_RANGES.items()}
    flags = sum((F.when(v, 1 << i).otherwise(0) for i, v in enumerate(inside.values())), F.lit(0))
    # one set of pairs serves all ranges; they differ in which truth is regular
    rows = variant_hits(pred.withColumn("_inside", flags), gt, levels, inside, ["_inside"], max_det).withColumnRenamed("variant", "area")
    in_range = F.lit(False)
    for i, name in enumerate(inside):
        in_range = F.when(F.col("area") == name, F.shiftright("_inside", i).bitwiseAND(1) == 1).otherwise(in_range)
    every = (1 << len(levels)) - 1
    # what matched counts if its truth is regular, what didn't if it lies in the range itself
    unmatched = F.when(in_range, F.bitwise_not("hits").bitwiseAND(every)).otherwise(0)
    rows = rows.withColumn("seen", F.col("regular_hits").bitwiseOR(unmatched)).withColumn("hits", F.col("regular_hits")).filter("seen > 0")
    sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("area"), v.alias("inside")) for k, v in inside.items()])).alias("a")
    npos = gt.select("class_id", sizes).filter("a.inside").groupBy("a.area", "class_id").agg(F.count("*").alias("npos"))
    per_level = ap_by_level(rows.select(*GROUP, "area", "pred_index", "score", "hits", "seen"), npos, ["area"], levels, ragged=True)
    return per_level.groupBy("area", "class_id").agg(F.avg("ap").alias("ap50_95"))


def macro_ap(group_ap: DataFrame) -> DataFrame:
    """Mean over groups of a per-group AP, undefined groups left out."""
    return group_ap.agg(F.avg("ap").alias("macro_ap"), F.count("ap").alias("groups"))


def leave_one_out_ap(
    matches: DataFrame, npos: DataFrame, group: str, levels: list[float] | None = None, caps: tuple[int, ...] = (100, 300)
) -> DataFrame:
    """AP50-95, AP50 and AP75 with each group omitted, per class and over classes (NULL), for every cap, from the cached matches.

    ``matches`` (``coco_hits``) and ``npos`` carry ``group``. Nothing is matched or ordered again: a class's predictions are
    ordered once, by ranges whose rows are numbered where they are sorted, and cut into blocks of numbers. Counts at a block's start, of all rows and of each group, are sums over
    (class, block, group) and their prefixes, and inside a block the counts without a group are those of all rows less
    the group's own. A block gives at most 101 recall steps per group, level and cap, so what is shuffled does not grow with its rows.
    """
    levels = levels or COCO_IOUS
    packed = _pack(matches, [group], levels).select("class_id", F.col(group).alias("_group"), *ORDER, "hits", "rank")
    # choosing the ranges reads the rows a second time
    ordered = cut(packed).repartitionByRange("class_id", *ORDER).sortWithinPartitions("class_id", *ORDER)
    placed = ordered.select("class_id", F.monotonically_increasing_id().alias("pos"), "_group", "hits", "rank")
    placed = cut(placed).withColumn("block", F.expr(f"pos div {BLOCK}"))
    cells = [(i, j) for j in range(len(caps)) for i in range(len(levels))]
    inside = [(F.col("rank") <= c).cast("long") for c in caps]
    counts = {f"n_{j}": inside[j] for j in range(len(caps))} | {f"t_{i}_{j}": _hit(i) * inside[j] for i, j in cells}
    own = placed.groupBy("class_id", "block", "_group").agg(*(F.sum(v).alias(k) for k, v in counts.items()))
    truth = cut(npos.select("class_id", F.col(group).alias("_group"), "npos"))
    everyone = truth.select("_group", F.lit(True).alias("omitted")).distinct()
    names = everyone.unionByName(placed.select("_group", F.lit(False).alias("omitted")).distinct()).groupBy("_group").agg(F.max("omitted").alias("omitted"))
    totals = truth.groupBy("class_id").agg(F.sum("npos").alias("_all"))
    # every class with every group: what the result has anyway
    left = totals.join(names, F.lit(True)).join(truth, ["class_id", "_group"], "left").select(
        "class_id", "_group", "omitted", (F.col("_all") - F.coalesce("npos", F.lit(0))).alias("left")
    )
    left = cut(left)
    starts = placed.select("class_id", "block").distinct().join(left, "class_id").join(own, ["class_id", "block", "_group"], "left")
    before = W.partitionBy("class_id", "_group").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("class_id", "block", "_group", "omitted", "left", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in counts))
    kind = placed.schema["_group"].dataType.simpleString()
    starts = cut(starts)  # columns of its own, as both sides come from one table
    reached = placed.groupBy("class_id", "block").cogroup(starts.groupBy("class_id", "block")).applyInPandas(
        _best_without(levels, caps), f"class_id int, omitted {kind}, level int, max_det int, step int, precision double"
    )
    keys = ["omitted", "class_id", "level", "max_det"]
    areas = _mean_of_best(reached.groupBy(*keys, "step").agg(F.max("precision").alias("precision")), keys)
    grid = left.filter("omitted AND left > 0").select(F.col("_group").alias("omitted"), "class_id")
    grid = grid.withColumn("level", F.explode(F.array(*map(F.lit, range(len(levels)))))).withColumn("max_det", F.explode(F.array(*map(F.lit, caps))))
    ap = grid.join(areas, keys, "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
    at = lambda level: F.avg(F.when(F.col("level").isin(*[i for i, t in enumerate(levels) if abs(t - level) < 1e-9]), F.col("ap")))
    parts = [F.avg("ap").alias("ap50_95"), at(0.5).alias("ap50"), at(0.75).alias("ap75")]
    per_class = ap.groupBy("omitted", "max_det", "class_id").agg(*parts)
    return per_class.unionByName(ap.groupBy("omitted", "max_det").agg(F.lit(None).cast("int").alias("class_id"), *parts))


def _best_without(levels: list[float], caps: tuple[int, ...]):
    """Per (class, block): the best precision per recall step reached at the block's hits, for each group left out."""

    def best(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        names = ["class_id", "omitted", "level", "max_det", "step", "precision"]
        if rows.empty or starts.empty:
            return pd.DataFrame({c: [] for c in names})
        rows, starts = rows.sort_values("pos"), starts.reset_index(drop=True)
        code = pd.Index(starts["_group"]).get_indexer(rows["_group"])
        asked = np.flatnonzero(starts["omitted"].to_numpy(bool) & (starts["left"].to_numpy() > 0))
        mine = code[None, :] == asked[:, None]
        left = starts["left"].to_numpy(float)[asked]
        hits, rank, out = rows["hits"].to_numpy(), rows["rank"].to_numpy(), []
        one = lambda who, i, cap, step, top: (who, np.full(len(who), i), np.full(len(who), cap), step, top)
        for j, cap in enumerate(caps):
            within = rank <= cap
            seen = starts[f"n_{j}"].sum() + np.cumsum(within)
            own_seen = starts[f"n_{j}"].to_numpy()[asked][:, None] + np.cumsum(mine & within, axis=1)
            for i in range(len(levels)):
                hit = (hits >> i & 1).astype(bool) & within
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                found = starts[f"t_{i}_{j}"].sum() + np.cumsum(hit)[at]
                own_found = starts[f"t_{i}_{j}"].to_numpy()[asked][:, None] + np.cumsum(mine & hit, axis=1)[:, at]
                tp, n = found[None, :] - own_found, seen[at][None, :] - own_seen[:, at]
                precision = np.where(mine[:, at], 0.0, tp / np.maximum(n, 1))
                # counts ascend, so a block's steps lie between those of its first and its last hit, mostly one
                low, high = (_recall_step(tp[:, k] / left) for k in (0, -1))
                flat = low == high
                top = precision[flat].max(1)
                out.append(one(asked[flat][top > 0], i, cap, low[flat][top > 0], top[top > 0]))
                for g in np.flatnonzero(~flat):
                    step = _recall_step(tp[g] / left[g])
                    head = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
                    top = np.maximum.reduceat(precision[g], head)
                    out.append(one(np.full((top > 0).sum(), asked[g]), i, cap, step[head][top > 0], top[top > 0]))
        if not out:
            return pd.DataFrame({c: [] for c in names})
        who, *columns = (np.concatenate(c) for c in zip(*out, strict=True))
        made = dict(zip(names[2:], columns, strict=True))
        return pd.DataFrame({"class_id": rows["class_id"].iat[0], "omitted": starts["_group"].to_numpy()[who], **made})

    return best


# ---------------------------------------------------------------- recall and rates


def size_recall(truth: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Detected/total/recall by class, size bin, both and overall (NULL = all).

    ``truth`` is ``found_truth``: one row per truth box with its ``matched_score``.
    """
    seen = F.coalesce(F.col("matched_score") >= threshold, F.lit(False)).cast("long")
    rows = truth.select("class_id", size_bin(box()).alias("size_bin"), seen.alias("seen"))
    cube = rows.cube("class_id", "size_bin").agg(F.sum("seen").alias("detected"), F.count("*").alias("total"))
    return cube.select("*", (F.col("detected") / F.col("total")).alias("recall"))


def negative_fp_rate(images: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float) -> DataFrame:
    """Share of the images without truth that have at least one prediction at the threshold."""
    negative = images.select("image_id").join(gt.select("image_id"), "image_id", "left_anti")
    fired = negative.join(pred.filter(F.col("score") >= threshold).select("image_id"), "image_id", "left_semi")
    rows = negative.select(F.lit(1).alias("n"), F.lit(0).alias("f")).unionByName(
        fired.select(F.lit(0).alias("n"), F.lit(1).alias("f"))
    )
    total = rows.agg(F.sum("n").alias("negative_images"), F.sum("f").alias("images_with_fp"))
    return total.select(
        "*", F.when(F.col("negative_images") > 0, F.col("images_with_fp") / F.col("negative_images")).alias("rate")
    )


def bootstrap_recall(per_group: DataFrame, resamples: int, seed: int = 42) -> DataFrame:
    """Percentile interval of recall when whole groups are drawn with replacement.

    ``per_group``: one row per group with ``group_id, tp, fn``. Draw ``j`` of resample ``i`` takes
    the group with ordinal ``md5(seed|i|j) mod groups``; the work is groups x resamples hashed
    picks, summed before anything is shuffled on the resample.
    """
    numbered = running(per_group, [], [F.col("group_id")], {"ordinal": F.lit(1)})
    groups = numbered.agg(F.count("*").alias("groups")).scalar()
    base = numbered.select((F.col("ordinal") - 1).cast("long").alias("ordinal"), "tp", "fn")
    draws = (
        base.select("ordinal", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
        .select("resample", hash_pick(groups, F.lit(seed), F.col("resample"), F.col("ordinal")).alias("ordinal"))
        .groupBy("resample", "ordinal").agg(F.count("*").alias("times"))
    )
    values = draws.join(base, "ordinal").groupBy("resample").agg(
        F.sum(F.col("tp") * F.col("times")).alias("tp"), F.sum(F.col("fn") * F.col("times")).alias("fn")
    )
    recalls = values.filter(F.col("tp") + F.col("fn") > 0).select((F.col("tp") / (F.col("tp") + F.col("fn"))).alias("r"))
    interval = recalls.agg(
        F.percentile("r", F.lit(0.025)).alias("lower"), F.percentile("r", F.lit(0.975)).alias("upper"),
        F.count("*").alias("resamples"),
    )
    joined = interval.withColumn("groups", groups)
    enough = F.col("groups") >= 2
    return joined.select(
        F.when(enough, F.col("lower")).alias("lower"), F.when(enough, F.col("upper")).alias("upper"),
        F.when(enough, F.col("resamples")).otherwise(F.lit(0)).cast("long").alias("resamples"), "groups",
        F.when(~enough, F.lit("fewer than two groups")).alias("refused"),
    )


def split_summary(images: DataFrame, objects: DataFrame) -> DataFrame:
    """Images, groups, boxes, positive images per split, split x source and split x class."""
    has_box = objects.groupBy("image_id").agg(F.count("*").alias("boxes"))
    per_image = images.join(has_box, "image_id", "left").na.fill(0, ["boxes"])
    a = per_image.groupingSets([["split"], ["split", "source"]], "split", "source").agg(
        F.count("*").alias("images"), F.countDistinct("group_id").alias("groups"), F.sum("boxes").alias("boxes"),
        F.count_if(F.col("boxes") > 0).alias("positive_images"),
    ).select("split", "source", F.lit(None).cast("int").alias("class_id"), "images", "groups", "boxes", "positive_images")
    b = objects.groupBy("split", "class_id").agg(
        F.countDistinct("image_id").alias("images"), F.countDistinct("group_id").alias("groups"),
        F.count("*").alias("boxes"), F.countDistinct("image_id").alias("positive_images"),
    ).select("split", F.lit(None).cast("string").alias("source"), "class_id", "images", "groups", "boxes", "positive_images")
    return a.unionByName(b)


def group_features(images: DataFrame, objects: DataFrame) -> DataFrame:
    """Long form of the group vector: per class, per size, per class x size, and image count."""
    sized = objects.select("group_id", F.col("class_id").cast("string").alias("c"), size_bin(box()).alias("s"))
    cells = sized.groupingSets([["group_id", "c"], ["group_id", "s"], ["group_id", "c", "s"]], "group_id", "c", "s").agg(
        F.count("*").alias("value")
    )
    name = F.concat_ws("/", F.concat(F.lit("class="), "c"), F.concat(F.lit("size="), "s"))
    counts = images.groupBy("group_id").agg(F.count("*").alias("value"))
    return cells.select("group_id", name.alias("feature"), "value").unionByName(
        counts.select("group_id", F.lit("images").alias("feature"), "value")
    )


def class_support(objects: DataFrame, keys: list[str]) -> DataFrame:
    return objects.groupBy(*keys).agg(
        F.countDistinct("image_id").alias("images"), F.count("*").alias("boxes"),
        F.countDistinct("group_id").alias("groups"),
    )


#: Ranges that a round of ``exact_quantiles`` cuts a value range into.
RANGES = 1024


def exact_quantiles(df: DataFrame, value: str, keys: list[str], at: list[float]) -> DataFrame:
    """Exact quantiles per key, interpolated between the two nearest ranks: keys, ``n``, and ``q_0``, ``q_1`` ... for ``at``.

    Rank selection by counting: the range that holds a wanted rank is cut into ``RANGES`` and counted, and the part with the rank is
    the next range, from its least to its greatest value, until these are equal. Rows outside the ranges leave after each
    round, so all but the first read little, and a key with any share of the rows is only counted. NULL and NaN don't count; a
    key without a value has no row. ``keys`` aren't NULL.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = cut(rows)
    ends = cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")))
    places = [F.lit(float(q)) * (F.col("n") - 1) for q in at]
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p), F.ceil(p)) for p in places))))
    left = ends.select(*keys, "low", "high", F.lit(0).cast("long").alias("below"), F.explode(wanted).alias("rank"))
    settled, one = None, [*keys, "rank"]
    while True:
        done = left.filter("low = high").select(*one, F.col("low").alias("v"))
        settled = done if settled is None else settled.unionByName(done)
        left = left.filter("low < high")
        if left.isEmpty():
            break
        inside = rows.join(left, keys).filter(F.col("_v").between(F.col("low"), F.col("high")))
        share = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves: the span of two doubles may be none
        part = F.least(F.floor(share * RANGES), F.lit(RANGES - 1))
        parts = inside.groupBy(*one, "below", part.alias("part")).agg(F.count("*").alias("m"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.sum("m").over(W.partitionBy(*one).orderBy("part"))  # at most RANGES rows
        parts = parts.withColumn("upto", F.col("below") + upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("m") <= F.col("rank")))
        left = cut(parts.select(*keys, "low", "high", (F.col("upto") - F.col("m")).alias("below"), "rank"))
        spans = left.select(*keys, F.col("low").alias("_low"), F.col("high").alias("_high")).distinct()
        rows = cut(rows.join(spans, keys).filter(F.col("_v").between(F.col("_low"), F.col("_high"))).drop("_low", "_high").withColumn("_v", F.col("_v")))
    values = ends.select(*keys, "n").join(settled.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("of")), keys)
    exact = lambda p: F.col("of")[F.floor(p)] * (F.floor(p) + 1 - p) + F.col("of")[F.floor(p) + 1] * (p - F.floor(p))
    shown = [F.when(p == F.floor(p), F.col("of")[F.floor(p)]).otherwise(exact(p)).alias(f"q_{i}") for i, p in enumerate(places)]
    return values.select(*keys, "n", *shown)


def latency_stats(times: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Count, mean, exact p50/p95 and total over rows that are not warm-up."""
    warm = cut(times.filter(~F.col("warm_up")).select(*keys, value))
    sums = warm.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    found = exact_quantiles(warm, value, keys, [0.5, 0.95]).drop("n")
    return sums.join(found, keys, "left").select(*keys, "n", "mean", F.col("q_0").alias("p50"), F.col("q_1").alias("p95"), "total")


def dense_cells(gt: DataFrame, limit: int = 100) -> DataFrame:
    """(image, class) cells above ``limit`` truths, and the recall a cap of ``limit`` allows."""
    n = gt.groupBy(*GROUP).agg(F.count("*").alias("boxes")).filter(F.col("boxes") > limit)
    return n.select("*", (F.lit(limit) / F.col("boxes")).alias("recall_ceiling"))


def cap_audit(pred: DataFrame, image_cap: int, class_caps: tuple[int, int] = (100, 300)) -> DataFrame:
    """Images at the per-image cap, cells above the class caps, lowest score kept by a full image."""
    cells = pred.groupBy(*GROUP).agg(F.count("*").alias("n"), F.min("score").alias("low"))
    images = cells.groupBy("image_id").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"),
        *[F.count_if(F.col("n") > c).alias(f"over_{c}") for c in class_caps],
    )
    return images.agg(
        F.count("*").alias("images"), F.count_if(F.col("n") >= image_cap).alias("images_at_cap"),
        *[F.sum(f"over_{c}").alias(f"cells_over_{c}") for c in class_caps],
        F.min(F.when(F.col("n") >= image_cap, F.col("low"))).alias("lowest_kept_score"),
    )


def recheck_prf(stored: DataFrame) -> DataFrame:
    """Largest difference between stored P/R/F1 and the same values from the stored counts."""
    p, r = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    pairs = [("precision", p), ("recall", r), ("f1", f1(p, r))]
    return stored.agg(
        F.count("*").alias("rows"),
        *[F.max(F.abs(F.col(n) - v)).alias(f"max_error_{n}") for n, v in pairs],
    )

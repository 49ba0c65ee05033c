"""Tiles, training views, ignore regions, weighted draws and exposure accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.functions.boxes import Box, box, grid_centres, letterbox, max_difference, normalize_to_crop, scale_box
from boxloom.functions.hashing import hash_unit
from boxloom.operators.joins import clip_objects
from boxloom.operators.matching import suppressed, top_per_group
from boxloom.operators.prefix import running
from boxloom.session import cut

COMPLETE = 1 - 1e-12


def axis_starts(length: Column, size: int, overlap: float) -> Column:
    """Tile starts on one axis: fixed stride, the last tile flush with the edge."""
    length = length.cast("int")
    tile = F.least(length, F.lit(size))
    last = length - tile
    stride = F.greatest(F.lit(1), F.floor(tile * (1 - overlap)).cast("int"))
    return F.array_union(F.sequence(F.lit(0), last, stride), F.array(last))


def tiles(images: DataFrame, size: int | tuple[int, int], overlap: float = 0.2, roi: str | None = None) -> DataFrame:
    """Row-major tile grid of every image in native pixels; a small image is one smaller tile.

    ``size`` is one number or (height, width). ``roi`` names a column with a struct ``x1, y1, x2, y2`` of whole pixels: the
    grid covers it instead of the image (null: the whole image), cut to the image; an image whose region is empty has no tile.
    """
    high, wide = (size, size) if isinstance(size, int) else size
    region = Box(F.lit(0), F.lit(0), F.col("width").cast("int"), F.col("height").cast("int"))
    if roi:
        part = Box(*(F.col(f"{roi}.{k}").cast("int") for k in Box._fields))
        limits = (region.x2, region.y2) * 2
        region = Box(*(F.when(p.isNull(), whole).otherwise(F.least(F.greatest(p, F.lit(0)), most)) for p, most, whole in zip(part, limits, region, strict=True)))
    named = images.select("*", *(c.alias(f"_{k}") for k, c in zip(Box._fields, region, strict=True))).filter("_x2 > _x1 AND _y2 > _y1")
    width, height = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    xs, ys = axis_starts(width, wide, overlap), axis_starts(height, high, overlap)
    rows = named.withColumn("_nx", F.size(xs)).select("*", F.posexplode(ys).alias("_iy", "_oy"))
    rows = rows.select("*", F.posexplode(xs).alias("_ix", "_ox")).withColumns({"x1": F.col("_x1") + F.col("_ox"), "y1": F.col("_y1") + F.col("_oy")})
    return rows.select(
        *images.columns, (F.col("_iy") * F.col("_nx") + F.col("_ix")).alias("tile"), "x1", "y1",
        (F.col("x1") + F.least(width, F.lit(wide))).alias("x2"),
        (F.col("y1") + F.least(height, F.lit(high))).alias("y2"),
    )


def tile_plan(images: DataFrame, sizes: list[int], overlap: float = 0.2) -> DataFrame:
    """Tiles of several sizes together; equal bounds from two sizes both stay."""
    out = None
    for s in sizes:
        part = tiles(images, s, overlap).withColumn("size", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


# fixed values: room around the longest side of an object, and the step of a crop's side in pixels
CROP_ROOM, CROP_STEP = 1.1, 32


def centred_crop(b: Box, width: Column, height: Column, least: int) -> Box:
    longest = F.greatest(b.width, b.height)
    side = F.greatest(F.lit(least), (F.ceil(longest * CROP_ROOM / CROP_STEP) * CROP_STEP).cast("int"))
    w, h = F.least(side, width).cast("int"), F.least(side, height).cast("int")
    x = F.least(F.greatest(((b.x1 + b.x2 - w) / 2).cast("int"), F.lit(0)), width - w)
    y = F.least(F.greatest(((b.y1 + b.y2 - h) / 2).cast("int"), F.lit(0)), height - h)
    return Box(x, y, x + w, y + h)


# fixed values: view kinds, first one wins when two give the same crop
KINDS = ["native", "context", "object_centered"]


def make_views(
    images: DataFrame, objects: DataFrame, native: int, context: int, centred_classes: list[int], order: str = "instance_id"
) -> DataFrame:
    """Native tiles, larger context tiles, and crops centred on objects: on those of the chosen classes, and, in the ``order`` of
    an image's objects, on each that no tile and no earlier crop shows completely. Equal crops of an image are one view.

    An object waits for the earlier ones whose crops would show it, and is settled as soon as these are: its own crop is void if one of theirs stands. These
    are the rounds of ``suppressed``; objects of different places settle side by side.
    """
    keep = ["image_id", "width", "height", "group_id"]
    base = images.select(*keep)
    grids = tiles(base, native).select(*keep, *box(), F.lit(0).alias("kind_rank")).unionByName(
        tiles(base, context).select(*keep, *box(), F.lit(1).alias("kind_rank"))
    )
    crops = grids.select("image_id", *box().cast("double").columns())
    items = objects.select("image_id", F.col(order).alias("_at"), "class_id", *box())
    shown = _complete(crops, items).select("image_id", "_at").distinct()
    always = F.col("class_id").isin(centred_classes)
    # objects that may need a crop, each with the crop that it would get
    asked = items.join(shown.withColumn("_shown", F.lit(True)), ["image_id", "_at"], "left").filter(always | F.col("_shown").isNull())
    asked = asked.join(base, "image_id").select(
        *keep, "_at", always.alias("_always"), *box(), *(c.alias("c_" + n) for n, c in zip(("x1", "y1", "x2", "y2"), centred_crop(box(), F.col("width"), F.col("height"), native)))
    )
    asked = cut(asked)
    own = asked.select("image_id", F.col("_at").alias("_by"), F.col("_always").alias("_stands"), *(F.col("c_" + n).cast("double").alias(n) for n in ("x1", "y1", "x2", "y2")))
    seen = _complete(own, asked.filter("NOT _always").select("image_id", "_at", *box()), ["_by", "_stands"]).filter(F.col("_by") < F.col("_at"))
    seen = cut(seen.select("image_id", "_by", "_stands", "_at"))
    void = seen.filter("_stands").select("image_id", "_at").distinct()
    rest = seen.filter("NOT _stands").join(void, ["image_id", "_at"], "left_anti").join(void.withColumnRenamed("_at", "_by"), ["image_id", "_by"], "left_anti")
    waits = rest.select("image_id", F.col("_by").alias("pred_index"), F.lit(0.0).alias("score"), F.col("_at").alias("lower"))
    void = void.unionByName(suppressed(waits, ["image_id"]).withColumnRenamed("pred_index", "_at"))
    centred = asked.join(void, ["image_id", "_at"], "left_anti").select(*keep, *(F.col("c_" + n).alias(n) for n in ("x1", "y1", "x2", "y2")), F.lit(2).alias("kind_rank"))
    names = F.array(*[F.lit(k) for k in KINDS])
    every = grids.select(*keep, *box().cast("int").columns(), "kind_rank").unionByName(
        centred.select(*keep, *box().cast("int").columns(), "kind_rank")
    )
    once = every.groupBy(*keep, "x1", "y1", "x2", "y2").agg(F.min("kind_rank").alias("k"))
    view_id = F.concat_ws("_", "image_id", "x1", "y1", "x2", "y2")
    return once.select(view_id.alias("view_id"), *keep, F.get(names, F.col("k")).alias("kind"), *box().columns())


def _complete(crops: DataFrame, items: DataFrame, more: tuple | list = ()) -> DataFrame:
    """Items that a crop of their image shows completely: ``image_id, _at`` and the crop's ``more`` columns."""
    named = crops.select("image_id", *more, *box().cast("double").columns())
    return clip_objects(named, items.select("image_id", "_at", *box())).filter(F.col("visible_fraction") >= COMPLETE).select("image_id", "_at", *more)


def _clipped(views: DataFrame, objects: DataFrame) -> DataFrame:
    crops = views.select("image_id", "view_id", "group_id", *box().cast("double").columns())
    return clip_objects(crops, objects)


def route_targets(views: DataFrame, objects: DataFrame, excluded: DataFrame) -> DataFrame:
    """Objects of every view: targets, and ignore regions with their reason.

    A fragment below half of its object is ignored, and so is any part of a source object of
    unknown type. Other excluded objects leave no trace.
    """
    seen = _clipped(views, objects.select("image_id", "instance_id", "class_id", *box()))
    part = F.col("visible_fraction") < 0.5
    a = seen.select(
        "view_id", "group_id", "instance_id", "class_id", "visible_fraction", *box(), *box("c_"),
        F.when(part, "ignore").otherwise("target").alias("role"),
        F.when(part, "target_fragment_lt50").alias("reason"),
    )
    unknown = excluded.filter(F.col("source_type") == "unknown").select(
        "image_id", F.concat(F.lit("x"), F.col("source_index").cast("string")).alias("instance_id"),
        F.lit(None).cast("int").alias("class_id"), *box(),
    )
    b = _clipped(views, unknown).select(
        "view_id", "group_id", "instance_id", "class_id", "visible_fraction", *box(), *box("c_"),
        F.lit("ignore").alias("role"), F.lit("source_unknown").alias("reason"),
    )
    both = a.unionByName(b)
    parts = normalize_to_crop(box(), box("c_"))
    return both.select(
        "view_id", "group_id", "instance_id", "class_id", "visible_fraction", "role", "reason",
        *[c.alias(n) for n, c in parts.items()],
        (F.col("c_x2") - F.col("c_x1")).alias("width"), (F.col("c_y2") - F.col("c_y1")).alias("height"),
    )


def tile_labels(views: DataFrame, objects: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Labels of each view with a ``clipped`` flag; views without any object stay as one row."""
    seen = _clipped(views, objects.select("image_id", "instance_id", "class_id", *box())).filter(
        F.col("visible_fraction") > minimum
    )
    rows = seen.select(
        "view_id", "instance_id", "class_id", (F.col("visible_fraction") < COMPLETE).alias("clipped"), *box()
    )
    return views.select("view_id", "image_id").join(rows, "view_id", "left")


def sampling_weight(views: DataFrame, targets: DataFrame, preferred: list[int], boost: float = 1.5) -> DataFrame:
    """Priority 1.5 for views with a target of a preferred class, normalised inside each group."""
    liked = targets.filter(F.col("class_id").isin(preferred)).select("view_id").distinct().withColumn("_b", F.lit(boost))
    p = views.join(liked, "view_id", "left").withColumn("priority", F.coalesce("_b", F.lit(1.0))).drop("_b")
    total = p.groupBy("group_id").agg(F.sum("priority").alias("_t"))
    return p.join(total, "group_id").withColumn("sampling_weight", F.col("priority") / F.col("_t")).drop("_t")


def weighted_draws(views: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` draws with replacement in proportion to ``sampling_weight``: view_id, n.

    A view starts where the weights before it end, draw ``i`` lies at ``hash(seed, i)``, and a draw takes the last view that
    starts at or before it. Starts and draws are one sequence, cut into ranges of about equal size: inside a range the last start is
    carried on, and each range hands one row to the next. So a view with nearly all the weight is one start whose draws lie in many ranges, and many
    light views next to each other are ranges of their own.
    """
    cum = running(views.select("view_id", "sampling_weight"), [], [F.col("view_id")], {"hi": F.col("sampling_weight")})
    cum = cut(cum.filter("sampling_weight > 0"))
    total = cum.agg(F.max("hi").alias("total")).scalar()
    starts = cum.select(((F.col("hi") - F.col("sampling_weight")) / total).alias("at"), F.lit(0).alias("kind"), "view_id")
    kind = views.schema["view_id"].dataType.simpleString()
    draws = views.sparkSession.range(n).select(hash_unit(F.lit(seed), F.col("id")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("view_id"))
    ranged = cut(starts.unionByName(draws).repartitionByRange("at", "kind", "view_id").withColumn("_range", F.spark_partition_id()))
    inside = W.partitionBy("_range").orderBy("at", "kind", "view_id").rowsBetween(W.unboundedPreceding, 0)
    last = ranged.filter("kind = 0").groupBy("_range").agg(F.max_by("view_id", F.struct("at", "view_id")).alias("_last"))
    # one row per range
    every = ranged.select("_range").distinct().join(last, "_range", "left")
    before = every.select("_range", F.last("_last", ignorenulls=True).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    filled = ranged.withColumn("_own", F.last("view_id", ignorenulls=True).over(inside)).filter("kind = 1").join(before, "_range")
    drawn = filled.select(F.coalesce("_own", "_before").alias("view_id")).filter("view_id IS NOT NULL")
    return drawn.groupBy("view_id").agg(F.count("*").alias("n"))


def exposures(draws: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """How often each kind of label was shown: stored labels, label exposures, distinct instances
    seen and seen completely. ``labels``: view_id, instance_id, visible_fraction and the keys."""
    j = labels.join(draws, "view_id", "left").na.fill(0, ["n"])
    drawn = F.col("n") > 0
    return j.groupBy(*keys).agg(
        F.count("*").alias("stored"), F.sum("n").alias("exposures"),
        F.count_distinct(F.when(drawn, F.col("instance_id"))).alias("instances_seen"),
        F.count_distinct(F.when(drawn & (F.col("visible_fraction") >= COMPLETE), F.col("instance_id"))).alias("instances_complete"),
    )


def concentration(draws: DataFrame, views: DataFrame) -> DataFrame:
    """Effective number of views (inverse Simpson), draw-count quantiles, top view and top-3 groups.

    Quantiles come from the histogram of draw counts; the median is the element at n // 2 of the
    descending list.
    """
    hist = draws.groupBy("n").agg(F.count("*").alias("views"))
    sums = hist.agg(
        F.sum(F.col("n") * F.col("views")).alias("draws"),
        F.sum((F.col("n") * F.col("n") * F.col("views")).cast("double")).alias("sq"),
        F.sum("views").alias("drawn_views"), F.max("n").alias("max_draws"), F.min("n").alias("min_draws"),
    )
    down = W.orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, 0)
    total = hist.agg(F.sum("views")).scalar()
    median = hist.select("n", F.sum("views").over(down).alias("c")).filter(F.col("c") > F.floor(total / 2)).agg(
        F.max("n")
    ).scalar()
    groups = draws.join(views.select("view_id", "group_id"), "view_id").groupBy("group_id").agg(F.sum("n").alias("n"))
    top3 = groups.orderBy(F.col("n").desc(), "group_id").limit(3).agg(F.sum("n")).scalar()
    return sums.select(
        "drawn_views", "draws", (F.col("draws") * F.col("draws") / F.col("sq")).alias("effective_views"),
        "max_draws", median.alias("median_draws"), "min_draws", (F.col("max_draws") / F.col("draws")).alias("top_view_share"),
        (top3 / F.col("draws")).alias("top3_group_share"),
    )


def ignore_coverage(draws: DataFrame, regions: DataFrame, size: int = 1024, strides=(8, 16, 32)) -> DataFrame:
    """Ignore regions that hold no grid centre of any stride after letterboxing, stored and drawn."""
    b = letterbox(*[F.col(c) for c in ("cx", "cy", "w", "h", "width", "height")], size)
    centres = F.lit(0)
    for s in strides:
        centres = centres + grid_centres(b, s)
    j = regions.join(draws, "view_id", "left").na.fill(0, ["n"]).withColumn("_empty", (centres == 0).cast("long"))
    return j.groupBy("reason").agg(
        F.count("*").alias("regions"), F.sum("_empty").alias("without_centre"), F.sum("n").alias("exposures"),
        F.sum(F.col("n") * F.col("_empty")).alias("exposures_without_centre"),
    )


def rescale_dataset(images: DataFrame, objects: DataFrame, scale: float) -> DataFrame:
    """The label set at another resolution: every id kept, with clamp and round-trip errors."""
    w, h = F.col("width"), F.col("height")
    nw, nh = F.bround(w * scale).cast("int"), F.bround(h * scale).cast("int")
    j = objects.join(images.select("image_id", "width", "height"), "image_id")
    s = scale_box(box(), w, h, nw, nh)
    back = Box(s.x1 * w / nw, s.y1 * h / nh, s.x2 * w / nw, s.y2 * h / nh)
    keep = [c for c in objects.columns if c not in ("x1", "y1", "x2", "y2")]
    return j.select(
        *keep, *s.columns(), nw.alias("width"), nh.alias("height"), max_difference(back, box()).alias("round_trip_error")
    )


def training_manifest(images: DataFrame, tile_rows: DataFrame) -> DataFrame:
    """Tiles for training and native images for everything else; a cohort of its own (``pi_test``)
    maps to split ``test``."""
    split = F.when(F.col("cohort") == "pi_test", "test").otherwise(F.col("cohort"))
    native = images.filter(F.col("cohort") != "train").select(
        F.col("image_id").cast("string").alias("row_id"), "image_id", "group_id", split.alias("split"), "cohort",
        F.lit("native").alias("form"),
    )
    tiled = tile_rows.select(
        F.concat_ws("__", F.col("image_id").cast("string"), F.lpad(F.col("tile").cast("string"), 4, "0")).alias("row_id"),
        "image_id", "group_id", F.lit("train").alias("split"), F.lit("train").alias("cohort"), F.lit("tile").alias("form"),
    )
    return native.unionByName(tiled)


def sample_conditions(frames: DataFrame, seed: str, conditions: int = 20, per_condition: int = 5) -> DataFrame:
    """Per code a hash-ordered choice of conditions and, in each, of frames."""
    def h(*c):
        return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(x).cast("string") for x in c]))

    cells = frames.select("code", "condition").distinct().withColumn("_h", h("code", "condition"))
    chosen = top_per_group(cells, ["code"], [F.col("_h"), F.col("condition")], conditions).drop("_h")
    rows = frames.join(chosen, ["code", "condition"]).withColumn("_h", h("frame"))
    return top_per_group(rows, ["code", "condition"], [F.col("_h"), F.col("frame")], per_condition).drop("_h")


def label_ledger(objects: DataFrame, targets: DataFrame, draws: DataFrame) -> DataFrame:
    """Per class: original boxes, labels stored in views, labels shown by the draws."""
    a = objects.groupBy("class_id").agg(F.count("*").alias("original"))
    b = exposures(draws, targets, ["class_id"]).select("class_id", "stored", "exposures")
    return a.join(b, "class_id", "left").na.fill(0, ["stored", "exposures"])


def group_ledger(draws: DataFrame, views: DataFrame) -> DataFrame:
    """Per group: draws and their share against the expected equal share of a group."""
    j = views.join(draws, "view_id", "left").na.fill(0, ["n"])
    g = j.groupBy("group_id").agg(F.count("*").alias("views"), F.sum("n").alias("draws"))
    total = g.agg(F.sum("draws")).scalar()
    groups = g.agg(F.count("*")).scalar()
    return g.select("group_id", "views", "draws", (F.col("draws") / total).alias("share"), (F.lit(1.0) / groups).alias("expected"))

"""Annotation readers. Each has a parser over (path, content) rows, so the same rules apply to files,
to archived text columns and to tests; the ``read_*`` functions only add the file scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom import schemas
from boxloom.functions.boxes import Box, box, box_area, box_from_voc, box_from_yolo
from boxloom.functions.text import stem
from boxloom.operators.prefix import running

#: How a reader gets its rows path, content: ``whole_text`` of plain files or ``archived_text``.
Texts = Callable[..., DataFrame]


def whole_text(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row per file: path, content."""
    rows = spark.read.options(**options).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def archived_text(spark: SparkSession, path: str) -> DataFrame:
    """The documents of an archive as rows path, content: what ``whole_text`` gives of a folder of files, without a file, a folder
    and a listing for each. ``writers.write_archive`` makes it; a reader takes it as its ``texts``."""
    return spark.read.schema(schemas.ARCHIVED_TEXT).parquet(path)


# ---------------------------------------------------------------- YOLO text


def parse_yolo(files: DataFrame, n_classes: int, geometry: str = "any") -> DataFrame:
    """Label lines to boxes; a line that breaks a rule keeps its ``problem`` and has no box.

    ``files``: path, content, width, height. Blank lines are skipped but counted in the line number.
    ``geometry='polygon'`` refuses plain boxes, ``'bbox'`` refuses polygons.
    """
    lines = files.select(
        "path", "width", "height", F.posexplode(F.split("content", r"\r?\n")).alias("_pos", "line")
    ).filter(F.trim("line") != "")
    tokens = F.split(F.trim("line"), r"\s+")
    t = lines.select("path", "width", "height", (F.col("_pos") + 1).alias("line_number"), "line", tokens.alias("t"))
    values = F.transform(F.slice("t", 2, F.size("t")), lambda v: v.try_cast("double"))
    t = t.withColumn("v", values).withColumn("native_class_id", F.get("t", F.lit(0)).try_cast("int"))
    n = F.size("v")
    in_range = F.forall("v", lambda x: F.coalesce((x >= 0) & (x <= 1), F.lit(False)))
    is_box, is_polygon = n == 4, (n >= 6) & (n % 2 == 0)

    def at(i: int) -> Column:
        return F.get("v", F.lit(i))

    w, h = F.col("width"), F.col("height")
    plain = box_from_yolo(at(0), at(1), at(2), at(3), w, h)
    xs, ys = F.filter("v", lambda _, i: i % 2 == 0), F.filter("v", lambda _, i: i % 2 == 1)
    outline = Box(F.array_min(xs) * w, F.array_min(ys) * h, F.array_max(xs) * w, F.array_max(ys) * h)
    raw = Box(*[F.when(is_box, a).otherwise(b) for a, b in zip(plain, outline)])
    limits = (w, h, w, h)
    clip = Box(*[F.greatest(F.lit(0.0), F.least(c, m.cast("double"))) for c, m in zip(raw, limits)])
    allowed = {"any": is_box | is_polygon, "polygon": is_polygon, "bbox": is_box}[geometry]
    problem = (
        F.when((F.size("t") < 5) | ~F.get("t", F.lit(0)).rlike(r"^\d+$"), "invalid_class_or_field_count")
        .when(F.col("native_class_id") >= n_classes, "unknown_class")
        .when(~in_range, "out_of_range")
        .when(is_box & ((at(2) <= 0) | (at(3) <= 0)), "nonpositive_size")
        .when(~allowed, "invalid_geometry")
        .when((clip.x2 <= clip.x1) | (clip.y2 <= clip.y1), "zero_area")
    )
    clipped = F.lit(False)
    for a, b in zip(raw, clip):
        clipped = clipped | (a != b)
    ok = problem.isNull()
    return t.select(
        "path", "line_number", "native_class_id",
        F.when(is_box, "yolo_bbox").when(is_polygon, "yolo_polygon").alias("native_format"), F.col("v").alias("native_coordinates"),
        *[F.when(ok, F.round(c, 4)).alias(k) for k, c in zip(Box._fields, clip)],
        F.when(ok, clipped).alias("box_clipped"), problem.alias("problem"),
    )


def read_yolo(
    spark: SparkSession, path: str, images: DataFrame, classes: list[str], geometry: str = "any", name: Callable[[Column], Column] = stem,
    texts: Texts = whole_text,
) -> DataFrame:
    """Label files under ``path`` joined to their images by stem (``images``: stem, width, height); ``name`` takes the stem from a path."""
    files = texts(spark, path).withColumn("stem", name(F.col("path")))
    rows = parse_yolo(files.join(images.select("stem", "width", "height"), "stem"), len(classes), geometry)
    names = F.array(*[F.lit(c) for c in classes])
    return rows.withColumn("native", F.get(names, F.col("native_class_id")))


# ---------------------------------------------------------------- VOC XML


def _voc_objects(docs: DataFrame, key: list[str], spelling: dict[str, str], clamp: bool) -> DataFrame:
    rows = docs.select(*key, "a.filename", "a.size", F.posexplode_outer("a.object").alias("source_index", "o"))
    b = box_from_voc(*[F.col(f"o.bndbox.{c}") for c in ("xmin", "ymin", "xmax", "ymax")], clamp)
    name = F.trim("o.name")
    fixed = name
    for wrong, right in spelling.items():
        fixed = F.when(F.lower(name) == wrong, right).otherwise(fixed)
    lifted = (F.col("o.bndbox.xmin") < 1) | (F.col("o.bndbox.ymin") < 1)
    return rows.select(
        *key, "filename", F.col("size.width").alias("width"), F.col("size.height").alias("height"), "source_index",
        F.col("o.name").alias("source_name"), fixed.alias("class_name"),
        F.coalesce("o.difficult", F.lit(0)).alias("difficult"), F.coalesce("o.truncated", F.lit(0)).alias("truncated"),
        *[c.cast("double").alias(n) for n, c in zip(Box._fields, b)], lifted.alias("clamped"),
    )


def parse_voc(files: DataFrame, spelling: dict[str, str] | None = None, clamp: bool = True) -> DataFrame:
    """VOC documents held as text: ``path, content`` to one row per object."""
    docs = files.select("path", F.from_xml("content", schemas.VOC_ANNOTATION, {"rowTag": "annotation"}).alias("a"))
    return _voc_objects(docs, ["path"], spelling or {}, clamp)


def read_voc(
    spark: SparkSession, path: str, spelling: dict[str, str] | None = None, clamp: bool = True, texts: Texts | None = None
) -> DataFrame:
    """One row per object of the annotations in XML files, several to a file if need be, or of ``texts`` with one annotation each."""
    if texts is not None:
        return parse_voc(texts(spark, path), spelling, clamp)
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schemas.VOC_ANNOTATION).load(path)
    docs = rows.select(F.col("_metadata.file_path").alias("path"), F.struct("filename", "size", "object").alias("a"))
    return _voc_objects(docs, ["path"], spelling or {}, clamp)


def size_mismatches(objects: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations whose declared size is not that of the decoded image."""
    declared = objects.select("filename", "width", "height").distinct()
    real = images.select("filename", F.col("width").alias("_w"), F.col("height").alias("_h"))
    return declared.join(real, "filename").filter((F.col("width") != F.col("_w")) | (F.col("height") != F.col("_h")))


# ---------------------------------------------------------------- COCO-like JSON


def parse_coco(files: DataFrame) -> DataFrame:
    """COCO-like documents (``path, content``) to one row per annotation with its image and class."""
    d = files.select("path", F.from_json("content", schemas.COCO_DOCUMENT).alias("d"))
    ann = d.select("path", F.explode("d.annotations").alias("a"))
    img = d.select("path", F.explode("d.images").alias("i")).select(
        "path", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height"
    )
    cat = d.select("path", F.explode("d.categories").alias("c")).select(
        "path", F.col("c.id").alias("category_id"), F.col("c.name").alias("class_name")
    )
    rows = ann.select("path", "a.image_id", "a.category_id", F.col("a.id").alias("annotation_id"), "a.bbox", "a.segmentation")
    x, y, w, h = [F.get("bbox", F.lit(i)) for i in range(4)]
    parts = F.transform(
        "segmentation",
        lambda ring: F.transform(
            F.sequence(F.lit(0), (F.size(ring) / 2).cast("int") - 1),
            lambda i: F.struct(F.get(ring, 2 * i).alias("x"), F.get(ring, 2 * i + 1).alias("y")),
        ),
    )
    return rows.join(img, ["path", "image_id"]).join(cat, ["path", "category_id"], "left").select(
        "path", "image_id", "file_name", "width", "height", "annotation_id", "category_id", "class_name",
        x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), parts.alias("polygon_parts"),
    )


def read_coco(spark: SparkSession, path: str, texts: Texts = whole_text) -> DataFrame:
    return parse_coco(texts(spark, path))


def to_coco(objects: DataFrame, order: list[str]) -> DataFrame:
    """COCO annotation rows; ids count from 1 in ``order`` as a distributed prefix count."""
    ranked = running(objects, [], [F.col(c) for c in order], {"id": F.lit(1).cast("long")})
    b = box()
    return ranked.select(
        "id", "image_id", F.col("class_id").alias("category_id"),
        F.array(b.x1, b.y1, b.width, b.height).alias("bbox"), box_area(b).alias("area"), F.lit(0).alias("iscrowd"),
    )


# ---------------------------------------------------------------- CSV, JSON records, predictions, logs


def boxes_from_csv(sizes: DataFrame, rects: DataFrame) -> DataFrame:
    """Size and rectangle tables joined by file name; code and condition come from the name.

    A size that is listed again for its file counts once, so no rectangle is repeated.
    """
    return sizes.distinct().join(rects, "Image").select(
        F.col("Image").alias("image"), F.substring("Image", 1, 1).alias("code"), F.substring("Image", 1, 4).alias("condition"),
        F.col("Width").alias("image_width"), F.col("Height").alias("image_height"),
        F.col("Left").cast("double").alias("x1"), F.col("Top").cast("double").alias("y1"),
        (F.col("Left") + F.col("BoxWidth")).cast("double").alias("x2"),
        (F.col("Top") + F.col("BoxHeight")).cast("double").alias("y2"),
    )


def read_csv_boxes(spark: SparkSession, sizes: str, rects: str) -> DataFrame:
    s = spark.read.csv(sizes, header=True, schema=schemas.BOX_SIZES_CSV)
    r = spark.read.csv(rects, header=True, schema=schemas.BOX_RECTS_CSV)
    return boxes_from_csv(s, r.withColumnRenamed("Width", "BoxWidth").withColumnRenamed("Height", "BoxHeight"))


def union_staged(parts: list[DataFrame]) -> DataFrame:
    """Record tables of different sources under one schema; absent columns become NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    """JSON or JSON-lines record files, with the file they came from."""
    rows = spark.read.schema(schemas.STAGED_RECORD).option("multiLine", not path.endswith(".jsonl")).json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("staged_in"))


def load_class_map(spark: SparkSession, path: str) -> DataFrame:
    """``{source: {native: [target, status]}}`` documents as rows source, native, target, status."""
    doc = whole_text(spark, path).select(
        F.explode(F.from_json("content", "map<string,map<string,array<string>>>")).alias("source", "m")
    )
    rows = doc.select("source", F.explode("m").alias("native", "e"))
    return rows.select("source", "native", F.get("e", F.lit(0)).alias("target"), F.get("e", F.lit(1)).alias("status"))


def parse_class_names(files: DataFrame) -> DataFrame:
    """Class names of dataset files (``path, content``): ``path, class_id, name, problem``.

    ``names`` is a list, in brackets or one ``- name`` a line, or a map with one ``id: name`` a line; ``nc``, where
    given, is their number. A file that breaks a rule has one row with its ``problem`` and no name: ids that are not 0, 1, 2 ...,
    a name given twice, another ``nc``, or no names at all.
    """
    text = F.regexp_replace("content", "\r", "")
    flow = F.regexp_extract(text, r"(?ms)^names:\s*\[(.*?)\]", 1)
    block = F.regexp_extract(text, r"(?m)^names:[ \t]*\n((?:[ \t]*(?:-|\d+:)[^\n]*\n?)+)", 1)
    bare = lambda v: F.regexp_replace(F.trim(v), r"^(['\"])(.*)\1$", "$2")
    entry = lambda i, v: F.struct(i.cast("int").alias("id"), bare(v).alias("name"))
    listed = F.transform(F.split(flow, ","), lambda v, i: entry(i, v))
    lines = F.filter(F.split(block, "\n"), lambda v: F.trim(v) != "")
    rows = F.transform(lines, lambda v, i: F.when(
        F.ltrim(v).startswith("-"), entry(i, F.regexp_extract(v, r"^[ \t]*-(.*)$", 1))
    ).otherwise(entry(F.regexp_extract(v, r"^[ \t]*(\d+):", 1), F.regexp_extract(v, r"^[ \t]*\d+:(.*)$", 1))))
    none = F.array().cast("array<struct<id:int,name:string>>")
    found = F.when(F.trim(flow) != "", listed).when(block != "", F.array_sort(rows)).otherwise(none)
    count = F.regexp_extract(text, r"(?m)^nc:\s*(\d+)", 1)
    f = files.select("path", found.alias("names"), F.when(count != "", count.cast("int")).alias("nc"))
    ids, names = F.transform("names", lambda e: e["id"]), F.transform("names", lambda e: e["name"])
    problem = (
        F.when(F.size("names") == 0, "no_names")
        .when(ids != F.sequence(F.lit(0), F.size("names") - 1), "ids_not_contiguous")
        .when(F.size(F.array_distinct(names)) != F.size("names"), "duplicate_names")
        .when(F.col("nc") != F.size("names"), "count_disagrees")
    )
    f = f.withColumn("problem", problem)
    good = f.filter("problem IS NULL").select("path", F.inline("names"), "problem").select("path", F.col("id").alias("class_id"), "name", "problem")
    bad = f.filter("problem IS NOT NULL").select("path", F.lit(None).cast("int").alias("class_id"), F.lit(None).cast("string").alias("name"), "problem")
    return good.unionByName(bad)


def read_class_names(spark: SparkSession, path: str) -> DataFrame:
    return parse_class_names(whole_text(spark, path))


def parse_predictions(files: DataFrame) -> DataFrame:
    """COCO result lists (``path, content``); ``json_index`` keeps the order that breaks ties."""
    kind = "array<struct<image_id:bigint,file_name:string,category_id:int,bbox:array<double>,score:double>>"
    rows = files.select("path", F.posexplode(F.from_json("content", kind)).alias("json_index", "p"))
    x, y, w, h = [F.get("p.bbox", F.lit(i)) for i in range(4)]
    return rows.select(
        "path", "json_index", "p.image_id", "p.file_name", F.col("p.category_id").alias("class_id"), "p.score",
        x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"),
    )


def read_predictions(spark: SparkSession, path: str, texts: Texts = whole_text) -> DataFrame:
    return parse_predictions(texts(spark, path))


def unbound_predictions(pred: DataFrame, images: DataFrame) -> DataFrame:
    """Predictions that name no known image, or another file than their image id does."""
    named = images.select("image_id", F.col("file_name").alias("_file"))
    j = pred.join(named, "image_id", "left")
    problem = F.when(F.col("_file").isNull(), "unknown_image").when(F.col("file_name") != F.col("_file"), "file_mismatch")
    return j.select("path", "json_index", "image_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def trim_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_epoch_log(spark: SparkSession, path: str) -> DataFrame:
    """Training log with padded column names; values are doubles, ``epoch`` an int."""
    rows = trim_header(spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))
    return rows.select(*[F.col(f"`{c}`").cast("int" if c == "epoch" else "double").alias(c) for c in rows.columns])


# fixed values: device names no archive member may use
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL"]


def check_members(members: DataFrame) -> DataFrame:
    """Problems of an archive listing: ``path, problem``.

    ``members``: path, sha256, is_link. Names that differ only in case, or repeat, are accepted
    only with the same spelling and the same bytes.
    """
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    reserved = r"^(?i)(" + "|".join(RESERVED_NAMES) + r"|COM[1-9]|LPT[1-9])(\.|$)"
    unsafe = (
        path.startswith("/") | (F.size(parts) == 0)
        | F.exists(parts, lambda p: (p == "..") | p.contains(":") | p.endswith(".") | p.endswith(" ") | p.rlike(reserved))
    )
    m = members.select("path", F.lower(F.array_join(parts, "/")).alias("_key"), "sha256", "is_link", unsafe.alias("_unsafe"))
    same = m.groupBy("_key").agg(F.count_distinct("sha256").alias("_shas"), F.count_distinct("path").alias("_spellings"))
    j = m.join(same, "_key")
    problem = (
        F.when(F.col("_unsafe"), "unsafe_path").when(F.col("is_link"), "symbolic_link")
        .when((F.col("_shas") > 1) | (F.col("_spellings") > 1), "conflicting_duplicate")
    )
    return j.select("path", problem.alias("problem")).filter(F.col("problem").isNotNull()).distinct()

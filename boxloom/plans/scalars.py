"""Queries on box, text, hash, time and number functions, and on filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions import boxes as bx
from boxloom.functions import hashing as hs
from boxloom.functions import numeric as nm
from boxloom.functions import text as tx
from boxloom.operators import filters as fl
from boxloom.operators import matching as mt
from boxloom.plans.derive import IMAGE_HEIGHT, IMAGE_WIDTH, with_sql
from boxloom.plans.matching import ioa_sql, iou_sql, rounded, suppress_sql
from boxloom.plans.metrics import SIZE_SQL
from boxloom.plans.registry import query

KEY = ["image_id", "gt_index"]
SIDES = ("x1", "y1", "x2", "y2")


def size():
    """Image width and height as columns (a column needs a running session, an import has none)."""
    return F.lit(float(IMAGE_WIDTH)), F.lit(float(IMAGE_HEIGHT))


def r6(df, *names):
    return rounded(df, names, 6)


def r6_sql(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("box1", with_sql("gt") + f""", y AS (SELECT image_id, gt_index, x1, (x1+x2)/(2*{IMAGE_WIDTH}.0::DOUBLE) AS cx, (y1+y2)/(2*{IMAGE_HEIGHT}.0::DOUBLE) AS cy,
  (x2-x1)/{IMAGE_WIDTH}.0::DOUBLE AS w, (y2-y1)/{IMAGE_HEIGHT}.0::DOUBLE AS h FROM gt)
  SELECT image_id, gt_index, {r6_sql('cx', 'cy', 'w', 'h')}, round((cx - w/2)*{IMAGE_WIDTH}, 6) AS x1 FROM y""")
def yolo_both_ways(t):
    y = t.gt().select(*KEY, *[c.alias(n) for n, c in bx.box_to_yolo(bx.box(), *size()).items()])
    back = bx.box_from_yolo(*[F.col(c) for c in ("cx", "cy", "w", "h")], *size())
    return r6(y.select("*", back.x1.alias("x1")), "cx", "cy", "w", "h", "x1")


@query("box2", """SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, l_suppkey - 1) AS x1, greatest(0, l_partkey % 7 - 1) AS y1,
  l_suppkey + 9 AS x2, l_partkey % 7 + 9 AS y2, l_suppkey - 1 < 0 OR l_partkey % 7 - 1 < 0 AS clamped FROM lineitem""")
def voc_corners(t):
    x, y = F.col("l_suppkey"), F.col("l_partkey") % 7
    b = bx.box_from_voc(x, y, x + 9, y + 9)
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", *b.columns(), ((x - 1 < 0) | (y - 1 < 0)).alias("clamped")
    )


@query("box3", with_sql("gt") + """ SELECT image_id, gt_index, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, (x2-x1)*(y2-y1) AS area,
  least(x2-x1, y2-y1) AS short_side FROM gt""")
def sides(t):
    b = bx.box()
    return t.gt().select(
        *KEY, *[c.alias(n) for n, c in bx.box_to_xywh(b).items()], bx.box_area(b).alias("area"),
        bx.box_short_side(b).alias("short_side"),
    )


@query("box4", with_sql("gt") + f" SELECT {SIZE_SQL} AS size_bin, count(*) AS n FROM gt GROUP BY 1")
def size_bins(t):
    return t.gt().groupBy(bx.size_bin(bx.box()).alias("size_bin")).agg(F.count("*").alias("n"))


def neighbours(t):
    """Each truth box beside the next one of its image."""
    from pyspark.sql import Window as W

    w = W.partitionBy("image_id").orderBy("gt_index")
    return t.gt().select(*KEY, *SIDES, *[F.lead(c).over(w).alias("n_" + c) for c in SIDES]).filter("n_x1 IS NOT NULL")


# one pass over the ordered boxes of an image instead of a join
SIDES_SQL = "{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
PAIR_SQL = with_sql("gt") + f", pr AS (SELECT image_id, gt_index, {SIDES_SQL} AS a, lead({SIDES_SQL}) OVER (PARTITION BY image_id ORDER BY gt_index) AS b FROM gt)"


@query("box5", PAIR_SQL + f" SELECT image_id, gt_index, {iou_sql('a', 'b')} AS iou FROM pr WHERE b IS NOT NULL")
def iou(t):
    return neighbours(t).select(*KEY, bx.box_iou(bx.box(), bx.box("n_")).alias("iou"))


@query("box6", PAIR_SQL + f" SELECT image_id, gt_index, {ioa_sql('a', 'b')} AS ioa, {ioa_sql('b', 'a')} AS ioa_other FROM pr WHERE b IS NOT NULL")
def ioa(t):
    a, b = bx.box(), bx.box("n_")
    return neighbours(t).select(*KEY, bx.box_ioa(a, b).alias("ioa"), bx.box_ioa(b, a).alias("ioa_other"))


CLIP_SQL = """CASE WHEN least(x2, 300) > greatest(x1, 50) AND least(y2, 250) > greatest(y1, 40) THEN {} END"""


@query("box7", with_sql("gt") + " SELECT image_id, gt_index, " + ", ".join(
    f"{CLIP_SQL.format(e)} AS {n}" for n, e in (
        ("x1", "greatest(x1, 50)"), ("y1", "greatest(y1, 40)"), ("x2", "least(x2, 300)"), ("y2", "least(y2, 250)"))) + " FROM gt")
def clip(t):
    r = bx.Box(*[F.lit(float(v)) for v in (50, 40, 300, 250)])
    return t.gt().select(*KEY, *bx.box_clip(bx.box(), r).columns())


@query("box8", with_sql("gt") + f""", l AS (SELECT image_id, gt_index, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, least(x2, 256) AS x2, least(y2, 256) AS y2,
    x1 < 256 AND y1 < 256 AS ok FROM gt),
  s AS (SELECT image_id, gt_index, x1 + 200 AS x1, y1 + 100 AS y1, least(x2 + 200, {IMAGE_WIDTH}) AS x2, least(y2 + 100, {IMAGE_HEIGHT}) AS y2, ok FROM l)
  SELECT image_id, gt_index, CASE WHEN ok AND x2 > x1 AND y2 > y1 THEN x1 END AS x1, CASE WHEN ok AND x2 > x1 AND y2 > y1 THEN y1 END AS y1,
    CASE WHEN ok AND x2 > x1 AND y2 > y1 THEN x2 END AS x2, CASE WHEN ok AND x2 > x1 AND y2 > y1 THEN y2 END AS y2 FROM s""")
def restore(t):
    crop = bx.Box(*[F.lit(float(v)) for v in (200, 100, 456, 356)])
    return t.gt().select(*KEY, *bx.restore_box(bx.box(), crop, *size()).columns())


@query("box9", with_sql("gt") + """ SELECT image_id, gt_index, round(greatest(least(x2,300)-greatest(x1,50),0)*greatest(least(y2,250)-greatest(y1,40),0)/((x2-x1)*(y2-y1)), 9) AS fraction FROM gt""")
def fraction(t):
    crop = bx.Box(*[F.lit(float(v)) for v in (50, 40, 300, 250)])
    return rounded(t.gt().select(*KEY, bx.visible_fraction(bx.box(), crop).alias("fraction")), ("fraction",))


@query("box10", with_sql("gt") + f""", n AS (SELECT image_id, gt_index, (x1+x2-2*50)/(2*250.0::DOUBLE) AS cx, (y1+y2-2*40)/(2*210.0::DOUBLE) AS cy,
  (x2-x1)/250.0::DOUBLE AS w, (y2-y1)/210.0::DOUBLE AS h FROM gt) SELECT image_id, gt_index, {r6_sql('cx', 'cy', 'w', 'h')} FROM n""")
def normalised(t):
    crop = bx.Box(*[F.lit(float(v)) for v in (50, 40, 300, 250)])
    parts = bx.normalize_to_crop(bx.box(), crop)
    return r6(t.gt().select(*KEY, *[c.alias(n) for n, c in parts.items()]), *parts)


NEW_W, NEW_H = 199, 156
SCALE_SQL = with_sql("gt") + f""", s AS (SELECT image_id, gt_index, x1 AS ox, x2 AS ox2, least(x1*({NEW_W}/{IMAGE_WIDTH}.0::DOUBLE), {NEW_W}) AS x1, least(y1*({NEW_H}/{IMAGE_HEIGHT}.0::DOUBLE), {NEW_H}) AS y1,
  least(x2*({NEW_W}/{IMAGE_WIDTH}.0::DOUBLE), {NEW_W}) AS x2, least(y2*({NEW_H}/{IMAGE_HEIGHT}.0::DOUBLE), {NEW_H}) AS y2 FROM gt)"""


@query("box11", SCALE_SQL + f""" SELECT image_id, gt_index, {r6_sql('x1', 'y1', 'x2', 'y2')},
  greatest(abs(x1/({NEW_W}/{IMAGE_WIDTH}.0::DOUBLE) - ox), abs(x2/({NEW_W}/{IMAGE_WIDTH}.0::DOUBLE) - ox2)) < 1e-9 AS exact FROM s""")
def scaled(t):
    s = bx.scale_box(bx.box(), *size(), F.lit(NEW_W), F.lit(NEW_H))
    back = bx.scale_box(s, F.lit(float(NEW_W)), F.lit(float(NEW_H)), *size())
    return r6(t.gt().select(*KEY, *s.columns(), (bx.max_difference(back, bx.box()) < 1e-9).alias("exact")), *SIDES)


@query("box12", with_sql("gt") + f""" SELECT DISTINCT image_id, CAST(greatest(0, floor(x1-(x2-x1)*0.1::DOUBLE)) AS INTEGER) AS x1, CAST(greatest(0, floor(y1-(y2-y1)*0.1::DOUBLE)) AS INTEGER) AS y1,
  CAST(least({IMAGE_WIDTH}, ceil(x2+(x2-x1)*0.1::DOUBLE)) AS INTEGER) AS x2, CAST(least({IMAGE_HEIGHT}, ceil(y2+(y2-y1)*0.1::DOUBLE)) AS INTEGER) AS y2 FROM gt""")
def rois(t):
    return t.gt().select("image_id", *bx.expand_roi(bx.box(), 0.1, F.lit(IMAGE_WIDTH), F.lit(IMAGE_HEIGHT)).columns()).distinct()


def centres_sql(stride: int) -> str:
    return " * ".join(
        f"greatest(0, floor({hi}/{stride}.0::DOUBLE - 0.5::DOUBLE) - ceil({lo}/{stride}.0::DOUBLE - 0.5::DOUBLE) + 1)"
        for lo, hi in (("x1", "x2"), ("y1", "y2"))
    )


@query("box13", with_sql("gt") + " SELECT image_id, gt_index, " + ", ".join(
    f"CAST({centres_sql(s)} AS BIGINT) AS centres_{s}" for s in (8, 16, 32)) + " FROM gt")
def centres(t):
    return t.gt().select(*KEY, *[bx.grid_centres(bx.box(), s).alias(f"centres_{s}") for s in (8, 16, 32)])


@query("box14", with_sql("gt") + """ SELECT image_id, gt_index, (x2-x1)*(y2-y1)*0.75 AS area, x1, y1, x2, y2 FROM gt""")
def polygons(t):
    """A box without its lower right quarter: a six-point outline."""
    b = bx.box()
    mx, my = (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2

    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(
        point(b.x1, b.y1), point(b.x2, b.y1), point(b.x2, my), point(mx, my), point(mx, b.y2), point(b.x1, b.y2)
    )
    rows = t.gt().select(*KEY, ring.alias("ring"))
    return rows.select(*KEY, bx.polygon_area(F.col("ring")).alias("area"), *bx.polygon_bounds(F.col("ring")).columns())


@query("box15", PAIR_SQL + """ SELECT image_id, gt_index, (b.x1+b.x2)/2 >= a.x1 AND (b.x1+b.x2)/2 < a.x2 AND (b.y1+b.y2)/2 >= a.y1 AND (b.y1+b.y2)/2 < a.y2 AS holds,
  round(sqrt(((a.x1+a.x2)/2-(b.x1+b.x2)/2)**2 + ((a.y1+a.y2)/2-(b.y1+b.y2)/2)**2), 6) AS distance FROM pr WHERE b IS NOT NULL""")
def containment(t):
    a, b = bx.box(), bx.box("n_")
    return r6(neighbours(t).select(
        *KEY, bx.box_contains(a, b.cx, b.cy).alias("holds"), bx.centre_distance(a, b).alias("distance")
    ), "distance")


@query("box16", with_sql("gt") + """ SELECT image_id, gt_index, list_filter([CASE WHEN gt_index % 11 = 0 THEN 'not_finite' END,
    CASE WHEN gt_index % 11 <> 0 AND x2 - 10 <= x1 THEN 'not_positive' END,
    CASE WHEN gt_index % 11 <> 0 AND (x2 - 10 > 400 OR y2 > 300) THEN 'outside_image' END, CASE WHEN class_id > 2 THEN 'unknown_class' END], lambda p: p IS NOT NULL) AS problems FROM gt""")
def invalid_boxes(t):
    bad = F.when(F.col("gt_index") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("x2") - 10)
    b = bx.Box(F.col("x1"), F.col("y1"), bad, F.col("y2"))
    return t.gt().select(*KEY, bx.box_problems(b, F.lit(400), F.lit(300), F.col("class_id"), 3).alias("problems"))


@query("hsh4", with_sql("codes") + " SELECT a.vec_id, CAST(bit_count(xor(a.code, b.code)) AS INTEGER) AS distance FROM codes a JOIN codes b ON b.vec_id = a.vec_id + 1")
def distances(t):
    c = t.codes()
    nxt = c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("code").alias("other"))
    return c.join(nxt, "vec_id").select("vec_id", hs.hamming(F.col("code"), F.col("other")).alias("distance"))


@query("hsh5", """SELECT o_orderkey, sha256(to_json({'custkey': o_custkey, 'priority': o_orderpriority, 'status': o_orderstatus})) AS fingerprint FROM orders""")
def fingerprints(t):
    cols = {"status": F.col("o_orderstatus"), "custkey": F.col("o_custkey"), "priority": F.col("o_orderpriority")}
    return t.read("orders").select("o_orderkey", hs.fingerprint(cols).alias("fingerprint"))


@query("hsh6", """SELECT p_partkey, 'p_' || substr(sha256(to_json([p_name, CAST(p_partkey AS VARCHAR)])), 1, 20) AS id FROM part""")
def stable_ids(t):
    return t.read("part").select("p_partkey", hs.stable_id("p_", F.col("p_name"), F.col("p_partkey")).alias("id"))


NAME_SQL = """names AS (SELECT doc_id, CASE CAST(substr(source, 4) AS INTEGER) % 4
  WHEN 0 THEN 'rf_embedded_hardware' WHEN 1 THEN 'rf_raspberrypi_vniye' WHEN 2 THEN 'rf_raspberry_pi_dpiwf' ELSE source END AS source,
  'export/' || (['train','Valid','test','misc'])[doc_id % 4 + 1] || '/images/' || CASE CAST(substr(source, 4) AS INTEGER) % 4
    WHEN 0 THEN 'AURIX_' || (doc_id % 7) || '_MOV-' || n_chars || '_jpg'
    WHEN 1 THEN '202301' || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0') || '_1200' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || '_x'
    ELSE 'board-' || (doc_id % 50) || ' top' END || '.rf.' || substr(sha256(text), 1, 10) || '.jpg' AS path FROM documents)"""


def names(t):
    kind = F.substring("source", 4, 8).cast("int") % 4
    folder = F.get(F.array(*[F.lit(x) for x in ("train", "Valid", "test", "misc")]), (F.col("doc_id") % 4).cast("int"))

    def s(c):
        return c.cast("string")

    d = F.col("doc_id")
    base = (
        F.when(kind == 0, F.concat(F.lit("AURIX_"), s(d % 7), F.lit("_MOV-"), s(F.col("n_chars")), F.lit("_jpg")))
        .when(kind == 1, F.concat(F.lit("202301"), F.lpad(s(d % 40), 2, "0"), F.lit("_1200"), F.lpad(s(d % 60), 2, "0"), F.lit("_x")))
        .otherwise(F.concat(F.lit("board-"), s(d % 50), F.lit(" top")))
    )
    source = (
        F.when(kind == 0, tx.VIDEO_SOURCE).when(kind == 1, tx.DAY_SOURCE).when(kind == 2, tx.SCENE_SOURCE)
        .otherwise(F.col("source"))
    )
    path = F.concat(
        F.lit("export/"), folder, F.lit("/images/"), base, F.lit(".rf."), F.substring(F.sha2("text", 256), 1, 10), F.lit(".jpg")
    )
    return t.read("documents").select("doc_id", source.alias("source"), path.alias("path"))


FAMILY_SQL = "regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', ''), '\\.rf\\.[0-9A-Za-z]+$', '')"


@query("str1", f"WITH {NAME_SQL} SELECT doc_id, {FAMILY_SQL} AS family FROM names")
def families(t):
    return names(t).select("doc_id", tx.family_of(F.col("path")).alias("family"))


@query("str2", f"""WITH {NAME_SQL}, f AS (SELECT *, {FAMILY_SQL} AS family FROM names)
SELECT doc_id, CASE source WHEN 'rf_embedded_hardware' THEN source || ':video:' || regexp_extract(family, '^(AURIX_\\d+_MOV)-', 1)
  WHEN 'rf_raspberry_pi_dpiwf' THEN source || ':scene:six_pi_cluster'
  WHEN 'rf_raspberrypi_vniye' THEN CASE WHEN try_strptime(substr(family, 1, 8), '%Y%m%d') IS NOT NULL
    THEN source || ':capture_day:' || CAST(CAST(strptime(substr(family, 1, 8), '%Y%m%d') AS DATE) AS VARCHAR) ELSE source || ':' || family END
  ELSE source || ':' || family END AS group_id,
  CASE WHEN source = 'rf_embedded_hardware' THEN CAST(regexp_extract(family, '-(\\d+)_jpg$', 1) AS INTEGER) END AS frame FROM f""")
def groups_of_names(t):
    return names(t).select(
        "doc_id", tx.capture_group(F.col("source"), F.col("path")).alias("group_id"),
        tx.frame_index(F.col("path")).alias("frame"),
    )


ANNOTATION_SQL = """ann AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '"' || p_name || '" R' || p_partkey WHEN p_size % 3 = 1 THEN p_type ELSE p_type || '  C' || p_size || ' ' END AS name FROM part)"""


@query("str3", f"""WITH {ANNOTATION_SQL} SELECT p_partkey, lower(CASE WHEN name LIKE '"%' THEN split_part(name, '"', 2) ELSE split_part(trim(name), ' ', 1) END) AS kind,
  nullif(trim(CASE WHEN name LIKE '"%' THEN split_part(name, '"', 3) ELSE substr(name, length(split_part(name, ' ', 1)) + 1) END), '') AS refdes FROM ann""")
def annotation_names(t):
    size = F.col("p_size") % 3
    name = (
        F.when(size == 0, F.concat(F.lit('"'), "p_name", F.lit('" R'), F.col("p_partkey").cast("string")))
        .when(size == 1, F.col("p_type"))
        .otherwise(F.concat("p_type", F.lit("  C"), F.col("p_size").cast("string"), F.lit(" ")))
    )
    return t.read("part").select("p_partkey", tx.source_type(name).alias("kind"), tx.source_refdes(name).alias("refdes"))


@query("str4", """SELECT c_custkey, 'Board' || c_nationkey AS board FROM customer""")
def boards(t):
    side = F.when(F.col("c_custkey") % 2 == 0, "_Top").otherwise("_bottom2")
    name = F.concat(F.lit("Board"), F.col("c_nationkey").cast("string"), side)
    return t.read("customer").select("c_custkey", tx.board_group(name).alias("board"))


@query("str5", f"WITH {NAME_SQL} SELECT doc_id, regexp_matches(path, '/board-\\d+ top\\.rf\\.[a-f].*\\.jpg$') AS original FROM names")
def originals(t):
    return names(t).select("doc_id", tx.is_original(F.col("path"), r"/board-\d+ top\.rf\.[a-f].*\.jpg$").alias("original"))


@query("str6", """SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS text FROM pages""")
def page_text(t):
    return t.read("pages").select("page_id", tx.plain_text(F.col("html")).alias("text"))


@query("str6_all")
def page_text_unescaped(t):
    bare = F.regexp_replace("html", r"<[^>]+>", "")
    return t.read("pages").select("page_id", tx.unescape_html(bare).alias("text"))


@query("str7", f"""WITH {NAME_SQL}, s AS (SELECT doc_id, regexp_replace({FAMILY_SQL}, '[^0-9A-Za-z_-]', '_', 'g') AS stem FROM names)
  SELECT lower(stem) AS folded, count(*) AS n, count(DISTINCT stem) AS spellings FROM s GROUP BY 1 HAVING count(*) > 1""")
def stem_collisions(t):
    s = names(t).select(tx.safe_stem(tx.family_of(F.col("path"))).alias("stem"))
    return s.groupBy(F.lower("stem").alias("folded")).agg(
        F.count("*").alias("n"), F.countDistinct("stem").alias("spellings")
    ).filter("n > 1")


ENTRY_SQL = """entries AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'drop' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'ports:' || lower(p_type) ELSE lower(p_type) END AS target,
  CASE WHEN p_size % 7 = 0 THEN 'needs_box' ELSE 'accepted' END AS status FROM part)"""


def entries(t):
    m, kind = F.col("p_size") % 5, F.lower("p_type")
    target = F.when(m == 0, "drop").when(m == 1, "needs_review").when(m == 2, F.concat(F.lit("ports:"), kind)).otherwise(kind)
    return t.read("part").select(
        "p_partkey", target.alias("target"), F.when(F.col("p_size") % 7 == 0, "needs_box").otherwise("accepted").alias("status")
    )


@query("str8", f"""WITH {ENTRY_SQL} SELECT p_partkey, CASE WHEN target = 'drop' THEN 'dropped' WHEN target LIKE 'needs%' OR status LIKE 'needs%' THEN 'pending'
    WHEN target LIKE '%:%' THEN split_part(target, ':', 1) ELSE 'boards' END AS model,
  CASE WHEN target = 'drop' THEN NULL WHEN target LIKE 'needs%' OR status LIKE 'needs%' THEN target WHEN target LIKE '%:%' THEN split_part(target, ':', 2) ELSE target END AS class_name,
  CASE WHEN target = 'drop' THEN 'drop' ELSE status END AS status FROM entries""")
def routed(t):
    parts = tx.route_target(F.col("target"), F.col("status"), F.lit("boards"))
    return entries(t).select("p_partkey", *[c.alias(n) for n, c in parts.items()])


@query("str9", f"WITH {NAME_SQL} SELECT doc_id, CASE WHEN split_part(path, '/', 2) = 'misc' THEN 'unknown' ELSE split_part(path, '/', 2) END AS split FROM names")
def provider(t):
    return names(t).select("doc_id", tx.provider_split(F.col("path")).alias("split"))


@query("str10", with_sql("gt") + """ SELECT image_id, gt_index, CAST(row_number() OVER (PARTITION BY image_id ORDER BY floor(y1 / 40), x1, class_id, gt_index) AS INTEGER) AS position FROM gt""")
def reading(t):
    from pyspark.sql import Window as W

    order = W.partitionBy("image_id").orderBy(*bx.reading_order(bx.box(), F.col("class_id")), "gt_index")
    return t.gt().select(*KEY, F.row_number().over(order).alias("position"))


@query("dat1", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS ts, o_orderkey % 3 <> 0 AS ordered FROM orders""")
def utc_times(t):
    local = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    m = F.col("o_orderkey") % 3
    plus2 = F.date_format(F.expr("o_orderdate + INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(m == 0, local).when(m == 1, F.concat(local, F.lit("Z"))).otherwise(F.concat(plus2, F.lit("+02:00")))
    ts = nm.parse_utc(text)
    return t.read("orders").select("o_orderkey", ts.alias("ts"), F.coalesce(ts <= F.col("o_orderdate"), F.lit(False)).alias("ordered"))


@query("num1", """SELECT doc_id, CASE WHEN quality IS NULL AND toxic IS NULL THEN TRUE WHEN quality IS NULL OR toxic IS NULL THEN FALSE ELSE abs(quality - toxic) <= 0.5 END AS near
  FROM (SELECT d.doc_id, l.quality, CASE WHEN l.toxic = 1 THEN NULL ELSE l.toxic END AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))""")
def close_values(t):
    toxic = F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("toxic"))
    return t.records().select("doc_id", nm.near(F.col("quality"), toxic, 0.5).alias("near"))


@query("num2", """SELECT event_id, NOT (event_type = 'error' OR event_type = 'view') AS finite FROM events""")
def finite_values(t):
    v = (
        F.when(F.col("event_type") == "error", F.lit(float("inf"))).when(F.col("event_type") == "view", F.lit(float("nan")))
        .otherwise(F.col("value"))
    )
    return t.read("events").select("event_id", nm.is_finite(v).alias("finite"))


@query("flt1", f"WITH {NAME_SQL} SELECT doc_id, path FROM names WHERE source = 'rf_embedded_hardware' AND lower({FAMILY_SQL}) LIKE '%aurix_3%'")
def cohort(t):
    rows = names(t).withColumn("group_id", tx.family_of(F.col("path")))
    return fl.select_cohort(rows, source="rf_embedded_hardware", group_contains="Aurix_3").select("doc_id", "path")


@query("flt2", with_sql("records") + """ SELECT CASE WHEN toxic = 1 THEN 'pending_mapping' WHEN lang = 'de' THEN 'draft_annotations'
  WHEN coalesce(quality, 0) <> 1 AND source = 'src1' THEN 'incomplete_annotations' WHEN n_chars < 200 THEN 'no_complete_labels' ELSE 'eligible' END AS skip_reason, count(*) AS n
  FROM records GROUP BY 1""")
def eligibility(t):
    no = F.lit(False)
    why = fl.skip_reason(
        F.coalesce(F.col("toxic") == 1, no), F.col("lang") == "de", F.col("source") == "src1",
        F.coalesce(F.col("quality") == 1, no), F.col("n_chars") >= 200,
    )
    return fl.skip_counts(t.records().withColumn("skip_reason", why))


@query("flt3", """SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')""")
def reviewed(t):
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "Pseudo_labels").when(
        F.col("o_orderpriority") == "5-LOW", "source_DRAFT").otherwise("reviewed")
    return t.read("orders").filter(~fl.unreviewed(F.array(F.lit("reviewed"), status))).select("o_orderkey")


@query("flt4", """SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR p_brand LIKE 'Brand#1%'""")
def licences(t):
    ok = fl.licensed(F.col("p_type"), ["PROMO"], []) | fl.licensed(F.col("p_brand"), [], ["Brand#1"])
    return t.read("part").filter(ok).select("p_partkey")


@query("flt5", with_sql("gt", "images", "excluded") + """ SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM gt WHERE class_id = 3 AND x2 - x1 > 60)""")
def without_class(t):
    wide = t.gt().filter((F.col("x2") - F.col("x1")) > 60)
    return fl.drop_images_with_class(t.images(), wide, [3]).select("image_id")


@query("flt6", with_sql("gt") + """ SELECT image_id, gt_index, CASE class_id WHEN 3 THEN 0 WHEN 0 THEN 1 WHEN 2 THEN 2 END AS class_id,
  ['resistor','capacitor','ic','connector'][class_id + 1] AS name FROM gt WHERE class_id <> 1""")
def reindexed(t):
    def vocabulary(words):
        return t.spark.createDataFrame([(i, w) for i, w in enumerate(words)], "class_id int, name string")

    old, new = vocabulary(["resistor", "capacitor", "ic", "connector"]), vocabulary(["connector", "resistor", "ic"])
    return fl.reindex_classes(t.gt().select(*KEY, "class_id"), old, new)


@query("flt7", with_sql("gt", "pred", recursive=True) + ", " + suppress_sql("0.5", ">", "DOUBLE")
       + " SELECT p.image_id, p.class_id, p.pred_index FROM kept JOIN pred p USING (image_id, class_id, pred_index) WHERE p.score >= 0.65")
def confident(t):
    return fl.at_confidence(mt.nms(t.pred()), 0.65).select("image_id", "class_id", "pred_index")


@query("flt8", with_sql("records") + """ SELECT doc_id, CASE WHEN toxic = 1 OR n_chars < 100 THEN 'excluded' WHEN quality = 1 THEN 'selected' ELSE 'reserve' END AS status,
  CASE WHEN toxic = 1 THEN 'flagged content' WHEN n_chars < 100 THEN 'too short' WHEN quality = 1 THEN 'reviewed' ELSE 'not in the frozen set' END AS reason FROM records""")
def decisions(t):
    rules = [
        ("excluded", "flagged content", F.col("toxic") == 1), ("excluded", "too short", F.col("n_chars") < 100),
        ("selected", "reviewed", F.col("quality") == 1),
    ]
    return fl.decide(t.records(), rules, ("reserve", "not in the frozen set")).select("doc_id", "status", "reason")

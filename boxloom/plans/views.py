"""Queries on splits, tiles, training views, draws and exposures."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.operators import sets as st
from boxloom.operators import splits as sp
from boxloom.operators import views as vw
from boxloom.operators.joins import clip_objects
from boxloom.operators.targets import target_split
from boxloom.plans.derive import IMAGE_HEIGHT, IMAGE_WIDTH, Tables, with_sql
from boxloom.plans.matching import rounded
from boxloom.plans.registry import query
from boxloom.session import cut

# ---------------------------------------------------------------- splits


@query("sp1", """SELECT c_custkey AS group_id, CASE WHEN sha256('boxloom|' || c_custkey) <= 'b333333333333333333333333333333333333333333333333333333333333333' THEN 'train'
  WHEN sha256('boxloom|' || c_custkey) <= 'd999999999999999999999999999999999999999999999999999999999999999' THEN 'val' ELSE 'test' END AS split FROM customer""")
def hashed(t):
    return sp.hash_split(t.read("customer").select(F.col("c_custkey").alias("group_id")))


GROUPS_SQL = """g AS (SELECT {stratum} AS stratum, c_custkey AS group_id, count(*) AS size{more} FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


def customer_groups(t: Tables, stratum, *more):
    c, o = t.read("customer"), t.read("orders")
    return c.join(o, c.c_custkey == o.o_custkey).groupBy(
        stratum.alias("stratum"), F.col("c_custkey").alias("group_id"), *more
    ).agg(F.count("*").alias("size"))


def greedy_split_sql(shares: dict[str, float], level: str) -> str:
    """Sequential filling as a recursive table ``w``; needs ``free`` (stratum, group_id, size)."""
    d = {n: level.format(s=f"{s}::DOUBLE", f=f"w.f_{n}") for n, s in shares.items()}
    pick = (f"CASE WHEN {d['train']} >= {d['val']} AND {d['train']} >= {d['test']} THEN 'train' "
            f"WHEN {d['val']} >= {d['test']} THEN 'val' ELSE 'test' END")
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY size DESC, md5('42|' || group_id), group_id) AS r,
    sum(size) OVER (PARTITION BY stratum) AS tot FROM free),
w AS (
  SELECT stratum, 0::BIGINT AS r, CAST(NULL AS BIGINT) AS group_id, 0::BIGINT AS size, '' AS split, 0::BIGINT AS f_train, 0::BIGINT AS f_val, 0::BIGINT AS f_test
  FROM (SELECT DISTINCT stratum FROM r)
  UNION ALL
  SELECT stratum, r, group_id, size, split, f_train + (split = 'train')::INT * size, f_val + (split = 'val')::INT * size, f_test + (split = 'test')::INT * size
  FROM (SELECT r.stratum, r.r, r.group_id, r.size, w.f_train, w.f_val, w.f_test, {pick} AS split
        FROM w JOIN r ON r.stratum = w.stratum AND r.r = w.r + 1)),
placed AS (SELECT stratum, group_id, size, split FROM w WHERE r > 0)"""


@query("sp2", "WITH RECURSIVE " + GROUPS_SQL.format(stratum="c_mktsegment || c_nationkey", more="") + ", free AS (SELECT * FROM g), "
       + greedy_split_sql(dict(sp.STRATIFIED_SHARES), "({s} * r.tot - {f})") + """,
n AS (SELECT stratum, count(*) AS n, count(*) FILTER (split = 'val') AS v, count(*) FILTER (split = 'test') AS t FROM placed GROUP BY stratum),
d AS (SELECT p.group_id, v, t, row_number() OVER (PARTITION BY p.stratum ORDER BY size, md5('42|' || group_id), group_id) AS k FROM placed p JOIN n USING (stratum)
  WHERE split = 'train' AND n >= 3 AND (v = 0 OR t = 0))
SELECT p.group_id, p.stratum, p.size, CASE WHEN d.k = 1 THEN CASE WHEN d.v = 0 THEN 'val' ELSE 'test' END WHEN d.k = 2 AND d.v = 0 AND d.t = 0 THEN 'test' ELSE p.split END AS split
FROM placed p LEFT JOIN d USING (group_id)""")
def stratified(t):
    stratum = F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))
    return sp.stratified_split(customer_groups(t, stratum))


@query("sp3", "WITH RECURSIVE " + GROUPS_SQL.format(
    stratum="CASE WHEN c_nationkey % 3 = 0 THEN 'positive' ELSE 'negative' END", more=", CASE WHEN c_acctbal < 0 THEN 'test' END AS anchor")
       + ", free AS (SELECT * FROM g WHERE anchor IS NULL), "
       + greedy_split_sql(dict(sp.DEFICIT_SHARES), "(({s} * r.tot - {f}) / greatest({s} * r.tot, 1))")
       + " SELECT group_id, stratum, size, split FROM placed UNION ALL SELECT group_id, stratum, size, anchor FROM g WHERE anchor IS NOT NULL")
def deficit(t):
    stratum = F.when(F.col("c_nationkey") % 3 == 0, "positive").otherwise("negative")
    anchor = F.when(F.col("c_acctbal") < 0, "test").alias("anchor")
    return sp.deficit_split(customer_groups(t, stratum, anchor))


FEATURE_SQL = """f AS (SELECT c_nationkey AS group_id, c_mktsegment AS feature, count(*) AS value FROM customer GROUP BY ALL
  UNION ALL SELECT c_nationkey, 'images', count(*) FROM customer GROUP BY ALL)"""


def nation_features(t: Tables):
    c = t.read("customer").withColumnRenamed("c_nationkey", "group_id")
    return c.groupBy("group_id", F.col("c_mktsegment").alias("feature")).agg(F.count("*").alias("value")).unionByName(
        c.groupBy("group_id", F.lit("images").alias("feature")).agg(F.count("*").alias("value"))
    )


@query("sp4", f"""WITH {FEATURE_SQL}, n AS (SELECT count(DISTINCT group_id) AS n FROM f),
p AS (SELECT trial, group_id, row_number() OVER (PARTITION BY trial ORDER BY md5('42|' || trial || '|' || group_id), group_id) AS rn FROM (SELECT DISTINCT group_id FROM f), range(0, 2000) r(trial)),
s AS (SELECT trial, group_id, CASE WHEN rn <= floor(n * 0.70::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM p, n),
c AS (SELECT trial, feature, coalesce(sum(value) FILTER (split = 'train'), 0)::BIGINT AS a, coalesce(sum(value) FILTER (split = 'val'), 0)::BIGINT AS b,
  coalesce(sum(value) FILTER (split = 'test'), 0)::BIGINT AS c, sum(value)::BIGINT AS t FROM s JOIN f USING (group_id) GROUP BY ALL),
k AS (SELECT trial, round(avg((((a - t*0.70::DOUBLE)/greatest(t*0.70::DOUBLE, 1))**2 + ((b - t*0.15::DOUBLE)/greatest(t*0.15::DOUBLE, 1))**2 + ((c - t*0.15::DOUBLE)/greatest(t*0.15::DOUBLE, 1))**2) / 3), 9) AS cost,
  bool_or(feature <> 'images' AND least(a, b, c) < 5) AS low FROM c GROUP BY trial),
best AS (SELECT trial, cost FROM k WHERE NOT low ORDER BY cost, trial LIMIT 1)
SELECT s.trial, group_id, split, cost FROM s JOIN best USING (trial)""")
def searched(t):
    return sp.search_split(nation_features(t), 2000)


@query("sp5", """WITH v AS (SELECT c_nationkey AS g, c_mktsegment AS class_id, count(*) AS value FROM customer GROUP BY ALL),
tot AS (SELECT class_id, sum(value) AS total FROM v GROUP BY class_id), gs AS (SELECT DISTINCT g FROM v),
cmb AS (SELECT a.g AS a, b.g AS b, c.g AS c, d.g AS d FROM gs a JOIN gs b ON a.g < b.g JOIN gs c ON b.g < c.g JOIN gs d ON c.g < d.g),
m AS (SELECT a, b, c, d, unnest([a, b, c, d]) AS g FROM cmb),
sh AS (SELECT a, b, c, d, class_id, sum(value) / any_value(total)::DOUBLE AS share FROM m JOIN v USING (g) JOIN tot USING (class_id) GROUP BY ALL),
sc AS (SELECT a, b, c, d, round(avg(abs(share - 0.25::DOUBLE)), 12) AS dev FROM sh GROUP BY ALL HAVING min(share) >= 0.12 AND max(share) <= 0.45 AND count(*) = (SELECT count(*) FROM tot)),
best AS (SELECT * FROM sc ORDER BY dev, a, b, c, d LIMIT 1)
SELECT unnest([a, b, c, d]) AS group_id, dev AS deviation, (SELECT count(*) FROM sc) AS eligible FROM best""")
def chosen(t):
    f = nation_features(t).filter("feature <> 'images'").withColumnRenamed("feature", "class_id")
    return sp.choose_groups(f, 4)


TARGETS_SQL = """n AS (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey),
tg AS (SELECT n * 6 // 10 AS tr, n * 2 // 10 AS va, n * 15 // 100 AS te, n - n * 6 // 10 - n * 2 // 10 - n * 15 // 100 AS ex FROM n)"""


@query("sp6", f"""WITH {TARGETS_SQL}, s AS (SELECT unnest(['train', 'val', 'test', 'excluded']) AS split, unnest([tr, va, te, ex]) AS target FROM tg)
  SELECT split, target, target AS images, 0 AS missed, 0 AS short_classes, CASE WHEN split = 'test' THEN (SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 41 = 7) ELSE 0 END AS pinned
  FROM s""")
def targeted(t):
    """Orders are images, customers groups and priorities classes; customers of one residue are pinned to test."""
    o = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    anchor = F.when(F.col("group_id") % 41 == 7, "test")
    g = o.groupBy(F.col("o_custkey").alias("group_id")).agg(F.count("*").alias("size")).withColumn("anchor", anchor)
    n = o.count()
    targets = {"train": n * 6 // 10, "val": n * 2 // 10, "test": n * 15 // 100}
    targets["excluded"] = n - sum(targets.values())
    members = o.select(F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("class_id")).distinct()
    minimum = {"train": 3, "val": 2, "test": 2}
    placed = target_split(g, targets, minimum, members).select("group_id", "size", "split")
    wanted = [(k, v, minimum.get(k, 0)) for k, v in targets.items()]
    asked = t.spark.createDataFrame(wanted, "split string, target long, least int")
    groups = placed.join(g.select("group_id", "anchor"), "group_id").groupBy("split").agg(F.sum("size").alias("images"), F.count_if(F.expr("anchor = split")).alias("pinned"))
    shown = placed.join(members, "group_id").groupBy("split", "class_id").agg(F.count("*").alias("n"))
    every = asked.join(members.select("class_id").distinct(), F.lit(True)).join(shown, ["split", "class_id"], "left")
    short = every.groupBy("split").agg(F.count_if(F.coalesce("n", F.lit(0)) < F.col("least")).alias("short_classes"))
    return asked.join(groups, "split", "left").join(short, "split").select(
        "split", "target", "images", F.abs(F.col("images") - F.col("target")).alias("missed"), "short_classes", "pinned"
    )


@query("sp7", """WITH r AS (SELECT c_custkey AS group_id, row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) AS rn FROM customer WHERE c_custkey <> 11)
  SELECT group_id, CASE WHEN rn <= 100 THEN 'train' WHEN rn <= 130 THEN 'val' ELSE 'test' END AS split FROM r UNION ALL SELECT 11, 'held_out'""")
def counted(t):
    groups = t.read("customer").select(F.col("c_custkey").alias("group_id"))
    return sp.counted_split(groups, {"train": 100, "val": 30, "test": 10**12}, 11)


@query("sp8", """SELECT count(DISTINCT split) AS splits, count(DISTINCT split) = 3 AS accepted FROM (SELECT CASE WHEN sha256('boxloom|' || c_custkey) <= 'b333333333333333333333333333333333333333333333333333333333333333' THEN 'train'
  WHEN sha256('boxloom|' || c_custkey) <= 'd999999999999999999999999999999999999999999999999999999999999999' THEN 'val' ELSE 'test' END AS split FROM customer)""")
def accepted(t):
    return sp.assert_splits(hashed(t))


# ---------------------------------------------------------------- views

TILE, CONTEXT = 128, 256


def starts_sql(length: int, size: int) -> str:
    return f"(SELECT unnest(list_distinct(list_append(range(0, {length - size} + 1, {int(size * 0.8)}), {length - size}))) AS v)"


def tiles_sql(size: int) -> str:
    xs, ys = starts_sql(IMAGE_WIDTH, size), starts_sql(IMAGE_HEIGHT, size)
    return f"""(SELECT i.image_id, i.width, i.height, i.group_id, i.split, CAST(x.v AS INTEGER) AS x1, CAST(y.v AS INTEGER) AS y1, CAST(x.v + {size} AS INTEGER) AS x2, CAST(y.v + {size} AS INTEGER) AS y2
  FROM images i, {xs} x, {ys} y)"""


@query("vw1", with_sql("images") + f" SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y1, x1) - 1 AS INTEGER) AS tile, x1, y1, x2, y2 FROM {tiles_sql(TILE)}")
def tiling(t):
    return vw.tiles(t.images(), TILE).select("image_id", "tile", "x1", "y1", "x2", "y2")


@query("vw1_roi", with_sql("images") + f""", r AS (SELECT image_id, CASE WHEN image_id % 5 = 0 THEN 0 ELSE (image_id % 100)::INT END AS a, CASE WHEN image_id % 5 = 0 THEN 0 ELSE (image_id % 70)::INT END AS b,
    CASE WHEN image_id % 5 = 0 THEN {IMAGE_WIDTH} ELSE least({IMAGE_WIDTH}, (image_id % 100 + 40 + image_id % 300)::INT) END AS c,
    CASE WHEN image_id % 5 = 0 THEN {IMAGE_HEIGHT} ELSE least({IMAGE_HEIGHT}, (image_id % 70 + 30 + image_id % 400)::INT) END AS d FROM images),
  s AS (SELECT *, least(c - a, 160) AS w, least(d - b, 96) AS h FROM r),
  t AS (SELECT image_id, a, b, w, h, unnest(list_sort(list_distinct(list_append(range(0, c - a - w + 1, greatest(1, floor(w * 0.75)::INT)), c - a - w)))) AS x,
    list_sort(list_distinct(list_append(range(0, d - b - h + 1, greatest(1, floor(h * 0.75)::INT)), d - b - h))) AS ys FROM s)
  SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS INTEGER) AS tile, CAST(a + x AS INTEGER) AS x1, CAST(b + y AS INTEGER) AS y1, CAST(a + x + w AS INTEGER) AS x2, CAST(b + y + h AS INTEGER) AS y2
  FROM (SELECT *, unnest(ys) AS y FROM t)""")
def tiling_of_regions(t):
    """Tiles of 96 x 160 pixels over a region of most images, and over all of every fifth."""
    i = F.col("image_id")
    corner = F.struct((i % 100).alias("x1"), (i % 70).alias("y1"), (i % 100 + 40 + i % 300).alias("x2"), (i % 70 + 30 + i % 400).alias("y2"))
    images = t.images().withColumn("roi", F.when(i % 5 != 0, corner))
    return vw.tiles(images, (96, 160), 0.25, "roi").select("image_id", "tile", "x1", "y1", "x2", "y2")


@query("vw2", with_sql("images") + f" SELECT image_id, {TILE} AS size, x1, y1, x2, y2 FROM {tiles_sql(TILE)} UNION ALL SELECT image_id, {CONTEXT}, x1, y1, x2, y2 FROM {tiles_sql(CONTEXT)}")
def plan(t):
    return vw.tile_plan(t.images(), [TILE, CONTEXT]).select("image_id", "size", "x1", "y1", "x2", "y2")


FRACTION_SQL = "(greatest(least(o.x2,c.x2)-greatest(o.x1,c.x1),0)*greatest(least(o.y2,c.y2)-greatest(o.y1,c.y1),0)/((o.x2-o.x1)*(o.y2-o.y1)))"


@query("jn4", with_sql("gt", "images") + f""", c AS (SELECT * FROM {tiles_sql(TILE)})
  SELECT o.image_id, o.gt_index AS instance_id, c.x1 || '_' || c.y1 AS view_id, round({FRACTION_SQL}, 9) AS visible_fraction, greatest(o.x1, c.x1) AS x1, greatest(o.y1, c.y1) AS y1,
    least(o.x2, c.x2) AS x2, least(o.y2, c.y2) AS y2 FROM gt o JOIN c ON o.image_id = c.image_id AND {FRACTION_SQL} > 0""")
def clipped(t):
    crops = vw.tiles(t.images(), TILE).select(
        "image_id", F.concat_ws("_", "x1", "y1").alias("view_id"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    )
    rows = clip_objects(crops, t.gt().select("image_id", F.col("gt_index").alias("instance_id"), "x1", "y1", "x2", "y2"))
    return rounded(rows.select("image_id", "instance_id", "view_id", "visible_fraction", "x1", "y1", "x2", "y2"), ("visible_fraction",))


def instances(t: Tables):
    ident = F.concat_ws(".", F.col("image_id").cast("string"), F.col("gt_index").cast("string"))
    return t.gt().select("image_id", ident.alias("instance_id"), "gt_index", "class_id", "x1", "y1", "x2", "y2")


def view_rows(t: Tables, objects=None):
    return cut(vw.make_views(t.images(), instances(t) if objects is None else objects, TILE, CONTEXT, [3], "gt_index"))


# the objects of an image one after the other, with the crops made so far
VIEW_SQL = with_sql("gt", "images", "excluded", recursive=True) + f""", inst AS (SELECT image_id, image_id || '.' || gt_index AS instance_id, gt_index, class_id, x1, y1, x2, y2 FROM gt),
grid AS (SELECT *, 0 AS k FROM {tiles_sql(TILE)} UNION ALL SELECT *, 1 FROM {tiles_sql(CONTEXT)}),
full_ AS (SELECT DISTINCT o.instance_id FROM inst o JOIN grid c ON o.image_id = c.image_id AND o.x1 >= c.x1 AND o.y1 >= c.y1 AND o.x2 <= c.x2 AND o.y2 <= c.y2),
side AS (SELECT *, CAST(greatest({TILE}, ceil(greatest(x2-x1, y2-y1)*1.1::DOUBLE/32)*32) AS INTEGER) AS s FROM inst),
obj AS (SELECT o.image_id, o.x1, o.y1, o.x2, o.y2, o.class_id = 3 AS always, o.instance_id IN (SELECT instance_id FROM full_) AS shown,
    row_number() OVER (PARTITION BY o.image_id ORDER BY o.gt_index) AS r,
    {{'x1': least(greatest(CAST(trunc((o.x1+o.x2-least(s, i.width))/2) AS INTEGER), 0), i.width - least(s, i.width)),
      'y1': least(greatest(CAST(trunc((o.y1+o.y2-least(s, i.height))/2) AS INTEGER), 0), i.height - least(s, i.height)), 'w': least(s, i.width), 'h': least(s, i.height)}} AS c
  FROM side o JOIN images i USING (image_id)),
walk AS (SELECT image_id, 0::BIGINT AS r, list_slice([any_value(c)], 2, 1) AS crops FROM obj GROUP BY image_id
  UNION ALL
  SELECT o.image_id, o.r, CASE WHEN o.always OR (NOT o.shown AND len(list_filter(w.crops, lambda p:
      greatest(least(o.x2, p.x1 + p.w) - greatest(o.x1, p.x1), 0) * greatest(least(o.y2, p.y1 + p.h) - greatest(o.y1, p.y1), 0) / ((o.x2 - o.x1) * (o.y2 - o.y1)) >= 1 - 1e-12::DOUBLE)) = 0)
    THEN list_append(w.crops, o.c) ELSE w.crops END
  FROM walk w JOIN obj o ON o.image_id = w.image_id AND o.r = w.r + 1),
cen AS (SELECT image_id, i.group_id, p.x1, p.y1, p.w, p.h FROM (SELECT image_id, unnest(arg_max(crops, r)) AS p FROM walk GROUP BY image_id) JOIN images i USING (image_id)),
every AS (SELECT image_id, group_id, x1, y1, x2, y2, k FROM grid UNION ALL SELECT image_id, group_id, x1, y1, x1 + w, y1 + h, 2 FROM cen),
views AS (SELECT concat_ws('_', image_id, x1, y1, x2, y2) AS view_id, image_id, group_id, ['native','context','object_centered'][min(k) + 1] AS kind, x1, y1, x2, y2
  FROM every GROUP BY image_id, group_id, x1, y1, x2, y2),
tgt AS (SELECT c.view_id, c.group_id, o.instance_id, o.class_id, {FRACTION_SQL} AS visible_fraction,
    CASE WHEN {FRACTION_SQL} < 0.5 THEN 'ignore' ELSE 'target' END AS role, CASE WHEN {FRACTION_SQL} < 0.5 THEN 'target_fragment_lt50' END AS reason,
    greatest(o.x1, c.x1) AS a, greatest(o.y1, c.y1) AS b, least(o.x2, c.x2) AS c_, least(o.y2, c.y2) AS d, c.x1 AS vx, c.y1 AS vy, c.x2 - c.x1 AS width, c.y2 - c.y1 AS height
  FROM inst o JOIN views c ON o.image_id = c.image_id AND {FRACTION_SQL} > 0
  UNION ALL
  SELECT c.view_id, c.group_id, 'x' || o.source_index, NULL, {FRACTION_SQL}, 'ignore', 'source_unknown',
    greatest(o.x1, c.x1), greatest(o.y1, c.y1), least(o.x2, c.x2), least(o.y2, c.y2), c.x1, c.y1, c.x2 - c.x1, c.y2 - c.y1
  FROM excluded o JOIN views c ON o.image_id = c.image_id AND o.source_type = 'unknown' AND {FRACTION_SQL} > 0),
routed AS (SELECT view_id, group_id, instance_id, class_id, visible_fraction, role, reason, (a + c_ - 2*vx)/(2.0::DOUBLE*width) AS cx, (b + d - 2*vy)/(2.0::DOUBLE*height) AS cy,
  (c_ - a)/width::DOUBLE AS w, (d - b)/height::DOUBLE AS h, width, height FROM tgt)"""


@query("vw3", VIEW_SQL + " SELECT view_id, image_id, kind FROM views")
def made(t):
    return view_rows(t).select("view_id", "image_id", "kind")


def routed(t: Tables, views=None, objects=None):
    objects = instances(t) if objects is None else objects
    return vw.route_targets(view_rows(t, objects) if views is None else views, objects, t.excluded())


def prepared(t: Tables, columns: tuple[str, ...] = (), rows: str = "TRUE"):
    """Views, the ``columns`` of their routed objects (of the ``rows`` asked for) and the draws, each made once.

    Without ``columns`` the routed objects serve the weights alone and are not written.
    """
    objects = cut(instances(t))
    views = view_rows(t, objects)
    parts = routed(t, views, objects)
    if columns:
        preferred = "role = 'target' AND class_id = 2"  # the weights need these
        parts = cut(parts.filter(f"({rows}) OR ({preferred})").select(*dict.fromkeys(["view_id", "role", "class_id", *columns])))
    draws = cut(vw.weighted_draws(vw.sampling_weight(views, parts.filter("role = 'target'"), [2]), N_DRAWS, 7))
    return views, parts.filter(rows) if columns else None, draws


@query("vw4", VIEW_SQL + " SELECT view_id, instance_id, role, reason, round(visible_fraction, 6) AS visible_fraction, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM routed")
def targets(t):
    rows = routed(t).select("view_id", "instance_id", "role", "reason", "visible_fraction", "cx", "cy", "w", "h")
    return rounded(rows, ("visible_fraction", "cx", "cy", "w", "h"), 6)


@query("vw5", VIEW_SQL + """, big AS (SELECT * FROM inst WHERE class_id = 1)
  SELECT v.view_id, count(o.instance_id) AS labels, count(*) FILTER (o.vf < 1 - 1e-12) AS clipped FROM views v LEFT JOIN
  (SELECT c.view_id, o.instance_id, """ + FRACTION_SQL + " AS vf FROM big o JOIN views c ON o.image_id = c.image_id AND " + FRACTION_SQL + " > 0) o ON o.view_id = v.view_id GROUP BY v.view_id")
def labels(t):
    rows = vw.tile_labels(view_rows(t), instances(t).filter("class_id = 1"))
    return rows.groupBy("view_id").agg(F.count("instance_id").alias("labels"), F.count_if("clipped").alias("clipped"))


WEIGHT_SQL = VIEW_SQL + """, pr AS (SELECT v.view_id, v.group_id, v.kind, CASE WHEN v.view_id IN (SELECT view_id FROM routed WHERE role = 'target' AND class_id IN (2)) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS priority FROM views v),
wt AS (SELECT *, priority / sum(priority) OVER (PARTITION BY group_id) AS sampling_weight FROM pr)"""


def weighted(t: Tables):
    objects = cut(instances(t))
    views = view_rows(t, objects)
    return vw.sampling_weight(views, routed(t, views, objects).filter("role = 'target'"), [2])


@query("vw6", WEIGHT_SQL + " SELECT view_id, priority, round(sampling_weight, 12) AS sampling_weight FROM wt")
def weights(t):
    return rounded(weighted(t).select("view_id", "priority", "sampling_weight"), ("sampling_weight",), 12)


N_DRAWS = 20000
DRAW_SQL = WEIGHT_SQL + f""", cum AS (SELECT view_id, sum(sampling_weight) OVER (ORDER BY view_id ROWS UNBOUNDED PRECEDING) AS hi, sampling_weight FROM wt),
tot AS (SELECT max(hi) AS total FROM cum),
u AS (SELECT ('0x' || substr(md5('7|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM range(0, {N_DRAWS}) r(i)),
draws AS (SELECT view_id, count(*) AS n FROM u ASOF JOIN (SELECT view_id, (hi - sampling_weight) / total AS lo FROM cum, tot) c ON u.u >= c.lo GROUP BY view_id)"""


@query("vw7", DRAW_SQL + " SELECT view_id, n FROM draws")
def draws(t):
    return vw.weighted_draws(weighted(t), N_DRAWS, 7)


@query("ag18", DRAW_SQL + """ SELECT class_id, role, reason, count(*) AS stored, CAST(sum(coalesce(n, 0)) AS BIGINT) AS exposures,
  count(DISTINCT CASE WHEN n > 0 THEN instance_id END) AS instances_seen, count(DISTINCT CASE WHEN n > 0 AND visible_fraction >= 1 - 1e-12 THEN instance_id END) AS instances_complete
  FROM routed LEFT JOIN draws USING (view_id) GROUP BY class_id, role, reason""")
def exposure(t):
    _, parts, draws = prepared(t, ("instance_id", "visible_fraction", "reason"))
    return vw.exposures(draws, parts, ["class_id", "role", "reason"])


@query("ag19", DRAW_SQL + """ SELECT count(*) AS drawn_views, CAST(sum(n) AS BIGINT) AS draws, round(sum(n)*sum(n)/sum(n*n)::DOUBLE, 6) AS effective_views, max(n) AS max_draws,
  list_sort(list(n), 'DESC')[count(*)//2 + 1] AS median_draws, min(n) AS min_draws, round(max(n)/sum(n)::DOUBLE, 9) AS top_view_share,
  round((SELECT sum(n) FROM (SELECT sum(n) AS n FROM draws JOIN views USING (view_id) GROUP BY group_id ORDER BY n DESC LIMIT 3))/sum(n)::DOUBLE, 9) AS top3_group_share FROM draws""")
def concentrated(t):
    views, _, draws = prepared(t)
    rows = vw.concentration(draws, views)
    return rounded(rounded(rows, ("effective_views",), 6), ("top_view_share", "top3_group_share"))


def _centres(lo: str, hi: str, s: int) -> str:
    return f"greatest(0, floor({hi}/{s}.0::DOUBLE - 0.5::DOUBLE) - ceil({lo}/{s}.0::DOUBLE - 0.5::DOUBLE) + 1)"


@query("vw8", DRAW_SQL + """, lb AS (SELECT *, least(1024/height::DOUBLE, 1024/width::DOUBLE) AS r FROM routed WHERE role = 'ignore'),
  off AS (SELECT *, round_even((1024 - round_even(width*r, 0))/2 - 0.1::DOUBLE, 0) AS dx, round_even((1024 - round_even(height*r, 0))/2 - 0.1::DOUBLE, 0) AS dy FROM lb),
  bx AS (SELECT view_id, reason, (cx-w/2)*(width*r)+dx AS x1, (cy-h/2)*(height*r)+dy AS y1, (cx+w/2)*(width*r)+dx AS x2, (cy+h/2)*(height*r)+dy AS y2 FROM off),
  em AS (SELECT view_id, reason, (""" + " + ".join(f"{_centres('x1', 'x2', s)}*{_centres('y1', 'y2', s)}" for s in (8, 16, 32)) + """ = 0)::INT AS e FROM bx)
  SELECT reason, count(*) AS regions, CAST(sum(e) AS BIGINT) AS without_centre, CAST(sum(coalesce(n, 0)) AS BIGINT) AS exposures, CAST(sum(coalesce(n, 0)*e) AS BIGINT) AS exposures_without_centre
  FROM em LEFT JOIN draws USING (view_id) GROUP BY reason""")
def coverage(t):
    _, parts, draws = prepared(t, ("reason", "cx", "cy", "w", "h", "width", "height"), "role = 'ignore'")
    return vw.ignore_coverage(draws, parts)


@query("vw9", with_sql("gt") + """, s AS (SELECT image_id, gt_index, x1*(162/464.0::DOUBLE) AS x1, y1*(127/364.0::DOUBLE) AS y1, x2*(162/464.0::DOUBLE) AS x2, y2*(127/364.0::DOUBLE) AS y2 FROM gt)
  SELECT image_id, gt_index, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, 162 AS width, 127 AS height, TRUE AS exact FROM s""")
def rescaled(t):
    rows = vw.rescale_dataset(t.images(), t.gt().select("image_id", "gt_index", "x1", "y1", "x2", "y2"), 0.35)
    rows = rows.withColumn("exact", F.col("round_trip_error") < 1e-9).drop("round_trip_error")
    return rounded(rows, ("x1", "y1", "x2", "y2"), 6)


@query("vw10", """WITH f AS (SELECT event_type AS code, user_id AS condition, event_id AS frame FROM events),
  c AS (SELECT code, condition, row_number() OVER (PARTITION BY code ORDER BY md5('s|' || code || '|' || condition), condition) AS k FROM (SELECT DISTINCT code, condition FROM f)),
  r AS (SELECT f.*, row_number() OVER (PARTITION BY f.code, f.condition ORDER BY md5('s|' || frame), frame) AS j FROM f JOIN c ON c.code = f.code AND c.condition = f.condition WHERE k <= 20)
  SELECT code, condition, frame FROM r WHERE j <= 5""")
def conditions(t):
    f = t.read("events").select(F.col("event_type").alias("code"), F.col("user_id").alias("condition"), F.col("event_id").alias("frame"))
    return vw.sample_conditions(f, "s").select("code", "condition", "frame")


@query("vw11", with_sql("images") + f""", coh AS (SELECT *, CASE WHEN group_id = 3 THEN 'pi_test' ELSE split END AS cohort FROM images),
  tl AS (SELECT image_id, group_id, row_number() OVER (PARTITION BY image_id ORDER BY y1, x1) - 1 AS tile FROM {tiles_sql(TILE)} t WHERE image_id IN (SELECT image_id FROM coh WHERE cohort = 'train'))
  SELECT CAST(image_id AS VARCHAR) AS row_id, image_id, group_id, CASE cohort WHEN 'pi_test' THEN 'test' ELSE cohort END AS split, cohort, 'native' AS form FROM coh WHERE cohort <> 'train'
  UNION ALL SELECT image_id || '__' || lpad(CAST(tile AS VARCHAR), 4, '0'), image_id, group_id, 'train', 'train', 'tile' FROM tl""")
def manifest(t):
    images = t.images().withColumn("cohort", F.when(F.col("group_id") == 3, "pi_test").otherwise(F.col("split")))
    return vw.training_manifest(images, vw.tiles(images.filter("cohort = 'train'"), TILE))


@query("set3", VIEW_SQL + """, seen AS (SELECT instance_id, max(visible_fraction) AS best FROM routed r JOIN views v USING (view_id) WHERE role = 'target' AND kind = 'native' GROUP BY 1)
  SELECT i.instance_id, CASE WHEN best IS NULL THEN 'never_seen' ELSE 'never_complete' END AS problem FROM inst i LEFT JOIN seen USING (instance_id) WHERE best IS NULL OR best < 1 - 1e-12""")
def not_covered(t):
    views = view_rows(t).filter("kind = 'native'")
    shown = vw.route_targets(views, instances(t), t.excluded()).filter("role = 'target'")
    return st.uncovered(instances(t), shown)


@query("ag31", DRAW_SQL + """ SELECT class_id, o.original, s.stored, s.exposures FROM (SELECT class_id, count(*) AS original FROM gt GROUP BY 1) o
  JOIN (SELECT class_id, count(*) AS stored, CAST(sum(coalesce(n, 0)) AS BIGINT) AS exposures FROM routed LEFT JOIN draws USING (view_id) WHERE role = 'target' GROUP BY 1) s USING (class_id)""")
def ledger(t):
    _, parts, draws = prepared(t, ("instance_id", "visible_fraction"), "role = 'target'")
    return vw.label_ledger(t.gt(), parts, draws)


@query("ag31_groups", DRAW_SQL + """ SELECT group_id, count(*) AS views, CAST(sum(coalesce(n, 0)) AS BIGINT) AS draws, round(sum(coalesce(n, 0)) / (SELECT sum(n) FROM draws)::DOUBLE, 9) AS share,
  round(1.0::DOUBLE / (SELECT count(DISTINCT group_id) FROM views), 9) AS expected FROM views LEFT JOIN draws USING (view_id) GROUP BY group_id""")
def groups(t):
    views, _, draws = prepared(t)
    return rounded(vw.group_ledger(draws, views), ("share", "expected"))

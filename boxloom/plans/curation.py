"""Queries on joins, similarity, components, sets, ranking and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxloom.functions.hashing import rotate_left
from boxloom.operators import components as gr
from boxloom.operators import joins as jn
from boxloom.operators import selection as wn
from boxloom.operators import sets as st
from boxloom.operators import similarity as sim
from boxloom.plans.derive import CODE_BITS, COPY, Tables, bit_sql, with_sql
from boxloom.plans.matching import rounded
from boxloom.plans.registry import query

# ---------------------------------------------------------------- joins


@query("jn1", """WITH i AS (SELECT o_custkey AS stem, 'i' || o_orderkey AS path FROM orders WHERE o_orderstatus = 'F'),
l AS (SELECT o_custkey AS stem, 'l' || o_orderkey AS path FROM orders WHERE o_orderstatus = 'O'),
a AS (SELECT stem, count(*) AS images, min(path) AS image FROM i GROUP BY 1), b AS (SELECT stem, count(*) AS labels, min(path) AS label FROM l GROUP BY 1)
SELECT coalesce(a.stem, b.stem) AS stem, coalesce(images, 0) AS images, coalesce(labels, 0) AS labels, image, label,
  CASE WHEN images > 1 OR labels > 1 THEN 'ambiguous' WHEN labels IS NULL THEN 'label_missing' WHEN images IS NULL THEN 'image_missing' ELSE 'paired' END AS status
FROM a FULL JOIN b ON a.stem = b.stem""")
def pairing(t):
    def side(status, tag):
        return t.read("orders").filter(F.col("o_orderstatus") == status).select(
            F.col("o_custkey").alias("stem"), F.concat(F.lit(tag), F.col("o_orderkey").cast("string")).alias("path")
        )

    return jn.pair_files(side("F", "i"), side("O", "l"))


ANN_SQL = """ann AS (SELECT o_orderkey AS record_id, o_custkey % 5 AS native_index, o_orderstatus AS source, o_orderpriority AS native FROM orders),
cmap AS (SELECT DISTINCT o_orderstatus AS source, o_orderpriority AS native, lower(substr(o_orderpriority, 3)) AS target, 'accepted' AS status FROM orders WHERE o_orderpriority <> '5-LOW'),
ovr AS (SELECT c_custkey * 10 AS record_id, c_custkey % 5 AS native_index, 'ports:' || lower(c_mktsegment) AS target, 'reviewed' AS status,
  CASE WHEN c_nationkey = 3 THEN ' ' ELSE 'checked' END AS reason FROM customer)"""


def annotations(t: Tables):
    return t.read("orders").select(
        F.col("o_orderkey").alias("record_id"), (F.col("o_custkey") % 5).alias("native_index"),
        F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("native"),
    )


def class_map(t: Tables):
    return annotations(t).select("source", "native").distinct().filter("native <> '5-LOW'").select(
        "source", "native", F.lower(F.expr("substr(native, 3)")).alias("target"), F.lit("accepted").alias("status")
    )


def overrides(t: Tables):
    return t.read("customer").select(
        (F.col("c_custkey") * 10).alias("record_id"), (F.col("c_custkey") % 5).alias("native_index"),
        F.concat(F.lit("ports:"), F.lower("c_mktsegment")).alias("target"), F.lit("reviewed").alias("status"),
        F.when(F.col("c_nationkey") == 3, " ").otherwise("checked").alias("reason"),
    )


@query("jn2", f"""WITH {ANN_SQL} SELECT a.*, coalesce(o.target, m.target) AS target, coalesce(o.status, m.status) AS status,
  CASE WHEN o.target IS NOT NULL THEN 'override' WHEN m.target IS NOT NULL THEN 'map' ELSE 'unmapped' END AS mapping, o.reason
  FROM ann a LEFT JOIN cmap m ON m.source = a.source AND m.native = a.native
  LEFT JOIN ovr o ON o.record_id = a.record_id AND o.native_index = a.native_index""")
def mapped(t):
    return jn.apply_class_map(annotations(t), class_map(t), overrides(t))


@query("jn2_errors", f"""WITH {ANN_SQL} SELECT record_id, native_index, 'unused' AS error FROM ovr o WHERE NOT EXISTS
  (SELECT 1 FROM ann a WHERE a.record_id = o.record_id AND a.native_index = o.native_index)
  UNION ALL SELECT record_id, native_index, 'no_reason' FROM ovr WHERE trim(reason) = ''""")
def bad_overrides(t):
    return jn.override_errors(annotations(t), overrides(t))


@query("src10", f"WITH {ANN_SQL} SELECT DISTINCT source, native FROM ann WHERE NOT EXISTS (SELECT 1 FROM cmap m WHERE m.source = ann.source AND m.native = ann.native)")
def unknown(t):
    return jn.unknown_natives(annotations(t), class_map(t))


CLICK_SQL = """clicks AS (SELECT l_orderkey // 8 AS image_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS point_id,
  CAST(max(l_suppkey * 7 % 464) AS DOUBLE) AS px, CAST(max(l_partkey * 11 % 364) AS DOUBLE) AS py FROM lineitem GROUP BY 1, 2)"""


def clicks(t: Tables):
    point = F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    return t.read("lineitem").groupBy(F.expr("l_orderkey div 8").alias("image_id"), point.alias("point_id")).agg(
        F.max(F.col("l_suppkey") * 7 % 464).cast("double").alias("px"),
        F.max(F.col("l_partkey") * 11 % 364).cast("double").alias("py"),
    )


@query("jn16", with_sql("gt") + f""", {CLICK_SQL} SELECT c.point_id, b.box_id, b.area FROM clicks c LEFT JOIN (
  SELECT c.point_id, arg_min(g.gt_index, {{'a': (x2-x1)*(y2-y1), 'i': g.gt_index}}) AS box_id, min((x2-x1)*(y2-y1)) AS area
  FROM clicks c JOIN gt g ON g.image_id = c.image_id AND px >= x1 AND px < x2 AND py >= y1 AND py < y2 GROUP BY 1) b USING (point_id)""")
def picked(t):
    boxes = t.gt().withColumnRenamed("gt_index", "box_id")
    return jn.pick_at(clicks(t), boxes, ["image_id"])


@query("jn17", with_sql("gt") + """, c AS (SELECT image_id, class_id, gt_index, (x1+x2)/2 AS x, (y1+y2)/2 AS y FROM gt),
  n AS (SELECT p.image_id, p.gt_index, min({'d': (c.x-p.x)*(c.x-p.x)+(c.y-p.y)*(c.y-p.y), 'i': c.image_id * 100000 + c.gt_index}) AS b
    FROM c p JOIN c ON c.image_id = p.image_id + 1 AND c.class_id = p.class_id AND abs(c.x-p.x) <= 80 AND abs(c.y-p.y) <= 80 GROUP BY ALL)
  SELECT c.image_id * 100000 + c.gt_index AS previous_id, n.b.i AS current_id, n.b.d AS distance_sq FROM c LEFT JOIN n USING (image_id, gt_index)""")
def followed(t):
    ident = F.col("image_id") * 100000 + F.col("gt_index")
    c = t.gt().select("image_id", "class_id", ident.alias("i"), ((F.col("x1") + F.col("x2")) / 2).alias("x"),
                      ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    prev = c.select((F.col("image_id") + 1).alias("image_id"), "class_id", F.col("i").alias("previous_id"),
                    F.col("x").alias("px"), F.col("y").alias("py"))
    cur = c.select("image_id", "class_id", F.col("i").alias("current_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    return jn.follow(prev, cur, ["image_id"])


FILES_SQL = """files AS (SELECT p_brand || '/' || p_partkey AS path, sha256(p_name) AS sha256, p_partkey, p_size FROM part),
files2 AS (SELECT CASE WHEN p_size = 7 THEN 'moved/' || path ELSE path END AS path, CASE WHEN p_size = 9 THEN sha256(sha256) ELSE sha256 END AS sha256, p_partkey, p_size FROM files WHERE p_size <> 11)"""


def files(t: Tables):
    return t.read("part").select(
        F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_name", 256).alias("sha256"),
        "p_partkey", "p_size",
    )


def files_later(t: Tables):
    """Second version: one size moved, one changed, one gone."""
    f = files(t).filter("p_size <> 11")
    return f.withColumn("path", F.when(F.col("p_size") == 7, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))).withColumn(
        "sha256", F.when(F.col("p_size") == 9, F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    )


@query("jn15", f"""WITH {FILES_SQL} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.sha256 IS NULL THEN 'missing' WHEN a.sha256 IS NULL THEN 'unexpected'
  WHEN a.sha256 <> b.sha256 THEN 'changed' ELSE 'equal' END AS status FROM files a FULL JOIN files2 b ON a.path = b.path""")
def inventory(t):
    return jn.diff_inventory(files(t), files_later(t))


@query("jn18", f"""WITH {FILES_SQL} SELECT f.p_size AS document, count(*) FILTER (b.sha256 = f.sha256) AS bound, count(*) FILTER (b.sha256 <> f.sha256) AS changed,
  count(*) FILTER (b.sha256 IS NULL) AS absent FROM files f LEFT JOIN files2 b ON b.path = f.path GROUP BY f.p_size""")
def bindings(t):
    records = files(t).select(F.col("p_size").alias("document"), "path", "sha256")
    return jn.check_bindings(files_later(t), records)


RUNS_SQL = """cb AS (SELECT l_suppkey AS run, l_linenumber AS epoch, count(*) AS n FROM lineitem GROUP BY ALL),
lg AS (SELECT DISTINCT l_suppkey AS run, l_linenumber AS epoch FROM lineitem WHERE l_quantity > 48)"""


@query("jn19", f"""WITH {RUNS_SQL} SELECT run, epoch, n, EXISTS (SELECT 1 FROM lg WHERE lg.run = cb.run AND lg.epoch = cb.epoch) AS actual FROM cb""")
def epochs(t):
    key = [F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch")]
    callbacks = t.read("lineitem").groupBy(*key).agg(F.count("*").alias("n"))
    log = t.read("lineitem").filter("l_quantity > 48").select(*key)
    kept, spurious = jn.actual_epochs(callbacks, log)
    return kept.withColumn("actual", F.lit(True)).unionByName(spurious.withColumn("actual", F.lit(False)))


@query("jn20", """WITH s AS (SELECT l_orderkey // 8 AS image_id, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i, l_returnflag AS f, l_linestatus AS s FROM lineitem)
SELECT image_id, count(*) FILTER (f = 'N') AS targets, count(*) FILTER (f = 'R') AS excluded, count(*) FILTER (f = 'A') AS broken FROM s GROUP BY image_id""")
def completeness(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("image_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s = t.read("lineitem").withColumn("image_id", F.expr("l_orderkey div 8")).select(
        "image_id", F.row_number().over(w).alias("source_index"), "l_returnflag"
    )
    recorded = s.filter("l_returnflag <> 'A'").select("image_id", "source_index", (F.col("l_returnflag") == "N").alias("is_target"))
    return jn.object_completeness(s, recorded)


CAND_DELTA_SQL = """, d AS (SELECT a.epoch, a.pipeline, b.ap300 - a.ap300 AS delta, a.optimizer_calls = b.optimizer_calls AS equal_budget
  FROM (SELECT epoch, pipeline, max(ap300) AS ap300, sum(optimizer_calls) AS optimizer_calls FROM candidates WHERE arm = 'a' GROUP BY ALL) a
  JOIN (SELECT epoch, pipeline, max(ap300) AS ap300, sum(optimizer_calls) AS optimizer_calls FROM candidates WHERE arm = 'b' GROUP BY ALL) b USING (epoch, pipeline))"""


@query("jn14", with_sql("candidates") + CAND_DELTA_SQL + """ SELECT pipeline, count(*) AS pairs, count(*) FILTER (delta > 0) AS b_higher,
  round(max(delta), 6) AS best_delta, bool_and(equal_budget) AS equal_budget FROM d GROUP BY pipeline""")
def deltas(t):
    def arm(name):
        return t.candidates().filter(F.col("arm") == name).groupBy("epoch", "pipeline").agg(
            F.max("ap300").alias("ap300"), F.sum("optimizer_calls").alias("optimizer_calls")
        )

    d = jn.paired_deltas(arm("a"), arm("b"), ["epoch", "pipeline"], "ap300", "optimizer_calls")
    return d.groupBy("pipeline").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("delta") > 0).alias("b_higher"),
        F.round(F.max("delta"), 6).alias("best_delta"), F.bool_and("equal_budget").alias("equal_budget"),
    )


# ---------------------------------------------------------------- similarity

DISTANCE = "bit_count(xor(a.code, b.code))"


@query("jn6", with_sql("codes") + f""", c AS (SELECT code, count(*) AS n, min(vec_id) AS id FROM codes GROUP BY code)
  SELECT a.code AS code_a, a.n AS n_a, a.id AS id_a, b.code AS code_b, b.n AS n_b, b.id AS id_b, CAST({DISTANCE} AS INTEGER) AS distance
  FROM c a JOIN c b ON a.code < b.code AND {DISTANCE} <= 6""")
def similar(t):
    return sim.similar_pairs(t.codes(), 6, "vec_id", CODE_BITS)


@query("jn11", with_sql("codes") + f""" SELECT (SELECT count(*) FROM codes a JOIN codes b ON a.code < b.code AND {DISTANCE} <= 6) AS pairs, CAST(0 AS BIGINT) AS differing""")
def recheck_pairs(t):
    """The banded search with two agreeing bands against the one with a single band."""
    cols = ["code_a", "code_b", "n_a", "n_b"]
    two = sim.similar_pairs(t.codes(), 6, "vec_id", CODE_BITS, 2).select(*cols)
    one = sim.similar_pairs(t.codes(), 6, "vec_id", CODE_BITS, 1).select(*cols)
    diff = st.symmetric_difference(two, one).agg(F.count("*").alias("n")).scalar()
    return two.agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("pairs")).select("pairs", diff.alias("differing"))


TURNS = range(0, CODE_BITS, 8)

VARIANTS_SQL = """, var AS (SELECT vec_id, label, code, unnest([""" + ", ".join(
    f"CAST(list_sum(list_transform(range(0, {CODE_BITS}), lambda i: CASE WHEN (code >> i::INTEGER) & 1 = 1 THEN {bit_sql(f'((i + {s}) % {CODE_BITS})')} ELSE 0::BIGINT END)) AS BIGINT)"
    if s else "code" for s in TURNS
) + "]) AS variant FROM codes)"


def with_variants(t: Tables):
    turns = [rotate_left(F.col("code"), s, CODE_BITS) for s in TURNS]
    return t.codes().select(F.col("vec_id").alias("id"), "label", "code", F.array(*turns).alias("variants"))


DIHEDRAL_SQL = with_sql("codes") + VARIANTS_SQL + """, c AS (SELECT code, min(vec_id) AS id, count(*) AS n FROM codes GROUP BY code),
turned AS (SELECT c.id, c.n, v.variant FROM c JOIN var v ON v.vec_id = c.id),
pairs AS (
  SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, CAST(min(bit_count(xor(a.variant, b.code))) AS INTEGER) AS distance,
    max(CASE WHEN a.id < b.id THEN a.n ELSE b.n END) AS n_a, max(CASE WHEN a.id < b.id THEN b.n ELSE a.n END) AS n_b
  FROM turned a JOIN c b ON a.id <> b.id AND bit_count(xor(a.variant, b.code)) <= 6 GROUP BY 1, 2
  UNION ALL SELECT id, id, 0, n, n FROM c WHERE n > 1)"""


@query("jn7", DIHEDRAL_SQL + " SELECT * FROM pairs")
def dihedral(t):
    return sim.similar_pairs_dihedral(with_variants(t), 6, bits=CODE_BITS)


@query("jn7_sources", with_sql("codes") + VARIANTS_SQL + """, own AS (SELECT vec_id, code, 's' || (label % 4) AS source FROM codes),
  near AS (SELECT DISTINCT least(a.vec_id, b.vec_id) AS x, greatest(a.vec_id, b.vec_id) AS y FROM var a JOIN codes b ON a.vec_id <> b.vec_id AND bit_count(xor(a.variant, b.code)) <= 6)
  SELECT least(a.source, b.source) AS source_a, greatest(a.source, b.source) AS source_b, count(*) AS pairs
  FROM near JOIN own a ON a.vec_id = x JOIN own b ON b.vec_id = y WHERE a.source <> b.source GROUP BY ALL""")
def pairs_across_sources(t):
    v = with_variants(t).withColumn("source", F.concat(F.lit("s"), (F.col("label") % 4).cast("string")))
    return sim.cross_source_counts(sim.similar_pairs_dihedral(v, 6, bits=CODE_BITS), v, "source")


@query("jn8", with_sql("codes") + VARIANTS_SQL + """ SELECT a.vec_id AS id, min('h' || lpad(CAST(b.vec_id AS VARCHAR), 7, '0')) AS holdout,
  CAST(min(bit_count(xor(a.variant, b.variant))) AS INTEGER) AS distance
  FROM var a JOIN var b ON a.label <> 0 AND b.label = 0 AND bit_count(xor(a.variant, b.variant)) <= 8 GROUP BY a.vec_id""")
def screened(t):
    v = with_variants(t)
    hold = v.filter("label = 0").select(F.concat(F.lit("h"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("name"), "variants")
    return sim.screen_holdout(v.filter("label <> 0"), hold, 8, bits=CODE_BITS)


@query("jn9", with_sql("codes") + """, d AS (SELECT a.vec_id AS id, b.vec_id AS o, CAST(bit_count(xor(a.code, b.code)) AS INTEGER) AS d
  FROM codes a JOIN codes b ON a.label <> 0 AND b.label = 0)
  SELECT id, min(d) AS distance, arg_min(o, {'d': d, 'o': o}) AS nearest, min(d) = 0 AS exact FROM d GROUP BY id""")
def nearest(t):
    c = t.codes()
    q = c.filter("label <> 0").select(F.col("vec_id").alias("id"), "code")
    ref = c.filter("label = 0").select("code", F.col("vec_id").alias("order"))
    return sim.nearest_reference(q, ref, CODE_BITS)


GREY_SQL = f"""grey0 AS (SELECT vec_id, label AS bucket, list_transform(embedding, lambda x: CAST(floor(x * 100) AS INTEGER)) AS pixels FROM embeddings),
grey AS (SELECT * FROM grey0 UNION ALL SELECT vec_id + {COPY}, bucket, pixels FROM grey0 WHERE vec_id % 7 = 0)"""


@query("jn10", f"""WITH {GREY_SQL}, held AS (SELECT bucket, pixels, min(vec_id) AS id, count(*) AS n FROM grey GROUP BY bucket, pixels)
  SELECT * FROM (SELECT a.bucket, a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b,
  round(list_sum(list_transform(list_zip(a.pixels, b.pixels), lambda z: abs(z[1] - z[2]))) / 64.0::DOUBLE, 9) AS mae
  FROM held a JOIN held b ON a.bucket = b.bucket AND a.id < b.id) WHERE mae <= 12 UNION ALL SELECT bucket, id, id, n, n, 0 FROM held WHERE n > 1""")
def copies(t):
    """All vectors, and a second row for every seventh, so that there are exact copies."""
    # in single precision, like the vectors
    pixels = F.transform("embedding", lambda x: F.floor(x.cast("float") * F.lit(100).cast("float")).cast("int"))
    ids = F.when(F.col("vec_id") % 7 == 0, F.array("vec_id", F.col("vec_id") + COPY)).otherwise(F.array("vec_id"))
    grey = t.read("embeddings").select(F.explode(ids).alias("vec_id"), F.col("label").alias("bucket"), pixels.alias("pixels"))
    return rounded(sim.near_copies(grey, 12.0, "vec_id"), ("mae",))


@query("jn12", DIHEDRAL_SQL + """, s AS (SELECT c.id, CASE WHEN k.label < 6 THEN 'train' WHEN k.label < 8 THEN 'val' ELSE 'test' END AS split, count(*) AS n
    FROM codes k JOIN c USING (code) GROUP BY 1, 2)
  SELECT p.id_a, p.id_b, p.distance, a.split AS split_a, b.split AS split_b, a.n AS n_a, b.n AS n_b FROM pairs p JOIN s a ON a.id = id_a JOIN s b ON b.id = id_b
  WHERE a.split <> b.split AND (id_a <> id_b OR a.split < b.split)""")
def leaks(t):
    v = with_variants(t)
    split = F.when(F.col("label") < 6, "train").when(F.col("label") < 8, "val").otherwise("test")
    pairs = sim.similar_pairs_dihedral(v, 6, bits=CODE_BITS)
    return sim.cross_split_leaks(pairs, v.withColumn("split", split))


# ---------------------------------------------------------------- components

GRAPH_SQL = with_sql("records", recursive=True) + """,
edges AS (SELECT min(doc_id) OVER (PARTITION BY sha) AS a, doc_id AS b FROM records
  UNION SELECT min(doc_id) OVER (PARTITION BY source, n_chars) AS a, doc_id AS b FROM records),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT doc_id AS id, doc_id AS r FROM records UNION SELECT reach.id, s.b FROM reach JOIN sym s ON s.a = reach.r),
comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""


def graph(t: Tables):
    nodes = t.records().withColumnRenamed("doc_id", "id")
    same = F.concat_ws("|", "source", F.col("n_chars").cast("string"))
    return nodes, gr.star_edges(nodes, "sha").unionByName(gr.star_edges(nodes, same))


@query("gr1", GRAPH_SQL + " SELECT * FROM comp")
def components(t):
    nodes, edges = graph(t)
    return gr.connected_components(nodes.select("id"), edges)


@query("gr2", GRAPH_SQL + " SELECT count(DISTINCT component) AS components, CAST(0 AS BIGINT) AS crossing_edges, CAST(0 AS BIGINT) AS wrong_labels, CAST(0 AS BIGINT) AS differing FROM comp")
def verified(t):
    nodes, edges = graph(t)
    return gr.verify_components(gr.connected_components(nodes.select("id"), edges), edges)


@query("gr2_faults", GRAPH_SQL + """, star AS (SELECT min(doc_id) OVER (PARTITION BY sha) AS a, doc_id AS b FROM records
  UNION ALL SELECT min(doc_id) OVER (PARTITION BY source, n_chars), doc_id FROM records),
wrong AS (SELECT id, component, CASE WHEN id % 50 = 0 THEN id WHEN id % 50 = 1 THEN component + 1 ELSE component END AS label FROM comp)
SELECT (SELECT count(DISTINCT label) FROM wrong) AS components,
  (SELECT count(*) FROM star JOIN wrong x ON x.id = a JOIN wrong y ON y.id = b WHERE a <> b AND x.label <> y.label) AS crossing_edges,
  (SELECT count(*) FROM (SELECT label FROM wrong GROUP BY label HAVING min(id) <> label)) AS wrong_labels,
  (SELECT count(*) FROM wrong WHERE label <> component) AS differing""")
def faults_found(t):
    """Some labels are changed, so that every count of the check moves."""
    nodes, edges = graph(t)
    changed = F.when(F.col("id") % 50 == 0, F.col("id")).when(F.col("id") % 50 == 1, F.col("component") + 1).otherwise(F.col("component"))
    wrong = gr.connected_components(nodes.select("id"), edges).withColumn("component", changed)
    return gr.verify_components(wrong, edges)


@query("gr3", with_sql("records", recursive=True) + """,
nodes AS (SELECT doc_id AS id, sha, source, n_chars, CASE quality WHEN 1 THEN 'train' WHEN 0 THEN 'test' END AS anchor FROM records),
edges AS (SELECT min(id) OVER (PARTITION BY sha) AS a, id AS b FROM nodes UNION SELECT min(id) OVER (PARTITION BY source, n_chars), id FROM nodes),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT id, id AS r FROM nodes UNION SELECT reach.id, s.b FROM reach JOIN sym s ON s.a = reach.r),
comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id),
bad AS (SELECT component FROM comp JOIN nodes USING (id) GROUP BY component HAVING count(DISTINCT anchor) > 1),
held AS (SELECT id FROM comp JOIN nodes USING (id) WHERE anchor IS NULL AND component IN (SELECT component FROM bad)),
sym2 AS (SELECT a, b FROM sym WHERE a NOT IN (SELECT id FROM held) AND b NOT IN (SELECT id FROM held)),
reach2 AS (SELECT id, id AS r FROM nodes WHERE id NOT IN (SELECT id FROM held) UNION SELECT reach2.id, s.b FROM reach2 JOIN sym2 s ON s.a = reach2.r),
comp2 AS (SELECT id, min(r) AS component FROM reach2 GROUP BY id),
bad2 AS (SELECT component FROM comp2 JOIN nodes USING (id) GROUP BY component HAVING count(DISTINCT anchor) > 1)
SELECT n.id, n.anchor, coalesce(c.component, n.id) AS component, c.component IS NULL AS quarantined, coalesce(c.component IN (SELECT component FROM bad2), FALSE) AS conflict
FROM nodes n LEFT JOIN comp2 c USING (id)""")
def anchored(t):
    nodes, edges = graph(t)
    anchor = F.when(F.col("quality") == 1, "train").when(F.col("quality") == 0, "test")
    return gr.resolve_anchors(nodes.select("id", anchor.alias("anchor")), edges)


@query("gr4", with_sql("records") + " SELECT sha, count(DISTINCT source) AS values, count(*) AS copies FROM records GROUP BY sha HAVING count(DISTINCT source) > 1")
def contradictory(t):
    return gr.contradictions(t.records(), "sha", "source")


@query("gr5", GRAPH_SQL + f" SELECT component, count(*) AS size, substr({st.list_digest_sql('CAST(id AS VARCHAR)')}, 1, 16) AS component_id FROM comp GROUP BY component")
def component_ids(t):
    nodes, edges = graph(t)
    return gr.component_id(gr.connected_components(nodes.select("id"), edges))


@query("jn8_components", GRAPH_SQL + """, hit AS (SELECT doc_id AS id, 'h' || source AS holdout FROM records WHERE toxic = 1),
  why AS (SELECT component, min(holdout) AS reason FROM comp JOIN hit USING (id) GROUP BY component)
  SELECT comp.id, comp.component, reason, reason IS NULL AS kept FROM comp LEFT JOIN why USING (component)""")
def excluded_components(t):
    nodes, edges = graph(t)
    labelled = gr.connected_components(nodes.select("id"), edges)
    hit = nodes.filter("toxic = 1").select("id", F.concat(F.lit("h"), "source").alias("holdout"))
    return sim.exclude_components(labelled, hit)


# ---------------------------------------------------------------- sets


@query("set1", f"""WITH {FILES_SQL}, n AS (SELECT path, sha256 FROM files WHERE p_size <> 11 UNION ALL SELECT 'new/' || path, sha256 FROM files WHERE p_size = 11)
  SELECT count(*) AS rows, count(*) FILTER (path LIKE 'new/%') AS added, CAST(0 AS BIGINT) AS evaluation_changes FROM n""")
def replaced(t):
    f = files(t)
    old = f.filter("p_size = 11")
    new = old.withColumn("path", F.concat(F.lit("new/"), "path"))
    after = st.replace_subset(f, old, new, "path")
    kept = [x.filter("p_size <> 11").select("path", "sha256") for x in (f, after)]
    changes = st.symmetric_difference(*kept).agg(F.count("*")).scalar()
    return after.agg(F.count("*").alias("rows"), F.count_if(F.col("path").startswith("new/")).alias("added")).select(
        "rows", "added", changes.alias("evaluation_changes")
    )


@query("set2", with_sql("records") + " SELECT DISTINCT a.sha AS id FROM records a JOIN records b ON a.sha = b.sha AND a.source = 'src1' AND b.source <> 'src1'")
def disjoint(t):
    r = t.records().withColumnRenamed("sha", "id")
    return st.shared_ids(r.filter("source = 'src1'"), r.filter("source <> 'src1'"))


@query("set4", with_sql("codes") + f""" SELECT a.code AS code_a, b.code AS code_b, 'right' AS side FROM (SELECT DISTINCT code FROM codes) a JOIN (SELECT DISTINCT code FROM codes) b
  ON a.code < b.code AND {DISTANCE} BETWEEN 5 AND 6""")
def pair_sets(t):
    near = sim.similar_pairs(t.codes(), 4, "vec_id", CODE_BITS).select("code_a", "code_b")
    far = sim.similar_pairs(t.codes(), 6, "vec_id", CODE_BITS).select("code_a", "code_b")
    return st.symmetric_difference(near, far)


@query("set5", with_sql("records") + """, bad AS (SELECT sha FROM records GROUP BY sha HAVING count(*) > 1 AND (count(DISTINCT coalesce(CAST(quality AS VARCHAR), 'none')) > 1 OR count(*) FILTER (toxic = 1) > 0))
  SELECT doc_id, sha FROM records WHERE sha IN (SELECT sha FROM bad)""")
def conflicts(t):
    r = t.records().withColumn("signature", F.col("quality").cast("string")).withColumn("valid", F.coalesce(F.col("toxic") != 1, F.lit(True)))
    return st.quarantine_conflicts(r, "sha", "signature", "valid").select("doc_id", "sha")


@query("set5_signatures", with_sql("gt") + """, s AS (SELECT image_id, list_sort(list({'c': class_id, 'x': x1, 'y': y1, 'x2': x2, 'y2': y2})) AS l FROM gt GROUP BY image_id)
  SELECT count(*) AS images, count(DISTINCT l) AS signatures FROM s""")
def signatures(t):
    s = st.annotation_signatures(t.gt(), "image_id", ["class_id", "x1", "y1", "x2", "y2"])
    return s.agg(F.count("*").alias("images"), F.count_distinct("signature").alias("signatures"))


# ---------------------------------------------------------------- ranking and selection

RANK = "ap300 DESC, ap100 DESC, p50_ms, candidate_id"


def select_sql(rank: str) -> str:
    return with_sql("candidates") + f""", w AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY {rank}) AS rn FROM candidates)
  SELECT candidate_id, arm, ap300, ap100, p50_ms, row_number() OVER (ORDER BY {rank}) = 1 AS recommended FROM w WHERE rn = 1"""


@query("wn1", select_sql(RANK))
def winners(t):
    return wn.select_candidate(t.candidates()).select("candidate_id", "arm", "ap300", "ap100", "p50_ms", "recommended")


@query("wn2", select_sql("ap100 DESC, ap300 DESC, p50_ms, candidate_id"))
def winners_ap100(t):
    return wn.select_candidate(t.candidates(), wn.AP100_FIRST).select("candidate_id", "arm", "ap300", "ap100", "p50_ms", "recommended")


@query("wn3", with_sql("records") + """ SELECT doc_id, sha, first_value(doc_id) OVER w AS kept_id, first_value(doc_id) OVER w = doc_id AS kept
  FROM records WINDOW w AS (PARTITION BY sha ORDER BY CASE WHEN quality = 1 THEN 0 ELSE 1 END, doc_id)""")
def representatives(t):
    priority = F.when(F.col("quality") == 1, 0).otherwise(1)
    return wn.keep_representative(t.records(), "sha", priority, "doc_id").select("doc_id", "sha", "kept_id", "kept")


@query("wn4", with_sql("records") + """, d AS (SELECT lang AS native, source AS family, doc_id AS item,
    row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS depth FROM records),
  o AS (SELECT *, row_number() OVER (PARTITION BY native ORDER BY depth, md5(family), family) AS position FROM d)
  SELECT native, family, item, position, CAST((position - 1) // 40 + 1 AS BIGINT) AS page, (position - 1) % 40 AS tile, position <= 48 AS representative FROM o""")
def pages(t):
    items = t.records().select(F.col("lang").alias("native"), F.col("source").alias("family"), F.col("doc_id").alias("item"))
    return wn.review_pages(items, 40)


@query("wn5", """WITH g AS (SELECT c_mktsegment AS cls, c_nationkey AS native, c_custkey AS group_id, count(*) AS size FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY cls, native ORDER BY md5('42|' || group_id), group_id) AS turn FROM g),
  f AS (SELECT *, sum(size) OVER (PARTITION BY cls ORDER BY turn, native, group_id ROWS UNBOUNDED PRECEDING) - size AS before FROM r)
  SELECT cls, native, group_id, size, CAST(before AS BIGINT) AS before FROM f WHERE before < 1000""")
def quotas(t):
    c, o = t.read("customer"), t.read("orders")
    g = c.join(o, c.c_custkey == o.o_custkey).groupBy(
        F.col("c_mktsegment").alias("cls"), F.col("c_nationkey").alias("native"), F.col("c_custkey").alias("group_id")
    ).agg(F.count("*").alias("size"))
    return wn.quota_select(g, 1000)


STABILITY_SQL = f"""WITH s AS (SELECT s_suppkey, 'c' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS candidate_id, l_returnflag AS g, sum(l_discount) AS d, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
f AS (SELECT candidate_id, row_number() OVER (ORDER BY round(sum(d) / sum(n), 4) DESC, candidate_id) AS full_rank FROM s GROUP BY candidate_id),
o AS (SELECT x.g AS omitted, candidate_id, row_number() OVER (PARTITION BY x.g ORDER BY round(sum(d) / sum(n), 4) DESC, candidate_id) AS rank
  FROM s JOIN (SELECT DISTINCT g FROM s) x ON x.g <> s.g GROUP BY x.g, candidate_id),
p AS (SELECT a.omitted, count(*) FILTER (fa.full_rank > fb.full_rank) AS bad, count(*) AS pairs FROM o a JOIN o b ON a.omitted = b.omitted AND a.rank < b.rank
  JOIN f fa ON fa.candidate_id = a.candidate_id JOIN f fb ON fb.candidate_id = b.candidate_id GROUP BY a.omitted)
SELECT o.omitted, arg_min(o.candidate_id, o.rank) AS winner, arg_min(o.candidate_id, o.rank) = any_value(z.candidate_id) AS same_as_frozen,
  CAST(min(o.rank) FILTER (o.candidate_id = z.candidate_id) AS INTEGER) AS frozen_rank, round(1 - 2 * any_value(p.bad) / any_value(p.pairs)::DOUBLE, 9) AS kendall_tau
FROM o, (SELECT candidate_id FROM f WHERE full_rank = 1) z JOIN p ON p.omitted = o.omitted GROUP BY o.omitted"""


@query("wn7", STABILITY_SQL.replace("FROM o, (SELECT candidate_id FROM f WHERE full_rank = 1) z JOIN p ON p.omitted = o.omitted",
                                    "FROM o JOIN p ON p.omitted = o.omitted CROSS JOIN (SELECT candidate_id FROM f WHERE full_rank = 1) z"))
def stability(t):
    items, s = t.read("lineitem"), t.read("supplier")
    name = F.concat(F.lit("c"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    parts = items.join(s, items.l_suppkey == s.s_suppkey).groupBy(name.alias("candidate_id"), F.col("l_returnflag").alias("g")).agg(
        F.sum("l_discount").alias("d"), F.count("*").alias("n")
    )
    score = F.round(F.sum("d") / F.sum("n"), 4).alias("score")
    order = (("score", False), ("candidate_id", True))
    full = wn.prefix_ranks(parts.groupBy("candidate_id").agg(score), [], order, "full_rank").select("candidate_id", "full_rank")
    others = parts.select("g").distinct().agg(F.collect_set("g")).scalar()
    spread = parts.withColumn("_all", others).withColumn("omitted", F.explode("_all")).filter("omitted <> g")
    ranked = wn.prefix_ranks(spread.groupBy("omitted", "candidate_id").agg(score), ["omitted"], order)
    frozen = full.filter("full_rank = 1").select("candidate_id")
    return rounded(wn.rank_stability(ranked.select("omitted", "candidate_id", "rank"), full, frozen), ("kendall_tau",))


@query("wn7_gap", with_sql("candidates") + f""", r AS (SELECT arm, candidate_id, round(ap300 - lead(ap300) OVER w, 9) AS gap, row_number() OVER w AS rn FROM candidates WINDOW w AS (PARTITION BY arm ORDER BY {RANK}))
  SELECT arm, candidate_id, gap FROM r WHERE rn = 1""")
def gaps(t):
    return rounded(wn.top_two_gap(t.candidates(), ["arm"]), ("gap",))


@query("wn8", """WITH e AS (SELECT l_suppkey AS run, l_linenumber AS epoch, round(avg(l_discount), 3) AS fitness FROM lineitem GROUP BY ALL)
  SELECT run, arg_max(epoch, {'f': fitness, 'e': epoch}) AS epoch, max(fitness) AS fitness FROM e GROUP BY run""")
def best_epochs(t):
    e = t.read("lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch")).agg(
        F.round(F.avg("l_discount"), 3).alias("fitness")
    )
    return wn.best_epoch(e, ["run"])


@query("wn9", """WITH c AS (SELECT o_custkey, o_orderkey, o_orderkey * 3 - o_custkey % 7 * 2000 + CAST(floor(o_totalprice) AS BIGINT) % 30000 AS calls FROM orders),
  p AS (SELECT *, CASE WHEN calls > 60000 THEN 'over_cap' WHEN lag(calls) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) >= calls THEN 'not_increasing' END AS problem FROM c)
  SELECT * FROM p WHERE problem IS NOT NULL""")
def budgets(t):
    calls = F.col("o_orderkey") * 3 - F.col("o_custkey") % 7 * 2000 + F.floor("o_totalprice") % 30000
    rows = t.read("orders").select("o_custkey", "o_orderkey", calls.alias("calls"))
    return wn.check_monotonic(rows, ["o_custkey"], "o_orderkey", "calls", 60000)


@query("wn10", with_sql("gt") + """, p AS (SELECT class_id, row_number() OVER (ORDER BY count(*), class_id) AS rank FROM gt GROUP BY class_id)
  SELECT image_id, arg_min(class_id, rank) AS primary_class FROM gt JOIN p USING (class_id) GROUP BY image_id""")
def primary(t):
    totals = t.gt().groupBy("class_id").agg(F.count("*").alias("rank"))
    return wn.primary_class(t.gt(), totals, "image_id")


@query("tk2", f"""WITH {FILES_SQL}, p AS (SELECT coalesce(a.path, b.path) AS path, a.path IS NULL AS extra FROM files a FULL JOIN files2 b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.sha256 <> b.sha256)
  SELECT path, (SELECT count(*) FROM p) AS problems FROM p ORDER BY path LIMIT 50""")
def first_problems(t):
    bad = jn.diff_inventory(files(t), files_later(t)).filter("status <> 'equal'")
    total = bad.agg(F.count("*")).scalar()
    return bad.orderBy("path").limit(50).select("path", total.alias("problems"))


@query("tk3", with_sql("records") + " SELECT source, doc_id FROM records ORDER BY source, doc_id")
def ordered(t):
    return t.records().select("source", "doc_id").orderBy("source", "doc_id")


@query("tk4", GRAPH_SQL + """ SELECT component, min(id) AS id FROM comp GROUP BY component ORDER BY md5('s|' || component), component LIMIT 40""")
def picked_components(t):
    nodes, edges = graph(t)
    return wn.pick_components(gr.connected_components(nodes.select("id"), edges), 40, "s")


def class_ap(t: Tables, keys=("class_id", "arm", "condition")):
    cols = {"class_id": (F.col("l_partkey") % 4).cast("int"), "arm": F.col("l_returnflag"), "condition": F.col("l_linestatus")}
    return t.read("lineitem").groupBy(*[cols[k].alias(k) for k in keys]).agg(
        F.round(F.avg("l_discount"), 6).alias("ap"), F.count("*").alias("gt")
    )


@query("ag27", """WITH a AS (SELECT l_returnflag AS arm, l_linestatus AS condition, round(avg(l_discount), 6) AS ap FROM lineitem GROUP BY ALL)
  SELECT a.arm, a.condition, a.ap, round((a.ap - r.ap) * 100, 6) AS delta_pp FROM a JOIN a r ON r.arm = a.arm AND r.condition = 'O'""")
def scale_sensitivity(t):
    return rounded(wn.sensitivity(class_ap(t, ("arm", "condition")), "O"), ("delta_pp",), 6)


@query("ag29", """WITH r AS (SELECT DISTINCT p_brand AS code, CASE WHEN p_brand LIKE '%1' THEN 'LARGE' ELSE 'SMALL' END AS reviewed FROM part WHERE p_brand <> 'Brand#3'),
  c AS (SELECT p_brand AS code, count(*) AS n, count(DISTINCT p_type) AS labels, max(p_type) AS label FROM part WHERE p_type IN ('LARGE', 'SMALL') GROUP BY 1)
  SELECT c.code, n, labels, reviewed, labels > 1 OR coalesce(label <> reviewed, TRUE) AS conflict FROM c LEFT JOIN r USING (code)""")
def code_conflicts(t):
    part = t.read("part")
    review = part.select(F.col("p_brand").alias("code")).distinct().filter("code <> 'Brand#3'").select(
        "code", F.when(F.col("code").endswith("1"), "LARGE").otherwise("SMALL").alias("reviewed")
    )
    items = part.filter("p_type IN ('LARGE', 'SMALL')").select(F.col("p_brand").alias("code"), F.col("p_type").alias("label"))
    return wn.mapping_conflicts(items, review)


RUN_SQL = """r AS (SELECT CAST(l_partkey % 4 AS INTEGER) AS class_id, l_returnflag AS arm, round(avg(l_discount), 6) AS ap, count(*) AS gt FROM lineitem GROUP BY ALL)"""


@query("ag30", f"""WITH {RUN_SQL} SELECT class_id, a.ap AS a, b.ap AS b, c.ap AS c, round((b.ap-a.ap)*100, 6) AS b_minus_a_pp, round((c.ap-b.ap)*100, 6) AS c_minus_b_pp,
  round((c.ap-a.ap)*100, 6) AS c_minus_a_pp, a.gt = b.gt AND b.gt = c.gt AS equal_truth
  FROM (SELECT * FROM r WHERE arm = 'A') a JOIN (SELECT * FROM r WHERE arm = 'N') b USING (class_id) JOIN (SELECT * FROM r WHERE arm = 'R') c USING (class_id)""")
def three_runs(t):
    r = class_ap(t, ("class_id", "arm"))
    rows = wn.compare_runs(*[r.filter(F.col("arm") == a) for a in "ANR"])
    return rounded(rows, ("b_minus_a_pp", "c_minus_b_pp", "c_minus_a_pp"), 6)


@query("dq8", f"""WITH {RUN_SQL}, j AS (SELECT min(round(c.ap - a.ap, 9)) AS worst, max(round(c.ap - a.ap, 9)) FILTER (class_id = 2) AS named
    FROM (SELECT * FROM r WHERE arm = 'A') a JOIN (SELECT * FROM r WHERE arm = 'R') c USING (class_id)),
  k AS (SELECT worst, named, round((SELECT avg(ap) FROM r WHERE arm = 'R') - (SELECT avg(ap) FROM r WHERE arm = 'A'), 9) AS gain,
    round((SELECT avg(ap) FROM r WHERE arm = 'R') - (SELECT avg(ap) FROM r WHERE arm = 'N'), 9) AS over_current FROM j)
  SELECT *, gain >= 0.005 AS gain_ok, worst >= -0.05 AS worst_ok, named >= 0 AS named_ok, over_current >= 0 AS current_ok,
    gain >= 0.005 AND worst >= -0.05 AND named >= 0 AND over_current >= 0 AS promoted,
    CASE WHEN gain >= 0.005 AND worst >= -0.05 AND named >= 0 AND over_current >= 0 THEN 'candidate' ELSE 'current' END AS model FROM k""")
def gate(t):
    r = class_ap(t, ("class_id", "arm"))
    rows = wn.promotion_gate(*[r.filter(F.col("arm") == a) for a in "ANR"], named_class=2)
    return rounded(rows, ("worst", "named", "gain", "over_current"))

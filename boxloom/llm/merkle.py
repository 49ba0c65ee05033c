"""A Merkle manifest of a dataset: one tree per group of rows, one over the groups, and a proof for every row.

Digests are SHA-256. Their input is the lower-case hex text of the digests below; tables hold the 32 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.llm.common import small_side, written

#: Consecutive nodes under one parent.
FAN = 16
#: A run of nodes is stored once for every so many blocks of leaves below it, so that no join key meets more blocks than that.
BLOCKS = 256
#: The tree over the groups; groups are numbered from 0.
TOP_TREE = -1


@dataclass(frozen=True)
class Manifest:
    """``blocks``: ``group``, ``block``, ``members`` (``id``, ``leaf``, ``changed``, in order). ``groups``: ``group``,
    ``name``, ``rows``, ``depth``, ``subroot``. ``runs``: ``tree``, ``level``, ``run``, ``children`` (32 bytes each),
    ``digest``, and the parent's place ``up_tree``, ``up_level``, ``up_node`` (null above the root)."""

    blocks: DataFrame
    groups: DataFrame
    runs: DataFrame


def leaf(columns: list[Column]) -> Column:
    """Digest of one row: per value ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _digest(joined: Column) -> Column:
    return F.unhex(F.sha2(F.lower(F.hex(joined)), 256))


def _depth(n: Column) -> Column:
    """How often ``n`` nodes have to be gathered by ``FAN`` until one is left."""
    digits = F.length(F.bin(n - 1))  # each gathering takes four binary digits off the last index
    return F.when(n <= 1, 0).otherwise(F.ceil(digits / 4)).cast("int")


def build(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None) -> Manifest:
    """Leaves, runs and subroots of ``docs``.

    A group's leaves ascend by id and are gathered by ``FAN`` until one node is left, its subroot (a lone leaf is its
    own); the subroots, in the order of their groups' names (null first, bytewise), are gathered likewise. ``changed``
    replaces columns by tampered values and gives every row a second leaf, which enters no node.

    Texts never move: a row is its id and its leaves. Positions come from a range partition by (group, id, leaf) and the
    counts per partition, so one group may hold any share of the rows. Nodes of a level are gathered by (tree, run),
    at most ``FAN`` rows a key, and written.

    Defined results: null ids come first in their group; rows that repeat an id are ordered by their leaves, and equal
    rows are leaves of their own. A null group is a group. Any other column is ignored. An empty table has no blocks,
    groups or runs.
    """
    own = leaf([F.col(c) for c in columns])
    other = leaf([(changed or {}).get(c, F.col(c)) for c in columns])
    rows = written(docs.select(F.col(group_col).alias("name"), F.col(id_col).alias("id"), own.alias("leaf"), other.alias("changed")), "leaves")
    order = ["name", "id", "leaf"]
    ranged = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = written(ranged.groupBy("part", "name").agg(F.count("*").alias("n")), "counts")
    groups = counts.groupBy("name").agg(F.min("part").alias("first"), F.sum("n").alias("rows"))
    groups = groups.withColumn("inside", F.row_number().over(W.partitionBy("first").orderBy("name")) - 1)
    # one row per range partition: how many groups begin in earlier ones
    begun = groups.groupBy("first").agg(F.count("*").alias("n"))
    begun = begun.select("first", (F.sum("n").over(W.orderBy("first")) - F.col("n")).alias("before"))
    groups = groups.join(F.broadcast(begun), "first").select("name", "rows", (F.col("before") + F.col("inside")).alias("group"))
    groups = written(groups.withColumn("depth", _depth(F.col("rows"))), "groups")
    starts = counts.select("part", "name", (F.sum("n").over(W.partitionBy("name").orderBy("part")) - F.col("n")).alias("start"))
    starts = starts.join(groups.withColumnRenamed("name", "_name"), F.col("name").eqNullSafe(F.col("_name")))
    starts = starts.select(F.col("part").alias("_part"), F.col("name").alias("_name"), "start", "group", "depth")
    local = F.row_number().over(W.partitionBy("part", "name").orderBy("id", "leaf", "changed")) - 1
    placed = ranged.withColumn("local", local).join(starts, (F.col("part") == F.col("_part")) & F.col("name").eqNullSafe(F.col("_name")))
    placed = placed.select("group", "depth", (F.col("start") + F.col("local")).alias("node"), "id", "leaf", "changed")
    members = F.sort_array(F.collect_list(F.struct("node", "id", "leaf", "changed")))
    blocks = placed.groupBy("group", "depth", F.expr(f"node div {FAN}").alias("block")).agg(members.alias("members"))
    blocks = written(blocks, "blocks")
    shape = groups.agg(F.max("depth").alias("deepest"), F.count("*").alias("groups")).first()

    bottom = blocks.filter("depth > 0").select(F.col("group").alias("tree"), "depth", F.col("block").alias("run"), _joined(F.transform("members", lambda m: m.leaf)).alias("children"))
    runs = [written(_with_digest(bottom, 0), "runs")] if shape["deepest"] else []
    for level in range(1, shape["deepest"] or 0):
        runs.append(written(_with_digest(_gathered(runs[-1].filter(F.col("depth") > level)), level), "runs"))
    subroots = blocks.filter("depth = 0").select("group", F.col("members")[0].leaf.alias("subroot"))
    for level, made in enumerate(runs):
        subroots = subroots.unionByName(made.filter(F.col("depth") == level + 1).select(F.col("tree").alias("group"), F.col("digest").alias("subroot")))
    groups = written(groups.join(subroots, "group"), "subroots")

    height = _height(shape["groups"])
    tops = groups.select(F.lit(TOP_TREE).cast("long").alias("tree"), F.lit(height).alias("depth"), F.col("group").alias("run"), F.col("subroot").alias("digest"))
    for level in range(height):
        tops = written(_with_digest(_gathered(tops), level), "runs")
        runs.append(tops)
    linked = None
    for made in runs:
        linked = made if linked is None else linked.unionByName(made)
    if linked is None:
        linked = _with_digest(bottom, 0)
    return Manifest(blocks, groups, _parents(linked, height))


def _height(n: int) -> int:
    steps = 0
    while n > 1:
        n, steps = -(-n // FAN), steps + 1
    return steps


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda whole, d: F.concat(whole, d))


def _gathered(runs: DataFrame) -> DataFrame:
    """Runs of the next level: the digests of ``FAN`` consecutive ones."""
    listed = F.sort_array(F.collect_list(F.struct("run", "digest")))
    made = runs.groupBy("tree", "depth", F.expr(f"run div {FAN}").alias("_up")).agg(listed.alias("nodes"))
    return made.select("tree", "depth", F.col("_up").alias("run"), _joined(F.transform("nodes", lambda n: n.digest)).alias("children"))


def _with_digest(runs: DataFrame, level: int) -> DataFrame:
    return runs.select("tree", "depth", F.lit(level).alias("level"), "run", "children", _digest(F.col("children")).alias("digest"))


def _parents(runs: DataFrame, height: int) -> DataFrame:
    inner = F.col("level") + 1 < F.col("depth")
    to_top = ~inner & (F.col("tree") != TOP_TREE) & F.lit(height > 0)
    return runs.select(
        "tree", "level", "run", "children", "digest",
        F.when(inner, F.col("tree")).when(to_top, F.lit(TOP_TREE)).cast("long").alias("up_tree"),
        F.when(inner, F.col("level") + 1).when(to_top, F.lit(0)).alias("up_level"),
        F.when(inner, F.col("run")).when(to_top, F.col("tree")).alias("up_node"),
        (~inner & (F.col("tree") != TOP_TREE)).alias("ends_group"),
    )


def _spread(manifest: Manifest) -> DataFrame:
    """Every run once per ``BLOCKS`` leaf blocks below it: ``group`` and ``chunk`` of those blocks are part of its key."""
    sizes = manifest.groups.select("group", ((F.col("rows") - 1) / (FAN * BLOCKS)).cast("long").alias("last"))
    below = manifest.runs.filter(F.col("tree") != TOP_TREE).join(sizes.withColumnRenamed("group", "tree"), "tree")
    span = F.pow(F.lit(float(FAN)), F.col("level"))
    first = F.floor(F.col("run") * span / BLOCKS)
    last = F.least(F.floor(((F.col("run") + 1) * span - 1) / BLOCKS), F.col("last"))
    inner = below.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("group", F.col("tree"))
    chunks = sizes.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("chunk"))
    top = manifest.runs.filter(F.col("tree") == TOP_TREE)
    levels = [r["level"] for r in top.select("level").distinct().collect()]  # as many as the tree is high
    seen = chunks.withColumn("level", F.explode(F.array(*map(F.lit, levels)))) if levels else chunks.withColumn("level", F.lit(0))
    seen = seen.withColumn("run", F.floor(F.col("group") / F.pow(F.lit(float(FAN)), F.col("level") + 1)))
    return inner.drop("last").unionByName(top.join(seen, ["level", "run"]))


_CLIMB = """
    WITH RECURSIVE climb(group, block, chunk, tree, level, node, folds, above, subroot, root) AS (
        SELECT group, block, chunk, tree, level, node, folds, above, subroot, root FROM {anchor}
        UNION ALL
        SELECT c.group, c.block, c.chunk, r.up_tree, r.up_level, r.up_node,
            transform(c.folds, (f, i) -> unhex(sha2(lower(hex(concat(
                substring(r.children, 1, 32 * if(own, i, at)), f, substring(r.children, 32 * if(own, i, at) + 33)
            ))), 256))),
            if(own, c.above, concat(c.above, substring(r.children, 1, 32 * at), substring(r.children, 32 * at + 33))),
            if(r.ends_group, r.digest, c.subroot), r.digest
        FROM (SELECT *, level = 0 AND tree >= 0 AS own, cast(pmod(node, {fan}) AS int) AS at FROM climb) c
        JOIN {runs} r ON r.tree = c.tree AND r.level = c.level AND r.run = c.node div {fan} AND r.group = c.group AND r.chunk = c.chunk
    )
    SELECT group, block, folds, above, subroot, root FROM climb WHERE tree IS NULL
"""


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: ``id``, ``leaf``, ``subroot``, ``root``, ``siblings`` (their digests, level by level, left to
    right), ``folded_root`` (from the changed leaf and the original siblings), ``verified``; digests as bytes.

    A recursive query climbs: its rows start at the leaves and meet, level by level, the run that holds them, add the
    siblings there and fold every leaf's changed digest with them. The leaves of one block share all runs but the
    first, so they ride in one row, each with a fold of its own. The query ends when no row has a parent left.

    Its result is written here, as Spark's bound on rows of a recursion (one million) has to be lifted while it runs.
    """
    spark = manifest.blocks.sparkSession
    alone = F.col("depth") == 0
    root_above = manifest.groups.limit(2).count() > 1
    up = F.lit(TOP_TREE).cast("long") if root_above else F.lit(None).cast("long")
    first = F.col("members")[0].leaf
    anchor = manifest.blocks.select(
        "group", "block", F.expr(f"block div {BLOCKS}").alias("chunk"),
        F.when(alone, up).otherwise(F.col("group")).alias("tree"),
        F.lit(0).alias("level"), F.when(alone, F.col("group")).otherwise(F.col("block") * FAN).alias("node"),
        F.transform("members", lambda m: m.changed).alias("folds"), F.lit(b"").alias("above"),
        F.when(alone, first).alias("subroot"), F.when(alone, first).alias("root"),
    )
    runs = small_side(written(_spread(manifest), "linked"), F.lit(100) + F.octet_length("children"))
    names = {"anchor": "_merkle_anchor", "runs": "_merkle_runs"}
    anchor.createOrReplaceTempView(names["anchor"])
    runs.createOrReplaceTempView(names["runs"])
    limit, levels = "spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit"
    before = {k: spark.conf.get(k) for k in (limit, levels)}
    try:
        spark.conf.set(limit, "-1")
        spark.conf.set(levels, "1000")
        top = written(spark.sql(_CLIMB.format(fan=FAN, **names)), "climbed")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for view in names.values():
            spark.catalog.dropTempView(view)
    found = manifest.blocks.join(top, ["group", "block"])
    leaves = _joined(F.transform("members", lambda m: m.leaf))
    each = found.select("group", "subroot", "root", "folds", "above", leaves.alias("leaves"), F.posexplode("members").alias("at", "m"))
    beside = F.concat(F.expr("substring(leaves, 1, 32 * at)"), F.expr("substring(leaves, 32 * at + 33)"), F.col("above"))
    folded = F.expr("folds[at]")
    return each.select(
        F.col("m.id").alias("id"), F.col("m.leaf").alias("leaf"), "subroot", "root", beside.alias("siblings"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )


def hex_text(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))

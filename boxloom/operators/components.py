"""Connected components of record graphs, and the checks built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.operators.sets import list_digest
from boxloom.session import cut


def star_edges(df: DataFrame, key: Column | str, node: str = "id") -> DataFrame:
    """Tie all rows of a key to its smallest member: one edge per row, never all pairs."""
    keyed = df.select(F.col(node).alias("dst"), (F.col(key) if isinstance(key, str) else key).alias("_k"))
    keyed = keyed.filter(F.col("_k").isNotNull())
    first = keyed.groupBy("_k").agg(F.min("dst").alias("src"))
    return keyed.join(first, "_k").filter(F.col("src") != F.col("dst")).select("src", "dst")


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Label every node with the smallest node of its component.

    Alternates the large-star and small-star steps until no edge changes. Minima are partial
    aggregates joined back, so a hub with very many neighbours is never gathered in one task
    (adaptive skew join splits it). Each round is cut by a reliable checkpoint.
    """
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter(F.col("u") != F.col("v"))
    pairs = cut(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        # after large-star every edge points down (u > v)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").filter(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        pairs = cut(small)
        now = pairs.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if before == now:
            break
        before = now
    label = pairs.select(F.col("u").alias(node), F.col("v").alias("component"))
    return nodes.join(label, node, "left").withColumn("component", F.coalesce("component", F.col(node)))


def contracted_components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """The labels of ``connected_components`` by another way: contraction.

    Every node points to the least of itself and its neighbours, pointers are followed by doubling, and what points to one node
    becomes that node; the edges between different ones go on to the next round, until none is left.
    """
    label = cut(nodes.select(F.col(node).alias("id"), F.col(node).alias("at")))
    live = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    live = cut(live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u != v").distinct())
    while not live.isEmpty():
        point = live.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        for _ in range(3):
            onward = point.select(F.col("u").alias("p"), F.col("p").alias("_next"))
            point = cut(point.join(onward, "p").select("u", F.col("_next").alias("p")))
        label = cut(label.join(point, F.col("at") == F.col("u"), "left").select("id", F.coalesce("p", "at").alias("at")))
        far = point.select(F.col("u").alias("v"), F.col("p").alias("_v"))
        live = cut(live.join(point, "u").join(far, "v").select(F.col("p").alias("u"), F.col("_v").alias("v")).filter("u != v").distinct())
    return nodes.join(label.select(F.col("id").alias(node), F.col("at").alias("component")), node)


def verify_components(labelled: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Independent check of a labelling: edges that cross components, labels that are not the
    smallest member, and nodes that a second labelling, by contraction, names otherwise."""
    c = labelled.select(F.col(node).alias("_n"), "component")
    crossing = (
        edges.join(c.select(F.col("_n").alias("src"), F.col("component").alias("a")), "src")
        .join(c.select(F.col("_n").alias("dst"), F.col("component").alias("b")), "dst")
        .agg(F.count_if(F.col("a") != F.col("b")).alias("crossing_edges"))
    )
    wrong = c.groupBy("component").agg(F.min("_n").alias("low")).agg(
        F.count_if(F.col("low") != F.col("component")).alias("wrong_labels"), F.count("*").alias("components")
    )
    again = contracted_components(labelled.select(node), edges, node).select(node, F.col("component").alias("second"))
    differ = labelled.join(again, node).agg(F.count_if(F.col("component") != F.col("second")).alias("differing"))
    return wrong.select(
        "components", crossing.scalar().alias("crossing_edges"), "wrong_labels", differ.scalar().alias("differing")
    )


def anchor_conflicts(labelled: DataFrame, anchor: str = "anchor") -> DataFrame:
    """Components whose members carry more than one fixed split."""
    return labelled.filter(F.col(anchor).isNotNull()).groupBy("component").agg(
        F.count_distinct(anchor).alias("anchors")
    ).filter("anchors > 1")


def resolve_anchors(nodes: DataFrame, edges: DataFrame, node: str = "id", anchor: str = "anchor") -> DataFrame:
    """Quarantine unanchored members of conflicting components, then group the rest again.

    Result: every node with ``component``, ``quarantined`` and ``conflict`` (still conflicting).
    """
    first = connected_components(nodes, edges, node)
    bad = anchor_conflicts(first, anchor).select("component")
    held = cut(
        first.join(bad, "component", "left_semi").filter(F.col(anchor).isNull()).select(node)
    )
    kept = nodes.join(held, node, "left_anti")
    left = edges.join(held.select(F.col(node).alias("src")), "src", "left_anti").join(
        held.select(F.col(node).alias("dst")), "dst", "left_anti"
    )
    second = connected_components(kept, left, node)
    still = anchor_conflicts(second, anchor).select("component", F.lit(True).alias("conflict"))
    done = second.join(still, "component", "left").select(
        *nodes.columns, "component", F.lit(False).alias("quarantined"), F.coalesce("conflict", F.lit(False)).alias("conflict")
    )
    out = nodes.join(held, node, "left_semi").select(
        "*", F.col(node).alias("component"), F.lit(True).alias("quarantined"), F.lit(False).alias("conflict")
    )
    return done.unionByName(out)


def contradictions(df: DataFrame, digest: str, flag: str) -> DataFrame:
    """Digests whose copies disagree on ``flag``; any row here is a hard stop."""
    return df.groupBy(digest).agg(F.count_distinct(flag).alias("values"), F.count("*").alias("copies")).filter(
        "values > 1"
    )


def component_id(labelled: DataFrame, node: str = "id") -> DataFrame:
    """Id of a component from its members, independent of their order."""
    named = labelled.select("component", F.col(node).cast("string").alias("_m"))
    return list_digest(named, ["component"], "_m").select(
        "component", F.col("n").alias("size"), F.substring("digest", 1, 16).alias("component_id")
    )

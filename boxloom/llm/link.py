"""Connected groups of similar rows from band keys: hubs first, then only what hubs can't settle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import small_side, written
from boxloom.operators.components import connected_components

#: Rounds in which buckets compare rows with hubs before the rest is paired; hubs of a bucket in every round but the first.
HUB_ROUNDS, HUBS = 3, 4
#: No more rounds are made once the pairs still to compare are at most so many times the rows in shared buckets.
LINEAR = 1
#: Longs of a parity bitmap.
PARITY = 16


def linked_groups(
    bands: DataFrame, features: Callable[[DataFrame], DataFrame], similarity: Callable[[Column, Column], Column], threshold: float
) -> DataFrame:
    """``node``, ``component`` (smallest node) of every node that shares a band key with another one.

    ``bands``: distinct (``node``, ``key``), nodes are longs. ``features(nodes)`` gives (``node``, ``feature``) of the asked
    nodes; two nodes are linked if the ``similarity`` of their features, a Jaccard similarity, is at least ``threshold``.

    Every two rows of a bucket (a key) are compared, or already known to be connected, or proven to be no link, so the
    components are those of all true pairs within buckets. But the pairs of a bucket are not emitted. First every
    bucket compares its rows with one hub, the row whose buckets hold the most rows, so a central one, which is
    linear in the bucket. Then, in each of the next rounds, what is apart from its bucket's largest component is compared with
    ``HUBS`` rows of that component, drawn by a hash, so that a group of near copies draws the same ones in all its buckets.
    What is still apart in the end is compared with the rest of the bucket, save where two exact bounds rule a link out.
    By the triangle inequality of the Jaccard distance, rows whose distances to one hub differ by more than 1 - ``threshold``
    are further apart than that. And two sets differ in at least as many elements as the parities of their elements'
    buckets do, so a join condition on ``PARITY`` longs a row drops what differs too much. When the end begins depends on the pairs that it would compare; the result does not.
    """
    spread = bands.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high").select("key")
    shared = written(bands.join(spread, "key"), "shared")
    sizes = shared.groupBy("key").agg(F.count("*").alias("n"))
    shared = shared.join(shared.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("weight")), "node")
    rows = written(shared, "weighed").withColumn("component", F.col("node"))
    nodes = rows.select("node").distinct()
    feats = small_side(written(features(written(nodes, "nodes")), "features"), F.lit(32) + 8 * F.size("feature"))
    edges, label, few = None, nodes.select("node", F.col("node").alias("component")), LINEAR * rows.count()
    for turn in range(HUB_ROUNDS + 1):
        if turn == 0:
            order = F.struct(-F.col("weight"), F.col("node"), F.col("component"))
            hubs = rows.groupBy("key").agg(F.min(order).alias("h")).select("key", F.col("h.node").alias("hub"))
            asked = rows.join(hubs, "key").withColumns({"a": F.least("node", "hub"), "b": F.greatest("node", "hub")})
            pairs = asked.filter(F.col("node") != F.col("hub"))
        else:  # buckets with one component left are settled
            rows = rows.drop("component").join(label, "node")
            count = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
            main = count.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n")).filter("m.n < n")
            placed = rows.join(main.select("key", F.col("m.component").alias("main"), (F.col("n") * (F.col("n") - F.col("m.n"))).alias("left")), "key")
            rows = written(placed, "mixed")
            to_do = rows.groupBy("key").agg(F.first("left").alias("left")).agg(F.sum("left").alias("left")).first()["left"]
            if to_do is None:
                break
            inner, rest = rows.filter("component = main"), rows.filter("component != main")
            last = to_do <= few or turn == HUB_ROUNDS
            rest = rest.select("key", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("away").alias("ax"))
            if last:
                apart = (F.col("component") != F.col("cx")) & ((F.col("component") == F.col("main")) | (F.col("node") < F.col("x")))
                apart &= F.coalesce(F.abs(F.col("away") - F.col("ax")) <= 1 - threshold + 1e-9, F.lit(True))
                most = (F.col("size") + F.col("sx")) * ((1 - threshold) / (1 + threshold)) + 1e-6
                apart &= sum(F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"px{i}"))) for i in range(PARITY)) <= most
                bits = written(rows.select("node").distinct().join(feats, "node").select("node", F.size("feature").alias("size"), parity("feature").alias("p")), "parity")
                flat = bits.select("node", "size", *(F.col("p")[i].alias(f"p{i}") for i in range(PARITY)))
                other = flat.select(F.col("node").alias("x"), F.col("size").alias("sx"), *(F.col(f"p{i}").alias(f"px{i}") for i in range(PARITY)))
                pairs = rows.join(flat, "node").join(rest.join(other, "x"), "key").filter(apart)
            else:
                drawn = [F.min(F.struct(F.xxhash64("node", F.lit(turn * HUBS + i)).alias("order"), "node")).node for i in range(HUBS)]
                hubs = inner.groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("hubs"))
                pairs = rest.join(hubs.select("key", F.explode("hubs").alias("node")), "key")
            pairs = pairs.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"))
        checked = written(_compared(written(pairs.select("a", "b").distinct(), "pairs"), feats, similarity), "compared")
        if turn == 0:
            distance = F.when(F.col("node") == F.col("hub"), F.lit(0.0)).otherwise(1 - F.col("similarity"))
            rows = written(asked.join(checked, ["a", "b"], "left").select("key", "node", distance.alias("away")), "placed")
        else:
            rows = rows.select("key", "node", "away")
        true = checked.filter(F.col("similarity") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        edges = written(true if edges is None else edges.unionByName(true), "edges")
        label = written(connected_components(nodes, edges, "node"), "labels")
        if turn and last:
            break
    return label


def _compared(pairs: DataFrame, feats: DataFrame, similarity: Callable[[Column, Column], Column]) -> DataFrame:
    left = feats.select(F.col("node").alias("a"), F.col("feature").alias("fa"))
    right = feats.select(F.col("node").alias("b"), F.col("feature").alias("fb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", similarity(F.col("fa"), F.col("fb")).alias("similarity"))


def parity(feature: str) -> Column:
    """``64 * PARITY`` bits of an array of hashes: whether a bucket of hashes holds an odd number of them."""
    one, empty = F.lit(1).cast("long"), F.array_repeat(F.lit(0).cast("long"), PARITY)
    bit = lambda h: F.call_function("shiftleft", one, F.shiftright(h, 8).bitwiseAND(63).cast("int"))
    flip = lambda p, h: F.transform(p, lambda v, i: F.when(i == F.pmod(h, F.lit(PARITY)), v.bitwiseXOR(bit(h))).otherwise(v))
    return F.aggregate(feature, empty, flip)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)

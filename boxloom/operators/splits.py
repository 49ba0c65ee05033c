"""Leak-free splits: every policy assigns whole groups.

Random number streams are hash orders (SHA-256 / MD5 of seed and key), so a split depends on the
keys alone and not on row order, partitioning or engine.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.operators.prefix import running
from boxloom.session import cut

# fixed values: 70 % and 85 % of the SHA-256 range, as 64 hex digits
CUT_70 = "b" + "3" * 63
CUT_85 = "d" + "9" * 63


def hash_split_of(group: Column, seed: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(seed), group.cast("string")), 256)
    return F.when(digest <= CUT_70, "train").when(digest <= CUT_85, "val").otherwise("test")


def hash_split(df: DataFrame, group: str = "group_id", seed: str = "boxloom") -> DataFrame:
    return df.withColumn("split", hash_split_of(F.col(group), seed))


#: Places of a run that one row lists.
PIECE = 1 << 15


def order_hash(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def rarest_class(objects: DataFrame, images_per_class: DataFrame | None = None) -> DataFrame:
    """Stratum of each group: its class with the fewest images overall (ties by class)."""
    present = objects.select("group_id", "image_id", "class_id").distinct()
    totals = images_per_class or present.groupBy("class_id").agg(F.countDistinct("image_id").alias("total"))
    classes = present.select("group_id", "class_id").distinct().join(totals, "class_id")
    return classes.groupBy("group_id").agg(F.min(F.struct("total", "class_id")).getField("class_id").alias("stratum"))


def _bulk(levels: list[float], steps: list[float], n: int) -> list[int]:
    """How many of the ``n`` largest terms of the falling sequences are certain, a few left open.

    A bisection on the water level replaces one step per group for very long runs; the caller
    settles the last terms one by one, where ties matter.
    """
    low, high = min(levels) - max(steps) * (n + 1), max(levels)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(max(0, int((a - mid) // b)) for a, b in zip(levels, steps)) > n:
            low = mid
        else:
            high = mid
    return [max(0, int((a - high) // b) - 4) for a, b in zip(levels, steps)]


def _fill_runs(shares: list[tuple[str, float]], normalised: bool):
    """Ordered fold over the size runs of one stratum.

    All groups of a size form one run, so a stratum has at most about sqrt(2 x rows) runs however
    many groups it holds. A run's groups go one after the other to the split furthest below its
    target; each split offers a falling sequence of deficits and the run takes the largest ones.
    """

    def level(share: float, total: float, filled: float) -> float:
        gap = share * total - filled
        return gap / max(share * total, 1) if normalised else gap

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        total = float((pdf["size"] * pdf["n"]).sum())
        filled = [0] * len(shares)
        out = []
        for size, n in zip(pdf["size"], pdf["n"]):
            size, n = int(size), int(n)
            start = list(filled)
            taken = _bulk([level(s, total, start[k]) for k, (_, s) in enumerate(shares)],
                          [level(s, total, start[k]) - level(s, total, start[k] + size)
                           for k, (_, s) in enumerate(shares)], n)
            queue = [(-level(s, total, start[k] + taken[k] * size), k) for k, (_, s) in enumerate(shares)]
            heapq.heapify(queue)
            left = n - sum(taken)
            while left:
                _, k = heapq.heappop(queue)
                taken[k] += 1
                left -= 1
                heapq.heappush(queue, (-level(shares[k][1], total, start[k] + taken[k] * size), k))
            for k, (name, _) in enumerate(shares):
                filled[k] += taken[k] * size
                if taken[k]:
                    out.append((pdf["stratum"].iloc[0], size, k, name, start[k], taken[k], total))
        return pd.DataFrame(out, columns=["stratum", "size", "k", "split", "start", "taken", "total"])

    return fold


def _greedy_by_deficit(groups: DataFrame, shares: list[tuple[str, float]], normalised: bool, seed: int) -> DataFrame:
    runs = groups.groupBy("stratum", "size").agg(F.count("*").alias("n"))
    kind = groups.schema["stratum"].dataType.simpleString()
    filled = runs.groupBy("stratum").applyInPandas(
        _fill_runs(shares, normalised),
        f"stratum {kind}, size bigint, k int, split string, start bigint, taken bigint, total double",
    )
    share = F.element_at(F.array(*[F.lit(float(s)) for _, s in shares]), F.col("k") + 1)
    # the places of a run in pieces, so that a run of any length needs no long array
    pieces = filled.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(taken - 1) div {PIECE}")))).repartition("stratum", "size", "k", "_piece")
    inside = F.sequence(F.col("_piece") * PIECE, F.least(F.col("taken"), (F.col("_piece") + 1) * PIECE) - 1)
    slots = pieces.withColumn("j", F.explode(inside)).drop("_piece")
    gap = share * F.col("total") - (F.col("start") + F.col("j") * F.col("size"))
    if normalised:
        gap = gap / F.greatest(share * F.col("total"), F.lit(1.0))
    slots = slots.select("stratum", "size", "split", "k", "j", (-gap).alias("want"))
    slots = running(slots, ["stratum", "size"], [F.col("want"), F.col("k"), F.col("j")], {"place": F.lit(1)})
    ranked = running(
        groups.withColumn("_h", order_hash(seed, F.col("group_id"))), ["stratum", "size"],
        [F.col("_h"), F.col("group_id")], {"place": F.lit(1)},
    )
    return ranked.join(slots.select("stratum", "size", "place", "split"), ["stratum", "size", "place"])


# fixed values: split shares
STRATIFIED_SHARES = [("train", 0.75), ("val", 0.15), ("test", 0.10)]
DEFICIT_SHARES = [("train", 0.70), ("val", 0.15), ("test", 0.15)]


def stratified_split(groups: DataFrame, seed: int = 42) -> DataFrame:
    """75/15/10 inside each stratum, largest groups first, to the split furthest below target.

    A stratum with three or more groups and no val (or test) group gives its smallest train group.
    ``groups``: ``group_id, stratum, size``.
    """
    placed = _greedy_by_deficit(groups, STRATIFIED_SHARES, False, seed)
    totals = placed.groupBy("stratum").agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("split") == "val").alias("n_val"), F.count_if(F.col("split") == "test").alias("n_test"),
    ).filter((F.col("groups") >= 3) & ((F.col("n_val") == 0) | (F.col("n_test") == 0)))
    smallest = W.partitionBy("stratum").orderBy("size", "_h", "group_id")
    donors = (
        placed.filter(F.col("split") == "train").withColumn("_rn", F.row_number().over(smallest))
        .filter(F.col("_rn") <= 2).join(totals, "stratum")
    )
    need_val, need_test = F.col("n_val") == 0, F.col("n_test") == 0
    given = donors.select(
        "group_id",
        F.when(F.col("_rn") == 1, F.when(need_val, "val").otherwise("test"))
        .when(need_val & need_test, "test").alias("gift"),
    ).filter(F.col("gift").isNotNull())
    return placed.join(given, "group_id", "left").select(
        "group_id", "stratum", "size", F.coalesce("gift", "split").alias("split")
    )


def deficit_split(groups: DataFrame, seed: int = 42) -> DataFrame:
    """70/15/15 by greatest normalised deficit inside positive and negative strata.

    Groups with an ``anchor`` keep it and take no part in the filling.
    ``groups``: ``group_id, stratum, size, anchor``.
    """
    free = groups.filter(F.col("anchor").isNull()).select("group_id", "stratum", "size")
    placed = _greedy_by_deficit(free, DEFICIT_SHARES, True, seed)
    fixed = groups.filter(F.col("anchor").isNotNull()).select("group_id", "stratum", "size", F.col("anchor").alias("split"))
    return placed.select("group_id", "stratum", "size", "split").unionByName(fixed)


def _trials(groups: DataFrame, trials: int, seed: int) -> DataFrame:
    t = groups.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    return t.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "trial", F.col("group_id").cast("string"))))


def search_split(features: DataFrame, trials: int, seed: int = 42, minimum: int = 5) -> DataFrame:
    """Best of ``trials`` hash permutations of the groups cut at 70 and 85 %.

    ``features``: ``group_id, feature, value`` (the feature ``images`` is exempt from the minimum).
    Every class needs ``minimum`` in every split; the mean squared relative error decides, then the
    trial number. Trials are independent, so they spread over the cluster.
    """
    groups = features.select("group_id").distinct()
    n = groups.agg(F.count("*").alias("n_groups")).scalar()
    placed = running(_trials(groups, trials, seed), ["trial"], [F.col("_h"), F.col("group_id")], {"rn": F.lit(1)})
    cut1, cut2 = F.floor(n * 0.70), F.floor(n * 0.85)
    split = F.when(F.col("rn") <= cut1, "train").when(F.col("rn") <= cut2, "val").otherwise("test")
    placed = cut(placed.select("trial", "group_id", split.alias("split")))
    counts = placed.join(features, "group_id").groupBy("trial", "feature", "split").agg(F.sum("value").alias("v"))
    wide = counts.groupBy("trial", "feature").agg(
        *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("v"))), F.lit(0)).alias(s) for s, _ in DEFICIT_SHARES],
        F.sum("v").alias("total"),
    )
    error = F.lit(0.0)
    for s, share in DEFICIT_SHARES:
        target = F.col("total") * share
        error = error + F.pow((F.col(s) - target) / F.greatest(target, F.lit(1.0)), 2)
    low = (F.col("feature") != "images") & (F.least("train", "val", "test") < minimum)
    cost = wide.groupBy("trial").agg((F.sum(error) / (3 * F.count("*"))).alias("cost"), F.max(low).alias("low"))
    best = cost.filter(~F.col("low")).agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "trial")).alias("b"))
    best = best.select("b.trial", "b.cost")
    return placed.join(best, "trial")


def choose_groups(features: DataFrame, k: int, minimum: float = 0.12, maximum: float = 0.45) -> DataFrame:
    """Exhaustive choice of ``k`` groups whose share of every class is closest to a quarter.

    ``features``: ``group_id, class_id, value``. Combinations grow by appending larger ordinals
    (an array and an ``explode``), never by joining the group table with itself.
    """
    totals = features.groupBy("class_id").agg(F.sum("value").alias("total"))
    groups = features.select("group_id").distinct()
    numbered = running(groups, [], [F.col("group_id")], {"ordinal": F.lit(1)})
    combos = numbered.agg(F.count("*").cast("int").alias("n")).select(
        "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("last")
    ).select("n", F.array("last").alias("members"), "last")
    for depth in range(1, k):
        # leave room for the members still to come
        more = F.when(
            F.col("last") + 1 <= F.col("n"), F.sequence(F.col("last") + 1, F.col("n"))
        )
        combos = combos.repartition(F.col("last")) if depth == 1 else combos
        combos = combos.select("n", "members", F.explode(more).alias("last")).select(
            "n", F.concat("members", F.array("last")).alias("members"), "last"
        )
    shares = features.join(numbered, "group_id").join(totals, "class_id").select(
        F.col("ordinal").cast("int").alias("ordinal"), "class_id", "value", "total"
    )
    members = combos.select("members", F.explode("members").alias("ordinal"))
    picked = members.join(shares, "ordinal").groupBy("members", "class_id").agg(
        (F.sum("value") / F.first("total")).alias("share")
    )
    n_classes = totals.agg(F.count("*").alias("n_classes")).scalar()
    scored = picked.groupBy("members").agg(
        F.round(F.avg(F.abs(F.col("share") - 0.25)), 12).alias("deviation"),
        F.min("share").alias("low"), F.max("share").alias("high"), F.count("*").alias("n_classes"),
    ).filter((F.col("n_classes") == n_classes) & (F.col("low") >= minimum) & (F.col("high") <= maximum))
    best = scored.agg(F.min(F.struct("deviation", "members")).alias("b"), F.count("*").alias("eligible"))
    chosen = best.select("eligible", F.col("b.deviation").alias("deviation"), F.explode("b.members").alias("ordinal"))
    return chosen.join(numbered.withColumn("ordinal", F.col("ordinal").cast("int")), "ordinal").select(
        "group_id", "deviation", "eligible"
    )


def counted_split(groups: DataFrame, counts: dict[str, int], held_out, seed: int = 42) -> DataFrame:
    """Fixed numbers of groups per split in hash order; one named group is set aside.

    The last split takes the remainder. The order is a prefix count, not a single sorted task.
    """
    free = groups.filter(F.col("group_id") != held_out).withColumn("_h", order_hash(seed, F.col("group_id")))
    ranked = running(free, [], [F.col("_h"), F.col("group_id")], {"rn": F.lit(1)})
    names = list(counts)
    split, edge = F.lit(names[-1]), sum(counts.values())
    for name in reversed(names):
        split = F.when(F.col("rn") <= edge, name).otherwise(split)
        edge -= counts[name]
    aside = groups.filter(F.col("group_id") == held_out).select("group_id", F.lit("held_out").alias("split"))
    return ranked.select("group_id", split.alias("split")).unionByName(aside)


def assert_splits(df: DataFrame, expected: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """One row that says whether every expected split is present (an empty one means reject)."""
    return df.agg(
        F.count_distinct("split").alias("splits"),
        F.coalesce(F.bool_and(F.col("split").isin(*expected)), F.lit(False)).alias("known"),
    ).select("splits", (F.col("known") & (F.col("splits") == len(expected))).alias("accepted"))

"""Ranking, representatives, review order, quotas and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.operators.prefix import running
from boxloom.session import cut

# fixed values: ranking keys, best first
AP300_FIRST = (("ap300", False), ("ap100", False), ("p50_ms", True), ("candidate_id", True))
AP100_FIRST = (("ap100", False), ("ap300", False), ("p50_ms", True), ("candidate_id", True))


def _order(keys) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in keys]


def select_candidate(candidates: DataFrame, order=AP300_FIRST, arm: str = "arm") -> DataFrame:
    """Winner of each arm and, among them, of all. Only validation rows may be ranked.

    A row of another split makes the query fail instead of being skipped.
    """
    guarded = candidates.withColumn(
        "split", F.when(F.col("split") == "val", F.col("split")).otherwise(
            F.raise_error(F.concat(F.lit("selection may only read validation rows, got "), F.col("split"))))
    )
    w = W.partitionBy(arm).orderBy(*_order(order))
    winners = guarded.filter(F.col("split").isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    # at most one row per arm is left
    overall = W.partitionBy(F.lit(1)).orderBy(*_order(order))
    return winners.drop("_rn").withColumn("recommended", F.row_number().over(overall) == 1)


def ranks(candidates: DataFrame, keys: list[str], order=AP300_FIRST) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*_order(order))
    return candidates.withColumn("rank", F.row_number().over(w))


def prefix_ranks(candidates: DataFrame, keys: list[str], order=AP300_FIRST, name: str = "rank") -> DataFrame:
    """``ranks`` by a prefix count, for keys (or none) with any number of candidates."""
    return running(candidates, keys, _order(order), {name: F.lit(1)}).withColumn(name, F.col(name).cast("int"))


def inversions(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Pairs per key whose order by ``first`` and by ``second`` (not negative, both without ties) differ: keys, ``inverted``.

    Merge counting, with the bits of ``second`` as levels: at the highest bit where two rows differ the one with a 0 is
    the smaller, so a pair is inverted if it comes after the 1 in the order of ``first``. All rows that share the higher bits are one list;
    how many 1s stand before each 0 is a prefix count, so no list is gathered.
    """
    width = df.agg(F.length(F.bin(F.coalesce(F.max(second), F.lit(0)))).alias("w"))
    rows = df.select(*keys, F.col(first).alias("_at"), F.col(second).cast("long").alias("_v")).join(F.broadcast(width), F.lit(True))
    rows = rows.select(*keys, "_at", "_v", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("_level"))
    above = F.call_function("shiftright", F.col("_v"), F.col("_level") + 1)
    bit = F.call_function("shiftright", F.col("_v"), F.col("_level")).bitwiseAND(1)
    rows = rows.select(*keys, "_level", above.alias("_above"), "_at", bit.alias("_bit"))
    counted = running(rows, [*keys, "_level", "_above"], [F.col("_at")], {"_ones": F.col("_bit")})
    return counted.groupBy(*keys).agg(F.sum(F.when(F.col("_bit") == 0, F.col("_ones")).otherwise(0)).alias("inverted"))


def rank_stability(omitted: DataFrame, full: DataFrame, frozen: DataFrame) -> DataFrame:
    """Per omitted group: the winner, the rank of the frozen one, and Kendall's tau to the full rank.

    ``omitted``: omitted, candidate_id, rank; ``full``: candidate_id, full_rank; ``frozen``: frozen_id.
    Discordant pairs are ``inversions`` of the two orders, so a grid may have any number of candidates.
    """
    joined = cut(omitted.join(full, "candidate_id"))
    name = frozen.scalar()
    is_frozen = F.col("candidate_id") == name
    sums = joined.groupBy("omitted").agg(
        F.min_by("candidate_id", "rank").alias("winner"), F.min(F.when(is_frozen, F.col("rank"))).alias("frozen_rank"), F.count("*").alias("_n")
    )
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    return sums.join(inversions(joined, ["omitted"], "rank", "full_rank"), "omitted").select(
        "omitted", "winner", (F.col("winner") == name).alias("same_as_frozen"), "frozen_rank",
        F.when(pairs > 0, 1 - 2 * F.col("inverted") / pairs).alias("kendall_tau"),
    )


def top_two_gap(candidates: DataFrame, keys: list[str], value: str = "ap300", order=AP300_FIRST) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*_order(order))
    rows = candidates.select(
        *keys, "candidate_id", (F.col(value) - F.lead(value).over(w)).alias("gap"), F.row_number().over(w).alias("_rn")
    )
    return rows.filter("_rn = 1").drop("_rn")


def keep_representative(df: DataFrame, digest: str, priority: Column, node: str = "id") -> DataFrame:
    """One row per digest by (priority, id); the others name the kept one.

    The least key per digest is a partial aggregate joined back, so a digest with very many copies
    is not windowed in one task.
    """
    best = df.groupBy(digest).agg(F.min(F.struct(priority.alias("p"), F.col(node).alias("id"))).alias("_b"))
    joined = df.join(best, digest)
    return joined.select(
        *df.columns, F.col("_b.id").alias("kept_id"), (F.col("_b.id") == F.col(node)).alias("kept")
    )


def review_pages(items: DataFrame, page_size: int, representatives: int = 48) -> DataFrame:
    """Round-robin review order over families, both in hash order, cut into pages per class.

    ``items``: ``native`` (class), ``family``, ``item``. Positions are prefix counts, so neither a
    large family nor a large class is ordered by one task.
    """
    hashed = items.withColumn("_fh", F.md5("family")).withColumn("_ih", F.md5(F.col("item").cast("string")))
    deep = running(hashed, ["native", "family"], [F.col("_ih"), F.col("item")], {"depth": F.lit(1)})
    ordered = running(deep, ["native"], [F.col("depth"), F.col("_fh"), F.col("family")], {"position": F.lit(1)})
    return ordered.select(
        *items.columns, F.col("position").cast("long").alias("position"),
        (F.floor((F.col("position") - 1) / page_size) + 1).alias("page"),
        ((F.col("position") - 1) % page_size).cast("long").alias("tile"),
        (F.col("position") <= representatives).alias("representative"),
    )


def quota_select(groups: DataFrame, quota: int, seed: str = "42") -> DataFrame:
    """Take groups round-robin over native classes while the running count is below the quota.

    ``groups``: ``cls, native, group_id, size``; the group that crosses the quota is still taken.
    """
    h = groups.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("group_id").cast("string"))))
    turns = running(h, ["cls", "native"], [F.col("_h"), F.col("group_id")], {"turn": F.lit(1)})
    filled = running(turns, ["cls"], [F.col("turn"), F.col("native"), F.col("group_id")], {"filled": F.col("size")})
    return filled.filter(F.col("filled") - F.col("size") < quota).select(
        *groups.columns, (F.col("filled") - F.col("size")).cast("long").alias("before")
    )


def best_epoch(df: DataFrame, keys: list[str]) -> DataFrame:
    """Highest fitness; the later epoch wins a tie."""
    return df.groupBy(*keys).agg(F.max(F.struct("fitness", "epoch")).alias("b")).select(
        *keys, F.col("b.epoch").alias("epoch"), F.col("b.fitness").alias("fitness")
    )


def check_monotonic(df: DataFrame, keys: list[str], order: str, counter: str, cap: int) -> DataFrame:
    """Rows whose counter does not rise strictly, or passes the cap."""
    w = W.partitionBy(*keys).orderBy(order)
    previous = F.lag(counter).over(w)
    problem = F.when(F.col(counter) > cap, "over_cap").when(previous >= F.col(counter), "not_increasing")
    return df.select(*keys, order, counter, problem.alias("problem")).filter(F.col("problem").isNotNull())


def primary_class(objects: DataFrame, priority: DataFrame, key: str) -> DataFrame:
    """The class of the image (or group) that stands first in the priority list."""
    joined = objects.join(priority, "class_id")
    return joined.groupBy(key).agg(F.min(F.struct("rank", "class_id")).alias("b")).select(
        key, F.col("b.class_id").alias("primary_class")
    )


def pick_components(labelled: DataFrame, k: int, seed: str, node: str = "id") -> DataFrame:
    """First ``k`` components in hash order, and the smallest member of each."""
    first = labelled.groupBy("component").agg(F.min(node).alias(node))
    return first.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("component").cast("string")))).orderBy(
        "_h", "component"
    ).limit(k).drop("_h")


def compare_runs(base: DataFrame, middle: DataFrame, last: DataFrame, value: str = "ap") -> DataFrame:
    """Per class: three runs, percentage-point deltas, and whether the truth counts agree."""
    def named(df, tag):
        return df.select("class_id", F.col(value).alias(tag), F.col("gt").alias(f"gt_{tag}"))

    j = named(base, "a").join(named(middle, "b"), "class_id").join(named(last, "c"), "class_id")
    return j.select(
        "class_id", "a", "b", "c", ((F.col("b") - F.col("a")) * 100).alias("b_minus_a_pp"),
        ((F.col("c") - F.col("b")) * 100).alias("c_minus_b_pp"), ((F.col("c") - F.col("a")) * 100).alias("c_minus_a_pp"),
        ((F.col("gt_a") == F.col("gt_b")) & (F.col("gt_b") == F.col("gt_c"))).alias("equal_truth"),
    )


def promotion_gate(
    base: DataFrame, current: DataFrame, candidate: DataFrame, named_class, gain: float = 0.005, drop: float = 0.05
) -> DataFrame:
    """Promotion rules over per-class scores (``class_id, ap``) and the model to use.

    Overall gain on base of at least ``gain``; no class falls more than ``drop``; the named class
    does not fall; the candidate is not below the current model. Otherwise the current model stays.
    """
    def mean(df):
        return df.agg(F.avg("ap")).scalar()

    j = base.select("class_id", F.col("ap").alias("base")).join(
        candidate.select("class_id", F.col("ap").alias("cand")), "class_id"
    )
    delta = F.col("cand") - F.col("base")
    row = j.agg(
        F.min(delta).alias("worst"), F.max(F.when(F.col("class_id") == named_class, delta)).alias("named")
    ).select(
        "worst", "named", (mean(candidate) - mean(base)).alias("gain"), (mean(candidate) - mean(current)).alias("over_current")
    )
    rules = {
        "gain_ok": F.round("gain", 9) >= gain, "worst_ok": F.round("worst", 9) >= -drop,
        "named_ok": F.round("named", 9) >= 0, "current_ok": F.round("over_current", 9) >= 0,
    }
    row = row.select("*", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items()])
    ok = F.col("gain_ok") & F.col("worst_ok") & F.col("named_ok") & F.col("current_ok")
    return row.select("*", ok.alias("promoted"), F.when(ok, "candidate").otherwise("current").alias("model"))


def sensitivity(df: DataFrame, reference: str, value: str = "ap") -> DataFrame:
    """Every condition against the reference condition of its arm, in percentage points."""
    ref = df.filter(F.col("condition") == reference).select("arm", F.col(value).alias("_ref"))
    return df.join(ref, "arm").select(
        "arm", "condition", value, ((F.col(value) - F.col("_ref")) * 100).alias("delta_pp")
    )


def mapping_conflicts(items: DataFrame, review: DataFrame) -> DataFrame:
    """Counts per source code with the labels seen, and whether they contradict the review."""
    counts = items.groupBy("code").agg(
        F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.max("label").alias("label")
    )
    return counts.join(review, "code", "left").select(
        "code", "n", "labels", "reviewed",
        ((F.col("labels") > 1) | F.coalesce(F.col("label") != F.col("reviewed"), F.lit(True))).alias("conflict"),
    )

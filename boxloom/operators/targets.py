"""Splits that meet image targets exactly with whole groups.

Which groups carry a size doesn't matter for a sum, so sums are solved over the size histogram: at most about
sqrt(2 x images) rows however many groups there are. Groups meet their split by a prefix count inside their size.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators.matching import top_per_group
from boxloom.operators.prefix import running
from boxloom.session import cut

#: Up to so many (states x groups) the joint search over all splits is complete: its refusal is a proof.
STATES = 1 << 28
#: Bits that one subset-sum table may take.
TABLE_BITS = 1 << 31
#: Choices of the groups that meet the class minima, tried one after the other.
ATTEMPTS = 24
#: Smallest groups per class that may be chosen for its minima, in multiples of what the minima ask.
SPARE = 4


def _pieces(sizes: dict[int, int]) -> list[tuple[int, int]]:
    """(size, count) items whose subsets are all choices of 0 to n groups of each size, largest sizes first."""
    out = []
    for size, n in sorted(sizes.items(), reverse=True):
        chunk = 1
        while n > 0:
            out.append((size, min(chunk, n)))
            n -= chunk
            chunk *= 2
    return out


def subset(sizes: dict[int, int], target: int) -> dict[int, int] | None:
    """Groups per size that add up to ``target``; large sizes are preferred. None if there is no such choice, or no room to look."""
    pieces = _pieces(sizes)
    if (target + 1) * (len(pieces) + 1) > TABLE_BITS:
        return None
    reach, tables, mask = 1, [], (1 << (target + 1)) - 1
    for size, n in pieces:
        tables.append(reach)
        reach |= (reach << (size * n)) & mask
    if not reach >> target & 1:
        return None
    taken: dict[int, int] = {}
    for (size, n), before in zip(reversed(pieces), reversed(tables), strict=True):
        if not before >> target & 1:
            taken[size] = taken.get(size, 0) + n
            target -= size * n
    return taken


def _one_after_another(sizes: dict[int, int], gaps: dict[str, int], order: list[str]) -> dict[str, dict[int, int]] | None:
    """Split by split: most of each size in proportion, then large sizes down to a gap of a few groups, which a subset sum of
    few groups a size closes; without any of these last. The last split takes what is left."""
    left, out = dict(sizes), {}
    for name in order[:-1]:
        total = sum(s * n for s, n in left.items())
        found = None
        for share in (1.0, 0.9, 0.5, 0.0):
            base = {s: int(n * share * gaps[name] / total) if total else 0 for s, n in left.items()}
            rest, few = gaps[name] - sum(s * n for s, n in base.items()), max(left, default=0) * 4
            for s in sorted(left, reverse=True) if share else ():
                n = min(left[s] - base[s], max(0, rest - few) // s)
                base[s], rest = base[s] + n, rest - n * s
            more = subset({s: min(n - base[s], 4 if share else n) for s, n in left.items()}, rest) if rest >= 0 else None
            if more is not None:
                found = {s: base[s] + more.get(s, 0) for s in left}
                break
        if found is None:
            return None
        out[name] = found
        left = {s: n - found[s] for s, n in left.items()}
    out[order[-1]] = left
    return out


def _jointly(sizes: dict[int, int], gaps: dict[str, int]) -> tuple[bool, dict[str, dict[int, int]] | None]:
    """All splits at once: (whether the search was complete, the groups per split and size). The largest split takes what the others leave."""
    *others, last = sorted(gaps, key=lambda k: gaps[k])
    shape = tuple(gaps[k] + 1 for k in others)
    items = [s for s, n in sorted(sizes.items(), reverse=True) for _ in range(n)]
    if int(np.prod([float(x) for x in shape])) * max(1, len(items)) > STATES:
        return False, None
    reach = np.zeros(shape, bool)
    reach[(0,) * len(others)] = True
    tables = []
    for size in items:
        tables.append(np.packbits(reach.ravel()))
        new = reach.copy()
        for axis, n in enumerate(shape):
            if size < n:
                to, of = [slice(None)] * len(shape), [slice(None)] * len(shape)
                to[axis], of[axis] = slice(size, None), slice(None, n - size)
                new[tuple(to)] |= reach[tuple(of)]
        reach = new
    at = [gaps[k] for k in others]
    if not reach[tuple(at)]:
        return True, None
    out: dict[str, dict[int, int]] = {k: dict.fromkeys(sizes, 0) for k in gaps}
    for size, table in zip(reversed(items), reversed(tables), strict=True):
        before = np.unpackbits(table, count=int(np.prod(shape))).reshape(shape)
        for axis, name in enumerate([*others, last]):
            from_ = list(at)
            if name != last:
                from_[axis] -= size
                if from_[axis] < 0:
                    continue
            if before[tuple(from_)]:
                out[name][size] += 1
                at = from_
                break
    return True, out


def _cover(gaps: dict[str, int], short: dict[tuple[str, str], int], candidates: list[tuple], turn: int) -> dict | None:
    """Group -> split so that no class is short, small groups first; each turn tries them in another order."""
    left, short, free = dict(gaps), dict(short), {c[0]: c for c in candidates}
    mixed = lambda g: hashlib.md5(f"{turn}|{g}".encode()).hexdigest()
    placed = {}
    for name in sorted(gaps, key=lambda k: gaps[k]):
        while True:
            wanted = {c for (s, c), n in short.items() if s == name and n > 0}
            if not wanted:
                break
            fits = [c for c in free.values() if c[1] <= left[name] and wanted & set(c[2])]
            if not fits:
                return None
            best = min(fits, key=lambda c: (-len(wanted & set(c[2])), c[1], mixed(c[0])) if turn == 0 else (mixed(c[0]), c[1]))
            placed[best[0]] = name
            left[name] -= best[1]
            del free[best[0]]
            for c in best[2]:
                short[name, c] = short.get((name, c), 0) - 1
    return placed


def assign(sizes: dict[int, int], gaps: dict[str, int], short: dict[tuple[str, str], int], candidates: list[tuple]):
    """(refusal or None, group -> split, split -> size -> groups)."""
    if min(gaps.values()) < 0:
        return "the pinned groups of a split exceed its target", {}, {}
    if sum(gaps.values()) != sum(s * n for s, n in sizes.items()):
        return "the targets don't add up to the images", {}, {}
    complete, found = _jointly(sizes, gaps)
    if complete and found is None:
        return "no choice of whole groups meets the targets", {}, {}
    for turn in range(ATTEMPTS):
        placed = _cover(gaps, short, candidates, turn)
        if placed is None:
            continue
        left, open_sizes, size_of = dict(gaps), dict(sizes), {c[0]: c[1] for c in candidates}
        for group, name in placed.items():
            left[name] -= size_of[group]
            open_sizes[size_of[group]] -= 1
        order = sorted(left, key=lambda k: left[k])
        found = _one_after_another(open_sizes, left, order if turn % 2 == 0 else order[::-1]) or _jointly(open_sizes, left)[1]
        if found:
            return None, placed, found
        if not placed:
            break  # other turns would try the same
    return "no choice was found that meets the targets and the class minima", {}, {}


PLAN = "refused string, group_key string, size long, split string, low long, high long"


def _planned(targets: dict[str, int], minimum: dict[str, int], batches):
    for pdf in batches:
        for row in pdf.itertuples():
            sizes = {int(r["size"]): int(r["n"]) for r in row.histogram}
            used = {r["anchor"]: int(r["images"]) for r in row.pinned}
            have = {(r["split"], r["class_id"]): int(r["n"]) for r in row.have}
            gaps = {k: t - used.get(k, 0) for k, t in targets.items()}
            scarce = [r for r in row.classes if r["n"] < sum(minimum.values())]
            short = {(k, r["class_id"]): m - have.get((k, r["class_id"]), 0) for k, m in minimum.items() for r in row.classes}
            candidates = [(r["group_key"], int(r["size"]), tuple(r["classes"])) for r in sorted(row.candidates, key=lambda r: r["group_key"])]
            refused, placed, runs = ("a class has too few groups for the minima", {}, {}) if scarce else assign(sizes, gaps, short, candidates)
            out = [(None, group, 0, name, 0, 0) for group, name in placed.items()]
            at: dict[int, int] = {}
            for name, taken in runs.items():
                for size, n in taken.items():
                    if n:
                        out.append((None, None, size, name, at.get(size, 0) + 1, at.get(size, 0) + n))
                        at[size] = at.get(size, 0) + n
            if refused:
                out = [(refused, None, 0, None, 0, 0)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])


def target_split(
    groups: DataFrame, targets: dict[str, int], minimum_groups: dict[str, int] | None = None, members: DataFrame | None = None, seed: int = 42,
) -> DataFrame:
    """Whole groups placed so that every split has exactly its ``targets`` images: ``group_id, size, split, refused``.

    ``groups``: ``group_id, size, anchor`` (a split name pins the group there). ``members`` (``group_id, class_id``) with
    ``minimum_groups`` ask for so many groups of every class in a split. First small groups are set aside for the
    minima that the pinned ones leave open, then the rest of each target is an exact choice of sizes, and inside a size groups
    go to splits in hash order.

    Where it can't be done the result is one row with the reason in ``refused`` and nulls elsewhere. It is proven if
    a pinned sum exceeds its target, the targets miss the total, a class has too few groups, or (up to ``STATES``) no choice of
    groups meets the targets at all; else the reason says that none was found.

    What the search reads is bounded: one row per size, split and class, and per class ``SPARE`` times as many
    groups as the minima ask. Groups themselves never meet in one task. An empty table meets targets of 0.
    """
    minimum = minimum_groups or {}
    held = cut(groups.select("group_id", F.col("size").cast("long").alias("size"), "anchor", F.col("group_id").cast("string").alias("group_key")))
    free = held.filter("anchor IS NULL")
    listed = lambda *names: F.collect_list(F.struct(*names))
    histogram = free.groupBy("size").agg(F.count("*").alias("n")).agg(listed("size", "n").alias("histogram"))
    pinned = held.filter("anchor IS NOT NULL")
    used = pinned.groupBy("anchor").agg(F.sum("size").alias("images")).agg(listed("anchor", "images").alias("pinned"))
    if members is None:
        members = held.select("group_id", F.lit(None).cast("string").alias("class_id"))
    of = cut(members.select("group_id", F.col("class_id").cast("string").alias("class_id")).filter("class_id IS NOT NULL").distinct().join(held, "group_id"))
    classes = of.groupBy("class_id").agg(F.count("*").alias("n")).agg(listed("class_id", "n").alias("classes"))
    have = of.filter("anchor IS NOT NULL").groupBy(F.col("anchor").alias("split"), "class_id").agg(F.count("*").alias("n"))
    have = have.agg(listed("split", "class_id", "n").alias("have"))
    order = [F.col("size"), F.md5(F.concat_ws("|", F.lit(str(seed)), "group_key"))]
    few = top_per_group(of.filter("anchor IS NULL"), ["class_id"], order, max(1, SPARE * sum(minimum.values())))
    named = of.join(few.select("group_id").distinct(), "group_id", "left_semi").groupBy("group_key", "size").agg(F.sort_array(F.collect_list("class_id")).alias("classes"))
    candidates = named.agg(listed("group_key", "size", "classes").alias("candidates"))
    # five tables of one row each
    seen = histogram
    for one in (used, classes, have, candidates):
        seen = seen.join(F.broadcast(one), F.lit(True))
    plan = cut(seen.mapInPandas(partial(_planned, targets, minimum), PLAN))
    chosen = plan.filter("group_key IS NOT NULL").select("group_key", F.col("split").alias("_chosen"))
    runs = plan.filter("group_key IS NULL AND refused IS NULL").select("size", "split", "low", "high")
    open_groups = free.join(F.broadcast(chosen), "group_key", "left_anti").withColumn("_h", order[1])
    ranked = running(open_groups, ["size"], [F.col("_h"), F.col("group_key")], {"place": F.lit(1)}).withColumnRenamed("size", "_size")
    placed = ranked.join(runs, (F.col("_size") == F.col("size")) & F.col("place").between(F.col("low"), F.col("high"))).select("group_id", "size", "split")
    set_aside = free.join(F.broadcast(chosen), "group_key").select("group_id", "size", F.col("_chosen").alias("split"))
    refused = plan.filter("refused IS NOT NULL").select("refused")
    kept = pinned.select("group_id", "size", F.col("anchor").alias("split")).join(F.broadcast(refused), F.lit(True), "left_anti")
    done = placed.unionByName(set_aside).unionByName(kept).withColumn("refused", F.lit(None).cast("string"))
    return done.unionByName(refused.select("refused"), allowMissingColumns=True)

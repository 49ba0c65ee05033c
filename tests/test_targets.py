"""Splits with exact image targets."""

import itertools
import random
from collections import Counter

import pytest

from boxloom.operators import targets as tg

NAMES = ["train", "val", "test", "excluded"]


def frames(spark, groups, members):
    g = spark.createDataFrame(groups, "group_id long, size long, anchor string")
    return g, spark.createDataFrame(members or [(-1, "none")], "group_id long, class_id string").filter("group_id >= 0")


def possible(sizes, gaps):
    """Whether some assignment of single groups meets the gaps, by trying all sums."""
    seen = {(0,) * len(gaps)}
    for s in sizes:
        seen = {
            tuple(v + s * (k == j) for j, v in enumerate(at)) for at in seen for k in range(len(gaps)) if at[k] + s <= gaps[k]
        }
    return tuple(gaps) in seen


@pytest.mark.parametrize("seed", range(6))
def test_sums_are_found_or_proven_impossible(seed):
    rng = random.Random(seed)
    for _ in range(30):
        sizes = [rng.choice([3, 5, 6, 9, 14, 20]) for _ in range(rng.randint(4, 9))]
        cuts = sorted(rng.randrange(sum(sizes) + 1) for _ in range(2))
        gaps = {"train": cuts[0], "val": cuts[1] - cuts[0], "test": sum(sizes) - cuts[1]}
        refused, placed, found = tg.assign(dict(Counter(sizes)), gaps, {}, [])
        assert (refused is None) == possible(sizes, list(gaps.values()))
        if refused is None:
            assert not placed and {k: sum(s * n for s, n in v.items()) for k, v in found.items()} == gaps
            assert sum((Counter(v) for v in found.values()), Counter()) == Counter(sizes)


@pytest.mark.parametrize("target", [0, 7, 1000, 123456])
def test_subset_of_many_groups(target):
    sizes = {s: 4000 for s in range(7, 40)}
    taken = tg.subset(sizes, target)
    assert sum(s * n for s, n in taken.items()) == target and all(n <= sizes[s] for s, n in taken.items())


def test_large_histogram_goes_split_by_split():
    sizes = {s: 10**6 // s for s in range(1, 1200)}
    total = sum(s * n for s, n in sizes.items())
    gaps = {"train": total - 3 * (total // 7), "val": total // 7, "test": 2 * (total // 7)}
    refused, _, found = tg.assign(sizes, gaps, {}, [])
    assert refused is None and {k: sum(s * n for s, n in v.items()) for k, v in found.items()} == gaps


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_pins_and_minima(spark, seed):
    rng = random.Random(seed)
    groups = [(i, rng.randint(1, 12), "test" if i % 17 == 3 else None) for i in range(160)]
    members = [(i, c) for i, _, _ in groups for c in rng.sample(["a", "b", "c", "rare"], rng.randint(1, 2)) if c != "rare" or i % 9 == 0]
    total = sum(s for _, s, _ in groups)
    targets = {"train": total * 6 // 10, "val": total * 15 // 100, "test": total // 5}
    targets["excluded"] = total - sum(targets.values())
    least = {"train": 3, "val": 2, "test": 2}
    g, m = frames(spark, groups, members)
    rows = tg.target_split(g, targets, least, m).collect()
    assert Counter(r["group_id"] for r in rows) == Counter(i for i, _, _ in groups) and not any(r["refused"] for r in rows)
    split, size = {r["group_id"]: r["split"] for r in rows}, {i: s for i, s, _ in groups}
    assert all(r["size"] == size[r["group_id"]] for r in rows)
    assert {k: sum(size[i] for i in split if split[i] == k) for k in NAMES} == targets
    assert all(split[i] == a for i, _, a in groups if a)
    for name, c in itertools.product(least, {c for _, c in members}):
        assert sum(split[i] == name for i, x in members if x == c) >= least[name]


@pytest.mark.parametrize(
    "groups,targets,least,members,reason",
    [
        ([(1, 4, None), (2, 6, None)], {"train": 5, "val": 5}, {}, [], "no choice of whole groups meets the targets"),
        ([(1, 4, None), (2, 6, None)], {"train": 4, "val": 5}, {}, [], "the targets don't add up to the images"),
        ([(1, 4, "val"), (2, 6, None)], {"train": 8, "val": 2}, {}, [], "the pinned groups of a split exceed its target"),
        ([(1, 4, None), (2, 6, None)], {"train": 4, "val": 6}, {"train": 1, "val": 1}, [(1, "a")], "a class has too few groups for the minima"),
        # both groups of the class only fit one split together
        ([(1, 4, None), (2, 6, None), (3, 10, None)], {"train": 10, "val": 10}, {"train": 1, "val": 1}, [(1, "a"), (2, "a")],
         "no choice was found that meets the targets and the class minima"),
    ],
)
def test_refusals(spark, groups, targets, least, members, reason):
    g, m = frames(spark, groups, members)
    rows = tg.target_split(g, targets, least, m).collect()
    assert [tuple(r) for r in rows] == [(None, None, None, reason)]


def test_empty(spark):
    g, m = frames(spark, [(1, 1, None)], [])
    assert tg.target_split(g.limit(0), {"train": 0, "val": 0}).count() == 0

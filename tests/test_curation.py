import random

import pytest
from pyspark.sql import functions as F

from boxloom.functions.hashing import rotate_left
from boxloom.operators import components as gr
from boxloom.operators import selection as wn
from boxloom.operators import sets as st
from boxloom.operators import similarity as sim
from boxloom.operators import splits as sp
from boxloom.operators.prefix import running


def codes(spark, n=300, seed=1, bits=64):
    """Codes with planted neighbours and one code that a third of the rows share."""
    rng = random.Random(seed)
    base = [rng.getrandbits(bits) for _ in range(n)]
    rows = []
    for b in base:
        for bit in rng.sample(range(bits), rng.randrange(0, 7)):
            b ^= 1 << bit
        rows.append(b)
    rows += base[: n // 3] + [base[0]] * (n // 3)
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in rows]
    return signed, spark.createDataFrame(list(enumerate(signed)), "id bigint, code bigint")


def bits_between(a, b):
    return bin((a ^ b) & ((1 << 64) - 1)).count("1")


@pytest.mark.parametrize("agree", [1, 2])
@pytest.mark.parametrize("k", [4, 6])
def test_banded_search_is_exact(spark, k, agree):
    rows, df = codes(spark)
    distinct = sorted(set(rows))
    brute = {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:] if bits_between(a, b) <= k}
    got = [(r.code_a, r.code_b) for r in sim.similar_pairs(df, k, agree=agree).collect()]
    assert len(got) == len(set(got)) and set(got) == brute


def test_band_keys_are_never_broadcast(spark):
    """The rows of a side multiply after the shuffle whose size decides on a broadcast."""
    a = spark.range(50).select(F.col("id").alias("a")).repartition("a")
    b = spark.range(50).select(F.col("id").alias("b")).repartition("b")
    pairs = sim.banded_join(a, b, "a", "b", 2, 64, 2)
    assert pairs.count() == sum(bits_between(x, y) <= 2 for x in range(50) for y in range(50))
    text = spark._jvm.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "simple")
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_candidate_pairs_of_a_band_never_become_rows(spark):
    """2,000 codes with an equal half share six keys; none is a pair, and no join may see them by key."""
    rng = random.Random(3)
    a = spark.createDataFrame([(rng.getrandbits(32),) for _ in range(2000)], "a bigint")
    pairs = sim.banded_join(a, a.withColumnRenamed("a", "b"), "a", "b", 2, 64, 2, ordered=True)
    text = spark._jvm.PythonSQLUtils.explainString(pairs._jdf.queryExecution(), "simple")
    assert "Generate" not in text and "_key" not in text
    codes = [r.a for r in a.collect()]
    assert pairs.count() == sum(bits_between(x, y) <= 2 for x in codes for y in codes if x < y)


def test_groups_that_cross_batches(spark):
    """Sides of a key may lie in different Arrow batches, and pairs are compared in several pieces."""
    import pyarrow as pa

    codes = list(range(-3, 40))
    keyed = sorted((side, c) for side in (0, 1) for c in codes)
    for size in (1, 7, 200):
        cuts = [keyed[i:i + size] for i in range(0, len(keyed), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in c], pa.int64()), pa.array([v for _, v in c], pa.int64())], names=["key", "code"]) for c in cuts]
        got = [p for r in sim._compare(64, 64, 1, True, iter(batches)) for p in zip(r["a"].to_pylist(), r["b"].to_pylist(), r["distance"].to_pylist())]
        assert sorted(got) == [(x, y, bits_between(x, y)) for x in codes for y in codes if x < y]


def test_copies_are_counted_not_paired(spark):
    rows, df = codes(spark)
    pairs = sim.similar_pairs(df, 4)
    assert pairs.filter("code_a = code_b").isEmpty()
    edges = sim.similarity_edges(df, 4)
    assert edges.count() < len(rows) * 4


def test_dihedral_distance_uses_both_directions(spark):
    rows, df = codes(spark, 60, bits=32)
    df = df.withColumn("variants", F.array(*[rotate_left(F.col("code"), s, 32) for s in (0, 8, 16, 24)]))
    first = {}
    for i, c in enumerate(rows):
        first.setdefault(c, i)

    def rot(c, s):
        return ((c << s) | (c >> (32 - s))) & 0xFFFFFFFF

    brute = {}
    items = sorted((i, c) for c, i in first.items())
    for x, (i, a) in enumerate(items):
        for j, b in items[x + 1:]:
            d = min(min(bits_between(rot(a, s), b), bits_between(rot(b, s), a)) for s in (0, 8, 16, 24))
            if d <= 6:
                brute[(i, j)] = d
    got = {(r.id_a, r.id_b): r.distance for r in sim.similar_pairs_dihedral(df, 6, bits=32).collect()}
    assert {k: v for k, v in got.items() if k[0] != k[1]} == brute
    assert {a for a, b in got if a == b} == {i for c, i in first.items() if rows.count(c) > 1}


def test_nearest_reference_is_exact(spark):
    rows, df = codes(spark, 90)
    ref_rows, _ = codes(spark, 30, seed=9)
    ref = spark.createDataFrame(list(enumerate(ref_rows)), "order bigint, code bigint")
    got = {r.id: (r.distance, r.nearest) for r in sim.nearest_reference(df, ref).collect()}
    assert got == {i: min((bits_between(c, r), o) for o, r in enumerate(ref_rows)) for i, c in enumerate(rows)}


def test_nearest_reference_over_blocks_sorts_no_candidates(spark, monkeypatch):
    monkeypatch.setattr(sim, "REFERENCES", 7)
    rows, df = codes(spark, 60)
    ref_rows, _ = codes(spark, 30, seed=9)
    ref = spark.createDataFrame(list(enumerate(ref_rows)), "order bigint, code bigint")
    out = sim.nearest_reference(df, ref)
    got = {r.id: (r.distance, r.nearest) for r in out.collect()}
    assert got == {i: min((bits_between(c, r), o) for o, r in enumerate(ref_rows)) for i, c in enumerate(rows)}
    assert "SortAggregate" not in spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")


def union_find(n, edges):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("shape", ["random", "chain", "hub"])
def test_components_equal_union_find(spark, shape):
    rng, n = random.Random(4), 200
    edges = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(120)],
        "chain": [(i, i + 1) for i in range(n - 1)],
        "hub": [(150, i) for i in range(n) if i != 150],
    }[shape]
    nodes = spark.range(n)
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r.id: r.component for r in gr.connected_components(nodes, df).collect()}
    assert got == union_find(n, edges)


def test_component_id_ignores_order_not_members(spark):
    a = spark.createDataFrame([(i, 0) for i in range(50)], "id bigint, component bigint")
    ids = [gr.component_id(x).first().component_id for x in (a, a.orderBy(F.col("id").desc()), a.filter("id > 0"), a.unionByName(a.filter("id = 7")))]
    assert ids[0] == ids[1] and len(set(ids)) == 3


def test_running_totals_with_one_hot_key(spark):
    rows = [(1, i, i % 7) for i in range(300)] + [(k, 0, 5) for k in range(2, 50)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    got = {(r.k, r.o): (r.total, r.pos) for r in running(df, ["k"], [F.col("o")], {"total": F.col("v"), "pos": F.lit(1)}).collect()}
    total = 0
    for o in range(300):
        total += o % 7
        assert got[(1, o)] == (total, o + 1)
    assert got[(30, 0)] == (5, 1)


def test_hash_split_is_order_free_and_group_disjoint(spark):
    rows = spark.createDataFrame([(i, f"g{i % 60}") for i in range(120)], "id int, group_id string")
    a = {(r.id, r.split) for r in sp.hash_split(rows).collect()}
    assert a == {(r.id, r.split) for r in sp.hash_split(rows.orderBy(F.col("id").desc())).collect()}
    assert sp.hash_split(rows).groupBy("group_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    assert sp.assert_splits(sp.hash_split(rows)).first().accepted


@pytest.mark.parametrize("normalised", [False, True])
def test_long_runs_of_equal_size_fill_like_single_steps(spark, normalised):
    sizes = [3] * 40 + [1] * 860
    groups = spark.createDataFrame([(i, "s", n) for i, n in enumerate(sizes)], "group_id bigint, stratum string, size bigint")
    shares = sp.DEFICIT_SHARES if normalised else sp.STRATIFIED_SHARES
    got = {(r.split, r.size): r.n for r in sp._greedy_by_deficit(groups, shares, normalised, 42).groupBy("split", "size").agg(F.count("*").alias("n")).collect()}
    total, filled, plain = float(sum(sizes)), [0] * len(shares), {}
    for size in sizes:

        def gap(k):
            short = shares[k][1] * total - filled[k]
            return short / max(shares[k][1] * total, 1) if normalised else short

        best = min(range(len(shares)), key=lambda k: (-gap(k), k))
        filled[best] += size
        plain[shares[best][0], size] = plain.get((shares[best][0], size), 0) + 1
    assert got == plain


def test_copies_across_splits_are_pairs_and_leaks(spark):
    rows = [(1, 5, "train"), (2, 5, "test"), (3, 4, "train"), (4, 1 << 40, "val"), (5, 1 << 40, "val"), (6, None, "test")]
    df = spark.createDataFrame(rows, "id bigint, code bigint, split string")
    df = df.withColumn("variants", F.array(*[rotate_left(F.col("code"), s, 64) for s in (0, 16, 32, 48)]))
    pairs = sim.similar_pairs_dihedral(df, 1)
    got = {(r.id_a, r.id_b, r.distance, r.n_a, r.n_b) for r in pairs.collect()}
    assert got == {(1, 3, 1, 2, 1), (1, 1, 0, 2, 2), (4, 4, 0, 2, 2)}
    leaks = {(r.id_a, r.id_b, r.split_a, r.split_b, r.n_a, r.n_b) for r in sim.cross_split_leaks(pairs, df).collect()}
    assert leaks == {(1, 1, "test", "train", 1, 1), (1, 3, "test", "train", 1, 1)}


def test_selection_refuses_other_splits(spark):
    cols = "candidate_id string, arm string, split string, ap300 double, ap100 double, p50_ms double"
    good = [("a", "x", "val", 0.5, 0.4, 9.0), ("b", "x", "val", 0.5, 0.4, 8.0), ("c", "x", "val", 0.5, 0.3, 1.0), ("d", "y", "val", 0.4, 0.9, 1.0)]
    rows = {r.arm: (r.candidate_id, r.recommended) for r in wn.select_candidate(spark.createDataFrame(good, cols)).collect()}
    assert rows == {"x": ("b", True), "y": ("d", False)}
    with pytest.raises(Exception, match="validation rows"):
        wn.select_candidate(spark.createDataFrame(good + [("e", "x", "test", 0.9, 0.9, 1.0)], cols)).collect()


def test_signatures_do_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (2, 1, 3.0), (2, 0, 2.0), (3, 0, 2.0)], "id int, c int, x double")
    got = {r.id: r.signature for r in st.annotation_signatures(a, "id", ["c", "x"]).collect()}
    assert got[1] == got[2] != got[3]


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(8)
    base = [[rng.randrange(40) for _ in range(16)] for _ in range(8)]
    rows = [(i, i % 2, [v + rng.randrange(3) for v in base[i % 8]]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, bucket int, pixels array<int>")
    brute = {
        (i, j) for i, b, p in rows for j, c, q in rows
        if i < j and b == c and p != q and sum(abs(x - y) for x, y in zip(p, q)) / 16 <= 0.8
    }
    got = {(r.id_a, r.id_b) for r in sim.near_copies(df, 0.8).collect()}
    assert got == brute and brute
    twice = df.unionByName(df.filter("id = 3").withColumn("id", F.lit(99)))
    same = [(r.id_a, r.id_b, r.n_a, r.mae) for r in sim.near_copies(twice, 0.8).filter("id_a = id_b").collect()]
    assert same == [(3, 3, 2, 0.0)]


@pytest.mark.parametrize("vectors,scale", [(3, 1), (3, 0.3), (3, 5000), (4096, 1)])
def test_near_copies_of_many_blocks(spark, monkeypatch, vectors, scale):
    """Cells cut into several blocks, whole numbers in narrow and wide ranges, fractions, and vectors of two lengths."""
    monkeypatch.setattr(sim, "VECTORS", vectors)
    monkeypatch.setattr(sim, "SUMS", 7)
    rng = random.Random(12)
    base = [[rng.randrange(-20, 20) for _ in range(12)] for _ in range(4)]
    kind = "double" if scale < 1 else "int"
    rows = [(i, i % 2, [(v + rng.randrange(4)) * scale for v in base[i % 4][: 12 - i % 5 // 4 * 3]]) for i in range(90)]
    df = spark.createDataFrame(rows + [(90, 0, None), (91, 0, [1 * scale, None])], f"id int, bucket int, pixels array<{kind}>")
    limit = 1.1 * scale
    brute = {}
    for i, b, p in rows:
        for j, c, q in rows:
            if i < j and b == c and p != q and len(p) == len(q):
                total = 0.0
                for x, y in zip(p, q, strict=True):
                    total += abs(x - y)
                if total / len(p) <= limit:
                    brute[b, i, j] = total / len(p)
    pairs = sim.near_copies(df, limit)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    got = {(r.bucket, r.id_a, r.id_b): r.mae for r in pairs.collect() if r.id_a != r.id_b}
    assert brute and got == brute

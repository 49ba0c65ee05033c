"""Near-duplicate search on 64-bit codes and on small grey vectors.

All searches are exact. Codes are cut into bands so that two codes within ``k`` bits must agree on
enough whole bands (pigeonhole); equal band keys meet in an equi-join and the true distance decides.
Equal codes are collapsed first: a group of copies is one code with a count, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.hashing import hamming
from boxloom.operators.grouped import whole_groups
from boxloom.operators.matching import deal
from boxloom.session import cut


#: Bits of a join key that hold the number of the choice of bands.
CHOICE_BITS = 16
#: Pairs that are compared at once, in arrays.
COMPARED = 1 << 19


def _bands(k: int, bits: int, agree: int) -> list[tuple[int, int]]:
    """(start, width) of ``k + agree`` bands; codes within ``k`` bits agree on ``agree`` of them."""
    n = k + agree
    edges = [round(i * bits / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _band(code: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _keyed(k: int, bits: int, agree: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key``, ``code``: a row per code and choice of ``agree`` bands, from rows (``code``, ``side``).

    A key is the values of the bands, then the number of their choice in ``CHOICE_BITS`` bits, and the side in the lowest bit: one
    number, which sorts by itself and takes 8 bytes of a shuffled row.
    """
    bands = _bands(k, bits, agree)
    for batch in batches:
        code, side = batch.column("code").to_numpy(), batch.column("side").to_numpy().view(np.uint64)
        cut_up = [(code.view(np.uint64) >> np.uint64(start)) & np.uint64((1 << width) - 1) for start, width in bands]
        for i, chosen in enumerate(combinations(range(len(bands)), agree)):
            value = np.zeros(len(code), np.uint64)
            for j in chosen:
                value = (value << np.uint64(bands[j][1])) | cut_up[j]
            key = (value << np.uint64(CHOICE_BITS + 1)) | np.uint64(2 * i) | side
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(code)], names=["key", "code"])


def _compare(k: int, bits: int, agree: int, ordered: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within ``k`` bits that share a key, from rows (``key``, ``code``) in order of key: of each, those of side 0, then of side 1.

    Only rows of side 0 of the last key are held. A pair counts at the first of the choices on which it agrees.
    """
    bands = _bands(k, bits, agree)
    choices = list(combinations(range(len(bands)), agree))
    masks = [np.uint64(sum(((1 << bands[j][1]) - 1) << bands[j][0] for j in chosen)).view(np.int64) for chosen in choices]
    held_key, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key, code = batch.column("key").to_numpy(), batch.column("code").to_numpy()
        one = (key & 1).astype(bool)
        own_key, own = np.concatenate([held_key, key[~one] >> 1]), np.concatenate([held, code[~one]])
        ask_key, ask = key[one] >> 1, code[one]
        first = np.searchsorted(own_key, ask_key, "left")
        many = np.searchsorted(own_key, ask_key, "right") - first
        some = many > 0
        first, many, ask, ask_key = first[some], many[some], ask[some], ask_key[some]
        ends = np.cumsum(many)
        at = 0
        while at < len(many):
            begun = int(ends[at] - many[at])
            stop = max(at + 1, int(np.searchsorted(ends, begun + COMPARED, "right")))
            size = many[at:stop]
            which = np.repeat(np.arange(at, stop), size)
            x = own[np.arange(len(which)) + np.repeat(first[at:stop] - (ends[at:stop] - size - begun), size)]
            apart = x ^ ask[which]
            distance = np.bitwise_count(apart.view(np.uint64))
            near = np.flatnonzero(distance <= k)
            at = stop
            if not len(near):
                continue
            x, y, apart, distance, choice = x[near], ask[which[near]], apart[near], distance[near], ask_key[which[near]] & ((1 << CHOICE_BITS) - 1)
            once = np.ones(len(near), bool)
            for i, mask in enumerate(masks):
                once &= (choice <= i) | ((apart & mask) != 0)
            if ordered:
                once &= x < y
            if once.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[once]), pa.array(y[once]), pa.array(distance[once].astype(np.int32))], names=["a", "b", "distance"])
        if len(key):
            last = own_key == key[-1] >> 1
            held_key, held = own_key[last], own[last]


def banded_join(
    left: DataFrame, right: DataFrame, a: str, b: str, k: int, bits: int, agree: int, ordered: bool = False
) -> DataFrame:
    """Pairs of rows with ``hamming(a, b) <= k``, each once; ``ordered`` keeps a < b only. Rows without a code are in no pair.

    Only different codes and their band keys are shuffled and sorted, by key; tasks compare those of a key as arrays, which
    takes nanoseconds a pair, and just the true pairs become rows, which meet the tables again by their codes.
    """
    def codes(df: DataFrame, code: str, side: int) -> DataFrame:
        return df.select(F.col(code).cast("long").alias("code")).filter("code IS NOT NULL").distinct().withColumn("side", F.lit(side).cast("long"))

    both = codes(left, a, 0).unionByName(codes(right, b, 1))
    keyed = both.mapInArrow(lambda rows: _keyed(k, bits, agree, rows), "key long, code long")
    dealt = keyed.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    pairs = dealt.mapInArrow(lambda rows: _compare(k, bits, agree, ordered, rows), "a long, b long, distance int")
    pairs = cut(pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "distance"))
    met = pairs.hint("merge").join(left.hint("merge"), F.col("_a") == F.col(a)).join(right.hint("merge"), F.col("_b") == F.col(b))
    return met.select(*left.columns, *right.columns, "distance")


def distinct_codes(df: DataFrame, node: str) -> DataFrame:
    return df.groupBy("code").agg(F.count("*").alias("n"), F.min(node).alias("first_id"))


def similar_pairs(df: DataFrame, k: int, node: str = "id", bits: int = 64, agree: int = 2) -> DataFrame:
    """Pairs of different codes within ``k`` bits, with how many rows hold each code."""
    codes = cut(distinct_codes(df, node))
    a = codes.select(F.col("code").alias("code_a"), F.col("n").alias("n_a"), F.col("first_id").alias("id_a"))
    b = codes.select(F.col("code").alias("code_b"), F.col("n").alias("n_b"), F.col("first_id").alias("id_b"))
    return banded_join(a, b, "code_a", "code_b", k, bits, agree, ordered=True)


def similarity_edges(df: DataFrame, k: int, node: str = "id", bits: int = 64) -> DataFrame:
    """Edges that connect what ``k``-similarity connects: copies to the first holder of their code,
    first holders of similar codes to each other."""
    from boxloom.operators.components import star_edges

    copies = star_edges(df, "code", node)
    near = similar_pairs(df, k, node, bits).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst"))
    return copies.unionByName(near)


def similar_pairs_dihedral(df: DataFrame, k: int, node: str = "id", bits: int = 64, agree: int = 2) -> DataFrame:
    """Pairs where any variant of one is within ``k`` of the other's own code.

    ``df``: node, ``code``, ``variants`` (array that includes the code). Rows with the same code and variants are one
    class, named by its least node; ``n_a`` and ``n_b`` count the rows of a class. Copies are the pair of their class
    with itself at distance 0, so no link is lost and no group of copies is paired out. Distance is the
    least over both directions. Rows without a code are in no pair.
    """
    classes = cut(df.filter(F.col("code").isNotNull()).groupBy("code", "variants").agg(
        F.min(node).alias("id"), F.count("*").alias("n")
    ))
    turned = classes.select(
        F.col("id").alias("v_id"), F.col("n").alias("v_n"), F.explode(F.array_distinct("variants")).alias("variant")
    )
    own = classes.select("id", "n", F.col("code").alias("own"))
    pairs = banded_join(turned, own, "variant", "own", k, bits, agree).filter(F.col("v_id") != F.col("id"))
    v_first = F.col("v_id") < F.col("id")
    near = pairs.groupBy(F.least("v_id", "id").alias("id_a"), F.greatest("v_id", "id").alias("id_b")).agg(
        F.min("distance").alias("distance"),
        F.max(F.when(v_first, F.col("v_n")).otherwise(F.col("n"))).alias("n_a"),
        F.max(F.when(v_first, F.col("n")).otherwise(F.col("v_n"))).alias("n_b"),
    )
    same = classes.filter("n > 1").select(
        F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0).alias("distance"), F.col("n").alias("n_a"), F.col("n").alias("n_b")
    )
    return near.unionByName(same)


def screen_holdout(df: DataFrame, holdout: DataFrame, k: int, node: str = "id", bits: int = 64) -> DataFrame:
    """Records with a variant within ``k`` of a holdout variant, and the first holdout name hit.

    ``df`` and ``holdout`` hold ``variants``; ``holdout`` also ``name``.
    """
    a = df.select(node, F.explode(F.array_distinct("variants")).alias("va"))
    # equal variants of many holdout images are one code with its first name
    b = holdout.select("name", F.explode(F.array_distinct("variants")).alias("vb")).groupBy("vb").agg(
        F.min("name").alias("name")
    )
    # all copies of one variant meet the holdout once
    codes = cut(a.select("va").distinct())
    hits = banded_join(codes, cut(b), "va", "vb", k, bits, 2).groupBy("va").agg(
        F.min("name").alias("name"), F.min("distance").alias("distance")
    )
    return a.join(hits, "va").groupBy(node).agg(F.min("name").alias("holdout"), F.min("distance").alias("distance"))


def exclude_components(labelled: DataFrame, screened: DataFrame, node: str = "id") -> DataFrame:
    """Drop every component with a screened member; the reason is its first holdout name."""
    reason = labelled.join(screened, node).groupBy("component").agg(F.min("holdout").alias("reason"))
    return labelled.join(reason, "component", "left").withColumn("kept", F.col("reason").isNull())


#: Bits of a part of a code in ``nearest_reference``.
PART = 16
#: References of a block, and tasks that share the queries of a block.
REFERENCES, SHARES = 1 << 14, 16
#: Bits of a packed neighbour that hold the place of the reference; its distance stands above them.
PLACE_BITS = 50


def _parts(codes: DataFrame, code: str, bits: int) -> DataFrame:
    """``code``, ``part``, ``value``: every ``PART`` bits of a code."""
    pieces = [F.struct(F.lit(i).alias("part"), _band(F.col(code), PART * i, PART).alias("value")) for i in range(bits // PART)]
    return codes.select("*", F.explode(F.array(*pieces)).alias("_p")).select(*codes.columns, "_p.part", "_p.value")


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nearest reference of each query in one block, packed, from rows (``key``, ``code``, ``place``) in order of ``key``:
    of each block its references, whose key is even, then its queries. Only the references of one block are held."""
    held_key, codes, places = None, [], []
    for batch in batches:
        key, code, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "code", "place"))
        code = code.view(np.uint64)
        for at in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1) if len(key) else []:
            if held_key != key[at[0]] >> 1:
                held_key, codes, places = key[at[0]] >> 1, [], []
            if key[at[0]] & 1 == 0:
                codes.append(code[at])
                places.append(place[at])
            elif codes:
                own, where = np.concatenate(codes), np.concatenate(places)
                order = np.argsort(where)  # the first of the nearest ones has the least place
                own, where = own[order], where[order]
                codes, places = [own], [where]
                asked, step = code[at], max(1, COMPARED // len(own))
                best = np.empty(len(asked), np.int64)
                for k in range(0, len(asked), step):
                    apart = np.bitwise_count(asked[k : k + step, None] ^ own[None, :])
                    first = apart.argmin(1)
                    best[k : k + step] = (apart[np.arange(len(first)), first].astype(np.int64) << PLACE_BITS) | where[first]
                yield pa.RecordBatch.from_arrays([pa.array(asked.view(np.int64)), pa.array(best)], names=["code", "best"])


def nearest_reference(queries: DataFrame, reference: DataFrame, bits: int = 64) -> DataFrame:
    """Closest reference code per query (first in reference order on ties) and exact-copy flag.

    Codes are cut into parts of ``PART`` bits. A query meets first the references that have a part in common with it; what they
    don't contain differs in each part, so a neighbour of fewer bits than parts is proven to be the nearest, and its query leaves.
    The rest is compared with all references, as arrays: a task holds one block of ``REFERENCES`` of them and streams queries by.
    Equal codes are one. Work grows as queries without a close copy times references, memory doesn't grow, as neighbours
    are packed into one long, distance before place in the reference order, whose minimum needs no sort.
    ``bits`` is a multiple of ``PART``. Without reference codes there is no row.
    """
    q = queries.filter("code IS NOT NULL").select("id", "code")
    known = reference.filter("code IS NOT NULL").groupBy(F.col("code").alias("ref_code")).agg(F.min("order").alias("order"))
    # ids of rows in global order ascend
    ref = cut(known.orderBy("order").select("ref_code", "order", F.monotonically_increasing_id().alias("place")))
    if ref.isEmpty():
        return q.select("id", F.lit(0).alias("distance"), F.lit(None).cast(ref.schema["order"].dataType).alias("nearest"), F.lit(True).alias("exact")).limit(0)
    codes = cut(q.select("code").distinct())
    packed = F.shiftleft(hamming(F.col("code"), F.col("ref_code")).cast("long"), PLACE_BITS).bitwiseOR(F.col("place"))
    met = _parts(codes, "code", bits).join(_parts(ref.drop("order"), "ref_code", bits), ["part", "value"])
    close = met.groupBy("code").agg(F.min(packed).alias("best")).filter(F.shiftright("best", PLACE_BITS) < bits // PART)
    close = cut(close)
    rest = codes.join(close, "code", "left_anti")
    blocks = -(-ref.count() // REFERENCES)
    share = lambda c: F.pmod(F.xxhash64(F.lit("share"), c), F.lit(SHARES))
    block = F.pmod(F.xxhash64(F.lit("block"), "ref_code"), F.lit(blocks))
    key = lambda block, share, side: ((F.col(block) * SHARES + F.col(share)) * 2 + side).cast("long").alias("key")
    held = ref.select(F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("s"), block.alias("b"), "ref_code", "place")
    asked = rest.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), share("code").alias("s"), "code")
    both = held.select(key("b", "s", 0), F.col("ref_code").alias("code"), "place").unionByName(asked.select(key("b", "s", 1), "code", F.lit(0).cast("long").alias("place")))
    dealt = both.repartition(blocks * SHARES, F.shiftright("key", 1)).sortWithinPartitions("key")
    far = dealt.mapInArrow(_nearest, "code long, best long").groupBy("code").agg(F.min("best").alias("best"))
    place = F.col("best").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    found = close.unionByName(far).select("code", F.shiftright("best", PLACE_BITS).cast("int").alias("distance"), place.alias("place"))
    return q.join(found, "code").join(ref.select("place", F.col("order").alias("nearest")), "place").select(
        "id", "distance", "nearest", (F.col("distance") == 0).alias("exact")
    )


#: Vectors of a block of ``near_copies``, about; a task holds two of them. Sums that are added up at once.
VECTORS, SUMS = 4096, 1 << 16


def near_copies(df: DataFrame, limit: float, node: str = "id") -> DataFrame:
    """Pairs in the same bucket whose grey vectors differ by at most ``limit`` on average.

    Identical vectors of a bucket are one class, named by its first holder, before pairs are made; ``n_a`` and
    ``n_b`` count its rows, and copies are the pair of their class with itself at 0. The
    means of two such vectors differ by no more than ``limit``, so only neighbouring mean cells of a
    bucket meet. A cell is cut into blocks of about ``VECTORS``, and every pair of blocks that may hold a pair is a piece of work of its own, whose
    vectors are compared as arrays: quadratic in the vectors of a cell, but spread over tasks and bounded in memory, and only true pairs become rows.
    ``df``: node, ``bucket``, ``pixels`` (array).
    """
    held = cut(df.groupBy("bucket", "pixels").agg(F.min(node).alias("id"), F.count("*").alias("n")))
    size = F.size("pixels")
    mean = F.aggregate("pixels", F.lit(0.0), lambda s, v: s + v.cast("double")) / size
    cell = F.floor(mean / (max(limit, 1e-9) * (1 + 1e-9)))
    rows = held.withColumn("_size", size).withColumn("_cell", cell).filter("_cell IS NOT NULL AND bucket IS NOT NULL")
    one = ["bucket", "_size"]
    blocks = cut(rows.groupBy(*one, "_cell").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("_k")))
    below, above = (blocks.select(*one, (F.col("_cell") + by).alias("_cell"), F.col("_k").alias(name)) for by, name in ((1, "_below"), (-1, "_above")))
    around = blocks.join(below, [*one, "_cell"], "left").join(above, [*one, "_cell"], "left").na.fill(0, ["_below", "_above"])
    mine = F.pmod(F.xxhash64("id"), F.col("_k")).cast("int")
    placed = rows.join(around, [*one, "_cell"]).withColumn("_mine", mine)
    upto = lambda k: F.filter(F.sequence(F.lit(0), F.greatest(F.col(k), F.lit(1)) - 1), lambda i: i < F.col(k))
    # a pair of blocks: the lower cell, whether the other cell is the next one, both blocks, and which of them the row belongs to
    unit = lambda cell, up, i, j, second: F.struct(cell.alias("_at"), F.lit(up).alias("_up"), i.alias("_i"), j.alias("_j"), second.alias("_second"))
    at, own, no, yes = F.col("_cell"), F.col("_mine"), F.lit(False), F.lit(True)
    units = F.concat(
        F.transform(upto("_k"), lambda j: unit(at, False, F.least(own, j), F.greatest(own, j), j < own)),
        F.transform(upto("_above"), lambda j: unit(at, True, own, j, no)),
        F.transform(upto("_below"), lambda i: unit(at - 1, True, i, own, yes)),
    )
    keys = [*one, "_at", "_up", "_i", "_j"]
    dealt = deal(placed.select(*one, F.inline(units), "id", "n", "pixels"), keys, [F.col("_second")])
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    made = dealt.mapInArrow(lambda b: _near_vectors(limit, b), f"bucket {kinds['bucket']}, id_1 {kinds['id']}, id_2 {kinds['id']}, n_1 long, n_2 long, mae double")
    first = F.col("id_1") < F.col("id_2")
    near = made.select(
        "bucket", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"),
        F.when(first, F.col("n_1")).otherwise(F.col("n_2")).alias("n_a"), F.when(first, F.col("n_2")).otherwise(F.col("n_1")).alias("n_b"), "mae",
    )
    same = held.filter("n > 1").select(
        "bucket", F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.lit(0.0).alias("mae")
    )
    return near.unionByName(same)


def _near_vectors(limit: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within ``limit`` of pairs of blocks; ``_second`` tells the two blocks, a block with itself has only one."""
    for rows, _ in whole_groups(batches, 1 << 62):
        start = np.flatnonzero(rows.column("_first").to_numpy(zero_copy_only=False))
        named = rows.select(["bucket", "id", "n"])
        inner, second = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_i", "_second"))
        alone = (inner == rows.column("_j").to_numpy()) & ~rows.column("_up").to_numpy(zero_copy_only=False)
        for x, y in zip(start.tolist(), [*start[1:].tolist(), rows.num_rows], strict=True):
            size = rows.column("_size")[x].as_py()
            vectors = rows.column("pixels").slice(x, y - x).flatten().to_numpy().reshape(y - x, size)
            middle = 0 if alone[x] else int(np.count_nonzero(~second[x:y]))
            for a, b, mae in _together(_vector_pairs(vectors[: None if alone[x] else middle], vectors[middle:], limit, bool(alone[x]))):
                one, two = named.take(pa.array(a + x)), named.take(pa.array(b + x + middle))
                yield pa.RecordBatch.from_arrays(
                    [one.column("bucket"), one.column("id"), two.column("id"), one.column("n"), two.column("n"), pa.array(mae)],
                    names=["bucket", "id_1", "id_2", "n_1", "n_2", "mae"],
                )


def _together(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same pairs in fewer, larger parts."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= SUMS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _vector_pairs(one: np.ndarray, two: np.ndarray, limit: float, alone: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of ``one``, row of ``two``, mean difference) up to ``limit``, each pair once if both are the same (``alone``).

    Sums are added up dimension by dimension, in order, so doubles round as in a fold; whole numbers in a narrow range take two bytes each.
    """
    if not len(one) or not len(two):
        return
    size, kind = one.shape[1], np.float64
    low, high = min(one.min(), two.min()), max(one.max(), two.max())
    if one.dtype.kind in "iu" and size * (int(high) - int(low)) < 1 << 15:
        kind, one, two = np.int16, one.astype(np.int64) - int(low), two.astype(np.int64) - int(low)
    left, right = np.ascontiguousarray(one.astype(kind).T), np.ascontiguousarray(two.astype(kind).T)
    step = max(1, SUMS // len(two))
    for at in range(0, len(one), step):
        begin = at if alone else 0  # pairs before the diagonal were met from the other side
        mine, other = left[:, at : at + step, None], right[:, begin:]
        total, apart = np.zeros((mine.shape[1], other.shape[1]), kind), np.empty((mine.shape[1], other.shape[1]), kind)
        for d in range(size):
            np.subtract(mine[d], other[d], out=apart)
            np.abs(apart, out=apart)
            np.add(total, apart, out=total)
        a, b = np.nonzero(total <= np.floor(limit * size) + 1)
        mae = total[a, b] / float(size)
        kept = mae <= limit
        if alone:
            kept &= b > a
        if kept.any():
            yield a[kept] + at, b[kept] + begin, mae[kept]


def cross_split_leaks(pairs: DataFrame, rows: DataFrame, node: str = "id") -> DataFrame:
    """Pairs of ``similar_pairs_dihedral`` whose members sit in different splits, with how many rows each split has.

    ``rows``: node, ``code``, ``variants``, ``split``. A class of copies that spans splits leaks into itself. Only
    counts per class and split are joined, so a large group of copies stays a few rows.
    """
    held = rows.groupBy("code", "variants", "split").agg(F.min(node).alias("_id"), F.count("*").alias("n"))
    named = held.groupBy("code", "variants").agg(F.min("_id").alias("id"))
    members = held.join(named, ["code", "variants"])
    a = members.select(F.col("id").alias("id_a"), F.col("split").alias("split_a"), F.col("n").alias("n_a"))
    b = members.select(F.col("id").alias("id_b"), F.col("split").alias("split_b"), F.col("n").alias("n_b"))
    apart = (F.col("split_a") != F.col("split_b")) & ((F.col("id_a") != F.col("id_b")) | (F.col("split_a") < F.col("split_b")))
    return pairs.select("id_a", "id_b", "distance").join(a, "id_a").join(b, "id_b").filter(apart)


def cross_source_counts(pairs: DataFrame, rows: DataFrame, source: str, node: str = "id") -> DataFrame:
    """How many pairs of similar rows lie across two sources: ``source_a, source_b`` (in order), ``pairs``.

    Counted from classes and their rows per source, so copies are never paired out.
    """
    across = cross_split_leaks(pairs, rows.withColumn("split", F.col(source)), node)
    return across.groupBy(F.least("split_a", "split_b").alias("source_a"), F.greatest("split_a", "split_b").alias("source_b")).agg(
        F.sum(F.col("n_a") * F.col("n_b")).alias("pairs")
    )

"""Exact, near, line and passage copies against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.llm import bagminhash, exact_dedup, lines, link, substrings
from tests.llm.cases import components, frame, odd_documents, passages, prose

ROWS = odd_documents()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.substring(F.md5(c), 1, 1)])
def test_exact_groups(spark, digest):
    """Also with a digest of one letter, where nearly every group is a collision."""
    got = exact_dedup.exact_groups(frame(spark, ROWS), keep="max", digest=digest).collect()
    want = []
    for i, t in ROWS:
        same = [j for j, u in ROWS if lowered(u) == lowered(t)]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(lowered(t).encode()).hexdigest()))
    assert Counter(map(tuple, got)) == Counter(want)


def test_exact_keeps_first(spark):
    left = exact_dedup.keep_exact(frame(spark, ROWS)).select("doc_id").collect()
    assert Counter(r[0] for r in left) == Counter([1, 3, 4, 6, 8, 10, 11, 12, 13, 14, 15, 16, 9, 9, None, None])


def test_exact_tells_texts_of_one_id_apart(spark):
    rows = [(9, "alpha"), (9, "unique beta"), (10, "alpha"), (10, "alpha"), (11, "Gamma"), (11, "gamma"), (None, "alpha")]
    left = exact_dedup.keep_exact(frame(spark, rows), keep="max").collect()
    assert Counter((r["doc_id"], r["text"].lower()) for r in left) == Counter([(9, "unique beta"), (10, "alpha"), (11, "gamma"), (None, "alpha")])
    assert left[0].asDict().keys() == frame(spark, rows).first().asDict().keys()


def overlap(a, b):
    a, b = Counter(a), Counter(b)
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0


def grams(text, k=5):
    words = (text or "").encode().lower().split()
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def near_rows():
    rng, rows = np.random.default_rng(3), []
    for group in range(12):
        words = prose(group, 90).split()
        for copy in range(9):
            changed = list(words)
            for at in rng.choice(len(words), copy % 4, replace=False):
                changed[at] = f"w{group}_{copy}_{at}"
            rows.append((len(rows), " ".join(changed)))
    rows.append((len(rows), "again and again " * 400))
    rows.append((len(rows), "again and again " * 380))
    rows.append((len(rows), "again and again " * 200))
    return rows


@pytest.mark.parametrize("rows", [near_rows(), [(i, t) for i, t in ROWS if i not in (None, 9)]])
def test_near_groups(spark, rows):
    texts = {}
    for i, t in rows:
        texts[i] = grams(t)
    want = components(sorted(texts), lambda a, b: bool(texts[a]) and overlap(texts[a], texts[b]) >= 0.8)
    got = bagminhash.near_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["group_id"] for r in got} == want
    sizes = Counter(want[i] for i, _ in rows)
    assert all(r["group_size"] == sizes[r["group_id"]] and r["kept"] == (r["id"] == r["group_id"]) for r in got)


def test_near_groups_null_ids_stay(spark):
    got = bagminhash.near_groups(frame(spark, ROWS)).filter("id IS NULL").collect()
    assert len(got) == 2 and all(r["kept"] and r["group_size"] == 1 for r in got)


def test_parity_bounds_the_difference(spark):
    """Parities differ in at most as many places as the sets do, so the bound never drops a link."""
    rng = np.random.default_rng(8)
    pairs = []
    for k in range(40):
        base = rng.integers(-(2**63), 2**63 - 1, 1 + 3 * k * k).tolist()
        pairs.append((base[: len(base) - k // 2], base[k // 3 :] + [k, -k - 1]))
    made = spark.createDataFrame([*pairs, ([], []), ([], [7])], "a array<long>, b array<long>").select("a", "b", link.parity("a").alias("pa"), link.parity("b").alias("pb"))
    for r in made.collect():
        differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(r["pa"], r["pb"], strict=True))
        assert differ <= len(set(r["a"]) ^ set(r["b"])) and differ % 2 == len(set(r["a"]) ^ set(r["b"])) % 2


def test_bag_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    values = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
    rows = np.repeat([0, 1], 60)
    made = bagminhash.bag_signatures(np.tile(values, 2), rows, np.concatenate([a, b]), 2, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((made[0] == made[1]).mean() - want) < 0.035


def test_line_groups(spark):
    rng, made = np.random.default_rng(1), []
    for group in range(14):
        line = prose(100 + group, 30)
        for copy in range(5):
            chars = list(line)
            for at in rng.choice(len(chars), copy // 2, replace=False):
                chars[at] = "#"
            made.append("".join(chars))
    rows = [(k, "\n".join(made[k::7]) + ("\n\nshort\nShort \n" if k % 2 else "")) for k in range(7)] + [(None, made[0]), (8, None), (9, "y" * 3000)]
    got = lines.line_groups(frame(spark, rows)).collect()
    places = [(i, n, " ".join(x.lower().split())) for i, t in rows for n, x in enumerate((t or "").split("\n"))]
    assert Counter((r["id"], r["line_no"]) for r in got) == Counter((i, n) for i, n, _ in places)
    texts = sorted({p for _, _, p in places if p})
    shingles = {t: {t[k : k + 12] for k in range(len(t) - 11)} or {t} for t in texts}
    linked = components(texts, lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]))
    order = lambda place: (place[0] is not None, place[0] or 0, place[1])
    want = {}
    for i, n, p in places:
        group = [(j, m) for j, m, q in places if q and p and linked[q] == linked[p]] or [(i, n)]
        want[i, n] = (*min(group, key=order), len(group), (i, n) == min(group, key=order))
    found = {(r["id"], r["line_no"]): (r["keep_id"], r["keep_line"], r["group_size"], r["kept"]) for r in got}
    # bands may miss a link, but never make one: a found group lies inside a true one
    true = {place: w[:2] for place, w in want.items()}
    assert all(true[place] == true[keep, line] for place, (keep, line, _, _) in found.items())
    assert sum(found[place] == want[place] for place in want) >= 0.9 * len(want)


def test_bands_find_pairs_at_the_threshold():
    """Pairs that share 8 of 10 shingles: all agree in a band."""
    pairs, rng = 2000, np.random.default_rng(11)
    made = rng.integers(1, 2**63, (pairs, 50)).astype(np.uint64)
    values = np.concatenate([made[:, :45], made[:, 5:]], 1).reshape(-1)
    rows = np.repeat(np.arange(2 * pairs), 45)
    signed = bagminhash.bag_signatures(values, rows, np.ones(len(values), np.int64), 2 * pairs).reshape(pairs, 2, bagminhash.BANDS, bagminhash.ROWS)
    assert (signed[:, 0] == signed[:, 1]).all(2).any(1).all()
    assert (1 - 0.8**bagminhash.ROWS) ** bagminhash.BANDS < 2.2e-4


def test_lines_sign_every_shingle(spark):
    """Lines without spaces, whose first letter differs, share nearly all shingles."""
    line = "".join("acgt"[k * k * 7 % 11 % 4] + "acgt"[k * 5 % 7 % 4] for k in range(35)) + "gattacacatgg"
    got = lines.line_groups(frame(spark, [(1, line), (2, "t" + line[1:] if line[0] != "t" else "g" + line[1:])])).collect()
    assert [(r["keep_id"], r["group_size"]) for r in got] == [(1, 2)] * 2


def test_lines_of_other_line_ends_stay(spark):
    """Every line has a row, also one without twelve characters in a row between U+2028, U+2029 or U+0085."""
    rows = [(k, end.join(["roses", "violets", "sugar", "and so"])) for k, end in enumerate(["\u2028", "\u2029", "\x85", "\u2028"])]
    got = {r["id"]: (r["keep_id"], r["group_size"]) for r in lines.line_groups(frame(spark, rows)).collect()}
    assert got[0] == got[3] == (0, 2) and set(got) == {0, 1, 2, 3}


def test_lines_leave_the_text(spark):
    docs = frame(spark, [(1, "same line of text here\nown"), (2, "same line of text here\n\nother"), (3, None)])
    out = lines.without_copies(docs, lines.line_groups(docs))
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "same line of text here\nown", 2: "\nother", 3: None}


def shared_rows():
    rng, rows = np.random.default_rng(9), []
    common = [prose(500 + k, 140).split() for k in range(4)]
    for k in range(40):
        words = prose(k, int(rng.integers(5, 120))).split()
        for _ in range(int(rng.integers(0, 3))):
            piece = common[int(rng.integers(4))]
            a = int(rng.integers(0, 80))
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = piece[a : a + int(rng.integers(30, 110))]
        rows.append((int(rng.integers(0, 10**12)), "\t".join(words[:9]) + " \n" + " ".join(words[9:])))
    return rows + [(0, "z " * 400), (5, "z " * 49), (6, "z " * 61)]


@pytest.mark.parametrize("rows", [shared_rows(), ROWS])
def test_repeated_passages(spark, rows):
    got = substrings.repeated_passages(frame(spark, rows)).select("id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(passages(rows))


@pytest.mark.parametrize("make", [exact_dedup.exact_groups, bagminhash.near_groups, lines.line_groups, substrings.repeated_passages])
def test_empty_table(spark, make):
    assert make(frame(spark, ROWS).limit(0)).count() == 0

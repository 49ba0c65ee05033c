"""The Merkle manifest against a plain version."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boxloom.llm import merkle
from tests.llm.cases import frame, odd_documents

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, at, fold):
    """(root, siblings, folded root) of one tree, by plain loops."""
    beside = []
    while len(nodes) > 1:
        start = at // 16 * 16
        run = nodes[start : start + 16]
        beside += run[: at - start] + run[at - start + 1 :]
        fold = digest(*run[: at - start], fold, *run[at - start + 1 :])
        nodes = [digest(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        at //= 16
    return nodes[0], beside, fold


def plain(rows, lowered):
    """rows: values of FIELDS; one tuple per row as ``merkle.proofs`` gives them."""
    groups = {}
    for r in rows:
        text = r[4]
        if text is not None and lowered(r[0]):
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(r[1], []).append((r[0], leaf(r), leaf([*r[:4], text])))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    for g in groups.values():
        g.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
    subroots = [climb([m[1] for m in groups[n]], 0, "")[0] for n in names]
    out = []
    for k, name in enumerate(names):
        for at, (i, own, changed) in enumerate(groups[name]):
            sub, beside, fold = climb([m[1] for m in groups[name]], at, changed)
            root, more, fold = climb(subroots, k, fold)
            out.append((i, own, sub, root, digest(*beside, *more), fold, fold == root))
    return Counter(out)


def folded(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2, "x", True) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, id long, part long, name string, leaf boolean")
    text = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    out = merkle.proofs(merkle.build(docs, FIELDS, changed={"text": text}))
    told = [merkle.hex_text(c) for c in ("leaf", "subroot", "root")]
    got = out.select("id", *told, F.sha2(merkle.hex_text("siblings"), 256), merkle.hex_text("folded_root"), "verified").collect()
    return Counter(map(tuple, got))


def rows_of(sizes):
    rng = random.Random(4)
    rows = []
    for name, n in sizes.items():
        rows += [(rng.randrange(10**6), name, rng.choice(["en", None, "é"]), rng.choice([3, None]), rng.choice(["Abc", "abc", "", None, "Ünï 漢", "X" * 9000])) for _ in range(n)]
    return rows


CASES = [
    {"a": 1}, {"a": 16}, {"a": 17, "b": 1}, {None: 5, "é": 2, "z": 1, "": 40}, {f"s{k}": 1 + k % 3 for k in range(20)}, {"hot": 4400, "x": 300, "y": 1},
]


@pytest.mark.parametrize("sizes", CASES)
def test_proofs(spark, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "BLOCKS", 2)  # so that runs are stored several times
    rows = rows_of(sizes)
    assert folded(spark, rows) == plain(rows, lambda i: i is not None and i % 3 == 0)


def test_odd_rows(spark):
    rows = [(i, "s" if k % 3 else None, "en", 0, t) for k, (i, t) in enumerate(odd_documents())]
    rows += [rows[3], rows[3], (None, "s", None, None, None), (None, "s", None, None, "B")]
    assert folded(spark, rows) == plain(rows, lambda i: i is not None and i % 3 == 0)


def test_limits_are_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert merkle.proofs(merkle.build(frame(spark, odd_documents()).limit(0), FIELDS)).count() == 0
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_merkle")]

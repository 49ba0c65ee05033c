"""Rows with nulls, empty, repeated, very long and clashing values, and plain versions of the operators."""

import hashlib
import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, node long, row long"


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choice(names) for _ in range(words))


def odd_documents():
    """(doc_id, text): every odd case that the operators define."""
    base = prose(1, 130)
    near = base.split()
    near[7] = "other"
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "One."), (5, "one."), (6, base), (7, base), (7, base), (8, " ".join(near)),
        (None, base), (None, None), (9, base.upper()), (10, prose(2, 60) + "\n" + base), (11, "☃ 漢字   ünï"), (12, prose(3, 9000)),
        (13, "x" * 5000), (14, prose(2, 60)), (15, "a b c"), (16, "12 34 56"), (9, prose(4, 70)),
    ]


def frame(spark, rows, extra=True):
    if not extra:
        return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return spark.createDataFrame([(i, t, "en", "s", 0, False, 5, 6, 7) for i, t in rows], COLUMNS)


def passages(rows, window=50):
    """(n_words, n_removed, kept_sha256) per row, window by window."""
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def components(nodes, linked):
    """Smallest node of the component of each node."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    nodes = list(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}

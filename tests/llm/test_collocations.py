"""Phrase mining against counts of everything."""

import random
import re
from collections import Counter

import pytest

from boxloom.llm import collocations
from tests.llm.cases import frame, odd_documents


def plain(rows, least, top, inside=80):
    """rows: (lang, text)."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        around = Counter()
        for p, n in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i : i + k]] = max(around[p[i : i + k]], n)
        kept = []
        for p, a in found.items():
            if 100 * around[p] >= inside * a:
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return Counter(out)


def mined(spark, rows, **how):
    docs = spark.createDataFrame([(lang, text, "x", 1, 2) for lang, text in rows], "lang string, text string, phrase string, n long, theta long")
    return Counter(map(tuple, collocations.collocations(docs, **how).collect()))


def talk(seed, lang, n, words):
    rng = random.Random(seed)
    names = [f"w{k}" if k % 7 else f"É{k}x" for k in range(words)]
    chains = [[rng.choice(names) for _ in range(rng.randint(2, 5))] for _ in range(12)]
    out = []
    for _ in range(n):
        text = []
        for _ in range(40):
            text += rng.choice(chains) if rng.random() < 0.4 else [names[int(words * rng.random() ** 3)]]
            text.append(rng.choice([" ", " ", " ", "\t ", ". ", "\n", ","]))
        joined = " ".join(text)
        out.append((lang, joined.upper() if rng.random() < 0.2 else joined))
    return out


@pytest.mark.parametrize("top,first,list_bytes", [(5, 1, 1 << 20), (25, 1, 0), (25, 3, 1 << 20), (4000, 3, 900)])
def test_growth(spark, monkeypatch, top, first, list_bytes):
    """Few asked phrases, so that the frontier stops early or has to be lowered; lists that travel and lists that are joined."""
    monkeypatch.setattr(collocations, "LIST_BYTES", list_bytes)
    monkeypatch.setattr(collocations, "FIRST", first)
    monkeypatch.setattr(collocations, "HELD", 300)
    rows = talk(1, "en", 60, 60) + talk(2, "fr", 40, 30) + talk(3, None, 15, 20) + talk(4, "und", 15, 20) + [("de", "a b"), ("de", None)]
    want = plain(rows, 4, top)
    assert len(want) > 10 and mined(spark, rows, least=4, top=top) == want


def test_counted_only_where_the_bound_asks(spark, monkeypatch):
    """The frontier leaves phrases out that can't reach the first ranks, and none that can."""
    grown = []
    once = collocations._Growth.expand
    monkeypatch.setattr(collocations._Growth, "expand", lambda self, theta: (once(self, theta), grown.append(self))[0])
    rows = talk(1, "en", 60, 60)
    assert mined(spark, rows, least=4, top=3) == plain(rows, 4, 3)
    all_threes = sum(1 for p in plain(rows, 4, 10**6, inside=10**9) if len(p[2].split()) == 3)
    assert grown[-1].counts[3].count() < all_threes


def test_nothing_survives_of_the_first_scores(spark):
    """The best-scoring pairs lie inside longer phrases, so later rounds have to settle the ranks."""
    rows = [("en", f"a{k} b{k} c{k} d{k} e{k}. x{k} y{k}. x{k}. y{k} z") for k in range(12) for _ in range(5)]
    assert mined(spark, rows, least=4, top=6) == plain(rows, 4, 6)


def test_odd_rows(spark):
    rows = odd_documents()
    want = plain([("en", t) for _, t in rows], 2, 50)
    assert Counter(map(tuple, collocations.collocations(frame(spark, rows), least=2, top=50).collect())) == want
    assert collocations.collocations(frame(spark, rows).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [(1, None), (2, "")])).count() == 0

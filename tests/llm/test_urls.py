"""URL rules and models against a plain version."""

import math
import random
import zlib
from collections import Counter

import pytest

from boxloom.llm import queries, urlmodel
from boxloom.llm.urlmodel import BACK, BINS, HELD_OUT, ORDER, STEPS


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def plain(rows, rules):
    """(id, host, path, rule, verdict, score) per row, with dictionaries and loops."""
    urls = [(i, *split(u)) for i, u in rows]
    grams = {"allow": Counter(), "block": Counter()}
    contexts = {"allow": Counter(), "block": Counter()}
    out_of = lambda host, path: zlib.crc32((host + path).encode()) % HELD_OUT == 0
    for _, host, path in urls:
        rule = rule_of(host, path, rules)
        if rule and not out_of(host, path):
            text = "\x02" + host + path + "\x03"
            for e in range(1, len(text)):
                for d in range(min(ORDER, e) + 1):
                    grams[rule.verdict][text[e - d : e + 1]] += 1
                    contexts[rule.verdict][text[e - d : e]] += 1

    def chance(kind, text, e):
        p = 1 / 256
        for d in range(min(ORDER, e) + 1):
            p = (grams[kind][text[e - d : e + 1]] + BACK * p) / (contexts[kind][text[e - d : e]] + BACK)
        return p

    def score(host, path):
        text = "\x02" + host + path + "\x03"
        steps = sum(round((math.log(chance("allow", text, e)) - math.log(chance("block", text, e))) * STEPS) for e in range(1, len(text)))
        return steps / STEPS / (len(text) - 1)

    learned = bool(grams["allow"] and grams["block"])
    cut = 0.0
    if learned:
        tried = [(math.floor(score(h, p) * BINS), rule_of(h, p, rules).verdict) for _, h, p in urls if out_of(h, p) and rule_of(h, p, rules)]
        n = Counter(v for _, v in tried)
        if n["allow"] and n["block"]:
            gain = lambda b: sum(n["allow"] if v == "block" else -n["block"] for x, v in tried if x < b)
            bins = sorted({b for b, _ in tried})
            best = min(bins, key=lambda b: (-gain(b), abs(b), b))
            cut = (best + max((b + 1 for b in bins if b < best), default=best)) / 2 / BINS
    out = []
    for i, host, path in urls:
        rule = rule_of(host, path, rules)
        s = None if rule else score(host, path) - cut if learned else 0.0
        out.append((i, host, path, rule and rule.text, rule.verdict if rule else "allow" if s >= 0 else "block", None if s is None else round(s, 4)))
    return Counter(out)


def judged(spark, rows, rules=queries.URL_RULES):
    pages = spark.createDataFrame([(i, u, "h", "p", 1.0) for i, u in rows], "page_id long, url string, host string, path string, n double")
    got = urlmodel.judge(pages, rules).select("id", "host", "path", "rule", "verdict", "score").collect()
    return Counter((*r[:5], None if r[5] is None else round(r[5], 4)) for r in got)


ODD = [
    (1, None), (2, ""), (3, "no scheme.org/"), (4, "http://"), (5, "http://EXAMPLE.org"), (6, "http://a.EXAMPLE.ORG/es/x?y#z"), (7, "x://notexample.org/es/"),
    (8, "http://example.org/en/1"), (9, "http://example.org/en/2"), (10, "https://a.com/fr/"), (11, "https://a.com/de/x"), (12, "https://com/de/"),
    (13, "http://q?x://example.org/"), (14, "http://u#://b.org/"), (15, "http://a.net/" + "é漢" * 3000), (None, "http://a.net/fr/1"), (10, "https://a.com/fr/"),
    (16, "http://a.org:80/"), (17, "http://b.a.net\n/en/\x02\x03"),
]


def made(n):
    rng = random.Random(5)
    tail = lambda k: "".join(rng.choice("abcdefgh0123456789") for _ in range(k))
    good = lambda k: (k, f"http://{rng.choice(['m.', ''])}news{rng.randrange(9)}.example.{rng.choice(['org', 'net'])}/story/{tail(6)}")
    bad = lambda k: (k, f"https://win-{tail(3)}.example.{rng.choice(['com', 'net'])}/de/casino-{rng.randrange(99)}?x={tail(4)}")
    return [rng.choice([good, bad])(k) for k in range(n)]


@pytest.mark.parametrize("rows", [ODD, made(300), made(300) + ODD, [], [(1, "http://a.org/"), (2, "http://b.net/")]])
def test_judge(spark, rows):
    assert judged(spark, rows) == plain(rows, queries.URL_RULES)


def test_models_tell_kinds_apart(spark):
    got = judged(spark, made(600))
    open_urls = [(r[1], r[2], r[4]) for r in got if r[3] is None]
    assert len(open_urls) > 100
    right = sum((verdict == "allow") == host.startswith(("news", "m.news")) for host, path, verdict in open_urls)
    assert right / len(open_urls) > 0.98


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()]
    want = Counter(r[:5] for r in plain(rows, queries.URL_RULES).elements())
    got = queries.op11_url_filters(spark, folder).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, got)) == want

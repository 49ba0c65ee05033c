"""URL filters: rules on hosts and paths first, character language models for what no rule names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.llm.common import small_side, written
from boxloom.llm.exact_dedup import lower_ascii

#: Characters of context that a model looks back on at most.
ORDER = 4
#: Weight of the shorter context's probability, in characters seen.
BACK = 4.0
#: One in so many labelled URLs sets the threshold and trains no model.
HELD_OUT = 5
#: Steps of a character's log-ratio: sums of whole numbers don't depend on their order.
STEPS = 1 << 20
#: Bins of the length-normalised score per unit, for the threshold.
BINS = 100

_START, _END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """Holds for ``host`` and its subdomains if the URL's path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return lower_ascii(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that holds, as (``text``, ``verdict``); null if none does. ``rules`` is a stated list, not data."""
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        holds = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(holds, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _framed(host: Column, path: Column) -> Column:
    return F.concat(F.lit(_START), host, path, F.lit(_END))


def _windows(text: Column) -> Column:
    """For each character after the first the string of it and up to ``ORDER`` characters before it."""
    ends = F.sequence(F.lit(2), F.length(text))
    return F.transform(ends, lambda e: F.substring(text, F.greatest(e - ORDER, F.lit(1)), F.least(e, F.lit(ORDER + 1))))


def _suffixes(window: Column) -> Column:
    """(``depth``, ``gram``): the window's last characters, with 0 to ``ORDER`` characters of context."""
    depths = F.sequence(F.lit(0), F.length(window) - 1)
    return F.transform(depths, lambda d: F.struct(d.alias("depth"), F.substring(window, -(d + 1), d + 1).alias("gram")))


def count_grams(urls: DataFrame) -> DataFrame:
    """``gram``, ``allowed``, ``blocked``: how often each string of 1 to ``ORDER`` + 1 characters ends at a character of the URLs of
    each verdict. ``urls``: ``host``, ``path``, ``verdict``, ``n`` (rows that have this URL).

    Windows are added up in the tasks before they are shuffled, then taken apart into their suffixes, so that frequent
    strings are few rows. Every URL counts; the table grows with the different strings.
    """
    windows = urls.select("verdict", "n", F.explode(_windows(_framed(F.col("host"), F.col("path")))).alias("window"))
    windows = windows.groupBy("verdict", "window").agg(F.sum("n").alias("n"))
    grams = windows.select("verdict", "n", F.explode(_suffixes(F.col("window"))).alias("s")).groupBy("s.gram")
    return grams.agg(*(F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).alias(c) for v, c in (("allow", "allowed"), ("block", "blocked"))))


def window_ratios(windows: DataFrame, grams: DataFrame) -> DataFrame:
    """``window``, ``ratio``: log-probability of its last character after the others as allowed URLs have it, less that of blocked ones.

    p(c | context) = (n(context c) + ``BACK`` p(c | shorter context)) / (n(context) + ``BACK``), from one in 256 up: contexts that
    were never seen leave the shorter one's probability as it is, so each window uses as long a context as its model knows.
    In ``STEPS`` of a natural logarithm, as a whole number.
    """
    inside = F.col("gram").substr(F.lit(1), F.length("gram") - 1)
    contexts = grams.groupBy(inside.alias("context")).agg(F.sum("allowed").alias("all_allowed"), F.sum("blocked").alias("all_blocked"))
    parts = windows.select("window", F.explode(_suffixes(F.col("window"))).alias("s")).select("window", "s.depth", "s.gram")
    parts = parts.withColumn("context", inside).join(contexts, "context", "left").join(grams, "gram", "left")
    counts = ["allowed", "all_allowed", "blocked", "all_blocked"]
    zero = [F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in counts]
    each = parts.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("depth", *zero))).alias("steps"))

    def chance(n, total):
        return F.aggregate("steps", F.lit(1 / 256), lambda p, s: (s[n] + BACK * p) / (s[total] + BACK))

    ratio = F.log(chance("allowed", "all_allowed")) - F.log(chance("blocked", "all_blocked"))
    return each.select("window", F.round(ratio * STEPS).cast("long").alias("ratio"))


def scores(urls: DataFrame, grams: DataFrame) -> DataFrame:
    """``host``, ``path``, ``score``: mean log-ratio of a URL's characters. ``urls`` are different ones."""
    each = urls.select("host", "path", F.explode(_windows(_framed(F.col("host"), F.col("path")))).alias("window"))
    ratios = written(window_ratios(each.select("window").distinct(), grams), "ratios")
    summed = each.join(small_side(ratios, F.lit(24) + F.octet_length("window")), "window").groupBy("host", "path").agg(F.sum("ratio").alias("ratio"))
    length = F.length("host") + F.length("path") + 1
    return summed.select("host", "path", (F.col("ratio") / STEPS / length).alias("score"))


def threshold(judged: DataFrame) -> float:
    """The score at which the shares of allowed URLs kept and of blocked ones dropped add up to most; of equal ones the nearest to 0,
    in the middle of the gap between it and the next lower score.

    ``judged``: ``score``, ``verdict``, ``n``. Scores are counted in bins of 1 / ``BINS``; a mean log-ratio lies within a few units,
    so there are some thousand bins. Without URLs of either verdict it is 0.
    """
    bins = judged.groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(
        *(F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n"))), F.lit(0)).alias(v) for v in ("allow", "block"))
    )
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    gap = F.coalesce(F.lag("bin").over(W.orderBy("bin")) + 1, F.col("bin"))
    least = bins.select("bin", gap.alias("gap"), *(F.coalesce(F.sum(v).over(below), F.lit(0)).alias(f"low_{v}") for v in ("allow", "block")))
    sums = bins.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    if not sums["allow"] or not sums["block"]:
        return 0.0
    wide = "decimal(19,0)"  # whole numbers, so that ties are ties
    gain = F.col("low_block").cast(wide) * F.lit(sums["allow"]).cast(wide) - F.col("low_allow").cast(wide) * F.lit(sums["block"]).cast(wide)
    best = least.orderBy(gain.desc(), F.abs("bin"), "bin").first()
    return (best["gap"] + best["bin"]) / 2 / BINS


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``id``, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    A rule decides where one holds (the longest). Its URLs are also the examples: two variable-order Markov models over the
    characters of host and path, of allowed and of blocked URLs, are smoothed from context to shorter context. A URL without a rule is allowed if its
    mean log-likelihood difference reaches the threshold that separates a held-out part of the examples best. ``score`` is that
    difference less the threshold; null where a rule decides.

    Pages are first grouped to different (host, path), with counts added up in the tasks; the models count all of them, but for the held-out
    share. Other columns, as the page's text, never move. Ratios of windows are broadcast up to a measured size, else joined by a
    shuffle whose hot windows adaptive execution splits.

    Defined results: a null URL, or one without ``://``, has an empty host and path and is judged as such. Without an example of either
    verdict all pages without a rule are allowed, with score 0. Repeated pages have a row each. URLs of any length are judged whole. An empty table gives no rows.
    """
    each = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = each.groupBy("host", "path").agg(F.count("*").alias("n"))
    urls = urls.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    held_out = F.crc32(F.concat("host", "path")) % HELD_OUT == 0
    urls = written(urls.select("host", "path", "n", F.col("found.text").alias("rule"), F.col("found.verdict").alias("verdict"), held_out.alias("held_out")), "urls")
    grams = written(count_grams(urls.filter("verdict IS NOT NULL AND NOT held_out")), "grams")
    learned = grams.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    if learned["allowed"] and learned["blocked"]:
        asked = urls.filter("verdict IS NULL OR held_out")
        scored = written(scores(asked.select("host", "path"), grams).join(urls, ["host", "path"]), "scored")
        cut = threshold(scored.filter("verdict IS NOT NULL").select("score", "verdict", "n"))
        open_urls = scored.filter("verdict IS NULL").withColumn("score", F.col("score") - cut)
    else:
        open_urls = urls.filter("verdict IS NULL").withColumn("score", F.lit(0.0))
    verdict = F.when(F.col("score") >= 0, "allow").otherwise("block")
    shown = ["host", "path", "rule", "verdict", "score"]
    settled = urls.filter("verdict IS NOT NULL").withColumn("score", F.lit(None).cast("double")).select(*shown)
    judged = written(settled.unionByName(open_urls.withColumn("verdict", verdict).select(*shown)), "judged")
    judged = small_side(judged, F.lit(80) + F.octet_length("host") + F.octet_length("path"))
    return each.join(judged, ["host", "path"]).select("id", *shown)

"""Phrases whose words belong together, mined per language by best-first growth of their prefixes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxloom.llm.common import small_side, written

#: Longest phrase, in words.
LONGEST = 4
#: Language of a text that has none.
UNKNOWN = "und"
#: Different phrases that a task holds before it passes their counts on.
HELD = 600_000
#: A list of phrases travels to the tasks up to this many bytes.
LIST_BYTES = 8 << 20
#: The first round settles scores down to that of the candidate of so many times the asked rank; each further one ``WIDER`` times as many.
FIRST, WIDER = 3, 4

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PIECES = re.compile(rb"[.,;:!?\n-\r]")


def _partial_counts(size: int, listed=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the phrases of ``size`` words in batches of (lang, text), added up in bounded memory.

    ``listed``: a broadcast pair of phrases per language, asked of a phrase without its last and without its first word.
    """

    def counted(batches):
        held: dict[str, Counter] = {}
        heads, tails = listed.value if listed else ({}, {})
        nothing = frozenset()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang, text in zip(langs, batch.column(1).cast(pa.binary()), strict=True):
                counts = held.setdefault(lang, Counter())
                low, grams = text.as_py().translate(_LOWER), []
                head, tail = heads.get(lang, nothing), tails.get(lang, nothing)
                # of bytes, split() parts at spaces and tabs, as the other white space ends a piece
                for piece in [_PIECES.sub(b" ", low)] if size == 1 else _PIECES.split(low):
                    words = piece.split()
                    if size == 1:
                        grams += words
                    elif len(words) < size:
                        continue
                    elif listed is None:
                        grams += zip(*(words[k:] for k in range(size)), strict=False)
                    elif size == 2:
                        grams += [g for g in zip(words, words[1:], strict=False) if g[0] in head and g[1] in tail]
                    else:
                        grams += [g for g in zip(*(words[k:] for k in range(size)), strict=False) if g[:-1] in head or g[1:] in tail]
                    if len(grams) > HELD:
                        counts.update(grams)
                        grams = []
                        yield from _full(held)
                counts.update(grams)
                yield from _full(held)
        yield from _emitted(held)

    return counted


def _full(held):
    if sum(map(len, held.values())) > HELD:
        yield from _emitted(held)
        held.clear()


def _emitted(held):
    for lang, counts in held.items():
        keys = list(counts)
        for first in range(0, len(keys), 50_000):
            part = keys[first : first + 50_000]
            phrases = part if isinstance(part[0], bytes) else [b" ".join(p) for p in part]
            columns = [pa.array([lang] * len(part), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array([counts[p] for p in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])


def phrase_counts(texts: DataFrame, size: int, heads: DataFrame | None = None, tails: DataFrame | None = None) -> DataFrame:
    """``lang``, ``phrase``, ``n``: occurrences of the phrases of ``size`` words.

    With ``heads`` and ``tails`` (``lang``, ``phrase``) only of those that begin with one of ``heads`` and (from three words on: or) end with
    one of ``tails``, all but one word long. Lists of a measured size travel to the tasks, which then skip the other phrases; longer ones are joined
    with the tasks' counts before these are shuffled by phrase.
    """
    schema = "lang string, phrase string, n long"
    if heads is None:
        return _summed(texts.mapInArrow(_partial_counts(size), schema))
    lists = [_small_lists(rows, size) for rows in (heads, tails)]
    if None not in lists:
        listed = texts.sparkSession.sparkContext.broadcast(tuple(lists))
        return _summed(texts.mapInArrow(_partial_counts(size, listed), schema))
    partial = texts.mapInArrow(_partial_counts(size), schema)
    partial = _marked(partial, _first(F.col("phrase"), size - 1), heads, "_head")
    partial = _marked(partial, _last(F.col("phrase"), size - 1), tails, "_tail")
    return _summed(partial.filter("_head AND _tail" if size == 2 else "_head OR _tail").drop("_head", "_tail"))


def _summed(partial: DataFrame) -> DataFrame:
    return partial.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _small_lists(rows: DataFrame, size: int) -> dict[str, frozenset] | None:
    """The phrases of ``rows`` per language as words in UTF-8, None beyond ``LIST_BYTES``."""
    if (rows.agg(F.sum(F.octet_length("phrase") + 8).alias("n")).first()["n"] or 0) > LIST_BYTES:
        return None
    found: dict[str, set] = {}
    for lang, phrase in rows.select("lang", "phrase").collect():
        words = tuple(phrase.encode().split(b" "))
        found.setdefault(lang, set()).add(words[0] if size == 2 else words)
    return {lang: frozenset(phrases) for lang, phrases in found.items()}


def _first(phrase: Column, words: int) -> Column:
    return F.substring_index(phrase, " ", words)


def _last(phrase: Column, words: int) -> Column:
    return F.substring_index(phrase, " ", -words)


def _marked(rows: DataFrame, part: Column, listed: DataFrame, name: str) -> DataFrame:
    """``name``: whether ``part`` is a phrase of ``listed`` in the row's language."""
    listed = small_side(listed, F.lit(40) + F.octet_length("phrase")).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.lit(True).alias(name))
    return rows.join(listed, (F.col("lang") == F.col("_lang")) & (part == F.col("_phrase")), "left").drop("_lang", "_phrase")


def _looked_up(rows: DataFrame, part: Column, counts: DataFrame, name: str) -> DataFrame:
    counts = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias(name))
    return rows.join(counts, (F.col("lang") == F.col("_lang")) & (part == F.col("_phrase")), "left").drop("_lang", "_phrase")


def ratio(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 a / (left + right)), exact beyond 64 bits."""
    wide = "decimal(19,0)"
    return F.call_function("div", F.lit(2000000).cast("decimal(7,0)") * a.cast(wide), left.cast(wide) + right.cast(wide))


def _cut(a: Column, k: int, left: Column, right: Column) -> Column:
    return F.struct(ratio(a, left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def _nth_score(rows: DataFrame, wanted: int) -> DataFrame:
    """``lang``, ``theta``: the score of the row of rank ``wanted`` of each language, 0 if it has fewer.

    Rows are counted per score first, of which there are at most a million and one.
    """
    bins = rows.groupBy("lang", "score").agg(F.count("*").alias("n"))
    seen = F.sum("n").over(W.partitionBy("lang").orderBy(F.desc("score")))
    reached = bins.withColumn("seen", seen).groupBy("lang").agg(F.max(F.when(F.col("seen") >= wanted, F.col("score"))).alias("theta"))
    return reached.select("lang", F.coalesce("theta", F.lit(0).cast("long")).alias("theta"))


class _Growth:
    """The counted phrases of each size, the frontier over them, and their growth by rounds."""

    def __init__(self, texts: DataFrame, least: int):
        self.texts, self.least = texts, least
        words = written(phrase_counts(texts, 1), "words")
        self.totals = written(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
        self.words = written(words.filter(F.col("n") >= least), "words")
        pairs = written(phrase_counts(texts, 2, self.words, self.words).filter(F.col("n") >= least), "pairs")
        self.counts = {1: self.words, 2: pairs}
        self.scored = {2: self._scored(pairs, 2)}

    def _scored(self, rows: DataFrame, size: int) -> DataFrame:
        """Adds ``score``, ``l``, ``r`` of the lowest-scoring cut; ``bound``: no longer phrase that begins with this one scores more; ``end_bound``:
        none that ends with it does. A phrase of ``LONGEST`` words whose last part isn't counted has no score: it is below ``theta``.
        """
        a, phrase = F.col("n"), F.col("phrase")
        for k in range(1, size):
            rows = _looked_up(rows, _first(phrase, k), self.counts[k], f"l{k}")
            rows = _looked_up(rows, _last(phrase, size - k), self.counts[size - k], f"r{k}")
        cuts = F.array(*(_cut(a, k, F.col(f"l{k}"), F.col(f"r{k}")) for k in range(1, size)))
        known = sum((F.col(f"l{k}") + F.col(f"r{k}") for k in range(1, size)), F.lit(0)).isNotNull()
        # a longer phrase occurs at most as often as this one, and its other part at least as often as itself
        for name, side in (("bound", "l"), ("end_bound", "r")):
            bounds = [ratio(a, F.col(f"{side}{k}"), a) for k in range(1, size)]
            rows = rows.withColumn(name, bounds[0] if size == 2 else F.least(*bounds))
        rows = rows.withColumn("cut", F.when(known, F.array_min(cuts)))
        return written(rows.select("lang", "phrase", "n", "bound", "end_bound", "cut.score", "cut.l", "cut.r"), "scored")

    def expand(self, theta: DataFrame) -> None:
        """Count what begins with a phrase whose ``bound`` reaches ``theta`` of its language or ends with one whose ``end_bound`` does,
        save what the round before, which went down to ``before``, has counted.

        Then the phrases of each size that score ``theta`` or more are counted, as are all their parts, and those that hold one of
        them and one word more: a phrase scores no more than the bound of any of its beginnings, or the end bound of any of its ends.
        """
        for size in range(3, LONGEST + 1):
            near = self.scored[size - 1].join(small_side(theta, 60), "lang")
            new = "{0} >= theta AND ({0} < before OR before IS NULL)"
            heads = written(near.filter(new.format("bound")).select("lang", "phrase"), "heads")
            tails = written(near.filter(new.format("end_bound")).select("lang", "phrase"), "tails")
            texts = self.texts.join(small_side(theta.select("lang"), 30), "lang", "left_semi")
            self._add(size, phrase_counts(texts, size, heads, tails).filter(F.col("n") >= self.least))
            self.scored[size] = self._scored(self.counts[size], size)

    def _add(self, size: int, found: DataFrame) -> None:
        known = self.counts.get(size)
        self.counts[size] = written(found if known is None else found.unionByName(known).distinct(), f"phrases{size}")

    def surviving(self, theta: DataFrame, inside: int) -> DataFrame:
        """Phrases that score ``theta`` or more and of which no longer one takes up ``inside`` hundredths."""
        out = None
        for size in range(2, LONGEST + 1):
            rows = self.scored[size].join(small_side(theta, 60), "lang").filter("score >= theta").drop("theta", "before")
            if size < LONGEST:  # a longer phrase that holds this one has a part that is one word longer, and as frequent at least
                held = self.scored[size + 1].select("lang", "n", F.explode(F.array(_first(F.col("phrase"), size), _last(F.col("phrase"), size))).alias("phrase"))
                most = held.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
                rows = rows.join(most, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("most") < inside * F.col("n"), F.lit(True))).drop("most")
            out = rows if out is None else out.unionByName(rows)
        return out


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int = 2000, inside: int = 80) -> DataFrame:
    """The ``top`` phrases of 2 to 4 words of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A-Z is lower-cased; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words at spaces and tabs. A candidate occurs ``least`` times
    or more (``a``). Its score is the least over its cuts of floor(2000000 a / (l + r)), l and r the counts of the two parts.
    It is dropped if a longer candidate around it occurs in ``inside`` hundredths of its places. Ranks go by score, ``a``
    and the phrase's bytes; ``n`` is the language's number of words.

    Branch and bound: pairs are counted first, of words that occur ``least`` times. A prefix's count bounds the score of
    all that begins with it, so the best bounds are expanded first: a round takes a score ``theta`` per language, counts the
    extensions of every prefix whose bound reaches it, and of every ending, to the left, whose bound does, and so settles all scores of ``theta`` or
    more. A language is done when ``top`` settled phrases survive (the last one's ties score no less), or when ``theta`` is 0; the others go on with a lower one.

    Texts are read once a round and size; counts are added up in the tasks before they are shuffled, by (language,
    phrase), so no language or word goes to one task. The frontier travels to the tasks up to a measured size, else it is joined.

    Defined results: a null text is empty, a null language is ``und`` and joins rows that say so. A text of any length is read
    whole; repeated rows count each time; ties go by the phrase. Other columns are ignored. An empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    growth = _Growth(texts, least)
    open_langs, done, wanted = growth.totals.select("lang", F.lit(None).cast("long").alias("before")), None, FIRST * top
    while True:
        theta = written(_nth_score(growth.scored[2], wanted).join(open_langs, "lang"), "theta")
        if theta.isEmpty():
            break
        growth.expand(theta)
        found = written(growth.surviving(theta, inside), "surviving")
        enough = found.groupBy("lang").agg(F.count("*").alias("n")).join(theta, "lang", "right")  # every open language has a row
        settled = written(enough.filter((F.col("theta") == 0) | (F.col("n") >= top)).select("lang"), "settled")
        part = found.join(settled, "lang", "left_semi")
        done = part if done is None else done.unionByName(part)
        open_langs = written(theta.select("lang", F.col("theta").alias("before")).join(settled, "lang", "left_anti"), "open")
        if open_langs.isEmpty():
            break
        wanted *= WIDER
    if done is None:
        done = growth.scored[2]
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase")
    ranked = done.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(growth.totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score"
    )

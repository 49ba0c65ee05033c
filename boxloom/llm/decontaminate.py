"""Benchmark passages in documents, also with other numbers, names and units in their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import small_side, written

#: Marks that type a slot; they stand before the slot's own characters. CAPITAL: any other word with a capital.
NUMBER, NAME, UNIT, CAPITAL = "\u0001", "\u0002", "\u0003", "\u0004"

#: Unit words that count as such after a number.
UNITS = (
    "mm cm m km kg g mg lb oz l ml s sec seconds min minutes h hours days weeks months years miles feet inches "
    "meters metres grams liters litres dollars euros pounds percent degrees points"
).split()

#: Tokens of a window, least tokens of a run, least tokens that are no slots in a run with changed slots.
WINDOW, RUN, LITERALS = 8, 13, 6

#: Longs of the bitmap of the codes that begin a window of the benchmark, whatever their number.
BITMAP = 1 << 14

#: Scripts without spaces between words: each character is a token.
_DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_LETTER = rf"[\p{{L}}\p{{M}}&&[^{_DENSE}]]"
#: ASCII stands first in its class, and is kept from the look-up of scripts.
_TOKEN = rf"[\x{{1}}-\x{{4}}]?[a-zA-Z0-9[\p{{L}}\p{{M}}\p{{N}}&&[^{_DENSE}]]]+(?:[.,]\p{{N}}+)*|(?=[^\x{{0}}-\x{{7f}}])[{_DENSE}&&[\p{{L}}\p{{N}}]]\p{{M}}*"


def marked(text: Column) -> Column:
    """Text with a mark before every number, every unit after a number, and every name, and white space as one space.

    A name is a capitalised word after a word or a comma, so not at the start of a sentence; there it gets a mark of its own.
    """
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}\x{85}\x{1}-\x{4}]+", " ")
    text = F.regexp_replace(text, rf"(?i)(?<=\p{{N}} ?)({'|'.join(UNITS)})(?![\p{{L}}\p{{M}}\p{{N}}])", f" {UNIT}$1")
    text = F.regexp_replace(text, r"(?<=[\p{Ll},;] )(\p{Lu}[\p{L}\p{M}]*)", f"{NAME}$1")
    text = F.regexp_replace(text, r"(?<![\p{L}\p{M}\p{N}\x{2}\x{3}])(\p{Lu}[\p{L}\p{M}]*)", f"{CAPITAL}$1")
    return F.regexp_replace(text, rf"(?=\p{{N}})(?<![\p{{N}}.,]|{_LETTER})(\p{{N}}+(?:[.,]\p{{N}}+)*)(?!{_LETTER})", f"{NUMBER}$1")


def slot_tokens(text: Column) -> Column:
    """Lower-case tokens; a slot, or a word with a capital, keeps its mark and its value."""
    return F.regexp_extract_all(F.lower(marked(text)), F.lit(_TOKEN), F.lit(0))


def _value(token: Column) -> Column:
    return F.when(token < "\u0005", F.substring(token, 2, 1 << 30)).otherwise(token)


def _once(x: Column, use) -> Column:
    """``use`` of ``x``, bound once; inside a lambda it would be made anew per element."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _hashes(tokens: Column, length: int) -> Column:
    """Hash of every window of ``length`` codes, in order."""
    last = F.size(tokens) - length + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(tokens, i, length)))).otherwise(F.array().cast("array<bigint>"))


def _readings(tokens: Column) -> list[Column]:
    """Codes of the tokens in three readings: a placeholder for numbers and units, and none, for names, or for every word with a capital."""
    typed = lambda t: F.when(t < NAME, F.lit(NUMBER)).when((t >= UNIT) & (t < CAPITAL), F.lit(UNIT))
    marked = lambda t, other: F.xxhash64(F.when(t < "\u0005", F.coalesce(typed(t), other)).otherwise(t))
    plain = lambda t: marked(t, _value(t))
    named = lambda t: marked(t, F.when(t < UNIT, F.lit(NAME)).otherwise(_value(t)))
    capital = lambda t: marked(t, F.lit(NAME))
    return [F.transform(tokens, code) for code in (plain, named, capital)]


def _place(codes: Column, k: Column) -> tuple[Column, Column]:
    """Long and bit in the bitmap of the three codes from position ``k`` (from 0) on, with which a window begins. Each is looked up once."""
    long = F.get(codes, k).bitwiseXOR(F.shiftright(F.get(codes, k + 1), 1)).bitwiseAND(F.lit(BITMAP - 1).cast("long"))
    return long.cast("int"), F.get(codes, k + 2).bitwiseAND(F.lit(63).cast("long")).cast("int")


def _windows(tokens: Column, lengths: list[int], bitmap: Column | None = None) -> Column:
    """(``at``, ``h``, ``long``, ``bit``) of every window of ``WINDOW`` tokens in three readings (see ``_readings``), and of plain windows of ``lengths``.

    With a ``bitmap``, of the former only those whose first codes may begin a window of the benchmark in some reading; hashes are made for these only.
    """
    def of(codes: Column) -> Column:
        last = F.size(codes) - WINDOW
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        if bitmap is not None:
            def known(k: Column) -> Column:
                long, bit = _place(codes, k)
                return F.call_function("shiftright", F.get(bitmap, long), bit).bitwiseAND(F.lit(1).cast("long")) == 1

            at = F.filter(at, known)
        h = lambda k: F.xxhash64(F.slice(codes, k + 1, WINDOW))
        place = lambda k: [c.alias(name) for c, name in zip(_place(codes, k), ("long", "bit"), strict=True)]
        return F.transform(at, lambda k: F.struct(k.alias("at"), h(k).alias("h"), *place(k)))

    made = [_once(codes, of) for codes in _readings(tokens)]
    at = lambda h, k: F.struct(k.alias("at"), h.alias("h"), F.lit(0).alias("long"), F.lit(0).alias("bit"))
    whole = lambda n: lambda c: _hashes(c, n)
    made += [F.transform(_once(F.transform(tokens, lambda t: F.xxhash64(_value(t))), whole(n)), at) for n in lengths]
    return F.concat(*made)


def _bitmap(item_windows: DataFrame) -> Column:
    """``BITMAP`` longs in which the places of all windows of the benchmark are set: a number of rows that no benchmark exceeds."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    found = item_windows.groupBy(F.col("long").alias("k")).agg(F.bit_or(one).alias("bits")).collect()
    bits = dict.fromkeys(range(BITMAP), 0) | {r["k"]: r["bits"] for r in found}
    return F.split(F.lit(",".join(str(bits[k]) for k in range(BITMAP))), ",").cast("array<bigint>")


def _runs(flags: str) -> Column:
    """(first, last) position, from 1, of every maximal run of true in an array column."""
    n = F.size(flags)
    on = lambda k: F.coalesce(F.get(flags, k), F.lit(False))
    first = F.filter(F.sequence(F.lit(1), n), lambda k: on(k - 1) & ~on(k - 2))
    last = F.filter(F.sequence(F.lit(1), n), lambda k: on(k - 1) & ~on(k))
    return F.arrays_zip(first.alias("first"), last.alias("last"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Matches of documents with benchmark items: ``id``, ``item``, ``at``, ``item_at``, ``tokens``, ``slots``, ``changed``.

    Windows of ``WINDOW`` tokens of every document are joined with the benchmark's by their hash, in three readings (see
    ``_windows``). On each diagonal of a hit the tokens themselves are compared over the whole item, and the maximal runs of
    equal positions are taken by three rules: equal values; equal templates, where numbers, units and names may change; and
    the same with every word with a capital on both sides as a name. A run counts if it has ``RUN`` tokens or the whole
    item and, if a slot changed, ``LITERALS`` tokens that are no slots and consistent slots: wherever the item repeats a value, the
    document repeats its own. Equal values over a part of an inconsistent run of templates are another question on the same
    frame and don't count. ``changed``: slots whose value differs.

    An item of under ``WINDOW`` tokens is searched whole, by equal values.

    The benchmark's distinct hashes are broadcast only up to a measured size, else the windows are shuffled;
    texts travel only for documents with a hit, by a join on the id.

    Defined results: null texts are empty and match nothing, items without a token match nothing,
    rows with null ids match nothing. Rows that repeat an id and text are one document.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).filter("item IS NOT NULL").distinct()
    items = items.select("item", slot_tokens(F.col("text")).alias("i_raw")).filter(F.size("i_raw") > 0)
    items = written(items.withColumn("key", F.monotonically_increasing_id()), "items")
    # at most WINDOW - 1 numbers
    lengths = sorted(r[0] for r in items.select(F.size("i_raw").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())
    own = F.when(F.size("i_raw") >= WINDOW, _windows(F.col("i_raw"), [])).otherwise(
        F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.transform("i_raw", lambda t: F.xxhash64(_value(t)))).alias("h"), F.lit(0).alias("long"), F.lit(0).alias("bit")))
    )
    item_windows = written(items.select("key", F.inline(own)).select("key", F.col("at").alias("item_at"), "h", "long", "bit").distinct(), "windows")
    bitmap = _bitmap(item_windows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    doc_windows = rows.select("id", F.inline(_once(slot_tokens(F.col("text")), lambda t: _windows(t, lengths, bitmap))))
    hit = doc_windows.select("id", "at", "h").join(small_side(item_windows.select("key", "item_at", "h"), 48), "h").select("id", "key", (F.col("at") - F.col("item_at")).alias("d")).distinct()
    hit = written(hit, "hits")
    found = hit.select("id").distinct()
    texts = rows.join(small_side(written(found, "found"), 24), "id", "left_semi").distinct()
    texts = texts.select("id", slot_tokens(F.col("text")).alias("d_raw"))
    both = hit.join(small_side(items, F.lit(64) + 40 * F.size("i_raw")), "key").join(texts, "id")
    skip, size = F.greatest(-F.col("d"), F.lit(0)), F.size("i_raw")
    many = F.least(size - skip, F.size("d_raw") - F.greatest("d", F.lit(0)))
    both = both.filter(many > 0).select(
        "id", "item", size.alias("size"), skip.alias("skip"), F.greatest("d", F.lit(0)).alias("begin"),
        F.arrays_zip(F.slice("i_raw", skip + 1, many).alias("i"), F.slice("d_raw", F.greatest("d", F.lit(0)) + 1, many).alias("d")).alias("both"),
    )
    kind = lambda t: F.when(t < "\u0005", F.substring(t, 1, 1)).otherwise("")
    same = F.transform("both", lambda p: F.struct(
        _value(p.i).alias("i"), _value(p.d).alias("d"), kind(p.i).alias("ki"), kind(p.d).alias("kd")
    ))
    both = written(both.withColumn("both", same), "aligned")
    alike = lambda p: (p.ki == p.kd) & p.ki.isin(NUMBER, UNIT)
    # as before: a slot needs a slot of its type, a literal an equal literal
    slot = lambda k: F.when(k == CAPITAL, "").otherwise(k)
    narrow = lambda p: (slot(p.ki) == slot(p.kd)) & (p.ki.isin(NUMBER, NAME, UNIT) | (p.i == p.d))
    wide = lambda p: (p.i == p.d) | alike(p) | (p.ki.isin(NAME, CAPITAL) & p.kd.isin(NAME, CAPITAL))
    rules = {"plain": lambda p: p.i == p.d, "narrow": narrow, "wide": wide}
    flagged = both.select("*", *(F.transform("both", rule).alias(f"f_{name}") for name, rule in rules.items()))
    flagged = written(flagged.withColumn("diagonal", F.monotonically_increasing_id()), "flagged")
    of = lambda name: lambda r: F.struct(F.lit(name).alias("rule"), r["first"].alias("first"), r["last"].alias("last"))
    spans = F.concat(*(F.transform(_runs(f"f_{name}"), of(name)) for name in rules))
    runs = flagged.select("id", "item", "size", "skip", "begin", "both", "diagonal", F.explode(spans).alias("r"))
    runs = runs.filter((F.col("r.last") - F.col("r.first") + 1 >= F.least(F.lit(RUN), "size")) & ((F.col("size") >= WINDOW) | (F.col("r.rule") == "plain")))
    runs = runs.withColumn("part", F.slice("both", F.col("r.first"), F.col("r.last") - F.col("r.first") + 1))
    # slots of the item, and words with a capital that changed
    pairs = F.filter("part", lambda p: p.ki.isin(NUMBER, NAME, UNIT) | (p.i != p.d))
    runs = runs.withColumn("pairs", F.transform(pairs, lambda p: F.struct(p.i.alias("i"), p.d.alias("d"))))
    # a changed value must be changed wherever the item repeats it, also where it is no slot
    names = F.transform("pairs", lambda p: p.i)
    held = F.array_distinct(F.transform(F.filter("part", lambda p: (p.ki != "") & F.array_contains(names, p.i)), lambda p: F.struct(p.i.alias("i"), p.d.alias("d"))))
    strict = F.array_distinct("pairs")
    distinct_names = F.size(F.array_distinct(names))
    consistent = F.when(F.col("r.rule") == "wide", F.size(held) == distinct_names).otherwise(F.size(strict) == distinct_names)
    runs = runs.withColumns({"tokens": F.col("r.last") - F.col("r.first") + 1, "slots": F.size("pairs"), "consistent": consistent})
    runs = runs.withColumn("changed", F.size(F.filter("pairs", lambda p: p.i != p.d)))
    runs = written(runs.drop("both", "part", "pairs"), "runs")
    frame = runs.filter("r.rule = 'narrow' AND NOT consistent").select("diagonal", F.col("r.first").alias("ff"), F.col("r.last").alias("fl"))
    inside = (F.col("a.diagonal") == F.col("b.diagonal")) & (F.col("a.r.first") >= F.col("ff")) & (F.col("a.r.last") <= F.col("fl")) & (F.col("a.r.rule") == "plain") & (F.col("a.tokens") < F.col("a.size"))
    left = runs.alias("a").join(frame.alias("b"), inside, "left_anti")
    sound = (F.col("r.rule") == "plain") | (F.col("changed") == 0) | (F.col("consistent") & (F.col("tokens") - F.col("slots") >= LITERALS))
    return left.filter(sound).select(
        "id", "item", (F.col("begin") + F.col("r.first") - 1).alias("at"), (F.col("skip") + F.col("r.first") - 1).alias("item_at"),
        F.col("tokens").cast("long").alias("tokens"), "slots", "changed",
    ).distinct()


def verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``contaminated``, ``n_items``, ``first_item``, ``longest_run``, ``changed_slots``."""
    found = contamination(docs, benchmark, id_col, text_col).groupBy(F.col("id").alias("hit_id")).agg(
        F.count_distinct("item").alias("n_items"), F.min("item").alias("first_item"), F.max("tokens").alias("longest_run"),
        F.max("changed").alias("changed_slots"),
    )
    found = small_side(written(found, "verdicts"), 64)
    return docs.select(F.col(id_col).alias("id")).join(found, F.col("id") == F.col("hit_id"), "left").select(
        "id", F.col("hit_id").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item",
        F.coalesce("longest_run", F.lit(0)).alias("longest_run"), F.coalesce("changed_slots", F.lit(0)).alias("changed_slots"),
    )

"""Windows of documents that are hashed: those whose first codes begin a window of the benchmark."""

from pyspark.sql import functions as F

from boxloom.llm import decontaminate as dc


def test_bitmap_keeps_every_hit_and_little_else(spark):
    item = "the small red Engine of 12 wagons left Paris at noon, and 3 miles later it stopped for Anna"
    other = " ".join(f"wort{i}" for i in range(400))
    docs = spark.createDataFrame([(1, other), (2, f"{other} {item} {other}"), (3, item.replace("12", "77").replace("Paris", "Rome")), (4, "short text"), (5, "")], "id int, text string")
    items = spark.createDataFrame([(item,)], "text string").select(F.inline(dc._windows(dc.slot_tokens(F.col("text")), [])))
    bitmap = dc._bitmap(items)
    every = docs.select("id", F.inline(dc._windows(dc.slot_tokens(F.col("text")), [])))
    some = docs.select("id", F.inline(dc._windows(dc.slot_tokens(F.col("text")), [], bitmap)))
    hits = lambda w: sorted(map(tuple, w.join(items.select("h").distinct(), "h").select("id", "at", "h").distinct().collect()))
    assert hits(some) == hits(every) and {i for i, _, _ in hits(some)} == {2, 3}
    assert some.count() < every.count() / 10


def test_tokens_of_all_scripts(spark):
    text = "Ab1 漢字 かな ก็ é1,5 x́y 12.5kg ⅷ a漢b 3 Δx"
    got = spark.range(1).select(dc.slot_tokens(F.lit(text)).alias("t")).first().t
    assert [t.lstrip("\x01\x02\x03\x04") for t in got] == ["ab1", "漢", "字", "か", "な", "ก็", "é1,5", "x́y", "12.5", "kg", "ⅷ", "a", "漢", "b", "3", "δx"]

"""Fuzzy copies of lines: MinHash of character shingles, bands, exact Jaccard, one line per component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import small_side, written
from boxloom.llm.link import linked_groups, overlap

#: Characters of a shingle, least Jaccard similarity of a link.
SHINGLE, THRESHOLD = 12, 0.8
#: A pair at 0.8 misses every band with probability 8e-4.
BANDS, ROWS = 10, 3

#: Signatures and verification read all shingles.
_EVERY = r"(?s)(?=(.{%d}))" % SHINGLE


def plain_line(line: Column) -> Column:
    """Lower case, runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def _shingles(line: Column) -> Column:
    found = F.regexp_extract_all(line, F.lit(_EVERY), F.lit(1))
    return F.when(F.char_length(line) < SHINGLE, F.array(line)).otherwise(found)


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``line_no`` (from 0), ``line`` for every line of every text; a null text is one empty line."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(lines).alias("line_no", "line"))


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per line: ``id``, ``line_no``, ``keep_id``, ``keep_line``, ``group_size``, ``kept``.

    Lines are compared after ``plain_line``. Distinct lines get MinHash signatures of their character shingles (a
    shorter line is its own shingle); lines that share a band are linked if the Jaccard similarity of all their
    shingles is at least ``threshold``; union-find by rounds of joins makes components, and of each the first
    line, by id and number, stays. Lines travel as 128-bit digests; the texts are shuffled once, to
    meet their copies, and once more only for lines that share a band.

    Defined results: empty lines are no copies, all stay and are groups of their own. A null id sorts first.
    A repeated (id, line number), from a repeated row, is a copy like any other line: only one row with that
    place is kept per row of ``docs`` that has it. Other columns are ignored; an empty table gives no rows.
    """
    places = split_lines(docs, id_col, text_col).select("id", "line_no", plain_line(F.col("line")).alias("plain"))
    digest = F.unhex(F.md5("plain"))
    full = places.filter("plain != ''").select(digest.alias("digest"), "plain")
    # one row per distinct line in the partition of its digest, where its shingles are then reduced
    lines = full.groupBy("digest").agg(F.first("plain").alias("plain"))
    # outer: a line has a row, whatever is found in it
    shingle = lines.select("digest", F.explode_outer(_shingles(F.col("plain"))).alias("s")).select("digest", F.xxhash64("s").alias("h"))
    registers = BANDS * ROWS
    masks = [((i * 2**64) // registers + 0x1F3D5B79A8C6E402 * (i + 1)) % 2**64 for i in range(registers)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    # the least of h XOR mask: each register orders the hashes in its own way
    mins = shingle.groupBy("digest").agg(*(F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(signed)))
    keys = F.array(*(F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)))
    lines = written(mins.select(F.monotonically_increasing_id().alias("node"), "digest", keys.alias("keys")), "lines")
    bands = lines.select("node", F.explode("keys").alias("key"))

    def features(nodes: DataFrame) -> DataFrame:
        wanted = written(lines.select("node", "digest").join(small_side(nodes, 16), "node"), "wanted")
        texts = full.join(small_side(wanted, 64), "digest").dropDuplicates(["node"])
        every = F.array_distinct(F.transform(_shingles(F.col("plain")), lambda s: F.xxhash64(s)))
        return texts.select("node", every.alias("feature"))

    groups = linked_groups(bands, features, overlap, threshold)
    named = lines.select("node", "digest").join(groups, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    located = places.select("id", "line_no", F.when(F.col("plain") != "", digest).alias("digest"))
    place = F.struct("id", "line_no")
    tied = located.filter("digest IS NOT NULL").join(named, "digest").select("id", "line_no", "component")
    tied = written(tied, "tied")
    heads = tied.groupBy("component").agg(F.min(place).alias("head"), F.count("*").alias("group_size"))
    out = tied.join(heads, "component").select(
        "id", "line_no", F.col("head.id").alias("keep_id"), F.col("head.line_no").alias("keep_line"), "group_size",
        place.eqNullSafe(F.col("head")).alias("kept"),
    )
    lone = located.filter("digest IS NULL").select(
        "id", "line_no", F.col("id").alias("keep_id"), F.col("line_no").alias("keep_line"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    return out.unionByName(lone)


def without_copies(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that don't stay taken out of the text; rows with a null id stay as they are."""
    gone = groups.filter(~F.col("kept")).groupBy(F.col("id").alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_gone"), i))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.concat_ws("\n", left))
    return docs.join(gone, F.col(id_col) == F.col("_id"), "left").withColumn(text_col, text).select(*docs.columns)

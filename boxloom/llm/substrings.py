"""Long repeated passages across documents: a compacted de Bruijn graph of word windows, verified at its sources."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import small_side, written
from boxloom.llm.words import mix, rounds, sliding_min, spans_of, text_bytes, word_hashes, word_spans

WINDOW = 50
#: Words of an anchor. Each window holds the one with the least hash of its WINDOW - ANCHOR + 1 anchors.
ANCHOR = 16


def _parts(batch: pa.RecordBatch):
    buffer, offsets = text_bytes(batch.column("text"))
    for first, last in rounds(offsets):
        own = offsets[first : last + 1]
        starts, ends, row = word_spans(buffer, own)
        yield first, last, buffer[own[0] : own[-1]], starts, ends, row


def _least_anchors(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start of WINDOW words of one row: whether it is one, and the least anchor hash inside."""
    anchors = spans_of(hashes, ANCHOR)
    least = sliding_min(anchors, WINDOW - ANCHOR + 1)
    valid = row[: len(least)] == row[WINDOW - 1 :] if len(least) else np.zeros(0, bool)
    return valid, least


def _texts(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: np.ndarray) -> Iterator[bytes]:
    last = np.cumsum(count)
    for a, b in zip(last - count, last, strict=True):
        yield part[starts[a] : ends[b - 1]].tobytes() if b > a else b""


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word count, digest of the words, and the anchors of all windows of each text."""
    for batch in batches:
        for first, last, part, starts, ends, row in _parts(batch):
            n = last - first
            count = np.bincount(row, minlength=n)
            hashes = word_hashes(part, starts, ends, 2)
            valid, least = _least_anchors(hashes, row)
            least, of = least[valid], row[: len(valid)][valid]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=n))]).astype(np.int32)
            digest = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in _texts(part, starts, ends, count)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(first, n), pa.array(count.astype(np.int64)), pa.array(digest), pa.ListArray.from_arrays(offsets, least[new].view(np.int64))],
                names=["id", "n_words", "sha", "anchors"],
            )


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the graph: 128-bit hash and place of every window with an anchor that another text has."""
    for batch in batches:
        hot = batch.column("hot")
        for first, last, part, starts, ends, row in _parts(batch):
            n = last - first
            one, two = word_hashes(part, starts, ends, 2), word_hashes(part, starts, ends, 3)
            valid, least = _least_anchors(one, row)
            if not len(least):
                continue
            # a (row, anchor) pair is looked up among the row's own repeated anchors
            asked = hot.slice(first, n)
            flat = asked.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.repeat(np.arange(n), asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            salt = lambda r: mix(r.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            valid &= np.isin(least ^ salt(row[: len(least)]), flat ^ salt(of))
            at = np.flatnonzero(valid)
            count = np.bincount(row, minlength=n)
            begin = np.cumsum(count) - count
            ids = batch.column("id").slice(first, n).take(pa.array(row[at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(spans_of(one, WINDOW)[at].view(np.int64)), pa.array(spans_of(two, WINDOW)[at].view(np.int64)), ids, pa.array((at - begin[row[at]]).astype(np.int32))],
                names=["h1", "h2", "id", "at"],
            )


def _span_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit digest of the words of each asked span (at, words) of a text."""
    for batch in batches:
        out_id, out_at, out_words, out_digest = [], [], [], []
        for row in batch.to_pylist():
            words = row["text"].encode().split()
            for span in row["spans"]:
                out_id.append(row["id"])
                out_at.append(span["at"])
                out_words.append(span["words"])
                out_digest.append(hashlib.blake2b(b" ".join(words[span["at"] : span["at"] + span["words"]]), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(out_id, pa.int64()), pa.array(out_at, pa.int32()), pa.array(out_words, pa.int32()), pa.array(out_digest, pa.binary())],
            names=["src", "src_at", "words", "digest"],
        )


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each span with its source's digest and take the spans that agree out of the text."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            words = row["text"].encode().split()
            keep = np.ones(len(words), bool)
            for span in row["spans"]:
                a, b = span["at"], span["at"] + span["words"]
                if hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest() == span["digest"]:
                    keep[a:b] = False
            left = b" ".join(w for w, k in zip(words, keep, strict=True) if k)
            out.append((row["id"], row["sha"], int((~keep).sum()), hashlib.sha256(left).hexdigest(), left.decode()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())],
            names=["id", "sha", "n_removed", "kept_sha", "kept_text"],
        )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept_text`` (null: all words stay).

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of ``WINDOW`` words over it also starts in a text with a
    smaller id; windows are those of the input.

    1. Every text gives a digest of its words and, of each window, its least anchor (``ANCHOR`` words). A text whose
       words equal those of a smaller id goes as a whole and takes no further part.
    2. Equal windows have equal least anchors, so only windows whose anchor another text has can
       be repeated. These are the edges of the de Bruijn graph, keyed by a 128-bit hash of their words.
    3. Each edge takes its smallest id and place (a partial aggregate) as source, by a join whose hot keys adaptive execution splits.
    4. Edges of a text that follow each other and whose sources do too are a nonbranching path, compacted to one span.
    5. A span's words are compared with its source's by a 128-bit digest of the words at both places before they go.

    Only texts with a repeated anchor are written again for steps 2 to 5.

    Defined results: a null text has no words. A row with a null id stays whole and is no source. Rows of one id don't
    remove each other's words. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    survey = written(rows.mapInArrow(_survey, "id long, n_words long, sha string, anchors array<long>"), "survey")
    first = survey.filter(f"id IS NOT NULL AND n_words >= {WINDOW}").groupBy("sha").agg(F.min("id").alias("first"))
    heads = written(survey.join(first, "sha").select("id", "sha", "first", F.when(F.col("id") == F.col("first"), F.col("anchors")).alias("anchors")), "heads")
    anchors = heads.filter("id = first").select("id", F.explode("anchors").alias("a"))
    many = anchors.groupBy("a").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high").select("a")
    hot = written(anchors.join(many, "a").groupBy("id").agg(F.collect_set("a").alias("hot")), "anchors")
    texts = rows.join(small_side(hot, F.lit(32) + 8 * F.size("hot")), "id")
    joined = F.concat_ws(" ", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    texts = written(texts.withColumn("sha", F.sha2(joined, 256)).dropDuplicates(["id", "sha"]), "texts")
    edges = texts.mapInArrow(_edges, "h1 long, h2 long, id long, at int")
    source = edges.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("src"), F.max("id").alias("high")).filter("src.id != high")
    pointed = edges.join(source.select("h1", "h2", "src"), ["h1", "h2"]).filter("src.id < id").select(
        "id", F.col("src.id").alias("src"), "at", F.col("src.at").alias("src_at")
    )
    # paths: consecutive edges on one diagonal of (text, source)
    diagonal = Window.partitionBy("id", "src", F.col("at") - F.col("src_at")).orderBy("at")
    path = pointed.distinct().withColumn("isle", F.col("at") - F.row_number().over(diagonal))
    spans = path.groupBy("id", "src", (F.col("at") - F.col("src_at")).alias("d"), "isle").agg(
        F.min("at").alias("at"), F.min("src_at").alias("src_at"), (F.count("*") + WINDOW - 1).cast("int").alias("words")
    )
    spans = written(spans.select("id", "src", "at", "src_at", "words"), "spans")
    asked = spans.select("src", "src_at", "words").distinct()
    # a source may be asked for by most of the corpus: its spans come in groups
    asked = asked.groupBy("src", F.pmod(F.xxhash64("src_at", "words"), F.lit(8)).alias("salt")).agg(F.collect_list(F.struct(F.col("src_at").alias("at"), "words")).alias("spans"))
    asked = written(asked.select(F.col("src").alias("id"), "spans"), "asked")
    sourced = texts.select("id", "text").join(small_side(asked, F.lit(40) + 24 * F.size("spans")), "id").mapInArrow(
        _span_digests, "src long, src_at int, words int, digest binary"
    )
    sourced = written(sourced.distinct(), "sources")
    proven = spans.join(sourced, ["src", "src_at", "words"]).groupBy("id").agg(F.collect_list(F.struct("at", "words", "digest")).alias("spans"))
    proven = written(proven, "proven")
    cut = texts.select("id", "sha", "text").join(small_side(proven, F.lit(40) + 48 * F.size("spans")), "id")
    cut = written(cut.mapInArrow(_cut_out, "id long, sha string, n_removed long, kept_sha string, kept_text string"), "cut")
    later = heads.filter("first < id").select("id", "sha").distinct().withColumn("whole", F.lit(True))
    # a row is named by its id and the digest of its words, as an id may stand for several texts
    out = survey.select("id", "n_words", "sha").join(later, ["id", "sha"], "left").join(cut, ["id", "sha"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    whole = F.coalesce("whole", F.lit(False))
    return out.select(
        "id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, empty).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )

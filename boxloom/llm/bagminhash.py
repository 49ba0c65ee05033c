"""Near copies of documents: BagMinHash signatures of word shingles, bands, verified multiset overlap."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import small_side, written
from boxloom.llm.link import linked_groups, overlap
from boxloom.llm.words import mix, rounds, spans_of, text_bytes, word_hashes, word_spans

SHINGLE, THRESHOLD = 5, 0.8
#: Registers of a signature: bands of rows. A pair at 0.8 misses every band with probability 5e-7.
BANDS, ROWS = 48, 6


def shingles(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every shingle of ``SHINGLE`` words; a shorter text has one shingle of all its words."""
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    whole = spans_of(hashes, SHINGLE)
    inside = row[: len(whole)] == row[SHINGLE - 1 :] if len(whole) else np.zeros(0, bool)
    made, of = [whole[inside]], [row[: len(whole)][inside]]
    for words in range(1, SHINGLE):
        rows = np.flatnonzero(count == words)
        if len(rows):
            value = np.zeros(len(rows), np.uint64)
            for j in range(words):
                value = value * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[first[rows] + j]
            made.append(mix(value + np.uint64(words)))
            of.append(rows)
    return np.concatenate(made), np.concatenate(of)


def weigh(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (value, row) with their counts."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return values[at], row[at], np.diff(np.append(at, len(values)))


def _exp(key: np.ndarray) -> np.ndarray:
    return -np.log(((mix(key) >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53)


def bag_signatures(values: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures, shape (n, registers): P(equal register) is the weighted Jaccard similarity.

    The weight axis is discretised to whole counts and cut into the strips [0, 1), [1, 2), [2, 4), [4, 8) ... Each strip of
    an element carries a Poisson process of points in time whose rate is the strip's width. A strip's points
    come from splitting: its first point falls into one half by a fair bit, the other half gets a first point
    of its own, and so on down to unit cells, which go on with exponential steps. Random bits are hashes of
    (element, cell), so texts that share a part of a strip share exactly its points. A point counts if its cell
    lies below the element's weight; it lowers one register. A row's process ends beyond its largest register.
    """
    best = np.full((n, registers), np.inf)
    flat = best.reshape(-1)
    step = np.uint64(0x9E3779B97F4A7C15)
    strips = np.where(weight == 1, 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64) + 1)
    of = np.repeat(np.arange(len(values)), strips)
    octave = np.arange(len(of)) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(octave == 0, 0, 1 << np.maximum(octave - 1, 0)).astype(np.int64)
    width = np.where(octave == 0, 1, 1 << np.maximum(octave - 1, 0)).astype(np.int64)
    x, doc, w = values[of], row[of], weight[of]
    cell = mix(x + step * (low.astype(np.uint64) * np.uint64(2) + np.uint64(1)) + (width.astype(np.uint64) << np.uint64(40)))
    time = _exp(cell) / width
    point, fresh = cell, np.ones(len(x), bool)
    highest = np.full(n, np.inf)
    while len(x):
        counts = fresh & (low + width <= w)
        register = (mix(point ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat, doc[counts] * registers + register[counts], time[counts])
        touched = np.unique(doc)
        highest[touched] = best[touched].max(1)
        fresh = fresh & ~counts
        go = time <= highest[doc]
        x, doc, w, low, width, time, cell, point, fresh = (a[go] for a in (x, doc, w, low, width, time, cell, point, fresh))
        unit = width == 1
        # a unit cell goes on with its next point
        next_cell = mix(cell[unit] + step)
        a = (x[unit], doc[unit], w[unit], low[unit], width[unit], time[unit] + _exp(next_cell), next_cell, next_cell, np.ones(int(unit.sum()), bool))
        # a wider one splits: the half that holds the point keeps it, the other one gets its own
        s = ~unit
        half = width[s] >> 1
        right = (mix(cell[s] ^ np.uint64(0xE7037ED1A0B428DB)) & np.uint64(1)).astype(np.int64)
        here, there = low[s] + right * half, low[s] + (1 - right) * half
        name = lambda at: mix(x[s] + step * (at.astype(np.uint64) * np.uint64(2) + np.uint64(1)) + (half.astype(np.uint64) << np.uint64(40)))  # noqa: E731, B023
        kept_cell, own = mix(name(here) + point[s]), mix(name(there) + point[s])
        b = (x[s], doc[s], w[s], here, half, time[s], kept_cell, point[s], fresh[s])
        c = (x[s], doc[s], w[s], there, half, time[s] + _exp(own) / half, own, own, np.ones(int(s.sum()), bool))
        x, doc, w, low, width, time, cell, point, fresh = (np.concatenate(z) for z in zip(a, b, c, strict=True))
        go = low < w
        x, doc, w, low, width, time, cell, point, fresh = (z[go] for z in (x, doc, w, low, width, time, cell, point, fresh))
    return best


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    buffer, offsets = text_bytes(batch.column("text"))
    for first, last in rounds(offsets):
        own = offsets[first : last + 1]
        starts, ends, row = word_spans(buffer, own)
        part = buffer[own[0] : own[-1]]
        yield first, last, part, starts, ends, row, word_hashes(part, starts, ends, 1, lower=True)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the lower-cased words, and band keys, of each text that has words."""
    for batch in batches:
        for first, last, part, starts, ends, row, hashes in _rows_of(batch):
            n = last - first
            values, of = shingles(hashes, row, n)
            signature = bag_signatures(*weigh(values, of), n)
            # rounded, so that the last bit of a logarithm can't part equal signatures
            bits = signature.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(n, BANDS, ROWS)
            keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)) + np.uint64(1)
            for j in range(ROWS):
                keys = mix(keys * np.uint64(0xC2B2AE3D27D4EB4F) + bits[:, :, j])
            count = np.bincount(row, minlength=n)
            texts = [part[a:b] for a, b in _row_bounds(starts, ends, count)]
            digest = [hashlib.blake2b(b" ".join(bytes(t).lower().split()), digest_size=16).digest() if c else None for t, c in zip(texts, count, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(first, n), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, keys.reshape(-1).view(np.int64))],
                names=["id", "digest", "keys"],
            )


def _row_bounds(starts: np.ndarray, ends: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int]]:
    last = np.cumsum(count)
    for a, b in zip(last - count, last, strict=True):
        yield (int(starts[a]), int(ends[b - 1])) if b > a else (0, 0)


def _multisets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each text as distinct hashes of (shingle, how many-th time)."""
    for batch in batches:
        for first, last, _, _, _, row, hashes in _rows_of(batch):
            n = last - first
            values, of, weight = weigh(*shingles(hashes, row, n))
            many = np.repeat(np.arange(len(values)), weight)
            nth = np.arange(len(many)) - np.repeat(np.cumsum(weight) - weight, weight)
            made = mix(values[many] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of[many], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(first, n), pa.ListArray.from_arrays(offsets, made.view(np.int64))], names=["node", "feature"]
            )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``group_id``, ``group_size``, ``kept``. A group keeps its smallest id.

    Texts are multisets of shingles of five lower-cased words (runs of non-space bytes). Texts of equal words are
    one class. Classes that agree in a band of their BagMinHash signatures are linked if the overlap of
    the multisets, sum of minima over sum of maxima, is at least ``threshold``; a group is a connected
    component. ``group_size`` counts rows.

    Defined results: a text without words, or null, and a row with a null id are groups of their own and
    kept. Rows that repeat an id are one document if their texts are linked, else the id belongs to both groups'
    rows as they stand. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(rows.mapInArrow(_sign, "id long, digest binary, keys array<long>"), "signed")
    usable = signed.filter("id IS NOT NULL AND digest IS NOT NULL")
    classes = written(usable.groupBy("digest").agg(F.min("id").alias("node")), "classes")
    first = usable.join(classes, "digest").filter("id = node")
    # the same id may stand for two texts: then their classes are one node
    bands = first.select("node", F.explode("keys").alias("key")).distinct()

    def features(nodes: DataFrame) -> DataFrame:
        wanted = rows.join(small_side(nodes, 16), F.col("id") == F.col("node"), "left_semi")
        one = wanted.select(F.col("id").alias("node"), "text").mapInArrow(_multisets, "node long, feature array<long>")
        return one.dropDuplicates(["node"])

    groups = linked_groups(bands, features, overlap, threshold)
    labelled = classes.join(groups, "node", "left").select("digest", F.coalesce("component", "node").alias("group_id"))
    placed = usable.join(labelled, "digest").select("id", "group_id")
    placed = written(placed, "placed")
    sizes = placed.groupBy("group_id").agg(F.count("*").alias("group_size"))
    lone = signed.filter("id IS NULL OR digest IS NULL").select("id", F.col("id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return placed.join(sizes, "group_id").select("id", "group_id", "group_size", (F.col("id") == F.col("group_id")).alias("kept")).unionByName(lone)

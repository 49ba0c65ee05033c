"""Sequences of token ids by bounded-space online packing."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import written
from boxloom.llm.pieces import encoder
from boxloom.llm.words import rounds, text_bytes

LENGTH, END, OPEN_WINDOWS = 2048, 1, 64
#: Partitions whose leftover windows are merged by one task.
MERGED = 16

_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """``OPEN_WINDOWS`` open windows; an item goes where it leaves the least room, and the fullest is emitted if none has room."""

    def __init__(self, length: int, windows: int):
        self.length, self.windows = length, windows
        self.free: list[tuple[int, int]] = []  # (room left, window), ascending
        self.next = 0

    def place(self, size: int) -> tuple[int, int, int | None]:
        """Window and offset of an item, and the window that had to be emitted, if any."""
        at, gone = bisect_left(self.free, (size, -1)), None
        if at == len(self.free):
            if len(self.free) == self.windows:
                gone = self.free.pop(0)[1]
            room, window = self.length, self.next
            self.next += 1
        else:
            room, window = self.free.pop(at)
        if room > size:
            insort(self.free, (room - size, window))
        return window, self.length - room, gone


def _pack(path: str, length: int, windows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of this partition's texts; ``left`` marks those in windows that are open at its end."""
    tokenizer, packer = encoder(path, "word"), Packer(length, windows)
    part = TaskContext.get().partitionId()
    held: dict[int, list[tuple]] = {}  # pieces of the open windows
    kind = None

    def batch_of(rows: list[tuple], left: bool) -> pa.RecordBatch:
        c = list(zip(*rows, strict=True)) or [()] * 7
        numbers = [pa.array(c[k], pa.int64()) for k in range(1, 7)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c[0], kind), *numbers, pa.array([left] * len(rows)), pa.array([part] * len(rows), pa.int64())],
            names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "left", "part"],
        )

    for batch in batches:
        kind = batch.column("id").type
        buffer, offsets = text_bytes(batch.column("text"))
        for first, last in rounds(offsets):
            ids, counts = tokenizer.encode(buffer, offsets[first : last + 1])
            names = batch.column("id").slice(first, last - first).to_pylist()
            done, at = [], 0
            for name, n in zip(names, counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], END).astype("<u4")
                at += n
                for begin in range(0, n + 1, length):
                    piece = own[begin : begin + length]
                    window, offset, gone = packer.place(len(piece))
                    held.setdefault(window, []).append((name, begin, len(piece), zlib.crc32(piece.tobytes()), n + 1, (part << 36) + window, offset))
                    if gone is not None:
                        done += held.pop(gone)
                    if offset + len(piece) == length:
                        done += held.pop(window)
            if done:
                yield batch_of(done, False)
    if held:
        yield batch_of([x for w in held for x in held[w]], True)


def _merge(length: int, group: pd.DataFrame) -> pd.DataFrame:
    """Whole leftover windows joined, fullest first, each where it leaves the least room."""
    fill = group.groupby("sequence_id")["length"].sum().reset_index().sort_values(["length", "sequence_id"], ascending=[False, True])
    free: list[tuple[int, int]] = []
    target, shift = {}, {}
    for sequence, size in zip(fill["sequence_id"].tolist(), fill["length"].tolist(), strict=True):
        at = bisect_left(free, (size, -1))
        room, into = free.pop(at) if at < len(free) else (length, sequence)
        target[sequence], shift[sequence] = into, length - room
        if room > size:
            insort(free, (room - size, into))
    out = group.copy()
    out["offset"] += out["sequence_id"].map(shift)
    out["sequence_id"] = out["sequence_id"].map(target)
    return out[["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part"]]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of documents in sequences: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is the ids of its whole text and an end id. It is cut every ``length`` ids; what remains is placed at once,
    in the open window of its partition that it fills best. A partition keeps ``windows`` windows open and emits the
    fullest when none has room. At the end the leftover windows, at most ``windows`` per partition, are merged whole, best fit,
    by rounds over ``MERGED`` partitions each, until one group is left. Offsets in a sequence have no gaps.

    A task holds its open windows only. All pieces are written before leftovers are merged, so a lost executor can't
    change an assignment that was already used. Sequence ids are unique: partition number, window number.

    Defined results: a null or empty text is the end id alone. Null and repeated ids are documents of their own. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    placed = rows.mapInArrow(lambda b: _pack(tokenizer, length, windows, b), f"id {kind}, {_PIECE}, left boolean, part long")
    placed = written(placed, "pieces")
    out = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    left = placed.filter("left").select(*out, "part")
    parts = (left.agg(F.max("part").alias("p")).first()["p"] or 0) + 1
    while True:
        groups = left.withColumn("part", F.floor(F.col("part") / MERGED).cast("long"))
        left = groups.groupBy("part").applyInPandas(lambda g: _merge(length, g), f"id {kind}, {_PIECE}, part long")
        parts = -(-parts // MERGED)
        if parts <= 1:
            break
        left = written(left, "leftovers")
    return placed.filter(~F.col("left")).select(*out).unionByName(left.select(*out))

"""Files of token ids: adaptive range coding of order-0 to order-2 predictions in independent, checksummed blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import scratch, small_side, written
from boxloom.llm.pieces import encoder
from boxloom.llm.words import rounds, text_bytes

#: Ids of a block (its model starts anew), ids after which a frame (one row of a file) is closed.
BLOCK, FRAME = 2048, 4 << 20
#: Bits of a frequency total, of an id inside its bucket, of the order-2 and order-1 tables.
TOTAL, FINE, TABLE2, TABLE1 = 15, 6, 11, 10
BUCKETS = 1 << (16 - FINE)
MAGIC = b"IDF1"
_LOW, _FULL = np.uint64(32), np.uint64((1 << 48) - 1)


class _Mixture:
    """The model of many blocks side by side; block i owns lane i of every table.

    Order 2 and order 1 each predict one id, the last seen after the same ids, with a confidence of 0 to 3; order 0 has
    frequencies of buckets of ids. An id's probability is their mixture, with weights that adapt per pair of confidences;
    it is coded as the highest order that predicts it, and by order 0 after an escape.
    """

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes, dtype=np.int64)
        self.two, self.one = np.zeros(lanes << TABLE2, np.int32), np.zeros(lanes << TABLE1, np.int32)
        self.weight = np.full((2, lanes << 4), 1 << (TOTAL - 4), np.int32)
        self.count = np.zeros((lanes, BUCKETS), np.int32)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.steps = 0
        self.refresh()

    def refresh(self) -> None:
        shares = 8 + self.count * ((1 << TOTAL) - 8 * BUCKETS) // max(1, self.steps)
        self.cum = np.zeros((len(self.lane), BUCKETS + 1), np.int32)
        np.cumsum(shares, axis=1, out=self.cum[:, 1:])
        self.flat = self.cum.reshape(-1)

    def shrink(self, lanes: int) -> None:
        """Go on with the first lanes only; tables stay, as lanes own their slices."""
        self.lane, self.last, self.before = self.lane[:lanes], self.last[:lanes], self.before[:lanes]
        self.count, self.cum = self.count[:lanes], self.cum[:lanes]

    def predict(self) -> None:
        mixed = self.last * 0x9E3779B1 + self.before * 0x85EBCA77
        self.at2 = (self.lane << TABLE2) + ((mixed >> 13) & ((1 << TABLE2) - 1))
        self.at1 = (self.lane << TABLE1) + (((self.last * 0x9E3779B1) >> 13) & ((1 << TABLE1) - 1))
        self.entry2, self.entry1 = self.two[self.at2], self.one[self.at1]
        self.context = (self.lane << 4) + ((self.entry2 & 3) << 2) + (self.entry1 & 3)
        self.first, self.second = self.weight[0][self.context], self.weight[1][self.context]

    def learn(self, ids: np.ndarray, order: np.ndarray) -> None:
        """``order``: 0 and 1 where order 2 and order 1 gave the id, 2 after an escape."""
        top = (1 << TOTAL) - 192
        self.weight[0][self.context] = self.first + (((order == 0) * top - self.first) >> 4)
        self.weight[1][self.context] = self.second + (((order == 1) * top - self.second) >> 4)
        for table, at, entry in ((self.two, self.at2, self.entry2), (self.one, self.at1, self.entry1)):
            sure = entry & 3
            table[at] = np.where((entry >> 2) == ids, entry + (sure < 3), np.where(sure == 0, ids << 2, entry - 1))
        self.count[self.lane, ids >> FINE] += 1
        self.before, self.last = self.last, ids.astype(np.int64)
        self.steps += 1
        if self.steps in (16, 64) or self.steps % 256 == 0:
            self.refresh()


def encode_frame(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """``MAGIC``, then as unsigned 32-bit integers: ids, ids of a block, blocks, a crc32 and a word count per block; then 16-bit words."""
    if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < 1 << 16):
        raise ValueError("ids must lie below 65,536")
    lanes = -(-len(ids) // block)
    head = np.array([len(ids), block, lanes], "<u4").tobytes()
    if not lanes:
        return MAGIC + head
    grid = np.zeros(lanes * block, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
    tail = len(ids) - (lanes - 1) * block
    model = _Mixture(lanes)
    out = np.zeros((lanes, 3 * block + 4), np.int64)
    words = out.reshape(-1)
    row = np.arange(lanes, dtype=np.int64) * out.shape[1]
    at = row + 1  # word 0 takes a carry of the first one
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, _FULL)
    last = None  # the state of the short lane when it ends

    def code(start: np.ndarray, size: np.ndarray, bits: int) -> None:
        nonlocal low, width, at
        unit = width >> np.uint64(bits)
        low = low + unit * start.astype(np.uint64)
        width = unit * size.astype(np.uint64)
        carry = low >> np.uint64(48)
        words[at - 1] += carry.astype(np.int64)
        low &= _FULL
        short = width < np.uint64(1 << 32)
        words[at] = (low >> _LOW).astype(np.int64) * short  # a word that isn't due yet is written over
        step = short.astype(np.uint64) * np.uint64(16)
        low = (low << step) & _FULL
        width = width << step
        at = at + short

    for t in range(block):
        if t == tail and tail < block:
            last = (low[-1:], at[-1:])
            model.shrink(lanes - 1)
            low, width, at = low[:-1], width[:-1], at[:-1]
            if lanes == 1:
                break
        own = grid[t, : len(low)]
        model.predict()
        order = np.where((model.entry2 >> 2) == own, 0, np.where((model.entry1 >> 2) == own, 1, 2))
        f0, f1 = model.first + 64, model.second + 64
        code(np.where(order == 0, 0, np.where(order == 1, f0, f0 + f1)), np.where(order == 0, f0, np.where(order == 1, f1, (1 << TOTAL) - f0 - f1)), TOTAL)
        literal = order == 2
        bucket = model.lane * (BUCKETS + 1) + (own >> FINE)
        start = model.flat[bucket]
        code(np.where(literal, start, 0), np.where(literal, model.flat[bucket + 1] - start, 1 << TOTAL), TOTAL)
        code(np.where(literal, own & ((1 << FINE) - 1), 0), np.where(literal, 1, 1 << FINE), FINE)
        model.learn(own, order)
    if last is not None:
        low, at = np.concatenate([low, last[0]]), np.concatenate([at, last[1]])
    for k in range(3):  # the rest of the state
        words[at + k] = ((low >> np.uint64(32 - 16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
    length = at + 3 - row
    for k in range(out.shape[1] - 1, 0, -1):  # carries run to the left
        over = out[:, k] >> 16
        if over.any():
            out[:, k] &= 0xFFFF
            out[:, k - 1] += over
    sums = [zlib.crc32(np.ascontiguousarray(ids[k : k + block]).astype("<u4").tobytes()) for k in range(0, len(ids), block)]
    inside = np.arange(out.shape[1])[None, :]
    body = out[(inside >= 1) & (inside < length[:, None])].astype("<u2")
    return MAGIC + head + np.array(sums, "<u4").tobytes() + (length - 1).astype("<u4").tobytes() + body.tobytes()


def decode_frame(data: bytes) -> np.ndarray:
    """The ids of a frame. A block whose checksum differs raises ValueError with its number."""
    if data[:4] != MAGIC:
        raise ValueError("not a frame of ids")
    total, block, lanes = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
    if not lanes:
        return np.zeros(0, np.uint32)
    sums, lengths = np.frombuffer(data, "<u4", 2 * lanes, 16).reshape(2, lanes)
    words = np.concatenate([np.frombuffer(data, "<u2", -1, 16 + 8 * lanes), np.zeros(4, "<u2")]).astype(np.uint64)
    at = (np.cumsum(lengths) - lengths).astype(np.int64)
    tail = total - (lanes - 1) * block
    model = _Mixture(lanes)
    grid = np.zeros((block, lanes), np.int32)
    value = (words[at] << np.uint64(32)) | (words[at + 1] << np.uint64(16)) | words[at + 2]
    at = at + 3
    width = np.full(lanes, _FULL)

    def slot(bits: int) -> tuple[np.ndarray, np.ndarray]:
        unit = width >> np.uint64(bits)
        return unit, np.minimum(value // unit, np.uint64((1 << bits) - 1)).astype(np.int64)

    def take(unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        nonlocal value, width, at
        value = value - unit * start.astype(np.uint64)
        width = unit * size.astype(np.uint64)
        short = width < np.uint64(1 << 32)
        step = short.astype(np.uint64) * np.uint64(16)
        value = (value << step) | (words[np.minimum(at, len(words) - 1)] * short)
        width = width << step
        at = at + short

    for t in range(block):
        if t == tail and tail < block:
            model.shrink(lanes - 1)
            value, width, at = value[:-1], width[:-1], at[:-1]
            if lanes == 1:
                break
        model.predict()
        f0, f1 = model.first + 64, model.second + 64
        unit, found = slot(TOTAL)
        order = np.where(found < f0, 0, np.where(found < f0 + f1, 1, 2))
        take(unit, np.where(order == 0, 0, np.where(order == 1, f0, f0 + f1)), np.where(order == 0, f0, np.where(order == 1, f1, (1 << TOTAL) - f0 - f1)))
        literal = order == 2
        unit, found = slot(TOTAL)
        row = model.lane * (BUCKETS + 1)
        bucket = np.zeros(len(row), np.int64)
        half = BUCKETS >> 1
        while half:
            bucket += half * (model.flat[row + bucket + half] <= found)
            half >>= 1
        start = model.flat[row + bucket]
        take(unit, np.where(literal, start, 0), np.where(literal, model.flat[row + bucket + 1] - start, 1 << TOTAL))
        unit, found = slot(FINE)
        take(unit, np.where(literal, found, 0), np.where(literal, 1, 1 << FINE))
        own = np.where(literal, (bucket << FINE) + found, np.where(order == 0, model.entry2 >> 2, model.entry1 >> 2)).astype(np.int32)
        grid[t, : len(own)] = own
        model.learn(own, order)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:total].astype("<u4")
    for k in range(lanes):
        if zlib.crc32(ids[k * block : (k + 1) * block].tobytes()) != int(sums[k]):
            raise ValueError(f"block {k} is damaged")
    return ids


def _encode(tokenizer: str, end: int, frame: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames of whole documents; a document longer than a frame has one of its own length."""
    library, part, number = encoder(tokenizer, "byte"), TaskContext.get().partitionId(), 0
    names, counts, held, size, kind = [], [], [], 0, None

    def close() -> pa.RecordBatch:
        data = encode_frame(np.concatenate(held))
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())), pa.array([data], pa.binary())],
            names=["part", "frame", "n_ids", "ids", "counts", "data"],
        )

    for batch in batches:
        kind = batch.column("id").type
        buffer, offsets = text_bytes(batch.column("text"))
        for first, last in rounds(offsets):
            made, sizes = library.encode(buffer, offsets[first : last + 1])
            ends = np.cumsum(sizes)
            held.append(np.insert(made, ends, end).astype(np.int32))
            names += batch.column("id").slice(first, last - first).to_pylist()
            counts += (sizes + 1).tolist()
            size += len(held[-1])
            if size >= frame:
                yield close()
                names, counts, held, size, number = [], [], [], 0, number + 1
    if names:
        yield close()


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids = decode_frame(batch.column("data")[k].as_py())
            counts = batch.column("counts")[k].values.to_numpy()
            starts = np.cumsum(counts) - counts
            sums = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[k].values, pa.array(starts + batch.column("first")[k].as_py()), pa.array(counts), pa.array(sums, pa.int64())],
                names=["id", "start", "n_tokens", "ids_crc32"],
            )


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> None:
    """Write the ids of all texts, each with ``end`` after it, to Parquet files at ``path`` in ascending order of id.

    A row is a frame: ``part``, ``frame``, ``n_ids``, the documents' ``ids`` and ``counts``, and ``data`` (see ``encode_frame``).
    Parts are ranges of ids, frames follow each other inside a part. Order: id, nulls first, then text. A null text is
    the end id alone. Rows that repeat an id are documents of their own; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    made = ordered.mapInArrow(lambda b: _encode(tokenizer, end, frame, b), f"part long, frame long, n_ids long, ids array<{kind}>, counts array<long>, data binary")
    made.write.option("compression", "none").parquet(path)


def read_ids(frames: DataFrame) -> DataFrame:
    """``id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32`` of each document in files of ``write_ids``."""
    kind = dict(frames.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    sizes = frames.select("part", "frame", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per part: as many as the writer had tasks
    ahead = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("frame")) - F.col("n_ids")
    first = sizes.withColumn("inside", inside).join(ahead, "part").select("part", "frame", (F.col("ahead") + F.col("inside")).alias("first"))
    first = small_side(written(first, "starts"), 64)
    return frames.join(first, ["part", "frame"]).mapInArrow(_decode, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def ids_file(docs: DataFrame, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` to a new place in the shared folder and give the files' rows."""
    path = scratch(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, end, id_col, text_col)
    return docs.sparkSession.read.parquet(path)

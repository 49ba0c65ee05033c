"""Token ids: exact pieces, packing, files."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from boxloom.llm import idcoder, packing
from boxloom.llm.pieces import PieceEncoder
from tests.llm.cases import frame, odd_documents, prose

ROWS = odd_documents()
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "B", "é", "Σ", "σ", " ", "  ", "\n", "\t", " ", " ", "\x85", "\x1c", "\x01", "漢", "☃", "1", "2", ".", ",", "'s", "'ll"]
SIGNS += ["<|endoftext|>", "<|startoftext|>", "́", "\r\n", "ﬁ", "İ", "\x00", "𝒳", " ", "\xa0"]


def library(path, texts):
    from tokenizers import Tokenizer

    return [np.array(e.ids, np.uint32) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path,kind", [(WORD, "word"), (BYTE, "byte")])
def test_pieces_equal_whole_texts(path, kind):
    rng = random.Random(1)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [t for _, t in ROWS if t]
    coded = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int64)
    ids, counts = PieceEncoder(path, kind).encode(np.frombuffer(b"".join(coded), np.uint8), offsets)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(parts, library(path, texts), strict=True))


@pytest.mark.parametrize("windows,length", [(64, 2048), (2, 64), (1, 7)])
def test_packing(spark, windows, length):
    rows = ROWS + [(100 + k, prose(k, 5 + 37 * k % 90)) for k in range(80)]
    docs = frame(spark, rows).repartition(40)
    got = packing.pack(docs, WORD, length=length, windows=windows).collect()
    want = Counter()
    for (i, _), ids in zip(rows, library(WORD, [t or "" for _, t in rows]), strict=True):
        ids = np.append(ids, 1).astype("<u4")
        for a in range(0, len(ids), length):
            want[i, a, len(ids[a : a + length]), zlib.crc32(ids[a : a + length].tobytes()), len(ids)] += 1
    assert Counter((r["id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= length
    if windows == 64:
        total = sum(r["length"] for r in got)
        assert len(sequences) * length <= 1.1 * total + length


def test_best_fit():
    packer = packing.Packer(10, 2)
    assert [packer.place(n) for n in (6, 7, 3, 4, 9, 9, 2)] == [
        (0, 0, None), (1, 0, None), (1, 7, None), (0, 6, None), (2, 0, None), (3, 0, None), (4, 0, 2)
    ]


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 9000])
def test_frames_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), rng.integers(0, 4, n), np.full(n, 65535), np.arange(n) % 700):
        data = idcoder.encode_frame(ids.astype(np.int32))
        assert (idcoder.decode_frame(data) == ids).all()
    assert n < 9000 or len(data) < n


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.int32) % 911
    data = bytearray(idcoder.encode_frame(ids))
    data[-900] ^= 4
    with pytest.raises(ValueError, match="block"):
        idcoder.decode_frame(bytes(data))
    with pytest.raises(ValueError, match="65,536"):
        idcoder.encode_frame(np.array([70000], np.int32))


@pytest.mark.parametrize("size", [idcoder.FRAME, 300])
def test_id_files(spark, size):
    from boxloom.llm.common import scratch

    path = scratch(spark, "test")
    idcoder.write_ids(frame(spark, ROWS).repartition(5), path, BYTE, 2, frame=size)
    got = idcoder.read_ids(spark.read.parquet(path)).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = Counter(), 0
    for (i, _), ids in zip(order, library(BYTE, [t or "" for _, t in order]), strict=True):
        ids = np.append(ids, 2).astype("<u4")
        want[i, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert Counter(map(tuple, got)) == want


def test_empty(spark):
    docs = frame(spark, ROWS).limit(0)
    assert packing.pack(docs, WORD).count() == 0
    assert idcoder.read_ids(idcoder.ids_file(docs, BYTE, 2)).count() == 0


@pytest.mark.parametrize("path,kind", [(WORD, "word"), (BYTE, "byte")])
def test_cuts_are_marked_not_sorted(monkeypatch, path, kind):
    """Sets of cuts took a quarter of the time of an encoder; empty texts and texts of spaces have bounds, too."""
    texts = ["", "a b", " ", "\n", "", "x\ny z  ", ""]
    coded = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int64)
    encoder = PieceEncoder(path, kind)
    for name in ("union1d", "unique"):
        monkeypatch.setattr(np, name, None)
    ids, counts = encoder.encode(np.frombuffer(b"".join(coded), np.uint8), offsets)
    want = library(path, texts)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w.tolist()]

"""Token ids of whole texts from the tokenizers library, each distinct piece of text encoded once.

A text is cut only at places where the library's own pre-tokenizer always cuts, so the ids of the
pieces, joined, are the ids of the text. Distinct pieces are encoded together, set apart by a piece of
their own, and kept for the next batches of the same worker.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Distinct pieces that a worker keeps; beyond them it starts anew.
KEPT_PIECES = 1_200_000
#: Pieces that are encoded in one string.
JOINED = 256


def marked(n: int, *places: np.ndarray) -> np.ndarray:
    """All ``places`` from 0 to ``n``, each once, in order; marks in an array take a fraction of the time of a set."""
    mark = np.zeros(n + 1, bool)
    for at in places:
        mark[at] = True
    return np.flatnonzero(mark)


def cuts_after_space(b: np.ndarray) -> np.ndarray:
    """Places after white space and before anything else, for a pre-tokenizer that drops white space."""
    space = (b == 32) | ((b >= 9) & (b <= 13))
    return np.flatnonzero(space[:-1] & ~space[1:]) + 1


def cuts_before_space(b: np.ndarray) -> np.ndarray:
    """Places before a single space or line feed between two characters that are surely no white space, and after
    such a line feed, for a byte-level pre-tokenizer that gives a space to the word that follows."""
    if len(b) < 3:
        return np.zeros(0, np.int64)
    ascii_mark = (b > 32) & (b < 127)
    lead = (b >= 0xC3) & (b <= 0xDF)  # no white space has these lead bytes
    ends = ascii_mark.copy()
    ends[1:] |= lead[:-1] & (b[1:] >= 0x80)
    begins = ascii_mark | lead
    gap = (b[1:-1] == 32) | (b[1:-1] == 10)
    at = np.flatnonzero(gap & ends[:-2] & begins[2:]) + 1
    return marked(len(b), at, at[b[at] == 10] + 1)


class PieceEncoder:
    """``kind``: "word" (white space dropped) or "byte" (byte level)."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cuts, self.apart, self.plain = {
            "word": (cuts_after_space, " \x01 ", re.compile("[^\x00-\x08\x0e-\x1f]+")),
            "byte": (cuts_before_space, "\n", re.compile(r" ?[^\s\x00-\x1f\x85]+")),
        }[kind]
        self.sign = self.library.encode(self.apart, add_special_tokens=False).ids
        assert len(self.sign) == 1
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        plain = [p for p in new if self.plain.fullmatch(p)]
        other = [p for p in new if not self.plain.fullmatch(p)]
        groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        coded = self.library.encode_batch_fast([self.apart.join(g) for g in groups], add_special_tokens=False)
        ids, sizes = [], []
        for group, e in zip(groups, coded, strict=True):
            made = np.array(e.ids, np.int32)
            signs = np.flatnonzero(made == self.sign[0])
            if len(signs) != len(group) - 1:  # a piece has the sign itself
                other += group
                continue
            bounds = np.concatenate([[-1], signs, [len(made)]])
            sizes.append(np.diff(bounds) - 1)
            ids.append(np.delete(made, signs))
            for p in group:
                self.slots[p] = len(self.slots)
        for p, e in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False) if other else [], strict=True):
            ids.append(np.array(e.ids, np.int32))
            sizes.append(np.array([len(e.ids)]))
            self.slots[p] = len(self.slots)
        if not sizes:
            return
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        first = len(self.slots) - len(sizes)
        while len(self.slots) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[first : len(self.slots)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : len(self.slots)] = sizes
        self.used += len(ids)

    def encode(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``buffer[offsets[i]:offsets[i + 1]]``, one after the other, and how many each has."""
        base, end = int(offsets[0]), int(offsets[-1])
        part = buffer[base:end]
        own = offsets - base
        if len(part) == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        bounds = marked(len(part), self.cuts(part), own)
        pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(part)))
        coded = pieces.dictionary_encode()
        if len(self.slots) > KEPT_PIECES:
            self._clear()
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.slots]
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        sizes = self.sizes[slot]
        total = int(sizes.sum())
        before = np.cumsum(sizes) - sizes
        ids = self.pool[np.repeat(self.starts[slot] - before, sizes) + np.arange(total)]
        ends = np.concatenate([before, [total]])[np.searchsorted(bounds, own)]
        return ids, np.diff(ends)


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> PieceEncoder:
    """The encoder of this worker process."""
    return PieceEncoder(path, kind)



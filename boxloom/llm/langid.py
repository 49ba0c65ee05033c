"""Language of a text by a bidirectional gated recurrent network over its bytes, trained in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.words import text_bytes

#: Units per direction, bytes of a window (the state starts anew in each), windows that run side by side.
HIDDEN, WINDOW, LANES = 12, 96, 4096
#: The training sample: texts per language (drawn by hash, in expectation), at most so many languages, and windows of a text.
TEXTS, LANGUAGES, PIECES = 400, 64, 3


@dataclass
class Network:
    """Weights. Gates are hard sigmoids, the candidate is a clipped line, so that a step is a few array operations."""

    languages: list[str]
    embed: np.ndarray  # (2, 256, 3 * HIDDEN): direction, byte, input part of update, reset and candidate
    state: np.ndarray  # (2, HIDDEN, 3 * HIDDEN)
    out: np.ndarray  # (2 * HIDDEN + 1, languages)


def _run(net: Network, codes: np.ndarray, direction: int, tape: list | None = None) -> np.ndarray:
    """States (T, B, HIDDEN) of one direction over ``codes`` (T, B)."""
    steps, lanes = codes.shape
    h = np.zeros((lanes, HIDDEN), np.float32)
    out = np.empty((steps, lanes, HIDDEN), np.float32)
    embed, gates, cand = net.embed[direction], net.state[direction][:, : 2 * HIDDEN], net.state[direction][:, 2 * HIDDEN :]
    for t in range(steps) if direction == 0 else range(steps - 1, -1, -1):
        x = embed[codes[t]]
        a = x[:, : 2 * HIDDEN] + h @ gates
        g = np.clip(a * np.float32(0.2) + np.float32(0.5), 0, 1)
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        rh = r * h
        c = x[:, 2 * HIDDEN :] + rh @ cand
        n = np.clip(c, -1, 1)
        if tape is not None:
            tape.append((t, h, a, z, r, rh, c, n))
        h = h + z * (n - h)
        out[t] = h
    return out


def _logits(net: Network, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    w = net.out
    return forward @ w[:HIDDEN] + backward @ w[HIDDEN : 2 * HIDDEN] + w[-1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _gradients(net: Network, codes: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss over all positions, and its gradients by backpropagation through time."""
    tapes: list[list] = [[], []]
    runs = [_run(net, codes, d, tapes[d]) for d in (0, 1)]
    p = _softmax(_logits(net, *runs))
    lanes = np.arange(codes.shape[1])
    loss = float(-(np.log(p[:, lanes, labels] + 1e-9) * mask).sum() / mask.sum())
    p[:, lanes, labels] -= 1
    p *= (mask / mask.sum())[..., None]
    top = np.concatenate([*runs, np.ones((*codes.shape, 1), np.float32)], -1)
    d_out = np.einsum("tbi,tbl->il", top, p, optimize=True)
    d_embed, d_state = np.zeros_like(net.embed), np.zeros_like(net.state)
    for d in (0, 1):
        gates, cand = net.state[d][:, : 2 * HIDDEN], net.state[d][:, 2 * HIDDEN :]
        d_top = p @ net.out[d * HIDDEN : (d + 1) * HIDDEN].T
        dh = np.zeros((codes.shape[1], HIDDEN), np.float32)
        for t, h, a, z, r, rh, c, n in reversed(tapes[d]):
            dh = dh + d_top[t]
            dn = dh * z * (np.abs(c) < 1)
            drh = dn @ cand.T
            da = np.concatenate([dh * (n - h), drh * h], 1) * np.float32(0.2) * (np.abs(a) < 2.5)
            d_state[d][:, : 2 * HIDDEN] += h.T @ da
            d_state[d][:, 2 * HIDDEN :] += rh.T @ dn
            np.add.at(d_embed[d], codes[t], np.concatenate([da, dn], 1))
            dh = dh * (1 - z) + drh * r + da @ gates.T
    return loss, [d_embed, d_state, d_out]


def train(texts: list[tuple[str, str]], epochs: int = 14, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network | None:
    """A network from (language, text) pairs, by Adam on windows drawn from the texts. None without pairs."""
    languages = sorted({lang for lang, _ in texts})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    windows, labels = [], []
    for lang, text in sorted(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        for at in np.linspace(0, max(0, len(data) - WINDOW), PIECES).astype(int) if len(data) > WINDOW else [0]:
            piece = data[at : at + WINDOW]
            if len(piece):
                windows.append(np.pad(piece.astype(np.int16), (0, WINDOW - len(piece)), constant_values=-1))
                labels.append(languages.index(lang))
    if not windows:
        return None
    codes, labels = np.array(windows).T, np.array(labels)
    mask, codes = (codes >= 0).astype(np.float32), np.maximum(codes, 0)
    # languages weigh the same
    mask = mask * (1 / np.bincount(labels, minlength=len(languages)).clip(1))[labels].astype(np.float32)
    scale = np.float32(0.3)
    net = Network(
        languages, rng.normal(0, scale, (2, 256, 3 * HIDDEN)).astype(np.float32), rng.normal(0, scale, (2, HIDDEN, 3 * HIDDEN)).astype(np.float32),
        rng.normal(0, scale, (2 * HIDDEN + 1, len(languages))).astype(np.float32),
    )
    weights = [net.embed, net.state, net.out]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    per_epoch = max(1, -(-len(labels) // batch))
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(per_epoch):
            pick = order[k * batch : (k + 1) * batch]
            _, grads = _gradients(net, codes[:, pick], labels[pick], mask[:, pick])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * (epoch * per_epoch + k) / (epochs * per_epoch)))
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, text: Column, lang: Column, allowed: Column, key: Column) -> list[tuple[str, str]]:
    """Bounded training texts: about ``TEXTS`` of each of the ``LANGUAGES`` most frequent languages, by a hash of ``key``.

    A text gives up to ``PIECES`` windows, so only its beginning, middle and end of ``WINDOW`` characters travel to the driver.
    """
    rows = docs.filter(allowed).select(lang.alias("lang"), text.alias("text"), F.pmod(F.xxhash64(key), F.lit(1_000_000)).alias("draw"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return []
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(1_000_000 * TEXTS / r["count"]))))
    chars = F.char_length("text")
    piece = F.when(chars <= 4 * WINDOW, F.col("text")).otherwise(
        F.concat(F.substr("text", F.lit(1), F.lit(WINDOW)), F.substr("text", (chars / 2).cast("int"), F.lit(WINDOW)), F.substr("text", chars - WINDOW + 1, F.lit(WINDOW)))
    )
    drawn = rows.filter(F.col("draw") < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("lang", piece.alias("piece"))
    return [(r["lang"], r["piece"]) for r in drawn.limit(2 * TEXTS * LANGUAGES).collect()]


def label_positions(net: Network, text: str) -> tuple[list[int], np.ndarray]:
    """The language of every byte of a text (an index into ``languages``) and the pooled probabilities."""
    data = np.frombuffer(text.encode(), np.uint8)
    padded = np.pad(data, (0, -len(data) % WINDOW)).reshape(-1, WINDOW).T
    p = _softmax(_logits(net, _run(net, padded, 0), _run(net, padded, 1))).transpose(1, 0, 2).reshape(-1, len(net.languages))[: len(data)]
    return p.argmax(1).tolist(), p.mean(0)


def _pooled(net: Network, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the position probabilities of each row, shape (rows, languages). All windows of all rows run in groups."""
    size = np.diff(offsets)
    windows = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), windows)
    start = offsets[:-1][row] + WINDOW * (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows))
    length = np.minimum(WINDOW, offsets[1:][row] - start)
    total = np.zeros((len(size), len(net.languages)))
    order = np.argsort(-length, kind="stable")  # windows of like length share a group
    for k in range(0, len(order), LANES):
        pick = order[k : k + LANES]
        steps = int(length[pick[0]])
        at = start[pick][None, :] + np.arange(steps)[:, None]
        inside = np.arange(steps)[:, None] < length[pick][None, :]
        codes = np.where(inside, buffer[np.minimum(at, len(buffer) - 1)], 0)
        x = _logits(net, _run(net, codes, 0), _run(net, codes, 1))
        x -= x.max(-1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(-1, keepdims=True)
        pooled = np.einsum("tbl,tb->bl", x, inside.astype(np.float32))
        np.add.at(total, row[pick], pooled)
    return total


def _predict(net: Network | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        letters = batch.column("letters").to_numpy(zero_copy_only=False)
        best, score = np.full(len(letters), -1), np.zeros(len(letters))
        if net is not None:
            buffer, offsets = text_bytes(batch.column("text"))
            if len(buffer):
                total = _pooled(net, buffer, offsets)
                share = total / np.maximum(total.sum(1, keepdims=True), 1e-9)
                best = np.where(letters, share.argmax(1), -1)
                score = np.where(letters, share.max(1).clip(0, 1), 0.0)
        names = np.array([*(net.languages if net is not None else []), "und"], dtype=object)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names[best], pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` per row: the language of the largest pooled probability, over all bytes of the text.

    Defined results: a null text and one without a letter are ``und`` with score 0, and so is every text if nothing could be learned.
    Ids may be null or repeated; other columns are ignored.
    """
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), letters.alias("letters"))
    return rows.mapInArrow(lambda b: _predict(net, b), f"id {dict(rows.dtypes)['id']}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the fold of a document is never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from a bounded sample of the labelled rows outside the held-out fold."""
    return train(sample(docs, F.col(text_col), F.col(lang_col), ~held_out(id_col), F.col(id_col)))

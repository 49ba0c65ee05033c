"""Greedy matching of whole groups as arrays, inside tasks.

Rows come in order of their group. A call holds some thousands of them: all pairs of a batch of groups are compared, ranked
and settled side by side, so a prediction costs about a microsecond and only results leave the task. Groups of more rows than
``crowd`` are not held: their rows go on as they are, for the operators that spread a group over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that a call holds, beside its open group.
ROWS = 1 << 15
#: Pairs that are compared at once, and pairs of both sides whose overlaps are settled together (a group of copies overlaps in all of them).
COMPARED, PRODUCTS = 1 << 18, 1 << 22
#: Columns that a call makes.
ITEM = pa.struct([("gt_index", pa.int64()), ("iou", pa.float64()), ("levels", pa.int32()), ("on_regular", pa.bool_())])
MADE = {"rank": pa.int32(), "gt_index": pa.int64(), "iou": pa.float64(), "on_regular": pa.bool_(), "_at": pa.list_(ITEM), "_settled": pa.bool_()}


def _numpy(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches of whole groups (False) and parts of groups of more than ``crowd`` rows (True); ``_first`` marks the first row of a group."""
    held, n, passing = [], 0, False
    for batch in batches:
        if passing:  # the open group is a crowd
            first = np.flatnonzero(_numpy(batch, "_first"))
            end = int(first[0]) if len(first) else batch.num_rows
            if end:
                yield batch.slice(0, end), True
            batch, passing = batch.slice(end), not len(first)
            if passing:
                continue
        held.append(batch)
        n += batch.num_rows
        if n < ROWS:
            continue
        rows = pa.concat_batches(held)
        last = int(np.flatnonzero(_numpy(rows, "_first"))[-1])
        yield from _apart(rows.slice(0, last), crowd)
        rest = rows.slice(last)
        passing = rest.num_rows > crowd
        if passing:
            yield rest, True
        held, n = ([], 0) if passing else ([rest], rest.num_rows)
    if held:
        yield from _apart(pa.concat_batches(held), crowd)


def _apart(rows: pa.RecordBatch, crowd: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    if not rows.num_rows:
        return
    start = np.flatnonzero(_numpy(rows, "_first"))
    sizes = np.diff(np.append(start, rows.num_rows))
    if sizes.max() > crowd:
        crowded = np.repeat(sizes > crowd, sizes)
        yield rows.filter(pa.array(crowded)), True
        if crowded.all():
            return
        rows = rows.filter(pa.array(~crowded))
    for piece in _bounded(rows):
        yield piece, False


def _bounded(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of whole groups with at most ``PRODUCTS`` pairs of both sides together, or one group."""
    if "_truth" not in rows.schema.names:
        yield rows
        return
    start, truth = np.flatnonzero(_numpy(rows, "_first")), _numpy(rows, "_truth")
    many = np.add.reduceat(truth.astype(np.int64), start)
    ends, at = np.cumsum(many * (np.diff(np.append(start, rows.num_rows)) - many)), 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PRODUCTS, "right")))
        yield rows.slice(start[at], (start[stop] if stop < len(start) else rows.num_rows) - start[at])
        at = stop


def products(many: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (begin, end, which, other) of the pairs of items 0, 1 ... with ``many`` consecutive others from ``first`` on."""
    ends, at = np.cumsum(many), 0
    while at < len(many):
        begun = int(ends[at] - many[at])
        stop = max(at + 1, int(np.searchsorted(ends, begun + COMPARED, "right")))
        size = many[at:stop]
        other = np.arange(int(ends[stop - 1]) - begun) + np.repeat(first[at:stop] - (ends[at:stop] - size - begun), size)
        yield at, stop, size, other
        at = stop


def _overlaps(rows: pa.RecordBatch, mine: np.ndarray, many: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in ``mine``, other row, area in common) where rows overlap; row ``mine[k]`` meets ``many[k]`` rows from ``first[k]`` on."""
    x1, y1, x2, y2 = _corners(rows)
    for at, stop, size, other in products(many, first):
        here = mine[at:stop]
        width = np.minimum(np.repeat(x2[here], size), x2[other]) - np.maximum(np.repeat(x1[here], size), x1[other])
        near = np.flatnonzero(width > 0)
        which, other = np.repeat(np.arange(at, stop), size)[near], other[near]
        p = mine[which]
        height = np.minimum(y2[p], y2[other]) - np.maximum(y1[p], y1[other])
        both = np.flatnonzero(height > 0)
        yield which[both], other[both], (width[near] * height)[both]


def _corners(rows: pa.RecordBatch) -> list[np.ndarray]:
    return [_numpy(rows, c).astype(float) for c in ("x1", "y1", "x2", "y2")]


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def box_pairs(rows: pa.RecordBatch, preds: np.ndarray, many: np.ndarray, first: np.ndarray, lowest: float) -> tuple[np.ndarray, ...]:
    """(place in ``preds``, row of the truth, IoU) of the pairs that reach ``lowest``."""
    x1, y1, x2, y2 = _corners(rows)
    area, out = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0), []
    for which, truth, both in _overlaps(rows, preds, many, first):
        iou = both / (area[preds[which]] + area[truth] - both)
        reached = iou >= lowest
        out.append((which[reached], truth[reached], iou[reached]))
    return _joined(out)


def mask_groups(batches: Iterator[pa.RecordBatch], names: list[str], self_join: bool, least: float, crowd: int) -> Iterator[pa.RecordBatch]:
    """Instances with those they overlap (``b_index``, ``iou``, ``_settled``) and rows of crowds as they came, with the columns ``names``.

    Rows are pieces of masks as boxes (``x1`` ... in pixels) in order of group, side (``_truth`` first: the other side) and ``_index``, the instance.
    """
    for rows, crowded in whole_groups(batches, crowd):
        if crowded:
            kept, other, iou = rows, pa.nulls(rows.num_rows, pa.int64()), pa.nulls(rows.num_rows, pa.float64())
        else:
            at, other, iou = _mask_pairs(rows, self_join, least)
            kept, other, iou = rows.take(pa.array(at)), pa.array(other), pa.array(iou)
        yield pa.RecordBatch.from_arrays(
            [*(kept.column(c) for c in names), other, iou, pa.array(np.full(kept.num_rows, not crowded))], names=[*names, "b_index", "iou", "_settled"]
        )


def _mask_pairs(rows: pa.RecordBatch, self_join: bool, least: float) -> tuple[np.ndarray, ...]:
    """(a row of the instance, the other instance, IoU)."""
    truth, first, index = (_numpy(rows, c) for c in ("_truth", "_first", "_index"))
    start, group = np.flatnonzero(first), np.cumsum(first) - 1
    begin = first.copy()  # first piece of an instance
    begin[1:] |= (truth[1:] != truth[:-1]) | (index[1:] != index[:-1])
    owner, head = np.cumsum(begin) - 1, np.flatnonzero(begin)
    x1, y1, x2, y2 = _corners(rows)
    area = np.bincount(owner, np.nan_to_num((x2 - x1) * (y2 - y1)))
    mine = np.flatnonzero(~truth)
    many = np.bincount(group[truth], minlength=len(start))
    codes, pixels = [], []
    for which, other, both in _overlaps(rows, mine, many[group[mine]], start[group[mine]]):
        code, place = np.unique(owner[mine[which]] * len(head) + owner[other], return_inverse=True)
        codes.append(code)
        pixels.append(np.bincount(place, both, len(code)))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    code, place = np.unique(np.concatenate(codes), return_inverse=True)  # an instance may lie in several pieces
    common = np.bincount(place, np.concatenate(pixels), len(code))
    one, two = np.divmod(code, len(head))
    iou = common / (area[one] + area[two] - common)
    kept = iou >= least
    if self_join:
        kept &= index[head[one]] < index[head[two]]
    return head[one[kept]], index[head[two[kept]]], iou[kept]


def given_pairs(rows: pa.RecordBatch, group: np.ndarray, preds: np.ndarray, lowest: float) -> tuple[np.ndarray, ...]:
    """(place in ``preds``, row of the pair, IoU) of pairs that come as rows with the index of their prediction."""
    pair = np.flatnonzero(_numpy(rows, "_truth"))
    index, iou = _numpy(rows, "_index"), _numpy(rows, "_iou")[pair]
    order = np.lexsort((index[preds], group[preds]))
    codes = np.unique(index, return_inverse=True)[1] + group * (len(index) + 1)
    mine = codes[preds][order]
    at = np.searchsorted(mine, codes[pair])
    known = at < len(mine)
    known[known] = mine[at[known]] == codes[pair][known]
    known &= iou >= lowest
    return order[at[known]], pair[known], iou[known]


def greedy(p: np.ndarray, g: np.ndarray, iou: np.ndarray, order: np.ndarray, regular: list[np.ndarray], levels: list[float], rounds: int) -> np.ndarray:
    """Bits of the ``levels`` at which each pair is matched, a row per variant of ``regular``.

    ``p`` numbers predictions in the order in which they choose, ``g`` the truths. A prediction takes the truth left that is regular,
    then of most IoU, then of the largest ``order``. In a round a pair settles that is the best left for its prediction, whose
    truth no earlier prediction can still take; what ``rounds`` leave is folded in order.
    """
    reach = sum(((iou >= t).astype(np.int64) << i for i, t in enumerate(levels)), np.zeros(len(iou), np.int64))
    masks = np.zeros((len(regular), len(iou)), np.int64)
    if not len(iou):
        return masks
    lone = (np.bincount(p)[p] == 1) & (np.bincount(g)[g] == 1)
    masks[:, lone] = reach[lone]
    rest = np.flatnonzero(~lone)
    by_truth = rest[np.lexsort((p[rest], g[rest]))]
    for v, flag in enumerate(regular):
        by_pred = rest[np.lexsort((-order[rest], -iou[rest], ~flag[rest], p[rest]))]
        for i in range(len(levels)):
            a, b = (k[(reach[k] >> i & 1).astype(bool)] for k in (by_pred, by_truth))
            if len(a):
                masks[v, _settle(a, b, p, g, rounds)] |= 1 << i
    return masks


def _settle(a: np.ndarray, b: np.ndarray, p: np.ndarray, g: np.ndarray, rounds: int) -> np.ndarray:
    """The matched ones of pairs ``a`` (in order of prediction, best truth first), which are ``b`` in order of truth and prediction."""
    gone_p, gone_g, leads, won = np.zeros(p.max() + 1, bool), np.zeros(g.max() + 1, bool), np.zeros(len(p), bool), []
    for _ in range(rounds):
        if not len(a):
            break
        pa_, gb = p[a], g[b]
        best = a[np.concatenate([[True], pa_[1:] != pa_[:-1]])]
        first = b[np.concatenate([[True], gb[1:] != gb[:-1]])]
        leads[first] = True
        both = best[leads[best]]
        leads[first] = False
        won.append(both)
        gone_p[p[both]] = True
        gone_g[g[both]] = True
        a, b = a[~(gone_p[pa_] | gone_g[g[a]])], b[~(gone_p[p[b]] | gone_g[gb])]
    taken_p, taken_g, folded = set(), set(), []
    for k, x, y in zip(a.tolist(), p[a].tolist(), g[a].tolist(), strict=True):
        if x not in taken_p and y not in taken_g:
            taken_p.add(x)
            taken_g.add(y)
            folded.append(k)
    return np.concatenate([*won, np.array(folded, np.int64)])


def match_groups(
    batches: Iterator[pa.RecordBatch], names: list[str], wanted: list[str], levels: list[float], tie: str, variants: int, cap: int | None, crowd: int, rounds: int,
) -> Iterator[pa.RecordBatch]:
    """Predictions with their matches (``_settled``) and rows of crowds as they came: the columns ``names``, then ``wanted`` ones, NULL in crowds.

    Rows of a group: truths, or given pairs, first (``_truth``), then predictions, best score first.
    """
    for rows, crowded in whole_groups(batches, crowd):
        if crowded:
            kept, made = rows, {}
        else:
            preds, made = _matched(rows, set(wanted), levels, tie, variants, cap, rounds)
            kept = rows.take(pa.array(preds))
        n = kept.num_rows
        more = [made[c].cast(MADE.get(c, pa.int32())) if c in made else pa.nulls(n, MADE.get(c, pa.int32())) for c in wanted]
        yield pa.RecordBatch.from_arrays(
            [*(kept.column(c) for c in names), *more, pa.array(np.full(n, not crowded))], names=[*names, *wanted, "_settled"]
        )


def _matched(rows: pa.RecordBatch, wanted: set[str], levels: list[float], tie: str, variants: int, cap: int | None, rounds: int) -> tuple[np.ndarray, dict]:
    truth, first = _numpy(rows, "_truth"), _numpy(rows, "_first")
    start, group = np.flatnonzero(first), np.cumsum(first) - 1
    many = np.bincount(group[truth], minlength=len(start))
    preds = np.flatnonzero(~truth)
    rank = preds - (start + many)[group[preds]] + 1
    if cap is not None:
        preds, rank = preds[rank <= cap], rank[rank <= cap]
    if "_iou" in rows.schema.names:
        p, at, iou = given_pairs(rows, group, preds, min(levels))
        other = _numpy(rows, "_other")[at]
        g = np.unique(np.stack([group[at], other]), axis=1, return_inverse=True)[1].reshape(-1) if len(at) else at
    else:
        p, g, iou = box_pairs(rows, preds, many[group[preds]], start[group[preds]], min(levels))
        at, other = g, _numpy(rows, "_index")[g]
    flags = _numpy(rows, "_flags")[at].astype(np.int64) if "_flags" in rows.schema.names else np.ones(len(at), np.int64)
    regular = [(flags >> v & 1).astype(bool) for v in range(variants)]
    masks = greedy(p, g, iou, other if tie == "last" else -other, regular, levels, rounds)
    made = {"rank": pa.array(rank)}
    for v in range(variants):
        if f"_hits_{v}" in wanted:
            made[f"_hits_{v}"] = pa.array(np.bincount(p, masks[v], len(preds)).astype(np.int64))
            made[f"_regular_{v}"] = pa.array(np.bincount(p, np.where(regular[v], masks[v], 0), len(preds)).astype(np.int64))
    if "gt_index" in wanted:  # one level
        hit = masks[0] != 0
        none = np.ones(len(preds), bool)
        none[p[hit]] = False
        for name, values in (("gt_index", other), ("iou", iou), ("on_regular", regular[0])):
            full = np.zeros(len(preds), values.dtype)
            full[p[hit]] = values[hit]
            made[name] = pa.array(full, mask=none)
    if "_at" in wanted:  # a list of the different truths, each with its levels
        hit = np.flatnonzero(masks[0])
        hit = hit[np.argsort(p[hit], kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(p[hit], minlength=len(preds)))]).astype(np.int32)
        values = {"gt_index": other[hit], "iou": iou[hit], "levels": masks[0][hit], "on_regular": regular[0][hit]}
        items = pa.StructArray.from_arrays([pa.array(values[f.name]).cast(f.type) for f in ITEM], fields=list(ITEM))
        made["_at"] = pa.ListArray.from_arrays(pa.array(ends), items, type=MADE["_at"])
    return preds, made

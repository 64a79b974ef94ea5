"""Masks of pages: runs, blobs, holes, tiles and rectangles.

A mask is a row (page_id, h, w, mask), with one byte a pixel, row by row.  Every rule works on one mask, so masks run side by side.
Masks are small and many: rules named ``*_in`` take a stack of equal size (n, h, w) at once and tell for each find the mask it is in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.operators.folds import Box, _pages, _starts, _told, by_page

# Share of the shorter run that joins two runs; largest hole as a share of the mask and in pixels; pixels of a tile.
JOINED, HOLE_SHARE, HOLE_PIXELS, TILE, DILATE = 0.25, 0.12, 4000, 8, 5
#: Pixels of the masks that are looked at together.
STACK = 1 << 21
_BOXES = "page_id long, ix int, x int, y int, w int, h int"
#: Finds of a stack: rows (mask, x, y, w, h), mask by mask.
Finds = np.ndarray


def runs(mask: np.ndarray) -> np.ndarray:
    """(row, begin, end) of each run of set pixels; rows of a stack are numbered through."""
    *above, w = mask.shape
    framed = np.zeros((*above, w + 2), bool)
    np.not_equal(mask, 0, out=framed[..., 1:-1])
    framed = framed.ravel()
    at = np.flatnonzero(framed[1:] != framed[:-1])
    row, begin = np.divmod(at[0::2], w + 2)
    return np.stack([row, begin, at[1::2] - row * (w + 2)], 1)


def _above(found: np.ndarray, joined: float, h: int) -> np.ndarray:
    """For each run the place of the first run of the row above which shares enough of the shorter of the two, else its own place."""
    (row, b, e), at = np.ascontiguousarray(found.T), np.arange(len(found))
    before = row - 1
    if joined >= 0:  # only runs that share a pixel can share enough
        w = int(e.max()) + 1
        low, high = np.searchsorted(row * w + e, before * w + b, "right"), np.searchsorted(row * w + b, before * w + e, "left")
    else:
        low, high = np.searchsorted(row, before, "left"), np.searchsorted(row, before, "right")
    n = np.where(row % h == 0, 0, high - low) if h else high - low
    i = np.repeat(at, n)
    j = np.arange(len(i)) + np.repeat(low - np.cumsum(n) + n, n)
    (bi, ei), (bj, ej) = (b[i], e[i]), (b[j], e[j])
    meets = np.minimum(ei, ej) - np.maximum(bi, bj) > joined * np.minimum(ei - bi, ej - bj)
    i, j = i[meets], j[meets]
    first = np.ones(len(i), bool)
    first[1:] = i[1:] != i[:-1]
    at[i[first]] = j[first]
    return at


def blobs(found: np.ndarray, joined: float = JOINED, h: int = 0) -> np.ndarray:
    """The blob of each run: that of the first run of the row above which shares enough of the shorter of the two, else a new one.

    h: rows of a mask, where the runs are those of a stack; its blobs are numbered through.
    """
    if not len(found):
        return np.zeros(0, np.int64)
    top = _above(found, joined, h)
    fresh = np.cumsum(top == np.arange(len(top))) - 1
    while not np.array_equal(top, up := top[top]):
        top = up
    return fresh[top]


def blob_boxes_in(stack: np.ndarray, least: int, joined: float = JOINED) -> Finds:
    """Boxes around the blobs of at least so many pixels, in order of their first pixel."""
    found, h = runs(stack), stack.shape[1]
    if not len(found):
        return np.zeros((0, 5), np.int64)
    label, (row, begin, end) = blobs(found, joined, h), np.ascontiguousarray(found.T)
    n = int(label.max()) + 1
    low, high, x, x1 = np.full(n, row[-1]), np.zeros(n, np.int64), np.full(n, stack.shape[2]), np.zeros(n, np.int64)
    np.minimum.at(low, label, row)
    np.maximum.at(high, label, row)
    np.minimum.at(x, label, begin)
    np.maximum.at(x1, label, end)
    size = np.bincount(label, weights=end - begin)
    return np.stack([low // h, x, low % h, x1 - x, high - low + 1], 1)[size >= least]


def blob_boxes(mask: np.ndarray, least: int, joined: float = JOINED) -> list[Box]:
    """Boxes around the blobs of one mask."""
    return [tuple(b) for b in blob_boxes_in(mask[None], least, joined)[:, 1:].tolist()]


def filled_in(stack: np.ndarray, share: float = HOLE_SHARE, least: int = HOLE_PIXELS) -> np.ndarray:
    """Masks with the background blobs set that touch no border and are not too large."""
    stack, (_, h, w) = stack != 0, stack.shape
    found = runs(~stack)
    if not len(found):
        return stack
    label, (row, begin, end) = blobs(found, JOINED, h), np.ascontiguousarray(found.T)
    open_ = (row % h == 0) | (row % h == h - 1) | (begin == 0) | (end == w)
    size = np.bincount(label, weights=end - begin)
    hole = (size <= max(least, int(share * h * w))) & (np.bincount(label, weights=open_) == 0)
    row, begin, end = found[hole[label]].T
    out, n = stack.copy(), end - begin
    out.ravel()[np.arange(n.sum()) + np.repeat(row * w + begin - np.cumsum(n) + n, n)] = True
    return out


def filled(mask: np.ndarray, share: float = HOLE_SHARE, least: int = HOLE_PIXELS) -> np.ndarray:
    """One mask with its holes set."""
    return filled_in(mask[None], share, least)[0]


def tile_rects_in(stack: np.ndarray, tile: int = TILE, grow: int = 1) -> Finds:
    """Runs of tiles that hold a set pixel or are near one; a run goes down as long as the rows below hold it and nothing else."""
    n, rows, cols = len(stack), stack.shape[1] // tile, stack.shape[2] // tile
    if not n or not rows or not cols:
        return np.zeros((0, 5), np.int64)
    cells = (stack[:, : rows * tile, : cols * tile] != 0).reshape(n, rows, tile, cols, tile).any(axis=2).any(axis=3)
    for _ in range(max(0, grow)):
        around = np.pad(cells, ((0, 0), (1, 1), (1, 1)))
        cells = cells | around[:, :-2, 1:-1] | around[:, 2:, 1:-1] | around[:, 1:-1, :-2] | around[:, 1:-1, 2:]
    found = runs(cells)
    row, begin, end = found.T
    only = np.bincount(row, minlength=n * rows)[row] == 1
    sole = np.full((n * rows, 2), -1)  # the run of a row that has no other
    sole[row[only]] = found[only, 1:]
    sole, deep = sole.reshape(n, rows, 2), np.zeros((n, rows + 1), np.int64)  # so many rows from here on have the same sole run
    below = np.concatenate([sole, np.full((n, 1, 2), -2)], 1)
    for y in reversed(range(rows)):
        same = (below[:, y] == below[:, y + 1]).all(1)
        deep[:, y] = 1 + np.where(same, deep[:, y + 1], 0)
    mask, y = np.divmod(row, rows)
    down = y + 1 + np.where((below[mask, y + 1] == found[:, 1:]).all(1), deep[mask, y + 1], 0)
    return np.stack([mask, begin * tile, y * tile, (end - begin) * tile, (down - y) * tile], 1)


def tile_rects(mask: np.ndarray, tile: int = TILE, grow: int = 1) -> list[Box]:
    """Runs of tiles of one mask."""
    return [tuple(b) for b in tile_rects_in(mask[None], tile, grow)[:, 1:].tolist()]


def merged(rects: list[Box]) -> list[Box]:
    """Rectangles (x0, y0, x1, y1) of which no two touch, around those that do; in order of the first in each."""
    groups: list[tuple[int, Box]] = []
    for i, rect in enumerate(rects):
        at, rest = i, groups
        while True:
            hits = [g for g in rest if g[1][0] <= rect[2] and rect[0] <= g[1][2] and g[1][1] <= rect[3] and rect[1] <= g[1][3]]
            if not hits:
                break
            rest = [g for g in rest if g not in hits]
            at = min([at, *[g[0] for g in hits]])
            (x0, y0, *_), (*_, x1, y1) = (tuple(map(pick, zip(rect, *[g[1] for g in hits], strict=True))) for pick in (min, max))
            rect = (x0, y0, x1, y1)
        groups = [*rest, (at, rect)]
    return [r for _, r in sorted(groups)]


def drawn(batch: pa.RecordBatch, w: int, h: int, dilate: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, the mask of each row, masks) of some pages of a batch (page_id, x, y, w, h, ...) at a time."""
    x, y, wide, tall = (batch.column(c).to_numpy(zero_copy_only=False) for c in "xywh")
    sides = [np.maximum(0, v).tolist() for v in (y - dilate, y + tall + dilate, x - dilate, x + wide + dilate)]
    starts, step = np.append(_starts(batch.column(0)), batch.num_rows), max(1, STACK // max(1, w * h))
    for a in range(0, len(starts) - 1, step):
        cut = starts[a : a + step + 1]
        out, mask = np.zeros((len(cut) - 1, h, w), np.uint8), np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        for i, top, bottom, left, right in zip(mask.tolist(), *[v[cut[0] : cut[-1]] for v in sides], strict=True):
            out[i, top:bottom, left:right] = 1
        yield batch.slice(cut[0], cut[-1] - cut[0]), mask, out


def draw(boxes: DataFrame, w: int, h: int, dilate: int = DILATE) -> DataFrame:
    """The mask of each page's boxes, grown on all sides; what lies off the page is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, out in drawn(batch, w, h, dilate):
                ids = rows.column(0).take(pa.array(_starts(rows.column(0)))).to_pylist()
                yield _told([(page, h, w, m.tobytes()) for page, m in zip(ids, out, strict=True)], "page_id long, h int, w int, mask binary")

    return by_page(boxes, run, "page_id long, h int, w int, mask binary", ("x", "y", "w", "h"))


def _listed(ids: pa.Array, found: Finds) -> pa.RecordBatch:
    """Finds as boxes of the pages ids, numbered on each page."""
    mask = found[:, 0]
    ix = np.arange(len(mask)) - np.searchsorted(mask, mask)
    columns = [pa.array(c.astype(np.int32)) for c in (ix, *found[:, 1:].T)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(mask)).cast(pa.int64()), *columns], names=[c.split()[0] for c in _BOXES.split(", ")])


def boxes_of(masks: DataFrame, rule: Callable[[np.ndarray], Finds]) -> DataFrame:
    """page_id, ix, x, y, w, h: the boxes that rule finds in each mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            a = 0
            while a < len(sizes):
                b, (h, w) = a + 1, sizes[a]
                while b < len(sizes) and sizes[b] == sizes[a] and (b - a) * h * w < STACK:
                    b += 1
                stack = np.stack([np.frombuffer(m.as_buffer(), np.uint8).reshape(h, w) for m in batch.column(3)[a:b]])
                yield _listed(batch.column(0)[a:b], rule(stack))
                a = b

    return masks.select("page_id", "h", "w", "mask").mapInArrow(run, _BOXES)


def boxes_drawn(boxes: DataFrame, w: int, h: int, dilate: int, rule: Callable[[np.ndarray], Finds]) -> DataFrame:
    """boxes_of(draw(...)) in one go: a page's mask, far larger than its boxes, never leaves the task that draws it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, out in drawn(batch, w, h, dilate):
                yield _listed(rows.column(0).take(pa.array(_starts(rows.column(0)))), rule(out))

    return by_page(boxes, run, _BOXES, ("x", "y", "w", "h"))


def merge_boxes(boxes: DataFrame) -> DataFrame:
    """page_id, ix, x, y, w, h: boxes around all boxes of a page that touch."""

    def rule(page: int, rows: list) -> list[tuple]:
        rows = sorted(rows, key=lambda r: r.ix)
        found = merged([(r.x, r.y, r.x + r.w, r.y + r.h) for r in rows])
        return [(page, i, x, y, a - x, b - y) for i, (x, y, a, b) in enumerate(found)]

    return _pages(boxes, rule, _BOXES)

"""What the pixels of a page tell: blank and coloured pages, ink like a glyph's, and room beside a box."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.operators.folds import PLACE, Box, by_page
from pagewright.operators.masks import drawn, runs

# Mean grey of a blank page, mean chroma of a coloured one, spread of a blank patch, grey of ink and of a glyph, least
# sides; pixels of a stroke and share of dark ones that close a line; height share, least height and greatest width of a wall.
BLANK, CHROMA, SPREAD, INK, GLYPH, LEAST = 250.0, 10.0, 20.0, 150, 128, 8
STROKE, DARK = 3, 0.06
WALL_SHARE, WALL_WIDTH = 0.75, 14


def is_blank(image: np.ndarray) -> bool:
    return float(image.mean()) > BLANK


def is_coloured(rgb: np.ndarray) -> bool:
    return float(np.ptp(rgb.astype(float), axis=2).mean()) > CHROMA


def is_bare(patch: np.ndarray) -> bool:
    """Whether a patch holds no lettering; an empty one doesn't."""
    grey = patch.astype(np.float32).mean(axis=2) if patch.ndim == 3 else patch.astype(np.float32)
    return not grey.size or float(grey.std()) < SPREAD


def glyph_like(grey: np.ndarray, box: Box) -> bool:
    """Whether a box holds ink and none on its border; false for boxes with little on the page."""
    x, y, w, h = box
    ink = grey[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] < GLYPH
    return min(ink.shape) >= LEAST and bool(ink.any()) and ink.sum() == ink[1:-1, 1:-1].sum()


def longest_runs(mask: np.ndarray) -> np.ndarray:
    """The longest run of set pixels in each column."""
    best = np.zeros(mask.shape[1], np.int64)
    found = runs(mask.T)
    np.maximum.at(best, found[:, 0], found[:, 2] - found[:, 1])
    return best


def free_lines(dark: np.ndarray, low: int, high: int, axis: int) -> np.ndarray:
    """Which columns (axis 0) or rows (axis 1) have no stroke and little ink between low and high; none if the band is off the page."""
    band = (dark if axis == 0 else dark.T)[max(0, low) : max(0, high)]
    return (longest_runs(band) < STROKE) & (band.mean(axis=0) < DARK) if len(band) else np.zeros(0, bool)


def room(free: np.ndarray, begin: int, end: int, limit: int) -> int:
    """How far a stretch can grow on both sides through free lines."""
    begin, end = np.clip([begin, end], 0, len(free))
    if begin >= end:
        return 0
    sides = [np.append(side[:limit], False) for side in (free[:begin][::-1], free[end:])]
    return int(min(s.argmin() for s in sides))


def thin_walls(grey: np.ndarray, top: int, bottom: int) -> np.ndarray:
    """Columns of narrow lines of ink that go through most of a strip."""
    ink = grey[max(0, top) : max(0, bottom)] < INK
    out = np.zeros(grey.shape[1], bool)
    if len(ink) < LEAST:
        return out
    tall = longest_runs(ink) >= max(LEAST, int(WALL_SHARE * len(ink)))
    for _, a, b in runs(tall[None]):
        out[a:b] = b - a <= WALL_WIDTH
    return out


def _tallies(dark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first i pixels along the first axis are set, and how many strokes begin there."""
    n, *others = dark.shape
    strokes = dark[: max(0, n - STROKE + 1)].copy()
    for k in range(1, STROKE):
        strokes &= dark[k : k + len(strokes)]
    out = []
    for what in (dark, strokes):
        sums = np.zeros((n + 1, *others), np.min_scalar_type(n))
        for i in range(n):
            sums[i + 1] = sums[i] + what[i] if i < len(what) else sums[i]
        out.append(sums)
    return out[0], out[1]


def _rooms_along(dark: np.ndarray, mask: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    """room(free_lines(...)) for many boxes at once: bands from low to high along the first axis of dark (length, masks, lines).

    A box's own pixels need not be taken off: they lie in lines from begin to end, which room() does not ask for.
    """
    length, _, lines = dark.shape
    sums, strokes = _tallies(dark)
    low, high = np.clip(low, 0, length), np.clip(high, 0, length)
    n = high - low
    free = strokes[np.maximum(low, high - STROKE + 1), mask] == strokes[low, mask]
    free &= (sums[np.maximum(low, high), mask] - sums[low, mask]) / np.maximum(n, 1)[:, None] < DARK
    at, each = np.arange(lines, dtype=np.int32), np.arange(len(mask))
    last, next_ = np.full((len(mask), lines + 1), -1, np.int32), np.full((len(mask), lines + 1), lines, np.int32)
    np.maximum.accumulate(np.where(free, -1, at), axis=1, out=last[:, 1:])
    next_[:, :-1] = np.minimum.accumulate(np.where(free, lines, at)[:, ::-1], axis=1)[:, ::-1]
    begin, end = np.clip(begin, 0, lines), np.clip(end, 0, lines)
    got = np.minimum(np.minimum(begin - 1 - last[each, begin], next_[each, end] - end), limit)
    return np.where((n > 0) & (begin < end), got, 0).astype(np.int32)


def rooms(boxes: DataFrame, w: int, h: int, limit: int) -> DataFrame:
    """page_id, ix, wider, taller: how far each box can grow sideways and up and down without meeting the other boxes of its page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, mask, out in drawn(batch, w, h, 0):
                x, y, wide, tall = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xywh")
                down, across = (np.ascontiguousarray(out.transpose(axes)).view(bool) for axes in ((1, 0, 2), (2, 0, 1)))
                wider = _rooms_along(down, mask, y, y + tall, x, x + wide, limit)
                taller = _rooms_along(across, mask, x, x + wide, y, y + tall, limit)
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), rows.column(1).cast(pa.int32()), pa.array(wider), pa.array(taller)], names=["page_id", "ix", "wider", "taller"])

    return by_page(boxes, run, "page_id long, ix int, wider int, taller int", PLACE)


def looks(images: DataFrame) -> DataFrame:
    """page_id, blank, coloured of images (page_id, h, w, rgb), three bytes a pixel."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pages = [np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3) for r in pdf.itertuples()]
            yield pd.DataFrame({"page_id": pdf["page_id"], "blank": [is_blank(p) for p in pages], "coloured": [is_coloured(p) for p in pages]})

    return images.select("page_id", "h", "w", "rgb").mapInPandas(run, "page_id long, blank boolean, coloured boolean")

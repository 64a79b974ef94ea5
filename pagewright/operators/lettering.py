"""Line breaking, the place of a block of lines in a balloon, and balloons that overlap.

Widths come from the caller: a font's advances are data, so any measure can be passed as a function of a text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.folds import Box, _pages, _shared

# Costs of a word wider than the line and of a last word alone; share of the smaller height that makes two balloons
# one; least height of a region that holds lines.
TOO_WIDE, ALONE, STACKED, LEAST_HEIGHT = 2.0, 0.6, 0.4, 8
# Legal breaks inside a word are after a hyphen and before a closing run of dots.
HYPHENED, DOTTED = "[^-]*-|[^-]+", "^(.*[^.．…])([.．…]{2,})$"
_HYPHENED, _DOTTED = re.compile(HYPHENED), re.compile(DOTTED)
#: What words are between: Unicode's white space.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Tokens up to which a plain loop breaks lines faster than arrays do.
FEW = 48


def word_parts(word: Column) -> Column:
    """Pieces into which a word may be broken, empty if it may not; a null word has none."""
    pieces = F.regexp_extract_all(word, F.lit(HYPHENED), F.lit(0))
    dotted = F.array(F.regexp_extract(word, DOTTED, 1), F.regexp_extract(word, DOTTED, 2))
    return F.when(F.size(pieces) > 1, pieces).when(word.rlike(DOTTED), dotted).otherwise(F.array().cast("array<string>"))


def pieces(word: str) -> list[str]:
    """word_parts of one word, which holds no white space."""
    found = _HYPHENED.findall(word) if "-" in word else []
    dotted = _DOTTED.match(word) if len(found) < 2 else None
    return list(dotted.groups()) if dotted else found if len(found) > 1 else []


def best_breaks(words: np.ndarray, joints: np.ndarray, room: float) -> list[int]:
    """First words of the lines that leave the least squared slack, by widths of words and of what lies between them."""
    n = len(words)
    if n <= FEW and room and math.isfinite(room):
        return _few_breaks(np.asarray(words, float).tolist(), np.asarray(joints, float).tolist(), float(room))
    begin = np.concatenate([[0], np.cumsum(words[:-1] + joints)])  # where a word starts if all stand on one line
    cost, after = np.zeros(n + 1), np.zeros(n, np.int64)
    for i in reversed(range(n)):
        wide = begin[i:] + words[i:] - begin[i]
        over = np.flatnonzero(wide[1:] > room)
        wide = wide[: over[0] + 1] if len(over) else wide
        own = ((room - wide) / room) ** 2
        if i + len(wide) == n:
            own[-1] = ALONE if len(wide) == 1 else 0.0
        if wide[0] > room:
            own[0] = TOO_WIDE
        total = own + cost[i + 1 : i + 1 + len(wide)]
        after[i] = i + 1 + int(np.argmin(total))
        cost[i] = total.min()
    out = [0]
    while after[out[-1]] < n:
        out.append(int(after[out[-1]]))
    return out


def _few_breaks(words: list[float], joints: list[float], room: float) -> list[int]:
    """best_breaks in plain numbers, sum by sum as there."""
    n, at = len(words), 0.0
    begin = [at]
    for w, j in zip(words, joints):
        at += w + j
        begin.append(at)
    cost, after = [0.0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        best, to, left = math.inf, i + 1, begin[i]
        for j in range(i, n):
            wide = begin[j] + words[j] - left
            if j > i and wide > room:
                break
            if j == i and wide > room:
                own = TOO_WIDE
            elif j == n - 1:
                own = ALONE if j == i else 0.0
            else:
                own = (room - wide) / room
                own *= own
            if own + cost[j + 1] < best:
                best, to = own + cost[j + 1], j + 1
        cost[i], after[i] = best, to
    out = [0]
    while after[out[-1]] < n:
        out.append(after[out[-1]])
    return out


def wrapped(words: list[str], room: float, measure: Callable[[str], float]) -> list[str]:
    """Lines of a text; a word wider than the room is broken where all its pieces fit."""
    tokens: list[str] = []
    for word in words:
        parts = pieces(word) if measure(word) > room else []
        tokens += parts if parts and max(map(measure, parts)) <= room else [word]
    if len(tokens) < 2:
        return tokens or [""]
    wide = [float(measure(t)) for t in tokens]
    joints = [measure(f"{a} {b}") - x - y for a, b, x, y in zip(tokens, tokens[1:], wide, wide[1:])]
    few = len(tokens) <= FEW and room and math.isfinite(room)
    starts = _few_breaks(wide, joints, room) if few else best_breaks(np.array(wide), np.array(joints), room)
    return [" ".join(tokens[a:b]) for a, b in zip(starts, [*starts[1:], len(tokens)], strict=True)]


def wrap(texts: DataFrame, measure: Callable[[str], float], text: str = "text", room: str = "room") -> DataFrame:
    """texts with lines, an array; a null text counts as empty and has one empty line."""
    ready = texts.withColumn("_text", F.col(text)).withColumn("_room", F.col(room).cast("double"))
    schema = texts.schema.simpleString()[7:-1] + ",lines:array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, said, wide = batch.columns
            rows = zip(said.to_pylist(), wide.to_pylist(), strict=True)
            lines = [wrapped([w for w in _SPACES.split(t or "") if w], math.nan if r is None else r, measure) for t, r in rows]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lines, pa.list_(pa.string()))], names=[*batch.schema.names[:-2], "lines"])

    return ready.mapInArrow(run, schema)


def block_top(bands: list[tuple[int, int]], wide: list[float], profile: np.ndarray, height: int, tolerance: float = 1.0, pad: int = 0, step: int = 1) -> int | None:
    """The top nearest the middle at which each line's band of rows is wide enough, by the width free in each row; None if there is none."""
    tall = bands[-1][1] - bands[0][0] if bands else 0
    if not bands or len(bands) != len(wide) or not len(profile) or height < LEAST_HEIGHT or tall <= 0:
        return None
    last, middle = max(0, height - tall), max(0, (height - tall) // 2)
    tops = np.unique(np.r_[0 : last + 1 : max(1, step), last, middle])
    fits = np.ones(len(tops), bool)
    for (y0, y1), w in zip(bands, wide, strict=True):
        narrow = np.concatenate([[0], np.cumsum(profile < math.ceil(w / max(tolerance, 1e-6)))])
        a = np.clip(tops + y0 - pad, 0, len(profile) - 1)
        b = np.maximum(a + 1, np.minimum(tops + y1 + pad, len(profile)))
        fits &= narrow[b] == narrow[a]
    found = tops[fits]
    return int(min(found, key=lambda t: (abs(t - middle), t))) if len(found) else None


def parted(regions: list[Box]) -> list[Box]:
    """Regions whose heights overlap by a good part, each cut at the middle of what they share; pairs in order, on what is left."""
    out = list(regions)
    for i in range(len(out)):
        for j in range(i + 1, len(out)):
            up, low = (i, j) if out[i][1] <= out[j][1] else (j, i)
            (ux, uy, uw, uh), (lx, ly, lw, lh) = out[up], out[low]
            both = _shared(out[up], out[low], 1)
            if _shared(out[up], out[low], 0) <= 0 or both <= 0 or both < STACKED * min(uh, lh):
                continue
            cut = (ly + ly + both) // 2
            out[up], out[low] = (ux, uy, uw, max(1, cut - uy)), (lx, cut, lw, max(1, ly + lh - cut))
    return out


def part_regions(boxes: DataFrame) -> DataFrame:
    """page_id, ix, x, y, w, h of each page's regions after overlapping ones are cut apart, in order of ix."""

    def rule(page: int, rows: list) -> list[tuple]:
        rows = sorted(rows, key=lambda r: r.ix)
        cut = parted([(int(r.x), int(r.y), int(r.w), int(r.h)) for r in rows])
        return [(page, r.ix, *b) for r, b in zip(rows, cut, strict=True)]

    return _pages(boxes, rule, "page_id long, ix int, x int, y int, w int, h int")

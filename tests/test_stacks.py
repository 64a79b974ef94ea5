"""Rules of stacked masks against the same rules on one mask at a time, and rooms against their plain rule."""

import numpy as np
import pytest

from pagewright.operators import masks, rasters


def _stack(rng, n=9, h=23, w=31):
    out = np.zeros((n, h, w), np.uint8)
    for m in out[1:]:
        for _ in range(4):
            y, x, a, b = rng.integers(0, [h, w, 12, 12])
            m[y : y + a, x : x + b] = 1
            m[y + 2 : y + a - 2, x + 2 : x + b - 2] = 0
        m[rng.random((h, w)) < 0.05] ^= 1
    return out


@pytest.mark.parametrize(("many", "one"), [
    (lambda s: masks.blob_boxes_in(s, 2), lambda m: masks.blob_boxes(m, 2)),
    (lambda s: masks.blob_boxes_in(s, 1, -0.5), lambda m: masks.blob_boxes(m, 1, -0.5)),
    (lambda s: masks.tile_rects_in(s, 4), lambda m: masks.tile_rects(m, 4)),
    (lambda s: masks.tile_rects_in(s, 3, 0), lambda m: masks.tile_rects(m, 3, 0)),
])
def test_stacks(many, one):
    rng = np.random.default_rng(5)
    for _ in range(20):
        stack = _stack(rng)
        assert many(stack).tolist() == [[i, *b] for i, m in enumerate(stack) for b in one(m)]
        assert np.array_equal(masks.filled_in(stack, 0.1, 5), np.stack([masks.filled(m, 0.1, 5) for m in stack]))


def _blobs(mask, joined):
    """Labels of runs by the rule as it reads: row by row, run by run."""
    label, before, fresh = [], [], 0
    for y in range(len(mask)):
        own = []
        for row, b, e in masks.runs(mask).tolist():
            if row == y:
                home = next((k for pb, pe, k in before if min(e, pe) - max(b, pb) > joined * min(e - b, pe - pb)), None)
                fresh, home = (fresh + 1, fresh) if home is None else (fresh, home)
                own.append((b, e, home))
        label += [k for _, _, k in own]
        before = own
    return label


@pytest.mark.parametrize("joined", [-0.5, 0.0, 0.25, 0.8])
def test_blobs_follow_the_rule(joined):
    rng = np.random.default_rng(6)
    for mask in _stack(rng, 30):
        assert masks.blobs(masks.runs(mask), joined).tolist() == _blobs(mask, joined)


def test_drawn_in_one_go(spark):
    rng = np.random.default_rng(7)
    table = [(p, int(i), *map(int, rng.integers([-5, -5, 0, 0], [60, 40, 30, 30]))) for p in range(40) for i in range(5)]
    boxes = spark.createDataFrame(table, "page_id long, ix int, x int, y int, w int, h int")
    rule = lambda stack: masks.blob_boxes_in(stack, 3)
    one_go, apart = masks.boxes_drawn(boxes, 60, 40, 2, rule), masks.boxes_of(masks.draw(boxes, 60, 40, 2), rule)
    assert sorted(one_go.collect()) == sorted(apart.collect())
    calls = [x._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for x in (one_go, apart)]
    assert 2 * calls[0] == calls[1]


def test_rooms(spark):
    rng = np.random.default_rng(8)
    table = [(p, i, *map(int, rng.integers([-8, -8, -1, -1], [65, 45, 16, 16]))) for p in range(60) for i in range(p % 6 + 1)]
    boxes = spark.createDataFrame(table, "page_id long, ix int, x int, y int, w int, h int")
    want = []
    for p, i, x, y, w, h in table:
        dark = np.zeros((40, 60), bool)
        for q, j, a, b, c, d in table:
            if q == p and j != i:
                dark[max(0, b) : max(0, b + d), max(0, a) : max(0, a + c)] = True
        free = [rasters.free_lines(dark, y, y + h, 0), rasters.free_lines(dark, x, x + w, 1)]
        want.append((p, i, rasters.room(free[0], x, x + w, 9), rasters.room(free[1], y, y + h, 9)))
    found = rasters.rooms(boxes, 60, 40, 9)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()

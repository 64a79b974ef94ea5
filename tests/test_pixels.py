"""Line breaking, places of blocks, overlapping balloons and masks against plain counterparts."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import fonts, lettering, masks, rasters
from pagewright.plans import pixel_queries


@pytest.mark.parametrize(("word", "parts"), [("MIO-SAN!", ["MIO-", "SAN!"]), ('"normal"...', ['"normal"', "..."]), ("plain", []), ("...", []), ("end.", []), ("a-", []), (None, [])])
def test_parts(spark, word, parts):
    assert spark.createDataFrame([(word,)], "w string").select(lettering.word_parts(F.col("w")).alias("p")).first()["p"] == parts


def _cost(lines, room, wide):
    out = 0.0
    for i, line in enumerate(lines):
        alone, w = len(line) == 1, wide(line)
        out += 2.0 if w > room else ((0.6 if alone else 0.0) if i == len(lines) - 1 else ((room - w) / room) ** 2)
    return out


def test_breaks_are_the_best():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, room = int(rng.integers(2, 8)), float(rng.integers(20, 90))
        words = rng.integers(5, 60, n).astype(float)
        starts = lettering.best_breaks(words, np.full(n - 1, 4.0), room)
        wide = lambda line: words[line].sum() + 4 * (len(line) - 1)
        every = []
        for cuts in itertools.product([0, 1], repeat=n - 1):
            lines = np.split(np.arange(n), [i + 1 for i, c in enumerate(cuts) if c])
            if all(len(x) == 1 or wide(x) <= room for x in lines):
                every.append(_cost(lines, room, wide))
        assert _cost(np.split(np.arange(n), starts[1:]), room, wide) == pytest.approx(min(every))


def test_wrap(spark):
    table = spark.createDataFrame([(1, "one two three", 80), (2, "", 80), (3, None, 80), (4, "MIO-SAN! yes", 50), (5, "unbreakable", 30)], "id int, text string, room int")
    got = {r["id"]: r["lines"] for r in lettering.wrap(table, lambda t: 10 * len(t)).collect()}
    assert got == {1: ["one two", "three"], 2: [""], 3: [""], 4: ["MIO-", "SAN!", "yes"], 5: ["unbreakable"]}


def test_block_top():
    rng = np.random.default_rng(2)
    for _ in range(200):
        profile, height = rng.integers(5, 60, 40), int(rng.integers(6, 50))
        bands, wide, pad = [(0, 6), (8, 14)], rng.integers(1, 30, 2).tolist(), int(rng.integers(0, 3))

        def fits(top):
            rows = [profile[max(0, min(top + a - pad, 39)) : max(max(0, min(top + a - pad, 39)) + 1, min(top + b + pad, 40))] for a, b in bands]
            return all(r.min() >= w for r, w in zip(rows, wide, strict=True))

        middle = max(0, (height - 14) // 2)
        ok = [t for t in range(max(0, height - 14) + 1) if fits(t)] if height >= 8 else []
        assert lettering.block_top(bands, wide, profile, height, pad=pad) == min(ok, key=lambda t: (abs(t - middle), t), default=None)
    assert lettering.block_top([], [], np.ones(5), 20) is None


def test_parted():
    assert lettering.parted([(0, 0, 100, 100), (10, 50, 100, 100)]) == [(0, 0, 100, 75), (10, 75, 100, 75)]
    assert lettering.parted([(10, 50, 100, 100), (0, 0, 100, 100)]) == [(10, 75, 100, 75), (0, 0, 100, 75)]
    apart = [(0, 0, 100, 100), (0, 90, 100, 100), (200, 0, 10, 100)]
    assert lettering.parted(apart) == apart
    assert lettering.parted([]) == []


def _labels(mask):
    """Boxes and sizes of four-connected blobs by flooding, for masks without narrow joints."""
    left, out = set(zip(*np.nonzero(mask), strict=True)), []
    while left:
        todo, own = [min(left)], []
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                own.append(p)
                todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
        y, x = np.array(own).T
        out.append((x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1))
    return sorted(out)


def test_blobs_and_holes():
    mask = np.zeros((40, 60), np.uint8)
    mask[2:8, 3:12] = mask[10:30, 20:40] = mask[35:38, 0:60] = 1
    assert sorted(masks.blob_boxes(mask, 1)) == _labels(mask)
    assert masks.blob_boxes(mask, 100) == [(20, 10, 20, 20), (0, 35, 60, 3)]
    mask[15:20, 25:30] = 0
    assert masks.filled(mask)[15:20, 25:30].all() and masks.filled(mask).sum() == mask.sum() + 25
    assert not masks.filled(mask, 0.0, 24)[15:20, 25:30].any()
    assert not masks.filled(np.zeros((4, 4))).any() and masks.filled(np.ones((4, 4))).all()
    assert masks.blob_boxes(np.zeros((4, 4)), 1) == []


def test_tiles():
    mask = np.zeros((40, 40), np.uint8)
    mask[8:24, 8:16] = 1
    assert masks.tile_rects(mask, grow=0) == [(8, 8, 8, 16), (8, 16, 8, 8)]
    assert masks.tile_rects(mask) == [(8, 0, 8, 8), (0, 8, 24, 16), (0, 16, 24, 8), (8, 24, 8, 8)]
    assert masks.tile_rects(np.ones((7, 40))) == []


def test_merged():
    rng = np.random.default_rng(3)
    for _ in range(100):
        at = rng.integers(0, 60, (8, 2))
        left = rects = [(*p, *(p + s)) for p, s in zip(at.tolist(), rng.integers(1, 14, (8, 2)), strict=True)]
        left = [tuple(int(v) for v in r) for r in left]
        rects = list(left)
        clash = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
        while hit := next(((a, b) for a, b in itertools.combinations(range(len(left)), 2) if clash(left[a], left[b])), None):
            a, b = (left[i] for i in hit)
            left[hit[0]] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
            del left[hit[1]]
        assert sorted(masks.merged(rects)) == sorted(left)
    assert masks.merged([]) == []


@pytest.mark.parametrize("name", [n for n in pixel_queries.QUERIES if n not in pixel_queries.ORACLE])
def test_queries_run(spark, name):
    assert pixel_queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_fonts(spark):
    catalog = [("a", "A", "a.ttf", False, 0), ("b", "B", "b.ttf", True, 1), ("comic-neue", "C", "c.ttf", False, 2)]
    catalog = spark.createDataFrame(catalog, "font_id string, name string, filename string, is_default boolean, pos int")

    def used(files, asked):
        files = spark.createDataFrame(files, "filename string, path string, folder int")
        listed = fonts.listing(catalog, files)
        r = fonts.legible(fonts.resolved(spark.createDataFrame([(asked,)], "font_id string"), listed), listed).first()
        return r["used_id"], r["path"], r["fallback"]

    every = [("a.ttf", "/x/a", 1), ("a.ttf", "/w/a", 0), ("b.ttf", "/x/b", 0), ("c.ttf", "/x/c", 0)]
    assert used(every, "a") == ("a", "/w/a", "/x/c")
    assert used(every, "zz") == used(every, None) == ("b", "/x/b", "/x/c")
    assert used(every, "comic-neue") == ("comic-neue", "/x/c", None)
    assert used(every[:2], None) == ("a", "/w/a", None)
    assert used([], "a") == (None, None, None)


@pytest.mark.parametrize(("path", "stem"), [("/data/jobs/12/o/p.1.jpg", "j12_p.1"), ("C:\\jobs\\7\\p.png", "j7_C:\\jobs\\7\\p"), ("p", "p"), ("/a/p.png", "p")])
def test_stems(spark, path, stem):
    assert spark.createDataFrame([(path,)], "p string").select(T.page_stem(F.col("p")).alias("s")).first()["s"] == stem


def test_room():
    rng = np.random.default_rng(4)
    for _ in range(100):
        mask = rng.random((12, 15)) < 0.3
        runs_ = [max((len(list(g)) for k, g in itertools.groupby(c) if k), default=0) for c in mask.T]
        assert rasters.longest_runs(mask).tolist() == runs_
        free, (a, b), limit = rng.random(20) < 0.8, sorted(rng.integers(-2, 24, 2).tolist()), int(rng.integers(0, 9))
        lo, hi, n = max(0, min(a, 20)), max(0, min(b, 20)), 0
        while lo < hi and n < limit and lo - n - 1 >= 0 and hi + n < 20 and free[lo - n - 1] and free[hi + n]:
            n += 1
        assert rasters.room(free, a, b, limit) == n
    assert len(rasters.free_lines(np.zeros((5, 5), bool), 3, 3, 0)) == 0
    grey = np.full((40, 60), 255)
    grey[:, 10:13] = grey[:, 30:50] = 0
    assert np.flatnonzero(rasters.thin_walls(grey, 0, 40)).tolist() == [10, 11, 12]
    assert not rasters.thin_walls(grey, 0, 7).any()


def test_looks(spark):
    red = np.zeros((4, 4, 3), np.uint8)
    red[:, :, 0] = 200
    pages = [(1, 4, 4, bytearray(b"\xff" * 48)), (2, 4, 4, bytearray(red.tobytes())), (3, 4, 4, bytearray(48))]
    got = rasters.looks(spark.createDataFrame(pages, "page_id long, h int, w int, rgb binary")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, True, False), (2, False, True), (3, False, False)]
    grey = np.full((20, 20), 255)
    grey[8:12, 8:12] = 0
    assert rasters.glyph_like(grey, (4, 4, 12, 12)) and not rasters.glyph_like(grey, (8, 4, 12, 12)) and not rasters.glyph_like(grey, (0, 0, 7, 7))
    assert rasters.is_bare(np.zeros((0, 3))) and rasters.is_bare(np.full((4, 4), 9)) and not rasters.is_bare(grey[:, 5:])

"""Boxes struct<x,y,w,h> as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def area(b: Column) -> Column:
    return b["w"].cast("long") * b["h"]


def inter(a: Column, b: Column) -> Column:
    """Area that two boxes share; touching edges share none."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0)).cast("long") * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(inter(a, b), area(a) + area(b) - inter(a, b)), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared area over the smaller box."""
    return F.coalesce(F.try_divide(inter(a, b), F.least(area(a), area(b))), F.lit(0.0))


def intersects(a: Column, b: Column) -> Column:
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def overlaps(a: Column, b: Column) -> Column:
    return (iou(a, b) > 0.5) | (containment(a, b) > 0.5)


def centre_in(a: Column, b: Column) -> Column:
    """Whether a's centre (integer halves) lies in b, edges included."""
    cx, cy = a["x"] + F.floor(a["w"] / 2), a["y"] + F.floor(a["h"] / 2)
    return cx.between(b["x"], b["x"] + b["w"]) & cy.between(b["y"], b["y"] + b["h"])


def orientation(w: Column, h: Column) -> Column:
    return F.when((w <= 16) & (h > 2 * w), "furigana").when(h > 1.5 * w, "vertical").otherwise("horizontal")


def inset(b: Column, wx: float = 0.15, hy: float = 0.12) -> Column:
    """Shrinks a box by a fraction on each side; a box that would fall under 8 stays."""
    dx, dy = (b["w"] * wx).cast("int"), (b["h"] * hy).cast("int")
    w, h = b["w"] - 2 * dx, b["h"] - 2 * dy
    return F.when((w < 8) | (h < 8), b).otherwise(box(b["x"] + dx, b["y"] + dy, w, h))


def is_corner_mark(b: Column, page_w: Column, page_h: Column) -> Column:
    """A narrow box in the lowest 6 % of the page that hugs one of its sides; never on a page without height."""
    narrow, side = b["w"] < 0.25 * page_w, (b["x"] < 0.25 * page_w) | (b["x"] + b["w"] > 0.75 * page_w)
    return (page_h > 0) & (b["y"] > 0.94 * page_h) & side & narrow


def is_title(b: Column, kind: Column, text: Column, page_h: Column) -> Column:
    """Large horizontal lettering, or large vertical lettering with few glyphs for its size; never on a page without height."""
    sparse = F.try_divide(F.char_length(F.trim(F.coalesce(text, F.lit("")))) * 10000.0, area(b)) < 0.8
    return (page_h > 0) & (((b["h"] > 0.15 * page_h) & (b["w"] > b["h"])) | ((kind == "vertical") & (area(b) >= 100_000) & sparse))


def capacity(w: Column, h: Column, glyph: Column) -> Column:
    """Glyphs of a height that fit into a box: lines at 1.15 of it, halves to even, each with a quarter more than its width holds; three at least."""
    g = F.greatest(glyph.cast("int"), F.lit(1))
    lines = F.greatest(F.bround(F.greatest(h, F.lit(1)) / (1.15 * g)).cast("int"), F.lit(1))
    return F.greatest((F.greatest(w, F.lit(1)) / g.cast("double") * 1.25 * lines).cast("int"), F.lit(3))


# Sizes and scores of boxes that are likely noise, screentone or drawn sound.
NOISE_SIDE, NOISE_SCORE = 55, 0.9
TALL_WIDTH, TALL_HEIGHT, TALL_SCORE = 48, 80, 0.44
SOUND_CHARS, SOUND_HEIGHT, SOUND_AREA, SOUND_SHAPE = 8, 28, 60_000, 0.55
STUB_AREA = 25_000
COVER_BLOCK, COVER_MUTUAL = 0.25, 0.15
BALLOON_SLACK, BALLOON_PAGE, BALLOON_TIMES = 2, 0.55, 6.0
LEAST_ON_PAGE = 12


def _let(value: Column, body) -> Column:
    """body(value), in which value is computed once however often it occurs."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def polygon_box(points: Column) -> Column:
    """Box of an array of struct<x,y>; fractions are cut off."""

    def around(points: Column) -> Column:
        side = lambda pick, f: pick(F.transform(points, lambda p: p[f])).cast("int")
        sides = F.struct(side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))
        return _let(sides, lambda s: box(s["x0"], s["y0"], s["x1"] - s["x0"], s["y1"] - s["y0"]))

    return _let(points, around)


def quad_angle(points: Column) -> Column:
    """Degrees of the longest edge (the first of equals), turned into -45 to 45."""

    def longest(points: Column) -> Column:
        n = F.size(points)

        def edge(p: Column, i: Column) -> Column:
            q = F.get(points, (i + 1) % n)
            dx, dy = (q["x"] - p["x"]).cast("double"), (q["y"] - p["y"]).cast("double")
            return F.struct(F.hypot(dx, dy).alias("size"), (-i).alias("first"), F.degrees(F.atan2(dy, dx)).alias("turn"))

        return F.array_max(F.transform(points, edge))["turn"]

    def turned(turn: Column) -> Column:
        return turn - 90 * F.when(turn > 45, F.ceil((turn - 45) / 90)).when(turn < -45, F.floor((turn + 45) / 90)).otherwise(0)

    return _let(_let(points, longest), turned)


def is_noise(w: Column, h: Column, score: Column) -> Column:
    """Small and read with little confidence; no score never is."""
    return F.coalesce((w < NOISE_SIDE) & (h < NOISE_SIDE) & (score < NOISE_SCORE), F.lit(False))


def is_screentone(w: Column, h: Column, score: Column) -> Column:
    """Narrow, tall and of low score; no score never is."""
    return F.coalesce((w <= TALL_WIDTH) & (h >= TALL_HEIGHT) & (score < TALL_SCORE), F.lit(False))


def is_drawn_sound(b: Column, kind: Column, text: Column) -> Column:
    """Few characters in a large box that is horizontal, or wide for its height."""
    n = F.char_length(F.trim(F.coalesce(text, F.lit(""))))
    large = (b["h"] >= SOUND_HEIGHT) & (area(b) >= SOUND_AREA)
    return n.between(1, SOUND_CHARS) & large & ((kind == "horizontal") | (b["w"] >= SOUND_SHAPE * b["h"]))


def expand(b: Column, wx: float = 0.25, hy: float = 0.2) -> Column:
    """Grows a box by a fraction of its size on each side; its corner stays on the page."""
    dx, dy = (b["w"] * wx).cast("int"), (b["h"] * hy).cast("int")
    return box(F.greatest(b["x"] - dx, F.lit(0)), F.greatest(b["y"] - dy, F.lit(0)), b["w"] + 2 * dx, b["h"] + 2 * dy)


def covers(bubble: Column, block: Column) -> Column:
    """Whether a block takes up a bubble: a quarter of the block lies in it, or the two overlap substantially."""
    held = F.try_divide(inter(bubble, block), area(block))
    return F.coalesce((held >= COVER_BLOCK) | (held > 0) & (iou(bubble, block) >= COVER_MUTUAL), F.lit(False))


def inside_half(outer: Column, b: Column) -> Column:
    """Whether half of b or more lies in outer."""
    return inter(outer, b) >= 0.5 * area(b)


def gap(a: Column, b: Column) -> Column:
    """Distance of the edges of two boxes; 0 if they touch."""
    apart = lambda at, size: F.greatest(F.greatest(a[at], b[at]) - F.least(a[at] + a[size], b[at] + b[size]), F.lit(0))
    return F.hypot(apart("x", "w").cast("double"), apart("y", "h").cast("double"))


def enlargement(own: Column, others: Column) -> Column:
    """How far a window about a box may grow: by its shape, thrice at most, less where another's window would meet it."""
    half = (own["w"] + own["h"]) / 2
    shape = F.greatest(own["w"] / own["h"], own["h"] / own["w"])

    def less(ratio: Column, b: Column) -> Column:
        grow = (ratio - 1) / 2
        meets = lambda at, size: (F.abs(2 * own[at] + own[size] - 2 * b[at] - b[size]) / 2
                                  < (0.5 + grow) * (own[size] + b[size]))
        near = (b["w"] > 0) & (b["h"] > 0) & meets("x", "w") & meets("y", "h")
        return F.when(near, F.least(ratio, gap(own, b) / (2 * half) + 1)).otherwise(ratio)

    grown = F.aggregate(others, F.least(shape * 1.5, F.lit(3.0)).cast("double"), less)
    return F.when((own["w"] <= 0) | (own["h"] <= 0), F.lit(1.5)).otherwise(F.greatest(grown, F.lit(1.0)))


def plausible_balloon(flood: Column, text: Column, named: Column, page_w: Column, page_h: Column) -> Column:
    """Whether a flooded box can be the balloon of a text: it holds it, is no page and not far larger than the box named."""
    s = BALLOON_SLACK
    holds = (flood["x"] <= text["x"] + s) & (flood["y"] <= text["y"] + s)
    holds &= (flood["x"] + flood["w"] >= text["x"] + text["w"] - s) & (flood["y"] + flood["h"] >= text["y"] + text["h"] - s)
    fair = named.isNull() | (area(flood) <= BALLOON_TIMES * F.greatest(area(named), F.lit(1)))
    return holds & (area(flood) <= BALLOON_PAGE * page_w * page_h) & fair


def on_page(b: Column, page_w: Column, page_h: Column, least: int = LEAST_ON_PAGE) -> Column:
    """The part of a box on the page; null if a side of it is too short."""
    x0, y0 = F.greatest(b["x"], F.lit(0)), F.greatest(b["y"], F.lit(0))
    w, h = F.least(b["x"] + b["w"], page_w) - x0, F.least(b["y"] + b["h"], page_h) - y0
    return F.when((w >= least) & (h >= least), box(x0, y0, w, h))


def near(a: Column, b: Column, grow: float = 1.2) -> Column:
    """Whether two boxes lie within so many heights of the taller one."""
    slack = grow * F.greatest(a["h"], b["h"], F.lit(1))
    apart = lambda p, q, at, size: p[at] + p[size] + slack < q[at]
    return ~(apart(a, b, "x", "w") | apart(b, a, "x", "w") | apart(a, b, "y", "h") | apart(b, a, "y", "h"))


def clip_off(region: Column, own: Column, others: Column) -> Column:
    """A region pulled in, side by side, to the other boxes that lie beside its own box; never inside its own box."""
    cx, cy = own["x"] + own["w"] / 2.0, own["y"] + own["h"] / 2.0
    edges = lambda x0, y0, x1, y1: F.struct(*[c.cast("int").alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])

    def pull(s: Column, b: Column) -> Column:
        far_x, far_y = b["x"] + b["w"], b["y"] + b["h"]
        rows = F.least(s["y1"], far_y) > F.greatest(s["y0"], b["y"])
        left = rows & (far_x <= cx) & (far_x > s["x0"])
        right = rows & ~left & (b["x"] >= cx) & (b["x"] < s["x1"])
        x0, x1 = F.when(left, far_x).otherwise(s["x0"]), F.when(right, b["x"]).otherwise(s["x1"])
        cols = F.least(x1, far_x) > F.greatest(x0, b["x"])
        above = cols & (far_y <= cy) & (far_y > s["y0"])
        below = cols & ~above & (b["y"] >= cy) & (b["y"] < s["y1"])
        return edges(x0, F.when(above, far_y).otherwise(s["y0"]), x1, F.when(below, b["y"]).otherwise(s["y1"]))

    real = F.filter(others, lambda b: (b["w"] > 0) & (b["h"] > 0))
    first = edges(region["x"], region["y"], region["x"] + region["w"], region["y"] + region["h"])
    s = F.aggregate(real, first, pull)
    x0, y0 = F.least(s["x0"], own["x"]), F.least(s["y0"], own["y"])
    x1, y1 = F.greatest(s["x1"], own["x"] + own["w"]), F.greatest(s["y1"], own["y"] + own["h"])
    return box(x0, y0, F.greatest(x1 - x0, F.lit(1)), F.greatest(y1 - y0, F.lit(1)))

"""Rectangles and bands of a page against its lines, beside loops over all pairs."""

import random
import time

from pyspark.sql import functions as F

from citeloom.operators import figures, layout

LINES = "page int, line_number int, x0 double, y0 double, x1 double, y1 double"
RECTS = "page int, rect_id int, x0 double, y0 double, x1 double, y1 double"
BANDS = "page int, rect_id int, bx0 double, bx1 double, y0 double, y1 double, height double, below boolean"


def boxes(rng, n, size):
    """n boxes at halves, so that edges and centres often tie."""
    out = []
    for i in range(n):
        x, y = rng.randrange(0, 200) / 2, rng.randrange(0, 300) / 2
        out.append((i + 1, x, y, x + rng.randrange(0, size), y + rng.randrange(0, size)))
    return out


def test_line_ranges_equal_a_loop(spark):
    rng = random.Random(11)
    lines, rects, want = [], [], {}
    for page in range(40):
        own, drawn = boxes(rng, rng.choice([0, 1, 3, 25]), 12), boxes(rng, 6, rng.choice([1, 20, 200]))
        lines += [(page, *b) for b in own]
        rects += [(page, *b) for b in drawn]
        for r, x0, y0, x1, y1 in drawn:
            met = [n for n, a, b, c, d in own if a <= x1 + 2 and c >= x0 - 2 and b <= y1 + 2 and d >= y0 - 2]
            near = min(((abs((b + d) / 2 - (y0 + y1) / 2), n) for n, _, b, _, d in own), default=(0, 0))[1]
            want[page, r] = (min(met), max(met)) if met else (near, near)
    found = layout.line_ranges(spark.createDataFrame(rects, RECTS), spark.createDataFrame(lines, LINES), ["page"])
    assert {(r["page"], r["rect_id"]): (r["line_start"], r["line_end"]) for r in found.collect()} == want


def test_clamped_bands_equal_a_loop(spark):
    rng = random.Random(12)
    lines, bands, want = [], [], {}
    for page in range(40):
        own = boxes(rng, rng.choice([0, 1, 3, 25]), 12)
        lines += [(page, *b) for b in own]
        for i in range(8):
            a, y = rng.choice([0.0, 40.0, rng.randrange(0, 90) / 2]), rng.randrange(0, 300) / 2
            b, z, below = a + rng.choice([10.0, 40.0]), y + 10, i % 2 == 0
            bands.append((page, i, a, b, y, z, 200.0, below))
            share = [(q, s) for _, p, q, r, s in own if not (r < a - 5 or p > b + 5)]
            bottom = min((q for q, _ in share if q >= z + 1), default=200.0) - 3
            top = max((s + 3 for _, s in share if s <= y - 1), default=3.0)
            fits = bottom - z >= 35 if below else y - top >= 35
            want[page, i] = ((z + 1, bottom) if below else (top, y - 1)) if fits else (None, None)
    found = figures.clamped(spark.createDataFrame(bands, BANDS), spark.createDataFrame(lines, LINES), ["page"], ["rect_id"])
    assert {(r["page"], r["rect_id"]): (r["top"], r["bottom"]) for r in found.collect()} == want
    assert found.count() == len(bands)


def test_a_page_of_200_000_lines_and_2_000_boxes(spark):
    i = F.col("id")
    lines = spark.range(200_000).select(F.lit(1).alias("page"), (i + 1).cast("int").alias("line_number"), F.lit(50.0).alias("x0"), (i * 12.0).alias("y0"), F.lit(300.0).alias("x1"), (i * 12.0 + 10).alias("y1"))
    at = i * 1200.0
    rects = spark.range(2_000).select(F.lit(1).alias("page"), i.cast("int").alias("rect_id"), F.lit(60.0).alias("x0"), at.alias("y0"), F.lit(90.0).alias("x1"), (at + 600).alias("y1"))
    bands = spark.range(2_000).select(F.lit(1).alias("page"), i.cast("int").alias("rect_id"), F.lit(60.0).alias("bx0"), F.lit(90.0).alias("bx1"), (at + 11).alias("y0"), (at + 11.5).alias("y1"), F.lit(2.5e6).alias("height"), (i % 2 == 0).alias("below"))
    began = time.monotonic()
    ranges = layout.line_ranges(rects, lines, ["page"]).agg(F.count("*"), F.sum(F.col("line_end") - F.col("line_start") + 1)).first()
    first = time.monotonic()
    fitting = figures.clamped(bands, lines, ["page"], ["rect_id"]).agg(F.count("*"), F.count("top")).first()
    second = time.monotonic()
    assert tuple(ranges) == (2_000, 1_999 * 52 + 51) and tuple(fitting) == (2_000, 0)
    assert first - began < 10 and second - first < 10, (first - began, second - first)

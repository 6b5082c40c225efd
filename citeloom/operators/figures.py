"""Captions, the regions they describe, and embedded images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import collapse, first_line, strip_u

# Fixed value: how a caption begins, by kind word, number and an optional sign.
CAPTION = r"(?i)^\s*(figure|fig\.?|table|scheme|chart|plate|exhibit)\s*(\d{1,3}[a-z]?|[ivxlc]{1,6})\b\s*[.:)–—-]?"
PAD, X_SLACK, LEAST_GAP, WIDE = 3.0, 5.0, 35.0, 1.35
MIN_AREA, PER_PAGE = 10_000.0, 8
MIN_PIXELS, CAPTION_REACH = 40_000, 90.0


def captions(blocks: DataFrame, text: str = "block_text") -> DataFrame:
    """Those blocks that are captions, with kind (table or figure), label, number and caption."""
    head = first_line(strip_u(F.col(text)))
    word, number = F.regexp_extract(head, CAPTION, 1), F.regexp_extract(head, CAPTION, 2)
    bare = F.regexp_replace(word, r"\.$", "")
    rows = blocks.withColumn("_word", bare).withColumn("_number", number).where("_word <> ''")
    return rows.select(
        *blocks.columns, F.when(F.lower("_word") == "table", "table").otherwise("figure").alias("kind"),
        F.concat_ws(" ", F.initcap("_word"), "_number").alias("label"), F.substring(collapse(F.col(text)), 1, 800).alias("caption"),
    )


def caption_columns(caps: DataFrame, bounds: DataFrame, page: list[str]) -> DataFrame:
    """caps (page.., rect_id, x0, x1) with col_x0 and col_x1: the column whose centre is nearest, the first of equals;
    all columns together for a caption that is much wider than it."""
    b = bounds.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("col", F.col("x0").alias("a"), F.col("x1").alias("b")))).alias("cols"))
    rows = caps.join(b, page)
    centre = (F.col("x0") + F.col("x1")) / 2
    near = F.array_min(F.transform("cols", lambda c: F.struct(F.abs((c["a"] + c["b"]) / 2 - centre).alias("d"), c["col"].alias("col"), c["a"].alias("a"), c["b"].alias("b"))))
    rows = rows.withColumn("_c", near)
    wide = (F.size("cols") > 1) & (F.col("x1") - F.col("x0") > (F.col("_c.b") - F.col("_c.a")) * WIDE)
    low, high = F.array_min(F.transform("cols", lambda c: c["a"])), F.array_max(F.transform("cols", lambda c: c["b"]))
    return rows.withColumn("col_x0", F.when(wide, low).otherwise(F.col("_c.a"))).withColumn("col_x1", F.when(wide, high).otherwise(F.col("_c.b"))).drop("_c", "cols")


def clamped(bands: DataFrame, lines: DataFrame, page: list[str], key: list[str]) -> DataFrame:
    """bands (page.., key.., bx0, bx1, y0, y1, height, below) with top and bottom: from the caption up or down to the
    nearest line that shares the band's x-range, less a pad; both null where under 35 points are left.

    A page's bands of one x-range (its columns', mostly) are swept with the lines that share it, once downwards and once
    upwards, so a page's work grows with lines x its x-ranges, not with lines x bands.
    """
    edges = lines.select(*page, F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("y0").alias("_ly0"), F.col("y1").alias("_ly1"))
    rows = bands.select(*page, *[c for c in bands.columns if c not in page]).unionByName(edges.withColumn("_line", F.lit(True)), allowMissingColumns=True)
    is_line = F.col("_line").isNotNull()
    ranges = F.collect_set(F.when(~is_line, F.struct("bx0", "bx1"))).over(Window.partitionBy(*page))
    shares = lambda r: ~((F.col("_x1") < r["bx0"] - X_SLACK) | (F.col("_x0") > r["bx1"] + X_SLACK))
    rows = rows.withColumn("_ranges", ranges).withColumn("_range", F.explode(F.when(is_line, F.filter("_ranges", shares)).otherwise(F.array(F.struct("bx0", "bx1")))))
    down, up = F.when(is_line, F.col("_ly1")).otherwise(F.col("y0") - 1), F.when(is_line, F.col("_ly0")).otherwise(F.col("y1") + 1)
    swept = lambda order: Window.partitionBy(*page, "_range").orderBy(order, is_line.desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.drop("_ranges").withColumn("_u", F.min("_ly0").over(swept(up.desc()))).withColumn("_o", F.max("_ly1").over(swept(down.asc()))).where(~is_line)
    bottom = F.coalesce(F.col("_u"), F.col("height")) - PAD
    top = F.coalesce(F.col("_o") + PAD, F.lit(PAD))
    fits = F.when(F.col("below"), bottom - F.col("y1") >= LEAST_GAP).otherwise(F.col("y0") - top >= LEAST_GAP)
    return found.select(
        *bands.columns, F.when(fits, F.when(F.col("below"), F.col("y1") + 1).otherwise(top)).alias("top"),
        F.when(fits, F.when(F.col("below"), bottom).otherwise(F.col("y0") - 1)).alias("bottom"),
    )


def _meets(a: tuple, b: tuple) -> Column:
    ax0, ay0, ax1, ay1 = map(F.col, a)
    bx0, by0, bx1, by1 = map(F.col, b)
    return (ax0 < bx1) & (bx0 < ax1) & (ay0 < by1) & (by0 < ay1)


def regions(caps: DataFrame, lines: DataFrame, graphics: DataFrame, page: list[str]) -> DataFrame:
    """(page.., rect_id, x0, y0, x1, y1) of each caption's region, for those that have one.

    caps: page.., rect_id, kind, y0, y1, col_x0, col_x1, width, height. Tables look below first, others above. A band
    of the caption's column must meet a graphic; it is widened to the graphics and clamped anew, and the wide one is
    taken if it keeps half the height and 35 points.
    """
    key = [*page, "rect_id"]
    below = F.explode(F.array(F.lit(False), F.lit(True))).alias("below")
    bands = caps.select(*key, "kind", "y0", "y1", "width", "height", (F.col("col_x0") - PAD).alias("bx0"), (F.col("col_x1") + PAD).alias("bx1"), below)
    narrow = clamped(bands, lines, page, key).where("top is not null")
    g = graphics.select(*page, *[F.col(c).alias(f"g{c}") for c in ("x0", "y0", "x1", "y1")])
    hit = narrow.join(g, page).where(_meets(("bx0", "top", "bx1", "bottom"), ("gx0", "gy0", "gx1", "gy1")))
    inside = hit.groupBy(*narrow.columns).agg(F.min("gx0").alias("ux0"), F.max("gx1").alias("ux1"))
    wide = (F.col("ux0") < F.col("bx0") - 2) | (F.col("ux1") > F.col("bx1") + 2)
    x0 = F.greatest(F.lit(0.0), F.least("bx0", "ux0") - PAD)
    x1 = F.least(F.col("width"), F.greatest("bx1", "ux1") + PAD)
    asked = inside.where(wide).select(*key, "below", "y0", "y1", "height", x0.alias("bx0"), x1.alias("bx1"))
    again = clamped(asked, lines, page, key).select(*key, "below", F.col("bx0").alias("wx0"), F.col("bx1").alias("wx1"), F.col("top").alias("wtop"), F.col("bottom").alias("wbottom"))
    both = inside.join(again, [*key, "below"], "left")
    take = F.col("wtop").isNotNull() & (F.col("wbottom") - F.col("wtop") >= F.greatest(F.lit(LEAST_GAP), (F.col("bottom") - F.col("top")) * 0.5))
    pick = lambda w, n, c: F.when(take, F.col(w)).otherwise(F.col(n)).alias(c)
    first = F.row_number().over(Window.partitionBy(*key).orderBy((F.col("below") == (F.col("kind") == "table")).desc()))
    best = both.withColumn("_n", first).where("_n = 1")
    return best.select(*key, pick("wx0", "bx0", "x0"), pick("wtop", "top", "y0"), pick("wx1", "bx1", "x1"), pick("wbottom", "bottom", "y1"))


def accepted(found: DataFrame, page: list[str], min_area: float = MIN_AREA, per_page: int = PER_PAGE) -> DataFrame:
    """Those regions (page.., rect_id, x0..y1), in the order of rect_id, that are large enough and meet no earlier
    accepted one, per_page of them at most. Each choice depends on those before it, so a page's regions are folded."""
    rest = [c for c in found.columns if c not in (*page, "rect_id")]
    large = found.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= min_area)
    rows = large.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("rect_id", *rest))).alias("_r"))
    meets = lambda a, b: (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])
    none = F.slice("_r", 1, 0)
    take = lambda kept, r: F.when((F.size(kept) < per_page) & ~F.exists(kept, lambda k: meets(k, r)), F.concat(kept, F.array(r))).otherwise(kept)
    return rows.select(*page, F.inline(F.aggregate("_r", none, take))).select(found.columns)


def embedded_images(images: DataFrame, caps: DataFrame, taken: DataFrame, page: list[str], min_pixels: int = MIN_PIXELS, per_page: int = PER_PAGE, strict_captions: bool = True) -> DataFrame:
    """images (page.., image_id, document_name, page_number, pixels, x0..y1) to export, with caption and label.

    Left out are images that meet an accepted region (taken: page.., rect_id, label, x0..y1), small ones, those whose
    nearest caption (caps: page.., rect_id, caption, label, y0, y1; under 90 points away) was accepted, and uncaptioned
    ones of under four times the pixels. With strict_captions only pages that have a caption export images. Regions
    and images together are per_page at most.
    """
    t = taken.select(*page, *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    rows = images.where(F.col("pixels") >= min_pixels)
    covered = rows.join(t, page).where(_meets(("x0", "y0", "x1", "y1"), ("tx0", "ty0", "tx1", "ty1"))).select(*page, "image_id").distinct()
    rows = rows.join(covered, [*page, "image_id"], "left_anti")
    if strict_captions:
        rows = rows.join(caps.select(*page).distinct(), page, "left_semi")
    c = caps.select(*page, F.col("rect_id").alias("c_id"), "caption", "label", F.col("y0").alias("cy0"), F.col("y1").alias("cy1"))
    away = F.least(F.abs(F.col("cy0") - F.col("y1")), F.abs(F.col("y0") - F.col("cy1")))
    near = rows.join(c, page).withColumn("away", away).where(F.col("away") < CAPTION_REACH)
    near = near.groupBy(*page, "image_id").agg(F.min(F.struct("away", "c_id", "caption", "label")).alias("c")).select(*page, "image_id", "c.caption", "c.label")
    rows = rows.join(near, [*page, "image_id"], "left")
    used = taken.where("label <> ''").select(*page, F.lower("label").alias("_l")).distinct()
    rows = rows.withColumn("_l", F.lower(F.coalesce("label", F.lit("")))).join(used, [*page, "_l"], "left_anti").drop("_l")
    rows = rows.where((F.coalesce("caption", F.lit("")) != "") | (F.col("pixels") >= 4 * min_pixels))
    plain = F.format_string("Untitled image on page %d of %s", F.col("page_number"), F.col("document_name"))
    rows = rows.withColumn("caption", F.when(F.coalesce("caption", F.lit("")) != "", F.col("caption")).otherwise(plain)).withColumn("label", F.coalesce("label", F.lit("")))
    counts = taken.groupBy(*page).agg(F.count("*").alias("_taken"))
    nth = F.row_number().over(Window.partitionBy(*page).orderBy("image_id"))
    rows = rows.join(counts, page, "left").withColumn("_nth", nth).where(F.col("_nth") + F.coalesce("_taken", F.lit(0)) <= per_page)
    return rows.drop("_taken", "_nth")


def numbered(figures: DataFrame) -> DataFrame:
    """figures (doc_uid, page_number, ord) with figure_index, which runs through the document."""
    return figures.withColumn("figure_index", F.row_number().over(Window.partitionBy("doc_uid").orderBy("page_number", "ord")) - 1)


def figure_text(label: Column, caption: Column) -> Column:
    """What is embedded for a figure."""
    return F.trim(F.concat_ws(" ", F.nullif(label, F.lit("")), F.nullif(caption, F.lit(""))))

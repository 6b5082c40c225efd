"""Reading order of a page's lines, its columns, and line ranges for rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE, SHARE, QUANTUM, SLACK = 0.08, 0.15, 3.0, 2.0
LEAST_STRIP = 1e-3
BOX = ["x0", "y0", "x1", "y1"]


def with_columns(lines: DataFrame, page: list[str]) -> DataFrame:
    """lines (page.., width, x0, x1) with `col`: -1 across the middle, 0 left, 1 right; 0 on single-column pages."""
    mid, tol = F.col("width") / 2, F.col("width") * TOLERANCE
    side = F.when((F.col("x0") < mid - tol) & (F.col("x1") > mid + tol), -1).when((F.col("x0") + F.col("x1")) / 2 < mid, 0).otherwise(1)
    rows = lines.withColumn("_side", side)
    over = Window.partitionBy(*page)
    n = F.count("*").over(over)
    few = F.least(F.count_if(F.col("_side") == 0).over(over), F.count_if(F.col("_side") == 1).over(over)) < n * SHARE
    return rows.withColumn("_single", few).withColumn("col", F.when(F.col("_single"), 0).otherwise(F.col("_side"))).drop("_side")


def reading_order(lines: DataFrame, page: list[str], tie: str) -> DataFrame:
    """lines with `col`, `band` and `line_number`: full-width lines part the page into bands, and in a band the left
    column comes before the right one. `tie` orders lines of equal height and x0."""
    rows = with_columns(lines, page)
    down = Window.partitionBy(*page).orderBy(F.bround(F.col("y0") / QUANTUM), "x0", tie)
    rows = rows.withColumn("_rank", F.row_number().over(down))
    band = F.when(F.col("_single"), 0).otherwise(F.sum(F.when(F.col("col") == -1, 1).otherwise(0)).over(Window.partitionBy(*page).orderBy("_rank")))
    order = Window.partitionBy(*page).orderBy("band", "col", "_rank")
    return rows.withColumn("band", band).withColumn("line_number", F.row_number().over(order)).drop("_rank", "_single")


def column_bounds(lines: DataFrame, page: list[str]) -> DataFrame:
    """(page.., col, x0, x1) of each column; single-column pages span their width."""
    rows = with_columns(lines, page)
    two = rows.where("col >= 0 and not _single").groupBy(*page, "col").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    one = rows.where("_single").groupBy(*page).agg(F.max("width").alias("x1")).select(*page, F.lit(0).alias("col"), F.lit(0.0).alias("x0"), "x1")
    return two.unionByName(one)


def line_ranges(rects: DataFrame, lines: DataFrame, page: list[str]) -> DataFrame:
    """rects (page.., rect_id, x0..y1) with line_start and line_end: the lines that a rectangle meets with 2 points of
    slack; else the line whose centre is nearest in height, the first of equals; 0 and 0 on a page without lines.

    A page's rectangles and lines are swept together. The nearest lines are the last ones before a rectangle in the order
    of centres, read in both directions. For the lines that it meets, the page is cut into strips of about a line's height,
    no more than it has lines, and a line is compared with the rectangles of its strips. So one shuffle by page serves all,
    and a page's work grows with its pairs of equal height, not with all its pairs.
    """
    r = rects.select(*page, "rect_id", *BOX)
    rows = lines.select(*page, "line_number", *BOX).unionByName(r, allowMissingColumns=True)
    is_line, centre = F.col("line_number").isNotNull(), (F.col("y0") + F.col("y1")) / 2
    own = lambda c: F.when(is_line, c)
    whole = Window.partitionBy(*page)
    low, high, n = F.min(own(F.least("y0", "y1"))).over(whole), F.max(own(F.greatest("y0", "y1"))).over(whole), F.count("line_number").over(whole)
    strip = F.greatest((F.col("_high") - F.col("_low")) / F.col("_n"), F.avg(own(F.abs(F.col("y1") - F.col("y0")))).over(whole), F.lit(LEAST_STRIP))
    rows = rows.withColumn("_mid", centre).withColumn("_low", low).withColumn("_high", high).withColumn("_n", n).withColumn("_strip", strip)
    last = F.last(own(F.struct("_mid", "line_number")), ignorenulls=True)
    before = lambda order: last.over(Window.partitionBy(*page).orderBy(order, is_line.desc(), F.col("line_number").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_above", before(F.col("_mid").asc())).withColumn("_below", before(F.col("_mid").desc()))
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["_mid"] - F.col("_mid")).alias("gap"), F.col(c)["line_number"].alias("line_number")))
    slack = F.when(is_line, 0.0).otherwise(SLACK)
    ends = F.col("y0") - slack, F.col("y1") + slack
    number = lambda y: F.floor((y - F.col("_low")) / F.col("_strip"))
    a, z = number(F.greatest(F.least(*ends), "_low")), number(F.least(F.greatest(*ends), "_high"))
    rows = rows.select(
        *page, "rect_id", "line_number", *BOX, F.least(away("_above"), away("_below"))["line_number"].alias("_near"), F.explode_outer(F.when(a <= z, F.sequence(a, z))).alias("_at"),
    )
    beside = F.collect_list(F.when(~is_line, F.struct("rect_id", *BOX))).over(Window.partitionBy(*page, "_at"))
    meets = lambda b: (F.col("x0") <= b["x1"] + SLACK) & (F.col("x1") >= b["x0"] - SLACK) & (F.col("y0") <= b["y1"] + SLACK) & (F.col("y1") >= b["y0"] - SLACK)
    met = F.transform(F.filter(F.col("_beside"), meets), lambda b: b["rect_id"])
    found = rows.withColumn("_beside", beside).select(*page, "line_number", "_near", F.explode(F.when(is_line, met).otherwise(F.array("rect_id"))).alias("rect_id"))
    found = found.groupBy(*page, "rect_id").agg(F.min("line_number").alias("lo"), F.max("line_number").alias("hi"), F.max(F.when(~is_line, F.col("_near"))).alias("near"))
    pick = lambda c: F.coalesce(c, "near", F.lit(0))
    return found.select(*page, "rect_id", pick("lo").alias("line_start"), pick("hi").alias("line_end"))

"""Extracted tables as Markdown and as chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import collapse, once

MAX_ROWS, MAX_CHARS = 80, 6000


def markdown(rows: Column, max_rows: int = MAX_ROWS) -> Column:
    """An array of rows of cells as a Markdown table: white space collapsed, empty rows and columns dropped, ragged rows
    filled, blank headers named by their place; empty if under two rows or two columns are left."""
    clean = F.transform(F.slice(rows, 1, max_rows), lambda r: F.transform(r, lambda c: collapse(F.coalesce(c, F.lit("")))))
    clean = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    places = lambda kept, width: F.filter(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: F.exists(kept, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
    cut = lambda kept, at: F.transform(kept, lambda r: F.transform(at, lambda i: F.coalesce(F.get(r, i), F.lit(""))))
    drawn = lambda kept: once(places(kept, F.array_max(F.transform(kept, F.size))), lambda at: F.when((F.size(kept) < 2) | (F.size(at) < 2), "").otherwise(once(cut(kept, at), _drawn)))
    return once(clean, drawn)


def _drawn(rows: Column) -> Column:
    """Rows of equally many cells, the header first, as lines of Markdown."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    head = F.transform(F.get(rows, F.lit(0)), lambda c, i: F.when(c == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(c))
    rule = F.transform(F.get(rows, F.lit(0)), lambda c: F.lit("---"))
    return F.array_join(F.concat(F.array(line(head), line(rule)), F.transform(F.slice(rows, 2, F.size(rows)), line)), "\n")


def table_chunks(tables: DataFrame, ranges: DataFrame, pages: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """tables (doc_uid, page_number, ord, rows) as chunks: the nth table has the nth detected range (doc_uid,
    page_number, ord, line_start, line_end), else its page's lines (doc_uid, page_number, n_lines), else 0 and 0."""
    made = tables.withColumn("md", markdown(F.col("rows"), max_rows)).where("md <> ''")
    made = made.join(ranges, ["doc_uid", "page_number", "ord"], "left").join(pages, ["doc_uid", "page_number"], "left")
    head = F.format_string("Table extracted from page %d:\n\n", F.col("page_number"))
    whole = F.when(F.col("n_lines") > 0, 1)
    return made.select(
        "doc_uid", "page_number", "ord", F.coalesce("line_start", whole, F.lit(0)).alias("line_start"), F.coalesce("line_end", F.when(whole == 1, F.col("n_lines")), F.lit(0)).alias("line_end"),
        F.concat(head, F.substring("md", 1, max_chars)).alias("text"),
    )

"""Page spans: the contract of a text extractor and the text lines that its spans make.

An extractor turns the bytes of a file into span rows (SPAN_SCHEMA); it is given as a function (path, content) ->
iterable of dicts. Their kinds: text; drawing and image, a graphic's box, an image with its pixels, data and suffix (in
text) where it can be exported; table, the box of the block-th table that was detected on a page; cell, the text at row
`line` and column `span` of the block-th extracted table; file, a file's digest. Cells can be left to a second extractor,
(path, content, pages) -> iterable of dicts, which is asked for the pages on which a table was detected. A row with
`error` and a page is a page that can't be read, one without a page a file. No PDF library is needed here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import strip_u
from citeloom.functions.workers import with_python_path
from citeloom.sources.opened import dealt, open_path

SPAN_SCHEMA = (
    "rel_path string, page_number int, block int, line int, span int, kind string, text string, dir_y double, "
    "x0 double, y0 double, x1 double, y1 double, width double, height double, error string, pixels long, data binary"
)
BATCH = 2000  # span rows that are sent at once


def extract(files: DataFrame, extractor: Callable[[str, bytes], Iterable[dict]], open_file: Callable[[str], BinaryIO] = open_path) -> DataFrame:
    """Span rows of files (rel_path, path, length): tasks open the files that they are dealt, the largest first, one at a time.
    Each file has a row of kind file, its digest in text; one that fails has a row with its error too."""

    def run(batches):
        for b in batches:
            for name, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    with open_file(path) as file:
                        content = file.read()
                    rows = [{"rel_path": name, "kind": "file", "text": hashlib.sha256(content).hexdigest()}]
                    yield from _batches([*rows, *({"rel_path": name} | row for row in extractor(name, content))])
                except Exception as problem:  # one bad file must not end the batch
                    yield from _batches([*rows, {"rel_path": name, "error": f"{type(problem).__name__}: {problem}"[:2000]}])

    with_python_path(files.sparkSession)
    return dealt(files.select("rel_path", "path", "length")).mapInArrow(run, SPAN_SCHEMA)


def extract_tables(found: DataFrame, files: DataFrame, extractor: Callable[[str, bytes, list[int]], Iterable[dict]], open_file: Callable[[str], BinaryIO] = open_path) -> DataFrame:
    """Cell rows of the pages of found (span rows) on which a table was detected: the dear second extractor gets a file's
    content with the numbers of its flagged pages, and no other file is opened. What it gives of other pages is left out;
    where it fails, the file's tables are left out, with a row of their error for the first flagged page."""
    flagged = found.where("kind = 'table'").groupBy("rel_path").agg(F.sort_array(F.collect_set("page_number")).alias("pages"))
    wanted = files.select("rel_path", "path", "length").join(flagged, "rel_path")

    def run(batches):
        for b in batches:
            for name, path, pages in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                try:
                    with open_file(path) as file:
                        content = file.read()
                    rows = [{"rel_path": name, "kind": "cell"} | row for row in extractor(name, content, pages) if row["page_number"] in pages]
                except Exception as problem:
                    rows = [{"rel_path": name, "page_number": pages[0], "error": f"{type(problem).__name__}: {problem}"[:2000]}]
                yield from _batches(rows)

    with_python_path(found.sparkSession)
    return dealt(wanted.select("rel_path", "path", "length", "pages")).mapInArrow(run, SPAN_SCHEMA)


def _batches(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in SPAN_SCHEMA.split(", "))])
    for i in range(0, len(rows), BATCH):
        yield pa.RecordBatch.from_pylist(rows[i : i + BATCH], schema)


def text_lines(spans: DataFrame) -> DataFrame:
    """(rel_path, page_number, block, line, text, x0..y1) of horizontal text: spans of a line joined in order, blank
    lines and lines whose direction leaves the horizontal by over 0.1 dropped."""
    rows = spans.where("kind = 'text' and abs(dir_y) <= 0.1 and x0 is not null")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), "")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    lines = rows.groupBy("rel_path", "page_number", "block", "line").agg(strip_u(joined).alias("text"), *box)
    return lines.where("text <> ''")


def graphics(spans: DataFrame) -> DataFrame:
    """(rel_path, page_number, x0..y1) of vector and raster graphics."""
    box = ["rel_path", "page_number", "x0", "y0", "x1", "y1"]
    return spans.where("kind = 'drawing'").select(box).unionByName(spans.where("kind = 'image'").select(box)).where("x1 > x0 and y1 > y0")


def cell_tables(spans: DataFrame) -> DataFrame:
    """(rel_path, page_number, ord, rows): the extracted tables of the pages on which one was detected, as rows of cells."""
    page = ["rel_path", "page_number"]
    cells = only_pages(spans.where("kind = 'cell'"), spans.where("kind = 'table'"))
    rows = cells.groupBy(*page, "block", "line").agg(F.sort_array(F.collect_list(F.struct("span", "text"))).alias("cells"))
    rows = rows.select(*page, "block", "line", F.transform("cells", lambda c: c["text"]).alias("cells"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("line", "cells"))), lambda r: r["cells"])
    return rows.groupBy(*page, F.col("block").alias("ord")).agg(whole.alias("rows"))


def only_pages(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """rows of the pages that the cheap test flagged, ahead of an expensive extractor."""
    return rows.join(flagged.select("rel_path", "page_number").distinct(), ["rel_path", "page_number"], "left_semi")


def plain_text(path: str, content: bytes) -> Iterable[dict]:
    """An extractor of text files: form feeds part pages, and each line is a span of a single column."""
    if b"\0" in content:
        raise ValueError("not a text file")
    for page, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        for no, line in enumerate(text.split("\n")):
            y = 60.0 + 12 * no
            yield {"page_number": page, "block": no, "line": 0, "span": 0, "kind": "text", "text": line, "dir_y": 0.0, "x0": 50.0, "y0": y, "x1": 560.0, "y1": y + 10, "width": 612.0, "height": max(792.0, y + 60)}

"""Overlapping chunks of a page's lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.workers import with_python_path

TARGET, OVERLAP, LEAST = 1100, 180, 120
_OUT = [("line_start", pa.int32()), ("line_end", pa.int32()), ("chunk_text", pa.string()), ("ord", pa.int32())]


def windows(lines: list[str], target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first, last, text) of the greedy windows over lines, numbered from 1. A window ends with the line that brings it
    to target; the next one starts far enough back to repeat overlap characters, and always further on than this one."""
    ahead = [0]
    for line in lines:
        ahead.append(ahead[-1] + len(line) + 1)
    out, start, n = [], 0, len(lines)
    while start < n:
        end = start + 1
        while end < n and ahead[end] - ahead[start] < target:
            end += 1
        if text := "\n".join(lines[start:end]).strip():
            out.append((start + 1, end, text))
        if end == n:
            break
        back = end
        while back > start + 1 and ahead[end] - ahead[back] < overlap:
            back -= 1
        start = max(start + 1, back)
    return out


def folded(parts: list[tuple[int, int, str]], least: int = LEAST) -> list[tuple[int, int, str]]:
    """parts with a last one of under `least` characters joined to its predecessor, overlap included twice."""
    if len(parts) > 1 and len(parts[-1][2]) < least:
        (first, _, text), (_, last, tail) = parts[-2:]
        return [*parts[:-2], (first, last, f"{text}\n{tail}")]
    return parts


def chunk_pages(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST, fold: bool = True) -> DataFrame:
    """pages (.., lines array<string>) as chunks: the other columns with line_start, line_end, chunk_text and ord.

    A page is one row, so chunks never cross pages and nothing is shuffled; lines are numbered by their place.
    """
    keep = [c for c in pages.columns if c != "lines"]

    def run(batches):
        for b in batches:
            rows, out = [], []
            for i, lines in enumerate(b.column(len(keep)).to_pylist()):
                parts = windows([x or "" for x in lines or []], target, overlap)
                for no, part in enumerate(folded(parts, least) if fold else parts):
                    rows.append(i)
                    out.append((*part, no))
            kept = b.select(keep).take(pa.array(rows, pa.int64()))
            made = [pa.array([o[k] for o in out], kind) for k, (_, kind) in enumerate(_OUT)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], [*keep, *(n for n, _ in _OUT)])

    schema = T.StructType([*pages.select(keep).schema, *(T.StructField(n, T.StringType() if n == "chunk_text" else T.IntegerType()) for n, _ in _OUT)])
    with_python_path(pages.sparkSession)
    return pages.select(*keep, "lines").mapInArrow(run, schema)


def indexed(chunks: DataFrame) -> DataFrame:
    """chunks (doc_uid, page_number, is_table, ord) with chunk_index: text chunks of a page first, then its tables."""
    order = Window.partitionBy("doc_uid", "page_number").orderBy("is_table", "ord")
    return chunks.withColumn("chunk_index", F.row_number().over(order) - 1)


def without_text(docs: DataFrame, chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """docs that have neither a chunk nor a figure."""
    found = chunks.select("doc_uid").unionByName(figures.select("doc_uid")).distinct()
    return docs.join(found, "doc_uid", "left_anti")

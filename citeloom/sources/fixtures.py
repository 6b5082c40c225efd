"""Inputs that the registered queries derive from the driver's tables. Each is one SQL text for both engines, over whole
tables; {documents} and the like stand for a table's name or DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIXTURES = {
    # a file listing, with hidden files, lock files and suffixes in capitals among it
    "paths": """SELECT doc_id, concat(CASE doc_id % 5 WHEN 0 THEN 'a/b/' WHEN 1 THEN 'a-b/' WHEN 2 THEN 'a/' ELSE '' END,
        CASE doc_id % 7 WHEN 3 THEN '.doc_' WHEN 4 THEN '~$doc_' ELSE 'doc_' END, cast(doc_id AS VARCHAR(20)),
        CASE doc_id % 11 WHEN 5 THEN '.PDF' WHEN 6 THEN '.pdf.tmp' ELSE '.pdf' END) AS path FROM {documents}""",
    "listing": """SELECT substring(sha1(concat('src/doc_', cast(doc_id AS VARCHAR(20)), '.pdf')), 1, 16) AS doc_uid, concat('doc_', cast(doc_id AS VARCHAR(20)), '.pdf') AS document_name,
        concat('/corpus/src/doc_', cast(doc_id AS VARCHAR(20)), '.pdf') AS source_path, concat('src/doc_', cast(doc_id AS VARCHAR(20)), '.pdf') AS rel_path,
        {sha}(CASE WHEN doc_id % 7 = 0 THEN concat(text, '+') ELSE text END{bits}) AS sha256, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size_bytes,
        cast(1700000000 + doc_id AS DOUBLE) AS mtime FROM {documents} WHERE doc_id % 11 <> 10""",
    "manifest": """SELECT substring(sha1(concat('src/doc_', cast(doc_id AS VARCHAR(20)), '.pdf')), 1, 16) AS doc_uid, concat(CASE WHEN doc_id % 2 = 0 THEN 'Doc_' ELSE 'doc_' END, cast(doc_id AS VARCHAR(20)), '.pdf') AS document_name,
        concat('/corpus/src/doc_', cast(doc_id AS VARCHAR(20)), '.pdf') AS source_path, concat('src/doc_', cast(doc_id AS VARCHAR(20)), '.pdf') AS rel_path,
        CASE WHEN doc_id % 19 = 0 THEN '' ELSE {sha}(text{bits}) END AS sha256, n_chars AS size_bytes, cast(1700000000 + doc_id AS DOUBLE) AS mtime,
        CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN doc_id % 10 = 1 THEN 'indexing' ELSE 'indexed' END AS status,
        cast(1 + doc_id % 9 AS INT) AS page_count, cast(doc_id % 50 AS INT) AS chunk_count, cast(doc_id % 4 AS INT) AS figure_count, cast(doc_id % 3 AS INT) AS table_count,
        CASE WHEN doc_id % 17 = 0 THEN '1.0.0' ELSE '1.1.0' END AS parser_version, CASE WHEN doc_id % 10 = 0 THEN 'no text' ELSE '' END AS error,
        '2024-01-01T00:00:00+00:00' AS indexed_at, '2024-01-01T00:00:00+00:00' AS updated_at FROM {documents} WHERE doc_id % 13 <> 12""",
    # hits of questions: twenty documents a question
    "hits": """SELECT cast(floor(doc_id / 20) AS BIGINT) AS query_id, doc_id % 20 AS hit_ord, doc_id % 20 + 1 AS hit_rank, concat('doc_', cast(doc_id % 13 AS VARCHAR(20)), CASE WHEN doc_id % 17 = 0 THEN '' ELSE '.pdf' END) AS document_name,
        1 + doc_id % 4 AS page_number, 1 + (doc_id * 7) % 40 AS line_start, 1 + (doc_id * 7) % 40 + doc_id % 9 AS line_end, CASE WHEN doc_id % 5 = 0 THEN 'table' ELSE 'text' END AS content_type,
        text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('Caption of ', source) END AS caption, concat('/img/', cast(doc_id AS VARCHAR(20)), '.png') AS image_path FROM {documents}""",
    "answers": """SELECT conv_id * 100 + turn AS answer_id, cast(floor(conv_id / 4) AS BIGINT) AS query_id,
        concat(text, ' [doc_', cast(conv_id % 15 AS VARCHAR(20)), '.pdf, Page ', cast(1 + turn % 5 AS VARCHAR(20)), ', Line ', cast(1 + (conv_id * 3) % 45 AS VARCHAR(20)), '-', cast(1 + (conv_id * 3) % 45 + turn AS VARCHAR(20)),
        '] and [DOC_', cast(conv_id % 15 AS VARCHAR(20)), '.pdf,pages ', cast(1 + turn % 5 AS VARCHAR(20)), ' , Lines ', cast(1 + (conv_id * 3) % 45 AS VARCHAR(20)), '] again [doc_', cast(conv_id % 15 AS VARCHAR(20)), '.pdf, Page ', cast(1 + turn % 5 AS VARCHAR(20)),
        ', Line ', cast(1 + (conv_id * 3) % 45 + turn AS VARCHAR(20)), '–', cast(1 + (conv_id * 3) % 45 AS VARCHAR(20)), '] not [doc_1.PDF, Page 1, Line 2]') AS text FROM {conversations} WHERE role = 'assistant'""",
    "captions": """SELECT item_id, concat(CASE item_id % 6 WHEN 0 THEN 'Figure ' WHEN 1 THEN 'Fig. ' WHEN 2 THEN 'TABLE ' WHEN 3 THEN 'Figures ' WHEN 4 THEN 'scheme' ELSE 'See ' END,
        CASE WHEN item_id % 4 = 3 THEN 'iv' ELSE concat(cast(1 + item_id % 9 AS VARCHAR(20)), CASE WHEN item_id % 5 = 0 THEN 'a' ELSE '' END) END, '. ', text) AS block_text FROM {benchmark}""",
    # rectangles on the documents' pages: captions and graphics
    "pages": "SELECT doc_id, 1 AS page_number, doc_id % 3 AS kind_no, doc_id % 5 AS at FROM {documents}",
    "events": """SELECT event_id, concat('p', cast(user_id AS VARCHAR(20)), CASE WHEN event_id % 29 = 0 THEN '.PDF' WHEN event_id % 31 = 0 THEN '.txt' ELSE '.pdf' END) AS path, concat('q', cast(user_id AS VARCHAR(20)), '.pdf') AS dest,
        CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'moved' ELSE 'modified' END AS op, {us} AS us, cast(floor(value) AS INT) AS size, event_id % 37 = 0 AS is_dir FROM {events}""",
    "thoughts": """SELECT conv_id, turn, concat(CASE WHEN turn % 3 = 0 THEN '<think>plan</think>' ELSE '' END, text, CASE conv_id % 4 WHEN 0 THEN '<think>' WHEN 1 THEN '</think> tail' WHEN 2 THEN ' <think>a
b</think> mid <think>c</think> end' ELSE '' END) AS answer FROM {conversations}""",
}
_SPARK = {"sha": "sha2", "bits": ", 256", "us": "cast(floor((unix_micros(cast(ts AS timestamp)) - 1704067200000000) / 10000) AS BIGINT)"}
_DUCK = {"sha": "sha256", "bits": "", "us": "cast(floor((epoch_us(ts) - 1704067200000000) / 10000) AS BIGINT)"}
TABLES = ("documents", "conversations", "benchmark", "events", "embeddings")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    for k, v in _SPARK.items():
        text = text.replace("{" + k + "}", v)
    text = re.sub(r"[ \t]*\n[ \t]+", " ", text)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("VARCHAR(20)", "STRING"), **used)


def duck(name: str) -> str:
    """The fixture for DuckDB, in parentheses."""
    text = FIXTURES[name]
    for k, v in _DUCK.items():
        text = text.replace("{" + k + "}", v)
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return f"({re.sub(r'[ \t]*\n[ \t]+', ' ', text)})"


def lines(spark: SparkSession, sf_dir: str, per_page: int = 20) -> DataFrame:
    """(doc_id, pos, page_number, line_number, text): the lines of all documents, per_page to a page."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    page = F.floor(F.col("pos") / per_page)
    return rows.select("doc_id", "pos", (page + 1).cast("int").alias("page_number"), (F.col("pos") % per_page + 1).alias("line_number"), "text")


DUCK_LINES = """(SELECT doc_id, pos, cast(1 + floor(pos / 20) AS INT) AS page_number, pos % 20 + 1 AS line_number, text FROM (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines() as page boxes: two columns, full-width lines among them and some rotated ones."""
    at = F.col("line_number") - 1
    wide, left = F.col("pos") % 7 == 0, F.col("pos") % 2 == 0
    x0 = F.when(wide | left, 50.0).otherwise(320.0)
    x1 = F.when(wide, 560.0).when(left, 290.0).otherwise(560.0)
    y0 = 60 + 7.5 * F.floor(at / 2)
    return lines(spark, sf_dir).select("*", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), (y0 + 7).alias("y1"), F.when(F.col("pos") % 11 == 10, 1.0).otherwise(0.0).alias("dir_y"))


DUCK_BOXES = f"""(SELECT *, y0 + 7 AS y1 FROM (SELECT *, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, CASE WHEN pos % 7 = 0 OR pos % 2 = 0 THEN 50.0::DOUBLE ELSE 320.0::DOUBLE END AS x0,
  CASE WHEN pos % 7 = 0 THEN 560.0::DOUBLE WHEN pos % 2 = 0 THEN 290.0::DOUBLE ELSE 560.0::DOUBLE END AS x1, (60 + 7.5::DOUBLE * floor((line_number - 1) / 2))::DOUBLE AS y0,
  CASE WHEN pos % 11 = 10 THEN 1.0 ELSE 0.0 END AS dir_y FROM {DUCK_LINES}))"""

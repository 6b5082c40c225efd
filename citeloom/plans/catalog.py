"""The registered queries: each operator over the driver's tables, with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.functions.workers import shared_path
from citeloom.operators import answer, chunking, citations, context, embed, figures, layout, retrieval, tables
from citeloom.plans import manifest, store
from citeloom.sources import fixtures as fx
from citeloom.sources import listing, spans
from citeloom.streaming import feed, watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-06-01T00:00:00+00:00"
PAGE = ["doc_id", "page_number"]


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores where its scan is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Listings -----------------------------------------------------------------------------------------------------------


@query(f"""SELECT path, ends_with(path, '.pdf') AND NOT regexp_matches(regexp_extract(path, '[^/]*$'), '^([.]|~[$])') AS scanned,
  ends_with(lower(path), '.pdf') AND NOT regexp_matches(regexp_extract(path, '[^/]*$'), '^([.]|~[$])') AS watched FROM {fx.duck("paths")}""")
def src01_discover(spark, sf_dir):
    p = F.col("path")
    return fx.fixture(spark, sf_dir, "paths").select("path", listing.is_scanned(p).alias("scanned"), listing.is_watched(p).alias("watched"))


@query(f"""SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM {fx.duck("paths")}
  WHERE ends_with(path, '.pdf') AND NOT regexp_matches(regexp_extract(path, '[^/]*$'), '^([.]|~[$])') GROUP BY 1""")
def src03_counts(spark, sf_dir):
    return listing.counts_by_folder(fx.fixture(spark, sf_dir, "paths"))


@query("""SELECT concat('src/doc_', doc_id, '.pdf') AS rel_path, substring(sha1(concat('src/doc_', doc_id, '.pdf')), 1, 16) AS doc_uid, octet_length(encode(text))::BIGINT AS size_bytes, sha256(text) AS sha256 FROM documents""")
def src04_records(spark, sf_dir):
    rel = F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    rows = read(spark, sf_dir, "documents").select(*listing.record(rel, F.col("text").cast("binary")), F.octet_length("text").cast("long").alias("size_bytes"))
    return rows.select("rel_path", "doc_uid", "size_bytes", "sha256")


@query(f"""SELECT doc_id, page_number, line_number, trim(text, E' \\t\\n\\r') AS text, x0, y0, x1, y1 FROM {fx.DUCK_BOXES} WHERE dir_y <= 0.1 AND trim(text, E' \\t\\n\\r') <> ''""")
def src08_text_lines(spark, sf_dir):
    b = fx.boxes(spark, sf_dir)
    halves = [(1, F.substring("text", 1, 5)), (2, F.substring("text", 6, 2**30))]
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("span"), t.alias("text")) for n, t in halves])).alias("s")
    s = b.select(F.col("doc_id").alias("rel_path"), "page_number", F.col("line_number").alias("block"), F.lit(0).alias("line"), F.lit("text").alias("kind"), "dir_y", "x0", "y0", "x1", "y1", made)
    s = s.select("*", "s.span", "s.text").drop("s")
    return spans.text_lines(s).select(F.col("rel_path").alias("doc_id"), "page_number", F.col("block").alias("line_number"), "text", "x0", "y0", "x1", "y1")


@query(f"""SELECT page_number, count(*) AS n, min(x0) AS x0, max(y1) AS y1 FROM {fx.DUCK_BOXES} WHERE pos % 3 <> 2 GROUP BY page_number""")
def src09_graphics(spark, sf_dir):
    kind = F.when(F.col("pos") % 3 == 0, "drawing").when(F.col("pos") % 3 == 1, "image").otherwise("text")
    rows = spans.graphics(fx.boxes(spark, sf_dir).withColumnRenamed("doc_id", "rel_path").withColumn("kind", kind))
    return rows.groupBy("page_number").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("y1").alias("y1"))


@query(f"""SELECT page_number, count(*) AS n FROM {fx.DUCK_LINES} l SEMI JOIN (SELECT DISTINCT doc_id, page_number FROM {fx.DUCK_LINES} WHERE contains(text, 'License')) f USING (doc_id, page_number) GROUP BY page_number""")
def src10_flagged_pages(spark, sf_dir):
    rows = fx.lines(spark, sf_dir).withColumnRenamed("doc_id", "rel_path")
    return spans.only_pages(rows, rows.where(F.contains("text", F.lit("License")))).groupBy("page_number").agg(F.count("*").alias("n"))


# The store ------------------------------------------------------------------------------------------------------------

_OLD = "(SELECT doc_id, source, n_chars, concat('doc_', cast(doc_id AS VARCHAR), '.pdf') AS document_name FROM documents WHERE source IS NOT NULL)"


def _stored(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("document_name"), "doc_id", "source", "n_chars", F.col("doc_id").alias("row_id"))


def _chunk_rows(docs, texts):
    """A chunk for each of an array of texts of documents."""
    one = docs.select("doc_id", F.posexplode(texts).alias("at", "text")).withColumn("doc_uid", F.col("doc_id").cast("string"))
    known = {"row_id": tx.row_id(F.col("doc_uid"), F.lit(1), "c", F.col("at")), "doc_uid": F.col("doc_uid"), "chunk_index": F.col("at"), "text": F.col("text"), "page_number": F.lit(1)}
    fields = [f.split(" ") for f in store.COLLECTIONS["chunks"].split(", ")]
    return one.select(*[known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


@query("""WITH old AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  new AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN [concat('new ', lines[1])] ELSE lines END AS lines FROM old)
  SELECT doc_id::VARCHAR AS doc_uid, (n - 1)::INT AS chunk_index, lines[n] AS text FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS n FROM new)""")
def snk01_replace(spark, sf_dir):
    """A store of a chunk per line, where those documents that have labels are replaced by one chunk each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    kept = store.Store(spark, shared_path(spark, "store"))
    kept.write(chunks=_chunk_rows(docs, F.col("lines")))
    changed = docs.join(read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    kept.replace_documents(_chunk_rows(changed, F.array(F.concat(F.lit("new "), F.get("lines", F.lit(0))))), kept.read("figures"))
    return kept.read("chunks").select("doc_uid", "chunk_index", "text")


@query(f"SELECT source, count(*) AS n FROM {_OLD} WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def snk04_delete(spark, sf_dir):
    gone = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc_uid"))
    return store.without(_stored(spark, sf_dir).withColumnRenamed("doc_id", "doc_uid"), gone).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT 'chunks' AS collection, count(*) AS n FROM documents UNION ALL SELECT 'figures', count(*) FROM benchmark")
def snk06_counts(spark, sf_dir):
    return store.counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query(f"SELECT DISTINCT document_name FROM {fx.duck('hits')} WHERE document_name <> ''")
def snk07_documents(spark, sf_dir):
    return store.document_names(fx.fixture(spark, sf_dir, "hits"))


@query(f"SELECT image_path FROM {fx.duck('hits')} WHERE document_name = 'doc_3.pdf' AND image_path <> ''")
def snk08_image_paths(spark, sf_dir):
    rows = fx.fixture(spark, sf_dir, "hits").withColumnRenamed("document_name", "doc_uid")
    return store.image_paths(rows, "doc_3.pdf")


@query(f"""SELECT image_path FROM (SELECT image_path FROM {fx.duck("hits")} EXCEPT SELECT image_path FROM {fx.duck("hits")} WHERE content_type = 'table') WHERE starts_with(image_path, '/img/')""")
def snk09_orphans(spark, sf_dir):
    before = fx.fixture(spark, sf_dir, "hits")
    return store.orphans(before, before.where("content_type = 'table'"), "/img")


@query(f"""WITH gone AS (SELECT DISTINCT document_name FROM {fx.duck("hits")} WHERE content_type = 'table' AND document_name LIKE 'doc_1%')
  SELECT 'figures' AS collection, count(*) AS n FROM {fx.duck("hits")} WHERE document_name NOT IN (FROM gone) UNION ALL SELECT 'manifest', count(*) FROM {fx.duck("manifest")} WHERE lower(document_name) NOT IN (FROM gone)
  UNION ALL SELECT 'images', count(*) FROM (SELECT image_path FROM {fx.duck("hits")} EXCEPT SELECT image_path FROM {fx.duck("hits")} WHERE document_name NOT IN (FROM gone)) WHERE starts_with(image_path, '/img/')""")
def snk10_remove_everywhere(spark, sf_dir):
    """The rows that are left of figures and manifest, and the images that go, when some documents are removed."""
    hits = fx.fixture(spark, sf_dir, "hits").withColumnRenamed("document_name", "doc_uid")
    gone = hits.where("content_type = 'table' and doc_uid like 'doc_1%'").select("doc_uid").distinct()
    left = store.without(hits, gone)
    rows = fx.fixture(spark, sf_dir, "manifest").withColumn("doc_uid", F.lower("document_name"))
    n = lambda d, c: d.agg(F.count("*").alias("n")).select(F.lit(c).alias("collection"), "n")
    return n(left, "figures").unionByName(n(manifest.delete(rows, gone), "manifest")).unionByName(n(store.orphans(hits, left, "/img"), "images"))


@query(f"""SELECT path, concat(substring(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1'), '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 60), '_', substring(sha1(path), 1, 8), '_p', lpad((1 + doc_id % 7)::VARCHAR, 4, '0'), '_img', lpad((doc_id % 90)::VARCHAR, 3, '0'), '.png') AS name FROM {fx.duck("paths")}""")
def snk11_embedded_names(spark, sf_dir):
    p, i = F.col("path"), F.col("doc_id")
    name = tx.image_name(listing.base_name(p), tx.doc_uid(p), (1 + i % 7).cast("int"), (i % 90).cast("int"), F.lit("PNG"))
    return fx.fixture(spark, sf_dir, "paths").select("path", name.alias("name"))


@query(f"""SELECT path, substring(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1'), '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 60) AS stem FROM {fx.duck("paths")}""")
def snk11_image_names(spark, sf_dir):
    return fx.fixture(spark, sf_dir, "paths").select("path", tx.image_stem(listing.base_name(F.col("path"))).alias("stem"))


# Layout -----------------------------------------------------------------------------------------------------------

_SIDES = f"""sides AS (SELECT *, CASE WHEN x0 < width / 2 - width * 0.08 AND x1 > width / 2 + width * 0.08 THEN -1 WHEN (x0 + x1) / 2 < width / 2 THEN 0 ELSE 1 END AS side FROM {fx.DUCK_BOXES} WHERE dir_y <= 0.1),
cols AS (SELECT *, least(count(*) FILTER (side = 0) OVER p, count(*) FILTER (side = 1) OVER p) < 0.15 * count(*) OVER p AS single FROM sides WINDOW p AS (PARTITION BY doc_id, page_number)),
sided AS (SELECT *, CASE WHEN single THEN 0 ELSE side END AS col FROM cols),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY round_even(y0 / 3.0, 0), x0, pos) AS rk FROM sided),
banded AS (SELECT *, CASE WHEN single THEN 0 ELSE sum(CASE WHEN col = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY rk) END AS band FROM ranked),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY band, col, rk) AS ln FROM banded)"""


@query(f"WITH {_SIDES} SELECT doc_id, page_number, pos, col::INT AS col, band::BIGINT AS band, ln::INT AS line_number FROM ordered")
def lay04_reading_order(spark, sf_dir):
    rows = fx.boxes(spark, sf_dir).where("dir_y <= 0.1").drop("line_number")
    return layout.reading_order(rows, PAGE, "pos").select("doc_id", "page_number", "pos", "col", F.col("band").cast("long").alias("band"), "line_number")


@query(f"""WITH {_SIDES} SELECT doc_id, page_number, col::INT AS col, min(x0) AS x0, max(x1) AS x1 FROM sided WHERE col >= 0 AND NOT single GROUP BY ALL
  UNION ALL SELECT doc_id, page_number, 0, 0.0::DOUBLE, max(width) FROM sided WHERE single GROUP BY ALL""")
def lay05_columns(spark, sf_dir):
    return layout.column_bounds(fx.boxes(spark, sf_dir).where("dir_y <= 0.1"), PAGE)


_RECTS = "(SELECT doc_id, 1 AS page_number, k AS rect_id, 60.0::DOUBLE + 200 * k AS x0, 61.0::DOUBLE + 40 * (doc_id % 5) AS y0, 200.0::DOUBLE + 200 * k AS x1, 75.0::DOUBLE + 40 * (doc_id % 5) + 500 * k AS y1 FROM documents, (SELECT unnest([0, 1]) AS k))"


def _rects(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), F.explode(F.array(F.lit(0), F.lit(1))).alias("rect_id"))
    at = 40 * (F.col("doc_id") % 5)
    k = F.col("rect_id")
    return d.select("*", (60.0 + 200 * k).alias("x0"), (61.0 + at).alias("y0"), (200.0 + 200 * k).alias("x1"), (75.0 + at + 500 * k).alias("y1"))


@query(f"""WITH l AS (SELECT * FROM {fx.DUCK_BOXES} WHERE dir_y <= 0.1), m AS (
  SELECT r.doc_id, r.page_number, r.rect_id, l.line_number, l.x0 <= r.x1 + 2 AND l.x1 >= r.x0 - 2 AND l.y0 <= r.y1 + 2 AND l.y1 >= r.y0 - 2 AS met, abs((l.y0 + l.y1) / 2 - (r.y0 + r.y1) / 2) AS gap
  FROM {_RECTS} r LEFT JOIN l USING (doc_id, page_number))
SELECT doc_id, page_number, rect_id, coalesce(min(line_number) FILTER (met), arg_min(line_number, (gap, line_number)), 0)::INT AS line_start, coalesce(max(line_number) FILTER (met), arg_min(line_number, (gap, line_number)), 0)::INT AS line_end FROM m GROUP BY ALL""")
def lay07_line_range(spark, sf_dir):
    return layout.line_ranges(_rects(spark, sf_dir), fx.boxes(spark, sf_dir).where("dir_y <= 0.1"), PAGE)


# Chunks -----------------------------------------------------------------------------------------------------------

_WALK = """RECURSIVE pages AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
sums AS (SELECT doc_id, l, len(l) AS n, list_transform(range(len(l) + 1), lambda i: i + coalesce(list_sum(list_transform(l[1:i], lambda s: length(s))), 0))::BIGINT[] AS p FROM pages),
walk AS (
  SELECT doc_id, 0 AS ord, 0::BIGINT AS s, least(n, len(list_filter(p, lambda x: x < 1100)))::BIGINT AS e FROM sums
  UNION ALL
  SELECT doc_id, ord + 1, s2, least(n, len(list_filter(p, lambda x: x < p[s2 + 1] + 1100)))::BIGINT FROM (
    SELECT w.doc_id, w.ord, x.n, x.p, greatest(w.s + 1, len(list_filter(x.p, lambda y: y <= x.p[w.e + 1] - 180)) - 1)::BIGINT AS s2 FROM walk w JOIN sums x USING (doc_id) WHERE w.e < x.n)),
windows AS (SELECT doc_id, ord, (s + 1)::INT AS line_start, e::INT AS line_end, trim(array_to_string(l[s + 1:e], chr(10)), E' \\t\\n\\r') AS text FROM walk JOIN sums USING (doc_id)),
parts AS (SELECT doc_id, line_start, line_end, text, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, count(*) OVER (PARTITION BY doc_id) AS n FROM windows WHERE text <> ''),
folds AS (SELECT *, lead(text) OVER d AS tail, lead(line_end) OVER d AS tail_end, n > 1 AND length(text) < 120 AND ord = n - 1 AS runt, coalesce(ord = n - 2 AND length(lead(text) OVER d) < 120, false) AS takes FROM parts WINDOW d AS (PARTITION BY doc_id ORDER BY ord)),
chunks AS (SELECT doc_id, ord, line_start, CASE WHEN takes THEN tail_end ELSE line_end END AS line_end, CASE WHEN takes THEN concat(text, chr(10), tail) ELSE text END AS text FROM folds WHERE NOT runt)"""


def _pages(spark, sf_dir):
    docs = dealt(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.where("text is not null").select("doc_id", F.lit(1).alias("page_number"), F.split("text", "\n", -1).alias("lines"))


def _chunks(spark, sf_dir, fold=True):
    return chunking.chunk_pages(_pages(spark, sf_dir), fold=fold).select("doc_id", F.col("ord").cast("long").alias("ord"), "line_start", "line_end", F.col("chunk_text").alias("text"))


@query(f"WITH {_WALK} SELECT doc_id, ord, line_start, line_end, md5(text) AS digest FROM parts")
def chk01_windows(spark, sf_dir):
    return _chunks(spark, sf_dir, fold=False).select("doc_id", "ord", "line_start", "line_end", F.md5("text").alias("digest"))


@query(f"WITH {_WALK} SELECT doc_id, ord, line_start, line_end, md5(text) AS digest FROM chunks")
def chk02_runt_fold(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "ord", "line_start", "line_end", F.md5("text").alias("digest"))


@query(f"""SELECT doc_id, page_number, pos, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pos % 3 = 0, pos) - 1)::INT AS chunk_index,
  concat(substring(sha1(concat('src/doc_', doc_id, '.pdf')), 1, 16), ':p', page_number, ':c', row_number() OVER (PARTITION BY doc_id, page_number ORDER BY pos % 3 = 0, pos) - 1) AS row_id FROM {fx.DUCK_LINES}""")
def chk03_index(spark, sf_dir):
    uid = tx.doc_uid(F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    rows = fx.lines(spark, sf_dir).select("doc_id", "page_number", "pos", uid.alias("doc_uid"), (F.col("pos") % 3 == 0).alias("is_table"), F.col("pos").alias("ord"))
    rows = chunking.indexed(rows)
    return rows.select("doc_id", "page_number", "pos", "chunk_index", tx.row_id(F.col("doc_uid"), F.col("page_number"), "c", F.col("chunk_index")).alias("row_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def chk04_no_text(spark, sf_dir):
    uid = lambda t, c: read(spark, sf_dir, t).select(F.col(c).alias("doc_uid"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("doc_uid"))
    return chunking.without_text(docs, uid("labels", "doc_id"), uid("benchmark", "item_id")).select("doc_id")


# Captions, figures, tables ------------------------------------------------------------------------------------------------

_CAP = "'(?i)^\\s*(figure|fig\\.?|table|scheme|chart|plate|exhibit)\\s*(\\d{1,3}[a-z]?|[ivxlc]{1,6})\\b'"


@query(f"""SELECT item_id, CASE WHEN lower(w) = 'table' THEN 'table' ELSE 'figure' END AS kind, concat(upper(w[1]), lower(w[2:]), ' ', n) AS label, substring(trim(regexp_replace(block_text, '\\s+', ' ', 'g')), 1, 800) AS caption FROM (
  SELECT *, rtrim(regexp_extract(string_split(block_text, chr(10))[1], {_CAP}, 1), '.') AS w, regexp_extract(string_split(block_text, chr(10))[1], {_CAP}, 2) AS n FROM {fx.duck("captions")}) WHERE w <> ''""")
def fig01_captions(spark, sf_dir):
    return figures.captions(fx.fixture(spark, sf_dir, "captions")).select("item_id", "kind", "label", "caption")


def _caps(spark, sf_dir):
    """A caption on the first page of each document, in three heights."""
    at = 200.0 + 100 * (F.col("doc_id") % 3)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), F.lit(0).alias("rect_id"), F.when(F.col("doc_id") % 4 == 0, "table").otherwise("figure").alias("kind"), at.alias("y0"), (at + 20).alias("y1"))
    x1 = F.when(F.col("doc_id") % 5 == 0, 560.0).otherwise(280.0)
    return rows.select("*", F.lit(60.0).alias("x0"), x1.alias("x1"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


_CAPS = """(SELECT doc_id, 1 AS page_number, 0 AS rect_id, CASE WHEN doc_id % 4 = 0 THEN 'table' ELSE 'figure' END AS kind, 200.0::DOUBLE + 100 * (doc_id % 3) AS y0, 220.0::DOUBLE + 100 * (doc_id % 3) AS y1, 60.0::DOUBLE AS x0,
  CASE WHEN doc_id % 5 = 0 THEN 560.0::DOUBLE ELSE 280.0::DOUBLE END AS x1, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height FROM documents)"""
_BOUNDS = """bounds AS (SELECT doc_id, page_number, col::INT AS col, min(x0) AS a, max(x1) AS b FROM sided WHERE col >= 0 AND NOT single GROUP BY ALL UNION ALL SELECT doc_id, page_number, 0, 0.0::DOUBLE, max(width) FROM sided WHERE single GROUP BY ALL),
near AS (SELECT c.doc_id, c.page_number, c.rect_id, c.kind, c.y0, c.y1, c.x0, c.x1, c.width, c.height, arg_min((a, b), (abs((a + b) / 2 - (c.x0 + c.x1) / 2), col)) AS best, min(a) AS lo, max(b) AS hi, count(*) AS n FROM """ + _CAPS + """ c JOIN bounds USING (doc_id, page_number) GROUP BY ALL),
capcols AS (SELECT * EXCLUDE (best, lo, hi, n), CASE WHEN n > 1 AND x1 - x0 > (best[2] - best[1]) * 1.35 THEN lo ELSE best[1] END AS col_x0, CASE WHEN n > 1 AND x1 - x0 > (best[2] - best[1]) * 1.35 THEN hi ELSE best[2] END AS col_x1 FROM near)"""


def _capped(spark, sf_dir):
    return figures.caption_columns(_caps(spark, sf_dir), layout.column_bounds(fx.boxes(spark, sf_dir).where("dir_y <= 0.1"), PAGE), PAGE)


@query(f"WITH {_SIDES}, {_BOUNDS} SELECT doc_id, rect_id, col_x0, col_x1 FROM capcols")
def fig03_columns(spark, sf_dir):
    return _capped(spark, sf_dir).select("doc_id", "rect_id", "col_x0", "col_x1")


def _clamp_sql(source: str) -> str:
    """SQL for bands (.., bx0, bx1, y0, y1, height, below) with top and bottom."""
    return f"""(SELECT * EXCLUDE (u, o), CASE WHEN below THEN CASE WHEN coalesce(u, height) - 3 - y1 >= 35 THEN y1 + 1 END ELSE CASE WHEN y0 - coalesce(o + 3, 3) >= 35 THEN coalesce(o + 3, 3.0::DOUBLE) END END AS top,
  CASE WHEN below THEN CASE WHEN coalesce(u, height) - 3 - y1 >= 35 THEN coalesce(u, height) - 3 END ELSE CASE WHEN y0 - coalesce(o + 3, 3) >= 35 THEN y0 - 1 END END AS bottom FROM (
  SELECT b.*, (SELECT min(l.y0) FROM textlines l WHERE l.doc_id = b.doc_id AND l.page_number = b.page_number AND l.y0 >= b.y1 + 1 AND NOT (l.x1 < b.bx0 - 5 OR l.x0 > b.bx1 + 5)) AS u,
    (SELECT max(l.y1) FROM textlines l WHERE l.doc_id = b.doc_id AND l.page_number = b.page_number AND l.y1 <= b.y0 - 1 AND NOT (l.x1 < b.bx0 - 5 OR l.x0 > b.bx1 + 5)) AS o FROM {source} b))"""


_LINES = f"textlines AS (SELECT * FROM {fx.DUCK_BOXES} WHERE dir_y <= 0.1)"
_BANDS = "bands AS (SELECT doc_id, page_number, rect_id, kind, y0, y1, width, height, col_x0 - 3 AS bx0, col_x1 + 3 AS bx1, unnest([false, true]) AS below FROM capcols)"


@query(f"WITH {_SIDES}, {_BOUNDS}, {_LINES}, {_BANDS} SELECT doc_id, rect_id, below, top, bottom FROM {_clamp_sql('bands')}")
def fig04_clamp(spark, sf_dir):
    caps = _capped(spark, sf_dir)
    bands = caps.select(*PAGE, "rect_id", "y0", "y1", "height", (F.col("col_x0") - 3).alias("bx0"), (F.col("col_x1") + 3).alias("bx1"), F.explode(F.array(F.lit(False), F.lit(True))).alias("below"))
    return figures.clamped(bands, fx.boxes(spark, sf_dir).where("dir_y <= 0.1"), PAGE, ["rect_id"]).select("doc_id", "rect_id", "below", "top", "bottom")


_ART = """(SELECT doc_id, 1 AS page_number, 60.0::DOUBLE AS x0, 210.0::DOUBLE + 60 * (doc_id % 7) AS y0, CASE doc_id % 3 WHEN 0 THEN 280.0::DOUBLE ELSE 550.0::DOUBLE END AS x1, 390.0::DOUBLE + 60 * (doc_id % 7) AS y1 FROM documents)"""


def _art(spark, sf_dir):
    at = 60 * (F.col("doc_id") % 7)
    return read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), F.lit(60.0).alias("x0"), (210.0 + at).alias("y0"), F.when(F.col("doc_id") % 3 == 0, 280.0).otherwise(550.0).alias("x1"), (390.0 + at).alias("y1"))


@query(f"""WITH {_SIDES}, {_BOUNDS}, {_LINES}, {_BANDS}, art AS {_ART},
narrow AS (SELECT * FROM {_clamp_sql("bands")} WHERE top IS NOT NULL),
inside AS (SELECT n.*, min(g.x0) AS ux0, max(g.x1) AS ux1 FROM narrow n JOIN art g ON n.doc_id = g.doc_id AND n.page_number = g.page_number AND bx0 < g.x1 AND g.x0 < bx1 AND top < g.y1 AND g.y0 < bottom GROUP BY ALL),
asked AS (SELECT doc_id, page_number, rect_id, y0, y1, height, below, greatest(0.0, least(bx0, ux0) - 3)::DOUBLE AS bx0, least(width, greatest(bx1, ux1) + 3)::DOUBLE AS bx1 FROM inside WHERE ux0 < bx0 - 2 OR ux1 > bx1 + 2),
again AS (SELECT doc_id, page_number, rect_id, below, bx0 AS wx0, bx1 AS wx1, top AS wtop, bottom AS wbottom FROM {_clamp_sql("asked")}),
picked AS (SELECT i.*, wx0, wx1, wtop, wbottom, coalesce(wbottom - wtop >= greatest(35.0, (bottom - top) * 0.5), false) AS take, row_number() OVER (PARTITION BY doc_id, page_number, rect_id ORDER BY below = (kind = 'table') DESC) AS nth FROM inside i LEFT JOIN again USING (doc_id, page_number, rect_id, below))
SELECT doc_id, rect_id, CASE WHEN take THEN wx0 ELSE bx0 END AS x0, CASE WHEN take THEN wtop ELSE top END AS y0, CASE WHEN take THEN wx1 ELSE bx1 END AS x1, CASE WHEN take THEN wbottom ELSE bottom END AS y1 FROM picked WHERE nth = 1""")
def fig05_region(spark, sf_dir):
    return figures.regions(_capped(spark, sf_dir), fx.boxes(spark, sf_dir).where("dir_y <= 0.1"), _art(spark, sf_dir), PAGE).select("doc_id", "rect_id", "x0", "y0", "x1", "y1")


@query(f"""WITH r AS (SELECT doc_id, page_number, pos AS rect_id, x0 - 10 AS x0, y0, x1, y0 + 30 + 5 * (pos % 5) AS y1 FROM {fx.DUCK_BOXES}),
pages AS (SELECT doc_id, page_number, list({{'rect_id': rect_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY rect_id) AS l FROM r WHERE (x1 - x0) * (y1 - y0) >= 10000 GROUP BY ALL),
kept AS (SELECT doc_id, page_number, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < 8 AND len(list_filter(acc, lambda b: b.x0 < x[1].x1 AND x[1].x0 < b.x1 AND b.y0 < x[1].y1 AND x[1].y0 < b.y1)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS k FROM pages)
SELECT doc_id, page_number, k.rect_id AS rect_id, k.x0 AS x0, k.y0 AS y0, k.x1 AS x1, k.y1 AS y1 FROM kept""")
def fig06_accepted(spark, sf_dir):
    """Regions of each page taken in order, none that meets an earlier one."""
    rows = fx.boxes(spark, sf_dir).select("doc_id", "page_number", F.col("pos").alias("rect_id"), (F.col("x0") - 10).alias("x0"), F.col("y0"), F.col("x1"), (F.col("y0") + 30 + 5 * (F.col("pos") % 5)).alias("y1"))
    return figures.accepted(rows, PAGE)


@query("""WITH i AS (SELECT doc_id, unnest([0, 1, 2]) AS image_id, n_chars FROM documents),
images AS (SELECT doc_id, image_id, n_chars * 20 * (image_id + 1) AS pixels, 300.0 + 40 * ((doc_id + image_id) % 6) AS y0, 350.0 + 40 * ((doc_id + image_id) % 6) AS y1 FROM i),
caps AS (SELECT doc_id, 0 AS c_id, 'a caption' AS caption, 'Figure 1' AS label, 520.0 AS y0, 540.0 AS y1 FROM documents WHERE doc_id % 4 <> 0
  UNION ALL SELECT doc_id, 1, 'another', 'Figure 3', 240.0, 260.0 FROM documents WHERE doc_id % 3 = 0),
taken AS (SELECT doc_id, 'Figure 2' AS label, 60.0 AS x0, 320.0 AS y0, 200.0 AS x1, 380.0 AS y1 FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'FIGURE 1', 400.0, 700.0, 500.0, 780.0 FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, '', 400.0, 600.0 + unnest(range(6)), 500.0, 690.0 FROM documents WHERE doc_id % 11 = 0),
free AS (SELECT * FROM images i WHERE pixels >= 40000 AND doc_id IN (SELECT doc_id FROM caps)
  AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.doc_id = i.doc_id AND 60 < t.x1 AND t.x0 < 200 AND i.y0 < t.y1 AND t.y0 < i.y1)),
near AS (SELECT f.doc_id, image_id, arg_min({'caption': caption, 'label': label}, (least(abs(c.y0 - f.y1), abs(f.y0 - c.y1)), c_id)) AS c FROM free f JOIN caps c ON c.doc_id = f.doc_id AND least(abs(c.y0 - f.y1), abs(f.y0 - c.y1)) < 90 GROUP BY ALL),
named AS (SELECT doc_id, image_id, pixels, coalesce(c.caption, '') AS caption, coalesce(c.label, '') AS label FROM free LEFT JOIN near USING (doc_id, image_id)),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY image_id) AS nth FROM named n WHERE (caption <> '' OR pixels >= 160000) AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.doc_id = n.doc_id AND t.label <> '' AND lower(t.label) = lower(n.label)))
SELECT doc_id, image_id, CASE WHEN caption <> '' THEN caption ELSE concat('Untitled image on page 1 of doc_', doc_id, '.pdf') END AS caption, label FROM kept WHERE nth + (SELECT count(*) FROM taken t WHERE t.doc_id = kept.doc_id) <= 8""")
def fig07_images(spark, sf_dir):
    """Three images a page beside two captions and up to eight regions that are taken."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit(1).alias("page_number"))
    at = 40 * ((F.col("doc_id") + F.col("image_id")) % 6)
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    images = docs.withColumn("image_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        *PAGE, "image_id", name.alias("document_name"), (F.col("n_chars") * 20 * (F.col("image_id") + 1)).alias("pixels"), F.lit(60.0).alias("x0"), (300.0 + at).alias("y0"), F.lit(200.0).alias("x1"), (350.0 + at).alias("y1"),
    )
    cap = lambda rows, i, caption, label, y: rows.select(*PAGE, F.lit(i).alias("rect_id"), F.lit(caption).alias("caption"), F.lit(label).alias("label"), F.lit(y).alias("y0"), F.lit(y + 20).alias("y1"))
    caps = cap(docs.where("doc_id % 4 <> 0"), 0, "a caption", "Figure 1", 520.0).unionByName(cap(docs.where("doc_id % 3 = 0"), 1, "another", "Figure 3", 240.0))
    box = lambda rows, i, label, *edges: rows.select(*PAGE, i.alias("rect_id"), F.lit(label).alias("label"), *[e.alias(c) for c, e in zip(layout.BOX, edges, strict=True)])
    nth, lit = F.explode(F.sequence(F.lit(0), F.lit(5))), F.lit
    many = docs.where("doc_id % 11 = 0").withColumn("nth", nth)
    taken = box(docs.where("doc_id % 5 = 0"), lit(2), "Figure 2", lit(60.0), lit(320.0), lit(200.0), lit(380.0))
    taken = taken.unionByName(box(docs.where("doc_id % 7 = 0"), lit(3), "FIGURE 1", lit(400.0), lit(700.0), lit(500.0), lit(780.0)))
    taken = taken.unionByName(box(many, F.col("nth") + 4, "", lit(400.0), 600.0 + F.col("nth"), lit(500.0), lit(690.0)))
    return figures.embedded_images(images, caps, taken, PAGE).select("doc_id", "image_id", "caption", "label")


@query(f"""SELECT doc_id, page_number, line_number, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, line_number) - 1)::INT AS figure_index FROM {fx.DUCK_LINES}""")
def fig08_index(spark, sf_dir):
    rows = fx.lines(spark, sf_dir).select("doc_id", "page_number", "line_number", F.col("doc_id").alias("doc_uid"), F.col("line_number").alias("ord"))
    return figures.numbered(rows).select("doc_id", "page_number", "line_number", "figure_index")


@query(f"SELECT query_id, hit_ord, trim(concat_ws(' ', nullif(caption, ''), nullif(content_type, ''))) AS figure_text FROM {fx.duck('hits')}")
def fig09_text(spark, sf_dir):
    return fx.fixture(spark, sf_dir, "hits").select("query_id", "hit_ord", figures.figure_text(F.col("caption"), F.col("content_type")).alias("figure_text"))


def _cells(spark, sf_dir):
    """A table of cells per document: its words three a row beside an empty column, with rows that are empty, blank or
    ragged, so that long texts have more rows than a table shows."""
    words = F.filter(F.split("text", "[ \\n]+", -1), lambda w: w != "")
    starts = lambda w: F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(3)), lambda i: i <= F.size(w))
    row = lambda w, i: F.concat(F.array(F.concat(F.get(w, i - 1), F.lit(" \n x|")), F.lit("")), F.slice(w, i + 1, 2))
    head = F.array(F.array(F.lit("word"), F.lit("")), F.array(F.lit(""), F.lit(None).cast("string")), F.array(F.lit(" "), F.lit(""), F.lit("")))
    rows = tx.once(words, lambda w: F.transform(starts(w), lambda i: row(w, i)))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(head, rows).alias("rows"))


_CELL = lambda k: f"trim(regexp_replace(w[3 * r + {k}], '[[:space:]]+', ' ', 'g'))"
_MARKDOWN = f"""SELECT doc_id, CASE WHEN len(w) < 2 THEN '' ELSE concat('| word |', CASE WHEN len(w) > 1 THEN ' col2 |' END, CASE WHEN len(w) > 2 THEN ' col3 |' END, chr(10), '| --- |', CASE WHEN len(w) > 1 THEN ' --- |' END, CASE WHEN len(w) > 2 THEN ' --- |' END,
  array_to_string(list_transform(range(least(77, (len(w) + 2) // 3)), lambda r: concat(chr(10), '| ', {_CELL(1)}, ' x| |', concat(' ', coalesce({_CELL(2)}, ''), ' |'), CASE WHEN len(w) > 2 THEN concat(' ', coalesce({_CELL(3)}, ''), ' |') END)), '')) END AS markdown
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)"""


@query(_MARKDOWN)
def tbl01_markdown(spark, sf_dir):
    return _cells(spark, sf_dir).select("doc_id", tables.markdown(F.col("rows")).alias("markdown"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 4 WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS line_start, CASE WHEN doc_id % 3 = 0 THEN 9 WHEN doc_id % 3 = 1 THEN 30 ELSE 0 END AS line_end,
  md5(concat('Table extracted from page 1:', chr(10), chr(10), substring(markdown, 1, 6000))) AS digest FROM ({_MARKDOWN}) WHERE markdown <> ''""")
def tbl02_chunks(spark, sf_dir):
    t = _cells(spark, sf_dir).select(F.col("doc_id").alias("doc_uid"), F.lit(1).alias("page_number"), F.lit(0).alias("ord"), "rows")
    ids = t.select("doc_uid", "page_number", "ord")
    ranges = ids.where("doc_uid % 3 = 0").select("*", F.lit(4).alias("line_start"), F.lit(9).alias("line_end"))
    pages = ids.where("doc_uid % 3 = 1").select("doc_uid", "page_number", F.lit(30).alias("n_lines"))
    made = tables.table_chunks(t, ranges, pages)
    return made.select(F.col("doc_uid").alias("doc_id"), "line_start", "line_end", F.md5("text").alias("digest"))


# Retrieval --------------------------------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"


def _words_sql(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({column}), '[a-z0-9]{{3,}}'), lambda w: NOT list_contains({_STOP}, w)))"


_KNN = "SELECT q.item_id AS query_id, e.vec_id AS row_id, 1 - list_cosine_similarity(qe.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM benchmark q JOIN embeddings qe ON q.item_id = qe.vec_id, embeddings e"
_DENSE = f"""dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS dense_rank FROM ({_KNN}))"""


def _questions(spark, sf_dir):
    q = read(spark, sf_dir, "benchmark").join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    return q.select(F.col("item_id").alias("query_id"), "text", "embedding")


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label")


@query(f"WITH {_DENSE} SELECT query_id, row_id, round(distance, 9) AS distance, dense_rank::INT AS dense_rank FROM dense WHERE dense_rank <= 24")
def ret01_knn(spark, sf_dir):
    return retrieval.dense_top(_vectors(spark, sf_dir), _questions(spark, sf_dir)).select("query_id", "row_id", F.round("distance", 9).alias("distance"), "dense_rank")


@query(f"WITH dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS dense_rank FROM ({_KNN} WHERE e.label = 3)) SELECT query_id, row_id, round(greatest(0, 1 - distance), 9)::DOUBLE AS dense_score FROM dense WHERE dense_rank <= 24")
def ret02_filtered_knn(spark, sf_dir):
    return retrieval.dense_top(_vectors(spark, sf_dir).where("label = 3"), _questions(spark, sf_dir)).select("query_id", "row_id", F.round("dense_score", 9).alias("dense_score"))


@query(f"SELECT doc_id, array_to_string(list_sort({_words_sql('text')}), ' ') AS words FROM documents")
def ret03_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(tx.content_words(F.col("text"))), " ").alias("words"))


_DOC_KNN = "SELECT q.item_id AS query_id, d.doc_id AS row_id, coalesce(1 - list_cosine_similarity(qe.embedding::DOUBLE[], e.embedding::DOUBLE[]), 1) AS distance FROM benchmark q JOIN embeddings qe ON q.item_id = qe.vec_id, documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"
_DOC_DENSE = f"dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS dense_rank FROM ({_DOC_KNN}))"


@query(f"""WITH {_DOC_DENSE}, q AS (SELECT item_id, {_words_sql("text")} AS q_words FROM benchmark), d AS (SELECT doc_id, {_words_sql("text")} AS words FROM documents WHERE doc_id IN (SELECT row_id FROM dense WHERE dense_rank <= 24))
SELECT query_id, row_id, len(list_intersect(words, q_words))::INT AS shared, round(CASE WHEN len(q_words) = 0 THEN 0 ELSE ln(1 + len(list_intersect(words, q_words))) / ln(1 + len(q_words)) END, 9)::DOUBLE AS lexical_score
FROM dense JOIN q ON item_id = query_id JOIN d ON doc_id = row_id WHERE dense_rank <= 24""")
def ret04_lexical(spark, sf_dir):
    """Word overlap of each question's dense candidates."""
    words = tx.content_words(F.col("text")).alias("words")
    docs, asked = _documents(spark, sf_dir), _questions(spark, sf_dir)
    found = retrieval.dense_top(docs, asked)
    rows = retrieval.overlaps(found, docs.select("row_id", words), asked.select("query_id", words))
    return rows.select("query_id", "row_id", "shared", F.round("lexical_score", 9).alias("lexical_score"))


_HYBRID = """cand AS (SELECT d.*, c.text, {words} AS words, {qwords} AS q_words FROM dense d JOIN corpus c USING (row_id) JOIN benchmark b ON b.item_id = d.query_id WHERE dense_rank <= {n}),
scored AS (SELECT *, CASE WHEN len(q_words) = 0 THEN 0 ELSE ln(1 + len(list_intersect(words, q_words))) / ln(1 + len(q_words)) END AS lexical FROM cand),
hits AS (SELECT query_id, row_id, text, (1 - {w}) * greatest(0, 1 - distance) + {w} * lexical AS score, lexical, row_number() OVER (PARTITION BY query_id ORDER BY round((1 - {w}) * greatest(0, 1 - distance) + {w} * lexical, 12) DESC, dense_rank) AS hit_rank FROM scored)"""


def _hybrid_sql(n: int, w: float) -> str:
    return _HYBRID.format(words=_words_sql("c.text"), qwords=_words_sql("b.text"), n=n, w=w)


_CHUNK_CORPUS = f"""WITH {_WALK}, corpus AS (SELECT doc_id * 100000 + ord AS row_id, text, doc_id, line_start, line_end FROM chunks),
docdense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS nth FROM (SELECT * FROM ({_DOC_KNN}) WHERE row_id IN (SELECT doc_id FROM corpus))),
dense AS (SELECT query_id, c.row_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, c.row_id) AS dense_rank FROM docdense d JOIN corpus c ON c.doc_id = d.row_id WHERE nth <= 24)"""


@query(f"""{_CHUNK_CORPUS}, {_hybrid_sql(24, 0.35)}
SELECT query_id, row_id, hit_rank::INT AS hit_rank, round(score, 9) AS score, round(lexical, 9)::DOUBLE AS lexical_score, concat('[doc_', doc_id, '.pdf, Page 1, Line ', line_start, '-', line_end, ']') AS citation FROM hits JOIN corpus USING (row_id) WHERE hit_rank <= 5""")
def ret06_hybrid_topk(spark, sf_dir):
    """The five best chunks of each question, with citation labels: chunks of all documents, each with its document's
    vector, or at distance 1 where it has none."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = _chunks(spark, sf_dir).join(vectors, "doc_id", "left")
    corpus = chunks.select((F.col("doc_id") * 100000 + F.col("ord")).alias("row_id"), "doc_id", "line_start", "line_end", "text", "embedding")
    hits = retrieval.hybrid(corpus, _questions(spark, sf_dir))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    label = tx.citation_label(name, F.lit(1), F.col("line_start"), F.col("line_end"))
    return hits.select("query_id", "row_id", "hit_rank", F.round("score", 9).alias("score"), F.round("lexical_score", 9).alias("lexical_score"), label.alias("citation"))


_DOC_CORPUS = "corpus AS (SELECT doc_id AS row_id, text FROM documents)"


def _documents(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text").join(vectors, "row_id", "left")


@query(f"WITH {_DOC_DENSE}, {_DOC_CORPUS}, {_hybrid_sql(9, 0.25)} SELECT query_id, row_id, hit_rank::INT AS hit_rank, round(score, 9) AS score FROM hits WHERE hit_rank <= 3")
def ret07_caption_topk(spark, sf_dir):
    return retrieval.figures(_documents(spark, sf_dir), _questions(spark, sf_dir)).select("query_id", "row_id", "hit_rank", F.round("score", 9).alias("score"))


_TOPS = f"WITH {_DOC_DENSE}, {_DOC_CORPUS}, {{}} SELECT '{{}}' AS collection, query_id, row_id, hit_rank, score FROM hits WHERE hit_rank <= {{}}"


@query(f"""SELECT query_id, collection, row_id, hit_rank::INT AS hit_rank, (row_number() OVER (PARTITION BY query_id ORDER BY collection, hit_rank) - 1)::INT AS hit_ord, round(score, 9) AS score
  FROM (SELECT * FROM ({_TOPS.format(_hybrid_sql(24, 0.35), "chunks", 5)}) UNION ALL SELECT * FROM ({_TOPS.format(_hybrid_sql(9, 0.25), "figures", 3)}))""")
def ret08_bundle(spark, sf_dir):
    docs, asked = _documents(spark, sf_dir), _questions(spark, sf_dir)
    return retrieval.bundle(retrieval.hybrid(docs, asked), retrieval.figures(docs, asked)).select("query_id", "collection", "row_id", "hit_rank", "hit_ord", F.round("score", 9).alias("score"))


@query("""WITH w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+'))) AS m FROM documents),
v AS (SELECT doc_id, ('0x' || substring(m, 1, 8))::BIGINT % 64 AS place, sum(CASE WHEN substring(m, 9, 1) >= '8' THEN 1 ELSE -1 END) AS s FROM w GROUP BY ALL)
SELECT doc_id, place::INT AS place, (s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS value FROM v WHERE s <> 0""")
def emb01_hashing(spark, sf_dir):
    """The components that aren't zero of all documents' vectors."""
    rows = embed.embed(dealt(read(spark, sf_dir, "documents").select("doc_id", "text")), embed.embedder("hashing", dim=64))
    return rows.select("doc_id", F.posexplode("embedding").alias("place", "value")).where("value <> 0").select("doc_id", "place", F.col("value").cast("double").alias("value"))


# Context ------------------------------------------------------------------------------------------------------------

_ENTRY = """concat('[', {no}, '] ', CASE WHEN content_type = 'table' THEN 'TABLE' ELSE 'PASSAGE' END, chr(10), 'CITATION: [', document_name, ', Page ', page_number, ', Line ', line_start, '-', line_end, ']', chr(10), 'CONTENT:', chr(10), trim(text, E' \\t\\n\\r'), chr(10))"""
_PACK = f"""h AS {fx.duck("hits")}, numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank) AS no FROM h),
entries AS (SELECT *, {_ENTRY.format(no="no")} AS entry FROM numbered),
sums AS (SELECT *, sum(length(entry)) OVER (PARTITION BY query_id ORDER BY no) AS used FROM entries),
packed AS (SELECT * FROM sums WHERE used <= 4500 OR no = 1)"""


@query(f"WITH {_PACK} SELECT query_id, hit_rank, no::INT AS entry_no, used::BIGINT AS used, md5(entry) AS digest FROM packed")
def ctx01_pack(spark, sf_dir):
    return context.pack_passages(fx.fixture(spark, sf_dir, "hits")).select("query_id", "hit_rank", "entry_no", "used", F.md5("entry").alias("digest"))


_PICS = """pics AS (SELECT query_id, hit_rank, caption, text, document_name, page_number, line_start, line_end, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank) AS nth FROM h WHERE content_type = 'table'),
spent AS (SELECT query_id, max(used) AS spent, max(no) AS kept FROM packed GROUP BY query_id),
fig AS (SELECT p.*, coalesce(spent, 0) AS spent, coalesce(kept, 0) AS kept, concat('[', coalesce(kept, 0) + nth, '] FIGURE', chr(10), 'CITATION: [', document_name, ', Page ', page_number, ', Line ', line_start, '-', line_end, ']', chr(10), 'CAPTION: ', trim(coalesce(nullif(caption, ''), text), E' \\t\\n\\r'), chr(10)) AS entry FROM pics p LEFT JOIN spent USING (query_id)),
figs AS (SELECT *, spent + sum(length(entry)) OVER (PARTITION BY query_id ORDER BY nth) AS used FROM fig)"""


def _pictures(hits):
    return hits.where("content_type = 'table'")


@query(f"WITH {_PACK}, {_PICS} SELECT query_id, (kept + nth)::BIGINT AS entry_no, used::BIGINT AS used, md5(entry) AS digest FROM figs WHERE used <= 4500 OR (nth = 1 AND kept = 0)")
def ctx02_figures(spark, sf_dir):
    hits = fx.fixture(spark, sf_dir, "hits")
    rows = context.pack_figures(_pictures(hits), context.pack_passages(hits))
    return rows.select("query_id", F.col("entry_no").cast("long").alias("entry_no"), "used", F.md5("entry").alias("digest"))


@query(f"""WITH {_PACK}, {_PICS}, every AS (SELECT query_id, no, entry FROM packed UNION ALL SELECT query_id, kept + nth, entry FROM figs WHERE used <= 4500 OR (nth = 1 AND kept = 0)),
ctx AS (SELECT query_id, string_agg(entry, chr(10) ORDER BY no) AS context FROM every GROUP BY query_id)
SELECT item_id AS query_id, md5(concat('CONTEXT PASSAGES', chr(10), '================', chr(10), coalesce(context, ''), chr(10), '================', chr(10), chr(10), 'QUESTION: ', text, chr(10), chr(10), 'Answer using only the context above, citing every claim in the format [DocName.pdf, Page X, Line Y-Z].')) AS digest FROM benchmark LEFT JOIN ctx ON item_id = query_id""")
def ctx03_prompts(spark, sf_dir):
    hits = fx.fixture(spark, sf_dir, "hits")
    packed = context.pack_passages(hits)
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return context.prompts(asked, packed, context.pack_figures(_pictures(hits), packed)).select("query_id", F.md5("prompt").alias("digest"))


@query(f"""WITH h AS {fx.duck("hits")}, e AS (SELECT query_id, hit_rank, concat(hit_rank, '. [', document_name, ', Page ', page_number, ', Line ', line_start, '-', line_end, ']', chr(10), '   ', substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 280), '...', chr(10)) AS entry FROM h WHERE hit_rank <= 5)
SELECT query_id, md5(rtrim(concat('The local LLM is unavailable, so no synthesised answer was generated.', chr(10), 'Reason: down', chr(10), chr(10), 'Start it with `ollama serve`, then ask again. The most relevant passages retrieved for this question are:', chr(10), chr(10), string_agg(entry, chr(10) ORDER BY hit_rank)), E'\\n')) AS digest FROM e GROUP BY query_id""")
def ans02_retrieval_only(spark, sf_dir):
    return context.retrieval_only(fx.fixture(spark, sf_dir, "hits"), "down").select("query_id", F.md5("answer").alias("digest"))


_REPLY = "It says so "
_FALSE = "[nope.pdf, Page 1, Line 1]"


def _replies():
    """A client whose replies follow from the prompt: it cites the first passage and a document that isn't there, and fails
    where the prompt's length is a multiple of three."""

    def generate(_system, prompt):
        if len(prompt) % 3 == 0:
            raise answer.ModelUnavailable("down")
        yield "<think>a thou"
        yield f"ght [x]</think>{_REPLY}"
        yield f"{re.search(r'CITATION: (.*)', prompt)[1]} and {_FALSE}."

    return generate


@query(f"""WITH {_PACK}, {_PICS}, every AS (SELECT query_id, no, entry FROM packed UNION ALL SELECT query_id, kept + nth, entry FROM figs WHERE used <= 4500 OR (nth = 1 AND kept = 0)),
ctx AS (SELECT query_id, string_agg(entry, chr(10) ORDER BY no) AS context, min_by(entry, no) AS top_entry FROM every GROUP BY query_id),
asked AS (SELECT item_id AS query_id, top_entry, CASE WHEN context IS NOT NULL THEN length(concat('CONTEXT PASSAGES', chr(10), '================', chr(10), context, chr(10), '================', chr(10), chr(10), 'QUESTION: ', text, chr(10), chr(10), 'Answer using only the context above, citing every claim in the format [DocName.pdf, Page X, Line Y-Z].')) END AS n FROM benchmark LEFT JOIN ctx ON item_id = query_id),
e AS (SELECT query_id, hit_rank, concat(hit_rank, '. [', document_name, ', Page ', page_number, ', Line ', line_start, '-', line_end, ']', chr(10), '   ', substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 280), '...', chr(10)) AS entry FROM h WHERE hit_rank <= 5),
alone AS (SELECT query_id, count(*) AS n_alone, rtrim(concat('The local LLM is unavailable, so no synthesised answer was generated.', chr(10), 'Reason: down', chr(10), chr(10), 'Start it with `ollama serve`, then ask again. The most relevant passages retrieved for this question are:', chr(10), chr(10), string_agg(entry, chr(10) ORDER BY hit_rank)), E'\\n') AS said FROM e GROUP BY query_id)
SELECT a.query_id,
  md5(CASE WHEN n IS NULL THEN '{answer.NO_CONTENT}' WHEN n % 3 = 0 THEN said ELSE concat('{_REPLY}', regexp_extract(top_entry, 'CITATION: ([^\n]*)', 1), ' and {_FALSE} [unverified].') END) AS digest,
  CASE WHEN n IS NULL THEN 'empty retrieval' WHEN n % 3 = 0 THEN '{answer.MODEL_DOWN}' ELSE concat('1 of ', n_whole, ' citations could not be matched to retrieved context and are marked [unverified].') END AS warning,
  CASE WHEN n IS NULL THEN 0 WHEN n % 3 = 0 THEN n_alone ELSE n_whole END::INT AS n_cited, CASE WHEN n IS NULL THEN 0 WHEN n % 3 = 0 THEN n_alone ELSE n_whole - 1 END::INT AS n_verified
FROM (SELECT *, CASE WHEN contains(regexp_extract(top_entry, 'CITATION: ([^\n]*)', 1), '.pdf,') THEN 2 ELSE 1 END AS n_whole FROM asked) a LEFT JOIN alone USING (query_id)""")
def ans03_batch(spark, sf_dir):
    """All questions of the benchmark in one plan, by a client whose replies can be foretold."""
    hits = fx.fixture(spark, sf_dir, "hits")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = answer.batch_answers(asked, hits, _pictures(hits), _replies, shared_path(spark, "answers"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    verified = F.size(F.filter("citations", lambda c: c["verified"]))
    has = F.col("citations").isNotNull()
    return found.select("query_id", F.md5("text").alias("digest"), "warning", n(F.when(has, F.size("citations"))).alias("n_cited"), n(F.when(has, verified)).alias("n_verified"))


@query(f"""SELECT conv_id, turn, regexp_replace(regexp_replace(answer, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', '') AS answer FROM {fx.duck("thoughts")}""")
def llm02_think(spark, sf_dir):
    return fx.fixture(spark, sf_dir, "thoughts").select("conv_id", "turn", tx.without_thinking(F.col("answer")).alias("answer"))


# Citations ----------------------------------------------------------------------------------------------------------

_CITE = "'\\[\\s*([^\\[\\],]+?\\.pdf)\\s*,\\s*[Pp]ages?\\s*(\\d{1,5})\\s*,\\s*[Ll]ines?\\s*(\\d{1,6})\\s*(?:[-\\x{2010}-\\x{2015}]\\s*(\\d{1,6}))?\\s*\\]'"
_CITED = f"""ans AS {fx.duck("answers")}, raws AS (SELECT answer_id, query_id, unnest(r) AS raw, unnest(range(len(r))) AS pos FROM (SELECT answer_id, query_id, regexp_extract_all(text, {_CITE}) AS r FROM ans)),
nums AS (SELECT *, trim(regexp_extract(raw, {_CITE}, 1)) AS document_name, regexp_extract(raw, {_CITE}, 2)::INT AS page, regexp_extract(raw, {_CITE}, 3)::INT AS a, coalesce(try_cast(nullif(regexp_extract(raw, {_CITE}, 4), '') AS INT), regexp_extract(raw, {_CITE}, 3)::INT) AS b FROM raws),
firsts AS (SELECT *, row_number() OVER (PARTITION BY answer_id, lower(document_name), page, least(a, b), greatest(a, b) ORDER BY pos) AS nth FROM nums),
cited AS (SELECT answer_id, query_id, raw, document_name, page, least(a, b) AS line_start, greatest(a, b) AS line_end, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS ord FROM firsts WHERE nth = 1)"""


@query(f"WITH {_CITED} SELECT answer_id, ord::INT AS ord, raw, document_name, page, line_start, line_end FROM cited")
def cit01_parse(spark, sf_dir):
    return citations.parse(fx.fixture(spark, sf_dir, "answers")).drop("query_id")


_VERIFY = f"""hits AS {fx.duck("hits")}, docs AS (SELECT query_id, lower(document_name) AS k, min(hit_ord) AS first, regexp_replace(lower(document_name), '\\.pdf$', '') AS stem FROM hits GROUP BY ALL),
keyed AS (SELECT c.*, coalesce((SELECT any_value(k) FROM docs d WHERE d.query_id = c.query_id AND d.k = lower(c.document_name)), (SELECT arg_min(k, first) FROM docs d WHERE d.query_id = c.query_id AND d.stem = regexp_replace(lower(c.document_name), '\\.pdf$', '')), lower(c.document_name)) AS k FROM cited c),
pairs AS (SELECT c.*, h.hit_ord, h.text, coalesce(c.line_start <= h.line_end + 5 AND h.line_start <= c.line_end + 5, false) AS verified FROM keyed c LEFT JOIN hits h ON h.query_id = c.query_id AND lower(h.document_name) = c.k AND h.page_number = c.page),
checked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, ord ORDER BY verified DESC, hit_ord) AS nth FROM pairs) WHERE nth = 1)"""


def _checked(spark, sf_dir):
    return citations.verify(citations.parse(fx.fixture(spark, sf_dir, "answers")), fx.fixture(spark, sf_dir, "hits"))


@query(f"WITH {_CITED}, {_VERIFY} SELECT answer_id, ord::INT AS ord, verified, hit_ord, coalesce(substring(text, 1, 700), '') AS snippet FROM checked")
def cit04_verify(spark, sf_dir):
    return _checked(spark, sf_dir).select("answer_id", "ord", "verified", "hit_ord", "snippet")


@query(f"""WITH {_CITED}, {_VERIFY} SELECT c.answer_id, c.ord::INT AS ord, coalesce(h.content_type, '') AS content_type, coalesce(h.caption, '') AS caption, coalesce(h.image_path, '') AS image_path FROM checked c LEFT JOIN hits h USING (query_id, hit_ord)""")
def cit05_enrich(spark, sf_dir):
    return _checked(spark, sf_dir).select("answer_id", "ord", "content_type", "caption", "image_path")


@query(f"SELECT query_id, hit_ord, concat('[', document_name, ', Page ', page_number, ', Line ', line_start, '-', line_end, ']') AS raw, true AS verified FROM {fx.duck('hits')}")
def cit06_from_hits(spark, sf_dir):
    return citations.from_hits(fx.fixture(spark, sf_dir, "hits")).select("query_id", "hit_ord", "raw", "verified")


@query(f"""WITH {_CITED}, {_VERIFY}, opens AS (SELECT answer_id, list(raw ORDER BY ord) AS r FROM checked WHERE NOT verified GROUP BY answer_id)
SELECT answer_id, md5(list_reduce(list_prepend(text, coalesce(r, [])), lambda t, x: CASE WHEN contains(t, concat(x, ' [unverified]')) THEN t ELSE replace(t, x, concat(x, ' [unverified]')) END)) AS digest FROM ans LEFT JOIN opens USING (answer_id)""")
def cit07_annotate(spark, sf_dir):
    return citations.annotate(fx.fixture(spark, sf_dir, "answers"), _checked(spark, sf_dir)).select("answer_id", F.md5("text").alias("digest"))


@query(f"""WITH {_CITED}, {_VERIFY}, c AS (SELECT answer_id, count(ord) AS n, count(*) FILTER (verified) AS v FROM ans LEFT JOIN checked USING (answer_id) GROUP BY answer_id)
SELECT answer_id, round(CASE WHEN n = 0 THEN 1.0 ELSE v / n END, 9)::DOUBLE AS coverage, CASE WHEN n = 0 THEN 'The model returned no citations; showing retrieved sources instead.' WHEN v < n THEN concat(n - v, ' of ', n, ' citations could not be matched to retrieved context and are marked [unverified].') ELSE '' END AS warning FROM c""")
def cit08_coverage(spark, sf_dir):
    counts = citations.coverage(fx.fixture(spark, sf_dir, "answers"), _checked(spark, sf_dir))
    return citations.warnings(counts).select("answer_id", F.round("coverage", 9).alias("coverage"), "warning")


# The manifest ---------------------------------------------------------------------------------------------------------

_MAN, _LIST = fx.duck("manifest"), fx.duck("listing")


def _both(spark, sf_dir):
    return fx.fixture(spark, sf_dir, "manifest"), fx.fixture(spark, sf_dir, "listing")


@query(f"SELECT doc_uid, document_name, status, chunk_count FROM {_MAN} WHERE doc_uid = substring(sha1('src/doc_3.pdf'), 1, 16)")
def man01_get(spark, sf_dir):
    return manifest.get(fx.fixture(spark, sf_dir, "manifest"), tx.doc_uid(F.lit("src/doc_3.pdf"))).select("doc_uid", "document_name", "status", "chunk_count")


@query(f"SELECT document_name, doc_uid FROM {_MAN}")
def man02_by_name(spark, sf_dir):
    return manifest.by_name(fx.fixture(spark, sf_dir, "manifest")).select("document_name", "doc_uid")


@query(f"SELECT doc_uid, document_name FROM {_MAN} WHERE status = 'failed'")
def man03_failed(spark, sf_dir):
    return manifest.by_status(fx.fixture(spark, sf_dir, "manifest"), "failed").select("doc_uid", "document_name")


@query(f"SELECT status, count(*) AS n FROM {_MAN} GROUP BY status")
def man04_by_status(spark, sf_dir):
    return manifest.counts_by_status(fx.fixture(spark, sf_dir, "manifest"))


@query(f"SELECT count(*) AS documents, coalesce(sum(page_count), 0)::BIGINT AS pages, coalesce(sum(chunk_count), 0)::BIGINT AS chunks, coalesce(sum(figure_count), 0)::BIGINT AS figures, coalesce(sum(table_count), 0)::BIGINT AS tables FROM {_MAN} WHERE status = 'indexed'")
def man05_totals(spark, sf_dir):
    return manifest.totals(fx.fixture(spark, sf_dir, "manifest"))


@query(f"""SELECT coalesce(l.doc_uid, m.doc_uid) AS doc_uid, coalesce(l.document_name, m.document_name) AS document_name, coalesce(l.sha256, m.sha256) AS sha256, coalesce(l.size_bytes, m.size_bytes) AS size_bytes, CASE WHEN l.doc_uid IS NOT NULL THEN 'pending' ELSE m.status END AS status,
  coalesce(m.chunk_count, 0) AS chunk_count, coalesce(m.parser_version, '') AS parser_version, CASE WHEN l.doc_uid IS NOT NULL THEN '' ELSE m.error END AS error, coalesce(m.indexed_at, '') AS indexed_at, CASE WHEN l.doc_uid IS NOT NULL THEN '{NOW}' ELSE m.updated_at END AS updated_at
  FROM {_MAN} m FULL JOIN {_LIST} l ON m.doc_uid = l.doc_uid""")
def man06_upsert(spark, sf_dir):
    rows = manifest.upsert_pending(*_both(spark, sf_dir), NOW)
    return rows.select("doc_uid", "document_name", "sha256", "size_bytes", "status", "chunk_count", "parser_version", "error", "indexed_at", "updated_at")


@query(f"SELECT doc_uid, status FROM {_MAN} WHERE doc_uid NOT IN (SELECT doc_uid FROM {_LIST} WHERE size_bytes % 2 = 0)")
def man07_delete(spark, sf_dir):
    rows, files = _both(spark, sf_dir)
    return manifest.delete(rows, files.where("size_bytes % 2 = 0")).select("doc_uid", "status")


@query(f"SELECT doc_uid, CASE WHEN size_bytes % 3 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN size_bytes % 3 = 0 THEN repeat('e', 2000) ELSE error END AS error FROM {_MAN}")
def man08_set_status(spark, sf_dir):
    rows = fx.fixture(spark, sf_dir, "manifest")
    changes = rows.where("size_bytes % 3 = 0").select("doc_uid", F.lit("failed").alias("new_status"), F.lit("e" * 2100).alias("new_error"))
    return manifest.set_status(rows, changes, NOW).select("doc_uid", "status", "error")


@query(f"SELECT doc_uid, CASE WHEN status = 'indexing' THEN 'indexed' ELSE status END AS status, CASE WHEN status = 'indexing' THEN 7 ELSE chunk_count END AS chunk_count, CASE WHEN status = 'indexing' THEN '{NOW}' ELSE indexed_at END AS indexed_at FROM {_MAN}")
def man09_mark_indexed(spark, sf_dir):
    rows = fx.fixture(spark, sf_dir, "manifest")
    counts = rows.where("status = 'indexing'").select("doc_uid", *[F.lit(7).alias(c) for c in manifest.COUNTS])
    return manifest.mark_indexed(rows, counts, NOW).select("doc_uid", "status", "chunk_count", "indexed_at")


@query(f"SELECT doc_uid, CASE WHEN status = 'indexing' THEN 'pending' ELSE status END AS status, status = 'indexing' AS was_stale FROM {_MAN}")
def man10_recover(spark, sf_dir):
    return manifest.recovered(fx.fixture(spark, sf_dir, "manifest"), NOW).select("doc_uid", "status", "was_stale")


_NEEDS = """CASE WHEN m.status IS NULL OR m.status <> 'indexed' THEN true WHEN m.parser_version <> '1.1.0' THEN true WHEN m.sha256 <> '' AND l.sha256 <> '' THEN m.sha256 <> l.sha256 ELSE m.size_bytes <> l.size_bytes OR m.mtime <> l.mtime END"""


@query(f"SELECT l.doc_uid, {_NEEDS} AS needs_ingest FROM {_LIST} l LEFT JOIN {_MAN} m ON l.doc_uid = m.doc_uid")
def man11_needs_ingest(spark, sf_dir):
    rows, files = _both(spark, sf_dir)
    return manifest.changed(files, rows).select("doc_uid", "needs_ingest")


@query(f"SELECT doc_uid, document_name, status FROM {_MAN} WHERE doc_uid NOT IN (SELECT doc_uid FROM {_LIST})")
def man12_prune(spark, sf_dir):
    return manifest.missing(*_both(spark, sf_dir)).select("doc_uid", "document_name", "status")


@query(f"""SELECT l.doc_uid, regexp_matches(l.document_name, '^doc_[^0-4].*7\\.pdf$') OR contains(l.document_name, 'doc_[!0-4]*7.pdf') OR coalesce(m.status = 'failed', false) OR m.status IS NULL OR m.parser_version <> '1.1.0' AS selected FROM {_LIST} l LEFT JOIN {_MAN} m ON l.doc_uid = m.doc_uid""")
def sel01_selector(spark, sf_dir):
    rows, files = _both(spark, sf_dir)
    chosen = manifest.Selector("DOC_[!0-4]*7.pdf", True, True)
    return manifest.changed(files, rows).select("doc_uid", chosen.matches(F.col("source_path"), F.col("known_status"), F.col("known_version")).alias("selected"))


@query(f"SELECT l.doc_uid, CASE WHEN {_NEEDS} THEN 'ingest' ELSE 'skip' END AS action FROM {_LIST} l LEFT JOIN {_MAN} m ON l.doc_uid = m.doc_uid WHERE contains(l.document_name, '3')")
def ing01_plan(spark, sf_dir):
    rows, files = _both(spark, sf_dir)
    return manifest.plan(files, rows, manifest.Selector("3")).select("doc_uid", "action")


@query(f"SELECT doc_uid, CASE WHEN error <> '' THEN 'failed' WHEN chunk_count = 0 AND figure_count = 0 THEN 'failed' ELSE 'indexed' END AS outcome FROM {_MAN}")
def ing02_outcome(spark, sf_dir):
    return fx.fixture(spark, sf_dir, "manifest").select("doc_uid", manifest.outcome(F.col("chunk_count"), F.col("figure_count"), F.col("error")).alias("outcome"))


@query(f"""WITH a AS (SELECT CASE WHEN {_NEEDS} THEN 'ingest' ELSE 'skip' END AS action, CASE WHEN {_NEEDS} THEN 'indexed' ELSE '' END AS status, coalesce(m.chunk_count, 0) AS c, coalesce(m.figure_count, 0) AS f, coalesce(m.table_count, 0) AS t FROM {_LIST} l LEFT JOIN {_MAN} m ON l.doc_uid = m.doc_uid)
SELECT count(*) AS scanned, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (action = 'skip') AS skipped, concat('indexed=', count(*) FILTER (status = 'indexed'), ' skipped=', count(*) FILTER (action = 'skip'), ' failed=0 removed=0 chunks=', sum(c), ' figures=', sum(f), ' tables=', sum(t)) AS summary FROM a""")
def ing06_report(spark, sf_dir):
    rows, files = _both(spark, sf_dir)
    counts = [F.col(c).alias(n) for c, n in (("chunk_count", "chunks"), ("figure_count", "figures"), ("table_count", "tables"))]
    acts = manifest.plan(files, rows).join(rows.select("doc_uid", *counts), "doc_uid", "left")
    acts = acts.select("action", F.when(F.col("action") == "ingest", "indexed").otherwise("").alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "figures", "tables")])
    return manifest.report(acts).select("scanned", "indexed", "skipped", "summary")


@query(f"""SELECT count(*) FILTER (status = 'indexed') AS documents, sum(chunk_count) FILTER (status = 'indexed')::BIGINT AS chunks, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'indexing') AS n_indexing, count(*) FILTER (status = 'failed') AS n_failed,
  (SELECT count(*) FROM documents) AS stored_chunks, (SELECT count(*) FROM benchmark) AS stored_figures, 'hashing:words:64' AS fingerprint FROM {_MAN}""")
def ing07_status(spark, sf_dir):
    rows = manifest.status(fx.fixture(spark, sf_dir, "manifest"), read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), embed.fingerprint("hashing", "words", 64))
    return rows.select("documents", "chunks", "n_pending", "n_indexing", "n_failed", "stored_chunks", "stored_figures", "fingerprint")


# Change feed -----------------------------------------------------------------------------------------------------------

_ACTS = f"""acts AS (SELECT event_id, us, p AS path, a AS action FROM (
  SELECT event_id, us, path AS p, CASE WHEN op IN ('created', 'modified') THEN 'upsert' ELSE 'remove' END AS a, is_dir FROM {fx.duck("events")} UNION ALL SELECT event_id, us, dest, 'upsert', is_dir FROM {fx.duck("events")} WHERE op = 'moved')
  WHERE NOT is_dir AND ends_with(lower(p), '.pdf'))"""


def _acts(spark, sf_dir):
    return watch.actions(fx.fixture(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros("us")))


@query(f"WITH {_ACTS} SELECT event_id, path, action, us FROM acts")
def str01_actions(spark, sf_dir):
    return _acts(spark, sf_dir).select("event_id", "path", "action", F.unix_micros("ts").alias("us"))


@query(f"WITH {_ACTS} SELECT path, arg_max(action, (us, event_id)) AS action, count(*) AS n_events FROM acts GROUP BY path")
def str02_last_event(spark, sf_dir):
    return watch.last_actions(_acts(spark, sf_dir), [])


@query(f"""WITH {_ACTS}, steps AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY path ORDER BY us) <= 4000000 THEN 0 ELSE 1 END AS new FROM acts),
islands AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY us, event_id) AS burst FROM steps)
SELECT path, min(us) AS started, max(us) + 4000000 AS due, arg_max(action, (us, event_id)) AS action, count(*) AS n_events FROM islands GROUP BY path, burst""")
def str03_debounce(spark, sf_dir):
    rows = watch.bursts(_acts(spark, sf_dir))
    return rows.select("path", F.unix_micros("started").alias("started"), F.unix_micros("due").alias("due"), "action", "n_events")


@query(f"""WITH looks AS (SELECT path, us, max(CASE WHEN event_id % 23 = 0 THEN NULL ELSE size // 100 END) AS size FROM {fx.duck("events")} GROUP BY path, us),
steps AS (SELECT *, CASE WHEN row_number() OVER p > 1 AND size IS NOT DISTINCT FROM lag(size) OVER p THEN 0 ELSE 1 END AS new FROM looks WINDOW p AS (PARTITION BY path ORDER BY us)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY us) AS run FROM steps),
since AS (SELECT *, min(us) OVER (PARTITION BY path, run) AS since FROM runs)
SELECT path, min(us) AS stable_at FROM since WHERE size IS NOT NULL AND us - since >= 2000000 GROUP BY path""")
def str04_stable(spark, sf_dir):
    e = fx.fixture(spark, sf_dir, "events")
    size = F.max(F.when(F.col("event_id") % 23 != 0, F.floor(F.col("size") / 100)))
    return watch.stable(e.groupBy("path", "us").agg(size.alias("size")))


@query(f"""WITH {_ACTS}, last AS (SELECT path, arg_max(action, (us, event_id)) AS action, max(us) AS us FROM acts GROUP BY path),
looks AS (SELECT path, us, max(CASE WHEN event_id % 23 = 0 THEN NULL ELSE size // 100 END) AS size FROM {fx.duck("events")} GROUP BY path, us),
steps AS (SELECT *, CASE WHEN row_number() OVER p > 1 AND size IS NOT DISTINCT FROM lag(size) OVER p THEN 0 ELSE 1 END AS new FROM looks WINDOW p AS (PARTITION BY path ORDER BY us)),
since AS (SELECT *, min(us) OVER (PARTITION BY path, run) AS since FROM (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY us) AS run FROM steps)),
steady AS (SELECT DISTINCT path FROM since WHERE size IS NOT NULL AND us - since >= 2000000)
SELECT path, action, CASE WHEN action = 'remove' THEN 0 ELSE 1 END AS step FROM last WHERE us + 4000000 <= (SELECT max(us) FROM acts) AND (action = 'remove' OR path IN (FROM steady))""")
def str05_drain(spark, sf_dir):
    """What is handed over at the time of the last event: due removals first, then due upserts of steady files."""
    acts = _acts(spark, sf_dir)
    e = fx.fixture(spark, sf_dir, "events")
    steady = watch.stable(e.groupBy("path", "us").agg(F.max(F.when(F.col("event_id") % 23 != 0, F.floor(F.col("size") / 100))).alias("size")))
    ended = watch.bursts(acts).groupBy("path").agg(F.max_by("action", "due").alias("action"), F.max("due").alias("due"))
    now = acts.agg(F.max("ts").alias("now"))
    due = ended.join(F.broadcast(now), F.col("due") <= F.col("now")).join(steady, "path", "left")
    return watch.steps(due.where("action = 'remove' or stable_at is not null")).select("path", "action", "step")


@query(f"""SELECT path, op FROM (SELECT coalesce(m.rel_path, l.rel_path) AS path, CASE WHEN m.rel_path IS NULL THEN 'created' WHEN l.rel_path IS NULL THEN 'deleted' WHEN m.size_bytes <> l.size_bytes OR m.mtime <> l.mtime THEN 'modified' END AS op
  FROM {_MAN} m FULL JOIN {_LIST} l ON m.rel_path = l.rel_path) WHERE op IS NOT NULL""")
def str00_differences(spark, sf_dir):
    before, after = (d.withColumnRenamed("rel_path", "path") for d in _both(spark, sf_dir))
    return feed.differences(before, after)

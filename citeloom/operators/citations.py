"""Citations of answers: found, checked against the hits by a range join, marked and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import citation_label, strip_u

# Fixed value: the form of a citation.
CITATION = r"\[\s*([^\[\],]+?\.pdf)\s*,\s*[Pp]ages?\s*(\d{1,5})\s*,\s*[Ll]ines?\s*(\d{1,6})\s*(?:[-‐-―]\s*(\d{1,6}))?\s*\]"
SLACK, SNIPPET, FALLBACK = 5, 700, 3


def parse(answers: DataFrame) -> DataFrame:
    """(answer_id, query_id, ord, raw, document_name, page, line_start, line_end) of answers (answer_id, query_id, text):
    each distinct citation once, where it comes first; a missing end is the start, a reversed range is turned round."""
    raw = answers.select("answer_id", "query_id", F.posexplode(F.regexp_extract_all("text", F.lit(CITATION), F.lit(0))).alias("pos", "raw"))
    part = lambda g: F.regexp_extract("raw", CITATION, g)
    a = part(3).cast("int")
    b = F.coalesce(F.nullif(part(4), F.lit("")).try_cast("int"), a)
    rows = raw.select("answer_id", "query_id", "pos", "raw", strip_u(part(1)).alias("document_name"), part(2).cast("int").alias("page"), F.least(a, b).alias("line_start"), F.greatest(a, b).alias("line_end"))
    first = F.row_number().over(Window.partitionBy("answer_id", F.lower("document_name"), "page", "line_start", "line_end").orderBy("pos"))
    rows = rows.withColumn("_n", first).where("_n = 1")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos"))).drop("_n", "pos")


def overlap(a0, a1, b0, b1, slack: int = SLACK):
    return (a0 <= b1 + slack) & (b0 <= a1 + slack)


def verify(cited: DataFrame, hits: DataFrame, slack: int = SLACK) -> DataFrame:
    """cited with verified, hit_ord and the columns of the hit that it was matched to.

    hits (query_id, hit_ord, document_name, page_number, line_start, line_end, text, ..) are candidates where the
    document is the same but for case; where a citation's document has none, those of the first document that equals it
    without .pdf. The first candidate of the page whose lines overlap verifies it; else the first of the page is its
    match, unverified; else it has none.
    """
    key = ["answer_id", "ord"]
    named = hits.withColumn("doc_key", F.lower("document_name"))
    docs = named.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("hit_ord", "doc_key"))).alias("_docs"))  # a question's hits are few
    stem = lambda c: F.regexp_replace(c, r"\.pdf$", "")
    asked = cited.withColumn("_doc", F.lower("document_name")).join(docs, "query_id", "left")
    alike = F.get(F.filter("_docs", lambda d: stem(d["doc_key"]) == stem(F.col("_doc"))), F.lit(0))["doc_key"]
    same = F.coalesce(F.exists("_docs", lambda d: d["doc_key"] == F.col("_doc")), F.lit(False))
    asked = asked.withColumn("doc_key", F.when(same, F.col("_doc")).otherwise(F.coalesce(alike, "_doc"))).drop("_docs")
    names = {"line_start": "h_start", "line_end": "h_end", "page_number": "page"}
    extra = [c for c in ("content_type", "image_path", "caption", "source_path", "doc_uid") if c in hits.columns]
    found = named.select("query_id", "doc_key", *[F.col(c).alias(n) for c, n in names.items()], "hit_ord", F.substring("text", 1, SNIPPET).alias("snippet"), *extra)
    pairs = asked.join(found, ["query_id", "doc_key", "page"], "left")
    pairs = pairs.withColumn("verified", F.coalesce(overlap(F.col("line_start"), F.col("line_end"), F.col("h_start"), F.col("h_end"), slack), F.lit(False)))
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("verified"), "hit_ord"))
    rows = pairs.withColumn("_n", best).where("_n = 1")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(*cited.columns, "verified", "hit_ord", blank("snippet"), *[blank(c) for c in extra])


def from_hits(hits: DataFrame) -> DataFrame:
    """Citations of hits themselves, all verified."""
    label = citation_label(F.col("document_name"), F.col("page_number"), F.col("line_start"), F.col("line_end"))
    return hits.select("query_id", "hit_ord", "document_name", F.col("page_number").alias("page"), "line_start", "line_end", label.alias("raw"), F.lit(True).alias("verified"), F.substring("text", 1, SNIPPET).alias("snippet"), *[c for c in ("doc_uid",) if c in hits.columns])


def annotate(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """(answer_id, text): each unverified citation followed by [unverified], once."""
    open_ = checked.where("not verified and raw <> ''").groupBy("answer_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "raw"))), lambda r: r["raw"]).alias("_raws"))
    rows = answers.join(open_, "answer_id", "left").withColumn("_raws", F.coalesce("_raws", F.array().cast("array<string>")))
    mark = lambda r: F.concat(r, F.lit(" [unverified]"))
    text = F.aggregate("_raws", F.col("text"), lambda t, r: F.when(F.contains(t, mark(r)), t).otherwise(F.replace(t, r, mark(r))))
    return rows.select("answer_id", text.alias("text"))


def coverage(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """(answer_id, n, n_verified, coverage): the verified share, 1 for an answer without citations."""
    counts = checked.groupBy("answer_id").agg(F.count("*").alias("n"), F.count_if("verified").alias("n_verified"))
    rows = answers.select("answer_id").join(counts, "answer_id", "left").fillna(0, ["n", "n_verified"])
    return rows.select("answer_id", "n", "n_verified", F.when(F.col("n") == 0, 1.0).otherwise(F.col("n_verified") / F.col("n")).alias("coverage"))


def warnings(counts: DataFrame) -> DataFrame:
    """coverage() with the warning that an answer gets, empty if none."""
    # The two warnings.
    none = F.lit("The model returned no citations; showing retrieved sources instead.")
    some = F.format_string("%d of %d citations could not be matched to retrieved context and are marked [unverified].", F.col("n") - F.col("n_verified"), F.col("n"))
    return counts.withColumn("warning", F.when(F.col("n") == 0, none).when(F.col("n_verified") < F.col("n"), some).otherwise(""))

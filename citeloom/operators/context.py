"""Prompt context under a budget of characters, prompts, and the answer without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import citation_label, collapse, strip_u

BUDGET, FALLBACK, SNIPPET = 4500, 5, 280


def _label() -> Column:
    return citation_label(F.col("document_name"), F.col("page_number"), F.col("line_start"), F.col("line_end"))


# The form of both kinds of entries.
def passage_entry(number: Column) -> Column:
    kind = F.when(F.col("content_type") == "table", "TABLE").otherwise("PASSAGE")
    return F.concat(F.lit("["), number, F.lit("] "), kind, F.lit("\nCITATION: "), _label(), F.lit("\nCONTENT:\n"), strip_u(F.col("text")), F.lit("\n"))


def figure_entry(number: Column) -> Column:
    caption = F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.col("text"))
    return F.concat(F.lit("["), number, F.lit("] FIGURE\nCITATION: "), _label(), F.lit("\nCAPTION: "), strip_u(caption), F.lit("\n"))


def pack_passages(hits: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The passages (query_id, hit_rank, ..) that fit, in rank order, with entry_no, entry and used; the first one
    always fits, and the first that doesn't ends the list."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("hit_rank"))
    rows = hits.withColumn("entry_no", number)
    rows = rows.withColumn("entry", passage_entry(F.col("entry_no").cast("string")))
    used = F.sum(F.length("entry")).over(Window.partitionBy("query_id").orderBy("entry_no"))
    return rows.withColumn("used", used).where((F.col("used") <= budget) | (F.col("entry_no") == 1))


def pack_figures(pictures: DataFrame, packed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The figures that fit in what the packed passages leave, numbered on from them; the first one is free only where
    no passage was packed."""
    spent = packed.groupBy("query_id").agg(F.max("used").alias("spent"), F.max("entry_no").alias("kept"))
    rows = pictures.join(spent, "query_id", "left").withColumn("spent", F.coalesce("spent", F.lit(0))).withColumn("kept", F.coalesce("kept", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("hit_rank")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("entry_no", F.col("kept") + F.col("nth"))
    rows = rows.withColumn("entry", figure_entry(F.col("entry_no").cast("string")))
    rows = rows.withColumn("used", F.col("spent") + F.sum(F.length("entry")).over(order))
    return rows.where((F.col("used") <= budget) | ((F.col("nth") == 1) & (F.col("kept") == 0))).drop("nth", "spent", "kept")


def prompts(questions: DataFrame, passages: DataFrame, pictures: DataFrame) -> DataFrame:
    """(query_id, context, prompt) of questions (query_id, text) with packed passages and figures."""
    both = passages.select("query_id", "entry_no", "entry").unionByName(pictures.select("query_id", "entry_no", "entry"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_no", "entry"))), lambda e: e["entry"]), "\n")
    rows = questions.join(both.groupBy("query_id").agg(joined.alias("context")), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    # Fixed value: the question's frame.
    text = F.concat(
        F.lit("CONTEXT PASSAGES\n================\n"), "context", F.lit("\n================\n\nQUESTION: "), "text",
        F.lit("\n\nAnswer using only the context above, citing every claim in the format [DocName.pdf, Page X, Line Y-Z]."),
    )
    return rows.select("query_id", "context", text.alias("prompt"))


def in_prompt(hits: DataFrame, packed: DataFrame, key: list[str]) -> DataFrame:
    """hits with whether they are among the packed ones, by the columns that name a hit."""
    shown = packed.select(*key).distinct().withColumn("_shown", F.lit(True))
    return hits.join(shown, key, "left").withColumn("in_prompt", F.coalesce("_shown", F.lit(False))).drop("_shown")


def retrieval_only(passages: DataFrame, reason: str | None = None) -> DataFrame:
    """(query_id, answer) from the best passages alone, for when no model answers; without a reason, that of each row's
    column reason."""
    rows = passages.where(F.col("hit_rank") <= FALLBACK)
    why = F.max("reason") if reason is None else F.lit(reason)
    snippet = F.substring(collapse(F.col("text")), 1, SNIPPET)
    entry = F.concat(F.col("hit_rank").cast("string"), F.lit(". "), _label(), F.lit("\n   "), snippet, F.lit("...\n"))
    # Fixed value: the notice above the passages.
    head = F.concat(
        F.lit("The local LLM is unavailable, so no synthesised answer was generated.\nReason: "), why,
        F.lit("\n\nStart it with `ollama serve`, then ask again. The most relevant passages retrieved for this question are:\n\n"),
    )
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hit_rank", entry.alias("entry")))), lambda e: e["entry"]), "\n")
    return rows.groupBy("query_id").agg(strip_u(F.concat(head, listed)).alias("answer"))

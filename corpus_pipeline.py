"""The training-data pipeline: five stages over documents, each written as Parquet and read again by the next.

Toxic documents go, one document of each class of near-duplicates stays, documents that hold a benchmark item go, the
sources are mixed to their target weights (a document comes as often as the mix takes its first word), and the rest is
written as token files, of which the last stage returns one row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import decontam, mixing, simhash, tokenfile, toxicity
from citeloom.llm.queries import tokenizer_path
from citeloom.llm.shared import new_path, scratch, table, written

#: SQL can't express the string kernel, the fingerprints or the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the model of the labelled documents scores 0.5 or more. Null and empty texts have the score
    of no words; rows are judged one by one, whatever their ids; an empty table gives no rows."""
    return toxicity.keep_civil(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each class of near copies, that of the smallest doc_id, null after all others. Texts without
    words, null ones too, are one class; unlike texts of one doc_id stay all; an empty table gives no rows."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item. Null and empty texts stay; rows are judged one by one, whatever their
    ids; an empty table gives no rows."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes their first word (not at all, once or twice), in the order of the slots that take it.
    Documents without words, null texts too, come first, once each.

    Each row is taken by itself, whether its doc_id is null, repeated or its own. An empty table gives no rows.
    """
    numbered = written(docs.withColumn("_no", F.monotonically_increasing_id()), "numbered")
    taken = mixing.mix(numbered, no_col="_no").where("size = 0 or size(starts) > 0")
    taken = taken.select(F.col("no").alias("_no"), F.explode(F.when(F.col("size") == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.col("starts"))).alias("_slot"))
    return numbered.join(taken, "_no").repartitionByRange("_slot", "_no").sortWithinPartitions("_slot", "_no").select(docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token files that docs are written to, a row per row of docs: null texts are
    the end id alone, null doc_ids come first, repeated ones are documents of their own. An empty table gives no rows."""
    path = new_path(spark, "tokens")
    tokenfile.write_tokens(docs, path, tokenizer_path())
    return tokenfile.read_documents(spark, path)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark, name):
            docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Token counts of flat token files that have no index: a scan for the end-of-document id.

A flat file is a run of blocks of a fixed number of ids; documents end wherever the separator stands and cross blocks
and files freely. Each block is searched as one vector. What a block leaves open (the ids after its last separator)
and how many documents ended before it are prefix sums over the blocks' summaries, so blocks are read in any order.
"""

from __future__ import annotations

import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.shared import in_python, spread, written
from citeloom.llm.tokenfile import Encoder

BLOCK_IDS = 1 << 19
FLAT_SCHEMA = "kind string, part int, block int, id_bytes int, ids binary, first long, docs array<bigint>"


def separator_of(id_bytes: int) -> int:
    """The end-of-document id of flat files: the largest integer of so many bytes, which no vocabulary holds, so a text
    that spells a special token ends no document."""
    return (1 << 8 * id_bytes) - 1


def write_flat(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of docs (doc_id, text), a separator after each document, as flat blocks under path/kind=tokens
    (part, block, id_bytes, ids), and the doc_ids in the same order under path/kind=names (part, first, docs).

    Documents are written where they are read, so texts are not shuffled; the order is that of parts and of the rows in
    them. All ids of a text are kept. Null and empty texts are the separator alone; repeated and null doc_ids are
    documents of their own. An empty table gives no blocks.
    """
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches):
        encoder = Encoder.of(tokenizer)
        width, end = encoder.id_bytes, array.array(encoder.kind, [separator_of(encoder.id_bytes)]).tobytes()
        part, block, held, size, nth = TaskContext.get().partitionId(), 0, [], 0, 0
        schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("first", pa.int64()), ("docs", pa.list_(pa.int64()))])

        def row(ids):
            nonlocal block
            block += 1
            return pa.RecordBatch.from_pylist([{"kind": "tokens", "part": part, "block": block - 1, "id_bytes": width, "ids": ids}], schema)

        for b in batches:
            names = b.column(0).to_pylist()
            if names:
                yield pa.RecordBatch.from_pylist([{"kind": "names", "part": part, "first": nth, "docs": names}], schema)
            nth += len(names)
            for ids in encoder.each(b.column(1)):
                held += (ids, end)
                size += len(ids) + width
                if size >= width * block_ids:
                    data = b"".join(held)
                    for i in range(0, size - width * block_ids + 1, width * block_ids):
                        yield row(data[i : i + width * block_ids])
                    held = [data[size - size % (width * block_ids) :]]
                    size = len(held[0])
        if size:
            yield row(b"".join(held))

    made = in_python(rows, run, FLAT_SCHEMA)
    made.write.partitionBy("kind").option("compression", "zstd").parquet(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The rows at path; a filter on kind reads one folder. Files of an empty table have none."""
    return spark.read.schema(FLAT_SCHEMA).parquet(path)


def _scan(files: DataFrame, separator: int | None) -> DataFrame:
    """A row per separator (None: separator_of), and for each block one with its summary (nth -1)."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(row["ids"], {2: "<u2", 4: "<u4"}[row["id_bytes"]])
                at = np.flatnonzero(ids == (separator_of(row["id_bytes"]) if separator is None else separator))
                length = np.diff(np.r_[-1, at])  # with the separator; the first one lacks what earlier blocks left open
                rest = len(ids) - 1 - (at[-1] if len(at) else -1)
                n = len(at) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["part"]), pa.int32()), pa.array(np.full(n, row["block"]), pa.int32()), pa.array(np.r_[-1, np.arange(len(at))], pa.int64()), pa.array(np.r_[rest, length], pa.int64()), pa.array(np.r_[len(at), at], pa.int64()), pa.array(np.full(n, len(ids)), pa.int64())],
                    ["part", "block", "nth", "length", "place", "n_ids"],
                )

    return in_python(files, run, "part int, block int, nth long, length long, place long, n_ids long")


def count_tokens(spark: SparkSession, path: str, separator: int | None = None) -> DataFrame:
    """(ordinal, start, n_tokens) per document of the flat files at path: its place from 0, the ids ahead of it, and
    its ids with the separator, which is that of write_flat unless one is given. Ids after the last separator are no
    document."""
    scan = written(_scan(_files(spark, path).where("kind = 'tokens'").select("part", "block", "id_bytes", "ids"), separator), "separators")
    blocks = scan.where("nth = -1").select("part", "block", F.col("length").alias("rest"), F.col("place").alias("n"), "n_ids")
    # A part's summary composes its blocks': documents, ids, and the ids after its last separator.
    inside = Window.partitionBy("part").orderBy("block")
    before, onward = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.when(F.col("n") > 0, F.sum("n_ids").over(onward) - F.col("rest"))  # where the part's latest separator so far ends
    steps = blocks.withColumn("end", ends).select(
        "part", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("ids"), F.max("end").over(before).alias("end")
    )
    parts = blocks.withColumn("end", ends).groupBy("part").agg(F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids"), F.max("end").alias("end"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ids0", F.coalesce(F.sum("n_ids").over(over), F.lit(0)))
    parts = parts.select("part", "ids0", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("docs0"), F.coalesce(F.max(F.col("end") + F.col("ids0")).over(over), F.lit(0)).alias("end0"))
    base = steps.join(parts, "part").select(
        "part", "block", (F.col("docs") + F.col("docs0")).alias("docs"), (F.col("ids") + F.col("ids0")).alias("ids"), F.coalesce(F.col("end") + F.col("ids0"), "end0").alias("end")
    )
    found = scan.where("nth >= 0").join(base, ["part", "block"])
    stop = F.col("ids") + F.col("place") + 1
    tokens = F.when(F.col("nth") == 0, stop - F.col("end")).otherwise(F.col("length"))
    return found.select((F.col("docs") + F.col("nth")).alias("ordinal"), (stop - tokens).alias("start"), tokens.alias("n_tokens"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, doc_id): the documents of the flat files at path in their order, numbered from 0 in two steps."""
    names = _files(spark, path).where("kind = 'names'")
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = names.groupBy("part").agg(F.sum(F.size("docs")).alias("n")).select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    each = names.select("part", "first", F.posexplode("docs").alias("nth", "doc_id"))
    return each.join(base, "part").select((F.col("base") + F.col("first") + F.col("nth")).alias("ordinal"), "doc_id")

"""Corpus listings: which files are documents, their records and their ids."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import doc_uid
from citeloom.sources.opened import digests, open_path


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def visible(path: Column) -> Column:
    """Neither hidden nor an editor's lock file."""
    return ~base_name(path).rlike(r"^([.]|~[$])")


def is_scanned(path: Column) -> Column:
    """What a scan takes: the suffix in lower case only."""
    return path.endswith(".pdf") & visible(path)


def is_watched(path: Column) -> Column:
    """What a watcher takes: the suffix in any case."""
    return F.lower(path).endswith(".pdf") & visible(path)


def path_order(path: Column) -> Column:
    """Orders paths by component, so a/b comes before a-b."""
    return F.split(path, "/")


def files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame | None:
    """(rel_path, path, length, modificationTime) of the PDF files under root, None where there is no root. Files are listed,
    not opened. rel_path is cut off by the root's length, so a root may hold any characters."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    whole = fs.makeQualified(hadoop).toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", recursive).load(_literal(root))
    other = whole.replace("file:/", "file:///", 1)  # the other spelling of a local path
    rel = F.when(F.startswith("path", F.lit(whole)), F.substring("path", len(whole) + 1, 2**30)).otherwise(F.substring("path", len(other) + 1, 2**30))
    return found.select(rel.alias("rel_path"), "path", "length", "modificationTime").where(visible(F.col("rel_path")))


def _literal(root: str) -> str:
    """root for Spark's readers, which take it for a glob pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", root)


def record(rel_path: Column, content: Column | None = None) -> list[Column]:
    """rel_path, document_name, doc_uid and sha256 of a file; without content the digest is empty."""
    digest = F.lit("") if content is None else F.sha2(content, 256)
    return [rel_path.alias("rel_path"), base_name(rel_path).alias("document_name"), doc_uid(rel_path).alias("doc_uid"), digest.alias("sha256")]


def counts_by_folder(paths: DataFrame) -> DataFrame:
    """(folder, n): how many of paths (path) a scan takes in each folder."""
    rows = paths.where(is_scanned(F.col("path")))
    return rows.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n"))


LISTED = "rel_path string, document_name string, doc_uid string, size_bytes long, mtime double, sha256 string, path string"


def discover(spark: SparkSession, root: str, recursive: bool = True, with_digest: bool = True, open_file: Callable[[str], BinaryIO] = open_path) -> DataFrame:
    """(rel_path, document_name, doc_uid, size_bytes, mtime, sha256, path) of the PDF files under root.

    A missing root gives no rows. Without with_digest no file is opened and sha256 is empty.
    """
    found = files(spark, root, recursive)
    if found is None:
        return spark.createDataFrame([], LISTED)
    mtime = (F.unix_micros("modificationTime") / 1e6).alias("mtime")
    rows = found.select(*record(F.col("rel_path"))[:3], F.col("length").alias("size_bytes"), mtime, F.lit("").alias("sha256"), "path")
    return digested(rows, open_file) if with_digest else rows


def digested(rows: DataFrame, open_file: Callable[[str], BinaryIO] = open_path) -> DataFrame:
    """Listed rows with the digests of their files, which are opened for it."""
    found = digests(rows.drop("sha256").withColumnRenamed("size_bytes", "length"), open_file)
    return found.withColumnRenamed("length", "size_bytes").select(rows.columns)

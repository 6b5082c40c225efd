"""The watch over a corpus: its changes as a stream, held back until a path is quiet, then applied to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import doc_uid
from citeloom.plans.ingest import Busy, Ingest
from citeloom.sources import listing
from citeloom.streaming import changes, watch


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, op) between two listings (path, size_bytes, mtime): created, modified or deleted."""
    b = before.select("path", F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"))
    both = b.join(after.select("path", "size_bytes", "mtime"), "path", "full_outer")
    op = (
        F.when(F.col("_size").isNull(), "created").when(F.col("size_bytes").isNull(), "deleted")
        .when((F.col("_size") != F.col("size_bytes")) | (F.col("_mtime") != F.col("mtime")), "modified")
    )
    return both.select("path", op.alias("op")).where("op is not null")


def look(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    files = listing.discover(spark, root, recursive, with_digest=False)
    return files.select(F.col("rel_path").alias("path"), "size_bytes", "mtime")


def follow(ingest: Ingest, every: str = "1 second", initial_sync: bool = True):
    """Brings the store up to date and keeps it so: starts a query over the folder's changes, in which a path is due once it
    has been quiet; removals are applied first. It goes on from its checkpoint in the store's folder when it is started again,
    so nothing that happened meanwhile is lost. Stop it with stop()."""
    s, spark, store = ingest.settings, ingest.spark, ingest.store
    log = f"{s.state_dir}/watch"
    changes.Log(log, s.pdf_dir, s.ingest_recursive).latest()  # before the sync, so that no change falls between
    if initial_sync:
        ingest.sync()

    def remove(paths: DataFrame) -> None:
        for (path,) in paths.orderBy("path").limit(100).collect():
            ingest.progress(f"removed: {path}")
        ingest.remove(paths.select(doc_uid(F.col("path")).alias("doc_uid")))

    def upsert(paths: DataFrame) -> None:
        ingest.progress(f"ingest-start: {paths.count()} files")
        report = ingest.upsert(paths.withColumnRenamed("path", "rel_path"))
        ingest.progress(f"ingest-{'complete' if report.indexed else 'skipped'}: {report.summary()}")
        for name, problem in report.errors:
            ingest.progress(f"error: {name}: {problem}")

    acts = watch.actions(changes.stream(spark, s.pdf_dir, log, s.ingest_recursive), "size")
    due = watch.quiet(acts, max(s.debounce_seconds, s.stability_seconds))
    return watch.apply(due, f"{store.root}/watch/checkpoint", remove, upsert, every, Busy)

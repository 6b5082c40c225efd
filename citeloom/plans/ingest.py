"""Ingesting a corpus: scan, select, parse, chunk, embed, store and prune, as one batch of Spark jobs."""

from __future__ import annotations

import contextlib
import datetime
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.text import image_name, row_id
from citeloom.operators import chunking, embed, figures, layout, tables
from citeloom.plans import manifest
from citeloom.plans.settings import Settings
from citeloom.plans.store import Store, orphans
from citeloom.sources import listing, spans
from citeloom.sources.opened import open_path

PAGE = ["rel_path", "page_number"]
ERRORS = 100
AFTER = 1_000_000  # images are numbered after a page's regions
BATCH_BYTES = 64 << 30  # of files that one commit takes, about


class Busy(RuntimeError):
    """Another process writes to the same knowledge base."""


@contextlib.contextmanager
def ingest_lock(path: str, blocking: bool = False) -> Iterator[None]:
    """An exclusive lock of the driver's host on path, which holds the owner's process id."""
    import fcntl

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a+") as handle:
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | (0 if blocking else fcntl.LOCK_NB))
        except BlockingIOError:
            handle.seek(0)
            raise Busy(f"process {handle.read().strip() or '?'} is ingesting") from None
        handle.truncate(0)
        handle.write(str(os.getpid()))
        handle.flush()
        try:
            yield
        finally:
            fcntl.flock(handle, fcntl.LOCK_UN)


@dataclass
class Report:
    scanned: int = 0
    indexed: int = 0
    skipped: int = 0
    failed: int = 0
    removed: int = 0
    recovered: int = 0
    chunks: int = 0
    figures: int = 0
    tables: int = 0
    images_removed: int = 0
    seconds: float = 0.0
    errors: list[tuple[str, str]] = field(default_factory=list)  # ERRORS at most; failed counts all
    warnings: list[tuple[str, str]] = field(default_factory=list)  # of pages that can't be read, ERRORS at most
    planned: list[str] = field(default_factory=list)

    def summary(self) -> str:
        if self.planned:
            return f"would re-ingest {len(self.planned)} document(s), skip {self.skipped}"
        return manifest.SUMMARY % tuple(getattr(self, n) for n in manifest.SUMMED) + f" in {self.seconds:.1f}s"


def utc_now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S+00:00")


class Ingest:
    """The writer of one knowledge base. extractor turns a file's bytes into span rows, table_extractor those of flagged pages
    into cells (see sources.spans); open_file opens a file by its path in a task. A run takes files in batches of about
    batch_bytes, each of which is committed by itself, so a run that ends early has lost one batch and the next one goes on."""

    def __init__(
        self, spark: SparkSession, settings: Settings, extractor: Callable, now: Callable[[], str] = utc_now, progress: Callable[[str], None] = lambda line: None,
        table_extractor: Callable | None = None, open_file: Callable = open_path, batch_bytes: int = BATCH_BYTES,
    ):
        self.spark, self.settings, self.extractor, self.now, self.progress = spark, settings, extractor, now, progress
        self.table_extractor, self.open_file, self.batch_bytes = table_extractor, open_file, batch_bytes
        name = embed.fingerprint(settings.embedding_backend, settings.embedding_model, settings.embedding_dim)
        self.store = Store(spark, settings.store_dir, name)

    def _lock(self):
        return ingest_lock(f"{self.settings.state_dir}/ingest.lock")

    def plan(self, selector: manifest.Selector = manifest.Selector(), force: bool = False, only: DataFrame | None = None, verify: bool = False) -> DataFrame:  # noqa: B008
        """The files of the corpus, or those of only (rel_path), with their action. A file is opened only if its size is that
        of the manifest and its time isn't, or for verify, whatever its time."""
        files = listing.discover(self.spark, self.settings.pdf_dir, self.settings.ingest_recursive, with_digest=False)
        files = files if only is None else files.join(only.select("rel_path").distinct(), "rel_path", "left_semi").select(files.columns)
        files = files.withColumn("source_path", F.concat(F.lit(self.settings.pdf_dir.rstrip("/") + "/"), "rel_path"))
        known = self.store.read("manifest")
        if not force:
            rows = manifest.looked_up(files, known, selector, verify=verify)
            opened = listing.digested(rows.where("doubtful"), self.open_file)
            files = opened.unionByName(rows.where("not doubtful").withColumn("sha256", F.col("known"))).select(files.columns)
        return manifest.plan(files, known, selector, force)

    def sync(self, selector: manifest.Selector = manifest.Selector(), force: bool = False, prune: bool = True, dry_run: bool = False, verify: bool = False) -> Report:  # noqa: B008
        """Brings the store up to date with the corpus; a narrowed run never prunes, a dry run writes nothing. verify
        compares the contents of all files, not only of those whose time has changed."""
        if dry_run:
            report = Report()
            rows = self.plan(selector, force, verify=verify).orderBy(listing.path_order(F.col("rel_path"))).select("document_name", "action").collect()
            report.scanned, report.planned = len(rows), [r[0] for r in rows if r[1] == "ingest"]
            report.skipped = report.scanned - len(report.planned)
            return report
        with self._lock(), self._workplace():
            began = time.monotonic()
            report = self._sync(selector, force, prune and not selector.is_narrowed, verify)
            report.seconds = time.monotonic() - began
        self.progress(report.summary())
        return report

    @contextlib.contextmanager
    def _workplace(self) -> Iterator[None]:
        """A folder for this run's tables, removed at its end."""
        self._work = f"work/{uuid.uuid4().hex}"
        try:
            yield
        finally:
            self.store.remove_path(self._work)

    def _sync(self, selector, force, prune, verify) -> Report:
        report, now = Report(), self.now()
        self.store.check_backend()
        known = manifest.recovered(self.store.read("manifest"), now)
        report.recovered = known.where("was_stale").count()
        if report.recovered:
            self.progress(f"recovered {report.recovered} interrupted documents")
            stale = known.where("was_stale")
            self.store.write(self.store.touched(stale), manifest=known)
        self._take(self.plan(selector, force, verify=verify), report, now)
        if prune:
            files = listing.discover(self.spark, self.settings.pdf_dir, self.settings.ingest_recursive, with_digest=False)
            gone = self._snapshot(manifest.missing(self.store.read("manifest"), files).select("doc_uid"), "gone")
            report.removed = gone.count()
            if report.removed:
                report.images_removed += self._delete(gone)
        return report

    def _delete(self, uids: DataFrame) -> int:
        """Takes documents out of all collections; gives how many images went."""
        before = self.store.read("figures")
        self.store.delete_documents(uids)
        return orphans(before, self.store.read("figures"), self.settings.images_dir).count()

    def remove(self, uids: DataFrame) -> int:
        """Takes documents (doc_uid) out of all collections, the manifest and their images; gives how many images went."""
        with self._lock():
            return self._delete(uids)

    def upsert(self, paths: DataFrame) -> Report:
        """Ingests those of the files paths (rel_path) that are new or changed; nothing is pruned."""
        with self._lock(), self._workplace():
            report, now = Report(), self.now()
            self._take(self.plan(only=paths), report, now)
        return report

    def _take(self, plan: DataFrame, report: Report, now: str) -> None:
        """Ingests the files of a plan batch by batch. A file's batch follows from its path, so that batches weigh alike."""
        seen = Observation()
        todo, size = F.col("action") == "ingest", F.coalesce("size_bytes", F.lit(0))
        acts = self._snapshot(plan.observe(seen, F.count("*").alias("n"), F.count_if(todo).alias("todo"), F.sum(F.when(todo, size)).alias("bytes")), "plan")
        n = seen.get
        report.scanned, report.skipped = n["n"], n["n"] - n["todo"]
        if not n["todo"]:
            return
        self.store.sized(n["bytes"] or 0)
        batches = min(n["todo"], max(1, -(-(n["bytes"] or 0) // self.batch_bytes)))
        batch = F.pmod(F.xxhash64("rel_path"), F.lit(batches))
        for i in range(batches):
            own = acts.where(todo & (batch == i))
            if batches == 1 or not own.isEmpty():
                self._ingest(own, report, now)

    def export_images(self, uids: DataFrame | None = None) -> DataFrame:
        """(image_path, data): the images of the store, or of some documents, under the paths that citations name."""
        rows = self.store.read("images")
        return (rows if uids is None else rows.join(uids, "doc_uid", "left_semi")).select("image_path", "data")

    def rebuild(self) -> Report:
        """Empties the store, takes this backend's name for it, and ingests everything."""
        with self._lock():
            self.store.reset()
        return self.sync(force=True)

    def reset(self) -> None:
        with self._lock():
            self.store.reset()

    def _snapshot(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{self.store.root}/{self._work}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _ingest(self, todo: DataFrame, report: Report, now: str) -> None:
        s = self.settings
        own = lambda: self.store.read("manifest", buckets).join(todo.select("doc_uid"), "doc_uid", "left_semi")
        buckets = self.store.touched(todo)
        pending = manifest.upsert_pending(self.store.read("manifest", buckets), todo, now)
        marks = todo.select("doc_uid", F.lit("indexing").alias("new_status"), F.lit("").alias("new_error"))
        self.store.write(buckets, manifest=manifest.set_status(pending, marks, now))
        files = todo.select("rel_path", "path", F.col("size_bytes").alias("length"))
        found = self._snapshot(spans.extract(files, self.extractor, self.open_file), "spans")
        if self.table_extractor:
            cells = self._snapshot(spans.extract_tables(found, files, self.table_extractor, self.open_file), "cells")
            found = found.where("kind is null or kind <> 'cell'").unionByName(cells)
        chunks, pictures, images = self._parsed(found, todo)
        loader = embed.embedder(s.embedding_backend, s.embedding_model, s.embedding_dim)
        chunks = self._snapshot(embed.embed(chunks, loader), "chunks")
        pictures = self._snapshot(embed.embed(pictures, loader), "figures")
        broken = found.where("error is not null and page_number is null").groupBy("rel_path").agg(F.min("error").alias("failure"))
        n = lambda d, c: d.groupBy("doc_uid").agg(F.count("*").alias(c))
        pages = found.where("error is null and page_number is not null").groupBy("rel_path").agg(F.countDistinct("page_number").alias("page_count"))
        rows = todo.select("doc_uid", "rel_path", "document_name").join(broken, "rel_path", "left").join(pages, "rel_path", "left")
        counts = ["page_count", "chunk_count", "figure_count", "table_count"]
        extracted = n(chunks.where("content_type = 'table'"), "table_count")
        for more in (n(chunks, "chunk_count"), n(pictures, "figure_count"), extracted):
            rows = rows.join(more, "doc_uid", "left")
        rows = rows.fillna(0, counts).withColumn("status", manifest.outcome(F.col("chunk_count"), F.col("figure_count"), F.col("failure")))
        rows = self._snapshot(rows.withColumn("failure", F.when(F.col("status") == "failed", F.coalesce("failure", F.lit("no extractable text")))), "outcome")
        good = rows.where("status = 'indexed'")
        of_good = lambda d: d.join(good.select("doc_uid"), "doc_uid", "left_semi")
        before = self.store.read("figures").join(good.select("doc_uid"), "doc_uid", "left_semi")
        digests = found.where("kind = 'file'").select("rel_path", F.col("text").alias("sha256")).join(todo.select("rel_path", "doc_uid"), "rel_path")
        done = manifest.with_digests(manifest.mark_indexed(own(), good, now), digests)
        bad = rows.where("status = 'failed'").select("doc_uid", F.col("status").alias("new_status"), F.col("failure").alias("new_error"))
        self.store.replace_documents(of_good(chunks), of_good(pictures), of_good(images), manifest=manifest.set_status(done, bad, now))
        report.images_removed += orphans(before, self.store.read("figures"), s.images_dir).count()
        total = rows.groupBy("status").agg(F.count("*").alias("n"), *[F.sum(f"{c}_count").alias(c) for c in ("chunk", "figure", "table")]).collect()
        by = {r["status"]: r for r in total}
        if "indexed" in by:
            for name, c in (("indexed", "n"), ("chunks", "chunk"), ("figures", "figure"), ("tables", "table")):
                setattr(report, name, getattr(report, name) + by["indexed"][c])
        some = lambda d, n: [tuple(r) for r in d.orderBy(listing.path_order(F.col("rel_path"))).limit(n).select("document_name", "failure").collect()] if n > 0 else []
        if "failed" in by:
            report.failed += by["failed"]["n"]
            report.errors += some(rows.where("status = 'failed'"), ERRORS - len(report.errors))
        unread = found.where("error is not null and page_number is not null").withColumn("failure", F.format_string("page %d unreadable: %s", "page_number", "error"))
        report.warnings += some(unread.join(todo.select("rel_path", "document_name"), "rel_path"), ERRORS - len(report.warnings))

    def _parsed(self, found: DataFrame, todo: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The chunks, figures and images of span rows, without embeddings."""
        s = self.settings
        size = found.where("error is null and page_number is not null").groupBy(*PAGE).agg(F.max("width").alias("width"), F.max("height").alias("height"))
        lines = spans.text_lines(found.where("error is null")).join(size, PAGE)
        lines = self._snapshot(layout.reading_order(lines.withColumn("tie", F.col("block") * 100_000 + F.col("line")), PAGE, "tie"), "lines")
        texts = F.transform(F.sort_array(F.collect_list(F.struct("line_number", "text"))), lambda x: x["text"])
        pages = lines.groupBy(*PAGE).agg(texts.alias("lines"))
        parts = chunking.chunk_pages(pages, s.chunk_target, s.chunk_overlap, s.chunk_least)
        names = todo.select("rel_path", "doc_uid", "document_name", "source_path")
        own = ["doc_uid", "page_number"]
        boxes = found.where("kind = 'table'").select(*PAGE, F.col("block").alias("rect_id"), "x0", "y0", "x1", "y1")
        near = layout.line_ranges(boxes, lines, PAGE).join(names, "rel_path").select(*own, F.col("rect_id").alias("ord"), "line_start", "line_end")
        n_lines = pages.join(names, "rel_path").select(*own, F.size("lines").alias("n_lines"))
        cells = spans.cell_tables(found).join(names, "rel_path").select(*own, "ord", "rows")
        drawn = tables.table_chunks(cells, near, n_lines, s.table_max_rows, s.table_max_chars).join(names, "doc_uid")
        shape = ["rel_path", "page_number", "ord", "line_start", "line_end", "doc_uid", "document_name", "source_path"]
        chunks = parts.join(names, "rel_path").select(*shape, F.col("chunk_text").alias("text"), F.lit(False).alias("is_table"))
        chunks = chunking.indexed(chunks.unionByName(drawn.select(*shape, "text", F.lit(True).alias("is_table")))).select(
            row_id(F.col("doc_uid"), F.col("page_number"), "c", F.col("chunk_index")).alias("row_id"), "doc_uid", "document_name", "source_path", "page_number", "line_start", "line_end",
            "chunk_index", F.when(F.col("is_table"), "table").otherwise("text").alias("content_type"), "text", F.lit("").alias("caption"), F.lit("").alias("image_path"),
        )
        blocks = lines.groupBy(*PAGE, "block", "width", "height").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("block_text"),
            F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        )
        caps = self._snapshot(figures.captions(blocks).withColumn("rect_id", F.col("block")), "captions")
        placed = figures.caption_columns(caps, layout.column_bounds(lines, PAGE), PAGE)
        found_areas = self._snapshot(figures.regions(placed, lines, spans.graphics(found), PAGE), "regions")
        areas = figures.accepted(found_areas, PAGE, s.figure_min_area, s.figure_max_per_page)
        kept = caps.join(areas.select(*PAGE, "rect_id"), [*PAGE, "rect_id"], "left_semi")
        kept = kept.select(*PAGE, "rect_id", "kind", "label", "caption", "x0", "y0", "x1", "y1", F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("binary").alias("data"))
        if s.extract_images:
            rasters = found.where("kind = 'image' and data is not null").join(names, "rel_path")
            rasters = rasters.select(*PAGE, F.struct("block", "line", "span").alias("image_id"), "document_name", "pixels", "x0", "y0", "x1", "y1", F.col("text").alias("suffix"), "data")
            taken = areas.join(caps.select(*PAGE, "rect_id", "label"), [*PAGE, "rect_id"])
            shown = figures.embedded_images(rasters, caps, taken, PAGE, s.image_min_pixels, s.figure_max_per_page, s.strict_captions)
            nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("image_id"))
            shown = shown.select(*PAGE, (nth + AFTER).alias("rect_id"), F.lit("image").alias("kind"), "label", "caption", "x0", "y0", "x1", "y1", "suffix", "data")
            kept = kept.unionByName(shown)
        ranges = layout.line_ranges(kept.select(*PAGE, "rect_id", "x0", "y0", "x1", "y1"), lines, PAGE)
        pictures = kept.join(ranges, [*PAGE, "rect_id"]).join(names, "rel_path").withColumn("ord", F.col("rect_id"))
        named = image_name(F.col("document_name"), F.col("doc_uid"), F.col("page_number"), F.col("figure_index"), F.coalesce("suffix", F.lit("png")))
        path = F.when(F.col("data").isNotNull(), F.concat(F.lit(s.images_dir.rstrip("/") + "/"), named)).otherwise("")
        pictures = figures.numbered(pictures).select(
            row_id(F.col("doc_uid"), F.col("page_number"), "f", F.col("figure_index")).alias("row_id"), "doc_uid", "document_name", "source_path", "page_number", "line_start", "line_end",
            "figure_index", "kind", "label", "caption", path.alias("image_path"), figures.figure_text(F.col("label"), F.col("caption")).alias("text"), "data",
        )
        pictures = self._snapshot(pictures, "pictures")
        return chunks, pictures.drop("data"), pictures.where("data is not null").select("row_id", "doc_uid", "image_path", "data")

"""Files opened by path: how many are opened, what a crash leaves, second extractors, and digests of large files."""

import hashlib
import os
import subprocess
import sys
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from citeloom.plans.ingest import Ingest
from citeloom.plans.settings import Settings
from citeloom.sources import listing, opened, spans
from citeloom.sources.spans import plain_text


def counting(folder):
    """Opens files, and leaves a file in a folder for each."""

    def open_file(path):
        Path(folder, f"{path.rsplit('/', 1)[1]}-{uuid.uuid4().hex}").touch()
        return opened.open_path(path)

    return open_file


@pytest.fixture()
def corpus(tmp_path):
    docs, log = tmp_path / "docs", tmp_path / "log"
    docs.mkdir()
    log.mkdir()
    for i in range(40):
        (docs / f"d {i}%.pdf").write_text(f"the text of document {i}\nand another line")
    settings = Settings(pdf_dir=str(docs), store_dir=str(tmp_path / "s"), state_dir=str(tmp_path / "t"), embedding_dim=4)

    def names():
        found = sorted(p.name.rsplit("-", 1)[0] for p in log.iterdir())
        for p in log.iterdir():
            p.unlink()
        return found

    return docs, log, settings, names


def test_only_what_changed_is_opened(spark, corpus):
    docs, log, settings, names = corpus
    ingest = Ingest(spark, settings, plain_text, open_file=counting(log))
    assert ingest.sync().indexed == 40 and len(names()) == 40
    digests = {r["rel_path"]: r["sha256"] for r in ingest.store.read("manifest").collect()}
    assert all(digests[p.name] == hashlib.sha256(p.read_bytes()).hexdigest() for p in docs.iterdir())
    (docs / "d 7%.pdf").write_text("a new text that is longer than the one before it was\n")
    report = ingest.sync()
    assert (report.scanned, report.skipped, report.indexed) == (40, 39, 1) and names() == ["d 7%.pdf"]
    (docs / "d 8%.pdf").write_text("a new text too, of another length than the one before")
    (docs / "d 9%.pdf").write_text("this one changes as well, but nobody asks for it here")
    report = ingest.upsert(spark.createDataFrame([("d 8%.pdf",), ("d 8%.pdf",)], "rel_path string"))
    assert (report.scanned, report.indexed) == (1, 1) and names() == ["d 8%.pdf"]
    os.utime(docs / "d 3%.pdf", (1, 1))  # another time, the same text
    assert ingest.sync().skipped == 39 and names() == ["d 3%.pdf", "d 9%.pdf"]
    stat = (docs / "d 5%.pdf").stat()
    (docs / "d 5%.pdf").write_text("THE text of document 5\nand another line")  # the same size and time
    os.utime(docs / "d 5%.pdf", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert ingest.sync().skipped == 40 and names() == ["d 3%.pdf"]
    assert ingest.sync(verify=True).indexed == 1 and len(names()) == 41


def test_a_run_that_ends_early_keeps_its_batches(spark, corpus):
    docs, log, settings, names = corpus
    ingest = Ingest(spark, settings, plain_text, open_file=counting(log), batch_bytes=400)
    whole, done = ingest._ingest, []

    def ingest_two(todo, report, now):
        if len(done) == 2:
            raise KeyboardInterrupt
        whole(todo, report, now)
        done.append(report.indexed)

    ingest._ingest = ingest_two
    with pytest.raises(KeyboardInterrupt):
        ingest.sync()
    kept = ingest.store.read("manifest").where("status = 'indexed'").count()
    assert 0 < kept == done[-1] < 40 and len(names()) == kept
    report = Ingest(spark, settings, plain_text, open_file=counting(log)).sync()
    assert report.skipped == kept and report.indexed == 40 - kept and len(names()) == 40 - kept
    assert ingest.store.read("chunks").select("doc_uid").distinct().count() == 40


def test_a_second_extractor_gets_flagged_pages(spark, tmp_path, corpus):
    docs, log, settings, names = corpus

    def extractor(path, content):
        yield from plain_text(path, content + b"\fa second page\fa third page")
        if path.startswith("d 1"):  # eleven files
            for page in (1, 3):
                yield {"page_number": page, "block": 0, "kind": "table", "x0": 50.0, "y0": 60.0, "x1": 560.0, "y1": 80.0}

    def tables(path, content, pages):
        Path(log, f"{path}:{pages}-{uuid.uuid4().hex}").touch()
        if path == "d 15%.pdf":
            raise ValueError("no tables here")
        for page in (1, 2, 3):
            for r in range(2):
                yield from ({"page_number": page, "block": 0, "line": r, "span": c, "text": f"cell {r} {c}"} for c in range(2))

    report = Ingest(spark, settings, extractor, table_extractor=tables).sync()
    assert names() == sorted(f"d {i}%.pdf:[1, 3]" for i in (1, *range(10, 20)))
    assert report.tables == 20 and report.warnings == [("d 15%.pdf", "page 1 unreadable: ValueError: no tables here")]


def test_files_are_dealt_by_size(spark):
    files = spark.createDataFrame([(f"p{i}", n) for i, n in enumerate([5, 900, 0, 7, 3000, 6, 700, 2900, 8, None])], "path string, length long")
    got = opened.dealt(files, 1000).select("length", F.spark_partition_id().alias("part")).collect()
    by_part = {}
    for r in got:
        by_part.setdefault(r["part"], []).append(r["length"] or 0)
    kinds = [{max(1, n).bit_length() for n in own} for _, own in sorted(by_part.items())]  # a task's files are within a factor of two
    assert all(len(k) == 1 for k in kinds) and [min(k) for k in kinds] == sorted((min(k) for k in kinds), reverse=True)
    assert max(by_part[min(by_part)]) >= 2900
    assert opened.dealt(files.limit(0)).count() == 0


def test_files_that_are_gone_have_no_digest(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("x")
    rows = spark.createDataFrame([(str(tmp_path / "a.pdf"), 1), (f"file:{tmp_path}/b.pdf", 1)], "path string, length long")
    assert [r["sha256"] for r in opened.digests(rows).orderBy("path").collect()] == sorted([hashlib.sha256(b"x").hexdigest(), ""], reverse=True)
    found = spans.extract(rows.withColumn("rel_path", F.col("path")), plain_text).where("error is not null").collect()
    assert len(found) == 1 and "FileNotFoundError" in found[0]["error"]


def test_a_large_file_is_read_in_blocks(tmp_path):
    path = tmp_path / "large.pdf"
    with open(path, "wb") as f:
        f.truncate(3 << 30)
    code = f"""import hashlib, resource, sys
sys.path.insert(0, {str(Path(opened.__file__).parents[2])!r})
from citeloom.sources.opened import digest_of
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(digest_of({str(path)!r}), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)"""
    digest, grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    want, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(3 << 10):
        want.update(block)
    assert digest == want.hexdigest() and int(grown) < 100_000


def test_listing_of_a_large_file(spark, tmp_path):
    with open(tmp_path / "large.pdf", "wb") as f:
        f.truncate((2 << 30) + 5)
    row = listing.discover(spark, str(tmp_path)).first()
    assert row["size_bytes"] == (2 << 30) + 5 and len(row["sha256"]) == 64

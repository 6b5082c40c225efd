"""Files opened by path: rows name files, and tasks open those that they are given, so nothing else of a corpus is read.

Files are dealt to tasks by their sizes, the largest first, and no content is ever a row's value: a digest is taken in
blocks of BLOCK bytes, whatever the file's size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.workers import with_python_path

BLOCK = 1 << 20
TASK_BYTES = 256 << 20  # bytes of files that a task is given, one larger file alone


def open_path(path: str) -> BinaryIO:
    """A file to read from: one of this machine, or of a file system that pyarrow knows (hdfs, s3, gs and others)."""
    named = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(.*)", path, re.DOTALL)
    if not named or named[1] == "file":
        return open("/" + named[2].lstrip("/") if named else path, "rb", buffering=0)
    from pyarrow import fs

    host, _, key = named[2].lstrip("/").partition("/")
    system, base = fs.FileSystem.from_uri(f"{'s3' if named[1].startswith('s3') else named[1]}://{host}/")
    return system.open_input_stream(f"{base.rstrip('/')}/{key}")


def digest_of(path: str, open_file: Callable[[str], BinaryIO] = open_path, block: int = BLOCK) -> str:
    """The SHA-256 of a file in hex, read a block at a time."""
    found = hashlib.sha256()
    with open_file(path) as file:
        while part := file.read(block):
            found.update(part)
    return found.hexdigest()


def dealt(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """files (path, length, ..) in partitions of some task_bytes each, the first ones of the largest files. Files are dealt
    within classes of sizes that differ by less than a factor of two, so a class's partitions weigh alike; the driver gets
    a row for each class."""
    size = F.greatest(F.coalesce("length", F.lit(0)), F.lit(1))
    kind = F.floor(F.log2(size)).cast("int")
    known = sorted(files.groupBy(kind.alias("kind")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).collect(), reverse=True)
    first, entries = 0, []
    for k, total, n in known:
        parts = min(n, -(-total // task_bytes))
        entries += [F.lit(k), F.struct(F.lit(first).alias("first"), F.lit(parts).alias("parts"))]
        first += parts
    if not known:
        return files
    at = F.create_map(*entries)[kind]
    return files.repartitionById(first, F.coalesce((at["first"] + F.pmod(F.xxhash64("path"), at["parts"])).cast("int"), F.lit(0)))


def digests(files: DataFrame, open_file: Callable[[str], BinaryIO] = open_path) -> DataFrame:
    """files (path, length, ..) with their sha256, empty for a file that can't be read (any more)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    place = files.columns.index("path")

    def run(batches):
        for b in batches:
            found = []
            for path in b.column(place).to_pylist():
                try:
                    found.append(digest_of(path, open_file))
                except OSError:
                    found.append("")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "sha256"])

    with_python_path(files.sparkSession)
    return dealt(files).mapInArrow(run, f"{fields}, sha256 string")

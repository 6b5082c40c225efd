"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


_held: tuple | None = None


def held(kind: str, key, make):
    """What make() gives for kind and key, kept in this worker process for its next tasks. Only the latest is kept, so
    that one operator's memo doesn't stay in memory while another works."""
    global _held
    if _held is None or _held[:2] != (kind, key):
        _held = None
        _held = (kind, key, make())
    return _held[2]


def release() -> None:
    """Drops what held() keeps, in tasks of operators that keep nothing, and hands free memory back to the machine."""
    global _held
    _held = None
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def parts(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """batches in slices of so many rows at most, so that what is made of whole texts stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new one of this machine for
    a local master; on a cluster that is an error, as each executor would write to a disk of its own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-citeloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


_made: list[str] = []  # folders that this session wrote
_within: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("within", default=())  # of this thread's scratch() blocks


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/citeloom-{what}-{uuid.uuid4().hex}"
    for made in (_made, *_within.get()):
        made.append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, keep: int = 0) -> None:
    """Removes the folders that this session wrote, but for the `keep` latest; what was read from them can't be read again."""
    _remove(spark, _made[: len(_made) - keep])


@contextlib.contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Removes the folders that this thread writes within, at its end or on an error, but for those named in keep (on an
    error these too)."""
    made: list[str] = []
    before = _within.set((*_within.get(), made))
    kept: tuple[str, ...] = ()
    try:
        yield
        kept = keep
    finally:
        _within.reset(before)
        _remove(spark, [p for p in made if p.rsplit("/citeloom-", 1)[1].rsplit("-", 1)[0] not in kept])


def _remove(spark: SparkSession, gone: list[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    _made[:] = [p for p in _made if p not in gone]
    for path in map(hadoop, gone):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_python_path(spark: SparkSession) -> None:
    """Lets Python workers import this package when only the driver's sys.path names it."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


def in_python(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with the package importable in the workers."""
    with_python_path(df.sparkSession)
    return df.mapInArrow(function, schema)


def spread(df: DataFrame) -> DataFrame:
    """Deals rows to all cores where the scan has fewer partitions than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def drawn(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """Of each group of rows the `most` first ones by order and then by a digest of the whole row; equal rows count once,
    so that no more are kept however often an id or a text repeats. Digests alone are ranked, each task cutting its own
    to `most` a group first; groups times most bounds what is broadcast."""
    digest = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns))
    keyed = rows.withColumn("_digest", digest)
    keys = keyed.select(group, *order, "_digest").distinct()
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order, "_digest"))
    first = keys.withColumn("_nth", nth).where(F.col("_nth") <= most).select(F.col(group).alias("_group"), F.col("_digest").alias("_wanted"))
    chosen = keyed.join(F.broadcast(first), (F.col("_digest") == F.col("_wanted")) & F.col(group).eqNullSafe(F.col("_group")), "left_semi")
    return chosen.dropDuplicates(["_digest", group]).drop("_digest")


def sampled(docs: DataFrame, ids: DataFrame, on: list[str], group: str, most: int) -> DataFrame:
    """Of each group the `most` rows of docs at most whose doc_ids have the smallest hashes (h), of the rows that ids name by
    the columns `on`. ids are as many as groups times most. docs are read once: the rows found are written, and cut then."""
    found = docs.join(F.broadcast(ids), on).withColumn("h", F.xxhash64("doc_id"))
    return drawn(written(found, "sampled"), group, ["h"], most)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

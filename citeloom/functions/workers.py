"""What Python workers need to find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def with_python_path(spark: SparkSession) -> None:
    """Lets Python workers import this package when only the driver's sys.path names it."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; where it is unset, in one of this
    machine for a local master, and an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-citeloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", known)
    return f"{known.rstrip('/')}/citeloom-{what}-{uuid.uuid4().hex}"

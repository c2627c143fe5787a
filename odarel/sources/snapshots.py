"""Written states of a result, for change feeds: what a later request is compared with."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from odarel.errors import ODataError


def _root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder serves a local master only."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="odarel-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def save(df: DataFrame) -> str:
    """Write ``df`` and give the name to find it by."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{_root(df.sparkSession)}/odarel/feed-{name}")
    return name


def load(spark: SparkSession, name: str, like: DataFrame) -> DataFrame:
    """The rows saved under ``name``; gone (410) if they have been cleared away."""
    if not re.fullmatch("[0-9a-f]{32}", name):
        raise ODataError("no such state", 410)
    path = f"{_root(spark)}/odarel/feed-{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise ODataError("the state that the token refers to is gone", 410)
    return spark.read.schema(like.schema).parquet(path)

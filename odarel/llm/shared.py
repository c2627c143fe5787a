"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str, str | None]] = []
_owner: ContextVar[str | None] = ContextVar("owner", default=None)  # each thread has its own


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local master; on a cluster
    that is an error, since executors would not see the driver's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="odarel-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared root, for what ``release`` may delete."""
    path = f"{shared_root(spark)}/odarel/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path, _owner.get()))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared root and read it back.

    Cuts the lineage like a checkpoint but computes the plan a single time, and
    later reads prune columns. A lost executor loses nothing that is written.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owned_by(name: str) -> Iterator[None]:
    """Mark the tables written inside, so that ``release`` can find them."""
    before = _owner.set(name)
    try:
        yield
    finally:
        _owner.reset(before)


def release(spark: SparkSession, owner: str | None = None) -> None:
    """Delete the intermediate tables written so far, or only those of ``owner``.

    Frames built on them can't be read any more.
    """
    for entry in [x for x in _written if x[0] is spark and owner in (None, x[2])]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry[1])
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _written.remove(entry)

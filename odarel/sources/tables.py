"""Loaders of entity-set tables: Parquet, rows in memory, JDBC."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

Loader = Callable[[SparkSession], DataFrame]


def parquet(path: str) -> Loader:
    """Predicates and columns reach the scan through Catalyst."""
    return lambda spark: spark.read.parquet(path)


def memory(rows: Iterable, schema: str) -> Loader:
    rows = list(rows)
    return lambda spark: spark.createDataFrame(rows, schema)


def jdbc(url: str, table: str, *, properties: Mapping[str, str] | None = None, split_on: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1) -> Loader:
    """A database table (PostgreSQL, MySQL, MariaDB, ...), read in ``parts`` ranges of a numeric column.

    Spark pushes filters, column choice, aggregates and limits down to the database.
    """

    def load(spark: SparkSession) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**dict(properties or {}))
        reader = reader.option("pushDownAggregate", "true").option("pushDownLimit", "true")
        if split_on and parts > 1:
            reader = reader.option("partitionColumn", split_on).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
        return reader.load()

    return load


def view(name: str) -> Loader:
    """A table or view of the session's catalog."""
    return lambda spark: spark.table(name)

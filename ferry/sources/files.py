"""The few file-system questions Spark's readers do not answer, asked through the
same Hadoop file system they use (so they work on any store Spark can reach)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _located(spark, path)
    return fs.exists(place)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the folders that match a glob; none is an empty list."""
    fs, place = _located(spark, pattern)
    return [s.getPath().toString() for s in (fs.globStatus(place) or []) if s.isDirectory()]


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table this library wrote."""
    fs, place = _located(spark, path)
    fs.delete(place, True)

"""Small files and folders in whatever storage Spark reads from."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def located(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path in it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = located(spark, path)
    return system.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    system, where = located(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    system, where = located(spark, path)
    return system.getContentSummary(where).getLength()


def delete(spark: SparkSession, path: str) -> None:
    system, where = located(spark, path)
    system.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file: readers see all of it or none. It is an error if the file is there already."""
    system, where = located(spark, path)
    aside = where.suffix(".part")
    out = system.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(where) or not system.rename(aside, where):
        raise FileExistsError(f"{path} was published by another writer")

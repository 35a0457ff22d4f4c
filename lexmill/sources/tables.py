"""Reading and writing tables: parquet inputs, JSON records, CSV inventories, chunk stores."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html import decode_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def local_dir() -> str:
    return tempfile.mkdtemp(prefix="lexmill-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, as spark.checkpoint.dir names it. Where none is set, a local
    session gets a temporary one; on a cluster that is an error, as executors could not see it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = local_dir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: computed once, whatever is lost later."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_pages(manifest: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Manifest rows with their page; a missing page is flagged, not dropped."""
    found = pages.withColumn("_there", F.lit(True))
    return manifest.join(found, key, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def page_files(spark: SparkSession, root: str, pattern: str = "*", stream: bool = False) -> DataFrame:
    """Saved pages as files below a folder: path, name (without folders and ending), n_bytes, saved (when), raw, and a
    column for each ``column=value`` folder on the way. As a stream, files come once, as they arrive."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("pathGlobFilter", pattern)
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    files = reader.load(root)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    others = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select("path", name.alias("name"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("saved"), F.col("content").alias("raw"), *others)


def read_page_files(manifest: DataFrame, files: DataFrame, key: str, others: Sequence[str] = ("gb18030",)) -> DataFrame:
    """Manifest rows with what their file holds: path, n_bytes, text, encoding and ``missing``.

    ``key`` is a column of both: the name of a file, or a folder's value, in which case only the folders of the manifest
    are read. A row without a file is flagged, not dropped; files that no row names are not read; of several files of one
    key the first by path counts. Bytes that no encoding fits come as ``lossy`` text;
    an empty file is as good as none, as Spark does not read it.
    """
    first = files.groupBy(key).agg(F.min("path").alias("path")).select("path")
    found = decode_pages(files.join(first, "path", "left_semi").select(key, "path", "n_bytes", "raw"), "raw", others).drop("raw")
    return manifest.join(found, key, "left").withColumn("missing", F.col("path").isNull())


def read_json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv_inventory(spark: SparkSession, path: str, mapping: Mapping[str, str]) -> DataFrame:
    """A CSV with header, columns renamed by ``mapping``; a byte order mark before the first name is dropped."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    for name in rows.columns:
        rows = rows.withColumnRenamed(name, mapping.get(name.lstrip("﻿"), name.lstrip("﻿")))
    return rows


def write_chunks(df: DataFrame, path: str) -> None:
    """One folder for each source; a second write replaces only the sources it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def write_inventory(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def explode_pages(df: DataFrame, page: str, lines: str, first_page: int, last_page: int | None = None) -> DataFrame:
    """(page, line_pos, line) of the pages from first to last."""
    rows = df.where(F.col(page) >= first_page)
    if last_page is not None:
        rows = rows.where(F.col(page) <= last_page)
    return rows.select("*", F.posexplode(lines).alias("line_pos", "line")).drop(lines)

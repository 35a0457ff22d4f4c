"""What the operators share: reading tables, cutting lineage, range bounds."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def local_dir() -> str:
    return tempfile.mkdtemp(prefix="lexmill-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set, a local session gets a temporary
    one; on a cluster that is an error, as executors could not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = local_dir()
    return named.rstrip("/")


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    files: at most so many, where the rows are slim and their number is known: not one for each shuffle partition. On a
    local folder each file costs about six child processes (Hadoop calls chmod and the like).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill-{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever storage Spark reads it from."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending bounds that cut the column's values into ranges of nearly equal counts."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, at, 10 * parts).alias("b")).first()["b"]
    return sorted(set(found or []))


def range_of(value: Column, bounds: list[int]) -> Column:
    """Index of the range that holds the value, by binary search over the bounds; null counts as the smallest value."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > bounds[mid], search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(bounds))

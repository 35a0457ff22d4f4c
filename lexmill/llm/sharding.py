"""Contiguous shards of nearly equal byte size, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import range_bounds, range_of, shuffle_partitions, written

#: More ranges than this make the range expression long; a range then holds more rows, and still only slim ones.
MAX_RANGES = 512


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", size: str = "size", tie: str = "tie") -> DataFrame:
    """Add ``shard`` and ``slot``: contiguous in ``key`` order, cut at equal byte targets.

    Rows are dealt into ranges of the key; each range's total gives, by a prefix sum over the small table of
    totals, the bytes and rows before it; a running sum inside the range places each row. A row belongs to the
    shard in which its middle byte lies, so two shards differ by at most one row's size around each cut.

    Only the given columns move, never texts. A null key sorts first. Rows with one key are ordered by ``tie``
    and are spread over sub-ranges by it, so that one key may hold any share of the rows. Rows equal in both get
    neighbouring slots in any order. An empty table gives no rows.
    """
    docs = written(docs, "sizes")  # slim rows: the texts are read once
    bounds = range_bounds(docs, key, min(MAX_RANGES, 4 * shuffle_partitions(docs.sparkSession)))
    spot = ["_range", "_part"]
    rows = docs.withColumn("_range", range_of(F.col(key), bounds)).withColumn("_part", F.shiftright(F.col(tie), 58))
    # A key between two equal bounds fills a range alone; within a range only that key may be split by tie.
    alone = range_heavy(rows, key)
    rows = rows.join(F.broadcast(alone), "_range", "left").withColumn("_part", F.when(F.col("_single"), F.col("_part")).otherwise(F.lit(0).cast("long"))).drop("_single")

    totals = rows.groupBy(*spot).agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy(*spot).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *spot,
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy(*spot).orderBy(F.col(key).asc_nulls_first(), tie).rowsBetween(Window.unboundedPreceding, 0)
    # at most 64 times MAX_RANGES rows of totals
    placed = (
        rows.withColumn("_sum", F.sum(size).over(inside))
        .withColumn("_n", F.row_number().over(inside))
        .join(F.broadcast(totals), spot)
        .withColumn("_twice", 2 * (F.col("_bytes_before") + F.col("_sum")) - F.col(size))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(_twice * {shards}) div greatest(2 * _all, 1)")).cast("int"))
        .withColumn("_index", F.col("_rows_before") + F.col("_n") - 1)
    )
    starts = placed.groupBy("shard").agg(F.min("_index").alias("_start"))
    return placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_index") - F.col("_start")).drop(*spot, "_sum", "_n", "_bytes_before", "_rows_before", "_all", "_twice", "_index", "_start")


def range_heavy(rows: DataFrame, key: str) -> DataFrame:
    """For each range, whether all its rows have one key."""
    return rows.groupBy("_range").agg((F.min(key).eqNullSafe(F.max(key)) & ((F.count(key) == F.count("*")) | (F.count(key) == 0))).alias("_single"))

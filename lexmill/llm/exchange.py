"""Looking up corpus-wide facts from batches of texts.

Texts are grouped into batches of a few MB. Each batch sends what it asks about (hashes, counts) to buckets by
hash, already aggregated within the batch, so that a key of any frequency sends one entry a batch; buckets answer
each batch; batch and answers meet again by batch number. In one plan, the shuffle of the texts is made once and
reused by every step that reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .runtime import shuffle_partitions, written

#: Stands for a null doc_id: such a document is never an earlier one.
NO_ID = np.iinfo(np.int64).max
#: Copies of one row that a batch holds at most, about, and bytes of text whose keys one bucket holds.
BATCH_ROWS = 20_000
BUCKET_BYTES = 8 << 20


def batched(docs: DataFrame, batch_bytes: int, **more: Column) -> tuple[DataFrame, int, int]:
    """Columns batch, doc_id, text and ``more``; the number of batches; and the number of buckets.

    Batches hold about ``batch_bytes`` of text, or one longer text. A row that is repeated so often that its copies would
    fill batches by themselves is spread over several; the spread is written down first, so that each later read finds
    the same batches.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.groupBy(F.xxhash64("doc_id", "text").alias("row")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    repeated = F.max(F.when(F.col("rows") > 1, F.col("bytes")))
    found = rows.agg(F.sum("bytes").alias("total"), repeated.alias("repeated"), F.max("rows").alias("rows")).first()
    total = found["total"] or 0
    count = max(1, -(-total // batch_bytes))
    parts = max(-(-(found["repeated"] or 0) // batch_bytes), -(-(found["rows"] or 0) // BATCH_ROWS))
    columns = [F.col("doc_id"), F.col("text"), *(c.alias(n) for n, c in more.items())]
    key = [F.col("doc_id"), F.col("text")]
    if parts > 1:
        docs = written(docs.select(*columns, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("_spread")), "spread")
        columns, key = [F.col(c) for c in ("doc_id", "text", *more)], [*key, F.col("_spread")]
        count = max(count, parts)
    return docs.select(F.pmod(F.xxhash64(*key), F.lit(count)).alias("batch"), *columns), count, bucket_count(docs, total)


def bucket_count(docs: DataFrame, total_bytes: int) -> int:
    """Buckets grow with the corpus, so that one holds the keys of about BUCKET_BYTES of text at any size."""
    return max(64, 4 * shuffle_partitions(docs.sparkSession), -(-total_bytes // BUCKET_BYTES))


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("text").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return A.utf8(column)


def deal(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit key; buckets are ranges of keys, so sorted keys stay together."""
    return (((keys >> A.U64(32)) * A.U64(buckets)) >> A.U64(32)).astype(np.int32)


def packed(batch: int, keys: np.ndarray, columns: dict[str, np.ndarray], buckets: int) -> pa.Table:
    """One row for each bucket: its sorted keys and what goes with them, as lists."""
    bucket = deal(keys, buckets)
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    sizes = np.diff(heads, append=len(keys))
    lists = {"keys": keys.view(np.int64), **columns}
    return pa.table(
        {"bucket": pa.array(bucket[heads]), "batch": pa.array(np.full(len(heads), batch, np.int64))}
        | {name: A.list_array(pa.array(values), sizes) for name, values in lists.items()}
    )


def short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys as their bucket and 32 bits more. A bucket holds a bounded number of keys, so few meet by chance."""
    return deal(keys, buckets).astype(A.U64) << A.U64(32) | keys & A.U64(0xFFFFFFFF)


def packed_short(batch: int, keys: np.ndarray, many: np.ndarray) -> pa.Table:
    """One row for each bucket with the 32 bits of its sorted short keys, and a mark for each."""
    bucket = (keys >> A.U64(32)).astype(np.int32)
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    sizes = np.diff(heads, append=len(keys))
    low = keys.astype(np.uint32).view(np.int32)
    rows = {"bucket": pa.array(bucket[heads]), "batch": pa.array(np.full(len(heads), batch, np.int64))}
    return pa.table(rows | {"keys": A.list_array(pa.array(low), sizes), "many": A.list_array(pa.array(many), sizes)})


def read_short(answers: pa.Table, mark: str) -> tuple[np.ndarray, np.ndarray]:
    """Short keys put together again from their rows' bucket, and their marks."""
    _, low, marks = unpacked(answers, ["keys", mark])
    sizes = answers.column("keys").combine_chunks().value_lengths().to_numpy() if answers.num_rows else np.zeros(0, np.int64)
    bucket = np.repeat(answers.column("bucket").to_numpy(), sizes).astype(A.U64)
    return bucket << A.U64(32) | low.astype(np.uint32).astype(A.U64), marks.astype(bool)


def unpacked(table: pa.Table, names: Iterable[str]) -> tuple[np.ndarray, ...]:
    """The batch of each entry, and the entries' lists laid end to end."""
    flat = {}
    sizes = np.zeros(0, np.int64)
    for name in names:
        column = table.column(name).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        flat[name] = column.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(column.offsets.to_numpy())
    return (np.repeat(table.column("batch").to_numpy(), sizes), *flat.values())


def replied(batch: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row for each batch with the lists of its answers."""
    order = np.argsort(batch, kind="stable")
    batch = batch[order]
    heads = np.flatnonzero(np.diff(batch, prepend=-1))
    sizes = np.diff(heads, append=len(batch))
    return pa.table({"batch": pa.array(batch[heads])} | {name: A.list_array(pa.array(values[order]), sizes) for name, values in columns.items()})


def grouped(rows: DataFrame, key: str, function: Callable, schema: str) -> DataFrame:
    """function: all rows of a key to result rows."""

    def run(table: pa.Table) -> pa.Table:
        return function(table)

    return rows.groupBy(key).applyInArrow(run, schema)


def joined(rows: DataFrame, others: DataFrame, key: str, function: Callable, schema: str) -> DataFrame:
    """function: all rows of a key on both sides (maybe none on one) to result rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return function(left, right)

    return rows.groupBy(key).cogroup(others.groupBy(key)).applyInArrow(run, schema)


def meet(texts: DataFrame, answers: DataFrame, function: Callable, schema: str) -> DataFrame:
    """function: a batch of texts and its answers (maybe no rows) to result rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return function(left, right)

    answers = answers.select(*(F.col(c).alias(c) for c in answers.columns))  # texts may be an ancestor of the answers
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)

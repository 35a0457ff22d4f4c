"""Substring deduplication of 50-word passages, by a log-structured fingerprint index.

Every window of 50 words has a fingerprint: the least hash of its 16-word grams, so that neighbouring windows
mostly share one and equal windows always do. The index is a folder of sorted immutable runs, one written by each ingest
of documents. A run has, by bucket, the fingerprints that are new, each with the only document that has it or the mark
that several have; and of fingerprints that several documents have, 96 bits of hash over all 50 words of each window,
with the least doc_id. A new batch is merge-joined with the runs: its windows with a fingerprint that another document
has too are held against the stored ones; where the index knows of one earlier document only, that document's windows
are made from its text and stored as well. A word goes if a window over it also starts in a document of smaller id.
Runs are merged when several have about the same size; in merging, newer entries of a fingerprint and lesser ids win.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from . import exchange as X
from .runtime import exists, range_bounds, range_of, shared_dir

WINDOW = 50
GRAM = 16
BATCH_BYTES = 2 << 20
INGESTS = 2
#: A run has at most so many files for each batch of texts; one that is merged has a file for so many fingerprints.
BATCH_FILES, FILE_ENTRIES = 2, 1 << 16
#: A run is merged into the one before it when that one is not this many times larger, once there are so many runs.
FANOUT = 4
#: Stands for the owner of a fingerprint that several documents have.
MANY = -1
#: Bitmaps of called rows, and bits of each: Spark's bitmap functions make them of 4 KB. All together, 16 MB.
CALL_BITMAPS, BITMAP_BITS = 4096, 32768
#: The batch of entries that nobody waits for.
NOBODY = -1
RESULT_ROW, MARKS_RUN, WINDOWS_RUN = 0, 1, 2

SENT = "bucket int, batch long, keys array<long>, owners array<long>"
MET = "kind int, bucket int, batch long, keys array<long>, owners array<long>"
REPLY, CALL, RUN = 0, 1, 2
ASKED = "bucket int, batch long, keys array<long>, check array<int>, first_id array<long>, more array<long>"
FOUND = "kind int, bucket int, batch long, keys array<long>, check array<int>, least_id array<long>"
RESULT = "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<start: int, stop: int>>"
MADE = f"kind int, bucket int, keys array<long>, check array<int>, least_id array<long>, {RESULT}"
STORED = "kind int, bucket int, keys array<long>, check array<int>, owners array<long>, least_id array<long>"
MANIFEST = "version long, place int, path string, buckets int, entries long"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_marks(values: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of each window of ``values``, and whether the window lies within one text."""
    marks = sliding_least(A.gram_hashes(values, gram), window - gram + 1)
    owner = A.owners(first)
    inside = owner[: len(marks)] == owner[window - 1 :] if len(marks) else np.zeros(0, bool)
    return marks, inside


def distinct_marks(marks: np.ndarray, inside: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of a batch, and whether two of its texts have them."""
    if not len(marks):
        return np.zeros(0, A.U64), np.zeros(0, bool)
    new = inside.copy()
    new[1:] &= (marks[1:] != marks[:-1]) | (owner[1 : len(marks)] != owner[: len(marks) - 1]) | ~inside[:-1]
    at = np.flatnonzero(new)
    keys, of = marks[at], owner[at]
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    heads = np.flatnonzero(np.diff(keys, prepend=keys[:1] + A.U64(1)) != 0) if len(keys) else np.zeros(0, np.int64)
    many = np.minimum.reduceat(of, heads) != np.maximum.reduceat(of, heads) if len(heads) else np.zeros(0, bool)
    return keys[heads], many


def flag_shared(table: pa.Table) -> pa.Table:
    """Of each batch's fingerprints, those that two documents have."""
    batch, keys, many = X.unpacked(table, ["keys", "many"])
    _, code, count = np.unique(keys, return_inverse=True, return_counts=True)
    hit = (count > 1)[code] | (np.bincount(code, weights=many) > 0)[code] if len(keys) else np.zeros(0, bool)
    return X.replied(batch[hit], {"keys": keys[hit]})


def send_marks(texts: pa.Table, buckets: int) -> pa.Table:
    """Distinct fingerprints of a batch of texts, by bucket, each with the number of the only row that has it."""
    marks, inside, owner = word_marks(*X.texts_of(texts))
    at = np.flatnonzero(inside)
    keys, of = marks[at], owner[at]
    order = np.lexsort((of, keys))
    keys, of = keys[order], of[order]
    heads = np.flatnonzero(np.diff(keys, prepend=keys[:1] + A.U64(1)) != 0)
    tails = np.append(heads[1:], len(keys)) - 1 if len(heads) else heads
    rows = texts.column("row").to_numpy()
    owners = np.where(of[heads] == of[tails], rows[of[heads]], MANY)
    return X.packed(texts.column("batch")[0].as_py(), keys[heads], {"owners": owners}, buckets)


def newest(keys: np.ndarray, age: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of entries with one key, the last by age; sorted by key."""
    order = np.lexsort((age, keys))
    keys = keys[order]
    last = np.flatnonzero(np.append(keys[1:] != keys[:-1], np.ones(min(1, len(keys)), bool)))
    return (keys[last], *(v[order][last] for v in values))


def rows_of(kind: int, bucket: int, names: Sequence[str], batch: bool, **lists: pa.Array) -> pa.Table:
    """One row of lists, or none if they are empty."""
    n = min(1, len(next(iter(lists.values()))))
    columns = {"kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32())}
    if batch:
        columns["batch"] = pa.array([NOBODY - 1 - bucket] * n, pa.int64())  # of no batch, and spread as its buckets are
    return pa.table(columns | {c: A.list_array(v, np.array([len(v)] * n)) for c, v in lists.items()}).select(names)


def join_marks(sent: pa.Table, runs: pa.Table) -> pa.Table:
    """Merge-join a bucket's new fingerprints with its runs: replies to batches (fingerprints that another document has
    too), calls to earlier documents that were the only ones, and the entries of the new run."""
    names = [c.split()[0] for c in MET.split(", ")]
    kind = pa.list_(pa.int64())
    if not sent.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), kind, kind)], names=names)
    bucket = sent.column("bucket")[0].as_py()
    batch, keys, owners = X.unpacked(sent, ["keys", "owners"])
    old_keys, old_owners = newest(*aged(runs)) if runs.num_rows else (np.zeros(0, A.U64), np.zeros(0, np.int64))
    distinct, place, code, count = np.unique(keys.view(A.U64), return_index=True, return_inverse=True, return_counts=True)
    several = (count > 1) | (np.bincount(code, weights=owners == MANY) > 0)
    known, at = member(distinct, old_keys)
    before = old_owners[at] if len(old_keys) else np.zeros(len(distinct), np.int64)
    single = known & (before != MANY)
    hit = (several | known)[code]
    replies = X.replied(batch[hit], {"keys": keys[hit]})
    n = replies.num_rows
    replies = replies.append_column("kind", pa.array(np.full(n, REPLY, np.int32))).append_column("bucket", pa.array(np.full(n, bucket, np.int32)))
    replies = replies.append_column("owners", pa.nulls(n, kind)).select(names)
    calls = rows_of(CALL, bucket, names, True, keys=pa.array(distinct[single].view(np.int64)), owners=pa.array(before[single]))
    fresh = ~known | single
    owner = np.where(known | several, MANY, owners[place])[fresh]
    run = rows_of(RUN, bucket, names, True, keys=pa.array(distinct[fresh].view(np.int64)), owners=pa.array(owner))
    return pa.concat_tables([replies, calls, run])


def aged(runs: pa.Table) -> tuple:
    """Keys, the age of each one's run, and owners of a bucket's runs."""
    age, keys, owners = X.unpacked(runs.rename_columns(["batch" if c == "age" else c for c in runs.column_names]), ["keys", "owners"])
    return keys.view(A.U64), age, owners


def reply_lists(answers: pa.Table, names: list[str]) -> tuple[np.ndarray, ...]:
    return X.unpacked(answers, names)[1:]


def word_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = A.word_spans(data, offsets)
    marks, inside = window_marks(A.word_hashes(data, starts, ends), first, WINDOW, GRAM)
    return marks, inside, A.owners(first)


def member(values: np.ndarray, sorted_set: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the set, and where."""
    if not len(sorted_set):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values, at


def window_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 more bits of hash over the 50 words of the windows at some places."""
    one = A.gram_hashes(words, WINDOW)[at]
    two = A.gram_hashes(A.word_hashes(data, starts, ends, 1), WINDOW, 1)[at]
    return one, (two >> A.U64(32)).astype(np.uint32).view(np.int32)


def send_windows(texts: pa.Table, keys: np.ndarray, batch: int, buckets: int) -> pa.Table:
    """Both hashes of each window with a wanted fingerprint, with the least id in the batch and by how much the greatest
    one is greater."""
    data, offsets = X.texts_of(texts)
    ids = X.ids_of(texts)
    starts, ends, first = A.word_spans(data, offsets)
    words = A.word_hashes(data, starts, ends)
    marks, inside = window_marks(words, first, WINDOW, GRAM)
    at = np.flatnonzero(inside)
    at = at[member(marks[at], np.sort(keys.view(A.U64)))[0]]
    one, two = window_hashes(data, starts, ends, words, at)
    of = ids[A.owners(first)[at]]
    order = np.lexsort((of, two, one))
    one, two, of = one[order], two[order], of[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(order)) - 1 if len(heads) else heads
    lists = {"check": two[heads], "first_id": of[heads], "more": of[tails] - of[heads]}
    return X.packed(batch, one[heads], lists, buckets)


def answer_windows(texts: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """Windows of a batch that its replies ask for."""
    (keys,) = reply_lists(replies, ["keys"])
    return send_windows(texts, keys, texts.column("batch")[0].as_py() if texts.num_rows else NOBODY, buckets)


def called(history: DataFrame, calls: DataFrame) -> DataFrame:
    """Rows (row, doc_id, text) of the history that calls may name, before any shuffle of them.

    A bit is set for each row that is called, by its hash, in at most CALL_BITMAPS bitmaps of 4 KB: what is broadcast is
    bounded, whatever the numbers of rows and calls. A row whose bit is set by another one stays; the join with the
    calls leaves it out.
    """
    bit = lambda row: F.pmod(row, F.lit(CALL_BITMAPS * BITMAP_BITS))
    maps = calls.select(bit(F.col("row")).alias("bit")).groupBy(F.expr(f"bit div {BITMAP_BITS}").alias("_map"))
    maps = maps.agg(F.bitmap_construct_agg((F.col("bit") % BITMAP_BITS).alias("bit")).alias("_bits"))
    rows = history.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = bit(F.col("row"))
    byte = F.conv(F.hex(F.substring("_bits", ((place % BITMAP_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (place % 8).cast("int")) == 1
    return rows.join(F.broadcast(maps), (F.floor(place / BITMAP_BITS) == F.col("_map")) & is_set).select("row", "doc_id", "text")


def earlier_windows(history: DataFrame, calls: DataFrame, buckets: int) -> DataFrame:
    """Windows of earlier documents, from (row, key) calls."""
    wanted = calls.groupBy("row").agg(F.collect_list("key").alias("wanted"))  # no more than a document has
    rows = called(history, calls).join(wanted, "row").select("doc_id", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches):
            part = pa.Table.from_batches([batch])
            keys = batch.column("wanted").flatten().to_numpy()
            yield from send_windows(part, keys, NOBODY, buckets).to_batches()

    return rows.mapInArrow(run, ASKED)


def least_ids(asked: pa.Table, runs: pa.Table) -> pa.Table:
    """Hold the windows of a bucket against its runs: replies with the least id of a document that holds the window,
    where that matters; and the entries of the new run: windows that are new, or have a lesser id now."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    if not asked.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))], names=names)
    bucket = asked.column("bucket")[0].as_py()
    batch, keys, check, first_id, more = X.unpacked(asked, ["keys", "check", "first_id", "more"])
    last_id, stored = first_id + more, np.zeros(len(keys), bool)
    if runs.num_rows:
        known = X.unpacked(runs.rename_columns(["batch" if c == "age" else c for c in runs.column_names]), ["keys", "check", "least_id"])[1:]
        n = len(known[0])
        batch, stored = np.concatenate([batch, np.full(n, NOBODY)]), np.concatenate([stored, np.ones(n, bool)])
        keys, check, first_id, last_id = (np.concatenate(x) for x in ((keys, known[0]), (check, known[1]), (first_id, known[2]), (last_id, known[2])))
    order = np.lexsort((check, keys.view(A.U64)))
    batch, keys, check, first_id, last_id, stored = (x[order] for x in (batch, keys, check, first_id, last_id, stored))
    new = np.ones(len(order), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(heads, append=len(order))
    least = np.minimum.reduceat(first_id, heads)
    before = np.minimum.reduceat(np.where(stored, first_id, X.NO_ID), heads)
    fresh = ~np.logical_or.reduceat(stored, heads) | (least < before)
    run = rows_of(RUN, bucket, names, True, keys=pa.array(keys[heads][fresh]), check=pa.array(check[heads][fresh]), least_id=pa.array(least[fresh]))
    told = np.repeat(least, sizes)
    matters = (told < last_id) & (batch != NOBODY)
    replies = X.replied(batch[matters], {"keys": keys[matters], "check": check[matters], "least_id": told[matters]})
    n = replies.num_rows
    replies = replies.append_column("kind", pa.array(np.full(n, REPLY, np.int32))).append_column("bucket", pa.array(np.full(n, bucket, np.int32)))
    return pa.concat_tables([replies.select(names), run])


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n places a window starting at one of ``starts`` covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) > 0


def drop_repeats(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Result rows of a batch of texts."""
    carried = {c: texts.column(c) for c in texts.column_names if c.startswith("_carry_")}
    if not texts.num_rows:
        return result_table([], [], [], [], [], carried)
    data, offsets = X.texts_of(texts)
    ids = X.ids_of(texts)
    starts, ends, first = A.word_spans(data, offsets)
    owner = A.owners(first)
    keys, check, least = reply_lists(answers, ["keys", "check", "least_id"])
    gone = np.zeros(len(starts), bool)
    if len(keys):
        order = np.argsort(keys.view(A.U64), kind="stable")
        keys, check, least = keys.view(A.U64)[order], check[order], least[order]
        words = A.word_hashes(data, starts, ends)
        whole = A.gram_hashes(words, WINDOW)
        at = np.flatnonzero(owner[: len(whole)] == owner[WINDOW - 1 :])
        hit, where = member(whole[at], keys)
        at, where = at[hit], where[hit]
        _, two = window_hashes(data, starts, ends, words, at)
        at = at[(check[where] == two) & (least[where] < ids[owner[at]])]
        gone = covered(at, WINDOW, len(starts))
    kept, spans, removed = [], [], []
    whole_text = data.tobytes()
    lows, highs = starts.tolist(), ends.tolist()
    lost = np.concatenate([[0], np.cumsum(gone)])[first]
    for a, b, n in zip(first[:-1].tolist(), first[1:].tolist(), np.diff(lost).tolist()):
        stay = [whole_text[x:y] for x, y in zip(lows[a:b], highs[a:b])] if not n else [whole_text[lows[i] : highs[i]] for i in (np.flatnonzero(~gone[a:b]) + a).tolist()]
        kept.append(b" ".join(stay))
        removed.append(n)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]))).tolist() if n else []
        spans.append([{"start": x, "stop": y} for x, y in zip(edge[::2], edge[1::2])])
    return result_table(texts.column("doc_id"), np.diff(first), removed, kept, spans, carried)


def result_table(doc_id, n_words, removed, kept, spans, carried) -> pa.Table:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    columns = [(doc_id, pa.int64()), (n_words, pa.int64()), (removed, pa.int64()), (kept, pa.binary()), (spans, kind)]
    names = ["doc_id", "n_words", "n_removed", "kept", "spans"]
    return pa.table({n: c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for n, (c, t) in zip(names, columns)} | carried)


def results_and_run(texts: pa.Table, found: pa.Table) -> pa.Table:
    """Result rows of a batch of texts; entries of the new run, which are of no batch, as they came."""
    entries = found.select(["bucket", "keys", "check", "least_id"])
    if texts.num_rows:
        rows = drop_repeats(texts, found)
        n, kind = rows.num_rows, RESULT_ROW
        entries = pa.table([pa.nulls(n, f.type) for f in entries.schema], names=entries.column_names)
    else:
        n, kind = found.num_rows, WINDOWS_RUN
        rows = drop_repeats(texts, found)  # none, for the types
        rows = pa.table([pa.nulls(n, f.type) for f in rows.schema], names=rows.column_names)
    names = ["kind", *entries.column_names, *rows.column_names]
    return pa.table([pa.array(np.full(n, kind, np.int32)), *entries.columns, *rows.columns], names=names)


class Run(NamedTuple):
    """A sorted immutable run: its folder, how many buckets it is dealt into, and how many fingerprints it has."""

    path: str
    buckets: int
    entries: int


def last_version(spark: SparkSession, index: str) -> int:
    """Number of the manifest's last version, -1 if there is none."""
    if not exists(spark, f"{index}/manifest"):
        return -1
    version = spark.read.schema(MANIFEST).parquet(f"{index}/manifest").agg(F.max("version")).first()[0]
    return -1 if version is None else version


def runs_of(spark: SparkSession, index: str) -> list[Run]:
    """The index's runs, oldest first; as many as the logarithm of its size. They are read without a join or a sort:
    each shuffle and each broadcast of a plan starts threads of the driver, which stay a minute."""
    version = last_version(spark, index)
    if version < 0:
        return []
    latest = spark.read.schema(MANIFEST).parquet(f"{index}/manifest").where(F.col("version") == version).collect()
    return [Run(r["path"], r["buckets"], r["entries"]) for r in sorted(latest, key=lambda r: r["place"])]


def publish(spark: SparkSession, index: str, runs: Sequence[Run]) -> None:
    """Make these the index's runs. Until then an ingest that failed has changed nothing."""
    version = last_version(spark, index) + 1
    rows = [(version, place, *run) for place, run in enumerate(runs)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{index}/manifest")


def stored(spark: SparkSession, runs: Sequence[Run], kind: int, column: str, buckets: int) -> DataFrame | None:
    """Rows of all runs, by bucket: age (higher is newer), keys, and what goes with them. Runs of fewer buckets are cut."""
    parts = []
    names = ["bucket", "age", "keys", *(["check"] if kind == WINDOWS_RUN else []), column]
    for age, run in enumerate(runs):
        rows = spark.read.schema(STORED).parquet(run.path).where(F.col("kind") == kind).withColumn("age", F.lit(age).cast("long")).select(names)
        parts.append(rows if run.buckets == buckets else rows.mapInArrow(partial(cut_rows, names=names, buckets=buckets), rows.schema))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def cut_rows(batches: Iterator[pa.RecordBatch], names: Sequence[str], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of sorted keys dealt into more buckets, which are narrower ranges of keys."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            lists = {c: row.column(c).flatten().to_numpy() for c in names[2:]}
            out = X.packed(row.column("age")[0].as_py(), lists.pop("keys").view(A.U64), lists, buckets)
            yield from out.rename_columns(["age" if c == "batch" else c for c in out.column_names]).select(names).to_batches()


def merge_runs(table: pa.Table, kind: int) -> pa.Table:
    """A bucket's runs as one: the newest entry of each fingerprint, the least id of each window."""
    bucket = table.column("bucket")[0].as_py()
    none = {"check": pa.list_(pa.int32()), "owners": pa.list_(pa.int64()), "least_id": pa.list_(pa.int64())}
    if kind == MARKS_RUN:
        keys, owners = newest(*aged(table))
        out = rows_of(kind, bucket, ["kind", "bucket", "keys", "owners"], False, keys=pa.array(keys.view(np.int64)), owners=pa.array(owners))
    else:
        _, keys, check, least = X.unpacked(table.rename_columns(["batch" if c == "age" else c for c in table.column_names]), ["keys", "check", "least_id"])
        order = np.lexsort((least, check, keys.view(A.U64)))
        keys, check, least = keys[order], check[order], least[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])
        out = rows_of(kind, bucket, ["kind", "bucket", "keys", "check", "least_id"], False, keys=pa.array(keys[new]), check=pa.array(check[new]), least_id=pa.array(least[new]))
    for name, t in none.items():
        if name not in out.column_names:
            out = out.append_column(name, pa.nulls(out.num_rows, t))
    return out.select([c.split()[0] for c in STORED.split(", ")])


def compacted(spark: SparkSession, index: str, runs: list[Run]) -> list[Run]:
    """The runs after the newest ones of about one size are merged, if there are FANOUT runs or more."""
    if len(runs) < FANOUT:
        return runs
    keep = len(runs) - 1
    while keep and runs[keep - 1].entries < FANOUT * sum(r.entries for r in runs[keep:]):
        keep -= 1
    if len(runs) - keep < 2:
        return runs
    merging = runs[keep:]
    buckets = max(r.buckets for r in merging)
    parts = [X.grouped(stored(spark, merging, kind, column, buckets), "bucket", partial(merge_runs, kind=kind), STORED) for kind, column in ((MARKS_RUN, "owners"), (WINDOWS_RUN, "least_id"))]
    files = -(-sum(r.entries for r in merging) // FILE_ENTRIES)
    runs = [*runs[:keep], write_run(parts[0].unionByName(parts[1]), index, buckets, max(1, files))]
    publish(spark, index, runs)
    return runs


def write_run(rows: DataFrame, index: str, buckets: int, files: int) -> Run:
    """Write a run of at most so many files; its fingerprints are counted as they are written."""
    path = f"{index}/run-{uuid.uuid4().hex}"
    counted = Observation()
    marks = F.when(F.col("kind") == MARKS_RUN, F.size("keys"))
    rows.observe(counted, F.sum(marks).alias("entries")).coalesce(files).write.parquet(path)
    return Run(path, buckets, counted.get["entries"] or 0)


def of_kind(rows: DataFrame, kind: int) -> DataFrame:
    """Rows of one kind. The test adds a 0 that is not deterministic for Spark and depends on every column: else the
    filter, or a choice of columns, would move below the shuffle of the rows, which would be made anew for each kind."""
    share = F.lit(1)
    for column in rows.columns:
        share = share + F.col(column).isNull().cast("int")
    return rows.where(F.col("kind") + F.floor(F.rand(0) / share).cast("int") == kind)


def ingest(batch: DataFrame, index: str, history: DataFrame | None = None, carry: Sequence[str] = (), keep: Column | None = None, columns: Sequence[Column] = (), add: bool = True) -> DataFrame:
    """Deduplicate a batch of documents against an index and itself, and add it to the index, unless ``add`` is false.

    index: a folder in shared storage; a new one is an empty index. history: the documents that were ingested before (or
    any table that has them all), needed from the second ingest on, else that is an error; it is scanned, but only documents
    that were the only ones to have a fingerprint, and no longer are, are shuffled. Returns, for each document of the batch: word counts, the kept words
    joined by spaces (UTF-8), and the removed spans of words. A word goes if a window over it also starts in a document
    of smaller id, in the batch or ingested before; earlier results are not taken back.

    Words are runs of bytes other than ASCII white space. A null text has no words. Documents of one id, or both
    without an id, are never earlier than each other; a document without an id is later than all with one. The
    columns of ``carry`` come along as ``_carry_0``, ``_carry_1``, ...; others do not. ``keep`` says which rows of
    the result stay, ``columns`` what is returned of them. Result and run are written together, and the run counts from then on; an ingest that fails changes nothing. A
    batch that is not added writes nothing, and its result is computed where it is used.
    """
    spark = batch.sparkSession
    runs = runs_of(spark, index)
    if runs and history is None:
        raise ValueError("history is needed to ingest into an index that has runs")
    runs = compacted(spark, index, runs) if add else runs
    texts, batches, buckets = X.batched(batch, BATCH_BYTES, row=F.xxhash64("doc_id", "text"), **{f"_carry_{i}": F.col(c) for i, c in enumerate(carry)})
    buckets = max([buckets, *(r.buckets for r in runs)])
    empty = lambda names: spark.createDataFrame([], names)
    old_marks = stored(spark, runs, MARKS_RUN, "owners", buckets) if runs else empty("bucket int, age long, keys array<long>, owners array<long>")
    old_windows = stored(spark, runs, WINDOWS_RUN, "least_id", buckets) if runs else empty("bucket int, age long, keys array<long>, check array<int>, least_id array<long>")

    sent = X.grouped(texts, "batch", partial(send_marks, buckets=buckets), SENT)
    met = X.joined(sent, old_marks, "bucket", join_marks, MET).repartition("batch")
    asked = X.meet(texts, of_kind(met, REPLY).select("batch", "keys"), partial(answer_windows, buckets=buckets), ASKED)
    if runs:
        calls = of_kind(met, CALL).select(F.inline(F.arrays_zip(F.col("owners").alias("row"), F.col("keys").alias("key"))))
        asked = asked.unionByName(earlier_windows(history, calls, buckets))
    found = X.joined(asked, old_windows, "bucket", least_ids, FOUND).repartition("batch")
    carried = [f"_carry_{i} {batch.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    # the run's windows come along: a second branch of the plan would hold all of it again
    made = X.meet(texts, found if add else found.where(F.col("kind") == REPLY), results_and_run, ", ".join([MADE, *carried]))
    is_result = F.col("kind") == RESULT_ROW
    made = made if keep is None else made.where(~is_result | keep)
    columns = columns or [F.col(c) for c in made.columns if c not in ("kind", "bucket", "keys", "check", "least_id")]
    if not add:
        return made.where(is_result).select(*columns)

    # one job writes result and run, so that each shuffle is made once
    every = made.select("kind", F.when(is_result, F.struct(*columns)).alias("row"), "bucket", "keys", "check", "least_id")
    new_marks = of_kind(met, RUN).select(F.lit(MARKS_RUN).alias("kind"), "bucket", "keys", "owners")
    every = every.unionByName(new_marks, allowMissingColumns=True)
    run = write_run(every, index, buckets, BATCH_FILES * batches)
    publish(spark, index, [*runs, run])
    return spark.read.schema(every.schema).parquet(run.path).where(F.col("kind") == RESULT_ROW).select("row.*")


def drop_repeated_passages(docs: DataFrame, ingests: int = INGESTS, carry: Sequence[str] = (), keep: Column | None = None, columns: Sequence[Column] = ()) -> DataFrame:
    """The results of ``ingest`` for a whole table, ingested into a new index in ranges of ascending doc_id, documents
    without an id last; a single ingest leaves no index. An empty table gives no rows."""
    index = f"{shared_dir(docs.sparkSession)}/lexmill-passages-{uuid.uuid4().hex}"
    if ingests == 1:  # nothing comes after it
        return ingest(docs, index, None, carry, keep, columns, add=False)
    bounds = range_bounds(docs, "doc_id", ingests)
    number = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(range_of(F.col("doc_id"), bounds))
    out = None
    for k in range(len(bounds) + 1):
        part = ingest(docs.where(number == k), index, docs.where(number < k), carry, keep, columns)
        out = part if out is None else out.unionByName(part)
    return out

"""Joins, deduplication by priority, and idempotent merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

def priority_dedup(df: DataFrame, key: str, order: Sequence[Column | str], note: str | None = None, prefix: str = "[跨源重复,已在更高优先源] ") -> tuple[DataFrame, DataFrame]:
    """First row of each key in the given order, and the others. An empty or null key never repeats another.

    With ``note``, a column of remarks, those of the excluded rows begin with ``prefix``; a null remark counts as empty.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    keyed = F.coalesce(F.col(key), F.lit("")) != ""
    ranked = df.where(keyed).withColumn("_rank", first)
    kept = ranked.where("_rank = 1").drop("_rank").unionByName(df.where(~keyed))
    excluded = ranked.where("_rank > 1").drop("_rank")
    if note is not None:
        excluded = excluded.withColumn(note, F.concat(F.lit(prefix), F.coalesce(note, F.lit(""))))
    return kept, excluded


def anti_existing(new: DataFrame, existing: DataFrame, key: str, order: Sequence[Column | str], own_prefix: Column | None = None) -> DataFrame:
    """New rows, first of each key, that are not stored yet; the source's own earlier output does not count."""
    stored = existing if own_prefix is None else existing.where(~own_prefix)
    return priority_dedup(new, key, order)[0].join(stored.select(key).distinct(), key, "left_anti")


def merge_keep_excluded(*parts: DataFrame, order: Sequence[str]) -> DataFrame:
    """All excluded rows in one table with a running number ``seq``."""
    return sequence_number(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), order)


def sequence_number(df: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    """Numbers 1..n in the given order: rows are sorted by range, counted by partition, and numbered from the sums
    before them, so no task sees more than its range. The sorted rows are written once, so that counts and numbers come
    from the same partitions."""
    ordered = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    ordered = written(ordered, "sorted")
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition
    starts = counts.select("_part", "_first", before.alias("_before"))
    return ordered.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")


def prefix_match_dedup(new: DataFrame, existing: DataFrame, key: str, min_len: int = 5) -> DataFrame:
    """Rows of new whose key neither starts with an existing key of ``min_len`` or more, nor, being that long itself,
    starts one. Each prefix that is long enough is looked up whole, so keys that only begin alike never meet."""
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(min_len), F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n)))
    keys, old = new.select(F.col(key).alias("_new")).distinct().where(F.length("_new") >= min_len), existing.select(F.col(key).alias("_old")).distinct().where(F.length("_old") >= min_len)
    begin = keys.select("_new", prefixes("_new").alias("_old")).join(old, "_old", "left_semi").select("_new")
    begun = keys.join(old.select(prefixes("_old").alias("_new")).distinct(), "_new", "left_semi")
    return new.join(begin.unionByName(begun).distinct(), F.col(key) == F.col("_new"), "left_anti")


def pieces_like(short: DataFrame, long: DataFrame, min_len: int) -> DataFrame:
    """(l, piece): the distinct pieces of long names (l) that begin like some short one (s) of ``min_len`` characters or
    more and are as long as it. What short names begin with and how long they are is a small table without the names, so
    names that only begin alike never meet."""
    begins = short.where(F.length("s") >= min_len).select(F.substring("s", 1, min_len).alias("g"), F.length("s").alias("n")).distinct()
    last = F.length("l") - min_len + 1
    at = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)
    places = long.select("l", F.explode(at).alias("i")).withColumn("g", F.substring(F.col("l"), F.col("i"), F.lit(min_len)))
    found = places.join(begins, "g").where(F.col("i") + F.col("n") - 1 <= F.length("l"))
    return found.select("l", F.substring(F.col("l"), F.col("i"), F.col("n")).alias("piece")).distinct()


def containment_flag(df: DataFrame, names: DataFrame, key: str, min_len: int = 5) -> DataFrame:
    """Add contained: the key equals a name, or one contains the other and the contained one is long enough. A null key
    is contained in nothing. Only whether there is a match is looked up, by equality of whole pieces; no pairs are made."""
    own = df.select(F.col(key).alias("_key")).where(F.col(key).isNotNull()).distinct()
    known = names.select(F.col(key).alias("_name")).where(F.col(key) != "").distinct()
    equal = own.join(known, F.col("_key") == F.col("_name"), "left_semi")
    inside = pieces_like(known.toDF("s"), own.toDF("l"), min_len).join(known, F.col("piece") == F.col("_name"), "left_semi").select(F.col("l").alias("_key"))
    outer = own.join(pieces_like(own.toDF("s"), known.toDF("l"), min_len), F.col("_key") == F.col("piece"), "left_semi")
    hits = equal.unionByName(inside).unionByName(outer).distinct().withColumn("contained", F.lit(True))
    return df.join(hits, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("contained", F.coalesce("contained", F.lit(False)))


def upsert_by_source(store: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """The store with all rows of the new rows' sources replaced: applying it twice changes nothing more."""
    return store.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def coverage_check(files: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the direction."""
    a, b = files.select(key).distinct(), registry.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("not registered")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("no file")))


def first_hit_catalog(hits: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First hit of each id in search order, with how it was found."""
    return distinct_by_key(hits, key, order)


def distinct_by_key(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


def union_sources(parts: Sequence[tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """Several schemas mapped into one."""
    return reduce(DataFrame.unionByName, (df.select(*(c.alias(n) for n, c in mapping.items())) for df, mapping in parts))


def attach_file_path(df: DataFrame, files: DataFrame, key: str, path: str, ordinal: str, reason: str) -> DataFrame:
    """First path of each key; rows without one get keep = false and the reason."""
    first = files.groupBy(key).agg(F.min_by(path, ordinal).alias("file_path"))
    out = df.join(first, key, "left")
    return out.withColumn("keep", F.col("file_path").isNotNull()).withColumn("reason", F.when(F.col("file_path").isNull(), reason))


def retry_merge(accepted: DataFrame, failed: DataFrame, new_ok: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Append new successes that are not accepted yet, and take them off the failed list."""
    fresh = new_ok.join(accepted.select(key), key, "left_anti")
    return accepted.unionByName(fresh), failed.join(new_ok.select(key), key, "left_anti")


def first_valid_candidate(attempts: DataFrame, target: str, rank: str, ok: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Per target the first attempt that passes; for the others all reasons in order, joined by ``; ``."""
    accepted = distinct_by_key(attempts.where(ok), target, [rank])
    failed = attempts.join(accepted.select(target), target, "left_anti")
    return accepted, failed.groupBy(target).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, reason))), lambda x: x[reason]), "; ").alias("reasons"))


def worklist(targets: DataFrame, progress: DataFrame, key: str, mode: str, limit: int | None = None) -> DataFrame:
    """Targets still to fetch: those that are short, have attachments, or both; with an address and without an error."""
    test = {"short": F.col("short"), "attach": F.col("has_attachment"), "both": F.col("short") | F.col("has_attachment")}[mode]
    rows = targets.where(test & F.col("error").isNull() & F.col("url").isNotNull()).join(progress.where("done").select(key), key, "left_anti")
    return rows if limit is None else rows.orderBy(key).limit(limit)


def unique_name(df: DataFrame, name: str, order: Sequence[Column | str], first: int = 1) -> DataFrame:
    """Add unique_name: the first of equal names as it is, the next ones with _1, _2, ..."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), (n - 2 + first).cast("string"))))

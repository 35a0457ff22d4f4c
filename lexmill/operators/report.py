"""Counts, totals and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merge import distinct_by_key


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows by value, null as ``?``, most frequent first, then by value."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("?")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def totals_by_section(df: DataFrame, column: str, order: Sequence[str] = (), stored: Column | None = None) -> DataFrame:
    """(value, n, n_yes, n_no, place): rows by value, and all (value ``total``, last), with how many are stored and how many
    are not.

    ``order`` fixes the place of its values, those without rows left out; others follow by name, null last. ``stored`` is a
    condition; a null one is a no, without one all rows are stored. An empty table gives no rows.
    """
    yes = F.coalesce(stored, F.lit(False)) if stored is not None else F.lit(True)
    rows = df.select(F.col(column).cast("string").alias("value"), yes.alias("yes"))
    sums = rows.rollup("value").agg(F.count("*").alias("n"), F.count_if("yes").alias("n_yes"), F.count_if(~F.col("yes")).alias("n_no"), F.grouping("value").alias("all"))
    fixed = F.coalesce(F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col("value")), F.lit(0))
    place = F.row_number().over(Window.orderBy("all", F.when(fixed == 0, len(order) + 1).otherwise(fixed), F.col("value").asc_nulls_last()))  # a row for each value
    return sums.select(F.when(F.col("all") == 1, "total").otherwise(F.col("value")).alias("value"), "n", "n_yes", "n_no", place.alias("place")).orderBy("place")


def chunks_per_doc(docs: DataFrame, chunks: DataFrame, doc: str) -> DataFrame:
    counts = chunks.groupBy(doc).agg(F.count("*").alias("n"))
    return docs.select(doc).join(counts, doc, "left").select(doc, F.coalesce("n", F.lit(0)).alias("n_articles"), F.col("n").isNotNull().alias("has_article"))


def skip_reasons(df: DataFrame, reason: str = "skip_reason") -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"))


def files_per_archive(df: DataFrame, archive: str, short: Column, attached: Column) -> DataFrame:
    return df.groupBy(archive).agg(F.count("*").alias("n"), F.count_if(short).alias("n_short"), F.count_if(attached).alias("n_attached"), F.count_if(short & attached).alias("n_both"))


def catalog_sort(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Descending by the columns as text, a null as ``None`` (which comes before digits)."""
    return df.orderBy(*(F.coalesce(F.col(c).cast("string"), F.lit("None")).desc() for c in columns))


def top_n_listing(df: DataFrame, key: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n of the first rows of each key."""
    return distinct_by_key(df, key, order).orderBy(*order).limit(n)


def bytes_per_key(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(F.octet_length(text)).alias("n_bytes"), F.sum(F.length(text)).alias("n_chars"))


def chunk_profile(chunks: DataFrame, label: str = "label") -> DataFrame:
    return chunks.agg(F.count("*").alias("total"), F.count(label).alias("with_number"), F.count_if(F.col(label).isNull()).alias("without_number"))

"""Versions of laws: which law has superseded which, when each was in force, and which one is at a date.

A law is followed by the one that supersedes it first. The way from a law to its newest version is walked by doubling:
each round joins every pointer with the pointer at its end, so chains of n laws take log n rounds, and the pointers of
all rounds answer a question about a date in as many joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import date_precision, norm_date
from ..sources.tables import written

IN_FORCE, REPEALED, PENDING, UNKNOWN = "现行有效", "已废止", "未生效", "未知"


def date_range(value: Column) -> Column:
    """Struct of the first and the last day that a date string may mean, and its precision: a day, a month, a year, or none."""
    text = norm_date(value)
    precision = date_precision(text)
    low = (
        F.when(precision == "day", F.try_to_date(F.substring(text, 1, 10))).when(precision == "month", F.try_to_date(F.concat(text, F.lit("-01"))))
        .when(precision == "year", F.try_to_date(F.concat(text, F.lit("-01-01"))))
    )
    high = F.when(precision == "month", F.last_day(low)).when(precision == "year", F.date_add(F.add_months(low, 12), -1)).otherwise(low)
    return F.struct(low.alias("low"), high.alias("high"), F.when(low.isNull(), "none").otherwise(precision).alias("precision"))


@dataclass
class Versions:
    """``laws``: (law, low, high, precision, next, until, until_high, newest, steps, cyclic). ``jumps``: for each k, (law, to,
    low): the law 2**k steps on, and the first day by which all on the way to it may be in force."""

    laws: DataFrame
    jumps: list[DataFrame]


def versions(laws: DataFrame, edges: DataFrame, law: str, effective: str) -> Versions:
    """The versions of laws (law, effective) by edges (new, old).

    A law ends when the first of those that supersede it takes effect; of several on one day the one with the least id
    counts, those without a date come last. A law that supersedes itself does not. ``newest`` is the last law on the way,
    ``steps`` its distance; a law whose way runs into a circle has none and is ``cyclic``. Edges to or from unknown laws are
    left out. Dates are strings of any precision, or dates.
    """
    text = F.col(effective) if laws.schema[effective].dataType.typeName() == "string" else F.date_format(effective, "yyyy-MM-dd")
    day = date_range(text)
    dated = laws.where(F.col(law).isNotNull()).select(F.col(law).alias("law"), day.alias("d")).groupBy("law").agg(F.min("d").alias("d")).select("law", "d.*")
    dated = written(dated, "laws")
    last = F.lit("9999-12-31").cast("date")
    known = edges.where("new <> old").select("new", "old").distinct().join(dated.select(F.col("law").alias("new"), "low", "high"), "new").join(dated.select(F.col("law").alias("old")), "old")
    first = F.min(F.struct(F.coalesce("low", last).alias("at"), F.col("new").alias("new"), "low", "high")).alias("f")
    follows = known.groupBy("old").agg(first).select(F.col("old").alias("law"), F.col("f.new").alias("next"), F.col("f.low").alias("until"), F.col("f.high").alias("until_high"))
    follows = written(follows, "next")

    # (law, to, steps, done): done once nothing follows ``to``
    heads = follows.select(F.col("law").alias("to"), F.lit(True).alias("_more"))
    way = written(follows.select("law", F.col("next").alias("to"), F.lit(1).alias("steps")).join(heads, "to", "left").select("law", "to", "steps", F.col("_more").isNull().alias("done")), "way")
    # pointers exactly 2**k steps on, where there are as many, and the day by which all laws on them may be in force
    exact = written(follows.select("law", F.col("next").alias("to"), F.coalesce("until", last).alias("low")), "jump")
    jumps, open_rows = [], way.where("NOT done").count()
    while True:
        jumps.append(exact)
        if not open_rows:
            break
        on = way.select(F.col("law").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = way.where("NOT done").join(on, "to").select("law", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"))
        further = exact.select(F.col("law").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        exact = written(exact.join(further, "to").select("law", F.col("_to").alias("to"), F.greatest("low", "_low").alias("low")), "jump")
        way = written(way.where("done").unionByName(moved), "way")
        still = way.where("NOT done").count()
        if still == open_rows:  # no way has ended in a round: the rest run in circles
            break
        open_rows = still
    ends = way.select("law", F.when(F.col("done"), F.col("to")).alias("newest"), F.when(F.col("done"), F.col("steps")).alias("steps"), (~F.col("done")).alias("cyclic"))
    out = dated.join(follows, "law", "left").join(ends, "law", "left")
    out = out.withColumn("cyclic", F.coalesce("cyclic", F.lit(False))).withColumn("newest", F.when(~F.col("cyclic"), F.coalesce("newest", "law")))
    return Versions(written(out.withColumn("steps", F.when(~F.col("cyclic"), F.coalesce("steps", F.lit(0)))), "versions"), jumps)


def status(as_of: Column) -> Column:
    """Of a row of ``Versions.laws`` at a date: 已废止 once what supersedes it may be in force, 未生效 before it may be, 未知
    without a date, else 现行有效."""
    return (
        F.when(F.col("until") <= as_of, REPEALED).when(F.col("low").isNull(), F.when(F.col("next").isNotNull() & F.col("until").isNull(), REPEALED).otherwise(UNKNOWN))
        .when(F.col("low") > as_of, PENDING).when(F.col("next").isNotNull() & F.col("until").isNull(), REPEALED).otherwise(IN_FORCE)
    )


def certain(as_of: Column) -> Column:
    """Whether the date strings are exact enough for that status at that date."""
    began = F.col("low").isNotNull() & ((F.col("high") <= as_of) | (F.col("low") > as_of))
    ended = F.coalesce((F.col("until_high") <= as_of) | (F.col("until") > as_of), F.col("next").isNull())
    return began & ended


def statuses(found: Versions, as_of: str) -> DataFrame:
    """(law, status, certain, newest): each law at a date."""
    day = F.lit(as_of).cast("date")
    return found.laws.select("law", status(day).alias("status"), certain(day).alias("certain"), "newest")


def in_force(found: Versions, as_of: str) -> DataFrame:
    """(law): those in force at a date, as hybrid search asks for."""
    return statuses(found, as_of).where(F.col("status") == IN_FORCE).select("law")


def version_at(rows: DataFrame, found: Versions, law: str, date: str, version: str = "version") -> DataFrame:
    """Add ``version``: what has become of ``law`` by ``date``: the last law on the way from it before one that is not in force
    by then or has no date.

    It is the law itself where nothing has followed yet, and null where the law itself is not in force yet, is unknown, or
    runs into a circle. Each law and date is followed once, from the longest jump to the shortest.
    """
    asked = rows.select(F.col(law).alias("law"), F.col(date).cast("date").alias("date")).where("law IS NOT NULL AND date IS NOT NULL").distinct()
    start = found.laws.where("NOT cyclic").select("law", F.col("low").alias("_from"))
    at = asked.join(start, "law").select("law", "date", F.when(F.col("_from") <= F.col("date"), F.col("law")).alias("at")).where("at IS NOT NULL")
    for jump in reversed(found.jumps):
        step = jump.select(F.col("law").alias("at"), "to", "low")
        at = at.join(step, "at", "left").select("law", "date", F.when(F.col("low") <= F.col("date"), F.col("to")).otherwise(F.col("at")).alias("at"))
    named = at.select(F.col("law").alias("_law"), F.col("date").alias("_date"), F.col("at").alias(version))
    return rows.join(named, (F.col(law) == F.col("_law")) & (F.col(date).cast("date") == F.col("_date")), "left").drop("_law", "_date")


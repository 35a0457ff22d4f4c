"""Chains of laws: against walking them one by one, with circles and dates of every precision."""

import datetime
import random

from pyspark.sql import functions as F

from lexmill.operators import versions as V

DAY = datetime.date


def walk(laws, edges):
    """next of each law, and the way from each to its end, None if it never ends."""
    after = {}
    for new, old in edges:
        if new != old and new in laws and old in laws:
            after[old] = min(after.get(old, (DAY.max, 10**9)), (laws[new] or DAY.max, new))
    after = {old: new for old, (_, new) in after.items()}
    ways = {}
    for law in laws:
        way, at = [law], law
        while at in after and len(way) <= len(laws):
            at = after[at]
            way.append(at)
        ways[law] = way if len(way) <= len(laws) else None
    return after, ways


def test_against_walking(spark):
    rng = random.Random(2)
    laws = {i: DAY(2000, 1, 1) + datetime.timedelta(days=40 * i + rng.randrange(30)) for i in range(60)}
    laws[7] = None
    edges = [(i + 1, i) for i in range(40)] + [(45, 12), (50, 12), (41, 42), (42, 43), (43, 41), (41, 44), (45, 45), (99, 3), (3, 99), (58, 57), (57, 56), (7, 59)]
    rows = spark.createDataFrame([(i, d and d.isoformat()) for i, d in laws.items()], "law int, day string").repartition(3)
    found = V.versions(rows, spark.createDataFrame(edges, "new int, old int").repartition(2), "law", "day")
    after, ways = walk(laws, edges)
    assert ways[41] is None and ways[44] is None and ways[40] == [40]
    for r in found.laws.collect():
        way = ways[r["law"]]
        assert (r["next"], r["newest"], r["steps"], r["cyclic"]) == (after.get(r["law"]), way and way[-1], way and len(way) - 1, way is None)
    days = [DAY(2000, 1, 1) + datetime.timedelta(days=n) for n in range(0, 2600, 37)]
    asked = [(i, d) for i in [*laws, 99, None] for d in days] + [(1, None), (1, days[3]), (1, days[3])]
    got = V.version_at(spark.createDataFrame(asked, "law int, date date"), found, "law", "date").collect()
    assert len(got) == len(asked)
    for r in got:
        want = None
        if r["law"] in laws and r["date"] and ways[r["law"]] and laws[r["law"]] and laws[r["law"]] <= r["date"]:
            for at in ways[r["law"]]:
                if laws[at] is None or laws[at] > r["date"]:
                    break
                want = at
        assert r["version"] == want


def test_precision_and_status(spark):
    assert [tuple(r["d"]) for r in spark.createDataFrame([("2024.3.5",), ("2024-02",), ("2024",), ("soon",), ("2024-13-01",), (None,)], "x string").select(V.date_range(F.col("x")).alias("d")).collect()] == [
        (DAY(2024, 3, 5), DAY(2024, 3, 5), "day"), (DAY(2024, 2, 1), DAY(2024, 2, 29), "month"), (DAY(2024, 1, 1), DAY(2024, 12, 31), "year"),
        (None, None, "none"), (None, None, "none"), (None, None, "none"),
    ]
    laws = [("a", "2020"), ("b", "2021-05"), ("c", "2023-01-01"), ("d", None), ("e", None), ("f", None), ("g", "2019-01-01")]
    edges = [("b", "a"), ("c", "b"), ("e", "d"), ("f", "g")]
    found = V.versions(spark.createDataFrame(laws, "law string, day string"), spark.createDataFrame(edges, "new string, old string"), "law", "day")
    at = lambda day: {r["law"]: (r["status"], r["certain"]) for r in V.statuses(found, day).collect()}
    assert at("2020-06-01")["a"] == ("现行有效", False) and at("2020-12-31")["a"] == ("现行有效", True) and at("2019-06-01")["a"] == ("未生效", True)
    assert at("2021-05-10")["a"] == ("已废止", False) and at("2021-05-31")["a"] == ("已废止", True) and at("2021-05-10")["b"] == ("现行有效", False)
    now = at("2024-01-01")
    assert [now[x] for x in "abc"] == [("已废止", True)] * 2 + [("现行有效", True)]
    assert now["d"] == ("已废止", False) and now["e"] == ("未知", False) and now["g"] == ("已废止", False)
    assert {r["law"] for r in V.in_force(found, "2022-01-01").collect()} == {"b"}


def test_no_edges(spark):
    none = spark.createDataFrame([], "new int, old int")
    found = V.versions(spark.createDataFrame([(1, "2020")], "law int, day string"), none, "law", "day")
    assert [(r["newest"], r["steps"], r["cyclic"]) for r in found.laws.collect()] == [(1, 0, False)]
    assert V.version_at(found.laws.select("law", F.lit("2021-01-01").alias("date")), found, "law", "date").first()["version"] == 1

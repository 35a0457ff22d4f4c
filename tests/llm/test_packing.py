import random
from collections import defaultdict

from pyspark.sql import functions as F

from lexmill.llm import packing


def check(rows, sizes, lengths):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for own in bins.values():
        own.sort(key=lambda r: (r["place"], r["length"]))
        at = 0
        for r in own:
            assert r["place"] == at
            at += r["length"]
        assert {r["bin_length"] for r in own} == {min(x for x in lengths if x >= at)}
    assert set(pieces) == set(sizes)
    for doc_id, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["piece"]):
            assert r["start"] == at
            at += r["length"]
        assert at == sizes[doc_id]
    return bins


def test_plan_holds_everything_once(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 1, 30, 100, 101, 250, rng.randint(1, 260), rng.randint(1, 900)]) for i in range(2000)}
    docs = spark.createDataFrame(list(sizes.items()), "doc_id long, bin_id long").withColumnRenamed("bin_id", "n")
    lengths = (64, 128, 256)
    bins = check(packing.pack(docs, F.col("n"), lengths).collect(), sizes, lengths)
    used = sum(sum(r["length"] for r in own) for own in bins.values())
    assert used / sum(own[0]["bin_length"] for own in bins.values()) > 0.97


def test_best_fit_prefers_the_fullest_sequence():
    bins, places, used = packing.best_fit([6, 5, 4, 3], [10], lambda size, left: 10)
    assert (bins, places, used) == ([0, 1, 0, 1], [0, 0, 6, 5], [10, 8])
    assert packing.cheapest([100], (64, 128, 256), float)[2] == [128]


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, "")], "doc_id long, text string")
    rows = packing.pack(docs, packing.words()).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert packing.pack(docs.where("false"), packing.words()).count() == 0


def least_total(sizes, lengths):
    """The least cost of any partition of the sizes into sequences."""
    cost = lambda n: packing.sequence_cost(min(x for x in lengths if x >= n))

    def search(k, bins):
        if k == len(sizes):
            return sum(map(cost, bins))
        tries = {b: i for i, b in enumerate(bins) if b + sizes[k] <= max(lengths)}  # equal bins are tried once
        found = [search(k + 1, [*bins[:i], b + sizes[k], *bins[i + 1 :]]) for b, i in tries.items()]
        return min([*found, search(k + 1, [*bins, sizes[k]])])

    return search(0, [])


def test_cost_against_the_optimum_of_small_cases():
    rng, lengths = random.Random(2), (64, 128, 256)
    ours = best = 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 256) for _ in range(rng.randint(1, 7))), reverse=True)
        bins, _, final = packing.cheapest(sizes, lengths, packing.sequence_cost)
        for b, length in enumerate(final):
            used = sum(s for s, x in zip(sizes, bins) if x == b)
            assert length == min(x for x in lengths if x >= used)
        total, optimum = sum(map(packing.sequence_cost, final)), least_total(sizes, lengths)
        assert optimum <= total <= 1.25 * optimum
        ours, best = ours + total, best + optimum
    assert ours <= 1.03 * best


def test_ties_clashing_names_and_many_repeats(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 500)
    docs = spark.range(6000).selectExpr("cast(null as long) as doc_id", "'a b c' as text", "id as size", "id as row", "'x' as piece")
    found = packing.pack(docs, packing.words())
    sizes = [r["count"] for r in found.groupBy(F.shiftright("bin_id", 32).alias("g")).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1000
    assert found.agg(F.sum("length")).first()[0] == 18000

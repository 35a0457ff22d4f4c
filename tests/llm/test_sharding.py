from pyspark.sql import functions as F

from lexmill.llm.sharding import shard_by_bytes


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, size long, shard_name string").withColumn("tie", F.xxhash64("size", "shard_name"))


def check(rows, shards):
    rows = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["slot"] for r in rows] == [i for s in range(shards) for i in range(sum(r["shard"] == s for r in rows))]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(shards):
        assert abs(sum(r["size"] for r in rows if r["shard"] == s) - total / shards) <= largest


def test_balanced_and_contiguous(spark):
    rows = [(i, 1 + (i * 7919) % 101, "x") for i in range(1000)]
    check(shard_by_bytes(frame(spark, rows), 8).collect(), 8)


def test_one_key_holds_most_rows_nulls_and_repeats(spark):
    rows = [(5, 1 + i % 9, str(i % 50)) for i in range(400)] + [(i, 3, "y") for i in range(100)] + [(None, 2, None)] * 20
    out = shard_by_bytes(frame(spark, rows), 4).collect()
    assert len(out) == 520
    check(out, 4)


def test_empty(spark):
    assert shard_by_bytes(frame(spark, []), 8).count() == 0


def test_shards_and_slots_against_running_sums(spark):
    import random

    rng = random.Random(6)
    rows = [(rng.choice([None, *range(-50, 400)]), rng.choice([1, 5, 5, 300]), f"n{i}") for i in range(700)]
    docs = frame(spark, rows).withColumn("_range", F.lit(1)).withColumn("extra", F.lit("x"))
    out = shard_by_bytes(docs.drop("_range"), 5).collect()
    assert {r["extra"] for r in out} == {"x"}
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]))
    total, before, want, seen = sum(r["size"] for r in order), 0, {}, {}
    for r in order:
        shard = min(4, (2 * before + r["size"]) * 5 // (2 * total))
        want[r["shard_name"]] = (shard, seen.setdefault(shard, 0))
        seen[shard] += 1
        before += r["size"]
    assert {r["shard_name"]: (r["shard"], r["slot"]) for r in out} == want

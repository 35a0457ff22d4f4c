import random
import re
from itertools import combinations
from pathlib import Path

import numpy as np

from lexmill.llm import jaccard
from lexmill.llm.runtime import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= 80 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(docs):
        groups.setdefault(find(k), []).append(i)
    return sorted((i, len(sets[k]), min(groups[find(k)])) for k, (i, _) in enumerate(docs))


def edited(rng, words, share):
    return [rng.choice(["x", "y", "z"]) + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def test_components_against_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 14)):  # chains of edits, so that components are wider than their links
            texts.append(" ".join(base))
            base = edited(rng, base, rng.choice([0.01, 0.03, 0.06]))
    passage = " ".join(f"p{i}" for i in range(60))  # a passage that many unlike documents share
    texts += [passage + " " + " ".join(f"q{rng.randrange(1000)}" for _ in range(60)) for _ in range(60)]
    texts += ["a b c", "A b  C", "a b c d", "", " \n", "one", "one", "a a a a a a a a", "a a a a a"] + [texts[3], texts[3].upper()]
    rng.shuffle(texts)
    docs = [(3 * i, t) for i, t in enumerate(texts)] + [(100_000, None)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_shingles int")
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame).collect())
    assert rows == brute(docs)


def test_prefix_size_is_enough():
    for n in range(1, 300):
        keep = int(jaccard.prefix_size(np.array([n]))[0])
        assert n - keep < -(-4 * n // 5) <= n - keep + 1
    assert jaccard.prefix_size(np.array([0]))[0] == 0


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(None, text), (None, text), (5, text), (5, text), (2, "other words here now then"), (None, None)]
    rows = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (-1, 5), (-1, 5), (2, 2), (5, 5), (5, 5)]


def test_rows_of_one_id_with_other_texts(spark):
    """They are one document: what links to any of its texts is linked to all of them, over several such ids too."""
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"}
    docs = [(5, "a"), (5, "b"), (3, "a"), (7, "b"), (9, "c"), (9, "d"), (9, "e"), (8, "e"), (8, "f"), (7, "f"), (20, "c"), (None, "d"), (None, "a"), (30, "x")]
    rows = jaccard.near_duplicates(spark.createDataFrame([(i, texts.get(k, "alone")) for i, k in docs], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in rows) == sorted((i or -1, 30 if i == 30 else 3) for i, _ in docs)


def test_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_large_group_of_unlike_near_copies(spark):
    """Copies of a text that is not there itself, most of them less than 80 % alike: no pair may become a row."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(0, 120, 4), rng.randint(1, 5)):
            words[at] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame).collect())
    assert rows == brute(docs)


def test_cells_do_not_depend_on_their_size(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(edited(rng, base, 0.05))) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "CELL_TOKENS", 700)
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame).collect())
    assert rows == brute(docs)


def test_near_copies_without_an_id(spark):
    words = [f"w{i}" for i in range(200)]
    near = [*words[:150], "other", *words[151:]]
    far = [*words[:100], "more", *words[101:150], "other", *words[151:]]
    docs = [(5, " ".join(words)), (None, " ".join(near)), (9, " ".join(far)), (None, "alone " * 20), (None, "b c d e f g"), (None, "b c d e f g h")]
    rows = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (-1, -1), (-1, -1), (-1, 5), (5, 5), (9, 5)]


def test_links_through_a_row_without_an_id(spark):
    words = [f"w{i}" for i in range(100)]
    step = lambda k: " ".join([*(f"v{i}" for i in range(6 * k)), *words[6 * k :]])
    docs = [(7, step(0)), (None, step(1)), (8, step(2))]
    found = brute([(1, step(0)), (2, step(1)), (3, step(2))])
    assert [r[2] for r in found] == [1, 1, 1] and [r[2] for r in brute([(1, step(0)), (3, step(2))])] == [1, 3]
    rows = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in rows} == {7}


def test_many_repeats_of_one_row(spark):
    text = " ".join(f"w{i}" for i in range(30))
    frame = spark.range(50_000).selectExpr("cast(3 as long) as doc_id", f"'{text}' as text").unionByName(spark.createDataFrame([(2, text)], "doc_id long, text string"))
    rows = jaccard.near_duplicates(frame).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, rows)) == [(2, 2, 1), (3, 2, 50_000)]


def test_files_between_steps_grow_with_the_texts_not_with_the_partitions(spark):
    """At 64 shuffle partitions, which are not coalesced, small steps wrote a file for each: some 300 files in all, and
    each costs child processes of an executor."""
    rng = random.Random(5)
    base = [[f"w{rng.randrange(9000)}" for _ in range(60)] for _ in range(60)]
    docs = [(k, " ".join(edited(rng, base[k % 60], 0.01))) for k in range(300)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    parts = lambda: set(Path(shared_dir(spark)).glob("lexmill-*/part-*"))
    old = parts()
    try:
        found = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
        assert sorted(tuple(r)[:3] for r in found.collect()) == brute(docs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(parts() - old) <= 30


def test_bit_table_is_packed_where_it_is_broadcast(spark):
    ids = [0, 1, 5, 10**12, -3]
    bits = jaccard.id_filter(spark.createDataFrame([(i,) for i in ids], "id long"))
    assert bits.nbytes == jaccard.FILTER_BITS // 8
    found = jaccard.is_set(bits, jaccard.bit_of(np.array([*ids, *range(100, 1100)])))
    assert found[: len(ids)].all() and not found[len(ids) :].any()


def test_a_step_of_components_is_compared_without_a_join(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11)], "a long, b long")
    found = jaccard.components(links, "test", 2)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = [store.executionsList(before, 100).apply(k).physicalPlanDescription() for k in range(store.executionsCount() - before)]
    assert plans and not any("LeftAnti" in p for p in plans)
    assert sorted(tuple(r) for r in found.collect()) == [(2, 1), (3, 1), (4, 1), (11, 10)]

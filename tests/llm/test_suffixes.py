import random
import tracemalloc

import numpy as np
import pytest

from lexmill.llm import arrays as A
from lexmill.llm import exchange as X
from lexmill.llm import suffixes


def brute(docs):
    least = {}
    order = lambda i: float("inf") if i is None else i
    for doc_id, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            key = data[i : i + 50]
            least[key] = min(least.get(key, float("inf")), order(doc_id))
    out = []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 49):
            if least[data[i : i + 50]] < order(doc_id):
                gone[i : i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


@pytest.mark.parametrize("depth", [1, 4, 9])
def test_merged_transforms_sort_and_bound_prefixes(depth, monkeypatch):
    rng = np.random.default_rng(depth)
    for _ in range(150):
        sizes = rng.integers(depth, 30, rng.integers(1, 12))
        text = rng.integers(97, 99, sizes.sum()).astype(np.uint8)
        monkeypatch.setattr(suffixes, "SHARD_BYTES", int(rng.integers(20, 200)))
        place, block = suffixes.intervals(text, sizes, depth)
        shared, part = suffixes.intervals(text, sizes, depth, singles=False)
        want = {i: bytes(text[i : i + depth]) for s, z in zip(np.cumsum(sizes) - sizes, sizes) for i in range(s, s + z - depth + 1)}
        found = [want[p] for p in place.tolist()]
        assert sorted(place.tolist()) == sorted(want) and found == sorted(found)
        assert (np.diff(block) != 0).tolist() == [a != b for a, b in zip(found, found[1:])]
        # without those that are alone
        again = [want[p] for p in shared.tolist()]
        assert again == [x for x in found if found.count(x) > 1] and len(set(shared.tolist())) == len(shared)
        assert (np.diff(part) != 0).tolist() == [a != b for a, b in zip(again, again[1:])]


def corpus():
    rng = random.Random(8)
    line = lambda n: "".join(rng.choices("abcdé 中\n", k=n))
    shared = [line(rng.randint(30, 130)) for _ in range(8)]
    docs = []
    for i in range(160):
        parts = [line(rng.randint(0, 80)) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        docs.append((i * 2, "".join(parts)))
    docs += [(1, docs[3][1]), (500, docs[3][1]), (None, docs[3][1]), (None, docs[5][1]), (4, None), (6, ""), (6, docs[40][1]), (6, docs[40][1])]
    return docs + [(700, "a" * 400), (701, "a" * 60), (702, "a" * 49), (703, "ab" * 100), (704, "xab" + "ab" * 60)]


@pytest.mark.parametrize(("common", "part_bytes"), [(suffixes.COMMON, suffixes.PART_BYTES), (1, suffixes.PART_BYTES), (10**6, 300)])
def test_against_brute_force(spark, common, part_bytes):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, mark string")
    rows = suffixes.drop_repeated_bytes(frame, common=common, part_bytes=part_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rows), key=key)
    assert found == sorted(brute(docs), key=key)


def test_empty_table(spark):
    assert suffixes.drop_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_short_document(spark):
    row = suffixes.drop_repeated_bytes(spark.createDataFrame([(1, "ten bytes.")], "doc_id long, text string")).first()
    assert (row["n_bytes"], row["n_removed"], bytes(row["kept"])) == (10, 0, b"ten bytes.")


def test_runs_of_windows_are_hashed_in_pieces(monkeypatch):
    """Tables over all bytes of a batch left the cache and were most of the query's time: 8 MB each for 1 MB of text."""
    rng = np.random.default_rng(4)
    sizes = [0, 49, 50, 51, 200, 0, 3000, 77, 50, 12, 400_000]
    data = rng.integers(97, 100, sum(sizes)).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    tracemalloc.start()
    runs = suffixes.byte_marks(data, offsets, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 * len(data)
    monkeypatch.setattr(suffixes, "PIECE", 100)
    for a, b in zip(runs, suffixes.byte_marks(data, offsets, 64)):
        assert a.tolist() == b.tolist()
    heads, size, marks, owner = runs
    got = {int(h) + i: (int(m), int(o)) for h, n, m, o in zip(heads, size, marks, owner) for i in range(n)}
    grams = A.gram_hashes(A.letters(data), suffixes.GRAM)
    least = X.short(np.array([grams[k : k + suffixes.LONGEST].min() for k in range(len(data) - sizes[-1])]), 64)
    for k, (a, b) in enumerate(zip(offsets[:-2], offsets[1:-1])):
        for at in range(a, b - suffixes.WINDOW + 1):
            assert got.pop(at) == (int(least[at]), k)
    assert all(o == len(sizes) - 1 for _, o in got.values()) and len(got) == sizes[-1] - suffixes.WINDOW + 1

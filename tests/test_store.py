"""The chunk store: runs, versions, what interrupts a batch, merging."""

import math
import random

import pytest

from lexmill.sources import files
from lexmill.streaming import ingest, store
from lexmill.streaming.store import Run


def batch(spark, pages):
    """pages: id -> number of chunks, None for a page that is gone."""
    chunks = [("s", i, k, None, None, f"第{k}条", f"page {i} of {n} chunks", f"s/{i}::{k}") for i, n in pages.items() for k in range(n or 0)]
    return spark.createDataFrame([(i, n is None) for i, n in pages.items()], store.PAGES), spark.createDataFrame(chunks, store.CHUNKS)


def held(spark, path, version=None):
    found = {}
    for r in store.read_store(spark, path, version).collect():
        found.setdefault(r["page_id"], []).append(r["body"])
    return {i: len(b) for i, b in found.items() if set(b) == {f"page {i} of {len(b)} chunks"}}


def test_versions_and_merging(spark, tmp_path):
    """Random batches with changed, repeated and gone pages, a page without an id: every version reads as it was."""
    rng, path = random.Random(1), str(tmp_path / "store")
    want, history = {}, {}
    assert held(spark, path) == {}
    for number in range(9):
        pages = {rng.choice([*range(12), None]): rng.choice([None, 1, 2, 3]) for _ in range(rng.randint(1, 8))}
        now = store.add_run(spark, path, "a", number, lambda: batch(spark, pages))  # noqa: B023
        want = {i: n for i, n in {**want, **pages}.items() if n}
        assert held(spark, path) == want
        history[now.version] = want
        merged = store.compact(spark, path)
        assert held(spark, path) == want
        history[merged.version] = want
        assert len(merged.runs) <= 2 + math.log2(number + 1)
        assert [r.first for r in merged.runs[1:]] == [r.last + 1 for r in merged.runs[:-1]]
    assert all(held(spark, path, v) == rows for v, rows in list(history.items())[::3])
    lost = store.vacuum(spark, path, keep=1)
    assert lost and held(spark, path) == want and files.names(spark, f"{path}/runs") == sorted(r.name for r in store.manifest(spark, path).runs)


def test_gone_pages_are_forgotten_at_last(spark, tmp_path):
    path = str(tmp_path / "store")
    store.add_run(spark, path, "a", 0, lambda: batch(spark, {1: 1}))
    store.add_run(spark, path, "a", 1, lambda: batch(spark, {1: None, 2: 1}))
    run = store.compact(spark, path).runs
    assert len(run) == 1 and [r["page_id"] for r in spark.read.parquet(f"{path}/runs/{run[0].name}/pages").collect()] == [2]


def test_interrupted_and_repeated_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.add_run(spark, path, "a", 0, lambda: batch(spark, {1: 2, 2: 1}))
    with monkeypatch.context() as m:
        m.setattr(store, "published", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):  # the run is written, but not published
            store.add_run(spark, path, "a", 1, lambda: batch(spark, {1: None, 3: 1}))
        with pytest.raises(ZeroDivisionError):
            store.compact(spark, path, ratio=10**9) if len(store.manifest(spark, path).runs) > 1 else 1 / 0
    assert held(spark, path) == {1: 2, 2: 1} and len(files.names(spark, f"{path}/runs")) == 2
    for _ in range(3):  # once more, and again after it was published
        store.add_run(spark, path, "a", 1, lambda: batch(spark, {1: None, 3: 1}))
    assert held(spark, path) == {2: 1, 3: 1} and store.manifest(spark, path).version == 2
    store.add_run(spark, path, "b", 0, lambda: batch(spark, {2: 3}))  # another stream counts its own batches
    assert held(spark, path) == {2: 3, 3: 1}
    assert len(store.vacuum(spark, path)) == 1 and held(spark, path) == {2: 3, 3: 1}
    with pytest.raises(FileExistsError):
        files.publish(spark, f"{path}/manifests/{store.manifest(spark, path).version:012d}.json", "{}")


def test_what_is_merged():
    runs = lambda *sizes: tuple(Run(str(i), i, i, n) for i, n in enumerate(sizes))
    assert [store.due(runs(*s)) for s in ((), (5,), (5, 5), (100, 5), (100, 5, 5), (30, 5, 5, 5), (19, 5, 5), (8, 4, 2, 1), (8, 5, 3, 2))] == [0, 0, 2, 0, 2, 3, 3, 0, 4]
    # one batch after another of equal size: each is written again a logarithmic number of times
    sizes, written = [], 0
    for _ in range(1024):
        sizes.append(1)
        written += 1
        count = store.due(runs(*sizes))
        if count:
            sizes[-count:] = [sum(sizes[-count:])]
            written += sizes[-1]
        assert len(sizes) <= 11
    assert written < 1024 * 12


def test_a_batch_writes_what_came(spark, tmp_path):
    """The bytes of a batch's run do not depend on the store."""
    path = str(tmp_path / "store")
    for number, n in enumerate((2000, 20, 20)):
        store.add_run(spark, path, "a", number, lambda: batch(spark, {n * 1000 + i: 1 for i in range(n)}))  # noqa: B023
    large, small, again = (r.bytes for r in store.manifest(spark, path).runs)
    assert large > 3 * small and abs(small - again) < small / 5


def test_stream_with_pages_that_go(spark, tmp_path):
    inbox, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "progress"))
    schema = "page_id long, url string, html string"
    for rows in ([(1, "https://a/x", "<p>one"), (2, "https://a/y", "<p>two")], [(1, "https://a/x", None), (2, "https://a/y", "<p>new")], [(3, "https://b/z", "<p>three")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        ingest.stream_ingest(spark, inbox, out, checkpoint, schema)
        ingest.stream_ingest(spark, inbox, out, checkpoint, schema)  # nothing new
    found = {r["page_id"]: r["body"] for r in store.read_store(spark, out).collect()}
    assert found == {2: "new", 3: "three"} and store.manifest(spark, out).done == {checkpoint: 2}

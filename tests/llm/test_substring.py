import random
import re

import pytest

from lexmill.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    least = {}
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        for i in range(len(words) - 49):
            key = tuple(words[i : i + 50])
            mine = float("inf") if doc_id is None else doc_id
            least[key] = min(least.get(key, float("inf")), mine)
    out = []
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 49):
            if least[tuple(words[i : i + 50])] < (float("inf") if doc_id is None else doc_id):
                gone[i : i + 50] = [True] * 50
        out.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "中文", "x"]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = [line(rng.randint(45, 130)) for _ in range(6)]
    docs = []
    for i in range(150):
        parts = [line(rng.randint(0, 60)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(shared))
        docs.append((i * 2, rng.choice(["\n", " ", "\t "]).join(parts)))
    docs += [(1, docs[3][1]), (500, docs[3][1]), (None, docs[3][1]), (None, docs[5][1]), (4, None), (6, ""), (8, " \n"), (6, docs[40][1]), (6, docs[40][1])]
    docs += [(700, "a " * 400), (701, "a " * 60), (702, "a " * 49)]
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, keys string")
    rows = substring.drop_repeated_passages(frame, ingests=2).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in rows), key=key)
    assert found == sorted(brute(docs), key=key)
    assert all(r["n_removed"] == sum(s["stop"] - s["start"] for s in r["spans"]) for r in rows)


def found_rows(rows):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in rows), key=key)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_ingests_equal_one_call(spark, tmp_path, batches, monkeypatch):
    """Batches of ascending ids, each ingested by a call of its own with the stored runs only, give what one call over
    all gives; the earlier documents are only read for fingerprints that had one owner."""
    monkeypatch.setattr(substring, "FANOUT", 3)
    docs = sorted(corpus(), key=lambda d: (d[0] is None, d[0] or 0))
    frame = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(docs)], "k int, doc_id long, text string")
    # equal ids may not be told apart by a cut
    cut = lambda n: next(k for k in range(len(docs) * n // batches, len(docs) + 1) if k in (0, len(docs)) or docs[k][0] != docs[k - 1][0])
    index, rows = f"{tmp_path}/index", []
    for n in range(batches):
        part = frame.where(f"k >= {cut(n)} AND k < {cut(n + 1)}")
        rows += substring.ingest(part, index, frame.where(f"k < {cut(n)}")).collect()
    assert found_rows(rows) == found_rows(substring.drop_repeated_passages(frame, ingests=1).collect())
    runs = substring.runs_of(spark, index)
    assert len(runs) == 1 if batches == 1 else 1 < len(runs) <= 3
    for run in runs:  # sorted, each key once
        for r in spark.read.schema(substring.STORED).parquet(run.path).where("kind > 0").collect():
            keys = [k % 2**64 for k in r["keys"]]
            assert keys == sorted(keys) and (r["kind"] == substring.WINDOWS_RUN or len(set(keys)) == len(keys))


def test_runs_of_fewer_buckets(spark, tmp_path, monkeypatch):
    """An index made with few buckets serves an ingest that needs more."""
    docs = [d for d in corpus() if d[0] is not None and d[0] % 2 == 0]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = f"{tmp_path}/index"
    first = substring.ingest(frame.where("doc_id < 150"), index).collect()
    monkeypatch.setattr(substring.X, "bucket_count", lambda docs, total: 200)
    second = substring.ingest(frame.where("doc_id >= 150"), index, frame.where("doc_id < 150")).collect()
    assert [r.buckets for r in substring.runs_of(spark, index)] == [64, 200]
    assert found_rows([*first, *second]) == found_rows(substring.drop_repeated_passages(frame, ingests=1).collect())


def test_history_is_needed(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    first, second = (spark.createDataFrame([(i, text)], "doc_id long, text string") for i in (10, 20))
    index = f"{tmp_path}/index"
    substring.ingest(first, index).collect()
    with pytest.raises(ValueError, match="history"):
        substring.ingest(second, index)
    assert [r["n_removed"] for r in substring.ingest(second, index, first).collect()] == [80]


def test_only_called_rows_of_the_history(spark, monkeypatch):
    """Every row that is called stays; with as many bits as there are, others do not; with few bits, some do."""
    history = spark.range(2000).selectExpr("IF(id % 50 = 0, NULL, id) AS doc_id", "IF(id % 7 = 0, NULL, concat('text ', id % 900)) AS text")
    rows = history.selectExpr("xxhash64(doc_id, text) AS row", "doc_id", "text")
    calls = rows.where("doc_id % 3 = 0").selectExpr("row", "explode(array(1L, 2L)) AS key")
    key = lambda r: (r["row"], r["doc_id"] or -1, r["text"] or "")
    wanted = sorted(map(key, rows.where("doc_id % 3 = 0").collect()))
    assert sorted(map(key, substring.called(history, calls).collect())) == wanted
    monkeypatch.setattr(substring, "CALL_BITMAPS", 1)
    monkeypatch.setattr(substring, "BITMAP_BITS", 1024)
    loose = sorted(map(key, substring.called(history, calls).collect()))
    assert set(wanted) <= set(loose) and len(wanted) < len(loose) < 2000
    assert substring.called(history, calls.where("false")).count() == 0


def test_a_batch_that_is_not_added(spark, tmp_path):
    docs = [d for d in corpus() if d[0] is not None]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = f"{tmp_path}/index"
    first, second = frame.where("doc_id < 150"), frame.where("doc_id >= 150")
    assert found_rows(substring.ingest(first, index, add=False).collect()) == found_rows(substring.ingest(first, index).collect())
    runs = substring.runs_of(spark, index)
    tried = found_rows(substring.ingest(second, index, first, add=False).collect())
    assert substring.runs_of(spark, index) == runs and len(runs) == 1
    assert tried == found_rows(substring.ingest(second, index, first).collect()) and len(substring.runs_of(spark, index)) == 2


def test_empty_table(spark):
    assert substring.drop_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_short_document(spark):
    text = "one two three four five six seven eight nine ten"
    row = substring.drop_repeated_passages(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_removed"], bytes(row["kept"]).decode()) == (10, 0, text)


def test_the_plan_of_an_ingest_holds_each_step_few_times(spark, tmp_path, monkeypatch):
    """A plan with many copies of its steps fills the driver: each stage that ends, the whole plan is planned and told anew."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = {}, DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        plans[path] = self._df._jdf.queryExecution().executedPlan().toString()
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    docs = [d for d in corpus() if d[0] is not None]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = f"{tmp_path}/index"
    first, second = frame.where("doc_id < 150"), frame.where("doc_id >= 150")
    rows = [*substring.ingest(first, index).collect(), *substring.ingest(second, index, first).collect()]
    assert found_rows(rows) == found_rows(brute_rows(docs))
    one, two = (plans[run.path] for run in substring.runs_of(spark, index))
    assert one.count("CoGroup") <= 7 and two.count("CoGroup") <= 7, two


def brute_rows(docs):
    return [{"doc_id": i, "n_words": n, "n_removed": gone, "kept": kept.encode()} for i, n, gone, kept in brute(docs)]


def test_files_of_a_run_grow_with_the_texts_not_with_the_partitions(spark, tmp_path):
    """At 64 shuffle partitions, which are not coalesced, a run had a file for each of most of them."""
    rng = random.Random(8)
    passages = [[f"w{rng.randrange(9000)}" for _ in range(80)] for _ in range(30)]
    docs = [(k, " ".join(rng.choice(passages) + [f"v{rng.randrange(9000)}" for _ in range(60)] + rng.choice(passages))) for k in range(200)]
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        table = spark.createDataFrame(docs, "doc_id long, text string")
        found = substring.ingest(table, str(tmp_path / "index"))
        out = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in found.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(out) == sorted(brute(docs))
    assert len(list((tmp_path / "index").glob("run-*/part-*"))) <= 2  # one batch of texts


def test_manifest_is_read_without_join_or_sort(spark, tmp_path):
    index = f"{tmp_path}/index"
    runs = [substring.Run(f"{index}/run-{k}", 64, k) for k in (3, 1, 2)]
    substring.publish(spark, index, runs[:1])
    substring.publish(spark, index, runs)
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    assert substring.runs_of(spark, index) == runs
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = [store.executionsList(before, 100).apply(k).physicalPlanDescription() for k in range(store.executionsCount() - before)]
    assert plans and not any("Join" in p or "Sort" in p for p in plans)

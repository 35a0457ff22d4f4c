import random

import corpus_pipeline
from lexmill.llm import substring


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    clean = [" ".join(word() for _ in range(rng.randint(60, 200))) for _ in range(60)]
    passage = " ".join(word() for _ in range(70))
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[3]), (101, clean[4].upper()), (102, clean[5] + " tail"), (103, clean[6] + " " + passage), (104, passage + " " + clean[7])]
    rows += [(105, passage), (200, "too short"), (201, None), (202, ""), (203, "spam spam spam " * 50), (None, " ".join(word() for _ in range(80)))]
    documents = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, left = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
        left[name] = {r["doc_id"]: r for r in docs.collect()}
    originals = {*range(60), 103, 104, None}
    assert set(left["quality_rules"]) == originals | {100, 101, 102, 105}
    assert set(left["near_duplicates"]) >= originals - {103, 104} and not {100, 101, 102} & set(left["near_duplicates"])
    after = left["substring_dedup"]
    assert 105 not in after and all(after[i]["text"] == clean[i] for i in range(60))
    if 104 in after:
        assert passage not in after[104]["text"] and after[104]["n_chars"] == len(after[104]["text"])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(after)
    assert sum(r["length"] for r in packed) == sum(len(r["text"].split()) for r in after.values())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)


def test_rows_without_an_id_are_kept_apart(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    rows = [(5, a), (None, a), (None, a + " tail"), (None, b), (None, c), (None, c), (None, c + " tail"), (None, ""), (None, None), (6, b + " tail x"), (7, d), (7, d)]
    docs = frame(spark, [(i, t, "en", "src", len(t or "")) for i, t in rows])
    left = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    kept = [(r["doc_id"], r["text"]) for r in left]
    assert (5, a) in kept and (6, b + " tail x") in kept and kept.count((7, d)) == 2
    unnamed = [t for i, t in kept if i is None]
    assert len(unnamed) == 3 and "" in unnamed and None in unnamed
    assert len({c, c + " tail"} & set(unnamed)) == 1


def test_clashing_names(spark, tmp_path):
    rng = random.Random(13)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    same = text()
    docs = frame(spark, [(i, text(), "en", "s", 1, i, "x", i, i) for i in range(5)] + [(8, same, "en", "s", 1, 8, "x", 8, 8), (9, same, "en", "s", 1, 9, "x", 9, 9)], ", _gone long, _counts string, row long, key long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_gone", "_counts", "row", "key"]
    found = docs.collect()
    assert sorted(r["doc_id"] for r in found) == [0, 1, 2, 3, 4, 8]
    assert all((r["_gone"], r["_counts"], r["row"], r["key"]) == (r["doc_id"], "x", r["doc_id"], r["doc_id"]) for r in found)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 6


def test_passages_go_through_the_index(spark, monkeypatch):
    """The stage holds each range of ids against the runs of those before, merged ones too, and calls earlier texts;
    what is left is what one batch against itself leaves."""
    rng = random.Random(14)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    shared = [words(rng.randint(50, 90)) for _ in range(12)]
    rows = [(i, " ".join([words(rng.randint(0, 40)), *([rng.choice(shared)] if i % 3 else []), words(rng.randint(0, 40))])) for i in range(200)]
    rows += [(None, words(9) + " " + shared[0]), (None, shared[1]), (300, shared[2]), (40, shared[3]), (41, None), (42, "")]
    docs = frame(spark, [(i, t, "en", "src", len(t or "")) for i, t in rows]).cache()
    runs, called_rows, published, called = [], [], substring.publish, substring.earlier_windows

    def publish(spark, index, now):
        runs.append(len(now))
        published(spark, index, now)

    def earlier_windows(history, calls, buckets):
        calls = calls.localCheckpoint()
        called_rows.append(calls.count())
        return called(history, calls, buckets)

    monkeypatch.setattr(substring, "publish", publish)
    monkeypatch.setattr(substring, "earlier_windows", earlier_windows)
    left = corpus_pipeline.substring_dedup(spark, docs, "").collect()
    assert runs == [1, 2, 3, 4, 1, 2] and len(called_rows) == 4 and sum(called_rows) > 0
    monkeypatch.undo()

    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    texts = lambda r: [d[1] for d in rows if d[0] == r["doc_id"]]
    found = substring.drop_repeated_passages(docs, ingests=1).collect()
    gone = [r for r in found if r["n_removed"] and r["n_removed"] == r["n_words"]]
    assert gone and sum(0 < r["n_removed"] < r["n_words"] for r in found) > 50
    wanted = [(r["doc_id"], bytes(r["kept"]).decode()) for r in found if r not in gone]
    assert sorted(((r["doc_id"], " ".join((r["text"] or "").split())) for r in left), key=key) == sorted(wanted, key=key)
    assert all(r["n_chars"] == len(r["text"] or "") for r in left)
    assert all(r["text"] in texts(r) for r in left if r["doc_id"] is not None and r["doc_id"] < 200 and not r["doc_id"] % 3)

"""Saved pages as files, and printed pages read back."""

from pyspark.sql import functions as F

from lexmill.operators import classify
from lexmill.sources.tables import page_files, read_page_files


def saved(tmp_path):
    folder = tmp_path / "pages"
    for name, data in {"a/1.html": "中文 one".encode(), "a/2.html": "中文".encode("gb18030"), "b/3.htm": b"\xff\xfe\xff", "b/4.html": b"", "b/9.html": b"not asked for", "c/1.html": b"second of its name", "c/5.txt": b"no page"}.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    return str(folder)


def test_files_of_a_manifest(spark, tmp_path):
    files = page_files(spark, saved(tmp_path) + "/*", "*.htm*")
    manifest = spark.createDataFrame([(n, f"title {n}") for n in ("1", "2", "3", "4", "5", "6")] + [(None, "no name")], "name string, title string")
    found = {r["name"]: r for r in read_page_files(manifest, files, "name").collect()}
    assert {n: (r["text"], r["encoding"], r["missing"]) for n, r in found.items()} == {
        "1": ("中文 one", "utf-8", False), "2": ("中文", "gb18030", False), "3": ("���", "lossy", False), "4": (None, None, True),
        "5": (None, None, True), "6": (None, None, True), None: (None, None, True),
    }
    assert found["1"]["path"].endswith("a/1.html") and found["2"]["n_bytes"] == 4 and found["6"]["title"] == "title 6"


def test_only_the_folders_asked_for_are_read(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(30).select("id", F.concat(F.lit("page "), "id").alias("value")).write.partitionBy("id").text(path)
    manifest = spark.createDataFrame([(3,), (77,)], "id int")
    found = read_page_files(manifest, page_files(spark, path), "id")
    assert {r["id"]: r["text"] for r in found.collect()} == {3: "page 3\n", 77: None}


def test_files_as_a_stream(spark, tmp_path):
    folder = saved(tmp_path)
    query = page_files(spark, folder + "/*", "*.html", stream=True).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["name"] for r in spark.table("arrived").collect()) == ["1", "1", "2", "9"]


def test_heads_and_feet(spark):
    pages = [["GB 1—2025", "- {n} -", "first {n}", "same everywhere", "Fig. 2 x", "last {n}", "{n}{n}{n}{n}{n}", "5", "Foot iv"] for n in range(4)]
    rows = [(1, n, k, line.format(n=n)) for n, page in enumerate(pages) for k, line in enumerate(page)]
    rows += [(2, n, k, line) for n in range(2) for k, line in enumerate(["Head 1", "text", "…… 3", "Ⅳ", "A title", " "])] + [(3, 0, 0, None), (None, 0, 0, "kept"), (None, 1, 0, "also")]
    found = classify.page_text(spark.createDataFrame(rows, "doc int, page int, pos int, line string").repartition(3), "doc", "page", "pos", "line", r"^Fig\. [0-9]", "A title")
    got = {}
    for r in found.orderBy("doc", "page", "pos").collect():
        got.setdefault(r["doc"], []).append(r["line"])
    # "last" stands on the second but last place only after what follows it is gone; a document of two pages has no heads
    assert got == {1: [x for n in range(4) for x in (f"first {n}", "same everywhere", f"last {n}")], 2: ["Head 1", "text"] * 2, None: ["kept", "also"]}


def test_numbers_at_the_end(spark):
    rows = [(1, 0, k, line) for k, line in enumerate(["12345", "text", "11111", "22222", "33333"])]
    found = classify.page_text(spark.createDataFrame(rows, "doc int, page int, pos int, line string"), "doc", "page", "pos", "line")
    assert [r["line"] for r in found.orderBy("pos").collect()] == ["12345", "text", "11111"]

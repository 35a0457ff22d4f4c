import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import fim as M

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute_force(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(2)
    words = ["a", "é", "中文", "😀", "<P", ">", "<", "S>", "word", "x" * 300, "\x01", "\xa0", " "]
    for i in range(400):
        yield "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b", "  "]) for _ in range(rng.randint(0, 40))) + rng.choice(["", "end"])
    yield from (None, "", " ", "\n\n", "one", " one ", "<P>", "a <M> b", "x" * 300_000, "y " * 200_000, ("z" * 5000 + " ") * 100 + "w " * 9000)


def test_against_brute_force(spark):
    """Each text under several ids, a null and a repeated one, and names that the operator uses itself."""
    rows = [(i, t) for k, t in enumerate(texts()) for i in ([*range(3 * k, 3 * k + 3), None] if k > 380 else [k])] + [(7, "again a b c")] * 3
    docs = spark.createDataFrame([(*r, *"12345") for r in rows], "doc_id long, text string, row string, own string, index string, n string, form string").repartition(3)
    out = M.fill_in_middle(docs)
    assert out.columns == [*docs.columns, "_fim"]
    got = out.select("doc_id", "text", "_fim.*", M.restored(F.col("_fim.output"), F.col("_fim.form")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_force(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_no_rows(spark):
    assert M.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_finds_every_boundary():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 12, 20_000), rng.geometric(0.001, 3000), np.r_[np.full(5000, 2), np.full(5000, 90)], np.array([10**6, 1, 10**6]), np.ones(1, int)):
        places = np.r_[0, np.cumsum(sizes)]
        line = M.fit(places)
        rest = places - M.predicted(*line, len(places))
        assert abs(rest).max() <= M.ERROR + 1 and rest.min() >= -128 and rest.max() <= 127
        assert len(line[0]) < len(places) / 2 or len(places) < 10 or sizes.max() > 500
    assert len(M.fit(np.arange(100_000) * 7)[0]) == 1


def test_boundaries_are_those_of_the_pattern():
    some = [t or "" for t in texts()]
    data = "".join(some).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in some)])
    for text, places in zip(some, M.boundaries(np.frombuffer(data, np.uint8), offsets)):
        assert places.tolist() == [0, *(m.end() for m in TOKEN.finditer(text))]


def test_ranks_by_expression(spark):
    text = "aa b  ccc\n" * 3000
    docs = spark.createDataFrame([(text,)], "text string").select(M.rank_index("text").alias("index"))
    ends = [0, *(m.end() for m in TOKEN.finditer(text))]
    got = docs.select(F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("index.n")), lambda k: M.place(F.col("index"), k))).alias("at")).collect()
    assert [r["at"] for r in got] == ends

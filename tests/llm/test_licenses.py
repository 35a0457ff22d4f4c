import math
import random
import re
from collections import Counter

import pytest

from lexmill.llm import licenses


def tokens(line):
    return re.findall(r"[0-9a-z\x80-￿]+", line.lower())


def brute(files):
    templates = [(n, tokens(re.sub(r"\s+", " ", t))) for n, ts in licenses.TEMPLATES.items() for t in ts]
    vocabulary = {w for _, t in templates for w in t}
    lines = [(p, k, tokens(x)) for p, text in files for k, x in enumerate((text or "").split("\n"))]
    having = Counter(w for _, _, t in lines for w in set(t) & vocabulary)
    rarity = {w: math.log((1 + len(lines)) / (1 + having[w])) + 1 for w in vocabulary}
    rarest = math.log(1 + len(lines)) + 1
    best = {}
    for path, k, t in lines:
        known, other = Counter(w for w in t if w in vocabulary), sum(w not in vocabulary for w in t)
        if sum(known.values()) < 2:
            continue
        norm = math.sqrt(sum((n * rarity[w]) ** 2 for w, n in known.items()) + other * rarest**2)
        for name, words in templates:
            c = Counter(words)
            cosine = sum(known[w] * rarity[w] ** 2 * n for w, n in c.items()) / norm / math.sqrt(sum((n * rarity[w]) ** 2 for w, n in c.items()))
            if cosine > best.get(path, (0, 0))[0] + 1e-12:
                best[path] = (cosine, name)
    return best


def test_scores_and_inheritance(spark):
    rng = random.Random(9)
    filler = lambda: " ".join(rng.choice("der the license of and version foo bar é baz permitted".split()) for _ in range(rng.randint(1, 9)))
    files = [(f"a/b/{i}.txt", "\n".join(filler() for _ in range(rng.randint(0, 5)))) for i in range(40)]
    files += [
        ("a/LICENSE", "x\nReleased under the MIT License."), ("a/c/COPYING.txt", "Licensed under the Apache License, Version 2.0."),
        ("a/c/d/x.py", "none"), ("a/c/own.py", "foo\nThis work is licensed under the GNU General Public License, version 3.\nbar"),
        ("z/q.txt", "nothing here"), ("top.txt", ""), ("null.txt", None), (None, "Released under the MIT License."), ("a/LICENSE-empty", "words"),
    ]
    frame = spark.createDataFrame([(p, t, "x") for p, t in files], "path string, text string, licence string")
    rows = {r["path"]: r for r in licenses.scan(frame).collect()}
    assert len(rows) == len(files)
    want = brute([f for f in files if f[0]] + [("none", files[-2][1])])
    for path, row in rows.items():
        score, name = want.get(path or "none", (0, None))
        assert row["cosine"] == pytest.approx(score, abs=1e-5)
        assert row["own_licence"] == (name if score >= licenses.LEAST_COSINE else "unknown" if path == "a/LICENSE-empty" else None)
    at = lambda p: (rows[p]["licence"], rows[p]["licence_from"])
    assert at("a/c/d/x.py") == ("Apache-2.0", "a/c/COPYING.txt") and at("a/c/own.py") == ("GPL-3.0", "a/c/own.py")
    assert at("a/LICENSE-empty") == ("unknown", "a/LICENSE-empty") and at("z/q.txt") == (None, None) and at("top.txt") == (None, None)
    assert rows[None]["licence"] == "MIT"


def test_root_licence_and_empty(spark):
    frame = spark.createDataFrame([("LICENSE", "Released under the MIT License."), ("x/y/z", "")], "path string, text string")
    assert {r["path"]: r["licence"] for r in licenses.scan(frame).collect()} == {"LICENSE": "MIT", "x/y/z": "MIT"}
    assert licenses.scan(frame.where("false")).count() == 0


def test_blocks_other_licences_and_unknown_statements(spark):
    mit = "Copyright (c) 2020 Somebody\n\n" + licenses.BLOCKS["MIT"][0]
    files = [
        ("LICENSE", "Released under the MIT License."), ("a/nc.txt", "words\nLicensed under CC BY-NC 4.0."), ("a/by.txt", "Licensed under CC BY 4.0."),
        ("b/LICENSE", mit), ("b/x.py", "none"), ("c/gpl.py", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details.\ncode()"),
        ("c/two.py", licenses.BLOCKS["BSD-2-Clause"][0]), ("c/three.py", licenses.BLOCKS["BSD-3-Clause"][0]),
        ("d/LICENSE", "Licensed under the Ruritanian Data Terms of 1894."), ("d/e/y.py", "none"), ("f/z.py", "none"),
    ]
    rows = {r["path"]: (r["licence"], r["licence_from"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert rows["a/nc.txt"] == ("CC-BY-NC-4.0", "a/nc.txt") and rows["a/by.txt"][0] == "CC-BY-4.0"
    assert rows["b/LICENSE"] == ("MIT", "b/LICENSE") and rows["b/x.py"] == ("MIT", "b/LICENSE")
    assert rows["c/gpl.py"] == ("GPL-3.0", "c/gpl.py")
    assert rows["c/two.py"][0] == "BSD-2-Clause" and rows["c/three.py"][0] == "BSD-3-Clause"
    assert rows["d/LICENSE"] == ("unknown", "d/LICENSE") and rows["d/e/y.py"] == ("unknown", "d/LICENSE") and rows["f/z.py"] == ("MIT", "LICENSE")


def test_wrapped_statements_and_whole_files(spark):
    bsd = "Redistribution and use in source and\nbinary forms, with or without\nmodification, are permitted"
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n" + "The licences for most works are designed otherwise. " * 200
    files = [("a/LICENSE", bsd), ("a/x.py", "none"), ("b/COPYING", gpl), ("b/c/y.py", ""), ("d/m.txt", "Released under\nthe MIT\nLicense.")]
    rows = {r["path"]: r["licence"] for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert rows == {"a/LICENSE": "BSD-3-Clause", "a/x.py": "BSD-3-Clause", "b/COPYING": "GPL-3.0", "b/c/y.py": "GPL-3.0", "d/m.txt": "MIT"}


def nearest(path, speakers):
    """The licence of the nearest directory above by walking up."""
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    while True:
        own = sorted(p for p in speakers if (p.rsplit("/", 1)[0] if "/" in p else "") == folder)
        if own:
            return own[0]
        if not folder:
            return None
        folder = folder.rsplit("/", 1)[0] if "/" in folder else ""


def test_inheritance_against_walking_up(spark):
    rng = random.Random(3)
    statements = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "nothing"]
    folder = lambda: "/".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))
    files = {}
    for i in range(150):
        name = rng.choice(["LICENSE", "COPYING.txt", "licence-2", f"f{i}.py", f"g{i}"])
        path = f"{folder()}/{name}".lstrip("/")
        files.setdefault(path, rng.choice(statements) if name[0] in "LCl" else "code here")
    rows = licenses.scan(spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(files.items())], "path string, text string, line long"), carry=["line"]).collect()
    speakers = {p: t for p, t in files.items() if t != "code here"}
    for r in rows:
        want = r["path"] if r["path"] in speakers else nearest(r["path"], speakers)
        assert r["licence_from"] == want


def test_repeats_nulls_and_query_without_ids(spark, tmp_path):
    from lexmill.llm import queries

    rows = [(1, "x\nReleased under the MIT License.", "en", "src1"), (None, "y\nLicensed under CC BY 4.0.", "en", "src1"), (None, None, "en", "src2"), (5, "", None, None), (7, "text", "en", "src1"), (7, "text", "en", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op2_license_scan(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1) for r in found) == [-1, -1, 1, 5, 7, 7]
    assert {r["own_licence"] for r in found if r["doc_id"] is None} == {"CC-BY-4.0", None}


def test_licence_files_that_are_not_recognised(spark):
    """A licence file with any words speaks for its folder, though nothing in it is known; one without words does not."""
    files = [("LICENSE", "Released under the MIT License."), ("b/LICENSE", "All rights reserved. No part of this may be copied."), ("b/c/LICENSE.txt", " \n"), ("b/y.py", "none"), ("b/c/z.py", ""), ("d/copying-notes.txt", "x")]
    found = {r["path"]: (r["licence"], r["licence_from"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    unknown = ("unknown", "b/LICENSE")
    assert found == {"LICENSE": ("MIT", "LICENSE"), "b/LICENSE": unknown, "b/c/LICENSE.txt": unknown, "b/y.py": unknown, "b/c/z.py": unknown, "d/copying-notes.txt": ("unknown", "d/copying-notes.txt")}

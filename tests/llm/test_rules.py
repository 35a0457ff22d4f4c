import random
import re
from collections import Counter

import numpy as np
import pandas as pd

from lexmill.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(threes)
    covered = {i + k for i, t in enumerate(threes) if often[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text), "n_digits": sum("0" <= c <= "9" for c in text),
        "n_marks": sum(c in "!?" for c in text), "n_distinct_words": len(set(words)),
    }


def texts():
    rng = random.Random(3)
    parts = ["a", "b", "c d", "é中", "\n", "\n", "\t", "#", "!!", "A1", "　", " ", "a b c"]
    return ["", None, "\n\n", " ", "a", "a\na\n a\na", "one two three one two three"] + ["".join(rng.choice(parts) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_counts_against_brute_force(spark):
    given = texts()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(given)], "doc_id long, text string, n_words long")
    rows = rules.with_counts(docs).orderBy("doc_id").collect()
    assert len(rows) == len(given)
    for text, row in zip(given, rows):
        assert row["counts"].asDict() == brute(text), repr(text)
        assert row["n_words"] == row["doc_id"]


def test_learned_list_rejects_what_it_was_taught(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice("lorem ipsum dolor sit amet tempor magna aliqua".split()) + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(150)]
    bad = [" ".join("#$%" + w for w in t.split()) for t in good[:60]]
    docs = spark.createDataFrame(list(enumerate(good + bad + ["", None])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["_kept"] for r in rules.judged(docs, labels).collect()}
    assert len(kept) == 212 and not kept[210] and not kept[211]
    assert sum(kept[i] for i in range(150)) >= 148 and not any(kept[i] for i in range(150, 210))


def test_learned_rules_find_planted_conjunctions():
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({f: rng.random(500) for f in rules.FEATURES})
    bad = (rows["symbols"] > 0.7).to_numpy() | ((rows["upper"] <= 0.2) & (rows["marks"] > 0.5)).to_numpy()
    learned = rules.learn(rows, bad)
    found = np.zeros(500, bool)
    for rule in learned:
        found |= rules.covers(rule, rows)
    assert (found == bad).mean() > 0.9
    assert rules.learn(rows, np.zeros(500, bool)) == []


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "w " * 30 + "x y z " * 2)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["_kept"] for r in rules.judged(docs, none).collect()] == [False, False]
    assert rules.judged(docs.where("false"), none).count() == 0

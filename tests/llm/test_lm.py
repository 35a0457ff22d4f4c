import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from lexmill.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")] + ["<end>"]


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def corpus():
    rng = random.Random(2)
    follow = {w: rng.sample(range(30), 3) for w in range(30)}
    docs = []
    for i in range(400):
        w, out = rng.randrange(30), []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(follow[w]) if rng.random() < 0.8 else rng.randrange(30)
            out.append(f"{'W' if rng.random() < 0.1 else 'w'}{w}" if rng.random() < 0.95 else f"rare{rng.randrange(500)}")
        docs.append((i, " ".join(out)))
    return docs + [(401, None), (402, ""), (403, "É a　b"), (None, "w1 w2"), (7, "w1"), (7, "w1")]


def test_base_and_counts_against_brute_force(spark):
    docs = corpus()
    rows = lm.log_scores(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")).collect()
    train = Counter(w for i, t in docs if not is_held_out(i) for w in words(t))
    n, v = sum(train.values()), len(train)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(((i, is_held_out(i), len(words(t)), sum(train[w] > 0 for w in words(t)), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in docs), key=key)
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=key)
    assert found == want
    held = [r for r in rows if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.2 * sum(r["n_tokens"] for r in held)
    assert all(r["score"] <= 0 for r in rows)


def test_short_texts_sum_below_one(spark):
    """The probabilities of all texts of at most one word add up to less than 1, unknown words as one."""
    docs = corpus()[:300]
    types = sorted({w for i, t in docs if not is_held_out(i) for w in words(t) if w != "<end>"}) + ["neverseen"]
    probes = iter(i for i in range(10_000, 10**6) if is_held_out(i))
    one = [(next(probes), w) for w in types]
    end = next(probes)
    rows = {r["doc_id"]: r["score"] for r in lm.log_scores(spark.createDataFrame(docs + one + [(end, "")], "doc_id long, text string")).collect()}
    assert 10 ** rows[end] + sum(10 ** rows[i] for i, _ in one) < 1


def test_automaton_weights_by_hand(spark):
    docs = [(i, "a b " * 40) for i in range(60)]
    rows = {r["doc_id"]: r for r in lm.log_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    train = [i for i, _ in docs if not is_held_out(i)]
    per_token = rows[train[0]]["score"] / 81
    assert per_token > -0.05  # a and b alternate: the model learns it nearly surely
    assert rows[train[0]]["base_score"] / 81 < -0.3


def test_empty_and_no_training(spark):
    assert lm.log_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = next(i for i in range(100) if is_held_out(i))
    row = lm.log_scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (0, 0, 0.0, 0.0)
    assert np.isfinite(row["score"])


class Brute:
    """The model by its definition, from dictionaries."""

    def __init__(self, docs):
        self.train, self.pairs, self.heads, self.triples = Counter(), Counter(), Counter(), Counter()
        for i, t in docs:
            if not is_held_out(i):
                line = words(t)
                before = ["<begin>", *line]
                self.train.update(line)
                self.pairs.update(zip(before, line))
                self.heads.update(before[:-1])
                self.triples.update(zip(before, line, line[1:]))
        self.n, self.v = sum(self.train.values()), len(self.train)
        self.first = self.learn((c, self.heads[u]) for (u, w), c in self.pairs.items())
        self.second = self.learn((c, self.pairs[u, v]) for (u, v, w), c in self.triples.items() if self.pairs[u, v] >= lm.CONTEXT)

    @staticmethod
    def size(count):
        return int(math.log2(count) / 2)

    def learn(self, rows):
        again, every = Counter(), Counter()
        for c, context in rows:
            every[self.size(context)] += c
            again[self.size(context)] += c if c > 1 else 0
        return {s: again[s] / (every[s] + 1) for s in every}

    def root(self, w):
        return (self.train[w] + 1) / (self.n + self.v + 1)

    def after_word(self, u, w):
        if not self.heads[u]:
            return self.root(w)
        r = self.first[self.size(self.heads[u])]
        return r * self.pairs[u, w] / self.heads[u] + (1 - r) * self.root(w)

    def after_pair(self, u, v, w):
        if self.pairs[u, v] < lm.CONTEXT:
            return self.after_word(v, w)
        r = self.second[self.size(self.pairs[u, v])]
        return r * self.triples[u, v, w] / self.pairs[u, v] + (1 - r) * self.after_word(v, w)

    def score(self, t):
        line = words(t)
        before = ["<begin>", *line]
        return math.log10(self.after_word("<begin>", line[0])) + sum(math.log10(self.after_pair(*x)) for x in zip(before, line, line[1:]))


def test_scores_against_brute_force(spark):
    """Every pair of the training documents counts, those of words that occur once too, and a long text's pieces join."""
    rng = random.Random(9)
    docs = [*corpus(), (500, " ".join(f"w{rng.randrange(30)}" for _ in range(3 * lm.PIECE + 100))), (501, " ".join(["w1 w2 w3"] * 700))]
    model = Brute(docs)
    assert sum(c >= lm.CONTEXT for c in model.pairs.values()) > 50 and len(model.second) > 1
    rows = lm.log_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], round(r["score"], 5)) for r in rows), key=key) == sorted(((i, round(model.score(t), 5)) for i, t in docs), key=key)
    # what every state gives all tokens, one unknown token among them, adds up to 1
    tokens = [*model.train, "neverseen"]
    states = [(u, v) for (u, v), c in model.pairs.items() if c >= lm.CONTEXT and v != "<end>"]
    assert all(abs(sum(model.after_pair(u, v, w) for w in tokens) - 1) < 1e-9 for u, v in states[:100])
    assert all(abs(sum(model.after_word(u, w) for w in tokens) - 1) < 1e-9 for u in list(model.heads)[:100])


def test_pairs_are_not_forgotten_as_the_corpus_grows(spark):
    rng = random.Random(5)
    probe = next(i for i in range(10**6, 10**7) if is_held_out(i))
    pairs = [(i, " ".join(f"left{(i + k) % 40} right{(i + k) % 40}" for k in range(20))) for i in range(20)]
    filler = [(100 + i, " ".join(f"w{rng.randrange(20000)}" for _ in range(4000))) for i in range(300)]
    rows = lm.log_scores(spark.createDataFrame([*pairs, *filler, (probe, "left5 right5 left6 right6")], "doc_id long, text string"))
    row = rows.where(f"doc_id = {probe}").first()
    assert row["train_tokens"] > 10**6 and row["score"] > row["base_score"] + 1

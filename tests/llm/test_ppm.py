import random
import unicodedata
import zlib
from collections import Counter
from math import log2

import numpy as np
import pytest

from lexmill.llm import ppm as M

PIECES = {"a": [b"abracadabra" * 3, b"xyz", b""], "b": ["thé cat sat on the mat".encode()], "c": [b"z"]}


def slow_bits(pieces, text):
    """Code length of a text, with contexts as dictionaries and the bytes to leave out as sets."""
    follow = [{} for _ in range(M.ORDER + 1)]
    pad = bytes([M.PAD]) * M.ORDER
    for piece in pieces:
        for i, x in enumerate(piece):
            before = (pad + piece[:i])[-M.ORDER :]
            for k in range(M.ORDER + 1):
                follow[k].setdefault(before[M.ORDER - k :], Counter())[x] += 1
    bits = 0.0
    for i, x in enumerate(text):
        before, out = (pad + text[:i])[-M.ORDER :], set()
        for k in range(M.ORDER, -1, -1):
            met = {s: n for s, n in follow[k].get(before[M.ORDER - k :], {}).items() if s not in out}
            if not met:
                continue
            total = sum(met.values()) + len(met)
            if x in met:
                bits -= log2(met[x] / total)
                break
            bits -= log2(len(met) / total)
            out |= set(met)
        else:
            bits += log2(256 - len(out))
    return bits


@pytest.mark.parametrize("held", [1 << 20, 7])
def test_code_lengths(monkeypatch, held):
    monkeypatch.setattr(M, "HELD", held)  # pieces of a text are scored as the whole is
    rng = random.Random(1)
    texts = [b"", b"abra", b"the mat", "é".encode(), bytes(rng.choices(b"abcd xyz", k=60)), b"", bytes(rng.choices(range(1, 120), k=50))]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [[slow_bits(own, t) for own in PIECES.values()] for t in texts]
    assert np.allclose(M.Model(PIECES).text_bits(data, offsets), want, atol=1e-3)
    monkeypatch.setattr(M, "TABLE", 0)  # nothing looked up
    assert np.allclose(M.Model(PIECES).text_bits(data, offsets), want, atol=1e-6)


def test_probabilities_sum_to_one():
    for levels in M.Model(PIECES).trees:
        for context in (b"abra", b"\xff\xff\xff\xff", b"\xff\xff\xffx", b"zzzz", b"xcad", b" the"):
            codes = np.array([int.from_bytes(context, "big") << 8 | x for x in range(256)], np.uint64)
            assert abs(np.exp2(-M.code_lengths(levels, codes)).sum() - 1) < 1e-9


def test_table_finds_what_it_holds():
    rng = np.random.default_rng(5)
    model = M.Model({"a": [rng.integers(1, 200, 50_000, np.uint8).tobytes()]})
    assert (model.lookup(model.known) == np.arange(len(model.known))).all()
    other = rng.integers(0, 1 << 40, 10_000, np.uint64)
    found = model.lookup(other)
    assert (np.isin(other, model.known) == (found >= 0)).all()


WORDS = {"en": "the of and that with for this from have not", "de": "der die und nicht mit ein für auf ist den", "fr": "les des que dans une pour est pas sur avec"}


def corpus(n):
    rng = random.Random(7)
    for i in range(n):
        lang = rng.choice(list(WORDS))
        yield i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(8, 60))), lang


def test_held_out_accuracy(spark):
    rows = list(corpus(400))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in M.identified(docs).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    out = [r[2] == got[r[0]]["lang_pred"] for r in rows if got[r[0]]["held_out"]]
    assert len(out) > 50 and sum(out) / len(out) > 0.97
    assert all(1 / 3 <= r["score"] <= 1 for r in got.values())


def test_language_is_no_input_and_sample_is_bounded(spark):
    rows = list(corpus(300))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    other = [(i, t, "xx" if held(i) else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    first, second = ({r["doc_id"]: r["lang_pred"] for r in M.identified(spark.createDataFrame(x, schema)).collect()} for x in (rows, other))
    assert first == second
    pieces = M.training_pieces(spark.createDataFrame(rows, schema), 4096, 1 << 20, 2)
    assert len(pieces) == 2 and all(0 < sum(map(len, p)) <= 4096 + M.PIECE for p in pieces.values())


def test_difficult_rows(spark):
    """Nulls, texts without letters, a text of some MB, repeated rows, a language of null, and clashing names."""
    rows = [(i, t, lang) for i, t, lang in corpus(60)] + [(None, None, None), (1000, None, "en"), (1001, "", "en"), (1002, "12 34 !\n", "en"), (1003, "中", None), (None, "the and of", "en")]
    rows += [(1004, "the of and that " * 200_000, "en"), (1005, "die und nicht ", "de")] + [(1006, "les des que dans", "fr")] * 50
    docs = spark.createDataFrame([(*r, *"1234") for r in rows], "doc_id long, text string, lang string, held_out string, lettered string, key string, piece string")
    got = M.identified(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            letters = any(unicodedata.category(c).startswith("L") for c in (text[r["doc_id"]] or "")[:100])
            assert (r["lang_pred"] == "und") == (not letters) and (r["score"] == 0) == (not letters)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert (by_id[1004], by_id[1005], by_id[1006]) == ("en", "de", "fr")


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    assert M.identified(spark.createDataFrame([], schema)).count() == 0
    got = M.identified(spark.createDataFrame([(1, "abc", None), (2, None, "en")], schema)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert {r["lang_pred"] for r in M.identified(spark.createDataFrame([(1, "abc", "zz"), (2, "q", None)], schema)).collect()} == {"zz"}

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lexmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    parts = ["a", "b", "s", "t", "re", "ve", "ll", "d", "'", "''", "'s", " ", "  ", "\n", "\t", "\x1c", "　", "1", "²", "é", "中", "!", "😀", "R", "don't", "we'll"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(2000)]
    return made + ["", None, " ", "'", "'s", "x" * 3000, " " * 500, "ab" * 2000, "the same", "the same", "<|endoftext|>"]


def test_ids_match_and_round_trip(spark, reference):
    given = list(enumerate(texts())) + [(None, "null id"), (3, "repeated id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in given], "doc_id long, text string, ids string")
    tokens = bpe.encode(docs, PATH)
    rows = tokens.collect()
    decoded = bpe.decode(tokens, PATH).collect()
    assert len(rows) == len(given)
    for (i, text), row, back in zip(given, rows, decoded):
        assert row["doc_id"] == i and row["ids"] == reference.encode_ordinary(text or "")
        assert bytes(back["bytes"]) == (text or "").encode()
        ends = row["offsets"][1:] + [len((text or "").encode())]
        assert all(reference.decode_single_token_bytes(t) == (text or "").encode()[a:b] for t, a, b in zip(row["ids"], row["offsets"], ends))


def test_digests(spark, reference):
    given = texts()[:200] + ["", None]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    for row, text in zip(bpe.digests(docs, PATH).collect(), given):
        ids = reference.encode_ordinary(text or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_every_code_point_is_cut_as_the_pattern_does(spark, reference):
    """All code points between letters, numbers and spaces, so that a class of another Unicode version would show."""
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    given = ["".join(f"a{c}1{c} {c}" for c in points[k : k + 20_000]) for k in range(0, len(points), 20_000)]
    rows = bpe.encode(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), PATH).collect()
    for row in rows:
        assert row["ids"] == reference.encode_ordinary(given[row["doc_id"]])

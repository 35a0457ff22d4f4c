import hashlib
import random

from lexmill.llm import fingerprints as FP


def test_spans_and_extensions():
    a, b = FP.prefix_hashes(FP.code_points("xxabcdefyy")), FP.prefix_hashes(FP.code_points("abcdefz"))
    assert FP.same_span(a, 2, b, 0, 6) and not FP.same_span(a, 2, b, 0, 7)
    assert FP.common_extension(a, 2, b, 0) == 6 and FP.common_extension(a, 0, b, 0) == 0
    rng = random.Random(4)
    for _ in range(200):
        s, t = ("".join(rng.choices("ab", k=rng.randint(1, 30))) for _ in range(2))
        i, j = rng.randrange(len(s)), rng.randrange(len(t))
        n = 0
        while i + n < len(s) and j + n < len(t) and s[i + n] == t[j + n]:
            n += 1
        assert FP.common_extension(FP.prefix_hashes(FP.code_points(s)), i, FP.prefix_hashes(FP.code_points(t)), j) == n


def test_likeness():
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefgh ", k=3000))
    same = FP.likeness(FP.fingerprint(text), FP.fingerprint(text[:2000] + text[:1000]))
    assert 0.6 <= same <= 0.7
    assert FP.likeness(FP.fingerprint(text), FP.fingerprint(text[::-1])) < 0.1
    assert FP.likeness(FP.fingerprint(""), FP.fingerprint(None)) == 1.0 and FP.likeness(FP.fingerprint(""), FP.fingerprint("a")) == 0.0
    assert FP.fingerprint("a") != FP.fingerprint("aa")
    assert 0.4 <= FP.likeness(FP.fingerprint(text), FP.fingerprint(text[:1500])) <= 0.5


def test_pairs_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i * 3, "".join(rng.choices("abé中 ", k=rng.randint(0, 80))) if i % 11 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in FP.edited_pairs(docs).collect()}
    order = sorted(rows, reverse=True)
    assert len(found) == 300
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % 300][1] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        row = found[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == FP.fingerprint(text) and row["edited_fingerprint"] == FP.fingerprint(edited)
        assert 0 <= row["near_next"] <= 1 and row["near_next"] == FP.likeness(FP.fingerprint(text), FP.fingerprint(after))


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(7, "a")] * 5 + [(None, "b"), (9, "c"), (9, "d")], "doc_id long, text string")
    assert FP.edited_pairs(docs).count() == 8
    assert FP.edited_pairs(docs.where("doc_id = 1")).count() == 0
    assert FP.edited_pairs(docs.where("doc_id IS NULL")).count() == 1


def test_shifted_and_moved_texts():
    """What is put in or taken out costs the stretch between two cuts, wherever it is."""
    rng = random.Random(8)
    for n in (400, 3000, 20_000):
        text = "".join(rng.choices("abcdefgh ", k=n))
        own = FP.fingerprint(text)
        for edited in ("x" + text, text[: n // 2] + "x" + text[n // 2 :], text[7:], text + "end", text[: n // 3] + text[n // 3 + 5 :]):
            assert FP.likeness(own, FP.fingerprint(edited)) > 0.7
        moved = text[n // 2 :] + text[: n // 2]
        assert FP.likeness(own, FP.fingerprint(moved)) > 0.7
        assert FP.likeness(own, FP.fingerprint("".join(rng.choices("abcdefgh ", k=n)))) < 0.05
        assert len(own) < 600 + n / 3
    junk = FP.fingerprint("a" * 5000)
    assert FP.likeness(junk, FP.fingerprint("a" * 5000)) == 1.0 and len(junk) < 400


def test_near_copies_of_any_length():
    """Texts with a likeness of 0.8 on five-word shingles are found at 0.5, others are not alike."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(5000)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    found = pairs = 0
    for n in (100, 300, 1000, 3000, 10_000):
        for _ in range(20):
            one = rng.choices(words, k=n)
            two = list(one)
            for at in rng.sample(range(n), max(1, n // 55)):
                two[at : at + 1] = rng.choices(words, k=rng.randint(0, 2))
            a, b = shingles(one), shingles(two)
            assert FP.likeness(FP.fingerprint(" ".join(one)), FP.fingerprint(" ".join(rng.choices(words, k=n)))) < 0.05
            if len(a & b) >= 0.8 * len(a | b):
                pairs += 1
                found += FP.likeness(FP.fingerprint(" ".join(one)), FP.fingerprint(" ".join(two))) >= 0.5
    assert pairs > 60 and found >= 0.98 * pairs


def test_long_stretches_without_cuts():
    junk = "ab" * 200_000
    one, two = FP.fingerprint(junk), FP.fingerprint("x" + junk)
    assert FP.likeness(one, two) > 0.6 and len(one) < 600
    at = FP.read(one)[0]
    assert max(at[1:] - at[:-1]) <= FP.LONGEST and at[-1] == 400_000 and (at[1:] > at[:-1]).all()


def test_clashing_names_ties_and_long_texts(spark):
    rng = random.Random(3)
    text = "".join(rng.choices("abé ", k=1_500_000))
    rows = [(2, text, 1, 1, "x"), (1, "b" + text, 1, 1, "x"), (1, "b", 2, 2, "x"), (1, "b", 2, 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int, role int, fingerprint string")
    found = {(r["doc_id"], r["n_chars"]): r for r in FP.edited_pairs(docs).collect()}
    assert found[2, 1_500_000]["near_next"] > 0.9 or found[2, 1_500_000]["near_next"] < 0.01  # whichever row of id 1 comes next
    assert len(found) == 3 and found[1, 1_500_001]["fingerprint"] == FP.fingerprint("b" + text)

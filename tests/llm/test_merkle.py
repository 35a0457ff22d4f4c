import collections
import hashlib
import zlib

from pyspark.sql import functions as F

from lexmill.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def proven(docs):
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return M.verified_manifest(docs, tampered, F.translate("text", M.UPPER, M.UPPER.lower()))


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        run = i // 16 * 16
        out.append((level[run:i], level[i + 1 : run + 16]))
        i //= 16
    return out


def brute_force(rows):
    sources = collections.defaultdict(list)
    for row in rows:
        sources[row[3]].append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for own in sources.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: levels([leaf(r, r[1]) for r in sources[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    found = []
    for k, s in enumerate(names):
        for i, row in enumerate(sources[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            own = trees[s][0][i]
            tampered = row[1] is not None and zlib.crc32(b"" if row[0] is None else str(row[0]).encode()) % 5 == 0
            up = leaf(row, row[1].translate(str.maketrans(M.UPPER, M.UPPER.lower()))) if tampered else own
            for before, after in path:
                up = digest([*before, up, *after])
            found.append((row[0], own, trees[s][-1][0], top[-1][0], digest(x for a, b in path for x in a + b), up, up == top[-1][0]))
    return sorted(found, key=repr)


def found(spark, rows, extra=""):
    docs = spark.createDataFrame([(*r, *["x"] * extra.count(",")) for r in rows], SCHEMA + extra).repartition(5)
    return sorted(map(tuple, proven(docs).collect()), key=repr)


def test_against_brute_force(spark):
    """Sources of 1, 16, 17, 256 and 300 rows, null and empty ones, nulls everywhere, repeated ids and rows; names that the
    operator uses itself."""
    rows = [(i, f"Text {i} é中", "en", s, 7) for s, n in (("a", 1), ("b", 16), ("c", 17), ("é", 256), ("d", 300)) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "No Id", "en", None, 3), (3, "", "en", "", 0), (3, "A", "fr", "", 1), (3, "B", None, "", None), (-4, "Tie", "en", "c", 1)]
    rows += [(9, "Same", "en", "many", 4)] * 300 + [(10, "X" * 200_000, "en", "many", 200_000)]
    got = found(spark, rows, ", tree string, digest string, rank string, n string, carry string, path string, block string")
    assert got == brute_force(rows)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_one_source_one_row_and_none(spark):
    for rows in ([(1, "One", "en", "s", 3)], [(i, "One", "en", None, 3) for i in range(5)], []):
        assert found(spark, rows) == brute_force(rows)


def test_many_sources(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 40}", 1) for i in range(100)]
    assert found(spark, rows) == brute_force(rows)


def test_requests_for_some_leaves(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}", 7) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    leaves = docs.select(F.col("source").alias("tree"), M.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))).alias("digest"), F.struct("doc_id").alias("carry"))
    own, top = M.manifest(leaves, [F.col("carry.doc_id")])
    wanted = spark.createDataFrame([("s1", 0), ("s1", 17), ("s1", 299), ("s2", 100), ("s2", 5000)], "tree string, rank long")
    proofs = M.proofs(own, top, wanted).withColumn("ups", M.steps(F.col("path")))
    got = proofs.select("carry.doc_id", F.lower(F.hex("leaf")).alias("leaf"), M.proof_digest(F.col("ups")).alias("proof")).collect()
    want = {r[0]: (r[1], r[4]) for r in brute_force(rows)}
    assert {r["doc_id"] for r in got} == {1, 52, 898, 302} and all(want[r["doc_id"]] == (r["leaf"], r["proof"]) for r in got)


def test_equal_nodes_are_stored_once_a_block(spark):
    leaves = spark.range(3000).select(F.lit("s").alias("tree"), M.leaf(F.lit("same")).alias("digest"), F.struct("id").alias("carry"))
    own = M.forest(leaves, [F.col("carry.id")])
    assert [level.count() for level in own.levels] == [2, 2, 1]  # full runs and the last, shorter one

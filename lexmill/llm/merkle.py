"""A Merkle manifest of a table: digests of rows, of runs of rows, and of sources, and proofs that a row belongs to it.

The manifest is a content-addressed store: one record for each inner node, from its digest to the digests of its
children. Requests for leaves start at the root and go down by the digits of their ranks, base ``FANOUT``; what is not
selected on the way are the siblings of the proof. Requests below one node go down as one row, and so no node is
looked up more than once for each place it has in the tree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import written

FANOUT = 16
#: A record is kept once for each block of so many places, so that the digest of rows repeated any number of times is no hot key.
BLOCK = 4096
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields, in order."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def hexed(digests: Column) -> Column:
    return F.transform(digests, lambda d: F.lower(F.hex(d)))


def node(children: Column) -> Column:
    """Digest of a node: of its children's hexadecimal digests, one after another."""
    return F.unhex(F.sha2(F.array_join(hexed(children), "").cast("binary"), 256))


@dataclass
class Forest:
    """Trees over groups of rows. ``wants``: (tree, run, digits, carries) the rows of each run of leaves; ``levels``: for
    each level from the leaves up, its records (digest, block, children); ``tops``: (tree, digest, n) the top node and the
    number of leaves of each tree."""

    wants: DataFrame
    levels: list[DataFrame]
    tops: DataFrame


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``rank`` (from 0) within the tree, and ``n``, the tree's rows.

    Rows are sorted by range and written once with their place; a rank is the place within the partition and the number
    of the tree's rows in the partitions before. Rows that are equal in everything are sorted by where they were read,
    so that they are spread over ranges too.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = rows.orderBy("tree", *order, "_tie").drop("_tie").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "sorted")
    counts = placed.groupBy("tree", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("tree")  # a tree has one row for each partition it is in
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "_part", "_first", before.alias("_before"), F.sum("_rows").over(whole).alias("n"))
    return placed.join(counts, ["tree", "_part"]).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def shorter(n: Column) -> Column:
    """Nodes of the level above n nodes."""
    return F.floor((n + FANOUT - 1) / FANOUT).cast("long")


def forest(leaves: DataFrame, order: list[Column]) -> Forest:
    """Trees over leaves (tree, digest, carry): the leaves of a tree ascend by ``order``, then by digest."""
    run = F.floor(F.col("rank") / FANOUT).cast("long")
    rows = ranked(leaves, [*order, F.col("digest")])
    members = F.array_sort(F.collect_list(F.struct("rank", "digest", "carry")))  # FANOUT at most
    runs = rows.groupBy("tree", run.alias("run")).agg(members.alias("m"), F.first("n").alias("n"))
    pick = lambda f: F.transform("m", f)
    runs = runs.select("tree", "run", "n", pick(lambda m: m["digest"]).alias("children"), pick(lambda m: (m["rank"] % FANOUT).cast("int")).alias("digits"), pick(lambda m: m["carry"]).alias("carries"))
    runs = written(runs.withColumn("digest", F.when(F.col("n") > 1, node(F.col("children"))).otherwise(F.get("children", F.lit(0)))), "runs")

    levels, tops = [], []
    nodes = runs.select("tree", F.col("run").alias("place"), "digest", "children", shorter(F.col("n")).alias("left"), "n")
    most = runs.agg(F.max("n").alias("n")).first()["n"] or 0
    while True:
        tops.append(nodes.where("left = 1").select("tree", "digest", "n"))
        if most > 1:
            block = F.floor(F.col("place") / BLOCK).cast("long")
            levels.append(nodes.where("n > 1").select("digest", block.alias("block"), "children").dropDuplicates(["digest", "block"]))
        most = -(-most // FANOUT)
        if most <= 1:
            break
        above = nodes.where("left > 1").groupBy("tree", F.floor(F.col("place") / FANOUT).cast("long").alias("place")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("place").alias("p"), "digest"))).alias("m"), F.first("left").alias("left"), F.first("n").alias("n")
        )
        above = above.select("tree", "place", F.transform("m", lambda m: m["digest"]).alias("children"), shorter(F.col("left")).alias("left"), "n")
        nodes = written(above.withColumn("digest", node(F.col("children"))), "nodes")
    return Forest(runs.select("tree", "run", "digits", "carries"), levels, reduce(DataFrame.unionByName, tops))


def descend(front: DataFrame, trees: Forest, requests: DataFrame | None = None) -> DataFrame:
    """One row for each requested leaf: the columns of front but ``digest`` and ``n``, ``leaf``, ``carry``, and ``path``.

    front: (tree, digest, n, path, ...), the top of each tree and the path to it. requests: (tree, rank) of the leaves to
    prove; all if there are none. Each step joins the front with the records of a level by digest; ``path`` has a segment
    for each step, root first: the digit taken and the digests of the other children.
    """
    depth = F.lit(0)
    reach = 1
    for k in range(len(trees.levels)):
        depth = F.when(F.col("n") > reach, k + 1).otherwise(depth)
        reach *= FANOUT
    front = front.withColumn("_depth", depth).withColumn("_place", F.lit(0).cast("long")).drop("n")
    names = [c for c in front.columns if c not in ("digest", "path", "_depth", "_place")]

    def asked(rows: DataFrame, level: int, place: str) -> DataFrame:
        if requests is None:
            return rows
        wanted = requests.select("tree", F.floor(F.col("rank") / FANOUT**level).cast("long").alias(place)).distinct()
        return rows.join(wanted, ["tree", place], "left_semi")

    def opened(rows: DataFrame, level: int) -> DataFrame:
        """The rows with the children of their node, as the store has them."""
        block = F.floor(F.col("_place") / BLOCK).cast("long")
        return rows.withColumn("block", block).join(trees.levels[level - 1], ["digest", "block"]).drop("block")

    others = lambda digit: F.struct(digit.cast("int").alias("digit"), F.filter("children", lambda _, i: i != digit).alias("siblings"))
    for level in range(len(trees.levels), 1, -1):
        here = opened(front.where(F.col("_depth") == level), level).select(*names, "path", "_place", "children", F.posexplode("children").alias("_digit", "digest"))
        below = here.select(
            *names, "digest", F.concat("path", F.array(others(F.col("_digit")))).alias("path"), F.lit(level - 1).alias("_depth"), (F.col("_place") * FANOUT + F.col("_digit")).alias("_place")
        )
        front = written(front.where(F.col("_depth") < level).select(below.columns).unionByName(asked(below, level - 1, "_place")), "front")
    runs = trees.wants.withColumnRenamed("run", "_place")
    lone = front.where("_depth = 0").withColumn("children", F.array("digest"))
    ends = opened(front.where("_depth = 1"), 1).unionByName(lone.select(*front.columns, "children"), allowMissingColumns=True) if trees.levels else lone
    rows = ends.join(runs, ["tree", "_place"]).select(*names, "path", "_depth", "_place", "children", F.explode(F.arrays_zip("digits", "carries")).alias("_r"))
    digit = F.col("_r.digits")
    rows = rows.withColumn("rank", F.col("_place") * FANOUT + digit)
    rows = asked(rows, 0, "rank")
    path = F.when(F.col("_depth") > 0, F.concat("path", F.array(others(digit)))).otherwise(F.col("path"))
    return rows.select(*names, F.get("children", digit).alias("leaf"), F.col("_r.carries").alias("carry"), path.alias("path"))


def steps(path: Column) -> Column:
    """The path from the leaf up: what stands before and after the node among its siblings, as hexadecimal text."""
    side = lambda s, at, n: F.array_join(hexed(F.slice(s["siblings"], at, n)), "")
    return F.transform(F.reverse(path), lambda s: F.struct(side(s, F.lit(1), s["digit"]).alias("before"), side(s, s["digit"] + 1, F.lit(FANOUT)).alias("after")))


def folded(leaf_hex: Column, ups: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way up."""
    return F.aggregate(ups, leaf_hex, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]).cast("binary"), 256))


def proof_digest(ups: Column) -> Column:
    return F.sha2(F.array_join(F.transform(ups, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def manifest(leaves: DataFrame, order: list[Column]) -> tuple[Forest, Forest]:
    """The trees of the sources over leaves (tree, digest, carry), and the tree over their tops, by ``tree``."""
    own = forest(leaves, order)
    tops = own.tops.select(F.lit("").alias("tree"), "digest", F.struct("tree", "n", F.col("digest").alias("subroot")).alias("carry"))
    return own, forest(tops, [F.col("carry.tree")])


def proofs(own: Forest, top: Forest, requests: DataFrame | None = None) -> DataFrame:
    """(root, subroot, leaf, carry, path) of the leaves asked for."""
    empty = F.array().cast("array<struct<digit: int, siblings: array<binary>>>")
    front = top.tops.select("tree", "digest", "n", empty.alias("path"), F.col("digest").alias("root"))
    subroots = descend(front, top).select("root", "path", "carry.*")
    return descend(subroots.select("tree", "n", "path", "root", "subroot", F.col("subroot").alias("digest")), own, requests)


def verified_manifest(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of documents.

    A row's leaf has its doc_id, source, lang, n_chars and text. The leaves of a source ascend by doc_id, null first; rows
    of one id by their leaf; equal rows have equal leaves and one place each. Sources ascend bytewise, null first. Where
    ``tampered`` holds, the proof is made for the row with ``changed`` as its text; nothing changes in a null text. Long
    texts are read once, in the scan; what moves are digests. An empty table gives no rows, and so no root.
    """
    source = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))  # null before the empty source
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    other = F.when(tampered & F.col("text").isNotNull(), leaf(*fields, changed))
    rows = docs.select(source.alias("tree"), leaf(*fields, F.col("text")).alias("digest"), F.struct("doc_id", other.alias("other")).alias("carry"))
    own, top = manifest(written(rows, "leaves"), [F.col("carry.doc_id").asc_nulls_first()])
    rows = proofs(own, top).withColumn("ups", steps(F.col("path")))
    text = lambda c: F.lower(F.hex(c))
    rows = rows.select(
        "carry.doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), proof_digest(F.col("ups")).alias("proof_sha256"),
        folded(text(F.coalesce("carry.other", "leaf")), F.col("ups")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))

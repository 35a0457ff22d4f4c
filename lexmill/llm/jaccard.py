"""Near-duplicate documents: all pairs of shingle sets with Jaccard similarity of at least 4/5, as components.

Two sets that similar share a token among the first fifth (plus one) of their tokens, in whatever order all tokens
are taken. Several orders are used: a candidate pair must share such a prefix token under every one of them. All
orders begin with the tokens that no other document has, which use prefix places up but make no candidates, and end
with the tokens that are common in the corpus, as a fixed-size table of counts tells. Besides, the tokens that a set
shares with any others bound its overlap with each. Candidates that pass all filters are verified on the whole sets.

Equal sets are one class. Each token's classes form a group, named by its least class, the hub; groups of one hub are
one group. First all members are held against their hub. Then groups whose members are still in several components are
compared whole: members outside the largest component against all others, in cells of bounded size. A cell applies the
prefix filters of all orders, verifies what is left on the whole sets, and returns only links that join components, so
no pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import exchange as X
from .runtime import written
from .substring import member
from .suffixes import FLAGGED, MARKS, flag_marks

SHINGLE = 5
BATCH_BYTES = 1 << 20
#: Batches for each file of what is written between steps, at least.
FILE_BATCHES = 8
ORDERS = 3
#: Counters of the table of token counts, 4 bytes each: what the driver holds and sends to each task.
COUNTERS = 1 << 20
BLOCKS = 64
#: Shingles on each side of a cell, about.
CELL_TOKENS = 1 << 18

#: Bits of the fixed-size filter of wanted ids.
FILTER_BITS = 1 << 23

SETS = "doc_id long, text_key long, n_shingles long, n_shared long, set_one long, set_two long, prefixes array<array<long>>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and where each text's begin.

    A shingle is five words; a text of one to four words has one shingle, all its words.
    """
    words, first = A.hashed_words(data, offsets, lower=True)
    n = len(offsets) - 1
    owner = A.owners(first)
    grams = A.gram_hashes(words, SHINGLE)
    inside = np.flatnonzero(owner[: len(grams)] == owner[SHINGLE - 1 :]) if len(grams) else np.zeros(0, np.int64)
    values, of = [grams[inside]], [owner[inside]]
    length = np.diff(first)
    for k in range(1, SHINGLE):
        few = np.flatnonzero(length == k)
        if len(few):
            values.append(A.gram_hashes(words, k)[first[few]] + A.U64(k))
            of.append(few)
    value, of = np.concatenate(values), np.concatenate(of)
    if len(values) > 1:
        order = np.argsort(of, kind="stable")
        value, of = value[order], of[order]
    new = ~pd.Series(value ^ A.mix(of.astype(A.U64) + A.U64(1))).duplicated().to_numpy()
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(n + 1))


def token_counts(docs: DataFrame) -> np.ndarray:
    """How many texts' tokens fall on each counter. The table has a fixed size, whatever the corpus."""
    width = COUNTERS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int64)
        for batch in A.slices(batches):
            tokens, _ = shingle_sets(*A.utf8(batch.column("text")))
            table += np.bincount((tokens & A.U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        parts = [np.minimum(p, 2**31 - 1).astype(np.int32).tobytes() for p in table.reshape(BLOCKS, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for part in table.column("counts"):
            total += np.frombuffer(part.as_py(), np.int32)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    blocks = X.grouped(docs.select("text").mapInArrow(count, "block int, counts binary"), "block", add, "block int, counts binary")
    out = np.zeros((BLOCKS, width), np.int32)
    for row in blocks.collect():  # BLOCKS rows, 4 * COUNTERS bytes in all
        out[row["block"]] = np.frombuffer(row["counts"], np.int32)
    return out.reshape(-1)


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Of a set of n tokens, how many make sure to meet a set of similarity 4/5: n - ceil(4 n / 5) + 1."""
    return np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)


def prefixes(tokens: np.ndarray, first: np.ndarray, take: np.ndarray, common: np.ndarray, order: int) -> list[list[int]]:
    """The first ``take`` of each set's shared tokens under one order: common ones last, else by hash."""
    keys = A.mix(tokens ^ A.U64(0x5851F42D4C957F2D * order & (2**64 - 1))) >> A.U64(6)
    keys |= common[(tokens & A.U64(COUNTERS - 1)).astype(np.int64)].astype(A.U64) << A.U64(58)
    out = []
    for a, b, k in zip(first[:-1].tolist(), first[1:].tolist(), take.tolist()):
        out.append(tokens[a:b][np.argpartition(keys[a:b], k - 1)[:k]].view(np.int64).tolist() if k > 0 else [])
    return out


def send_tokens(texts: pa.Table, buckets: int) -> pa.Table:
    """The tokens of a batch, and whether two of its sets have them."""
    tokens, _ = shingle_sets(*X.texts_of(texts))
    keys, count = np.unique(X.short(tokens, buckets), return_counts=True)
    return X.packed_short(texts.column("batch")[0].as_py(), keys, count > 1)


def keep_sets(texts: pa.Table, answers: pa.Table, buckets: int, common) -> pa.Table:
    """Each document's set: its size and hashes, how many of its tokens other documents have, and the shared tokens of
    its prefixes, null if there are none (then it is similar to no other)."""
    names = [c.split()[0] for c in SETS.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.list_(pa.int64()))]
    if not texts.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    tokens, first = shingle_sets(*X.texts_of(texts))
    sizes = np.diff(first)
    keys = X.short(tokens, buckets)
    hit = member(keys, np.sort(X.read_short(answers, "common")[0]))[0]
    bounds = np.concatenate([[0], np.cumsum(hit)])[first]
    shared = np.diff(bounds)
    # tokens of no other document come first in every order
    take = np.minimum(prefix_size(sizes) - (sizes - shared), shared)
    parts = [prefixes(keys[hit], bounds, take, common.value, k) for k in range(ORDERS)]
    lists = [list(own) if own[0] else None for own in zip(*parts)]
    one, two = set_hashes(tokens, first)
    columns = [texts.column("doc_id"), texts.column("text_key"), sizes, shared, one, two, lists]
    return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A fixed-size bit table (packed) of the ids' hashes, to leave out most rows of other ids before a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[bit_of(batch.column("id").to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.packbits(bits).tobytes()])], ["k", "bits"])

    def either(table: pa.Table) -> pa.Table:
        total = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")])
        return pa.table({"k": pa.array([0], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    rows = X.grouped(ids.toDF("id").mapInArrow(run, "k int, bits binary"), "k", either, "k int, bits binary").collect()
    return np.frombuffer(rows[0]["bits"], np.uint8) if rows else np.zeros(FILTER_BITS // 8, np.uint8)


def bit_of(ids: np.ndarray) -> np.ndarray:
    return (A.mix(ids.astype(np.int64).view(A.U64)) & A.U64(FILTER_BITS - 1)).astype(np.int64)


def is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the bits at some places of a packed table are set."""
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def set_hashes(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, whatever the order of its tokens."""
    sizes = np.diff(first).astype(A.U64)
    sums = [np.concatenate([np.zeros(1, A.U64), np.cumsum(A.mix(tokens + A.U64(k)))]) for k in (1, 2)]
    one, two = (A.mix(s[first[1:]] - s[first[:-1]] + sizes).view(np.int64) for s in sums)
    return one, two


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class_id, set_one and all shingles of the classes that ``wanted`` names, each set once.

    Rows of other ids are left out by a fixed-size bit table where the wanted ids leave most of it empty; the semi join
    that follows is exact in any case.
    """
    wanted = wanted.distinct()
    rows, bits = docs.select("doc_id", "text"), None
    if wanted.count() <= FILTER_BITS // 8:
        bits = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))  # FILTER_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                own = batch.column("doc_id")
                keep = is_set(bits.value, bit_of(own.fill_null(0).to_numpy())) | own.is_null().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(keep))
            for part in A.slices([batch]):
                tokens, first = shingle_sets(*A.utf8(part.column("text")))
                one, _ = set_hashes(tokens, first)
                own = part.column("doc_id").to_pylist()
                ids = pa.array([surrogate(int(h)) if i is None else i for i, h in zip(own, one.tolist())], pa.int64())
                shingles = A.list_array(pa.array(tokens.view(np.int64)), np.diff(first))
                yield pa.RecordBatch.from_arrays([ids, pa.array(one), shingles], ["class_id", "set_one", "shingles"])

    found = rows.mapInArrow(run, "class_id long, set_one long, shingles array<long>")
    return found.join(wanted, "class_id", "left_semi").groupBy("class_id", "set_one").agg(F.first("shingles").alias("shingles"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets have a similarity of 4/5 or more."""
    both = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()  # without repeats
                same = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * same >= 80 * (len(x) + len(y) - same))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def components(links: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """node, component: the least node that links lead to, for all nodes with links.

    Large-star and small-star steps in turn, each a group-by on slim rows, until nothing changes. A step writes at most
    ``files`` files.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name, files)
    while True:
        # every node links its larger neighbours to its least one, itself included
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every node links its smaller neighbours and itself to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, name, files)
        # both are sets; one shuffle without a join, as each shuffle and broadcast starts threads of the driver
        sides = edges.select("u", "v", F.lit(1).alias("side")).union(after.select("u", "v", F.lit(2).alias("side")))
        if not sides.groupBy("u", "v").agg(F.sum("side").alias("sides")).where("sides <> 3").head(1):
            break
        edges = after
    return after.select(F.col("u").alias("node"), F.col("v").alias("component"))


def may_match(n_a: Column, shared_a: Column, n_b: Column, shared_b: Column) -> Column:
    """Two sets of similarity 4/5 have sizes within 4/5, and an overlap of 4/9 of both sizes together; the overlap is no
    more than what either shares with any others."""
    return (5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)) & (9 * F.least(shared_a, shared_b) >= 4 * (n_a + n_b))


def candidates(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (a, b) that share a token in every other order's prefix too."""
    side = lambda s: classes.select(F.col("class_id").alias(s), F.col("prefixes").alias(f"p_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    test = F.lit(True)
    for k in range(1, ORDERS):
        test = test & F.arrays_overlap(F.get("p_a", F.lit(k)), F.get("p_b", F.lit(k)))
    return both.where(test).select("a", "b").distinct()


class Lists:
    """Values of many rows laid end to end, as codes."""

    def __init__(self, column: pa.Array):
        values, self.code = np.unique(column.flatten().to_numpy(), return_inverse=True)
        self.code, self.first, self.mark = self.code.astype(np.int32), column.offsets.to_numpy().astype(np.int64), np.zeros(len(values), bool)
        self.first = self.first - self.first[0]

    def overlaps(self, row: int, others: np.ndarray) -> np.ndarray:
        """How many values each of the other rows, none of them empty, has in common with one row."""
        own = self.code[self.first[row] : self.first[row + 1]]
        self.mark[own] = True
        sizes = self.first[others + 1] - self.first[others]
        hits = np.add.reduceat(self.mark[self.code[A.spread(self.first[others], sizes)]], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.mark[own] = False
        return hits


def join_cell(cell: pa.Table) -> pa.Table:
    """Links (a, b) between members outside the largest component and all others of a cell, as few as join the same
    components: a pair must pass the size and shared-token bounds and the prefix filter of every order, then its whole
    sets are compared; members that are already connected are not."""
    cell = cell.combine_chunks()
    array = lambda name: cell.column(name).combine_chunks()
    flat = lambda a: a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    ids, n, shared = (flat(array(c)).to_numpy() for c in ("class_id", "n", "shared"))
    _, label = np.unique(flat(array("component")).to_numpy(), return_inverse=True)
    outside = flat(array("outside")).to_numpy(zero_copy_only=False).astype(bool)
    prefixes, shingles = flat(array("prefixes")), Lists(flat(array("shingles")))
    orders = [Lists(pa.compute.list_element(prefixes, k)) for k in range(ORDERS)]
    inside = np.flatnonzero(~outside)
    links = []
    for i in np.flatnonzero(outside).tolist():
        at = inside[label[inside] != label[i]]
        size, most = n[at], np.minimum(shared[at], shared[i])
        at = at[(5 * np.minimum(size, n[i]) >= 4 * np.maximum(size, n[i])) & (9 * most >= 4 * (size + n[i]))]
        for order in orders:
            at = at[order.overlaps(i, at) > 0] if len(at) else at
        if not len(at):
            continue
        same = shingles.overlaps(i, at)
        at = at[100 * same >= 80 * (n[at] + n[i] - same)]
        _, heads = np.unique(label[at], return_index=True)
        for j in at[heads].tolist():
            links.append((ids[i], ids[j]))
            label[label == label[j]] = label[i]
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def cells(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """Links that join components within groups, from (hub, class_id, n, component) rows.

    Members are dealt into blocks of about CELL_TOKENS shingles; a cell is a block of members outside the group's
    largest component with a block of all members.
    """
    sizes = members.groupBy("hub", "component").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    largest = sizes.groupBy("hub").agg(F.max_by(F.struct("component", "tokens"), F.struct("size", "component")).alias("top"), F.sum("tokens").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda tokens: F.ceil(tokens / CELL_TOKENS).cast("int")
    plan = largest.select("hub", F.col("top.component").alias("largest"), blocks(F.col("all")).alias("columns"), blocks(F.col("all") - F.col("top.tokens")).alias("rows"))
    placed = members.join(plan, "hub")
    dealt = lambda parts: F.pmod(F.xxhash64("class_id", "hub"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    own = placed.where("component <> largest").select("hub", "class_id", "component", dealt("rows").alias("row"), each("columns").alias("column"), F.lit(True).alias("outside"))
    others = placed.select("hub", "class_id", "component", dealt("columns").alias("column"), each("rows").alias("row"), F.lit(False).alias("outside"))
    rows = own.unionByName(others).join(profiles, "class_id")
    return rows.groupBy("hub", "row", "column").applyInArrow(join_cell, "a long, b long")


def surrogate(hashed: int) -> int:
    """Internal number of a class without any doc_id: its hash with the sign bit set."""
    return hashed | -(1 << 63)


def same_document(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) from the least to all other classes that have a row of one doc_id."""
    keys = ["set_one", "set_two"]
    rows = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    several = rows.groupBy("doc_id").agg(*(F.min(k).alias(f"{k}_min") for k in keys), *(F.max(k).alias(f"{k}_max") for k in keys))
    several = several.where("set_one_min <> set_one_max OR set_two_min <> set_two_max").select("doc_id")
    held = rows.join(several, "doc_id", "left_semi").select("doc_id", *keys).distinct().join(members.select(*keys, "class_id"), keys)
    least = held.groupBy("doc_id").agg(F.min("class_id").alias("a"))
    return held.join(least, "doc_id").where("a < class_id").select("a", F.col("class_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links lead to) of every document, and ``text_key``
    (a hash of its text) and ``component`` (a number of its component, whether its documents have ids or not).

    A null or empty text, or one without words, has no shingles and no links; its component is its own id. Rows of
    one doc_id count as one document: what links to one of them links to all. A document without an id links like any
    other; its component is the least id that links lead to, null if none of those documents has one. Other columns are
    not carried; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(np.log2(token_counts(docs) + 1).astype(np.int8))  # COUNTERS bytes
    texts, batches, buckets = X.batched(docs, BATCH_BYTES, text_key=F.xxhash64("text"))
    files = -(-batches // FILE_BATCHES)  # grows with the bytes of text
    sent = X.grouped(texts, "batch", partial(send_tokens, buckets=buckets), MARKS)
    shared = X.grouped(sent, "bucket", partial(flag_marks, many=batches + 1), FLAGGED)
    sets = written(X.meet(texts, shared, partial(keep_sets, buckets=buckets, common=common), SETS), "prefixes")

    keys = ["set_one", "set_two"]
    # equal sets are one class; its id is the least doc_id, or made of the set's hash where all are null
    members = sets.where("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("least_id"))
    members = members.withColumn("class_id", F.coalesce("least_id", F.col("set_one").bitwiseOR(F.lit(-(2**63)))))
    found = sets.where("prefixes IS NOT NULL").join(members, keys).where(F.col("doc_id").eqNullSafe(F.col("least_id")))
    classes = found.dropDuplicates(["class_id", *keys]).select("class_id", "set_one", F.col("n_shingles").alias("n"), F.col("n_shared").alias("shared"), "prefixes")
    classes = written(classes, "classes", files)

    entries = classes.select(F.struct("class_id", "n", "shared").alias("x"), F.explode(F.get("prefixes", F.lit(0))).alias("token"))
    hubs = entries.groupBy("token").agg(F.min("x").alias("hub"), F.max("x").alias("last")).where("hub.class_id < last.class_id").drop("last")
    groups = written(entries.join(hubs, "token").select("hub", "x").distinct(), "groups", files)
    sets_wanted = groups.select(F.col("x.class_id").alias("class_id"))
    whole = written(sets_of(docs, sets_wanted), "sets", files)

    star = groups.where((F.col("x.class_id") != F.col("hub.class_id")) & may_match(*(F.col(f"{s}.{c}") for s in ("hub", "x") for c in ("n", "shared"))))
    star = star.select(F.col("hub.class_id").alias("a"), F.col("x.class_id").alias("b")).distinct()
    links = written(similar(candidates(star, classes), whole).unionByName(same_document(sets, members)), "links", files)
    so_far = components(links, "first", files)
    placed = groups.select(F.col("hub.class_id").alias("hub"), "x.class_id", "x.n").distinct()
    placed = placed.join(so_far, F.col("class_id") == F.col("node"), "left").select("hub", "class_id", "n", F.coalesce("component", "class_id").alias("component"))
    profiles = classes.join(whole, ["class_id", "set_one"]).select("class_id", "n", "shared", "prefixes", "shingles")
    more = cells(placed, profiles)

    final = components(links.union(more), "second", files)
    least = members.join(final, F.col("class_id") == F.col("node"), "left").select(*keys, "least_id", F.coalesce("component", "class_id").alias("component"))
    named = least.groupBy("component").agg(F.min("least_id").alias("component_id"))
    place = least.join(named, "component").select(*keys, "component_id", "component")
    out = sets.select("doc_id", "n_shingles", "text_key", *keys)
    alone = out.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    out = out.where("n_shingles > 0").join(place, keys).unionByName(alone).select("doc_id", "n_shingles", "component_id", "text_key", "component")
    return out.coalesce(files)

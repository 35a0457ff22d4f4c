"""Document fingerprints from prefix polynomial hashes.

With the prefix hashes of a text any span's hash is one subtraction and one product, so two spans are compared
in constant time and the longest common extension is found by binary search. A fingerprint keeps the prefix
hashes at cuts, so the same search runs on fingerprints alone. Up to 32 cuts are evenly spaced, for texts that agree in
place; the others are chosen by content, where a run of 8 code points has the least hash around, so they move along with
the text when something is put in before them. There is one for about 25 code points at any length, so that a small change costs
about as much of a short text as of a long one: a fingerprint has about two fifths as many characters as its text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import range_bounds, range_of, shuffle_partitions
from .substring import sliding_least

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1812433253)
EVEN, WINDOW = 32, 8
#: A cut by content has the least hash of so many places on either side.
REACH = 12
LONGEST = 65_535


@lru_cache(maxsize=4)
def _powers(which: int, size: int) -> np.ndarray:
    p, out = PRIMES[which], np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(BASES[which], len(out), p)) % np.uint64(p)])
    return out


def powers(which: int, n: int) -> np.ndarray:
    return _powers(which, 1 << max(12, int(n).bit_length()))


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def prefix_hashes(points: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of every prefix: the sum of (code point + 1) * base**position, modulo a prime."""
    out = np.zeros(len(points) + 1, np.uint64)
    p = np.uint64(PRIMES[which])
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(which, len(points))[: len(points)] % p, out=out[1:])
    return out % p


def same_span(x: np.ndarray, i: int, y: np.ndarray, j: int, n: int, which: int = 0) -> bool:
    """Whether the texts of prefix hashes x and y agree on n code points from i and from j."""
    p, up = PRIMES[which], powers(which, max(i, j))
    a, b = (int(x[i + n]) - int(x[i])) % p, (int(y[j + n]) - int(y[j])) % p
    return a * int(up[j]) % p == b * int(up[i]) % p


def common_extension(x: np.ndarray, i: int, y: np.ndarray, j: int, which: int = 0) -> int:
    """Length of the longest common run from i and j, by binary search."""
    low, high = 0, min(len(x) - 1 - i, len(y) - 1 - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(x, i, y, j, middle, which):
            low = middle
        else:
            high = middle - 1
    return low


@lru_cache(maxsize=4)
def _inverses(which: int, size: int) -> np.ndarray:
    p, inverse, out = PRIMES[which], pow(BASES[which], -1, PRIMES[which]), np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(inverse, len(out), p)) % np.uint64(p)])
    return out


def window_hashes(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each run of WINDOW code points, the same wherever it stands, from prefix hashes."""
    p, n = np.uint64(PRIMES[0]), len(x) - WINDOW
    if n <= 0:
        return np.zeros(0, np.uint64)
    down = _inverses(0, 1 << max(12, int(n).bit_length()))[:n]
    span = (x[WINDOW:] + p - x[:-WINDOW]) % p * down % p
    span = (span + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return span >> np.uint64(32)


def cuts_of(x: np.ndarray) -> np.ndarray:
    """Places of the cuts by content, in order: where a window's hash is less than those of the REACH places before it and
    no more than those of the REACH places after it; and places in between, so that no two are over LONGEST apart."""
    hashes = window_hashes(x)
    around = np.full(len(hashes) + 2 * REACH, 1 << 32, np.uint64)
    around[REACH:-REACH] = hashes
    least = sliding_least(around, REACH)
    at = np.flatnonzero((hashes < least[: len(hashes)]) & (hashes <= least[REACH + 1 :]))
    gaps = np.diff(at, prepend=0, append=len(x) - 1)
    if len(gaps) and gaps.max() > LONGEST:
        edges = np.concatenate([[0], at, [len(x) - 1]])
        more = [np.arange(edges[k] + LONGEST, edges[k + 1], LONGEST) for k in np.flatnonzero(gaps > LONGEST)]
        at = np.sort(np.concatenate([at, *more]))
    return at[at > 0]


def fingerprint(text: str | None) -> str:
    """``length.stride.hash.even.cuts``: two hashes of the whole text; the prefix hash after each stride of code points; of
    each cut by content the prefix hash before it, 4 bytes, and how far it is from the one before, 2 bytes (base64)."""
    points = code_points(text)
    n = len(points)
    stride = 1 << max(0, (max(n, 1) - 1).bit_length() - EVEN.bit_length() + 1)
    first, second = (prefix_hashes(points, k) for k in (0, 1))
    places = cuts_of(first)
    cuts = first[places].astype("<u4").tobytes() + np.diff(places, prepend=0).astype("<u2").tobytes()
    even = "".join(f"{h:08x}" for h in first[stride::stride].tolist())
    return f"{n:x}.{stride:x}.{int(first[n]):08x}{int(second[n]):08x}.{even}.{base64.b64encode(cuts).decode()}"


def read(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the beginning, the cuts and the end; the prefix hashes there; of each span between two of them a key of
    its length and hash, the same wherever it stands."""
    n, _, whole, _, cuts = text.split(".")
    data, n = base64.b64decode(cuts), int(n, 16)
    count = len(data) // 6
    at = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u2", count, 4 * count), dtype=np.int64), [n]])
    hashes = np.concatenate([[0], np.frombuffer(data, "<u4", count), [int(whole[:8], 16)]]).astype(np.uint64)
    p = np.uint64(PRIMES[0])
    down = _inverses(0, 1 << max(12, n.bit_length()))
    keys = (hashes[1:] + p - hashes[:-1]) % p * down[at[:-1]] % p
    return at, hashes, keys << np.uint64(32) | np.diff(at).astype(np.uint64)


def likeness(a: str, b: str) -> float:
    """Share of the longer text that stands in the other one too, as far as the cuts can tell: at the same place, or
    anywhere, whichever is more; 1 for equal texts."""
    return 1.0 if a == b else max(in_place(a, b), anywhere(a, b))


def in_place(a: str, b: str) -> float:
    """Share of the longer text that agrees at the same place in both, by the evenly spaced cuts."""
    (na, sa, _, ca, _), (nb, sb, _, cb, _) = a.split("."), b.split(".")
    stride = max(int(sa, 16), int(sb, 16))

    def cuts(s: str, own: str) -> list[int]:
        every = stride // int(own, 16)
        return [0] + [int(s[8 * k : 8 * k + 8], 16) for k in range(every - 1, len(s) // 8, every)]

    x, y = cuts(ca, sa), cuts(cb, sb)
    n, p = min(len(x), len(y)) - 1, PRIMES[0]
    at = same = 0
    while at < n:
        low, high = 0, n - at  # the span from this cut agrees up to some cut: binary search, as on the texts
        while low < high:
            middle = (low + high + 1) // 2
            if (x[at + middle] - x[at] - y[at + middle] + y[at]) % p == 0:
                low = middle
            else:
                high = middle - 1
        same += low
        at += low + 1
    return min(1.0, same * stride / max(int(na, 16), int(nb, 16), 1))


def anywhere(a: str, b: str) -> float:
    """Share of the longer text that stands anywhere in the other: from each span that both have, the longest common
    extension over the following cuts is found by binary search."""
    (at_a, x, keys_a), (at_b, y, keys_b) = read(a), read(b)
    distinct, first = np.unique(keys_b, return_index=True)
    where = np.minimum(np.searchsorted(distinct, keys_a), len(distinct) - 1)
    found = np.flatnonzero(distinct[where] == keys_a)
    p, up = PRIMES[0], powers(0, max(int(at_a[-1]), int(at_b[-1])))
    same = done = 0  # spans before done are counted already
    for i, j in zip(found.tolist(), first[where[found]].tolist()):
        if i < done:
            continue
        from_a, from_b, x_i, y_j = int(at_a[i]), int(at_b[j]), int(x[i]), int(y[j])
        up_a, up_b = int(up[from_a]), int(up[from_b])

        def agree(m: int) -> bool:
            if int(at_a[i + m]) - from_a != int(at_b[j + m]) - from_b:
                return False
            return ((int(x[i + m]) - x_i) * up_b - (int(y[j + m]) - y_j) * up_a) % p == 0

        low, most = 1, min(len(keys_a) - i, len(keys_b) - j)
        step = 1  # doubled as long as spans agree, so that a search costs the logarithm of what it finds
        while low < most and agree(min(low + step, most)):
            low, step = min(low + step, most), 2 * step
        high = min(low + step, most + 1) - 1
        while low < high:
            middle = (low + high + 1) // 2
            if agree(middle):
                low = middle
            else:
                high = middle - 1
        same, done = same + int(at_a[i + low]) - from_a, i + low
    return min(1.0, same / max(int(at_a[-1]), int(at_b[-1]), 1))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text rows' raw material: rows in ranges of doc_id, each range with the row that follows it.

    Columns: bucket, role (0: a row of the range, 1: the head of the following range), doc_id, text. Texts are
    shuffled once; only each range's head row is doubled.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    docs = docs.select("doc_id", "text")
    bounds = range_bounds(docs, "doc_id", min(512, 4 * parts))
    bucket = range_of(F.col("doc_id"), bounds)
    # one row for each range, at most 512
    heads = docs.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("_head"))
    order = Window.orderBy("bucket")
    heads = heads.select("bucket", "_head", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(Window.partitionBy())).alias("_follows"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("role"))
    tail = F.struct(F.col("_follows").alias("bucket"), F.lit(1).alias("role"))
    return (
        docs.withColumn("bucket", bucket)
        .join(F.broadcast(heads), "bucket")
        .withColumn("_at", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("_head")), F.array(own, tail)).otherwise(F.array(own))))
        .select("_at.bucket", "_at.role", "doc_id", "text")
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and their likenesses.

    The edited text has the last third replaced by the start of the next document, in descending order of doc_id
    (the last one's next is the first). Null ids come last; rows with one id are ordered by text. A null text is
    empty; two empty texts are alike (1), an empty and another one are not (0).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one has not come yet
        for batch in batches:
            out: list[tuple] = []
            for bucket, role, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "role", "doc_id", "text"))):
                text = text or ""
                if held and held[0] == bucket and held[1] is not None:
                    out.append(compared(held[2], held[3], held[4], text, own := fingerprint(text)))
                else:
                    own = fingerprint(text)
                # the rows after a range's first following row are its own repeats
                held = (bucket, None, None, None, None) if role else (bucket, 0, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)

    rows = with_next(docs)
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "bucket")
    rows = rows.sortWithinPartitions("bucket", "role", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return rows.mapInArrow(run, SCHEMA)


NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in SCHEMA.split(", ")]


def compared(doc_id: int | None, text: str, own: str, following: str, following_print: str) -> tuple:
    part = len(text) // 3
    edited = text[: len(text) - part] + following[:part]
    edited_print = fingerprint(edited)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return doc_id, len(text), digest, own, edited_print, likeness(own, edited_print), likeness(own, following_print)

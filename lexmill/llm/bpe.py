"""Byte-level BPE encoding and decoding.

Texts are cut into pieces without a regular expression: each code point gets a class (letter, number, space,
other, ...), a class is a function from scanner state to scanner state, and the functions are composed by an
associative scan over blocks. Equal pieces of a slice are merged once; merges are cached across slices.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A

ENCODED = "doc_id long, ids array<int>, offsets array<int>"
BLOCK = 64
#: Entries of a worker's piece cache; when it is full it starts anew, so results don't depend on it.
CACHE = 300_000
#: From this many bytes on, a piece is merged with a heap.
LONG_PIECE = 200
NONE = 1 << 40

# Scanner symbols. An apostrophe that a contraction of one or two letters follows has a symbol of its own, and so
# have the last space of a run that a non-space follows (plain or other) and the other spaces.
LETTER, NUMBER, OTHER, SHORT, PAIR, SPACE, LAST_PLAIN, LAST_OTHER = range(8)
FIRST = 8  # added at a text's first code point
IDENTITY = 16
# Scanner states: what the open piece is. TWO and ONE: letters that a contraction still takes.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, OPEN_PLAIN, TWO, ONE = range(8)

WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for each code point."""
    major = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece starts, for symbol * 8 + state."""
    to, cut = np.zeros((17, 8), np.uint8), np.zeros((17, 8), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for state in range(8):
        for symbol, own in runs.items():
            to[symbol, state], cut[symbol, state] = own, state not in (own, OPEN_PLAIN)
        for symbol, left in ((SHORT, ONE), (PAIR, TWO)):
            inside = state in (IN_OTHERS, OPEN_PLAIN)
            to[symbol, state], cut[symbol, state] = (IN_OTHERS if inside else left), not inside
        to[SPACE, state], cut[SPACE, state] = IN_SPACES, state != IN_SPACES
        to[LAST_PLAIN, state], cut[LAST_PLAIN, state] = OPEN_PLAIN, True
        to[LAST_OTHER, state], cut[LAST_OTHER, state] = START, True
    to[LETTER, TWO], cut[LETTER, TWO] = ONE, False
    to[LETTER, ONE], cut[LETTER, ONE] = START, False
    for symbol in range(8):
        to[symbol + FIRST], cut[symbol + FIRST] = to[symbol, START], True
    to[IDENTITY] = np.arange(8)
    return to.ravel(), cut.ravel()


NEXT, CUT = _transitions()


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Scanner symbol of each code point; firsts: where texts start."""
    n = len(points)
    kind = point_classes()[points]
    begins = np.zeros(n + 2, bool)
    begins[firsts] = True
    begins[n:] = True
    one, two = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    one[:-1], two[:-2] = points[1:], points[2:]
    one[begins[1 : n + 1]] = 0
    two[begins[1 : n + 1] | begins[2 : n + 2]] = 0
    marks = np.flatnonzero(points == ord("'"))
    a, b = one[marks], two[marks]
    is_ = lambda x, chars: np.isin(x, [ord(c) for c in chars])
    kind[marks[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = PAIR
    kind[marks[is_(a, "stmd")]] = SHORT
    space = kind == SPACE
    follows = np.zeros(n, bool)
    follows[:-1] = ~space[1:]
    follows &= ~begins[1 : n + 1]
    last = space & follows
    kind[last] = LAST_OTHER
    kind[last & (points == 32)] = LAST_PLAIN
    kind[firsts] += FIRST
    return kind


def boundaries(symbol: np.ndarray) -> np.ndarray:
    """Where pieces start, by composing the symbols' transition functions.

    Each block of symbols is composed to one function of eight states, the blocks' functions are composed by a
    doubling scan, and with the state before each block known, all blocks are walked side by side.
    """
    n = len(symbol)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, IDENTITY, np.intp)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) * 8
    composed = np.tile(np.arange(8, dtype=np.intp), (blocks, 1))
    for column in columns:
        composed = NEXT.take(column[:, None] + composed).astype(np.intp)
    step = 1
    while step < blocks:
        later = np.take_along_axis(composed[step:], composed[:-step], 1)
        composed = np.concatenate([composed[:step], later])
        step *= 2
    state = np.empty(blocks, np.intp)
    state[0], state[1:] = START, composed[:-1, START]
    cuts = np.empty((BLOCK, blocks), bool)
    for j, column in enumerate(columns):
        at = column + state
        cuts[j], state = CUT.take(at), NEXT.take(at).astype(np.intp)
    return np.flatnonzero(cuts.T.reshape(-1)[:n])


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces start in the texts' bytes."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    begin = offsets[:-1][np.diff(offsets) > 0]
    return at[boundaries(symbols(points, np.searchsorted(at, begin)))]


class Vocabulary:
    """Ranks of byte strings, and the merged pieces seen so far."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        size = max(self.ranks.values()) + 1
        self.bytes = np.full(size, b"", object)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, size)
        self.decimals = np.array([b"%d" % i for i in range(size)], object)
        self.single = np.fromiter((self.ranks[bytes([i])] for i in range(256)), np.int64, 256)
        self.cache: dict[bytes, list[int]] = {}
        self._pair_table()

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of distinct pieces: the adjacent pair of least rank is merged again and again, the leftmost first."""
        cache = self.cache
        if len(cache) >= CACHE:
            cache.clear()
        new = [p for p in pieces if p not in cache]
        short = [p for p in new if len(p) <= LONG_PIECE]
        cache.update(zip(short, self._merge_short(short)))
        long = {p: self._merge_long(p) for p in new if len(p) > LONG_PIECE}
        return [cache[p] if p in cache else long[p] for p in pieces]

    def _merge_short(self, pieces: list[bytes]) -> list[list[int]]:
        """One merge of each unfinished piece a round, for all pieces side by side."""
        if not pieces:
            return []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = self.pair_ranks(ids, piece)
        while len(ids):
            heads = np.flatnonzero(np.diff(piece, prepend=-1))
            lengths = np.diff(heads, append=len(ids))
            least = np.minimum.reduceat(rank, heads)
            stays = np.repeat(least < NONE, lengths)
            if not stays.all():
                done.append((piece[~stays], ids[~stays]))
                ids, piece, rank = ids[stays], piece[stays], rank[stays]
                lengths, least = lengths[least < NONE], least[least < NONE]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, lengths))
            hits = hits[np.flatnonzero(np.diff(piece[hits], prepend=-1))]
            ids[hits] = rank[hits]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))
            ids, piece, rank = ids[keep], piece[keep], rank[keep]
            near = np.concatenate([at, at[at > 0] - 1])
            rank[near] = self.pair_ranks(ids, piece, near)
        piece, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(piece, kind="stable")
        ends = np.cumsum(np.bincount(piece, minlength=len(pieces))).tolist()
        flat = ids[order].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def pair_ranks(self, ids: np.ndarray, piece: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of the token that each id makes with the next one of its piece, NONE without one."""
        n = len(ids)
        at = np.arange(n) if at is None else at
        out = np.full(len(at), NONE, np.int64)
        inner = np.flatnonzero(at + 1 < n)
        inner = inner[piece[at[inner]] == piece[at[inner] + 1]]
        key = ids[at[inner]] << 32 | ids[at[inner] + 1]
        slot = self._slot(key)
        while len(key):
            there = self.pair_keys[slot]
            same = there == key
            out[inner[same]] = self.pair_values[slot[same]]
            on = ~same & (there >= 0)
            key, inner, slot = key[on], inner[on], (slot[on] + 1) & (len(self.pair_keys) - 1)
        return out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (A.mix(key.astype(np.uint64)) & A.U64(len(self.pair_keys) - 1)).astype(np.int64)

    def _pair_table(self) -> None:
        """A hash table with open addressing from pairs of ids to the rank of their concatenation."""
        get, pairs = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        size = 1 << (3 * len(pairs) + 1).bit_length()
        self.pair_keys, self.pair_values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        key, value = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.pair_keys[slot] < 0
            self.pair_keys[slot[free]], self.pair_values[slot[free]] = key[free], value[free]
            lost = self.pair_keys[slot] != key
            key, value, slot = key[lost], value[lost], (slot[lost] + 1) & (size - 1)

    def _merge_long(self, piece: bytes) -> list[int]:
        get, n = self.ranks.get, len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, length = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or end[j] - i != length:
                continue
            gone[j], end[i], after[i] = 1, end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]] - i))
            if (h := before[i]) >= 0 and (r := get(piece[h : end[i]])) is not None:
                heapq.heappush(heap, (r, h, end[i] - h))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        code, distinct = pd.factorize(A.span_hash(A.byte_sums(data), starts, ends))
        where = np.empty(len(distinct), np.intp)
        where[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        whole = data.tobytes()
        merged = self.merge([whole[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())])
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter(chain.from_iterable(merged), np.int32, int(sizes.sum()))
        counts = sizes[code]
        ids = flat[A.spread((np.cumsum(sizes) - sizes)[code], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        per_text = np.diff(total[np.searchsorted(starts, offsets)])
        return ids, per_text

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes[ids].tolist())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """doc_id, ids and the byte at which each token starts in its text."""
    vocab = vocabulary(path)
    for batch in A.slices(batches):
        data, offsets = A.utf8(batch.column("text"))
        ids, counts = vocab.encode(data, offsets)
        lengths = vocab.lengths[ids]
        starts = np.cumsum(lengths) - lengths - np.repeat(offsets[:-1], counts)
        columns = [batch.column("doc_id"), A.list_array(pa.array(ids), counts), A.list_array(pa.array(starts.astype(np.int32)), counts)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "offsets"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids and token byte offsets of every whole text.

    A null or empty text has no tokens. Rows keep their doc_id, null or repeated ones too; other columns are not
    carried. Nothing is shuffled.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: encoded(batches, path), ENCODED)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of ids as ``encode`` gives them; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text, decode its ids again, and return digests of both, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in encoded(batches, path):
            lists = batch.column("ids")
            ids, at = lists.values.to_numpy(), lists.offsets.to_pylist()
            rows = [ids[a:b] for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(at).astype(np.int64)),
                    pa.array([hashlib.sha256(b" ".join(vocab.decimals[x].tolist())).hexdigest() for x in rows]),
                    pa.array([hashlib.sha256(vocab.decode(x)).hexdigest() for x in rows]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)

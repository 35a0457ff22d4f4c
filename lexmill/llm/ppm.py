"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of what followed them. A byte that
never followed a context is reached by escaping to the next shorter one, whose counts then leave out what the longer
one could have coded, so that the probabilities of all bytes after any context sum to one. The counts are frozen: the
code length of a text is the sum of the code lengths of its bytes, each of which depends on ORDER + 1 bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .runtime import written

ORDER = 4
#: Stands for what is before a text; no byte of UTF-8.
PAD = 0xFF
#: Bytes of a piece of a training text, and bytes whose codes a task holds at once.
PIECE = 4096
HELD = 1 << 20
#: Code lengths that a task looks up instead of computing them, over all languages.
TABLE = 1 << 24
FOLDS = 5
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"

U64 = np.uint64


def low(codes: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of each code."""
    return codes & U64((1 << 8 * n) - 1)


def codes_of(data: np.ndarray, offsets: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
    """For the bytes from start to end: each with the ORDER bytes before it, PAD where its text has no more."""
    end = len(data) if end is None else end
    before = data[max(0, start - ORDER) : end].astype(U64)
    before = np.concatenate([np.full(ORDER - min(start, ORDER), PAD, U64), before])
    codes = np.zeros(end - start, U64)
    for j in range(ORDER + 1):
        codes |= before[ORDER - j : len(before) - j] << U64(8 * j)
    heads, ends = offsets[:-1], offsets[1:]
    for t in range(ORDER):
        at = (heads + t)[heads + t < ends] - start
        pads = ((1 << 8 * (ORDER + 1)) - 1) ^ ((1 << 8 * (t + 1)) - 1)
        codes[at[(at >= 0) & (at < len(codes))]] |= U64(pads)
    return codes


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted values stand in sorted keys, and whether they do."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Level:
    """Contexts of one length: how often each was met, how many bytes followed it, and how often the next shorter context
    was followed by one of those; and each context with a byte that followed it, with its count."""

    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    shared: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray


def tree(codes: np.ndarray) -> list[Level]:
    """The context tree over training codes, by length of context."""
    levels: list[Level] = []
    pairs, counts = np.unique(codes, return_counts=True)
    for k in range(ORDER, -1, -1):
        if k < ORDER:
            pairs, where = np.unique(low(pairs, k + 1), return_inverse=True)
            counts = np.bincount(where, counts).astype(np.int64)
        contexts, of = np.unique(pairs >> U64(8), return_inverse=True)
        levels.insert(0, Level(contexts, np.bincount(of, counts).astype(np.int64), np.bincount(of), np.zeros(len(contexts), np.int64), pairs, counts))
    for k in range(1, ORDER + 1):
        own, shorter = levels[k], levels[k - 1]
        at, _ = find(shorter.pairs, low(own.pairs, k))
        of, _ = find(own.contexts, own.pairs >> U64(8))
        own.shared = np.bincount(of, shorter.counts[at], len(own.contexts)).astype(np.int64)
    return levels


def code_lengths(levels: list[Level], codes: np.ndarray) -> np.ndarray:
    """Bits of each code's last byte after the bytes before it."""
    bits = np.zeros(len(codes))
    out_total, out_kinds = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    still = np.arange(len(codes))
    for k in range(ORDER, -1, -1):
        level, own = levels[k], codes[still]
        at, met = find(level.contexts, low(own >> U64(8), k))
        total = np.where(met, level.total[at] - out_total[still], 0)
        kinds = np.where(met, level.kinds[at] - out_kinds[still], 0)
        pair, coded = find(level.pairs, low(own, k + 1))
        some = total > 0  # a context all of whose bytes are left out says nothing, and costs nothing
        coded &= some
        bits[still[some]] += np.log2((total + kinds)[some])
        bits[still[coded]] -= np.log2(level.counts[pair[coded]])
        escaped = some & ~coded
        bits[still[escaped]] -= np.log2(kinds[escaped])
        out_total[still], out_kinds[still] = np.where(met, level.shared[at], 0), np.where(met, level.kinds[at], 0)
        still = still[~coded]
    bits[still] += np.log2(256 - out_kinds[still])
    return bits


class Model:
    """The trees of all languages, and a table of the code lengths of the codes that training met most often."""

    def __init__(self, pieces: dict[str, list[bytes]]):
        self.languages = sorted(pieces)
        met = []
        for language in self.languages:
            own = [p for p in pieces[language] if p]
            met.append(codes_of(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])))
        self.trees = [tree(codes) for codes in met]
        known, counts = np.unique(np.concatenate(met), return_counts=True) if met else (np.zeros(0, U64), np.zeros(0, np.int64))
        most = TABLE // max(1, len(met))
        known = np.sort(known[np.argsort(-counts, kind="stable")[:most]])
        self.shift = U64(64 - max(4, (2 * len(known)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.known = known
        left = np.arange(len(known))
        slot = self.slot(known)
        while len(left):  # each round gives a free slot to one of those that want it; the others go on to the next slot
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) % len(self.slots)
        self.bits = [np.append(code_lengths(levels, known), 0).astype(np.float32) for levels in self.trees]  # the last is that of index -1

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Index of each code among the known ones, -1 for others."""
        slot = self.slot(codes)
        found = self.slots[slot]
        wrong = np.flatnonzero((found >= 0) & (self.known[found] != codes)) if len(self.known) else np.zeros(0, np.int64)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % len(self.slots)
            found[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.known[found[wrong]] != codes[wrong])]
        return found

    def text_bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text (rows) in each language, in bits."""
        sums = np.zeros((len(offsets) - 1, len(self.languages)))
        for start in range(0, len(data), HELD):
            end = min(len(data), start + HELD)
            codes = codes_of(data, offsets, start, end)
            at = self.lookup(codes)
            new, where = np.unique(codes[at < 0], return_inverse=True)
            cuts = np.clip(offsets - start, 0, len(codes))
            texts = np.flatnonzero(np.diff(cuts))
            for k, levels in enumerate(self.trees):
                bits = self.bits[k][at].astype(float)
                if len(new):
                    bits[at < 0] = code_lengths(levels, new)[where]
                sums[texts, k] += np.add.reduceat(bits, cuts[texts])
        return sums


def likeliest(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language with the shortest code, the first of equal ones, and its share of the probability of all."""
    best = bits.argmin(1)
    odds = np.exp2(-(bits - bits.min(1, keepdims=True)))
    return best, 1 / odds.sum(1)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: by crc32 of its id; a null id counts as an empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def training_pieces(docs: DataFrame, sample_bytes: int, all_bytes: int, most_languages: int) -> dict[str, list[bytes]]:
    """A sample of pieces of the training texts of each language, of bounded size: whole texts are cut into pieces of PIECE
    bytes, and of each language those of least hash are taken, equal texts once."""
    rows = docs.where(~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("text").alias("key")).where("lang IS NOT NULL AND octet_length(text) > 0")
    sizes = rows.groupBy("lang", "key").agg(F.max(F.octet_length("text")).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    sizes = sizes.orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not sizes:
        return {}
    own = min(sample_bytes, all_bytes // len(sizes))
    #: twice what is wanted, as hashes do not cut evenly
    bars = {r["lang"]: min(1.0, 2 * (own + PIECE) / r["n"]) for r in sizes}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches):
            data, offsets = A.utf8(batch.column("text"))
            counts = -(-np.diff(offsets) // PIECE)
            text = np.repeat(np.arange(len(counts)), counts)
            number = A.spread(np.zeros(len(counts), np.int64), counts)
            keys = batch.column("key").to_numpy().view(U64)
            drawn = A.mix(keys[text] + A.mix(number.astype(U64)))
            bar = np.array([bars.get(x, 0.0) for x in batch.column("lang").to_pylist()])
            taken = np.flatnonzero((drawn >> U64(11)) / (1 << 53) < bar[text])
            starts = offsets[text[taken]] + number[taken] * PIECE
            ends = np.minimum(starts + PIECE, offsets[text[taken] + 1])
            pieces = [data[a:b].tobytes() for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(text[taken])), pa.array((drawn[taken] >> U64(1)).astype(np.int64)), pa.array(pieces, pa.binary())], ["lang", "drawn", "piece"])

    found = rows.mapInArrow(cut, "lang string, drawn long, piece binary").groupBy("lang", "drawn").agg(F.first("piece").alias("piece"))
    upto = F.sum(F.octet_length("piece")).over(Window.partitionBy("lang").orderBy("drawn"))  # some two samples of each language
    pieces: dict[str, list[bytes]] = {}
    for row in written(found, "pieces").withColumn("upto", upto).where(F.col("upto") <= own + PIECE).orderBy("lang", "drawn").collect():
        pieces.setdefault(row["lang"], []).append(bytes(row["piece"]))
    return pieces


def identified(docs: DataFrame, sample_bytes: int = 1 << 19, all_bytes: int = 1 << 23, most_languages: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of documents.

    Learned from text and language of the documents that are not held out: at most ``sample_bytes`` of each language and
    ``all_bytes`` in all, in pieces drawn from whole texts; of more than ``most_languages``, those with most text. A
    language takes part if some training text has it. Every whole text is scored byte by byte in all languages; the
    shortest code wins, the first language by name among equal ones; the score is its probability when all languages are
    as likely beforehand. A null text, and one without a letter, is ``und`` with score 0, and so is every text if there is
    nothing to learn from. Rows do not move; an empty table gives no rows.
    """
    model = Model(training_pieces(docs, sample_bytes, all_bytes, most_languages))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size, as the sample is

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in A.slices(batches):
            n = batch.num_rows
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(n, len(names) - 1), np.zeros(n)
            if len(names) > 1 and n:
                found, share = likeliest(model.text_bits(*A.utf8(batch.column("text"))))
                best, score = np.where(lettered, found, best), np.where(lettered, share, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), lettered.alias("lettered"), "text").mapInArrow(predict, RESULT)

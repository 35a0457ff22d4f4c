"""Scores of texts under a smoothed three-word model, as one walk over a weighted backoff automaton.

States are histories. The root gives each token its add-one probability. Every word seen in training is a state, and
every pair of words that training has CONTEXT times at least. A state's arcs are the tokens seen after its history,
weighted by an interpolation of their relative count with what the shorter history gives them; its failure arc leads to
the state of the shorter history with the rest of the weight. After an arc the state is the longest history that is one.
Words, pairs and triples are counted over all training documents, at any size; interpolation weights, one for each order
and size of history counts, are the share of the training tokens that their history is followed by somewhere else too.

With a state h, its shorter history g and an arc to w: p(w) = r * c(h, w) / c(h) + (1 - r) * p(w after g); without an arc
the walk pays 1 - r and goes on from g. So what every state gives all tokens, one unknown token among them, adds up to 1.

The walk reads all texts of a batch side by side from left to right, long ones in pieces that begin two tokens early.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import exchange as X

BATCH_BYTES = 8 << 20
FOLDS, HELD_OUT = 7, 2
#: Times that training must have a pair for it to be a state of its own; the same at every size of corpus.
CONTEXT = 4
#: Tokens of a piece of a text that is walked by itself.
PIECE = 512
#: Sizes of history counts (powers of 4) that have an interpolation weight each.
SIZES = 24
#: Bits by which pairs and triples of one bucket are told apart; a bucket has those of about X.BUCKET_BYTES of text.
ARC_BITS = 40

END = A.U64(0x243F6A8885A308D3)
BEGIN = A.U64(0x13198A2E03707344)

COUNTED = "bucket int, batch long, n int, keys binary, values binary"
WORDS = "bucket int, batch long, n int, more binary, tokens long, types long"
ARCS = "bucket int, batch long, n int, more binary, seen array<struct<size: int, again: long, all: long>>"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: by crc32 of its id; a null id counts as an empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def tokens(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a batch, each text's words then END; the state each is read in; where each text starts."""
    words, first = A.hashed_words(*X.texts_of(texts), lower=True)
    n = len(first) - 1
    at = first + np.arange(n + 1)
    out = np.full(len(words) + n, END, A.U64)
    out[np.arange(len(words)) + A.owners(first)] = words
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[at[:-1]] = BEGIN
    return out, before, at


def pair_keys(states: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return A.mix(A.mix(states) + labels * A.U64(0x9E3779B97F4A7C15))


def spare_bits(buckets: int) -> int:
    """Low bits that keys of arcs can do without."""
    return max(0, 64 - ARC_BITS - int(buckets).bit_length())


def cut_keys(keys: np.ndarray, spare: int) -> np.ndarray:
    return keys >> A.U64(spare) << A.U64(spare)


def counted(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and the sum of its weights."""
    distinct, place, code = np.unique(keys, return_index=True, return_inverse=True)
    return distinct, place, np.bincount(code, weights=weight, minlength=len(distinct)).astype(np.int32)


def trains(texts: pa.Table, at: np.ndarray) -> np.ndarray:
    """1 for each token of a training document, else 0."""
    return np.repeat(~texts.column("held_out").to_numpy().astype(bool), np.diff(at)).astype(np.int8)


def own_counts(texts: pa.Table, labels: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens of a batch and their training counts in it, 0 for those that only held-out documents have."""
    keys, _, count = counted(labels, trains(texts, at))
    # beginnings are counted as a state only
    begins = np.array([(~texts.column("held_out").to_numpy().astype(bool)).sum()], np.int32)
    keys, count = np.append(keys, BEGIN), np.append(count, begins)
    order = np.argsort(keys)
    return keys[order], count[order]


def planes(values: np.ndarray) -> bytes:
    """All lowest bytes, then all next ones, as many as the greatest value needs."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplaned(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and data:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return out.reshape(-1).view(A.U64)


def slim(table: pa.Table, spare: int = 0) -> pa.Table:
    """Packed rows of (keys, values) with keys as gaps, and both in no more bytes than they need."""
    _, keys, values = X.unpacked(table, ["keys", "values"])
    keys, values = keys.view(A.U64), values.astype(A.U64)
    sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in table.column("keys").chunks)]).astype(np.int64)
    ends = np.cumsum(sizes)
    spans = list(zip((ends - sizes).tolist(), ends.tolist()))
    return pa.table(
        {
            "bucket": table.column("bucket"), "batch": table.column("batch"), "n": pa.array(sizes.astype(np.int32)),
            "keys": pa.array([keys[i : i + 1].tobytes() + planes(np.diff(keys[i:j]) >> A.U64(spare)) for i, j in spans], pa.binary()),
            "values": pa.array([planes(values[i:j]) for i, j in spans], pa.binary()),
        }
    )


def keys_of(table: pa.Table, spare: int = 0) -> np.ndarray:
    rows = zip(table.column("keys").to_pylist(), table.column("n").to_pylist())
    return np.concatenate([np.cumsum(np.append(np.frombuffer(data[:8], A.U64), unplaned(data[8:], n - 1) << A.U64(spare))) for data, n in rows])


def values_of(table: pa.Table, column: str = "values") -> np.ndarray:
    parts = [unplaned(data, n) for data, n in zip(table.column(column).to_pylist(), table.column("n").to_pylist())]
    return np.concatenate([np.zeros(0, A.U64), *parts]).astype(np.int64)


def send_words(texts: pa.Table, buckets: int) -> pa.Table:
    labels, _, at = tokens(texts)
    keys, count = own_counts(texts, labels, at)
    return slim(X.packed(texts.column("batch")[0].as_py(), keys, {"values": count}, buckets))


def summed(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    distinct, code = np.unique(keys, return_inverse=True)
    return distinct, code, np.bincount(code, weights=count, minlength=len(distinct)).astype(np.int64)


def others(table: pa.Table, more: np.ndarray) -> pa.Table:
    """What the other batches count, entry by entry in the order asked, so that no keys are sent back."""
    sizes = table.column("n").to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    values = [planes(more[j - n : j].astype(A.U64)) for j, n in zip(ends.tolist(), sizes.tolist())]
    return pa.table({"bucket": table.column("bucket"), "batch": table.column("batch"), "n": table.column("n"), "more": pa.array(values, pa.binary())})


def told(answers: pa.Table) -> np.ndarray:
    """The answers to a batch, in the order of its sorted keys: buckets are ranges of keys."""
    return values_of(answers.sort_by("bucket"), "more")


def first_row(rows: int, value) -> list:
    return ([value] + [None] * rows)[:rows]


def count_words(table: pa.Table) -> pa.Table:
    """Other batches' counts for each that asked; a bucket's first row has its share of tokens and types."""
    count = values_of(table)
    distinct, code, total = summed(keys_of(table), count)
    out = others(table, total[code] - count)
    real = total[(distinct != BEGIN) & (total > 0)]
    for name, value in (("tokens", real.sum()), ("types", len(real))):
        out = out.append_column(name, pa.array(first_row(out.num_rows, int(value)), pa.int64()))
    return out


class Counts:
    """Corpus counts of the tokens of a batch, and the corpus totals."""

    def __init__(self, answers: pa.Table, keys: np.ndarray, own: np.ndarray):
        self.keys, self.count = keys, own + told(answers)
        self.tokens, self.types = (answers.column(c)[0].as_py() for c in ("all_tokens", "all_types"))
        self.room = self.tokens + self.types + 1

    def of(self, values: np.ndarray) -> np.ndarray:
        return self.count[np.searchsorted(self.keys, values)]


def size_class(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 1)) / 2, SIZES - 1).astype(np.int8)


class Known:
    """The tokens of a batch and what its answers tell of them, up to an order of history."""

    def __init__(self, texts: pa.Table, answers: pa.Table, order: int, spare: int):
        self.labels, self.before, self.at = tokens(texts)
        level = answers.column("level").to_numpy()
        rows = lambda k: answers.filter(pa.array(level == k))
        counts = Counts(rows(0), *own_counts(texts, self.labels, self.at))
        self.words, self.word_count, self.tokens = counts.keys, counts.count, counts.tokens
        self.train, n = trains(texts, self.at), len(self.labels)
        self.label_count, self.context = counts.of(self.labels), counts.of(self.before)
        self.root = (self.label_count + 1) / counts.room
        if order < 2:
            return
        self.pairs = np.flatnonzero((self.label_count > 0) & (self.context > 0))
        self.pair_arc, self.pair_count = self._arcs(self.pairs, cut_keys(pair_keys(self.before, self.labels), spare), rows(1), n)
        self.rest = 1 - weights_of(rows(1))[size_class(self.context)] * (self.context > 0)
        self.after_word = (1 - self.rest) * self.pair_count / np.maximum(self.context, 1) + self.rest * self.root
        # the history of two words is the pair that ends before the token; a text's first token has none
        self.context2 = np.concatenate([np.zeros(1, np.int64), self.pair_count[:-1]])
        self.context2[self.at[:-1]] = 0
        self.context2[self.context2 < CONTEXT] = 0
        self.history = np.concatenate([np.zeros(1, A.U64), pair_keys(self.before, self.labels)[:-1]])
        self.triples = np.flatnonzero((self.context2 > 0) & (self.pair_count > 0))
        if order < 3:
            return
        self.triple_arc, triple_count = self._arcs(self.triples, cut_keys(pair_keys(self.history, self.labels), spare), rows(2), n)
        self.rest2 = 1 - weights_of(rows(2))[size_class(self.context2)] * (self.context2 > 0)
        self.after_pair = (1 - self.rest2) * triple_count / np.maximum(self.context2, 1) + self.rest2 * self.after_word

    def _arcs(self, use: np.ndarray, keys: np.ndarray, answers: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place the number of its arc, -1 without one, and its training count."""
        arc, count = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if len(use):
            distinct, code = np.unique(keys[use], return_inverse=True)
            total = np.bincount(code, weights=self.train[use], minlength=len(distinct)).astype(np.int64) + told(answers)
            count[use] = total[code]
            arc[use] = np.where(total[code] > 0, code, -1)
        return arc, count


def weights_of(answers: pa.Table) -> np.ndarray:
    out = np.zeros(SIZES)
    for choice in (answers.column("weights")[0].as_py() or []) if answers.num_rows else []:
        out[choice["size"]] = choice["weight"]
    return out


def send_arcs(texts: pa.Table, answers: pa.Table, buckets: int, order: int) -> pa.Table:
    """Training counts of a batch's pairs or triples, 0 for those that only its held-out documents have. What cannot
    occur in training, as a part of it does not, is not asked for."""
    if not texts.num_rows:
        return slim(X.packed(0, np.zeros(0, A.U64), {"values": np.zeros(0, np.int64)}, buckets))
    spare = spare_bits(buckets)
    k = Known(texts, answers, order - 1, spare)
    if order == 2:
        use, keys, context = np.flatnonzero((k.label_count > 0) & (k.context > 0)), pair_keys(k.before, k.labels), k.context
    else:
        use, keys, context = k.triples, pair_keys(k.history, k.labels), k.context2
    keys, place, count = counted(cut_keys(keys[use], spare), k.train[use])
    values = count.astype(np.int64) * 32 + size_class(context[use[place]])
    return slim(X.packed(texts.column("batch")[0].as_py(), keys, {"values": values}, buckets), spare)


def count_arcs(table: pa.Table, spare: int) -> pa.Table:
    """Other batches' counts; a bucket's first row has, for each size of history, how many training tokens there are, and
    how many whose arc another one has too."""
    count, size = np.divmod(values_of(table), 32)
    distinct, code, total = summed(keys_of(table, spare), count)
    out = others(table, total[code] - count)
    place = np.empty(len(distinct), np.int64)
    place[code] = np.arange(len(code))
    every, again = (np.bincount(size[place], weights=w, minlength=SIZES).astype(np.int64) for w in (total, np.where(total > 1, total, 0)))
    cells = [{"size": int(i), "again": int(again[i]), "all": int(every[i])} for i in np.flatnonzero(every)]
    kind = pa.list_(pa.struct([("size", pa.int32()), ("again", pa.int64()), ("all", pa.int64())]))
    return out.append_column("seen", pa.array(first_row(out.num_rows, cells), kind))


class Automaton:
    """The states and arcs that a batch's texts can reach.

    States: 0 is the root, then the words, then the pairs by the number of their arc. Arcs are known by the place of the
    token that is read, as an order of history has at most one arc for it.
    """

    def __init__(self, k: Known):
        n_words = len(k.words)
        word_state = np.where(k.word_count > 0, 1 + np.arange(n_words), 0)
        of_word = word_state[np.searchsorted(k.words, k.labels)]
        self.begin = int(word_state[np.searchsorted(k.words, BEGIN)])
        first_pair = 1 + n_words
        #: Where reading the token leads: to the pair that it ends, if that is a state, else to its word, else to the root.
        self.next_root = of_word
        self.next = np.where((k.pair_arc >= 0) & (k.pair_count >= CONTEXT), first_pair + k.pair_arc, of_word)
        self.first_pair = first_pair
        self.has = [k.pair_arc >= 0, k.triple_arc >= 0]
        self.weight = [np.log10(k.root), np.log10(k.after_word), np.log10(k.after_pair)]
        # failure arcs by state: where to, and the weight; the root has none
        states = first_pair + int(k.pair_arc.max(initial=-1)) + 1
        self.fail, self.fail_weight = np.zeros(states, np.int64), np.zeros(states)
        own = word_state[np.searchsorted(k.words, k.before)]
        self.fail_weight[own] = np.log10(k.rest)
        self.fail_weight[0] = 0
        pairs = np.flatnonzero(k.context2 > 0)
        self.fail[first_pair + k.pair_arc[pairs - 1]] = own[pairs]
        self.fail_weight[first_pair + k.pair_arc[pairs - 1]] = np.log10(k.rest2[pairs])

    def step(self, state: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one token in each state: take its arc, or failure arcs until there is one. The new states and weights."""
        weight = np.zeros(len(state))
        pair, word = state >= self.first_pair, (state > 0) & (state < self.first_pair)
        failing = pair & ~self.has[1][place]
        weight[failing] = self.fail_weight[state[failing]]
        state = np.where(failing, self.fail[state], state)
        word |= failing
        pair &= ~failing
        failing = word & ~self.has[0][place]
        weight[failing] += self.fail_weight[state[failing]]
        word &= ~failing
        weight += np.where(pair, self.weight[2][place], np.where(word, self.weight[1][place], self.weight[0][place]))
        return np.where(pair | word, self.next[place], self.next_root[place]), weight


def walk(automaton: Automaton, at: np.ndarray) -> np.ndarray:
    """Log probability of each text: one pass from left to right that carries a state for each piece of text."""
    sizes = np.diff(at)
    parts = -(-sizes // PIECE)
    text = np.repeat(np.arange(len(sizes)), parts)
    start = at[text] + PIECE * A.spread(np.zeros(len(sizes), np.int64), parts)
    stop = np.minimum(start + PIECE, at[text + 1])
    early = np.minimum(start - at[text], 2)  # after two tokens the state is the same wherever the walk began
    order = np.argsort(-(stop - start + early), kind="stable")
    text, start, stop, early = text[order], start[order], stop[order], early[order]
    place = start - early
    left = stop - place
    state = np.where(early > 0, 0, automaton.begin)
    total = np.zeros(len(text))
    for k in range(int(left.max(initial=0))):
        active = int(np.searchsorted(-left, -k))  # pieces that have more than k tokens
        state, weight = automaton.step(state[:active], place[:active] + k)
        total[:active] += np.where(k >= early[:active], weight, 0)
    return np.bincount(text, weights=total, minlength=len(sizes))


def score(texts: pa.Table, answers: pa.Table, spare: int) -> pa.Table:
    """Result rows of a batch of texts."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    if not texts.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    k = Known(texts, answers, 3, spare)
    sums = lambda values: np.add.reduceat(values, k.at[:-1])  # noqa: E731  each text has a token at least: its end
    columns = [
        texts.column("doc_id"), texts.column("held_out"), np.diff(k.at), sums((k.label_count > 0).astype(np.int64)),
        np.full(len(k.at) - 1, k.tokens), sums(np.log10(k.root)), walk(Automaton(k), k.at),
    ]
    return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)


def log_scores(docs: DataFrame) -> DataFrame:
    """Base and model log10 probabilities of every text, its end included.

    Words are runs of bytes other than ASCII white space, with A-Z lowered; a null text has no words and is scored
    as its end alone. All rows train or are held out by doc_id, repeated rows each time; without training documents
    every token is unknown. Other columns are not carried; an empty table gives no rows.
    """
    texts, _, buckets = X.batched(docs, BATCH_BYTES, held_out=held_out(F.col("doc_id")))
    sent = X.grouped(texts, "batch", partial(send_words, buckets=buckets), COUNTED)
    words = X.grouped(sent, "bucket", count_words, WORDS)
    # one row of totals
    totals = words.agg(F.sum("tokens").alias("all_tokens"), F.sum("types").alias("all_types")).withColumn("one", F.lit(1))
    words = words.select("bucket", "batch", "n", "more", F.lit(1).alias("one")).join(F.broadcast(totals), "one").drop("one")
    answers = words.withColumn("level", F.lit(0))
    for order in (2, 3):
        asked = X.meet(texts, answers, partial(send_arcs, buckets=buckets, order=order), COUNTED)
        found = with_weights(X.grouped(asked, "bucket", partial(count_arcs, spare=spare_bits(buckets)), ARCS))
        answers = answers.unionByName(found.withColumn("level", F.lit(order - 1)), allowMissingColumns=True)
    return X.meet(texts, answers, partial(score, spare=spare_bits(buckets)), RESULT)


def with_weights(arcs: DataFrame) -> DataFrame:
    """Answers with the interpolation weights of their order, below 1: one row of at most SIZES weights."""
    sums = arcs.select(F.inline("seen")).groupBy("size").agg((F.sum("again") / (F.sum("all") + 1)).alias("weight"))
    chosen = sums.agg(F.array_sort(F.collect_list(F.struct("size", "weight"))).alias("weights")).withColumn("one", F.lit(1))
    return arcs.select("bucket", "batch", "n", "more", F.lit(1).alias("one")).join(F.broadcast(chosen), "one").drop("one")

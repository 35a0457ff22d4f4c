"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Only texts' parts that can repeat are sorted. Exact copies of a text are represented by their least doc_id. In the
rest, windows of 50 bytes count whose fingerprint (the least hash of their 28-byte grams) another document has
too; runs of such windows, called contexts, meet in a bucket by fingerprint. A fingerprint with one distinct
context is settled by the least id that has it. Of the others the bytes are sent as well: a bucket cuts its distinct contexts into shards, makes each shard's suffix order
and transform, and merges the transforms by refining their interleave: after h rounds it is sorted by h symbols,
and the places where a round tells neighbours apart bound the intervals of common prefixes of h. A suffix that is
alone in its interval stays alone and leaves. After 50 rounds the intervals are the repeated strings; no suffix is
sorted again. Each interval's least doc_id goes back.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import exchange as X
from .runtime import written
from .substring import flag_shared, member, sliding_least

WINDOW = 50
GRAM = 28
#: Windows of a context at most.
LONGEST = WINDOW - GRAM + 1
BATCH_BYTES = 1 << 20
#: Windows that are hashed at a time, so that the tables stay in the cache.
PIECE = 32 << 10
SHARD_BYTES = 128 << 10
#: Contexts of different fingerprints have no window in common, so a bucket merges about so many bytes at a time.
MERGE_BYTES = 512 << 10
#: A fingerprint that so many batches have is common: its windows go to buckets by their own content, one by one.
COMMON = 48

MARKS = "bucket int, batch long, keys array<int>, many array<boolean>"
FLAGGED = "batch long, bucket int, keys array<int>, common array<boolean>"
SENT = "bucket int, batch long, low array<int>, high array<int>, one array<long>, size array<tinyint>, first_id array<long>, several array<boolean>"
SENT_BYTES = SENT + ", full array<boolean>, bytes binary"
FOUND = "batch long, mark array<long>, single array<boolean>, one array<long>, start array<tinyint>, stop array<tinyint>, least_id array<long>"
#: Replies that stop here ask for a context again, of one of its senders with its bytes. The least id of such a reply
#: is the number of the part of the bucket that the fingerprint belongs to.
SEND_BYTES, SEND_HASH = -1, -2
#: Bytes of contexts of a part, about.
PART_BYTES = 1 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start: int, stop: int>>"


def byte_marks(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one fingerprint: the first window, how many, the fingerprint, and the text.

    Fingerprints are in short; those that meet by chance are told apart by their contexts. Windows are hashed piece by
    piece: a hash does not depend on the place.
    """
    n = max(0, len(data) - WINDOW + 1)
    edge = np.zeros(n + 1, bool)  # runs end with their text, and where its last window begins
    edge[np.minimum(offsets[:-1], n)] = True
    edge[np.minimum(np.maximum(offsets[:-1], offsets[1:] - WINDOW + 1), n)] = True
    heads, marks, last = [np.zeros(0, np.int64)], [np.zeros(0, A.U64)], None
    for a in range(0, n, PIECE):
        own = sliding_least(A.gram_hashes(A.letters(data[a : a + PIECE + WINDOW - 1]), GRAM), LONGEST)
        new = edge[a : a + len(own)].copy()
        new[1:] |= own[1:] != own[:-1]
        new[0] |= last is None or own[0] != last
        at = np.flatnonzero(new)
        heads.append(at + a)
        marks.append(own[at])
        last = own[-1]
    heads, marks = np.concatenate(heads), np.concatenate(marks)
    size = np.diff(heads, append=n)
    owner = np.searchsorted(offsets, heads, "right") - 1
    inside = np.flatnonzero(heads + WINDOW <= offsets[owner + 1]) if len(heads) else heads
    return heads[inside], size[inside], X.short(marks[inside], buckets), owner[inside]


def distinct_marks(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of a batch's runs, and whether two of its texts have them."""
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    heads = heads_of(keys) if len(keys) else np.zeros(0, np.int64)
    # a text's runs come one after another, so owners of one key ascend
    tails = np.append(heads[1:], len(keys)) - 1 if len(heads) else heads
    return keys[heads], owner[heads] != owner[tails]


def flag_marks(table: pa.Table, many: int) -> pa.Table:
    """Fingerprints that two documents have, and whether very many batches have them."""
    wide = table.set_column(2, "keys", table.column("keys").cast(pa.list_(pa.int64())))
    batch, keys = X.unpacked(flag_shared(wide), ["keys"])
    _, code, count = np.unique(keys, return_inverse=True, return_counts=True)
    out = X.replied(batch, {"keys": keys.astype(np.int32), "common": count[code] >= many})
    return out.add_column(1, "bucket", pa.array(np.full(out.num_rows, table.column("bucket")[0].as_py(), np.int32)))


def contexts(data: np.ndarray, offsets: np.ndarray, buckets: int, common: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows with one fingerprint, at most LONGEST of them; those of common fingerprints singly.

    wanted: keep runs of these fingerprints only. A context is known by its fingerprint and 64 bits of hash over all
    its bytes.
    """
    heads, size, marks, owner = byte_marks(data, offsets, buckets)
    use = member(marks, wanted)[0]
    heads, size, marks, owner = heads[use], size[use], marks[use], owner[use]
    step = np.where(member(marks, common)[0], 1, LONGEST)
    parts = -(-size // step)
    start = np.repeat(heads, parts) + A.spread(np.zeros(len(heads), np.int64), parts) * np.repeat(step, parts)
    count = np.minimum(np.repeat(step, parts), np.repeat(heads + size, parts) - start)
    one = A.word_hashes(data, start, start + count + WINDOW - 1, 1)
    return {"start": start, "count": count, "mark": np.repeat(marks, parts), "one": one, "owner": np.repeat(owner, parts)}


def copies(texts: DataFrame) -> DataFrame:
    """For each batch the hashes of its texts that another document has too, and the least id with that text."""
    rows = texts.select("batch", "text_one", "text_two", F.coalesce("doc_id", F.lit(int(X.NO_ID))).alias("id"))
    texts_of = ["text_one", "text_two"]
    least = rows.groupBy(*texts_of).agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last").drop("last")
    own = rows.groupBy("batch", *texts_of).agg(F.max("id").alias("last"))
    found = own.join(least, texts_of).where("least < last")
    return found.groupBy("batch").agg(*(F.collect_list(c).alias(f"copy_{n}") for n, c in (("one", "text_one"), ("two", "text_two"), ("least", "least"))))


def are_copies(texts: pa.Table, answers: pa.Table) -> np.ndarray:
    """Which texts of a batch also stand in a document of smaller id."""
    rows = answers.filter(answers.column("copy_one").is_valid())
    _, one, two, least = X.unpacked(rows, ["copy_one", "copy_two", "copy_least"])
    known = dict(zip(zip(one.tolist(), two.tolist()), least.tolist()))
    keys = zip(texts.column("text_one").to_pylist(), texts.column("text_two").to_pylist())
    return np.array([known.get(k, X.NO_ID) < i for k, i in zip(keys, X.ids_of(texts).tolist())], bool)


def originals(texts: pa.Table, answers: pa.Table) -> pa.Table:
    return texts.filter(pa.array(~are_copies(texts, answers)))


def send_original_marks(texts: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    own = originals(texts, answers)
    keys, many = np.zeros(0, A.U64), np.zeros(0, bool)
    if own.num_rows:
        _, _, marks, owner = byte_marks(*X.texts_of(own), buckets)
        keys, many = distinct_marks(marks, owner)
    return X.packed_short(texts.column("batch")[0].as_py() if texts.num_rows else 0, keys, many)


def send_contexts(texts: pa.Table, answers: pa.Table, buckets: int, with_bytes: bool) -> pa.Table:
    """The distinct contexts of a batch that are asked about, by bucket: the fingerprint, a hash, the least id and
    whether other documents of the batch have it. The bucket is the fingerprint's; that of a single window of a common
    fingerprint is its hash's, and ``high`` is then the fingerprint's bucket, negative and less one."""
    texts = originals(texts, answers)
    asked = answers.filter(answers.column("mark" if with_bytes else "keys").is_valid())
    if with_bytes:
        _, keys, ones, codes, parts = X.unpacked(asked, ["mark", "one", "stop", "least_id"])
        again = codes < 0
        keys, ones, codes, parts, common = keys[again].view(A.U64), ones[again].view(A.U64), codes[again], parts[again], np.zeros(0, A.U64)
    else:
        keys, many = X.read_short(asked, "common")
        common = np.sort(keys[many])
    data, offsets = X.texts_of(texts)
    ids = X.ids_of(texts)
    c = contexts(data, offsets, buckets, common, np.sort(keys))
    single = member(c["mark"], common)[0]
    high = (c["mark"] >> A.U64(32)).astype(np.int32)
    bucket = np.where(single, X.deal(c["one"], buckets), high)
    high = np.where(single, -1 - high, high).astype(np.int32)
    if with_bytes and len(bucket):
        asking = np.argsort(ones, kind="stable")  # each of these contexts was sent before and has a reply
        at = asking[np.searchsorted(ones[asking], c["one"])]
        bucket, c["code"] = bucket + buckets * parts[at], codes[at]
    of = ids[c["owner"]]
    order = np.lexsort((of, c["one"], c["mark"], high, bucket))
    bucket, high, of = bucket[order], high[order], of[order]
    c = {n: v[order] for n, v in c.items()}
    heads = heads_of(bucket, high, c["mark"], c["one"])
    tails = np.append(heads[1:], len(order)) - 1 if len(heads) else heads
    size = c["count"][heads] + WINDOW - 1
    lists = {
        "low": c["mark"][heads].astype(np.uint32).view(np.int32), "high": high[heads], "one": c["one"][heads].view(np.int64),
        "size": size.astype(np.int8), "first_id": of[heads], "several": of[heads] != of[tails],
    }
    rows = heads_of(bucket[heads])
    sizes = np.diff(rows, append=len(heads))
    batch = np.full(len(rows), texts.column("batch")[0].as_py() if texts.num_rows else 0, np.int64)
    if with_bytes:
        lists["full"] = c["code"][heads] == SEND_BYTES if len(heads) else np.zeros(0, bool)
    out = pa.table({"bucket": pa.array(bucket[heads][rows].astype(np.int32)), "batch": pa.array(batch)} | {n: A.list_array(pa.array(v), sizes) for n, v in lists.items()})
    if not with_bytes:
        return out
    full = np.flatnonzero(lists["full"])
    blob = data[A.spread(c["start"][heads][full], size[full])].tobytes()
    cut = np.concatenate([[0], np.cumsum(np.where(lists["full"], size, 0))])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    return out.append_column("bytes", pa.array([blob[a:b] for a, b in zip(cut, cut[1:])], pa.binary()))


def sent_contexts(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Batch, fingerprint, whether single, hash, size, least id and whether several, of what a bucket was sent."""
    batch, low, high, one, size, first_id, several = X.unpacked(table, ["low", "high", "one", "size", "first_id", "several"])
    single = high < 0
    mark = np.where(single, -1 - high, high).astype(A.U64) << A.U64(32) | low.view(np.uint32).astype(A.U64)
    return batch, mark.view(np.int64), single, one, size.astype(np.int64), first_id, several.astype(bool)


def heads_of(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def settle(table: pa.Table, part_bytes: int) -> pa.Table:
    """Least ids for the contexts that are the only ones of their fingerprint; for the others, a call for bytes."""
    batch, mark, single, one, size, first_id, several = sent_contexts(table)
    order = np.lexsort((one, mark, single))
    heads = heads_of(single[order], mark[order], one[order])
    context = np.empty(len(order), np.int64)
    context[order] = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(order)))
    least = np.minimum.reduceat(first_id[order], heads)
    own = order[heads]
    _, code, count = np.unique(mark[own], return_inverse=True, return_counts=True)
    many = (count[code] > 1) & ~single[own]
    mixed = many[context]
    # parts of the bucket: whole fingerprints, in order, of about as many bytes
    weight = np.bincount(context, weights=size, minlength=len(own)) * many
    before = (np.cumsum(np.bincount(code, weights=weight)) // part_bytes).astype(np.int64)
    answer = np.flatnonzero(mixed | several | (least[context] < first_id))
    lists = {"mark": mark[answer], "single": single[answer], "one": one[answer], "start": np.zeros(len(answer), np.int8)}
    stop = np.where(mixed, SEND_HASH, size - WINDOW + 1)
    stop[own[many]] = SEND_BYTES
    told = np.where(mixed, before[code][context], least[context])
    return X.replied(batch[answer], lists | {"stop": stop[answer].astype(np.int8), "least_id": told[answer]})


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of texts that each end with symbol 0; equal suffixes stay in order of place.

    Ranks by seven symbols, then twice as many a round. A suffix ends with its text's 0.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(7):  # seven symbols of nine bits
        key <<= 9
        inside = np.flatnonzero(left >= k)
        key[inside] |= symbols[inside + k]
    depth, longest = 7, int(left.max(initial=0)) + 1
    while True:
        values, rank = np.unique(key, return_inverse=True)
        if depth >= longest or len(values) == n:
            return np.argsort(rank, kind="stable")
        after = np.zeros(n, np.int64)
        more = np.flatnonzero(left >= depth)
        after[more] = rank[more + depth] + 1
        key = rank * (len(values) + 1) + after
        depth *= 2


def transform(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The symbol before each suffix in order; 0 at a text's start."""
    before = np.zeros(len(symbols), symbols.dtype)
    before[1:] = symbols[:-1]
    return before[order]


def longer(transform: np.ndarray, ends: int) -> np.ndarray:
    """For each suffix in a shard's order the place of the suffix that is one symbol longer, if there is one."""
    moving = np.flatnonzero(transform)
    out = np.zeros(len(transform), np.int64)
    out[moving[np.argsort(transform[moving], kind="stable")]] = ends + np.arange(len(moving))
    return out


def merged(transforms: list[np.ndarray], ends: list[int], depth: int, singles: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffix orders, as places in the orders laid end to end, and the number of the interval
    of each.

    transforms: each shard's, whose first ``ends`` suffixes are the bare ends of texts. A round lets every suffix
    of the current interleave move the suffix that is one symbol longer to the next free place among those of that
    symbol. Ends of texts come first and are intervals of their own. Without ``singles``, a suffix that is alone in its
    interval leaves: what it would move is alone as well.
    """
    sizes = np.array([len(t) for t in transforms])
    base = np.cumsum(sizes) - sizes
    whole = np.concatenate(transforms)
    step = np.concatenate([longer(t, e) + b for t, e, b in zip(transforms, ends, base)])
    fixed = np.concatenate([b + np.arange(e) for b, e in zip(base, ends)])
    rest = np.concatenate([b + np.arange(e, n) for b, e, n in zip(base, ends, sizes)])
    place = np.concatenate([fixed, rest])
    block = np.zeros(len(place), np.int32)  # all have the same prefix of no symbols
    for _ in range(depth):
        symbol = whole[place]
        order = np.argsort(symbol, kind="stable")[len(symbol) - np.count_nonzero(symbol) :]
        moved, from_block = symbol[order], block[order]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (moved[1:] != moved[:-1]) | (from_block[1:] != from_block[:-1])
        if singles:
            place = np.concatenate([fixed, step[place[order]]])
            block = np.concatenate([np.arange(len(fixed), dtype=np.int32), len(fixed) - 1 + np.cumsum(new[:-1], dtype=np.int32)])
        else:
            shared = np.flatnonzero(~(new[:-1] & new[1:]))
            place, block = step[place[order[shared]]], np.cumsum(new[:-1], dtype=np.int32)[shared]
            if not len(place):
                break
    return place, block


def intervals(text: np.ndarray, sizes: np.ndarray, depth: int = WINDOW, singles: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Places in the contexts' bytes in merged suffix order, and their interval of common prefixes of ``depth``.

    Only places from which ``depth`` bytes of the context are left are returned; without ``singles``, only those whose
    interval has others.
    """
    starts = np.cumsum(sizes) - sizes
    shard = (starts + sizes - 1) // SHARD_BYTES
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    transforms, orders, ends = [], [], []
    for a, b in zip(cuts, np.append(cuts[1:], len(sizes))):
        own = sizes[a:b]
        symbols = np.zeros(int(own.sum()) + len(own), np.uint16)
        place = A.spread(starts[a:b], own)
        at = np.arange(len(place)) + np.repeat(np.arange(len(own)), own)
        symbols[at] = text[place].astype(np.uint16) + 1
        order = suffix_order(symbols)
        where = np.full(len(symbols), -1, np.int64)
        where[at] = place
        transforms.append(transform(symbols, order))
        orders.append(where[order])
        ends.append(len(own))
    at, block = merged(transforms, ends, depth, singles)
    place = np.concatenate(orders)[at]
    stop = np.repeat(starts + sizes, sizes)
    long = np.flatnonzero(place >= 0)
    long = long[stop[place[long]] - place[long] >= depth]
    return place[long], block[long]


def least_ids(table: pa.Table) -> pa.Table:
    """For every context a batch sent, the least id for each of its windows, where that matters."""
    batch, mark, _, one, size, first_id, several = sent_contexts(table)
    full = X.unpacked(table, ["full"])[1].astype(bool)
    text = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
    start = np.cumsum(np.where(full, size, 0)) - size  # of those that came with their bytes
    order = np.lexsort((~full, one, mark))
    heads = heads_of(mark[order], one[order])
    context = np.empty(len(order), np.int64)
    context[order] = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(order)))
    own = order[heads]  # the sender of each distinct context's bytes
    least = np.minimum.reduceat(first_id[order], heads)
    sizes = size[own]
    windows = sizes - WINDOW + 1
    base = np.cumsum(windows) - windows
    window_least = np.repeat(least, windows)
    marks = heads_of(mark[own])
    part = (np.cumsum(sizes) - sizes)[marks] // MERGE_BYTES
    bounds = marks[heads_of(part)]
    for a, b in zip(bounds, np.append(bounds[1:], len(own))):
        inside = sizes[a:b]
        place, block = intervals(text[A.spread(start[own[a:b]], inside)], inside, singles=False)
        which = np.repeat(np.arange(b - a), inside)[place]
        inner = place - (np.cumsum(inside) - inside)[which]
        if not len(block):
            continue
        cuts = heads_of(block)
        window_least[base[a:b][which] + inner] = np.repeat(np.minimum.reduceat(least[a:b][which], cuts), np.diff(cuts, append=len(block)))
    # runs of windows with one least id
    run = heads_of(window_least, np.repeat(np.arange(len(own)), windows))
    run_context = np.searchsorted(base, run, "right") - 1
    run_start = run - base[run_context]
    run_stop = np.append(run[1:], len(window_least)) - base[run_context]
    runs = np.bincount(run_context, minlength=len(windows))
    first_run = np.cumsum(runs) - runs
    entry = np.repeat(np.arange(len(batch)), runs[context])
    at = A.spread(first_run[context], runs[context])
    low = window_least[run[at]]
    use = several[entry] | (low < first_id[entry])
    entry, at = entry[use], at[use]
    lists = {"mark": mark[entry], "single": np.zeros(len(entry), bool), "one": one[entry]}
    return X.replied(batch[entry], lists | {"start": run_start[at].astype(np.int8), "stop": run_stop[at].astype(np.int8), "least_id": low[use]})


def drop_repeats(texts: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Result rows of a batch of texts."""
    if not texts.num_rows:
        return result_table(np.zeros(0, np.int64), [], [], [], [])
    data, offsets = X.texts_of(texts)
    ids = X.ids_of(texts)
    copy = are_copies(texts, answers)
    gone = np.repeat(copy & (np.diff(offsets) >= WINDOW), np.diff(offsets))
    found = answers.filter(answers.column("mark").is_valid())
    _, mark, single, one, start, stop, least = X.unpacked(found, ["mark", "single", "one", "start", "stop", "least_id"])
    use = np.flatnonzero(stop >= 0)
    if len(use):
        order = use[np.argsort(one.view(A.U64)[use], kind="stable")]
        mark, one = mark.view(A.U64)[order], one.view(A.U64)[order]
        single, start, stop, least = single.astype(bool)[order], start[order], stop[order], least[order]
        c = contexts(data, offsets, buckets, np.sort(mark[single]), np.sort(mark))
        low, high = np.searchsorted(one, c["one"]), np.searchsorted(one, c["one"], "right")
        which = np.repeat(np.arange(len(low)), high - low)
        at = A.spread(low, high - low)
        use = (mark[at] == c["mark"][which]) & (least[at] < ids[c["owner"][which]])
        which, at = which[use], at[use]
        steps = np.zeros(len(data) + 1, np.int64)
        np.add.at(steps, c["start"][which] + start[at].astype(np.int64), 1)
        np.add.at(steps, c["start"][which] + stop[at].astype(np.int64) + WINDOW - 1, -1)
        gone |= np.cumsum(steps[:-1]) > 0
    lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
    whole = data.tobytes()
    kept, spans = [], []
    for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lost.tolist()):
        own = gone[a:b]
        kept.append(data[a:b][~own].tobytes() if n else whole[a:b])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]))).tolist() if n else []
        spans.append([{"start": x, "stop": y} for x, y in zip(edge[::2], edge[1::2])])
    return result_table(texts.column("doc_id"), np.diff(offsets), lost, kept, spans)


def result_table(doc_id, n_bytes, removed, kept, spans) -> pa.Table:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    columns = [doc_id, pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)]
    return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "kept", "spans"])


def drop_repeated_bytes(docs: DataFrame, common: int = COMMON, part_bytes: int = PART_BYTES) -> DataFrame:
    """For each document: byte counts, the kept bytes, and the removed spans of bytes.

    A byte goes if a string of 50 bytes over it, within its text, also starts in a document of smaller doc_id. A null
    text is empty. Documents of one id, or both without an id, are never earlier than each other; a document
    without an id is later than all with one. Other columns are not carried; an empty table gives no rows. ``common``
    and ``part_bytes`` change how the work is spread, not the result.
    """
    texts, _, buckets = X.batched(docs, BATCH_BYTES, text_one=F.xxhash64("text"), text_two=F.xxhash64(F.lit(1), "text"))
    same = written(copies(texts), "copies")
    sent = X.meet(texts, same, partial(send_original_marks, buckets=buckets), MARKS)
    flagged = X.grouped(sent, "bucket", partial(flag_marks, many=common), FLAGGED)
    flagged = flagged.unionByName(same, allowMissingColumns=True)
    asked = X.meet(texts, flagged, partial(send_contexts, buckets=buckets, with_bytes=False), SENT)
    found = X.grouped(asked, "bucket", partial(settle, part_bytes=part_bytes), FOUND)
    answers = found.unionByName(same, allowMissingColumns=True)
    asked = X.meet(texts, answers, partial(send_contexts, buckets=buckets, with_bytes=True), SENT_BYTES)
    return X.meet(texts, answers.unionByName(X.grouped(asked, "bucket", least_ids, FOUND), allowMissingColumns=True), partial(drop_repeats, buckets=buckets), RESULT)

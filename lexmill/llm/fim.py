"""Fill-in-middle: texts cut at token boundaries, found by a learned rank index.

A text's index maps the rank of a token boundary to its place. The boundaries are nearly a straight line over their
ranks, so a few segments predict each place to within ``ERROR`` code points; the difference, one byte a boundary, is
stored and makes the prediction exact. Indexes are made by numpy, batch by batch; cutting and putting together are
column expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A

#: Furthest that a boundary may be from its segment; with rounding, a residual still fits a byte.
ERROR = 120
#: Binary places of a slope.
POINT = 24
#: Boundaries that one step of the fit looks at.
REACH = 4096

INDEX = "n long, ranks array<long>, places array<long>, slopes array<long>, residuals array<byte>"
NAMES, KINDS = ["n", "ranks", "places", "slopes", "residuals"], [pa.int64()] * 3 + [pa.int8()]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the code points before each token boundary, from 0 to its end. A token is a word with the white
    space before it, or the white space at the end."""
    _, ends, first = A.word_spans(data, offsets)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    at = before[ends]
    found = []
    for k in range(len(offsets) - 1):
        start, end = before[offsets[k]], before[offsets[k + 1]]
        own = at[first[k] : first[k + 1]] - start
        rest = [end - start] if end - start > (own[-1] if len(own) else 0) else []
        found.append(np.concatenate([[0], own, rest]).astype(np.int64))
    return found


def fit(places: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rank, place there, and slope of each segment. A segment goes on while some line through its first boundary
    is within the error of all its boundaries: the cone of slopes that do is narrowed boundary by boundary."""
    ranks, slopes, at, n = [], [], 0, len(places)
    while at < n:
        low, high, end = -np.inf, np.inf, at + 1
        while end < n:
            run = np.arange(end - at, min(n, end + REACH) - at)
            gain = places[at + run] - places[at]
            lows = np.maximum(np.maximum.accumulate((gain - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((gain + error) / run), high)
            bad = np.flatnonzero(lows > highs)
            good = int(bad[0]) if len(bad) else len(run)
            if good:
                low, high, end = lows[good - 1], highs[good - 1], end + good
            if len(bad):
                break
        ranks.append(at)
        slopes.append(0 if end == at + 1 else int(round((low + high) / 2 * (1 << POINT))))
        at = end
    ranks = np.array(ranks, np.int64)
    return ranks, places[ranks], np.array(slopes, np.int64)


def predicted(ranks: np.ndarray, places: np.ndarray, slopes: np.ndarray, n: int) -> np.ndarray:
    """The place that the segments predict for each rank below n."""
    rank = np.arange(n)
    segment = np.searchsorted(ranks, rank, "right") - 1
    return places[segment] + ((slopes[segment] * (rank - ranks[segment])) >> POINT)


def rank_index(text: Column | str) -> Column:
    """The index of each text's token boundaries, as a struct: the number of tokens, the segments, and a residual for each
    boundary. A null text is empty and has the one boundary 0."""

    @F.arrow_udf(INDEX)
    def indexed(texts: pa.Array) -> pa.Array:
        found = []
        for part in A.slices(iter([pa.record_batch([texts], ["text"])])):
            for places in boundaries(*A.utf8(part.column("text"))):
                line = fit(places)
                rest = places - predicted(*line, len(places))
                assert -128 <= rest.min() and rest.max() <= 127, "a residual does not fit"
                found.append((*line, rest.astype(np.int8)))
        lists = [A.list_array(pa.array(np.concatenate(x)), np.array([len(v) for v in x])) for x in zip(*found)] if found else [pa.array([], pa.list_(t)) for t in KINDS]
        n = pa.array([len(row[-1]) - 1 for row in found], pa.int64())
        return pa.StructArray.from_arrays([n, *lists], NAMES)

    return indexed(text)


def place(index: Column, rank: Column) -> Column:
    """Code points before the boundary of that rank: the segment's prediction and the stored residual."""
    segment = F.size(F.filter(index["ranks"], lambda r: r <= rank)) - 1
    steps = rank - F.get(index["ranks"], segment)
    return F.get(index["places"], segment) + F.shiftright(F.get(index["slopes"], segment) * steps, POINT) + F.get(index["residuals"], rank.cast("int"))


MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four numbers from the digest of seed and id; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """All columns of docs, and ``_fim``: n, form, prefix_chars, middle_chars, output.

    Two ranks drawn from the id cut the text into prefix, middle and suffix. ``rate`` percent of ids are transformed, of
    them ``spm`` percent with the suffix first. A null text is empty; an empty text, and one that contains a mark, stays
    plain. Rows of one id and text are treated alike. Rows do not move.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    h = draws(F.col("doc_id"), seed)
    marked = text.contains(MARKS["prefix"]) | text.contains(MARKS["suffix"]) | text.contains(MARKS["middle"])
    plain = (text == "") | marked | (h[2] % 100 >= rate)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(text.alias("text"), *(x.alias(f"h{k}") for k, x in enumerate(h)), plain.alias("plain")).alias("own"))
    rows = rows.withColumn("index", rank_index("own.text"))
    ends = F.col("index.n") + 1
    first, second = F.col("own.h0") % ends, F.col("own.h1") % ends
    rows = rows.select("row", "own", F.col("index.n").alias("n"), place(F.col("index"), F.least(first, second)).alias("a"), place(F.col("index"), F.greatest(first, second)).alias("b"))
    text, a, b, plain = F.col("own.text"), F.col("a").cast("int"), F.col("b").cast("int"), F.col("own.plain")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.length(text))
    form = F.when(plain, "plain").when(F.col("own.h3") % 100 < spm, "spm").otherwise("psm")
    mark = {name: F.lit(x) for name, x in MARKS.items()}
    rows = rows.withColumn("form", form)
    output = (
        F.when(plain, text)
        .when(F.col("form") == "psm", F.concat(mark["prefix"], prefix, mark["suffix"], suffix, mark["middle"], middle))
        .otherwise(F.concat(mark["suffix"], suffix, mark["prefix"], prefix, mark["middle"], middle))
    )
    kept = lambda c: F.when(~plain, c.cast("long"))
    fim = F.struct("n", "form", kept(a).alias("prefix_chars"), kept(b - a).alias("middle_chars"), output.alias("output"))
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns), fim.alias("_fim"))


def restored(output: Column, form: Column) -> Column:
    """The text, from what was made of it and the form. Marks stand in it once each, as no text that has one is cut."""
    part = lambda x, after, before: F.substring_index(F.substring_index(x, after, -1), before, 1)
    p, s, m = MARKS.values()
    middle = F.substring_index(output, m, -1)
    return (
        F.when(form == "psm", F.concat(part(output, p, s), middle, part(output, s, m)))
        .when(form == "spm", F.concat(part(output, p, m), middle, part(output, s, p)))
        .otherwise(output)
    )

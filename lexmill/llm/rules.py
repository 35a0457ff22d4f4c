"""Quality rules: text features, and an ordered list of threshold conjunctions learned from labels.

The list is grown by sequential covering: a rule is grown condition by condition on two thirds of a bounded
labelled sample, pruned on the other third, kept if it is precise there, and the rows it covers leave before
the next rule is grown. The result is plain data and becomes one Spark ``CASE`` expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words"]
#: What rules may test, as expressions over the counts.
FEATURES = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "distinct_words": "n_distinct_words / greatest(n_words, 1)",
}
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MARKS = np.isin(np.arange(256), list(b"!?"))


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text."""
    starts, ends, first = A.word_spans(data, offsets)
    owner, texts = A.owners(first), len(offsets) - 1

    def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])

    words = A.word_hashes(data, starts, ends)
    own = A.mix(owner.astype(np.uint64) + A.U64(1))
    threes = A.gram_hashes(words, 3)
    inside = owner[: len(threes)] == owner[2:] if len(threes) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    code, _ = pd.factorize(threes[at] ^ own[at])
    again = at[np.bincount(code, minlength=1)[code] > 1] if len(at) else at
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[again + k] = True

    breaks = np.flatnonzero(data == 10)
    line = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], breaks + 1, offsets[-1:]]))
    line_end = np.minimum(np.append(line[1:], offsets[-1]), offsets[-1])
    line_end -= (line_end > line) & (data[np.maximum(line_end, 1) - 1] == 10) if len(data) else 0
    has_word = np.diff(np.searchsorted(starts, np.append(line, offsets[-1]))) > 0
    line, line_end = line[has_word], line_end[has_word]
    line_owner = np.searchsorted(offsets, line, "right") - 1
    hashes = A.span_hash(A.byte_sums(data), line, line_end) ^ A.mix(line_owner.astype(np.uint64) + A.U64(1))
    n_lines = np.bincount(line_owner, minlength=texts)

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of[~pd.Series(keys).duplicated().to_numpy()], minlength=texts)

    gap = A.GAPS[data]
    return {
        "n_words": np.diff(first),
        "word_chars": per_text(~gap & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_dup_lines": n_lines - distinct(hashes, line_owner),
        "n_repeat_words": per_text(covered, first),
        "n_lines": n_lines,
        "n_upper": per_text((data >= 65) & (data <= 90), offsets),
        "n_digits": per_text((data >= 48) & (data <= 57), offsets),
        "n_marks": per_text(MARKS[data], offsets),
        "n_distinct_words": distinct(words ^ own, owner),
    }


def with_counts(docs: DataFrame, column: str = "counts") -> DataFrame:
    """All columns of docs, and a struct of counts of each whole text (a null text counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches):
            found = counts(*A.utf8(batch.column("text")))
            struct = pa.StructArray.from_arrays([pa.array(found[c].astype(np.int64)) for c in COUNTS], COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, column])

    kind = f"struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>"
    return docs.mapInArrow(run, docs.withColumn(column, F.lit(None).cast(kind)).schema)


def base_failed(counts: str = "counts") -> Column:
    """The fixed rules: under 50 words, or more than half of the words in repeated three-word windows."""
    return (F.col(f"{counts}.n_words") < 50) | (100 * F.col(f"{counts}.n_repeat_words") > 50 * F.col(f"{counts}.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        values = rows[self.feature].to_numpy()
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, counts: str) -> Column:
        # the counts are fields of a struct; the expressions name them bare
        text = FEATURES[self.feature]
        for name in sorted(COUNTS, key=len, reverse=True):
            text = text.replace(name, f"{{{COUNTS.index(name)}}}")
        value = F.expr(text.format(*(f"{counts}.{c}" for c in COUNTS))).cast("double")
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def covers(rule: Rule, rows: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(rows), bool)
    for condition in rule:
        out &= condition.holds(rows)
    return out


def _grow(rows: pd.DataFrame, bad: np.ndarray, longest: int) -> Rule:
    """Add the condition of greatest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(rows), bool)
    while len(rule) < longest and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best, best_gain = None, 1e-9
        for feature in FEATURES:
            values = rows[feature].to_numpy()[inside]
            flags = bad[inside]
            for threshold in np.unique(np.quantile(values, np.linspace(0, 1, 65)[1:-1])):
                over = values > threshold
                for above, hit in ((True, over), (False, ~over)):
                    p, n = flags[hit].sum(), (~flags[hit]).sum()
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0
                    if gain > best_gain:
                        best, best_gain = Condition(feature, above, float(threshold)), gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(rows)
    return tuple(rule)


def _prune(rule: Rule, rows: pd.DataFrame, bad: np.ndarray) -> Rule:
    """The prefix of the rule that is worth most on rows it was not grown on."""

    def worth(r: Rule) -> tuple[float, int]:
        hit = covers(r, rows)
        p, n = (bad & hit).sum(), (~bad & hit).sum()
        return ((p - n) / (p + n) if p + n else -1.0, -len(r))

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())


def learn(rows: pd.DataFrame, bad: np.ndarray, precision: float = 0.98, least: int = 3, most_rules: int = 16, longest: int = 4, seed: int = 7) -> list[Rule]:
    """Rules that find the bad rows, in order. Each must be right for ``precision`` of the uncovered rows it covers
    in either part of the sample, and cover ``least`` of them; with one class only, there are no rules."""
    rules: list[Rule] = []
    grown = np.random.default_rng(seed).random(len(rows)) < 2 / 3
    left = np.ones(len(rows), bool)
    while len(rules) < most_rules:
        a, b = left & grown, left & ~grown
        if not (bad & a).any() or not (~bad & a).any():
            break
        rule = _prune(_grow(rows[a], bad[a], longest), rows[b], bad[b])
        hit = covers(rule, rows) & left if rule else np.zeros(len(rows), bool)
        right = [(bad & hit & part).sum() >= precision * (hit & part).sum() for part in (grown, ~grown)]
        if hit.sum() < least or not all(right):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def first_rule(rules: list[Rule], counts: str = "counts") -> Column:
    """Number of the first rule that covers the row, null if none does: one ordered conditional expression."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        test = F.lit(True)
        for condition in rule:
            test = test & condition.column(counts)
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Features and verdicts of at most ``most`` labelled documents, those of least hashed doc_id."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most `most` rows are broadcast
    rows = with_counts(rows).where(~base_failed()).select("doc_id", "_quality", F.xxhash64("text").alias("_hash"), "counts.*")
    values = [F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()]
    # of an id's rows the one of least text hash, so at most ``most`` rows reach the driver, always the same
    first = rows.groupBy("doc_id").agg(F.min(F.struct("_hash", "_quality", *values)).alias("row"))
    found = first.select("doc_id", "row.*").toPandas().sort_values("doc_id", ignore_index=True)
    return found[list(FEATURES)], (found["_quality"] == 0).to_numpy()


def judged(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000) -> DataFrame:
    """All columns of docs with ``_counts`` (struct), ``_base_failed``, ``_rule`` (number of the rule that rejects
    it) and ``_kept``. Quality 0 is what rules look for; at most ``sample_rows`` labelled documents are fitted.

    Every row is judged, repeated ones alike; of labelled rows with one id, that of least text hash is fitted; null and empty texts fail the fixed rules; without labels of both
    kinds only the fixed rules act. Columns of docs that have one of these four names are replaced.
    """
    docs = docs.drop("_counts", "_base_failed", "_rule", "_kept")
    rules = learn(*labelled_sample(docs, labels, sample_rows))
    return (
        with_counts(docs, "_counts")
        .withColumn("_base_failed", base_failed("_counts"))
        .withColumn("_rule", first_rule(rules, "_counts"))
        .withColumn("_kept", ~F.col("_base_failed") & F.col("_rule").isNull())
    )

"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and all but the last
return the columns of documents. Null ids, null and empty texts, repeated rows and empty tables pass every stage as
its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import jaccard, packing, rules, substring
from lexmill.llm.runtime import table, written

WORD = r"[^\x20\x09-\x0D]"
#: Ingests of the passage index: the last one finds as many runs as are merged.
INGESTS = substring.FANOUT + 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rules nor the learned list rejects; their rows are unchanged."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("row"))  # so that no name can clash
    kept = rules.judged(rows, table(spark, sf_dir, "labels")).where("_kept")
    return kept.select(*(F.col("row")[c].alias(c) if c in others else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of least id.

    Of a group without any id, one row stays; a row without an id whose group has one goes. Documents without words are
    in no group and stay. Rows of one id are one document.
    """
    found = written(jaccard.near_duplicates(docs), "groups")
    # a struct is a name that no column of docs can have
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    named = rows.where("row.doc_id IS NOT NULL").join(gone, F.col("row.doc_id") == F.col("doc_id"), "left_anti")
    unnamed = rows.where("row.doc_id IS NULL")
    wordless = unnamed.where(~F.coalesce(F.col("row.text").rlike(WORD), F.lit(False)))
    stays = found.where("doc_id IS NULL AND component_id IS NULL AND component IS NOT NULL").groupBy("component").agg(F.min("text_key").alias("key"))
    own = unnamed.where(F.col("row.text").rlike(WORD)).withColumn("key", F.xxhash64("row.text")).join(stays.select("key"), "key", "left_semi")
    first = own.groupBy("key").agg(F.first("row").alias("row"))
    return named.unionByName(wordless).unionByName(first.select("row")).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that a document of smaller id has too.

    A document that loses nothing keeps its text as it is; the text of another one becomes its kept words, joined by
    spaces, and its n_chars their length. A document of which nothing is left goes.
    """
    names = docs.columns

    own = {c: F.col(f"_carry_{i}") for i, c in enumerate(names)}
    text = F.when(F.col("n_removed") == 0, own["text"]).otherwise(F.decode("kept", "UTF-8"))
    chars = F.when(F.col("n_removed") == 0, own["n_chars"]).otherwise(F.length(F.decode("kept", "UTF-8")).cast("long"))
    columns = [{**own, "text": text, "n_chars": chars}[c].alias(c) for c in names]
    keep = F.expr("n_removed = 0 OR n_removed < n_words")
    return substring.drop_repeated_passages(docs, ingests=INGESTS, carry=names, keep=keep, columns=columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each remaining document goes: sequences of 512 to 4096 words."""
    return packing.pack(docs, packing.words())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules, components and packing are beyond SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

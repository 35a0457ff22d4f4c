"""Incremental ingest: new page files are cleaned, split and merged into the chunk store once, whatever interrupts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import distinct_by_key
from ..operators.segment import split_or_fulltext
from ..sources.html import page_paragraphs
from ..sources.tables import written
from . import store


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, source, text, gone): the host of each page, its paragraphs as lines, and whether it has no html."""
    text = F.array_join(page_paragraphs(F.col("html")), "\n")
    return pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("source"), text.alias("text"), F.col("html").isNull().alias("gone"))


def text_chunks(docs: DataFrame) -> DataFrame:
    """(source, page_id, art_pos, chapter, section, label, body, chunk_id): the articles of each text, or the whole text
    where there are none."""
    chunks = split_or_fulltext(docs, "page_id", "text").join(docs.select("page_id", "source"), "page_id")
    name = F.concat("source", F.lit("/"), F.col("page_id").cast("string"), F.lit("::"), F.coalesce("label", F.lit("全文")))
    return chunks.select("source", "page_id", "art_pos", "chapter", "section", "label", "body", name.alias("chunk_id"))


def page_chunks(pages: DataFrame) -> DataFrame:
    return text_chunks(page_texts(pages))


def stream_ingest(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, schema: str, ratio: int = store.RATIO) -> None:
    """Process the files that have arrived since the last run, then stop.

    The checkpoint keeps finished files from being read again. Each batch is one run of the store, published at once; one
    that is repeated after a failure is brought in once. A page that comes again replaces all its chunks, one without
    html is gone. Of several versions of a page in one batch that of the newest file counts. Runs are merged after a
    batch where their sizes ask for it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        def run() -> tuple[DataFrame, DataFrame]:
            newest = distinct_by_key(batch, "page_id", [F.col("arrived").desc(), F.xxhash64("html")])
            docs = written(page_texts(newest), "arrived")
            return docs, text_chunks(docs.where("NOT gone"))

        store.add_run(spark, out_dir, checkpoint, number, run)
        store.compact(spark, out_dir, ratio)

    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(in_dir)
    pages = pages.select("*", F.col("_metadata.file_modification_time").alias("arrived"))
    query = pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

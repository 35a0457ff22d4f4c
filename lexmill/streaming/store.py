"""A chunk store as a log of runs.

Each batch adds one run: the pages that came, and their chunks. A manifest names the runs that count, oldest first; a
new version of it is the only thing that makes a run visible, so a run that was not finished or not published changes
nothing. A page's chunks are those of the newest run that has the page; a page that is gone is a run's row without
chunks. Runs are merged when a newer one has grown to about the size of the one before it, so there are few of them,
sizes fall from old to new, and a chunk is written again a number of times that grows with the logarithm of the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

CHUNKS = "source string, page_id long, art_pos int, chapter string, section string, label string, body string, chunk_id string"
PAGES = "page_id long, gone boolean"
#: A run is merged with the one before it when that is less than so many times as large.
RATIO = 2


@dataclass(frozen=True)
class Run:
    """A folder with the pages and chunks of the batches from ``first`` to ``last``."""

    name: str
    first: int
    last: int
    bytes: int


@dataclass(frozen=True)
class Manifest:
    """What a version of the store consists of. ``done``: the last batch that each stream has brought in."""

    version: int = 0
    runs: tuple[Run, ...] = ()
    done: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str) -> Manifest:
        found = json.loads(text)
        return Manifest(found["version"], tuple(Run(**r) for r in found["runs"]), found["done"])


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split(".")[0]) for n in files.names(spark, f"{path}/manifests") if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest version, or an older one; an empty one for a store that is not there yet."""
    found = versions(spark, path)
    if not found:
        return Manifest()
    return Manifest.of(files.read_text(spark, f"{path}/manifests/{found[-1] if version is None else version:012d}.json"))


def published(spark: SparkSession, path: str, now: Manifest) -> Manifest:
    files.publish(spark, f"{path}/manifests/{now.version:012d}.json", now.text())
    return now


def written_run(spark: SparkSession, path: str, first: int, last: int, pages: DataFrame, chunks: DataFrame) -> Run:
    """A run in a folder of its own, which nothing refers to yet."""
    name = f"{first:012d}-{last:012d}-{uuid.uuid4().hex[:8]}"
    pages.select("page_id", "gone").write.parquet(f"{path}/runs/{name}/pages")
    chunks.select(*(c.split()[0] for c in CHUNKS.split(", "))).write.parquet(f"{path}/runs/{name}/chunks")
    return Run(name, first, last, files.size(spark, f"{path}/runs/{name}"))


def parts(spark: SparkSession, path: str, runs: tuple[Run, ...]) -> tuple[DataFrame, DataFrame]:
    """Of some runs the newest row of each page, and the chunks of the pages that are not gone."""
    read = lambda kind, schema, r: spark.read.schema(schema).parquet(f"{path}/runs/{r.name}/{kind}").withColumn("_run", F.lit(r.last))
    pages = reduce(DataFrame.unionByName, (read("pages", PAGES, r) for r in runs))
    chunks = reduce(DataFrame.unionByName, (read("chunks", CHUNKS, r) for r in runs))
    newest = pages.groupBy("page_id").agg(F.max(F.struct("_run", "gone")).alias("n")).select("page_id", "n._run", "n.gone")
    there = newest.where("NOT gone").select(F.col("page_id").alias("_page"), F.col("_run").alias("_newest"))
    # a page without an id is one page
    own = chunks.join(there, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_run") == F.col("_newest")), "left_semi")
    return newest.drop("_run"), own.drop("_run")


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunks of a version of the store, the newest if none is given."""
    runs = manifest(spark, path, version).runs
    return parts(spark, path, runs)[1] if runs else spark.createDataFrame([], CHUNKS)


def add_run(spark: SparkSession, path: str, stream: str, batch: int, make: Callable[[], tuple[DataFrame, DataFrame]]) -> Manifest:
    """Bring in a batch of a stream once: pages (page_id, gone) and chunks of those that are not gone. A batch that is
    already in changes nothing, whatever interrupted the one who brought it."""
    now = manifest(spark, path)
    if now.done.get(stream, -1) >= batch:
        return now
    number = now.runs[-1].last + 1 if now.runs else 0
    run = written_run(spark, path, number, number, *make())
    return published(spark, path, replace(now, version=now.version + 1, runs=(*now.runs, run), done={**now.done, stream: batch}))


def due(runs: tuple[Run, ...], ratio: int = RATIO) -> int:
    """How many of the newest runs are to be merged, 0 if none are."""
    count, size = 1, runs[-1].bytes if runs else 0
    while count < len(runs) and runs[-count - 1].bytes < ratio * size:
        size += runs[-count - 1].bytes
        count += 1
    return count if count > 1 else 0


def compact(spark: SparkSession, path: str, ratio: int = RATIO) -> Manifest:
    """Merge the newest runs as far as their sizes ask for it. What is gone is forgotten once no older run may have it."""
    now = manifest(spark, path)
    count = due(now.runs, ratio)
    if not count:
        return now
    old, merged = now.runs[:-count], now.runs[-count:]
    pages, chunks = parts(spark, path, merged)
    run = written_run(spark, path, merged[0].first, merged[-1].last, pages if old else pages.where("NOT gone"), chunks)
    return published(spark, path, replace(now, version=now.version + 1, runs=(*old, run)))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the manifests but the last ``keep``, and the runs that none of those names; their names. To be called while
    nothing is written or read by an older version."""
    found = versions(spark, path)
    named = {r.name for v in found[-keep:] for r in manifest(spark, path, v).runs}
    lost = [n for n in files.names(spark, f"{path}/runs") if n not in named]
    for name in lost:
        files.delete(spark, f"{path}/runs/{name}")
    for v in found[:-keep]:
        files.delete(spark, f"{path}/manifests/{v:012d}.json")
    return lost

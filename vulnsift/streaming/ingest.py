"""Incremental feed ingest with Structured Streaming (optional form of V9/K3).

New feed files landing in a folder are read by the file source (explicit feed schema, one
JSON document per file), exploded into items, turned into collection rows and appended with
insert-if-absent semantics in ``foreachBatch``. The stream keeps its progress in a checkpoint
location on shared storage, so a restarted or failed job resumes without re-adding rows; the
anti-join in ``Collection.add`` makes a replayed micro-batch harmless as well.

Positional ``doc-{i}`` ids are not stable across micro-batches, so the stream uses the advisory
id as the collection id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vulnsift.functions.embed import hashed_embedding
from vulnsift.operators.templates import dense_documents
from vulnsift.sources.collection import Collection
from vulnsift.session import checkpoint_dir
from vulnsift.sources.feed import feed_options, feed_rows, raw_feed_schema


def feed_stream(spark: SparkSession, feed_dir: str) -> DataFrame:
    """Every item of new files, malformed ones and files marked in ``reject``."""
    return feed_rows(feed_options(spark.readStream.schema(raw_feed_schema())).json(feed_dir))


@dataclass(frozen=True)
class Progress:
    """What one batch brought."""
    batch: int
    items: int
    rejects: int
    documents: int


def observed(df: DataFrame, name: str, **counts) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``df`` with counters, and how to read them after the first action over it; ``counts`` are conditions (None: every row).
    The numbers come with the action itself; a retried task may count twice, so they inform and decide nothing."""
    seen = Observation(name)
    columns = [F.count(F.lit(1) if c is None else F.when(c, 1)).alias(n) for n, c in counts.items()]
    return df.observe(seen, *columns), lambda: dict(seen.get)


def ingest_feed(spark: SparkSession, feed_dir: str, collection: Collection, checkpoint_location: str,
                available_now: bool = True, rejects_path: str | None = None,
                on_progress: Callable[[Progress], None] | None = None):
    """Start (and, with ``available_now``, finish) the ingest of every feed file in ``feed_dir``; with ``rejects_path``,
    malformed files and items are appended there as Parquet. ``on_progress`` gets the counts of every batch once it is stored."""

    def add_batch(batch: DataFrame, epoch_id: int) -> None:
        # one action reads the batch and counts it; what follows reads what that action has written
        seen, counts = observed(batch, f"ingest-{epoch_id}", items=F.col("reject").isNull(), rejects=F.col("reject").isNotNull())
        seen = seen.checkpoint()
        docs, documents = observed(dense_documents(seen.where("reject IS NULL")), f"documents-{epoch_id}", documents=None)
        rows = docs.select(F.col("cve_id").alias("id"), F.col("document"),
                           hashed_embedding("document").alias("embedding"), "pos")
        collection.add(rows)
        if rejects_path:
            seen.where("reject IS NOT NULL").select("source_file", "pos", "reject") \
                .write.mode("overwrite").parquet(f"{rejects_path.rstrip('/')}/batch={epoch_id}")

        if on_progress:
            on_progress(Progress(epoch_id, **counts(), **documents()))

    checkpoint_dir(spark)
    w = feed_stream(spark, feed_dir).writeStream.foreachBatch(add_batch) \
        .option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q

"""Ingest of pages as they arrive, and windowed counts of events with late data."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from specloom.functions.vocabulary import Domain
from specloom.operators.domains import Domains
from specloom.plans.pipeline import Analysis
from specloom.sources import artifacts

BUCKETS = 64  # parts of the store of pages, by document
HOLD_MS, LATE_MS = 600_000, 30 * 86_400_000  # how long a quiet document's pages stay in the state, and after that its version
_PAGES = "doc_id long, version int, restored boolean, page_number int, text string, fresh boolean"


def page_stream(spark: SparkSession, path: str, per_trigger: int = 4) -> DataFrame:
    """New parquet files of pages as they arrive."""
    return spark.readStream.schema("doc_id long, page_number int, text string").option("maxFilesPerTrigger", per_trigger).parquet(path)


def open_documents(pages: DataFrame, hold_ms: int = HOLD_MS, late_ms: int = LATE_MS) -> DataFrame:
    """All known pages of each document that gets new ones, with the number of its version; a page that comes again takes the place of the first.

    The state holds the pages of documents that are open. A document without new pages for ``hold_ms`` is closed: the
    state keeps its version alone, and forgets that too after ``late_ms``. Late pages of a closed document come
    by themselves with ``restored``, so that the older ones are fetched from where they were stored. Time is that of
    arrival: it goes on when pages arrive.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, closed, held = state.get if state.exists else (0, False, "{}")
        if state.hasTimedOut:
            if closed:
                state.remove()
            else:
                state.update((version, True, "{}"))
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + late_ms)
            return
        new, now = {}, 0
        for frame in frames:
            now = max(now, int(frame["arrived_ms"].max()))
            new |= {int(n): None if pd.isna(t) else t for n, t in zip(frame["page_number"], frame["text"], strict=True) if not pd.isna(n)}
        known = new if closed else {int(n): t for n, t in json.loads(held).items()} | new
        state.update((version + 1, closed, "{}" if closed else json.dumps(known)))
        state.setTimeoutTimestamp(now + (late_ms if closed else hold_ms))
        rows = [(key[0], version + 1, closed, n, t, n in new) for n, t in known.items()]
        yield pd.DataFrame(rows, columns=["doc_id", "version", "restored", "page_number", "text", "fresh"])

    rows = pages.filter("doc_id IS NOT NULL").select("doc_id", "page_number", "text", F.current_timestamp().alias("arrived")).withWatermark("arrived", "0 seconds")
    rows = rows.withColumn("arrived_ms", F.unix_millis("arrived"))
    return rows.groupBy("doc_id").applyInPandasWithState(step, _PAGES, "version int, closed boolean, pages string", "append", GroupStateTimeout.EventTimeTimeout)


def ingest_rules(pages: DataFrame, out: str, checkpoint: str, domain: Domain | Domains, hold_ms: int = HOLD_MS, late_ms: int = LATE_MS, buckets: int = BUCKETS) -> StreamingQuery:
    """Mine the documents of each micro-batch that got pages, as a whole, into ``out``, a folder for each batch; :func:`latest_rules` reads the last version of each.

    Pages of a document may come in any number of batches. Those of each batch are stored beside ``out`` by bucket of the document, and
    only the buckets of closed documents with late pages are read again. A batch that is run again replaces itself.
    """
    spark = pages.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")

    def one(batch: DataFrame, batch_id: int) -> None:
        with artifacts.tables_made() as made:
            rows = artifacts.settled(batch)  # the state is asked once
            rows.filter("fresh").select("doc_id", "page_number", "text", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}-pages/batch={batch_id}")
            versions = rows.groupBy("doc_id").agg(F.max("version").alias("version"))
            whole = rows.select("doc_id", "page_number", "text")
            late = rows.filter("restored").select("doc_id", bucket).distinct()
            touched = [r["bucket"] for r in late.select("bucket").distinct().collect()]  # at most ``buckets``
            if touched:
                stored = spark.read.schema("doc_id long, page_number int, text string, batch long, bucket int").parquet(f"{out}-pages")
                old = stored.filter(F.col("bucket").isin(touched) & (F.col("batch") < batch_id)).join(late.select("doc_id"), "doc_id", "left_semi")
                old = old.groupBy("doc_id", "page_number").agg(F.max_by("text", "batch").alias("text"))
                whole = whole.unionByName(old.join(whole, ["doc_id", "page_number"], "left_anti"))
            mined = Analysis(whole, domain).mined
            mined.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            versions.write.mode("overwrite").parquet(f"{out}-versions/batch={batch_id}")
        artifacts.released(spark, made)

    return open_documents(pages, hold_ms, late_ms).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rules(spark: SparkSession, out: str) -> DataFrame:
    """The rules of each document's last version, with version. A document without rules in its last version has none."""
    versions = spark.read.schema("doc_id long, version int, batch long").parquet(f"{out}-versions")
    last = versions.groupBy("doc_id").agg(F.max(F.struct("batch", "version")).alias("v")).select("doc_id", "v.batch", "v.version")
    return spark.read.parquet(out).join(last, ["doc_id", "batch"]).drop("batch")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, total: counts and sums of events by tumbling window; later rows than ``late`` are dropped from a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def event_counts(spark: SparkSession, path: str, out: str, checkpoint: str, width: str = "1 day") -> StreamingQuery:
    """Stream the events under ``path`` into windowed counts at ``out``, one folder of changed windows for each batch.

    Windows older than the watermark leave the state. A batch that is run again replaces itself; :func:`latest_counts`
    reads the last state of every window.
    """
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path.rsplit("/", 1)[0]).withColumn("ts", F.col("ts").cast("timestamp"))

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return event_windows(events, width).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """window_start, event_type, n, total: the last state of every window written by :func:`event_counts`."""
    rows = spark.read.parquet(out).groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return rows.select("window_start", "event_type", "s.n", "s.total")

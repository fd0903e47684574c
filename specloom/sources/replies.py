"""A store of model replies: what was answered once is never asked again, and a retried task cannot change it."""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.sources.artifacts import exists

Model = Callable[[list[str]], list[str | None]]
ROW = "key string, reply string, provider int, error string, run string"


def reply_key(step: str, prompt: Column) -> Column:
    """The key of a prompt of a step; a null prompt is the empty one."""
    return F.sha2(F.concat(F.lit(step), F.lit("\x00"), F.coalesce(prompt, F.lit(""))), 256)


def attempt(prompts: list[str], providers: Sequence[Model], tries: int, wait: float = 0.0) -> list[tuple[str | None, int | None, str | None]]:
    """(reply, number of the provider that gave it, error) of each prompt.

    A provider gets all prompts that have no reply yet at once. Where that fails, or it gives another number of replies, each prompt is asked
    by itself, up to ``tries`` times, ``wait`` seconds longer before each. Prompts without a reply go to the next provider. The
    error is the last one of a prompt that no provider has answered; without one the providers had no reply to give.
    """
    found: list[tuple[str | None, int | None, str | None]] = [(None, None, None)] * len(prompts)
    for number, model in enumerate(providers):
        left = [i for i, (reply, _, _) in enumerate(found) if reply is None]
        if not left:
            break
        try:
            replies = model([prompts[i] for i in left])
            if len(replies) != len(left):
                raise ValueError(f"{len(replies)} replies to {len(left)} prompts")
            for i, reply in zip(left, replies, strict=True):
                found[i] = (reply, None if reply is None else number, found[i][2])
        except Exception:  # noqa: BLE001
            for i in left:
                found[i] = _alone(prompts[i], model, number, tries, wait, found[i][2])
    return [(reply, number, None if reply is not None else error) for reply, number, error in found]


def _alone(prompt: str, model: Model, number: int, tries: int, wait: float, error: str | None) -> tuple[str | None, int | None, str | None]:
    for n in range(tries):
        try:
            (reply,) = model([prompt])
            return reply, None if reply is None else number, error
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
            if wait and n + 1 < tries:
                time.sleep(wait * (n + 1))
    return None, None, error


@dataclass(frozen=True)
class ReplyStore:
    """Replies in ``folder``, on any file system that all executors share.

    tries and wait bound what one failing prompt costs; size is the number of prompts that a provider gets at once. Replies are
    written before anything reads them, so a task that runs twice asks twice but only one of its answers is seen. Failures are
    kept in the tables of their run, and are asked again by the next one. Where two runs at once answer the same prompt,
    the earlier run counts for all that read later.
    """

    folder: str
    tries: int = 3
    wait: float = 0.0
    size: int = 64

    def table(self, spark: SparkSession, step: str) -> DataFrame:
        """key, reply, provider, error, run: all that the runs have written for a step, failures included."""
        path = self._path(step)
        return spark.read.schema(ROW).option("recursiveFileLookup", "true").parquet(path) if exists(spark, path) else spark.createDataFrame([], ROW)

    def replies(self, spark: SparkSession, step: str) -> DataFrame:
        """key, reply, provider: the reply that counts for each answered prompt of a step."""
        rows = self.table(spark, step).filter("reply IS NOT NULL")
        return rows.groupBy("key").agg(F.min_by(F.struct("reply", "provider"), F.struct("run", "provider", "reply")).alias("r")).select("key", "r.*")

    def ask(self, asked: DataFrame, step: str, model: Model | Sequence[Model] | None) -> DataFrame:
        """``asked`` (doc_id, batch, prompt) with reply, provider and error, for the prompts of a step.

        Equal prompts are asked once. Only prompts without a stored reply are asked, of the first of the models, then of the next where
        it fails. Without a model nothing is asked, and the stored replies are all there is. Nothing here depends on the
        number of prompts but the tables: they are dealt out by their key.
        """
        spark = asked.sparkSession
        rows = asked.select("doc_id", "batch", "prompt").withColumn("key", reply_key(step, F.col("prompt")))
        providers = [] if model is None else [model] if callable(model) else list(model)
        known, run = self.replies(spark, step), f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        failed = spark.createDataFrame([], "key string, error string")
        if providers:
            open_ = rows.groupBy("key").agg(F.first("prompt").alias("prompt")).join(known, "key", "left_anti")  # one prompt has one key
            path = posixpath.join(self._path(step), f"run-{run}")
            self._answered(open_, providers, run).write.parquet(path)
            known = self.replies(spark, step)
            failed = spark.read.schema(ROW).parquet(path).filter("error IS NOT NULL").select("key", "error")
        out = rows.join(known, "key", "left").join(failed, "key", "left")
        return out.select("doc_id", "batch", "prompt", "reply", "provider", F.when(F.col("reply").isNull(), F.col("error")).alias("error"))

    def _path(self, step: str) -> str:
        return posixpath.join(self.folder, f"step={step}")

    def _answered(self, prompts: DataFrame, providers: Sequence[Model], run: str) -> DataFrame:
        tries, wait, size = self.tries, self.wait, self.size

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, size):
                    batch = whole.slice(start, size)
                    got = attempt([p or "" for p in batch.column("prompt").to_pylist()], providers, tries, wait)
                    reply, provider, error = (list(x) for x in zip(*got, strict=True))
                    columns = [batch.column("key"), pa.array(reply, pa.string()), pa.array(provider, pa.int32()), pa.array(error, pa.string()), pa.array([run] * len(got), pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "reply", "provider", "error", "run"])

        return prompts.select("key", "prompt").mapInArrow(go, ROW)

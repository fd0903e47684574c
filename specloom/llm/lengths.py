"""Exact token counts from a length histogram.

Documents are encoded and counted by length. Suffix sums of the histogram answer, for any context
limit, how many documents reach it, how many tokens there are in all, and how many are left when
every document is cut at the limit: the sum over k = 1..limit of the documents with k tokens or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.bpe import load_ranks
from specloom.llm.common import materialize
from specloom.llm.packing import rank_encoding

SPAN = 1024  # lengths whose sums are made in one group


def token_lengths(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every document; a null text has none."""

    shared = documents.sparkSession.sparkContext.broadcast(load_ranks(path))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(shared.value)
        for batch in batches:
            n = [len(encoding.encode_to_numpy(t.as_py() or "", disallowed_special=())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n, np.int64))], ["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(documents: DataFrame, path: str) -> DataFrame:
    """n_tokens and n_docs. Each task counts its own documents first, so only lengths are shuffled."""
    return token_lengths(documents, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs: n_docs, docs_from, tokens_from, tokens_total, truncated, quantile.

    docs_from and tokens_from cover the documents of at least this length; truncated is the total when
    every document is cut at this length; quantile is the share of documents of at most this length.
    The sums are made in groups of ``SPAN`` lengths, and each group starts from the totals of those
    beyond it, so no task holds the whole histogram. An empty histogram gives no rows.
    """
    hist = materialize(hist.withColumn("span", F.floor(F.col("n_tokens") / SPAN)), "histogram")
    spans = hist.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    # one row for SPAN lengths: the longest document bounds them
    beyond = spans.selectExpr("span", "coalesce(sum(d) OVER (ORDER BY span DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d_beyond", "coalesce(sum(t) OVER (ORDER BY span DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t_beyond", "sum(d) OVER () AS d_all", "sum(t) OVER () AS t_all")
    window = "OVER (PARTITION BY span ORDER BY n_tokens DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = hist.join(beyond, "span").selectExpr("n_tokens", "n_docs", f"d_beyond + sum(n_docs) {window} AS docs_from", f"t_beyond + sum(n_docs * n_tokens) {window} AS tokens_from", "t_all AS tokens_total", "d_all")
    return rows.selectExpr("n_tokens", "n_docs", "docs_from", "tokens_from", "tokens_total", "tokens_total - tokens_from + n_tokens * docs_from AS truncated", "(d_all - docs_from + n_docs) / d_all AS quantile")


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit and tokens: the total when every document is cut at the limit, for any limits.

    The shortest length at or above a limit has the suffix that the limit cuts. The limits (a short list)
    are held against the histogram's rows in one aggregation, without a join.
    """
    least = [F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("n_tokens") >= x, F.col("n_tokens"))).alias(f"s{i}") for i, x in enumerate(limits)]
    one = sums.agg(F.max("tokens_total").alias("total"), *least)
    each = F.explode(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("limit"), F.when(F.col(f"s{i}.docs_from") > 0, F.col(f"s{i}")).alias("s")) for i, x in enumerate(limits)]))
    return one.select("total", each.alias("e")).selectExpr("e.limit AS limit", "coalesce(total - coalesce(e.s.tokens_from, 0) + e.limit * coalesce(e.s.docs_from, 0), 0) AS tokens")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share and n_tokens: the least length that at least so large a share of the documents does not exceed. Null without documents."""
    one = sums.agg(*[F.min(F.when(F.col("quantile") >= x, F.col("n_tokens"))).alias(f"q{i}") for i, x in enumerate(shares)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(x)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, x in enumerate(shares)])).alias("e")).select("e.*")

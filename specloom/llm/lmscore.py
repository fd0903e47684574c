"""Language-model scoring by cross-entropy difference.

Two bigram models over one vocabulary, the tokens of a public byte-level BPE: the target model is
trained on the documents that ``labels`` calls good, the background model on all documents. The models
are matched: the same order, the same weight of the bigram estimate, and a floor of the same share of
their own tokens, however many these are. Both leave out the document that is being scored, so its own
counts don't speak for it. A document's score is the mean over its tokens of the background's loss less
the target's: high for documents that look like the target, low for those of which the corpus has a copy.

Counts are exact. Documents are gathered in blocks of bounded size; each block counts its own bigrams,
the blocks' counts are summed over the corpus, and every block gets back the counts of its own bigrams
and no others. So the models grow with the corpus, and no task or driver ever holds one whole. The counts
of tokens and of contexts are one row for each word of the vocabulary, and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.bpe import load_ranks
from specloom.llm.common import materialize
from specloom.llm.packing import rank_encoding

WEIGHT = 0.7  # of the bigram estimate; the rest goes to the token's own frequency
FLOOR = 0.01  # share of the token frequencies that is spread evenly, so that no probability is zero
BLOCK_TOKENS = 1_000_000  # tokens after which a block is closed; a longer document is a block by itself
BLOCK_DOCS = 100_000  # documents after which it is closed too
SHIFT = 20  # a bigram's key is context << SHIFT | token
FEW_GOOD = 1_000_000  # target ids up to which they are broadcast, 8 bytes each; more of them are joined by a shuffle


def _packed(ids: np.ndarray) -> bytes:
    """Token ids in few bytes: 16 bits each where that holds them, compressed."""
    return zstandard.ZstdCompressor().compress(ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes())


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(raw)
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.int64)


def _keys(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """The bigram key of each token; the first one's context is a start symbol."""
    before = np.concatenate([[vocabulary], ids[:-1]])
    return (before << SHIFT) | ids


def encoded(documents: DataFrame, labels: DataFrame, tokens: list[bytes]) -> DataFrame:
    """block, doc_ids, good, sizes, ids: the documents of each block and their token ids, end to end.

    A document counts for the target if any row of ``labels`` gives its id quality 1.
    """
    spark = documents.sparkSession
    vocabulary = spark.sparkContext.broadcast(tokens)
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    few = None
    rows = documents.select(F.col("doc_id").cast("long"), F.lit(False).alias("good"), "text")
    if good.count() <= FEW_GOOD:
        few = spark.sparkContext.broadcast(np.sort(good.toArrow().column(0).to_numpy()))
    else:
        rows = rows.drop("good").join(good.withColumn("good", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("good", F.lit(False)).alias("good"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(vocabulary.value)
        held: list[tuple[int, bool, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            values = [[[d for d, _, _ in held]], [[g for _, g, _ in held]], [[len(x) for _, _, x in held]], [_packed(np.concatenate([x for _, _, x in held]))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()), strict=True)], ["doc_ids", "good", "sizes", "ids"])

        for batch in batches:
            docs, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if few is not None:
                marks = np.isin([-1 if d is None else d for d in docs], few.value) & np.array([d is not None for d in docs], bool)
            for doc, is_good, text in zip(docs, marks, batch.column(2), strict=True):
                ids = encoding.encode_to_numpy(text.as_py() or "", disallowed_special=())
                if held and (size + len(ids) > BLOCK_TOKENS or len(held) >= BLOCK_DOCS):
                    yield out()
                    held, size = [], 0
                held.append((doc, bool(is_good), ids))
                size += len(ids)
        if held:
            yield out()

    blocks = rows.mapInArrow(run, "doc_ids array<long>, good array<boolean>, sizes array<long>, ids binary")
    return materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _block(sizes: list[int], raw: bytes, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids, bigram keys and document numbers of a block, token by token."""
    sizes = np.asarray(sizes, np.int64)
    ids = _unpacked(raw, int(sizes.sum()))
    key = _keys(ids, vocabulary)
    begins = np.cumsum(np.append(0, sizes[:-1]))[sizes > 0]
    key[begins] = (vocabulary << SHIFT) | ids[begins]
    return ids, key, np.repeat(np.arange(len(sizes)), sizes)


def counts(blocks: DataFrame, vocabulary: int) -> DataFrame:
    """block, key, background, target: how often each block's documents hold each bigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, good, sizes, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, key, doc = _block(sizes, raw, vocabulary)
                keys, at, n = np.unique(key, return_inverse=True, return_counts=True)
                t = np.bincount(at, weights=np.array(good, float)[doc], minlength=len(keys)).astype(np.int64)
                for k in range(0, len(keys), 100_000):
                    part = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), block)), pa.array(keys[part]), pa.array(n[part].astype(np.int64)), pa.array(t[part])], ["block", "key", "background", "target"])

    return materialize(blocks.select("block", "good", "sizes", "ids").mapInArrow(run, "block long, key long, background long, target long"), "counts")


def single_counts(blocks: DataFrame, vocabulary: int) -> np.ndarray:
    """[token or context] x [id] x [background or target]: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, vocabulary + 1, 2), np.int64)
        for batch in batches:
            for good, sizes, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, key, doc = _block(sizes, raw, vocabulary)
                mine = np.array(good, bool)[doc]
                for kind, x in enumerate((ids, key >> SHIFT)):
                    out[kind, :, 0] += np.bincount(x, minlength=vocabulary + 1)
                    out[kind, :, 1] += np.bincount(x[mine], minlength=vocabulary + 1)
        at = np.flatnonzero(out.reshape(-1, 2).any(1))
        b, t = out.reshape(-1, 2)[at].T
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(b), pa.array(t)], ["at", "b", "t"])

    rows = blocks.select("good", "sizes", "ids").mapInArrow(run, "at long, b long, t long").groupBy("at").agg(F.sum("b").alias("b"), F.sum("t").alias("t")).toPandas()
    out = np.zeros((2 * (vocabulary + 1), 2), np.int64)
    out[rows["at"].to_numpy(int)] = rows[["b", "t"]].to_numpy(int)
    return out.reshape(2, vocabulary + 1, 2)


def _own(doc: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """How often the document of each token holds x."""
    _, at, n = np.unique((doc << bits) | x, return_inverse=True, return_counts=True)
    return n[at].astype(float)


def score(documents: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss, score (bits per token).

    A null or empty text has no tokens, null losses and score 0. Where a model has no other document, it is
    flat. Repeated rows are documents of their own, each of which the other speaks for; a null id is never
    a target; other columns are not read. A bigram has one row for each block at most, of the hundreds of
    thousands that a block has, so even the commonest is no large part of a task's share.
    """
    tokens = load_ranks(path)
    vocabulary = len(tokens)
    blocks = encoded(documents, labels, tokens)
    by_block = counts(blocks, vocabulary)
    single = single_counts(blocks, vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast(single)
    model = by_block.groupBy("key").agg(F.sum("background").alias("b"), F.sum("target").alias("t"))
    own = by_block.select("block", "key").join(model, "key")

    def run(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        key = right["key"].to_numpy()
        order = np.argsort(key)
        key, n = key[order], right[["b", "t"]].to_numpy(np.float64)[order]
        single, totals = shared.value.astype(float), shared.value[0].sum(0).astype(float)
        out = []
        for docs, good, sizes, raw in zip(left["doc_ids"], left["good"], left["sizes"], left["ids"], strict=True):
            ids, k, doc = _block(sizes, raw, vocabulary)
            sizes, context = np.asarray(sizes, np.int64), k >> SHIFT
            # what the document itself has is taken from the background, and from the target if it is in it
            mine = np.stack([np.ones(len(sizes)), np.asarray(good, float)], 1)[doc]
            bigrams = (n[np.searchsorted(key, k)] if len(k) else np.zeros((0, 2))) - mine * _own(doc, k, 2 * SHIFT)[:, None]
            contexts = single[1][context] - mine * _own(doc, context, SHIFT)[:, None]
            singles = single[0][ids] - mine * _own(doc, ids, SHIFT)[:, None]
            others = totals - mine * sizes[doc][:, None]
            share = np.divide(bigrams, contexts, out=np.zeros_like(bigrams), where=contexts > 0)
            plain = np.divide(singles, others, out=np.full_like(singles, 1 / vocabulary), where=others > 0)
            weight = np.where(contexts > 0, WEIGHT, 0.0)
            loss = -np.log2(weight * share + (1 - weight) * ((1 - FLOOR) * plain + FLOOR / vocabulary))
            sums = np.stack([np.bincount(doc, loss[:, m], len(sizes)) for m in (0, 1)], 1)
            mean = np.divide(sums, sizes[:, None], out=np.full(sums.shape, np.nan), where=sizes[:, None] > 0)
            out.append(pd.DataFrame({"doc_id": pd.array([None if d is None or d != d else int(d) for d in docs], "Int64"), "n_tokens": sizes, "target_loss": mean[:, 1], "background_loss": mean[:, 0]}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_tokens": [], "target_loss": [], "background_loss": []})

    scored = blocks.select("block", "doc_ids", "good", "sizes", "ids").groupBy("block").cogroup(own.groupBy("block")).applyInPandas(run, "doc_id long, n_tokens long, target_loss double, background_loss double")
    losses = [F.when(F.col("n_tokens") > 0, F.col(c)).alias(c) for c in ("target_loss", "background_loss")]
    return scored.select("doc_id", "n_tokens", *losses, F.when(F.col("n_tokens") > 0, F.col("background_loss") - F.col("target_loss")).otherwise(0.0).alias("score"))

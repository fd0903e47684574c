"""SentencePiece encoding and decoding by a table of distinct chunks.

A text's blanks become markers, with one more marker in front. Where no piece of the vocabulary has a
marker after another character, merging never crosses the border before a run of markers, so a text is
the sequence of its chunks: a run of markers and what follows up to the next one. A task takes its
documents in blocks of about a megabyte of text. A block is its distinct chunks and, for every document, the
codes of its chunks in order; every distinct chunk is segmented once, and its ids are joined back to the places
where the chunk stands. What was segmented stays known for the task's next blocks.

One table of chunks for all tasks would have to deal out the distinct chunks of every block and the codes, which
is more than the texts themselves, to save less than half of a segmentation that is cheap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
BLOCK_CHARS = 1_000_000  # text of a block; a longer document is a block by itself
KNOWN, KNOWN_CHARS = 200_000, 64  # chunks that a task remembers, and their length; beyond that number it begins anew with the next block
PROBE = " a  bé ﬁ "  # a text that any normalisation but marking blanks would change


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def can_split(processor: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether chunks can be segmented apart: no piece crosses a border, and normalisation only marks blanks."""
    pieces = processor.id_to_piece(list(range(processor.get_piece_size())))
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and "".join(processor.encode(PROBE, out_type=str)) == marked(PROBE)


def chunks_of(text: str, split: bool = True) -> list[str]:
    """The chunks of a text, in order; together they spell the marked text. Without ``split`` a text is one chunk."""
    if not split:
        return [marked(text)] if text else []
    return _CHUNK(marked(text))


_CHUNK = re.compile(f"{MARK}+[^{MARK}]*").findall


class _Codes(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = found = len(self)
        return found


def segment(processor: sentencepiece.SentencePieceProcessor, chunks: list[str]) -> list[list[int]]:
    """The ids of each chunk. The processor sets the first marker itself, but not before an empty text."""
    found = processor.encode([c[1:] for c in chunks], num_threads=1)
    alone = processor.piece_to_id(MARK)
    return [ids if len(c) > 1 else [alone] for ids, c in zip(found, chunks, strict=True)]


def joined(codes: list[int], table: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all codes in a row, and where each code's ids begin (with the end)."""
    codes, sizes = np.array(codes, np.int64), np.fromiter(map(len, table), np.int64, len(table))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.fromiter(chain.from_iterable(table), np.uint32, starts[-1])
    n = sizes[codes]
    at = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(starts[:-1][codes] - at[:-1], n) + np.arange(at[-1])], at


class Encoder:
    """Encodes blocks of texts with one processor, and remembers chunks."""

    def __init__(self, model: bytes, split: bool):
        self.processor, self.split, self.known = load(model), split, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, with the begin and end ids, as little-endian unsigned 32-bit integers."""
        table, codes, ends = _Codes(), [], []
        for text in texts:
            codes += map(table.__getitem__, chunks_of(text, self.split))
            ends.append(len(codes))
        if len(self.known) > KNOWN:
            self.known.clear()
        new = [c for c in table if c not in self.known]
        self.known.update(zip(new, segment(self.processor, new), strict=True))
        ids, at = joined(codes, [self.known[c] for c in table])
        for c in new:
            if len(c) > KNOWN_CHARS:
                del self.known[c]
        begin, end = (np.array([i], np.uint32) for i in (self.processor.bos_id(), self.processor.eos_id()))
        stops = at[ends].tolist()
        return [np.concatenate([begin, ids[a:b], end]).tobytes() for a, b in zip([0, *stops], stops)]


def encode(documents: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id and ids, little-endian unsigned 32-bit integers with the begin and end ids.

    A null text counts as empty: only the begin and end ids. Repeated rows give repeated results; other columns
    are not read. No shuffle; a task holds an Arrow batch, a block and what it knows of chunks. A document is
    not split over blocks.
    """
    with open(path, "rb") as f:
        model = f.read()
    shared, split = documents.sparkSession.sparkContext.broadcast(model), can_split(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, split)
        for batch in batches:
            texts, sizes = batch.column(1), np.cumsum([len(t.as_py() or "") for t in batch.column(1)])
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BLOCK_CHARS, "right")))
                ids = encoder.encode([t.as_py() or "" for t in texts.slice(a, b - a)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary())], ["doc_id", "ids"])
                a = b

    return documents.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids as :func:`encode` gives them) with text, as the processor decodes the ids; null ids: empty."""
    with open(path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(shared.value)
        for batch in batches:
            texts = [processor.decode(np.frombuffer(x.as_py() or b"", np.uint32).tolist()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def encode_digests(documents: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens with the begin and end ids, and the hashes of the ids and of the text decoded from them."""
    rows = decode(encode(documents, path), path)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))

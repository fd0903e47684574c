"""Byte-level BPE encoding and decoding.

A text is split by the vocabulary's pattern. Each match is encoded by itself: an Aho-Corasick
automaton over the vocabulary (bytes mapped to Latin-1 characters) gives the longest token at every
position, and the encoder takes longest matches and backs off to the next shorter prefix token
whenever a token is not compatible with the one before it. Two adjacent tokens are compatible when
no merge of lower rank crosses their border; a sequence of pairwise compatible tokens that spells
the text is what rank-ordered merging yields, so the result is exact. A position that was left once
is never entered again, so the work is linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE = 400_000  # distinct matches remembered by a worker; the memory is emptied when it is full
PAIRS = 400_000  # remembered compatibilities, emptied likewise
CACHED_LENGTH = 64  # longer matches are encoded each time

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a rank file (base64 token, space, rank on each line)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def split_tokens(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two parts that each token's last merge joined; -1 for tokens that no merge makes.

    Found by merging a token's bytes in rank order with its own rank left out.
    """
    rank = {t: i for i, t in enumerate(tokens)}
    left, right = np.full(len(tokens), -1, np.int32), np.full(len(tokens), -1, np.int32)
    for i, t in enumerate(tokens):
        if len(t) < 2:
            continue
        parts = [t[k : k + 1] for k in range(len(t))]
        while len(parts) > 2:
            best, at = i, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1], i)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            left[i], right[i] = rank[parts[0]], rank[parts[1]]
    return left, right


class Encoder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, tokens: list[bytes], left: np.ndarray, right: np.ndarray, pattern: str = public_tokenizers.PATTERN):
        self.tokens, self.left, self.right = tokens, left.tolist(), right.tolist()
        self.sizes = [len(t) for t in tokens]
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        ids = {}
        for i, t in enumerate(tokens):
            ids[t] = i
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.joined = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if a >= 0}
        self.ids = ids
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.spelling = [str(i) for i in range(len(tokens))]

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        found = self.shorter.get(token)
        if found is None:
            t, found = self.tokens[token], -1
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in self.ids:
                    found = self.ids[t[:n]]
                    break
            self.shorter[token] = found
        return found

    def _edge(self, token: int, side: list[int]) -> list[tuple[int, int]]:
        """(part, rank at which it is absorbed) along one edge of a token's merge tree."""
        out, up = [], len(self.tokens)
        while token >= 0:
            out.append((token, up))
            up, token = token, side[token]
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens ``a`` and ``b`` alone.

        A merge across the border is made if both its parts still exist at its rank. At equal rank
        the leftmost merge goes first, so it loses to one inside ``a`` and wins over one inside ``b``.
        """
        key = (a, b)
        found = self.fits.get(key)
        if found is None:
            found, right_edge = True, self._edge(b, self.left)
            for p, p_up in self._edge(a, self.right):
                for q, q_up in right_edge:
                    m = self.joined.get((p, q))
                    if m is not None and m < p_up and m <= q_up:
                        found = False
                        break
                if not found:
                    break
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            self.fits[key] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, sizes = len(piece), self.sizes
        longest = [-1] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            at = end - sizes[i] + 1
            if longest[at] < 0 or sizes[longest[at]] < sizes[i]:
                longest[at] = i
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            if token < 0:  # no token fits here: leave this position for good
                dead[at] = 1
                token = out.pop()
                at -= sizes[token]
                token = self.next_shorter(token)
                continue
            end = at + sizes[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            else:
                token = self.next_shorter(token)

    def _miss(self, match: str) -> tuple[int, ...]:
        ids = tuple(self.encode_piece(match.encode()))
        if len(match) <= CACHED_LENGTH:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[match] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, out = self.cache.get, []
        for match in self.pattern.findall(text):
            out += get(match) or self._miss(match)
        return out

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def digests(encoder: Encoder, text: str | None) -> tuple[int, str, str]:
    """Token count, hash of the ids and hash of the decoded bytes of one text."""
    ids = encoder.encode(text or "")
    spelled = " ".join(map(encoder.spelling.__getitem__, ids))
    return len(ids), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()


def _broadcast_vocabulary(df: DataFrame, path: str):
    """The vocabulary and its merge splits: a fixed size, so safe to broadcast."""
    tokens = load_ranks(path)
    return df.sparkSession.sparkContext.broadcast((tokens, *split_tokens(tokens)))


def encode_digests(documents: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no tokens and the hashes of the empty string. Repeated rows give
    repeated results; other columns are not read. No shuffle; a task's memory is one Arrow batch
    and the bounded memories of the encoder.
    """
    shared = _broadcast_vocabulary(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            rows = [digests(encoder, t.as_py()) for t in batch.column(1)]
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, SCHEMA)


def encode_ids(documents: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id and its token ids (an empty list for a null text)."""
    shared = _broadcast_vocabulary(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            ids = [encoder.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id and the bytes that its ids spell (null ids: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            back = [b"".join([tokens[i] for i in row.as_py() or ()]) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], ["doc_id", "bytes"])

    return encoded.selectExpr("CAST(doc_id AS BIGINT) doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")

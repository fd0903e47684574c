"""Toxicity by the nearest labelled examples.

Documents and labelled examples are TF-IDF vectors over all their words: (1 + ln n) * idf * rf. The
document frequencies behind idf count all documents; rf = log2(2 + toxic / max(1, clean)) is the relevance
frequency of supervised term weighting, from the examples that hold the word, and 1 for any other word.

The examples stand in blocks of similar ones, in an inverted index with block maxima. A query first
traverses the postings of its rarer words whole; the best sum in a block and the block's largest weight of
each common word bound every cosine in it. A few blocks of the highest bounds are scored, and then only
those whose bound reaches the k-th best cosine so far; no neighbour is lost. What can be among the nearest
in single precision is computed again in double precision.

The neighbours vote with the square of their cosine against a prior of the base rate, and a logistic curve
fitted to leave-one-out votes turns the vote into a calibrated score. The neighbours are the evidence.

Words that neither an example nor a large share of the documents holds lower a cosine only by the length
of the vector. Their frequencies are too many for one task, so they are joined to the documents' words.
Words are known by a hash of 64 bits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import materialize, release

MAX_EXAMPLES = 16_384  # labelled documents used: the bound of the sample, those with the smallest hashed ids
MAX_WORDS = 40_000_000  # distinct words of the examples, summed over them: the sample ends before it has more
NEIGHBOURS, PRIOR = 15, 0.5
BLOCK = 64  # examples of a block
COMMON = 512  # words with the longest postings, which are skipped by blocks
SEEDS = 4  # blocks that are scored first, for a threshold
GROUP = 128  # documents that are compared at once
SLACK = 1e-4  # above the rounding errors of a cosine in single precision
WIDE = 1_000  # a word of more than one in so many documents is known to every task, so no join has a hot word
FLUSH = 200_000  # words that a task counts before it hands the counts on
PART = 1 << 18  # postings that are handled at once while an index is made: a bound of what is held beside it
MAX_CALIBRATION = 4_096  # examples whose votes the curve is fitted to: the bound of that sample, every k-th
FEW_TOXIC = 1_000_000  # keys of rejected rows (16 bytes each) up to which they are broadcast; more are joined by a shuffle
WORD = re.compile(r"\w+")
APART = bytes(b if b > 127 or chr(b).isalnum() or b == ord("_") else 32 for b in range(256))  # a space for each ASCII character of no word
POSTING = np.dtype([("row", np.int32), ("weight", np.float32)])
DAMPED = 1 + np.log(np.maximum(1, np.arange(4_096)))  # 1 + ln n of the usual counts


def held_out() -> Column:
    """Rows that are never learnt from: crc32 of the id as text is a multiple of 5. False for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _pieces(text: str | None) -> list[bytes]:
    """The lower-cased text in UTF-8, cut at the characters of ASCII that are of no word."""
    return (text or "").lower().encode().translate(APART).split()


def _uncut(pieces, text: str | None) -> list[str]:
    """The pieces that are not words: some of their characters beyond ASCII are of no word, or they hold a ``_`` beside such ones."""
    mixed = [] if not text or text.isascii() else [p for p in pieces if not p.isascii()]
    return [p for p in b" ".join(mixed).decode().split(" ") if not p.isalnum()] if mixed else []


def words_of(text: str | None) -> Counter:
    """The matches of ``WORD`` in the lower-cased text, in UTF-8, and how often each is there."""
    found = Counter(_pieces(text))
    for piece in _uncut(found, text):
        n = found.pop(piece.encode())
        for w in WORD.findall(piece):
            found[w.encode()] += n
    return found


def distinct_words(text: str | None) -> set[bytes]:
    """The same words, without a count."""
    found = set(_pieces(text))
    for piece in _uncut(found, text):
        found.remove(piece.encode())
        found.update(w.encode() for w in WORD.findall(piece))
    return found


def hashed(found: Counter) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes in ascending order, and their counts."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = np.fromiter(found.values(), np.int64, len(found))
    order = np.argsort(h)
    return h[order], n[order]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all runs, one run after another."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out))
    return out


def _runs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The parts of x from each start to its end, one after another."""
    return np.concatenate([x[:0], *(x[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))])


def damped(n: np.ndarray) -> np.ndarray:
    """1 + ln n of each count."""
    out = DAMPED.take(n, mode="clip")
    many = n >= len(DAMPED)
    if many.any():
        out[many] = 1 + np.log(n[many], dtype=np.float64)
    return out


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor().compress(x.tobytes())


def _unpacked(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def halved(x: np.ndarray, rows: np.ndarray, block: int) -> list[np.ndarray]:
    """``rows`` of x in blocks of similar ones: cut in two along the direction of greatest spread, again and again."""
    if len(rows) <= block:
        return [rows]
    own = x[rows] - x[rows].mean(0)
    direction = 1 + np.arange(x.shape[1], dtype=x.dtype) / x.shape[1]
    for _ in range(8):
        direction = own.T @ (own @ direction)
        direction /= np.linalg.norm(direction) or 1.0
    order = rows[np.argsort(own @ direction, kind="stable")]
    middle = -(-len(rows) // (2 * block)) * block  # all blocks but the last are full
    return halved(x, order[:middle], block) + halved(x, order[middle:], block)


class Index:
    """All examples' vectors, by example and by term, in blocks. An example without words is in it, but near to nothing.

    terms: ascending hashes; factor: idf times rf of each; examples: (id, label, terms' positions, counts).
    """

    def __init__(self, terms: np.ndarray, factor: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.terms, self.factor, self.ready = terms, factor, False
        self._fill(examples)
        common = np.argsort(-self._holders(), kind="stable")[:256]
        column = np.full(len(terms), -1)
        column[common] = np.arange(len(common))
        x = np.zeros((len(examples), len(common)), np.float32)
        for row, term, weight in self._parts():
            often = column[term] >= 0
            x[row[often], column[term[often]]] = weight[often]
        if examples and len(common):
            self._fill([examples[i] for i in np.concatenate(halved(x, np.arange(len(examples)), BLOCK))])

    def _fill(self, examples: list) -> None:
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.labels = np.array([e[1] for e in examples], np.float64)
        self.sizes = np.array([len(e[2]) for e in examples], np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes))
        self.term = np.concatenate([np.zeros(0, np.int32), *[np.asarray(e[2], np.int32) for e in examples]])
        n = np.concatenate([np.zeros(0, np.uint16), *[e[3] for e in examples]])
        self.n = n.astype(np.uint16) if not len(n) or n.max() < 1 << 16 else n
        self.lengths = np.ones(len(examples))
        squares = np.zeros(len(examples))
        for row, _, weight in self._parts():
            squares += np.bincount(row, weight * weight, len(examples))
        self.lengths = np.where(squares > 0, np.sqrt(squares), 1.0)

    def _parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, terms and weights of the postings, ``PART`` of them or one example at a time, so that little is held beside the index."""
        a = 0
        while a < len(self.sizes):
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + PART, "right")) - 1)
            part = slice(self.starts[a], self.starts[b])
            row = np.repeat(np.arange(a, b), self.sizes[a:b])
            yield row, self.term[part], self.weights(self.term[part], self.n[part]) / self.lengths[row]
            a = b

    def _holders(self) -> np.ndarray:
        """How many examples hold each term; counted in parts, as a count makes a wider copy of what it counts."""
        out = np.zeros(len(self.terms), np.int64)
        for a in range(0, len(self.term), PART):
            out += np.bincount(self.term[a : a + PART], minlength=len(out))
        return out

    def __getstate__(self) -> dict:
        """What is broadcast: postings by example, as compressed differences in parts; the rest is made anew in each process."""
        own = {k: getattr(self, k) for k in ("terms", "factor", "ids", "labels", "sizes", "starts", "lengths")}
        cuts = range(0, len(self.term), PART)
        return own | {"term": [_packed(np.diff(self.term[a : a + PART], prepend=np.int32(0))) for a in cuts], "n": (self.n.dtype.str, [_packed(self.n[a : a + PART]) for a in cuts])}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        kind, counts = state["n"]
        self.term, self.n, self.ready = np.empty(self.starts[-1], np.int32), np.empty(self.starts[-1], kind), False
        for a, term, n in zip(range(0, len(self.term), PART), state["term"], counts, strict=True):
            np.cumsum(_unpacked(term, np.int32), dtype=np.int32, out=self.term[a : a + PART])
            self.n[a : a + PART] = _unpacked(n, kind)

    def open(self) -> None:
        """Make postings by term, dense blocks of the common words, and block maxima."""
        holders = self._holders()
        common = np.argsort(-holders, kind="stable")[:COMMON]
        self.column = np.full(len(self.terms), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.blocks = -(-len(self.ids) // BLOCK)
        self.dense = np.zeros((self.blocks, len(common), BLOCK), np.float32)
        holders[common] = 0
        self.first = np.append(0, np.cumsum(holders))
        self.posting = np.zeros(self.first[-1], POSTING)  # row and weight are fetched together
        self.row, self.weight = self.posting["row"], self.posting["weight"]
        free = self.first[:-1].copy()  # where each term's next posting goes
        for row, term, weight in self._parts():
            column = self.column[term]
            often = column >= 0
            self.dense[row[often] // BLOCK, column[often], row[often] % BLOCK] = weight[often]
            row, term, weight = row[~often], term[~often], weight[~often]
            order = np.argsort(term, kind="stable")
            held, sizes = np.unique(term[order], return_counts=True)
            at = _spans(free[held], sizes)
            self.row[at], self.weight[at] = row[order], weight[order]
            free[held] += sizes
        self.most = np.ascontiguousarray(self.dense.max(2).T) if self.blocks else np.zeros((len(common), 0), np.float32)
        self.scratch, self.asked = np.zeros(len(self.terms)), np.zeros(len(self.terms), bool)
        self.ready = True

    def weights(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Weights of terms by their counts, not yet divided by the vector's length."""
        return damped(n) * self.factor[at]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions of hashes among the terms, -1 for unknown ones."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.searchsorted(self.terms, h).clip(max=len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def raw(self, found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text's hashes and counts: terms and weights of the known words, not yet divided by the vector's
        length; hashes and counts of the others. Words are looked up in the order of their hashes, for all texts at once."""
        every = np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in found]])
        order = np.argsort(every)
        places = np.empty(len(every), np.int64)
        places[order] = self.find(every[order])
        end = 0
        for h, n in found:
            at, end = places[end : end + len(h)], end + len(h)
            known = at >= 0
            yield at[known], self.weights(at[known], n[known]), h[~known], n[~known]

    def unit(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[row], self.starts[row + 1])
        return self.term[part], self.weights(self.term[part], self.n[part]) / self.lengths[row]

    def _rough(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cosines in single precision of each query with the examples of the blocks that it needs, else minus
        infinity; and a threshold that its k nearest reach."""
        width = self.blocks * BLOCK
        rare = np.zeros((len(queries), width), np.float32)
        q = np.zeros((len(queries), self.dense.shape[1]), np.float32)
        for i, (at, weight) in enumerate(queries):
            column, weight = self.column[at], weight.astype(np.float32)
            often = column >= 0
            q[i, column[often]] = weight[often]
            at, weight = at[~often], weight[~often]
            sizes = self.first[at + 1] - self.first[at]
            posted = _spans(self.first[at], sizes)
            if len(posted):
                # every position is valid; "clip" spares the copy that take makes for the checks of "raise"
                posted = self.posting.view(np.int64).take(posted, mode="clip").view(POSTING)
                products = np.repeat(weight, sizes)
                products *= posted["weight"]
                rare[i] = np.bincount(posted["row"], products, width)
            if skip[i] is not None:
                rare[i, skip[i]] = -np.inf
        rare = rare.reshape(len(queries), self.blocks, BLOCK)
        bound = rare.max(2) + q @ self.most
        out = np.full_like(rare, -np.inf)

        def score(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)):
                own = np.flatnonzero(wanted[:, b])
                out[own, b] = rare[own, b] + q[own] @ self.dense[b]

        first = np.argsort(-bound, 1, kind="stable")[:, :SEEDS]
        seeds = np.zeros(bound.shape, bool)
        np.put_along_axis(seeds, first, True, 1)
        score(seeds)
        best = np.take_along_axis(out, first[:, :, None], 1).reshape(len(queries), -1)
        least = np.maximum(np.partition(best, -k, 1)[:, -k], 0) if best.shape[1] > k else np.zeros(len(queries))
        score(~seeds & (bound >= least[:, None] - SLACK) & (bound > 0))
        return out.reshape(len(queries), width), least

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each unit vector, rows and cosines of the k nearest examples with a cosine over 0, ties by id."""
        if not len(self.ids) or not queries:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        if not self.ready:
            self.open()
        found, q, asked = [], self.scratch, self.asked
        for (at, weight), own, least in zip(queries, *self._rough(queries, k, skip or [None] * len(queries)), strict=True):
            rows = np.flatnonzero(own >= max(np.float32(least - SLACK), np.nextafter(np.float32(0), np.float32(1))))
            if len(rows) > k:
                rough = own[rows]
                rows = rows[rough >= np.partition(rough, -k)[-k] - SLACK]
            starts, sizes = self.starts[rows], self.sizes[rows]
            q[at] = weight * self.factor[at]  # the factors of both vectors
            asked[at] = True
            term, n = _runs(self.term, starts, starts + sizes), _runs(self.n, starts, starts + sizes)
            shared = np.flatnonzero(asked.take(term, mode="clip"))  # the others' products are 0
            products = np.zeros(len(term))
            products[shared] = q[term[shared]] * damped(n[shared])
            q[at], asked[at] = 0, False
            cosines = np.add.reduceat(products, np.cumsum(sizes) - sizes) / self.lengths[rows] if len(rows) else np.zeros(0)
            best = np.lexsort((self.ids[rows], -cosines.round(12)))[:k]
            found.append((rows[best], cosines[best]))
        return found


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def curve(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from votes to labels (Newton steps, a weak pull to the identity)."""
    x = _logit(votes)
    theta, pull = np.array([1.0, 0.0]), np.array([1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(theta[0] * x + theta[1])))
        g = np.array([((p - y) * x).sum(), (p - y).sum()]) + pull * (theta - [1.0, 0.0])
        q = p * (1 - p)
        h = np.array([[(q * x * x).sum(), (q * x).sum()], [(q * x).sum(), q.sum()]]) + np.diag(pull)
        step = np.linalg.solve(h, g)
        theta = theta - step / max(1.0, np.abs(step).max())
    return max(float(theta[0]), 1e-3), float(theta[1])


def word_counts(documents: DataFrame) -> DataFrame:
    """h, n: the documents that hold each word, by its hash, and under a null hash all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        rows = 0

        def handed() -> pa.RecordBatch:
            h, times = hashed(n)
            return pa.RecordBatch.from_arrays([pa.array([*h.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(times, rows))], ["h", "n"])

        for batch in batches:
            for text in batch.column(0):
                n.update(distinct_words(text.as_py()))
                rows += 1
                if len(n) > FLUSH:
                    yield handed()
                    n.clear()
                    rows = 0
        yield handed()

    return documents.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _all_documents(counts: DataFrame) -> int:
    return counts.filter("h IS NULL").agg(F.sum("n")).first()[0] or 0


def example_words(documents: DataFrame, labels: DataFrame, max_examples: int) -> DataFrame:
    """doc_id, toxic, size, words, times: the labelled documents used, with their words' hashes and counts.

    Null labels and null ids teach nothing; an id is toxic if any of its rows says so. Of an id's rows
    with different texts the smallest text counts.
    """
    ids = labels.select(F.col("doc_id").cast("long"), "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    ids = ids.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)  # its size is bounded, so it may be broadcast
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [hashed(words_of(text.as_py())) for text in batch.column(2)]
            columns = [pa.array([len(h) for h, _ in each], pa.int64()), pa.array([_packed(h) for h, _ in each], pa.binary()), pa.array([_packed(n.astype(np.int32)) for _, n in each], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "toxic", "size", "words", "times"])

    each = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "toxic", "text")
    return each.mapInArrow(words, "doc_id long, toxic int, size long, words binary, times binary")


def fit(documents: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, counts: DataFrame | None = None, max_words: int = MAX_WORDS) -> Index:
    """The index of labelled examples.

    ``counts`` is the written table of :func:`word_counts`. The examples' hashed words are gathered on the
    driver: of at most max_examples documents, in the order of their hashed ids, with at most max_words words.
    """
    counts = materialize(word_counts(documents), "words") if counts is None else counts
    all_docs = _all_documents(counts)
    each = materialize(example_words(documents, labels, max_examples), "examples")
    sizes = each.select("doc_id", "size").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()  # max_examples rows at most
    fitting = sizes.column("doc_id").to_numpy()[np.cumsum(sizes.column("size").to_numpy()) <= max_words]
    used = each if len(fitting) == sizes.num_rows else each.filter(F.col("doc_id").isin(fitting.tolist()))
    own, some, held = np.zeros(0, np.uint64), [], 0
    for r in used.select("words", "size").toLocalIterator():
        some.append(_unpacked(r["words"], np.uint64))
        held += r["size"]
        if held > 4 * FLUSH:
            own, some, held = np.unique(np.concatenate([own, *some])), [], 0
    own = np.unique(np.concatenate([own, *some]))
    shared = documents.sparkSession.sparkContext.broadcast(own)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            h, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            held = n * WIDE > all_docs
            if len(own):
                held |= own[np.searchsorted(own, h).clip(max=len(own) - 1)] == h
            yield batch.filter(pa.array(held))

    df = counts.filter("h IS NOT NULL").mapInArrow(known, "h long, n long").toArrow()
    shared.unpersist()
    h, n = df.column("h").to_numpy().view(np.uint64), df.column("n").to_numpy()
    order = np.argsort(h)
    terms, idf = h[order], np.log((1 + all_docs) / (1 + n[order])) + 1
    # read again, so that the hashes are never all held
    examples, holders = [], np.zeros((2, len(terms)), np.int64)
    for r in used.select("doc_id", "toxic", "words", "times").toLocalIterator():
        at, times = np.searchsorted(terms, _unpacked(r["words"], np.uint64)).astype(np.int32), _unpacked(r["times"], np.int32)
        holders[r["toxic"], at] += 1
        examples.append((r["doc_id"], r["toxic"], at, times.astype(np.uint16) if not len(times) or times.max() < 1 << 16 else times))
    release(each)
    examples.sort(key=lambda e: e[0])
    clean, toxic = holders
    return Index(terms, idf * np.log2(2 + toxic / np.maximum(1, clean)), examples)


def base_rate(index: Index) -> float:
    """The smoothed share of toxic examples; 0 without any."""
    return (index.labels.sum() + 0.5) / (len(index.labels) + 1) if len(index.labels) else 0.0


def calibrated(spark, shared, base: float, labels: np.ndarray) -> tuple[float, float]:
    """The curve over each example's vote without itself; the votes are taken in Spark tasks."""
    step = max(1, -(-len(labels) // MAX_CALIBRATION))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        if not index.ready:
            index.open()
        for batch in batches:
            rows, votes = batch.column(0).to_pylist(), []
            for i in range(0, len(rows), GROUP):
                some = rows[i : i + GROUP]
                for near, cosines in index.search([index.unit(r) for r in some], NEIGHBOURS, some):
                    w = cosines * cosines
                    votes.append(float((w @ index.labels[near] + PRIOR * base) / (w.sum() + PRIOR)))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(votes)], ["row", "vote"])

    rows = spark.range(0, len(labels), step, numPartitions=6).mapInArrow(run, "row long, vote double").toArrow()
    return curve(rows.column("vote").to_numpy(), labels[rows.column("row").to_numpy()])


KEYS = ["_task", "_row"]


def _neighbours(documents: DataFrame, labels: DataFrame, max_examples: int, own: list[str]) -> tuple[DataFrame, DataFrame]:
    """What the nearest examples say of every document, and (_task, _row, score); both read written tables.

    The order of the neighbours does not depend on the length of a document's vector, so only the lengths
    are joined afterwards.
    """
    spark = documents.sparkSession
    counts = materialize(word_counts(documents), "words")
    all_docs = _all_documents(counts)
    index = fit(documents, labels, max_examples, counts)
    base, marks = base_rate(index), index.labels
    shared = spark.sparkContext.broadcast(index)
    del index
    slope, shift = calibrated(spark, shared, base, marks) if len(marks) else (1.0, 0.0)
    # the text comes first, by itself or inside the row's own columns
    rows = documents.select((F.struct(*own) if own else F.col("text")).alias("_own"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"))
    place = own.index("text") if own else None
    inner = "_task long, _row long, _square double, _w double, _toxic double, evidence array<long>, _h array<long>, _n array<int>"
    schema = spark.createDataFrame([], inner).schema
    for f in (rows if own else rows.drop("_own")).schema.fields:
        schema = schema.add(f.name, f.dataType, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        task, done = int(np.random.default_rng().integers(2**63)), 0  # names the rows of this task; they are written once
        for whole in batches:
            for start in range(0, whole.num_rows, GROUP):
                batch = whole.slice(start, GROUP)
                vectors, squares, others, times = [], [], [], []
                texts = batch.column(0) if place is None else batch.column(0).field(place)
                for at, weight, unknown, n in index.raw([hashed(words_of(text.as_py())) for text in texts]):
                    square = float((weight * weight).sum())
                    vectors.append((at, weight / (np.sqrt(square) or 1.0)))
                    squares.append(square)
                    others.append(unknown.view(np.int64))
                    times.append(n.astype(np.int32))
                near = index.search(vectors, NEIGHBOURS)
                # sums of squared products, with the document's vector still at its own length
                sums = [s * float(c @ c) for s, (_, c) in zip(squares, near, strict=True)]
                toxic = [s * float((c * c) @ index.labels[r]) for s, (r, c) in zip(squares, near, strict=True)]
                n = batch.num_rows
                ends = pa.array(np.append(0, np.cumsum([len(x) for x in others])).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (others, times)]
                named = [pa.array(np.full(n, task)), pa.array(np.arange(done, done + n)), *(pa.array(x, pa.float64()) for x in (squares, sums, toxic)), pa.array([index.ids[r].tolist() for r, _ in near], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*named, *lists, *batch.columns[place is None :]], schema.names)
                done += n

    near = materialize(rows.mapInArrow(run, schema), "neighbours")
    rest = near.select(*KEYS, F.explode(F.arrays_zip("_h", "_n")).alias("o")).select(*KEYS, F.col("o._h").alias("h"), F.col("o._n").alias("_n"))
    rest = rest.join(counts, "h").groupBy(*KEYS).agg(F.sum(F.expr(f"pow((1 + ln(_n)) * (ln((1 + {all_docs}D) / (1 + n)) + 1), 2)")).alias("_rest"))
    scored = near.select(*KEYS, "_square", "_w", "_toxic").join(rest, KEYS, "left").withColumn("_all", F.col("_square") + F.coalesce("_rest", F.lit(0.0)))
    share = F.when(F.col("_all") > 0, 1 / F.col("_all")).otherwise(0.0)
    vote = (F.col("_toxic") * share + PRIOR * base) / (F.col("_w") * share + PRIOR)
    vote = F.least(F.greatest(vote, F.lit(1e-6)), F.lit(1 - 1e-6))
    return near, scored.select(*KEYS, (1 / (1 + F.exp(-(slope * F.ln(vote / (1 - vote)) + shift)))).alias("score"))


def toxicity(documents: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence.

    evidence lists the ids of the nearest examples, nearest first. Null and empty texts, and texts
    without a word of an example, take the calibrated base rate. Without labels of both kinds all scores are
    near the smoothed base rate. Without any usable labelled document nothing can be learnt: scores are near 0
    and nothing is predicted toxic. Repeated rows give repeated results. Labels, language, source and id
    are no inputs of a score. The index is bounded and broadcast; extra columns are not read.
    """
    near, scores = _neighbours(documents, labels, max_examples, [])
    out = near.select(*KEYS, "doc_id", "held_out", "evidence").join(scores, KEYS)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, with their own columns.

    Only the keys of the rejected rows are joined back to the rows, so no text is shuffled while they are few.
    """
    near, scores = _neighbours(documents, labels, MAX_EXAMPLES, documents.columns)
    toxic = materialize(scores.filter("score >= 0.5").select(*KEYS), "toxic")
    toxic = F.broadcast(toxic) if toxic.count() <= FEW_TOXIC else toxic
    return near.select(*KEYS, "_own").join(toxic, KEYS, "left_anti").select("_own.*")

"""Ranked lexical search over a tiered index.

The documents are cut into terms once, and each is written as its vector: the terms that the queries ask
for, with how often they occur. From the vectors each term's postings are dealt into tiers by impact: the
first holds its few postings of highest impact, the next one more, and the vectors themselves are the last.
For each tier and term the index keeps the highest impact that is still left below it.

A query is first scored on the first tier alone. A document that this has not seen scores at most the
sum of what is left of the query's terms. If that is below the twentieth score found, no such document can
come in; the documents whose bounds reach the twentieth score are then scored exactly from their vectors. A query
without this proof falls through to the next tier, and at the end to the vectors of all documents, of which each
task keeps its own best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm.common import materialize

BEST = 20
TIERS = (256, 4096)  # postings of a term in the first tier, and in the first two
LEVEL = 1 << 14  # impacts are told apart by levels of this width when postings are dealt into tiers
BLOCK_PAIRS = 1 << 18  # (query, term) pairs that are worked on together, so what is broadcast has a bound; a longer query is a block by itself
SLICE = 2_000_000  # numbers that a task adds up at once

# Bytes that are not in a term become blanks, A to Z become a to z; bytes from 0x80 belong to characters beyond ASCII.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text given as UTF-8."""
    return text.translate(_FOLD).split()


@dataclass
class Queries:
    """A block of queries: their ids, and for each term of the block the queries that ask for it and how often."""

    ids: list[int | None]
    terms: dict[bytes, int]
    starts: np.ndarray  # of a term's queries in ``query`` and ``times``
    query: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int | None, bytes, int, int]]) -> Queries:
        """From (item_id, term, query number, occurrences)."""
        numbers: dict[int, int] = {}
        ids: list[int | None] = []
        terms: dict[bytes, int] = {}
        pairs = []
        for item, term, query, times in rows:
            if query not in numbers:
                numbers[query] = len(ids)
                ids.append(item)
            pairs.append((terms.setdefault(term, len(terms)), numbers[query], times))
        found = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        return Queries(ids, terms, np.searchsorted(found[:, 0], np.arange(len(terms) + 1)), found[:, 1], found[:, 2])


def _blocks(items: DataFrame, pairs: int) -> Iterator[Queries]:
    """The queries in blocks of about ``pairs`` (query, term) pairs. Rows equal in item_id and text are one query; a null or empty text is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, terms = [], [], []
            for item, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = terms_of(text.encode())
                ids += [item] * len(own)
                names += [name] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(terms, pa.binary())], ["item_id", "query", "term"])

    rows = items.select(F.col("item_id").cast("long"), F.xxhash64("item_id", "text").alias("query"), "text").filter("text IS NOT NULL").distinct()
    rows = materialize(rows.mapInArrow(run, "item_id long, query long, term binary").groupBy("item_id", "query", "term").agg(F.count("*").alias("times")), "queries")
    blocks = max(1, math.ceil(rows.count() / pairs))
    for b in range(blocks):
        one = rows.filter(F.pmod(F.xxhash64("query", F.lit("block")), F.lit(blocks)) == b).select("item_id", "term", "query", "times").collect()
        if one:
            yield Queries.of([(r[0], bytes(r[1]), r[2], r[3]) for r in sorted(one, key=lambda r: (r[2], r[1]))])


def vectors(documents: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """One row per document: row (its number here), doc_id, n (all its terms) and the known terms with their occurrences, tfs. A null text has none."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = shared.value.get, TaskContext.get().partitionId() << 33
        for batch in batches:
            n, ids, counts = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py() or b"")
                found = np.array([t for t in map(known, words) if t is not None], np.int32)
                own, times = np.unique(found, return_counts=True)
                n.append(len(words))
                ids.append(own)
                counts.append(times)
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            nested = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(np.int32) if x else [], pa.int32())) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), batch.column(0), pa.array(n, pa.int64()), *nested], ["row", "doc_id", "n", "terms", "tfs"])
            row += len(n)

    return documents.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "row long, doc_id long, n long, terms array<int>, tfs array<int>")


@dataclass
class Index:
    vectors: DataFrame  # row, doc_id, n, terms, tfs
    postings: DataFrame  # tier, term, row, impact: all tiers but the last, a folder each
    weights: np.ndarray  # of each term
    left: np.ndarray  # left[j][term]: the highest impact below tier j
    documents: int  # with a term
    words: int  # of all documents


def _posted(vectors_: DataFrame, documents: int, words: int) -> DataFrame:
    m = F.expr(f"75 + (25 * n * {documents}L) div {words}L")
    rows = vectors_.select("row", m.alias("m"), F.inline(F.arrays_zip("terms", "tfs")))
    return rows.select(F.col("terms").alias("term"), "row", F.expr("(1000000000L * tfs) div (1000L * tfs + 12 * m)").alias("impact"))


def build(documents: DataFrame, terms: dict[bytes, int], tiers: tuple[int, ...] = TIERS) -> Index | None:
    """The index of ``documents`` on ``terms``; None if no document has any term at all."""
    spark = documents.sparkSession
    own = materialize(vectors(documents, terms), "vectors")
    all_ = own.agg(F.sum(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    if not all_[1]:
        return None
    posted = _posted(own, *all_)
    # a row for each term and level: at most 62 for each known term
    levels = posted.groupBy("term", F.expr(f"impact div {LEVEL}").alias("level")).agg(F.count("*").alias("k"), F.max("impact").alias("top"))
    down = Window.partitionBy("term").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = levels.withColumn("so_far", F.sum("k").over(down))
    outside = [F.max(F.when(F.col("so_far") > size, F.struct("level", "top"))).alias(f"t{j}") for j, size in enumerate(tiers)]  # the highest level that a tier has no room for
    frequent, left, floors = np.zeros(len(terms), np.int64), np.zeros((len(tiers), len(terms)), np.int64), []
    for r in levels.groupBy("term").agg(F.sum("k").alias("df"), *outside).collect():  # a row for each known term
        frequent[r["term"]] = r["df"]
        for j in range(len(tiers)):
            left[j][r["term"]] = r[f"t{j}"]["top"] if r[f"t{j}"] else 0
        floors.append((r["term"], *[(r[f"t{j}"]["level"] if r[f"t{j}"] else -1) for j in range(len(tiers))]))
    schema = "term int, " + ", ".join(f"f{j} long" for j in range(len(tiers)))
    known = posted.join(F.broadcast(spark.createDataFrame(floors, schema)), "term")
    tier = F.coalesce(*[F.when(F.expr(f"impact div {LEVEL}") > F.col(f"f{j}"), j) for j in range(len(tiers))])
    postings = materialize(known.select(tier.alias("tier"), "term", "row", "impact").filter("tier IS NOT NULL"), "postings", by="tier")
    weights = np.array([math.floor(1000 * math.log((2 * all_[0] + 2) / (2 * int(f) + 1))) for f in frequent], np.int64)
    return Index(own, postings, weights, left, *all_)


def _scored(rows: DataFrame, index: Index, queries: Queries, everywhere: list[int], best: int) -> DataFrame:
    """item, row, doc_id, score above 0: exact scores from vectors, the ``best`` of each task for each query.

    Queries are those of ``everywhere`` and, where ``rows`` has a column items, those listed there for a row.
    """
    listed = "items" in rows.columns
    shared = rows.sparkSession.sparkContext.broadcast((queries.starts, queries.query, queries.times, index.weights, np.isin(np.arange(len(queries.ids)), everywhere)))
    documents, words = index.documents, index.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, query, times, weights, free = shared.value
        n_queries, held = len(free), {}
        for batch in batches:
            row, doc, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "_doc", "n"))
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            terms, tfs = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
            sizes = np.array([len(x) for x in batch.column("terms")], np.int64)
            of = np.repeat(np.arange(len(row)), sizes)
            impact = 1_000_000_000 * tfs // (1000 * tfs + 12 * (75 + 25 * n[of] * documents // words))
            asked = starts[terms + 1] - starts[terms]
            work = np.concatenate([[0], np.cumsum(np.bincount(of, asked, len(row)) + n_queries)])
            a = 0
            while a < len(row):
                b = max(a + 1, int(np.searchsorted(work, work[a] + SLICE, "right")) - 1)
                lo, hi = np.searchsorted(of, [a, b])
                k = asked[lo:hi]
                at = np.repeat(starts[terms[lo:hi]] - np.concatenate([[0], np.cumsum(k)[:-1]]) if hi > lo else np.empty(0, np.int64), k) + np.arange(k.sum())
                score = np.zeros((b - a) * n_queries, np.int64)
                np.add.at(score, np.repeat((of[lo:hi] - a) * n_queries, k) + query[at], np.repeat(weights[terms[lo:hi]] * impact[lo:hi], k) * times[at])
                score = score.reshape(b - a, n_queries)
                wanted = np.broadcast_to(free, score.shape)
                if listed:
                    wanted = wanted.copy()
                    for i, items in enumerate(batch.column("items").slice(a, b - a)):
                        wanted[i, items.as_py() or []] = True
                score = np.where(wanted, score, 0)
                for q in np.flatnonzero(score.max(0)):
                    found = np.flatnonzero(score[:, q])
                    new = np.stack([-score[found, q], known[a:b][found], doc[a:b][found], row[a:b][found]], 1)
                    every = np.concatenate([held[q], new]) if q in held else new
                    if len(every) > best:
                        every = every[np.lexsort(every.T[::-1])[:best]]
                    held[q] = every
                a = b
        if held:
            q = np.repeat(list(held), [len(x) for x in held.values()])
            rows_ = np.concatenate(list(held.values()))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(rows_[:, 3]), pa.array(rows_[:, 2], mask=rows_[:, 1] == 0), pa.array(-rows_[:, 0])], ["item", "row", "doc_id", "score"])

    return rows.withColumn("_doc", F.coalesce("doc_id", F.lit(0).cast("long"))).mapInArrow(run, "item int, row long, doc_id long, score long")


def search(index: Index, queries: Queries, best: int = BEST) -> DataFrame:
    """item (number of the query), rank, doc_id, score: the ``best`` documents of each query with a score above 0, the smaller doc_id first at a tie."""
    spark = index.vectors.sparkSession
    open_, sure = np.arange(len(queries.ids)), []
    term = np.repeat(np.arange(len(queries.terms)), np.diff(queries.starts))
    gain = queries.times * index.weights[term]
    for j in range(len(index.left)):
        if not len(open_):
            break
        rest = gain * index.left[j][term]  # what a term may still add to a query
        total = np.zeros(len(queries.ids), np.int64)
        np.add.at(total, queries.query, rest)
        use = np.isin(queries.query, open_)
        table = pa.table({"term": pa.array(term[use], pa.int32()), "item": pa.array(queries.query[use], pa.int32()), "gain": gain[use], "rest": rest[use]})
        weights = F.broadcast(spark.createDataFrame(table))  # at most a block's pairs
        seen = index.postings.filter(F.col("tier") <= j).join(weights, "term").groupBy("item", "row").agg(F.sum(F.col("gain") * F.col("impact")).alias("least"), F.sum("rest").alias("met"))
        seen = materialize(seen, f"seen-{j}")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("least")))
        last = {r["item"]: r["least"] for r in seen.select("item", "least").withColumn("place", place).filter(F.col("place") <= best).filter(F.col("place") == best).collect()}
        proven = [int(q) for q in open_ if total[q] < last.get(q, 0) or not total[q]]
        open_ = np.setdiff1d(open_, proven)
        if proven:
            bar = F.broadcast(spark.createDataFrame([(q, int(total[q]), int(last.get(q, 1))) for q in proven], "item int, total long, bar long"))
            sure.append(seen.join(bar, "item").filter("least + total - met >= bar").select("item", "row"))
    found = None
    if sure:
        rows = sure[0]
        for r in sure[1:]:
            rows = rows.unionByName(r)
        rows = index.vectors.join(rows.groupBy("row").agg(F.collect_list("item").alias("items")), "row")
        found = _scored(rows, index, queries, [], best)
    if len(open_):
        rest = _scored(index.vectors, index, queries, open_.tolist(), best)
        found = rest if found is None else found.unionByName(rest)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select("item", "rank", "doc_id", "score")


def rank(documents: DataFrame, items: DataFrame, best: int = BEST, tiers: tuple[int, ...] = TIERS, pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents for each row of ``items`` (item_id, text).

    Every row of ``documents`` is a document of its own, repeated ones too; a null id comes before the others at a tie.
    Items equal in id and text are one. A text without a term, or an item without a document that scores, gives no row.
    Other columns are not read.
    """
    spark, out = documents.sparkSession, None
    for queries in _blocks(items, pairs):
        index = build(documents, queries.terms, tiers)
        if index is None:
            break
        names = F.broadcast(spark.createDataFrame([(i, q) for i, q in enumerate(queries.ids)], "item int, item_id long"))
        one = search(index, queries, best).join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out

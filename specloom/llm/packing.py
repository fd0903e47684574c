"""Packing by cutting-stock column generation.

Documents are cut at every ``context`` tokens; a whole context is a sequence of its own, and the rest
of a document is an item. Items are counted by size class (their length rounded up to ``UNIT`` tokens),
a histogram of fixed size. If whole items can't be packed with little padding, they are cut at every
half, quarter or eighth of a context, the coarsest that will do. A linear program over patterns (how many items of each class share a
sequence) is solved by column generation: a knapsack program over the classes' dual prices finds the
pattern that helps most, until none does. The patterns' counts are rounded down, and what is left is
filled greedily. Items are then numbered inside their class, and an item's number alone decides its
pattern, its sequence and its place there. Only the histogram ever reaches the driver.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from specloom.llm import bpe
from specloom.llm.common import materialize

CONTEXT, UNIT, END = 2048, 8, 1
BUCKETS = 256  # parts in which each class is numbered
CUTS = (1, 2, 4, 8)  # an item may be cut at every context / CUTS tokens
PADDING = 0.015  # the coarsest cut with no more padding than this is taken
GAP = 4e-3  # the linear program ends when its patterns are proven to be this near the fewest
MAX_COLUMNS = 20_000  # guards against cycling; the program is solved long before, and fails if it is not


def rank_encoding(tokens: list[bytes]) -> tiktoken.Encoding:
    ranks = {t: i for i, t in enumerate(tokens)}
    return tiktoken.Encoding("ranks", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Ids:
    """Ids of texts by a tokenizer file, as the tokenizers library gives them without added tokens.

    The file's byte-level vocabulary is handed to tiktoken, which gives the same ids in a fraction of the
    time; a text that holds one of the file's special strings goes to the tokenizers library itself.
    """

    def __init__(self, file: str):
        """``file`` is the text of the tokenizer file."""
        spec = json.loads(file)
        self.file, self.special, self.whole = file, [t["content"] for t in spec.get("added_tokens", ())], None
        raw = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(raw[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.encoding = tiktoken.Encoding("ids", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            self.whole = self.whole or Tokenizer.from_str(self.file)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.encoding.encode_to_numpy(text, disallowed_special=())


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def chunks(documents: DataFrame, path: str, context: int = CONTEXT, end: int = END) -> DataFrame:
    """doc_id, start, length, doc_tokens, crcs: the contexts of every document's ids and the end id.

    crcs[k] holds the checksums of the pieces that the k-th cut makes of the chunk (whole chunks are never cut).
    """

    with open(path, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Ids(shared.value)
        for batch in batches:
            at, start, length, total, crcs = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), end).astype("<u4")
                for s in range(0, len(ids), context):
                    part = ids[s : s + context]
                    at.append(row)
                    start.append(s)
                    length.append(len(part))
                    total.append(len(ids))
                    crcs.append([[zlib.crc32(part[i : i + context // c].tobytes()) for i in range(0, len(part), context // c)] for c in (CUTS if len(part) < context else CUTS[:1])])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total)), pa.array(crcs, pa.list_(pa.list_(pa.int64())))], ["doc_id", "start", "length", "doc_tokens", "crcs"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, crcs array<array<long>>")


def cut_lengths(lengths: dict[int, int], step: int, context: int) -> dict[int, int]:
    """The histogram of the pieces when every chunk shorter than a context is cut at every ``step`` tokens."""
    out: dict[int, int] = {}
    for length, n in lengths.items():
        whole, rest = divmod(length, step) if length < context else (0, length)
        for size, times in ((step, whole), (rest, 1)):
            if size and times:
                out[size] = out.get(size, 0) + n * times
    return out


def choose(lengths: dict[int, int], context: int, unit: int) -> tuple[int, list[tuple[np.ndarray, int]]]:
    """Index of the cut taken, and the patterns for it."""
    tokens, best = sum(length * n for length, n in lengths.items()), None
    for k, cut in enumerate(CUTS):
        demand = np.zeros(context // unit, np.int64)
        for length, n in cut_lengths(lengths, context // cut, context).items():
            demand[-(-length // unit) - 1] += n
        chosen = patterns(demand, context // unit)
        padding = 1 - tokens / max(1, context * sum(times for _, times in chosen))
        if best is None or padding < best[0] - PADDING:
            best = (padding, k, chosen)
        if best[0] <= PADDING:
            break
    return best[1:]


def best_pattern(prices: np.ndarray, capacity: int) -> np.ndarray:
    """Counts by class 1..len(prices) of the most valuable set of items that fits (any number of each)."""
    k = len(prices)
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        n = min(c, k)
        worth = prices[:n] + value[c - 1 :: -1][:n]  # item of class i leaves c - i
        i = int(worth.argmax())
        if worth[i] > value[c - 1] + 1e-12:
            value[c], choice[c] = worth[i], i + 1
        else:
            value[c] = value[c - 1]
    out, c = np.zeros(k, np.int64), capacity
    while c > 0:
        if choice[c]:
            out[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return out


def inverted(basis: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots; a few hundred rows, so plain array steps do."""
    m = len(basis)
    a = np.hstack([basis.astype(float), np.eye(m)])
    for i in range(m):
        k = i + int(np.abs(a[i:, i]).argmax())
        a[[i, k]] = a[[k, i]]
        a[i] /= a[i, i]
        factor = a[:, i].copy()
        factor[i] = 0
        a -= factor[:, None] * a[i]
    return a[:, m:]


def solve(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of the linear program that covers ``demand`` (by class) with fewest sequences.

    A revised simplex over the classes in demand; its first basis has one pattern for each class.
    """
    used = np.flatnonzero(demand)
    m = len(used)
    if not m:
        return []
    sizes = used + 1
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand[used].astype(float)
    bound = 0.0
    for step in range(MAX_COLUMNS):
        duals = inverse.sum(0)
        prices = np.zeros(used[-1] + 1)
        prices[used] = np.maximum(duals, 0)
        column = best_pattern(prices, capacity)[used].astype(float)
        worth = float(duals @ column)
        bound = max(bound, float(x.sum()) / max(worth, 1.0))  # no solution has fewer sequences
        if worth <= 1 + 1e-9 or x.sum() <= bound * (1 + GAP):
            break
        direction = inverse @ column
        able = direction > 1e-9
        if not able.any():
            break
        ratio = np.full(m, np.inf)
        ratio[able] = np.maximum(x[able], 0) / direction[able]
        out = int(ratio.argmin())
        basis[:, out] = column
        pivot = inverse[out] / direction[out]
        theta = ratio[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        x = x - theta * direction
        x[out] = theta
        if step % 500 == 499:
            inverse = inverted(basis)
            x = inverse @ demand[used].astype(float)
    else:
        raise RuntimeError(f"the linear program is not solved after {MAX_COLUMNS} columns")
    found = []
    for i in range(m):
        pattern = np.zeros(len(demand), np.int64)
        pattern[used] = basis[:, i].round().astype(np.int64)
        found.append((pattern, float(x[i])))
    return found


def fill_rest(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns for the items that rounding left over: again and again the largest item that still fits."""
    left, out = left.copy(), []
    while left.any():
        pattern, room = np.zeros(len(left), np.int64), capacity
        while len(fits := np.flatnonzero(left[:room])):
            i = fits[-1]
            pattern[i] += 1
            left[i] -= 1
            room -= i + 1
        here = pattern > 0
        again = int((left[here] // pattern[here]).min())
        left -= pattern * again
        out.append((pattern, 1 + again))
    return out


def patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) covering ``demand`` exactly, in whole numbers."""
    left, out = demand.copy(), []
    for pattern, x in sorted(solve(demand, capacity), key=lambda p: -p[1]):
        times = int(x + 1e-6)
        here = pattern > 0
        times = min(times, int((left[here] // pattern[here]).min())) if here.any() else 0
        if times > 0:
            out.append((pattern, times))
            left = left - pattern * times
    return out + fill_rest(left, capacity)


def layout(chosen: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, items per sequence, first sequence, place of the class in the pattern), rank by rank."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in chosen:
        place = 0
        for i in np.flatnonzero(pattern)[::-1]:
            size, n = int(i) + 1, int(pattern[i])
            out.append((size, ranks.get(size, 0), n, sequence, place))
            ranks[size] = ranks.get(size, 0) + n * times
            place += n
        sequence += times
    return out


def pack(documents: DataFrame, path: str, context: int = CONTEXT, unit: int = UNIT, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed as rows of their own; rows equal
    in all of these columns take their places in any order. An empty table gives no rows.

    The histogram of lengths (context rows at most) and the layout (patterns x classes in them, bounded by
    the number of classes and not by the data) are all that the driver holds and broadcasts.
    """
    whole = materialize(chunks(documents, path, context, end), "chunks")
    lengths = {r["length"]: r["n"] for r in whole.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length
    k, chosen = choose(lengths, context, unit)
    rows = layout(chosen)
    step = context // CUTS[k]
    each = whole.select("doc_id", F.col("start").alias("from"), F.col("length").alias("chunk"), "doc_tokens", F.posexplode(F.when(F.col("length") < context, F.col("crcs")[k]).otherwise(F.col("crcs")[0])).alias("i", "ids_crc32"))
    cut = each.selectExpr("doc_id", f"from + i * {step} AS start", f"CASE WHEN chunk < {context} THEN least({step}, chunk - i * {step}) ELSE chunk END AS length", "ids_crc32", "doc_tokens")
    size = F.ceil(F.col("length") / unit).cast("int").alias("size")
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int").alias("bucket")
    counts = cut.select(size, bucket).groupBy("size", "bucket").agg(F.count("*").alias("n"))
    starts = counts.selectExpr("size", "bucket", "coalesce(sum(n) OVER (PARTITION BY size ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin")
    ranked = cut.select("*", size, bucket).join(F.broadcast(starts), ["size", "bucket"])
    ranked = ranked.selectExpr("*", "begin + row_number() OVER (PARTITION BY size, bucket ORDER BY doc_id, start, ids_crc32, length) - 1 AS rank")
    return _seat(ranked, rows)


def _seat(ranked: DataFrame, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Sequence and offset of every ranked item, by a search in the broadcast layout."""
    by_size: dict[int, tuple[np.ndarray, ...]] = {}
    for size in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == size)
        by_size[size] = tuple(np.array(x, np.int64) for x in zip(*own, strict=True))
    shared = ranked.sparkSession.sparkContext.broadcast(by_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            sequence, place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                here = size == s
                first, per, begin, at = shared.value[int(s)]
                k = np.searchsorted(first, rank[here], side="right") - 1
                along = rank[here] - first[k]
                sequence[here] = begin[k] + along // per[k]
                place[here] = at[k] + along % per[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(place)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"])

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    seated = ranked.select(*columns, "size", "rank").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    # a sequence has at most ``context`` items
    return seated.selectExpr(*columns, "sequence_id", "coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset")

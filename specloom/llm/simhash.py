"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``LIMIT`` or fewer differing bits. The bits are grouped into
partitions, correlated ones together; partition i gets a threshold t_i >= -1 with
sum(t_i + 1) = LIMIT + 1, so two linked fingerprints differ in at most t_i bits of some partition i
(-1: the partition is not used). The number of partitions and their thresholds are found by dynamic
programming on candidate counts estimated from all distinct fingerprints. Each fingerprint is then
put under its value in partition i, and under the values that differ from it in up to t_i bits;
fingerprints that meet are verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import connected_components, group_bounds, join_by_class, materialize, merge_labels, release, sorted_groups

BITS, LIMIT, SEED = 64, 3, 42
PARTITIONS = (2, 3, 4, 5)  # numbers of partitions that are weighed against each other
PROBE_COST = 20.0  # of writing one probe, in verified pairs
HOT = 20_000  # members from which a bucket is split again by the rest of its bits, and then dealt out in pairs of chunks
TILE = 1024
KEYS = ["part", "key", "sub", "subkey", "low", "high"]  # of a group of fingerprints to be compared


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text: the majority of its word shingles' hashes at each bit."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` and fp (the fingerprint's bits as a signed long); a null text counts as one without words."""
    rows = documents.select(*carry, F.col("text").alias("_text"))
    schema = rows.drop("_text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, text = batch.columns
            fp = np.array([fingerprint(t.as_py()) for t in text], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fp)], [*batch.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, schema)


def bit_counts(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """How often bits i and j are both set (64 x 64, over all fingerprints), and the number of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy())
            x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(x), 65536):  # counts to 2^24 are exact in float32
                total += x[at : at + 65536].T @ x[at : at + 65536]
            n += len(x)
        values = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "n"])

    rows = distinct.select("fp").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()  # 4097 rows
    out = np.zeros(BITS * BITS + 1, np.int64)
    out[rows["i"].to_numpy(int)] = rows["n"]
    return out[:-1].reshape(BITS, BITS), int(out[-1])


def correlations(both: np.ndarray, n: int) -> np.ndarray:
    """Absolute correlation of each two bits; 0 for bits that never vary."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(p * (1 - p))
    scale = np.outer(sd, sd)
    return np.abs(np.divide(both / max(n, 1) - np.outer(p, p), scale, out=np.zeros_like(scale), where=scale > 0))


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near equal size; each takes, again and again, the free bit most correlated with it."""
    free, out = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        own = [max(sorted(free), key=lambda b: sum(correlation[b, c] for c in free if c != b))]
        free.remove(own[0])
        while len(own) < size:
            best = max(sorted(free), key=lambda b: sum(correlation[b, c] for c in own))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def mask_of(bits: list[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def _equal_pairs(distinct: DataFrame, masks: list[int]) -> np.ndarray:
    """For each mask, the number of pairs of fingerprints that agree on it: from the counts of all values."""
    each = distinct.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("p", "v"))
    counts = each.groupBy("p", "v").agg(F.count("*").alias("n"))
    rows = counts.groupBy("p").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect()  # a row per mask
    out = np.zeros(len(masks))
    for r in rows:
        out[r["p"]] = r["pairs"]
    return out


def probes(bits: int, threshold: int) -> int:
    """Keys that differ from a key of so many bits in at most ``threshold`` of them."""
    return sum(comb(bits, k) for k in range(threshold + 1))


def allocate(sizes: list[int], equal: list[float], odds: list[list[float]], n: int, limit: int = LIMIT) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost for one partitioning, by dynamic programming over the partitions.

    equal: pairs that agree on the whole partition. odds: for each bit, how much likelier the pairs are
    when that bit may differ; their elementary symmetric sums carry ``equal`` over to 1, 2 and 3 differing bits.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for size, pairs, o in zip(sizes, equal, odds, strict=True):
        sums = [1.0] + [0.0] * (limit + 1)
        for x in o:
            for k in range(limit + 1, 0, -1):
                sums[k] += x * sums[k - 1]
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, taken) in best.items():
            for t in range(-1, limit + 1):
                total = used + t + 1
                if total > limit + 1 or t > size:
                    continue
                c = cost if t < 0 else cost + PROBE_COST * n * probes(size, t) + pairs * sum(sums[: t + 1])
                if total not in new or c < new[total][0]:
                    new[total] = (c, [*taken, t])
        best = new
    return best[limit + 1]


def plan(distinct: DataFrame) -> list[tuple[int, int]]:
    """(bit mask, threshold) of the partitions to probe, by the statistics of all distinct fingerprints."""
    both, n = bit_counts(distinct)
    c = correlations(both, n)
    p = np.diag(both) / max(n, 1)
    same = p * p + (1 - p) ** 2
    odds = 2 * p * (1 - p) / same
    groups = {m: group_bits(c, m) for m in PARTITIONS}
    masks = [mask_of(g) for m in PARTITIONS for g in groups[m]]
    equal = iter(_equal_pairs(distinct, masks))
    found = []
    for m in PARTITIONS:
        g = groups[m]
        cost, thresholds = allocate([len(x) for x in g], [next(equal) for _ in g], [[float(odds[b]) for b in x] for x in g], n)
        found.append((cost, m, [(mask_of(x), t) for x, t in zip(g, thresholds, strict=True) if t >= 0]))
    return min(found)[2]


def _rest_masks(mask: int) -> list[int]:
    """The bits outside ``mask`` in LIMIT + 1 parts: linked fingerprints that agree on the mask agree on one of them."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [mask_of(rest[i :: LIMIT + 1]) for i in range(LIMIT + 1)]


def _placed(distinct: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """fp, part, key, home: every fingerprint under its own key (home) and, as a probe, under the keys near it."""
    out = []
    for i, (mask, threshold) in enumerate(parts):
        bits = [b for b in range(BITS) if mask >> b & 1]
        flips = [mask_of(list(x)) for k in range(threshold + 1) for x in combinations(bits, k)]
        key = F.col("fp").bitwiseAND(F.lit(mask))
        rows = distinct.select("fp", F.explode(F.array(*[F.lit(f) for f in flips])).alias("flip"), key.alias("own")) if len(flips) > 1 else distinct.select("fp", F.lit(0).cast("long").alias("flip"), key.alias("own"))
        out.append(rows.select("fp", F.lit(i).alias("part"), F.col("own").bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") == 0).alias("home")))
    first, *others = out
    for o in others:
        first = first.unionByName(o)
    return first


def links_in_bucket(fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the bucket's verified pairs connect, fewer than it has members.

    Pairs are compared in tiles and joined at once, so memory does not grow with their number.
    """
    n = len(fp)
    labels = np.arange(n)
    x = fp.view(np.uint64)
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            near = np.bitwise_count(x[a : a + TILE, None] ^ x[None, b : b + TILE]) <= LIMIT
            near &= home[a : a + TILE, None] | home[None, b : b + TILE]
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            later = j > i
            labels = merge_labels(labels, i[later], j[later])
    member = np.flatnonzero(labels != np.arange(n))
    return fp[labels[member]], fp[member]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in sorted_groups(batches, KEYS):
        bounds = group_bounds(table, KEYS)
        fp, home = table.column("fp").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        sizes = np.diff(bounds)
        a, b = [], []
        pairs = bounds[:-1][sizes == 2]  # most buckets with more than one member have two
        if len(pairs):
            ok = np.bitwise_count(fp[pairs].view(np.uint64) ^ fp[pairs + 1].view(np.uint64)) <= LIMIT
            ok &= home[pairs] | home[pairs + 1]
            a.append(fp[pairs][ok])
            b.append(fp[pairs + 1][ok])
        for at in np.flatnonzero(sizes > 2):
            x, y = links_in_bucket(fp[bounds[at] : bounds[at + 1]], home[bounds[at] : bounds[at + 1]])
            a.append(x)
            b.append(y)
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            differ = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[differ]), pa.array(b[differ])], ["a", "b"])


def dealt(distinct: DataFrame, parts: list[tuple[int, int]], hot: int) -> DataFrame:
    """fp and home under the keys of the groups to be compared, none much larger than two times ``hot``.

    Buckets of more than ``hot`` members are split once more: each member goes under its values on
    LIMIT + 1 parts of the remaining bits, which loses no link. Sub-buckets that still have more are
    dealt out as pairs of chunks (low, high), so each two of their members meet in some group.
    """
    placed = materialize(_placed(distinct, parts), "probes")
    full = placed.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("part", "key", F.lit(True).alias("is_hot"))
    full = F.broadcast(materialize(full, "hot"))  # a row for more than ``hot`` probes
    subs = F.lit(None)
    for i, (mask, _) in enumerate(parts):
        one = F.array(*[F.struct(F.lit(k + 1).alias("sub"), F.col("fp").bitwiseAND(F.lit(m)).alias("subkey")) for k, m in enumerate(_rest_masks(mask))])
        subs = F.when(F.col("part") == i, one).otherwise(subs)
    whole = F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("subkey")))
    keys = ["part", "key", "sub", "subkey"]

    def split(how: str) -> DataFrame:
        rows = placed.join(full, ["part", "key"], how)
        return rows.withColumn("s", F.explode(F.when(F.col("is_hot"), subs).otherwise(whole))).select("part", "key", "s.sub", "s.subkey", "fp", "home")

    again = split("inner").groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > hot).select(*keys, F.ceil(F.col("n") / hot).cast("int").alias("chunks"))
    rows = split("left").join(F.broadcast(materialize(again, "hot-parts")), keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).filter("chunks = 1 OR chunk <> other")
    return rows.select(*keys, F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "fp", "home")


def fingerprint_links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) among distinct fingerprints that connect all and only those within LIMIT bits of each other."""
    rows = dealt(distinct, plan(distinct), hot)
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "fp").mapInArrow(_verify, "a long, b long")


def _components(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, th, fp) of every document, th a hash of its text; (fp, root, component_id, copies) of every distinct
    fingerprint; and the written table that the latter is read from."""
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    docs = materialize(fingerprints(rows, ("doc_id", "th")), "fingerprints")
    firsts = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "distinct")
    links = materialize(fingerprint_links(firsts.select("fp")), "links")
    roots = connected_components(links, "a", "b")
    named = materialize(firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", "copies"), "roots")
    for done in (firsts, links, roots):
        release(done)
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return docs, named.join(names, "root").select("fp", "root", "component_id", "copies"), named


def simhash_components(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest doc_id that links of at most LIMIT differing bits reach, itself
    included. Null texts and texts without words have fingerprint zero and are linked like any other.
    A null doc_id joins a component but never names one; a component with no other id has a null name.
    Only (doc_id, fingerprint) rows are shuffled; equal fingerprints are compared once, and those of very many
    documents are joined back by broadcast.
    """
    docs, by_fp, _ = _components(documents)
    return join_by_class(docs, by_fp, ["fp"], "copies").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay when each component keeps the document with its smallest id.

    Of rows with that id in one component, the one whose text has the smallest hash stays, and of those equal
    in id and text the one that is least as JSON, whatever task it comes from; of a component in which no document has an id, likewise. An id that stands on rows of several
    components is kept once for each. The choice is made on ids and hashes; the rows themselves are shuffled once.
    """
    docs, by_fp, named = _components(documents)
    each = docs.groupBy("doc_id", "th", "fp").agg(F.count("*").alias("_n"))
    able = join_by_class(each, by_fp, ["fp"], "copies").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = able.groupBy("root").agg(F.min(F.struct("th", "doc_id", "_n")).alias("k")).select("k.*")
    keys = ["_id", "_none", "_th"]
    named_rows = lambda id_, th: [F.coalesce(id_, F.lit(0)).alias("_id"), id_.isNull().alias("_none"), th.alias("_th")]
    kept = materialize(kept.select(*named_rows(F.col("doc_id"), F.col("th")), "_n"), "survivors")
    release(docs)
    release(named)
    rows = documents.select(F.struct(*documents.columns).alias("_row"), *named_rows(F.col("doc_id").cast("long"), F.xxhash64("text")))
    out = rows.join(kept.filter("_n = 1"), keys).select("_row.*")
    if kept.filter("_n > 1").isEmpty():
        return out
    several = join_by_class(rows, kept.filter("_n > 1"), keys, "_n")
    return out.unionByName(several.groupBy(*keys).agg(F.min_by("_row", F.to_json("_row", {"ignoreNullFields": "false"})).alias("_row")).select("_row.*"))

"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards. A row descends it level by level: at each node every child
draws -ln(u) / weight, u a hash of the row's key and the child's name, and the smallest draw wins.
A child is therefore taken in proportion to its weight, and its draw depends on nothing but the key,
its own name and its own weight. When a weight changes, rows move only between the changed subtree
and the rest; below nodes whose weights did not change no draw changes.

A tree grows by :meth:`Tree.grown`, which puts the new shard in a region of its own: all older draws
stay as they are, so every row that moves goes to the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256  # parts in which each shard is numbered; a fixed figure, so the table of offsets is bounded


@dataclass(frozen=True)
class Tree:
    """regions[r][k] lists the (shard, weight) pairs of rack k in region r."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def balanced(shards: int, racks: int = 2, per_rack: int = 4, founded: int = 24) -> Tree:
        """Shards 0 to shards - 1 of weight 1: the first ``founded`` filled rack by rack, each later one as grown.

        So the number of shards alone decides, and from ``founded`` shards on one more takes rows only into itself.
        """
        if shards < 1:
            raise ValueError("a tree needs a shard")
        filled = min(shards, founded)
        racked = [tuple((s, 1.0) for s in range(i, min(i + per_rack, filled))) for i in range(0, filled, per_rack)]
        tree = Tree(tuple(tuple(racked[i : i + racks]) for i in range(0, len(racked), racks)))
        for _ in range(filled, shards):
            tree = tree.grown()
        return tree

    @property
    def shards(self) -> list[int]:
        return sorted(s for region in self.regions for rack in region for s, _ in rack)

    def grown(self, weight: float = 1.0) -> Tree:
        """This tree with one more shard, in a new region."""
        return Tree((*self.regions, ((((max(self.shards) + 1), weight),),)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        return Tree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))


def _table(values: list, depth: int) -> str:
    """A nested array literal, every level padded with 0 to the same width."""

    def width(v: list, level: int) -> int:
        return len(v) if level == 0 else max(width(x, level - 1) for x in v)

    widths = [width(values, level) for level in range(depth)]

    def text(v, level: int) -> str:
        if level == depth:
            return f"{float(v or 0)}D"
        v = list(v or []) + [None] * (widths[level] - len(v or []))
        return f"array({', '.join(text(x, level + 1) for x in v)})"

    return text(values, 0)


def _first(weights: str, name: str) -> str:
    """Index of the child with the smallest draw, the lower one at a tie; ``name`` spells the child's name from its index i.

    A draw is -ln(u) / weight with u strictly between 0 and 1, and infinite at weight 0.
    """
    u = f"(shiftrightunsigned(xxhash64({name}), 11) + 0.5D) / {float(1 << 53):.1f}D"
    return f"array_min(transform({weights}, (w, i) -> struct(CASE WHEN w > 0 THEN -ln({u}) / w ELSE double('infinity') END AS draw, i AS i))).i"


def place(key: str, tree: Tree) -> Column:
    """The shard of the key in column ``key``. A null key is a key like any other."""
    racks = [[sum(w for _, w in rack) for rack in region] for region in tree.regions]
    weights = _table([[[w for _, w in rack] for rack in region] for region in tree.regions], 3)
    ids = _table([[[s for s, _ in rack] for rack in region] for region in tree.regions], 3)
    region = _first(_table([sum(w) for w in racks], 1), f"{key}, 'region', i")
    rack = _first(f"{_table(racks, 2)}[r]", f"{key}, 'rack', r, i")
    leaf = _first(f"{weights}[r][c]", f"{key}, 'shard', int({ids}[r][c][i])")
    return F.expr(f"int(transform(array({region}), r -> transform(array({rack}), c -> {ids}[r][c][{leaf}])[0])[0])")


def shard(documents: DataFrame, tree: Tree, grown: Tree | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``documents``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Only doc_id and the tree decide the shard. size is the text's UTF-8 bytes (none for null) plus 8;
    text_crc32 of a null text is that of the empty one. Slots number a shard's rows from 0 without
    gaps: rows are numbered inside ``buckets`` parts of each shard, dealt by a hash of doc_id, and
    each part starts where the one before ends, so no task holds a whole shard. Rows equal in every
    column share the order arbitrarily, and their results are equal but for the slot. Null ids are placed
    together; other columns are not read.
    """
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("bucket")), F.lit(buckets)).cast("int").alias("bucket")
    ids = documents.select(F.col("doc_id").cast("long")).select(place("doc_id", tree).alias("shard"), bucket)
    counts = ids.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # shards x buckets rows at most, a bound that the data don't move
    starts = counts.selectExpr("shard", "bucket", "coalesce(sum(n) OVER (PARTITION BY shard ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start")
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = rows.select("*", bucket, place("doc_id", tree).alias("shard"), (place("doc_id", grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    return rows.join(F.broadcast(starts), ["shard", "bucket"]).selectExpr(
        "doc_id", "size", "text_crc32", "'key' AS law", "shard",
        "start + row_number() OVER (PARTITION BY shard, bucket ORDER BY doc_id, text_crc32, size) - 1 AS slot",
        "grown_shard",
    )

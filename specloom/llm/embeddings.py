"""Near-duplicate vectors by a subspace pigeonhole join.

For unit vectors cosine >= c means a squared distance of at most 2 - 2c. The vectors are turned by one
fixed random rotation and cut into blocks of ``BLOCK_DIMS`` dimensions; a pair within the squared distance D
is within D * (size of the block / all dimensions) in at least one block. Each block is range-joined under
that budget: the vectors of a label stand together, or, where they are more than one task should hold, in a
grid over as many of the block's dimensions as it takes, with cells of four radii, and of two when all
dimensions are taken. A vector goes to its own cell and to every upper neighbour that its radius reaches, so
any two vectors in range meet in exactly one cell, the larger of their cells in every dimension.

Inside a cell nothing is copied. Its vectors are split at medians into small groups, and a group is compared
only with the groups, and in them only with the vectors, that lie within the block's radius of its bounding
box, by all dimensions of the block. The larger a label, the smaller a part of its pairs is compared.

The join moves ids and the block's coordinates only. Vectors are fetched for the members of a cell that have
another one within the block's budget, and for no others; these few are verified exactly, and each pair is
counted in the first block in which it is within budget.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import connected_components, group_bounds, join_by_class, materialize, merge_labels, release, sorted_groups

COSINE = 0.98
BLOCK_DIMS, GRID_DIMS = 8, 8
WIDE, NARROW = 4.0, 2.0  # widths of a grid's cells in radii: at first, and in as many dimensions as are taken again
TILE_ROWS = 131_072  # members of a cell from which it is dealt out in pairs of chunks, some 100 bytes each
SHRINK = 1.4  # a step of the grid more for each time that a label has so many times TILE_ROWS vectors
LEAF = 32  # vectors at most in a group of those that are compared together
FEW_FULL = 100_000  # full cells up to which they are broadcast (40 bytes each)
SLACK = 1e-9  # widens the ranges beyond rounding errors; verification is exact
SINGLE = 1e-5  # the same for squared distances in single precision


def rotation(d: int) -> np.ndarray:
    """A fixed random rotation: the same on every executor, independent of the data."""
    q, r = np.linalg.qr(np.random.default_rng(20_240 + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def blocks_of(d: int) -> list[slice]:
    edges = np.linspace(0, d, max(1, d // BLOCK_DIMS) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def rotated_units(x: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated. einsum adds up each row the same way wherever the row stands."""
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.einsum("ij,jk->ik", x, rotation(x.shape[1]), optimize=False)


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vkey, dims, vec: the vectors' bytes as they are stored, and a key that equal vectors share.

    vkey, dims and vec are null in rows that can't be compared: null id or label, null or zero vector, null
    or non-finite components. Vectors that differ by a power of two, which changes no cosine, have one key.
    """
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, raw = [], [], []
            for v, usable in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                key = size = data = None
                if usable and v.is_valid and v.values.null_count == 0:
                    x = v.values.to_numpy().astype("<f8") + 0.0
                    if np.isfinite(x).all() and x.any():
                        key = hashlib.blake2b(_scaled(x[None])[0].tobytes(), digest_size=16).digest()
                        size, data = len(x), x.astype("<f4").tobytes() if single else x.tobytes()
                keys.append(key)
                dims.append(size)
                raw.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "label", "vkey", "dims", "vec"])

    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding") if single else F.col("embedding").cast("array<double>"))
    return rows.withColumn("usable", F.expr("vec_id IS NOT NULL AND label IS NOT NULL")).mapInArrow(run, "vec_id long, label long, vkey binary, dims int, vec binary")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    raw = column.to_pylist()
    return _scaled(np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * d else "<f8").astype("<f8") for v in raw]))


def budget(cut: slice, d: int, cosine: float) -> float:
    """The block's share of the squared distance."""
    return (2 - 2 * cosine) * (cut.stop - cut.start) / d


def _cells(cosine: float):
    """Every vector under its own cell (home) and the cells that it reaches, in each block, with its coordinates there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                part = pa.Table.from_batches([batch]).filter(pa.array(dims == d))
                x = rotated_units(_matrix(part.column("vec"), int(d)))
                steps = part.column("grid").to_numpy()[:, None] - np.arange(GRID_DIMS)[None]
                used, radii = steps > 0, np.where(steps > GRID_DIMS, NARROW, WIDE)
                rows, cells, homes, blocks, coords = [], [], [], [], []
                for b, cut in enumerate(blocks_of(int(d))):
                    y = np.zeros((len(x), GRID_DIMS))
                    own = x[:, cut]
                    y[:, : own.shape[1]] = own[:, :GRID_DIMS]
                    radius = np.sqrt(budget(cut, int(d), cosine)) + SLACK
                    low, high = (np.where(used, np.clip(np.floor(z / (radii * radius)), -EDGE, EDGE), 0).astype(np.int64) for z in (y, y + radius))
                    home = _pack(low)
                    raw = np.ascontiguousarray(own, "<f4")
                    raw = [r.tobytes() for r in raw]
                    reach = high > low
                    for up in product(*((0, 1) if any_there else (0,) for any_there in reach.any(0))):
                        there = np.flatnonzero((reach | (np.array(up) == 0)).all(1))
                        rows.append(there)
                        cells.append(_pack(low[there] + np.array(up)))
                        homes.append(home[there])
                        blocks.append(np.full(len(there), b, np.int32))
                        coords += [raw[i] for i in there]
                at = pa.array(np.concatenate(rows))
                own = {k: part.column(k).take(at) for k in ("label", "node", "dims")}
                out = pa.table({**own, "block": pa.array(np.concatenate(blocks)), "cell": pa.array(np.concatenate(cells)), "home": pa.array(np.concatenate(homes)), "coords": pa.array(coords, pa.binary())})
                yield from out.to_batches(max_chunksize=8192)

    return run


EDGE = 126  # cells beyond it, on either side, are one with it: coordinates of 8 bits keep their order


def _pack(cells: np.ndarray) -> np.ndarray:
    """Grid coordinates, 8 bits each, as one long."""
    out = np.zeros(len(cells), np.int64)
    for k in range(cells.shape[1]):
        out = (out << 8) | (cells[:, k] + 128)
    return out


def _unpack(packed: np.ndarray, k: int) -> np.ndarray:
    return np.stack([(packed >> (8 * (k - 1 - i))) & 0xFF for i in range(k)], 1)


def median_groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of x, and the starts of the groups in it, of LEAF rows or fewer: rows are halved at the median of their widest coordinate."""
    order, parts = np.arange(len(x)), [(0, len(x))]
    starts = []
    while parts:
        a, b = parts.pop()
        if b - a <= LEAF:
            starts.append(a)
            continue
        own = x[order[a:b]]
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, np.ptp(own, 0).argmax()], half)]
        parts += [(a, a + half), (a + half, b)]
    return order, np.sort(np.array(starts))


def close_tables(x: np.ndarray, within: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the tables that hold every pair of rows of x at a squared distance of at most ``within``.

    Rows are a group and columns what lies near its bounding box. A pair stands in one table; of two rows of one
    group the table has both (i, j) and (j, i), so the first rows of the columns are the group itself.
    """
    order, starts = median_groups(x)
    y, ends = x[order], np.append(starts[1:], len(x))
    low, high = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
    for g, (a, b) in enumerate(zip(starts, ends, strict=True)):
        gap = np.maximum(np.maximum(low[g + 1 :] - high[g], low[g] - high[g + 1 :]), 0)
        near = g + 1 + np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= within)
        sizes = ends[near] - starts[near]
        others = np.repeat(starts[near] - np.append(0, np.cumsum(sizes)[:-1])[: len(near)], sizes) + np.arange(sizes.sum())
        gap = np.maximum(np.maximum(y[others] - high[g], low[g] - y[others]), 0)
        others = others[np.einsum("ij,ij->i", gap, gap) <= within]
        yield order[a:b], np.append(order[a:b], order[others])


def near_members(x: np.ndarray, chunk: np.ndarray, crossing: bool, within: float) -> tuple[np.ndarray, int, int]:
    """Which rows of x have another one at a squared distance of at most ``within``, the number of such pairs, and of the pairs compared.

    ``crossing``: only pairs of different chunks count.
    """
    squares, found, pairs, compared = np.einsum("ij,ij->i", x, x), np.zeros(len(x), bool), 0, 0
    for rows, columns in close_tables(x, within):
        near = squares[rows, None] + squares[None, columns] - 2 * (x[rows] @ x[columns].T) <= within
        near[:, : len(rows)] = np.triu(near[:, : len(rows)], 1)
        compared += near.size
        if crossing:
            near &= chunk[rows, None] != chunk[None, columns]
        if near.any():
            pairs += int(near.sum())
            found[rows] |= near.any(1)
            found[columns] |= near.any(0)
    return found, pairs, compared


TILE = ["label", "dims", "block", "cell", "low", "high"]


def _within_budget(cosine: float):
    """The rows of every tile that have another one within the block's budget, without their coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, TILE):
            bounds = group_bounds(table, TILE)
            kept = []
            for at, n in zip(bounds[:-1], np.diff(bounds), strict=True):
                if n < 2:
                    continue
                part = table.slice(at, n)
                d, block, low, high = (part.column(k)[0].as_py() for k in ("dims", "block", "low", "high"))
                cut = blocks_of(d)[block]
                x = np.frombuffer(b"".join(part.column("coords").to_pylist()), "<f4").reshape(n, -1)
                kept.append(at + np.flatnonzero(near_members(x, part.column("chunk").to_numpy(), low != high, budget(cut, d, cosine) + SINGLE)[0]))
            if kept and sum(map(len, kept)):
                yield from table.drop_columns(["coords"]).take(pa.array(np.concatenate(kept))).to_batches(max_chunksize=8192)

    return run


def cell_links(vec: np.ndarray, home: np.ndarray, chunk: np.ndarray, block: int, cell: int, crossing: bool, cosine: float):
    """Links of one tile, as (i, j) in batches.

    A pair counts here if it is linked, within this block's budget, not within any earlier block's, and
    this is the cell in which it meets. ``crossing``: only pairs of different chunks count.
    """
    d = vec.shape[1]
    cuts = blocks_of(d)
    limits = [budget(cut, d, cosine) + SLACK for cut in cuts]
    norm = np.sqrt(np.einsum("ij,ij->i", vec, vec))
    unit, turned = vec / norm[:, None], rotated_units(vec)
    homes, here = _unpack(home, GRID_DIMS), _unpack(np.array([cell]), GRID_DIMS)[0]
    for rows, columns in close_tables(turned[:, cuts[block]], limits[block]):
        near = unit[rows] @ unit[columns].T >= cosine - SLACK
        near[:, : len(rows)] = np.triu(near[:, : len(rows)], 1)
        if crossing:
            near &= chunk[rows, None] != chunk[None, columns]
        i, j = np.nonzero(near)
        i, j = rows[i], columns[j]
        for at in range(0, len(i), 65536):
            p, q = i[at : at + 65536], j[at : at + 65536]
            ok = np.einsum("ij,ij->i", vec[p], vec[q]) / (norm[p] * norm[q]) >= cosine
            ok &= (np.maximum(homes[p], homes[q]) == here).all(1)
            gap = (turned[p] - turned[q]) ** 2
            for e, cut in enumerate(cuts[: block + 1]):
                within = gap[:, cut].sum(1) <= limits[e]
                ok &= within if e == block else ~within
            yield p[ok], q[ok]


def _verify(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, TILE):
            bounds = group_bounds(table, TILE)
            out_node, out_n, out_root = [], [], []
            for at, n in zip(bounds[:-1], np.diff(bounds), strict=True):
                if n < 2:
                    continue
                part = table.slice(at, n)
                d, block, cell, low, high = (part.column(k)[0].as_py() for k in ("dims", "block", "cell", "low", "high"))
                node, copies, chunk = (part.column(k).to_numpy() for k in ("node", "copies", "chunk"))
                labels, degree = np.arange(n), np.zeros(n, np.int64)
                for i, j in cell_links(_matrix(part.column("vec"), d), part.column("home").to_numpy(), chunk, block, cell, low != high, cosine):
                    np.add.at(degree, i, copies[j])
                    np.add.at(degree, j, copies[i])
                    labels = merge_labels(labels, i, j)
                has = np.flatnonzero(degree)
                out_node.append(node[has])
                out_n.append(degree[has])
                out_root.append(node[labels[has]])
            if out_node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_node, out_n, out_root)], ["node", "n", "root"])

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared only within equal labels (and equal dimensions). Equal vectors are compared
    once, whatever their number: they link to one another and share their other links. Rows that can't
    be compared (null id or label; null, empty, zero or non-finite vector) have n_links 0 and their own
    vec_id as component; a null id gives a null component and kept false. Repeated ids are vectors of
    their own that share a name.

    A label of more than ``tile_rows`` vectors takes the finer a grid, the more it has; a cell that still has
    more members is dealt out as pairs of chunks, so no task holds it whole.
    """
    rows = vectors(embeddings)
    ids = materialize(rows.select("vec_id", "label", "vkey"), "vectors")
    classes = rows.filter("vkey IS NOT NULL").groupBy("label", "vkey").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min(F.struct("vec", "dims")).alias("v"))
    classes = materialize(classes.select("label", "vkey", "rep", "copies", "v.vec", "v.dims", F.monotonically_increasing_id().alias("node")), "classes")
    tiles = tiled(classes, cosine, tile_rows)
    near = tiles.repartition(*TILE).sortWithinPartitions(*TILE, "node").mapInArrow(_within_budget(cosine), tiles.drop("coords").schema)
    near = materialize(near, "near")  # the members of tiles that have a candidate there
    fetched = near.join(classes.select("node", "copies", "vec"), "node")
    found = fetched.repartition(*TILE).sortWithinPartitions(*TILE, "node").mapInArrow(_verify(cosine), "node long, n long, root long")
    found = materialize(found, "links")
    release(near)
    degree = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = connected_components(found, "node", "root")
    named = classes.select("label", "vkey", "node", "rep", "copies").join(degree, "node", "left").join(roots, "node", "left")
    named = named.select("label", "vkey", "rep", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = materialize(named, "named")
    for done in (found, classes, roots):
        release(done)
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = named.join(names, "root").select("label", "vkey", "copies", "n_links", "component_id")
    linked = join_by_class(ids.filter("vkey IS NOT NULL"), by_class, ["label", "vkey"], "copies").select("vec_id", "n_links", "component_id")
    lone = ids.filter("vkey IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def tiled(classes: DataFrame, cosine: float, tile_rows: int) -> DataFrame:
    """Every class of ``classes`` under the tiles in which it is compared, with its coordinates in the tile's block."""
    size = F.log(F.col("n") / tile_rows) / float(np.log(SHRINK))
    grids = classes.groupBy("label", "dims").agg(F.count("*").alias("n")).select("label", "dims", F.least(F.greatest(F.ceil(size), F.lit(0)), F.lit(2 * GRID_DIMS)).cast("int").alias("grid"), "n")
    sized = join_by_class(classes.select("label", "node", "dims", "vec"), grids, ["label", "dims"], "n").select("label", "node", "dims", "grid", "vec")
    place = lambda rows: rows.mapInArrow(_cells(cosine), "label long, node long, dims int, block int, cell long, home long, coords binary")
    placed = place(sized)
    cell = ["label", "dims", "block", "cell"]
    # only labels in a grid have more than tile_rows vectors, so the others' cells need no count
    full = place(sized.filter("grid > 0")).groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > tile_rows).select(*cell, F.ceil(F.col("n") / tile_rows).cast("int").alias("chunks"))
    full = materialize(full, "full")
    full = F.broadcast(full) if full.count() <= FEW_FULL else full
    out = placed.join(full, cell, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    out = out.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    out = out.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
    return out.select(*cell, F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "home", "coords")

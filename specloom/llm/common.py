"""What the training-data operators share: durable intermediate tables, sorted-group
iteration inside a task, and connected components by star contraction."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("specloom.shared.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="specloom-")
    spark.conf.set("specloom.shared.dir", f"file://{made}")
    return f"file://{made}"


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it. ``by`` names a column with a folder for each value.

    This cuts the lineage without depending on any executor: a lost executor costs
    nothing that was written here.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._specloom_path = path
    for made in _scopes.get():
        made.append(out)
    return out


_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())  # each thread has its own


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """Gathers the tables that :func:`materialize` makes inside, so that they can be released when their readers are done."""
    made: list[DataFrame] = []
    before = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(before)


def release(df: DataFrame | None) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_specloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def join_by_class(rows: DataFrame, classes: DataFrame, keys: list[str], copies: str, hot: int = 1_000_000) -> DataFrame:
    """Inner join of ``rows`` with the one row of ``classes`` for their keys, which are not null.

    ``copies`` counts the rows of a class. Classes of more than ``hot`` rows are broadcast, so no task gets
    all rows of one; there are at most (rows / hot) of them. ``rows`` is read twice if there are any.
    """
    big = materialize(classes.filter(F.col(copies) > hot), "hot")
    if big.isEmpty():
        release(big)
        return rows.join(classes, keys)
    few = big.select(*keys, F.lit(True).alias("_hot"))
    plain = rows.join(F.broadcast(few), keys, "left_anti").join(classes.filter(F.col(copies) <= hot), keys)
    return plain.unionByName(rows.join(F.broadcast(big), keys))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by ``keys`` (non-null integers).

    A table holds one or more complete groups; a group that spans batches is carried over,
    so memory is one batch plus the largest group.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        breaks = np.zeros(batch.num_rows, bool)
        for c in cols:
            breaks[1:] |= c[1:] != c[:-1]
        if kept:
            last = kept[-1]
            tail = [last.column(last.schema.get_field_index(k))[last.num_rows - 1].as_py() for k in keys]
            breaks[0] = any(c[0] != t for c, t in zip(cols, tail, strict=True))
        starts = np.flatnonzero(breaks)
        if not len(starts):
            kept.append(batch)
            continue
        cut = int(starts[-1])
        done = [*kept, batch.slice(0, cut)] if cut else kept
        if done:
            yield pa.Table.from_batches(done).combine_chunks()
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the groups in a table sorted by ``keys``, and its length at the end."""
    n = table.num_rows
    breaks = np.zeros(n, bool)
    breaks[:1] = True
    for k in keys:
        c = table.column(k).to_numpy()
        breaks[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(breaks), n)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of ``a[i]`` and ``b[i]`` in ``labels`` (each element's smallest member so far)."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Alternating large-star and small-star rounds: every round is two grouped minima (combined
    before the shuffle) joined back to the edges; the minima of hubs are broadcast, so no task gets all
    links of one. Rounds grow with the logarithm of the longest path. Each round is a written table.
    Edges with a null end are ignored; self loops give no row.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
    e = e.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, mark = _round(e, None)
    while True:
        before = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_by_class(both.filter("v > u"), lows, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_by_class(large, lows, ["u"], "n").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new, mark = _round(small, e)
        e = new
        if mark == before:
            break
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    out._specloom_path = e._specloom_path  # so that release() deletes the last round
    return out


def _round(e: DataFrame, old: DataFrame | None) -> tuple[DataFrame, tuple]:
    e = materialize(e, "edges")
    release(old)
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return e, (row["n"], row["h"])

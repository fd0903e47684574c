"""Running sums and states in the order of a document, for documents of any length.

A document of ordinary length is one group of a window. A very long one is cut into cells that follow each other in its order. Each
cell is scanned by itself, then what it hands on (its sums and last states, one row) is carried over the document's cells and
joined back, so no task sees more than a cell's rows, or one row for each cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.sources.artifacts import settled

CELL = 4096  # ordinals in a cell
SUM, LAST, PREVIOUS = "sum", "last", "previous"
LONG = 64 << 20  # characters of a document from which on it is scanned by cells


def in_cells(ordinal: str | Column) -> Column:
    """The cell of an ordinal that grows with a document's order."""
    return F.floor((F.col(ordinal) if isinstance(ordinal, str) else ordinal) / CELL)


def scan(rows: DataFrame, key: Sequence[str], order: Sequence[str], results: Mapping[str, tuple[str, Column]], cell: Column | None = None) -> DataFrame:
    """``rows`` with a column for each result, in the order of ``order`` (unique within ``key``).

    A result is (SUM, c): the sum of c up to the row, (LAST, c): the last c that is not null up to the row, or (PREVIOUS, c): the
    same before the row. With ``cell``, a column that never falls in this order, the rows are scanned by cells; they are
    written once, as they are read twice.
    """
    key, order = list(key), list(order)
    if cell is None:
        return rows.withColumns(_within(Window.partitionBy(*key).orderBy(*order), results))
    columns = [c for c in rows.columns if c not in results]
    held = {f"_v{i}": c for i, (_, c) in enumerate(results.values())}
    rows = settled(rows.withColumns({"_cell": cell, **held}))
    carried = {n: F.coalesce(F.sum(n), F.lit(0)) if kind == SUM else F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*order))) for n, (kind, _) in zip(held, results.values(), strict=True)}
    ends = rows.groupBy(*key, "_cell").agg(*[c.alias(n) for n, c in carried.items()])
    before = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*key, "_cell", *[(F.coalesce(F.sum(n).over(before), F.lit(0)) if kind == SUM else F.last(n, ignorenulls=True).over(before)).alias(f"{n}_before") for n, (kind, _) in zip(held, results.values(), strict=True)])
    inner = {name: (kind, F.col(n)) for n, (name, (kind, _)) in zip(held, results.items(), strict=True)}
    rows = rows.withColumns(_within(Window.partitionBy(*key, "_cell").orderBy(*order), inner))
    # null keys are keys like others
    keys = {f"_k{i}": k for i, k in enumerate([*key, "_cell"])}
    ends = ends.withColumnsRenamed({k: n for n, k in keys.items()})
    rows = rows.join(ends.hint("merge"), [F.col(k).eqNullSafe(F.col(n)) for n, k in keys.items()])
    whole = {}
    for n, (name, (kind, _)) in zip(held, results.items(), strict=True):
        whole[name] = F.col(name) + F.col(f"{n}_before") if kind == SUM else F.coalesce(name, F.col(f"{n}_before"))
    return rows.withColumns(whole).select(*columns, *results)


def _within(order: Window, results: Mapping[str, tuple[str, Column]]) -> dict[str, Column]:
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    over = {SUM: lambda c: F.coalesce(F.sum(c).over(so_far), F.lit(0)), LAST: lambda c: F.last(c, ignorenulls=True).over(so_far), PREVIOUS: lambda c: F.last(c, ignorenulls=True).over(earlier)}
    return {name: over[kind](c) for name, (kind, c) in results.items()}


def any_long(pages: DataFrame, limit: int = LONG) -> bool:
    """Whether a document of ``pages`` has more than ``limit`` characters: one number comes to the driver."""
    longest = pages.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0]
    return (longest or 0) > limit

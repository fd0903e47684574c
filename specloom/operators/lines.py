"""Pages to classified lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import text as T
from specloom.operators.domains import Domains
from specloom.operators.scans import SUM, in_cells, scan

EDGE = 3  # lines at either end of a page where page numbers and running headers are looked for


def explode_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line_idx, n_lines, raw: the lines of every page with text."""
    parts = F.split("text", "\n", -1)
    rows = pages.filter("text IS NOT NULL AND text <> ''").select("doc_id", "page_number", F.size(parts).alias("n_lines"), F.posexplode(parts).alias("line_idx", "raw"))
    return rows.select("doc_id", "page_number", "line_idx", "n_lines", "raw")


def clean_lines(lines: DataFrame, headers: Sequence[str] | Domains = ()) -> DataFrame:
    """The lines without page numbers and running headers at page edges; headings always stay. Headers are given, or those of each document's domain."""
    line = T.strip(F.col("raw"))
    edge = (F.col("line_idx") < EDGE) | (F.col("line_idx") >= F.col("n_lines") - EDGE)
    header = F.lit(False)
    if isinstance(headers, Domains):
        # a domain's headers are few; they come to a line as one array
        each = headers.assign(lines).join(headers.of_kind("header", "word").groupBy("domain").agg(F.collect_set("word").alias("_headers")), "domain", "left")
        lines, columns = each, lines.columns
        header = F.exists(F.coalesce("_headers", F.array(*map(F.lit, T.DEFAULT_HEADERS))), lambda h: F.contains(F.lower(line), h))
    else:
        columns = lines.columns
        for h in headers or T.DEFAULT_HEADERS:
            header = header | F.contains(F.lower(line), F.lit(h.lower()))
    dropped = (line != "") & ~line.rlike(T.HEADING) & edge & (line.rlike(T.PAGE_NUMBER) | header)
    return lines.withColumn("line", line).filter(~dropped).select(*columns, "line")


def classify_lines(lines: DataFrame, demoted: DataFrame | None = None, long: bool = False) -> DataFrame:
    """doc_id, page_number, line_idx, line, kind, g1, g2, cid, line_no.

    cid numbers the heading candidates of a document from 1; ``demoted`` (doc_id, cid) turns some of them
    into table rows or text. line_no numbers a document's lines from 1. long: documents are scanned by cells of a page.
    """
    rows = lines.withColumn("kind", T.line_kind(F.col("line")))
    is_heading = F.col("kind") == "heading"
    counts = {"line_no": (SUM, F.lit(1).cast("long")), "cid": (SUM, is_heading.cast("int"))}
    rows = scan(rows, ["doc_id"], ["page_number", "line_idx"], counts, F.struct("page_number", in_cells("line_idx")) if long else None)
    rows = rows.withColumn("cid", F.when(is_heading, F.col("cid")).otherwise(0).cast("int"))
    if demoted is not None:
        wrong = demoted.select("doc_id", "cid", F.lit(True).alias("_wrong")).distinct()
        other = F.when(T.is_table_row(F.col("line")), "table_row").otherwise("text")
        rows = rows.join(wrong, ["doc_id", "cid"], "left").withColumn("kind", F.when(F.col("_wrong"), other).otherwise(F.col("kind"))).drop("_wrong")
    pattern = {"heading": T.HEADING, "list_item": T.LIST}
    group = lambda n: F.when(F.col("kind") == "heading", F.regexp_extract("line", pattern["heading"], n)).when(F.col("kind") == "list_item", F.regexp_extract("line", pattern["list_item"], n))
    return rows.select("doc_id", "page_number", "line_idx", "line", "kind", group(1).alias("g1"), group(2).alias("g2"), "cid", "line_no")


def sample_text(pages: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and the text of its first ``n`` pages, joined by line ends."""
    order = Window.partitionBy("doc_id").orderBy("page_number")
    first = pages.filter("text IS NOT NULL AND text <> ''").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n)
    rows = F.array_sort(F.collect_list(F.struct("_n", "text")))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("sample"))

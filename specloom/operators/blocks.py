"""Classified lines to blocks, sections and outlines. Everything is a window or a grouped sum within a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import text as T
from specloom.operators.scans import LAST, PREVIOUS, SUM, in_cells, scan

ROOT = "Document Root"


def block_lines(lines: DataFrame, long: bool = False) -> DataFrame:
    """The non-empty lines with block_no: whether a line opens a block depends on its kind and the line before it."""
    place = ["doc_id"], ["line_no"]
    cell = in_cells("line_no") if long else None
    lines = scan(lines, *place, {"_before": (PREVIOUS, F.col("kind"))}, cell)
    before = F.col("_before")
    opens = F.col("kind").isin("heading", "list_item") | ((F.col("kind") == "table_row") & ~before.eqNullSafe(F.lit("table_row")))
    opens = opens | ((F.col("kind") == "text") & F.coalesce(before.isin("empty", "heading", "table_row"), F.lit(True)))
    rows = scan(lines, *place, {"block_no": (SUM, opens.cast("int"))}, cell)
    return rows.withColumn("block_no", F.col("block_no").cast("int")).filter("kind <> 'empty'").drop("_before")


def assemble(lines: DataFrame, long: bool = False) -> DataFrame:
    """doc_id, block_no, id, type, text, page_number, prefix, rows, number, title."""
    line = F.when(F.col("kind") == "heading", F.concat_ws(" ", "g1", "g2")).when(F.col("kind") == "list_item", F.col("g2")).otherwise(F.col("line"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"), line.alias("t"))))
    rows = block_lines(lines, long).groupBy("doc_id", "block_no").agg(
        F.min_by(F.struct("kind", "page_number", "g1", "g2"), "line_no").alias("f"), F.transform(parts, lambda p: p["t"]).alias("parts"))
    kind = F.when(F.col("f.kind") == "table_row", "table").when(F.col("f.kind") == "text", "paragraph").otherwise(F.col("f.kind"))
    text = F.when(kind == "table", F.array_join("parts", "\n")).when(kind == "heading", F.array_join("parts", " ")).otherwise(T.squeeze(F.array_join("parts", " ")))
    return rows.select(
        "doc_id", "block_no", F.format_string("BLK-%04d", "block_no").alias("id"), kind.alias("type"), text.alias("text"), F.col("f.page_number").alias("page_number"),
        F.when(kind == "list_item", F.col("f.g1")).alias("prefix"), F.when(kind == "table", F.col("parts")).alias("rows"),
        F.when(kind == "heading", F.col("f.g1")).alias("number"), F.when(kind == "heading", F.col("f.g2")).alias("title"),
    )


def headings(blocks: DataFrame) -> DataFrame:
    """doc_id, block_no, number, title, norm, depth of the heading blocks."""
    h = blocks.filter("type = 'heading'").select("doc_id", "block_no", "number", "title", T.normal_section(F.col("number")).alias("norm"))
    return h.withColumn("depth", F.size(F.split("norm", r"\.")))


def _prefixes(h: DataFrame, long: bool = False) -> DataFrame:
    """One row for each heading and prefix of its number: level, prefix, and the same level of the heading before it."""
    parts = F.split("norm", r"\.")
    h = h.withColumn("_all", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda j: F.array_join(F.slice(parts, 1, j), ".")))
    h = scan(h, ["doc_id"], ["block_no"], {"_before": (PREVIOUS, F.struct("_all"))}, in_cells("block_no") if long else None).withColumn("_before", F.col("_before._all"))
    rows = h.select("*", F.posexplode("_all").alias("_j", "prefix"))
    return rows.withColumn("level", F.col("_j") + 1).withColumn("_fresh", F.coalesce(F.get("_before", F.col("_j")) != F.col("prefix"), F.lit(True)).cast("int")).drop("_all", "_before", "_j")


def hierarchy(blocks: DataFrame, long: bool = False) -> DataFrame:
    """doc_id, block_no, parents, context of every heading: the numbers and titles of its active ancestors; context ends with its own title.

    An ancestor is active while all headings since it stand at or below it: they share its prefix, so
    they form one unbroken run at its level.
    """
    h = headings(blocks)
    cell = in_cells("block_no") if long else None
    rows = scan(_prefixes(h, long), ["doc_id", "level"], ["block_no"], {"_run": (SUM, F.col("_fresh"))}, cell)
    own = F.when(F.col("depth") == F.col("level"), F.struct("number", "title"))
    rows = scan(rows, ["doc_id", "level", "_run"], ["block_no"], {"_active": (PREVIOUS, own)}, cell)
    kept = F.array_sort(F.collect_list(F.when((F.col("level") < F.col("depth")) & F.col("_active").isNotNull(), F.struct("level", "_active"))))
    out = rows.groupBy("doc_id", "block_no").agg(kept.alias("_k"), F.first("title").alias("_t"))
    return out.select("doc_id", "block_no", F.transform("_k", lambda k: k["_active"]["number"]).alias("parents"), F.concat(F.transform("_k", lambda k: k["_active"]["title"]), F.array("_t")).alias("context"))


def with_sections(blocks: DataFrame, long: bool = False) -> DataFrame:
    """``blocks`` with section_number, parent_hierarchy, heading_context and heading_no, carried forward from the last heading."""
    joined = blocks.join(hierarchy(blocks, long), ["doc_id", "block_no"], "left")
    heading = F.when(F.col("type") == "heading", F.struct("number", "parents", "context", "block_no"))
    joined = scan(joined, ["doc_id"], ["block_no"], {"_s": (LAST, heading)}, in_cells("block_no") if long else None)
    return joined.select(
        *blocks.columns, F.coalesce("_s.number", F.lit("0.0")).alias("section_number"), F.coalesce("_s.parents", F.array().cast("array<string>")).alias("parent_hierarchy"),
        F.coalesce("_s.context", F.array(F.lit(ROOT))).alias("heading_context"), F.col("_s.block_no").alias("heading_no"),
    )


def outline(blocks: DataFrame) -> DataFrame:
    """doc_id, sec_ord, parent_ord, section, title: each heading under the latest heading ever seen with its longest seen prefix (null: root)."""
    rows = _prefixes(headings(blocks))
    seen = Window.partitionBy("doc_id", "prefix").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_seen", F.last(F.when(F.col("depth") == F.col("level"), F.col("block_no")), ignorenulls=True).over(seen))
    parent = F.max(F.when((F.col("level") < F.col("depth")) & F.col("_seen").isNotNull(), F.struct("level", "_seen")))
    text = F.concat_ws(" ", "number", "title")
    title = F.array_join(F.slice(F.split(text, f"{T.WS}+"), 2, 1_000_000), " ")
    return rows.groupBy("doc_id", F.col("block_no").alias("sec_ord")).agg(parent.alias("_p"), F.first("number").alias("section"), F.first(title).alias("title")).select("doc_id", "sec_ord", F.col("_p._seen").alias("parent_ord"), "section", "title")


def outline_paths(tree: DataFrame) -> DataFrame:
    """``tree`` with path: the sec_ords from the root down. A parent's number is a proper prefix, so the longest number bounds the rounds."""
    depth = tree.agg(F.max(F.size(F.split("section", r"\.")))).first()[0] or 0
    out = tree.withColumn("path", F.array("sec_ord")).withColumn("_up", F.col("parent_ord"))
    up = tree.select("doc_id", F.col("sec_ord").alias("_up"), F.col("parent_ord").alias("_next"))
    for _ in range(depth):
        out = out.join(up, ["doc_id", "_up"], "left").withColumn("path", F.when(F.col("_up").isNotNull(), F.concat(F.array("_up"), "path")).otherwise(F.col("path"))).drop("_up").withColumnRenamed("_next", "_up")
    return out.drop("_up")


def markdown(blocks: DataFrame) -> DataFrame:
    """doc_id and markdown: depth first, a section's own blocks before its subsections, an empty part after each section of the
    first level; blocks before the first heading are left out."""
    tree = outline_paths(outline(blocks))
    nodes = tree.select("doc_id", F.col("sec_ord").alias("heading_no"), "path", "title", "section")
    level = F.least(F.size("path"), F.lit(6))
    own = nodes.select("doc_id", F.col("path").alias("key"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.concat_ws(" ", "section", "title"), F.lit("\n")).alias("piece"))
    rows = with_sections(blocks).filter("type <> 'heading' AND heading_no IS NOT NULL").join(nodes.select("doc_id", "heading_no", "path"), ["doc_id", "heading_no"])
    piece = F.when(F.col("type") == "list_item", F.concat(F.coalesce("prefix", F.lit("-")), F.lit(" "), "text", F.lit("\n"))).when(F.col("type") == "table", F.concat(F.lit("```\n"), "text", F.lit("\n```\n"))).otherwise(F.concat("text", F.lit("\n")))
    content = rows.select("doc_id", F.concat("path", F.array(F.lit(0), F.col("block_no"))).alias("key"), piece.alias("piece"))
    pieces = F.array_sort(F.collect_list(F.struct("key", "piece")))
    apart = nodes.filter(F.size("path") == 1).select("doc_id", F.concat("path", F.array(F.lit(2**31 - 1))).alias("key"), F.lit("\n").alias("piece"))
    return own.unionByName(content).unionByName(apart).groupBy("doc_id").agg(T.strip(F.array_join(F.transform(pieces, lambda p: p["piece"]), "\n")).alias("markdown"))

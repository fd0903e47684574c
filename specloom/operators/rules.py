"""Blocks to normative sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.functions import text as T
from specloom.operators.scans import LAST, SUM, in_cells, scan


def block_sentences(blocks: DataFrame) -> DataFrame:
    """``blocks`` with one row for each sentence: sent_idx and sentence."""
    return blocks.select("*", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence"))


def valid_sections(blocks: DataFrame, long: bool = False) -> DataFrame:
    """``blocks`` with rule_section: the last section that is neither blank nor 0.0, in block order; UNKNOWN before any."""
    good = F.when(~F.trim("section_number").isin("", "0.0"), F.col("section_number"))
    rows = scan(blocks, ["doc_id"], ["block_no"], {"rule_section": (LAST, good)}, in_cells("block_no") if long else None)
    return rows.withColumn("rule_section", F.coalesce("rule_section", F.lit("UNKNOWN")))


def mine(blocks: DataFrame, long: bool = False) -> DataFrame:
    """The requirement ledger: doc_id, rule_ord, id, section_number, parent_hierarchy, heading_context, constraint_type, all_matched_constraints, text, source_block_id, page_number."""
    rows = block_sentences(valid_sections(blocks, long)).withColumn("all_matched_constraints", T.modal_types(F.col("sentence"))).filter(F.size("all_matched_constraints") > 0)
    rows = scan(rows, ["doc_id"], ["block_no", "sent_idx"], {"rule_ord": (SUM, F.lit(1))}, F.struct(in_cells("block_no")) if long else None)
    rows = rows.withColumn("rule_ord", F.col("rule_ord").cast("int"))
    return rows.select(
        "doc_id", "rule_ord", F.format_string("REQ-%03d", "rule_ord").alias("id"), F.col("rule_section").alias("section_number"), "parent_hierarchy", "heading_context",
        F.col("all_matched_constraints")[0].alias("constraint_type"), "all_matched_constraints", F.col("sentence").alias("text"), F.col("id").alias("source_block_id"), "page_number",
    )


def implicit_candidates(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Paragraphs and list items that gave no rule but speak of an obligation."""
    found = rules.select("doc_id", F.col("source_block_id").alias("id")).distinct()
    return blocks.filter(F.col("type").isin("paragraph", "list_item") & F.col("text").rlike(T.OBLIGATION)).join(found, ["doc_id", "id"], "left_anti")


def without(rules: DataFrame, removed: DataFrame) -> DataFrame:
    """``rules`` less the (doc_id, id) in ``removed``; ids are not dealt anew."""
    return rules.join(removed.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti")

"""Steps that a language model may help with. The model is any function from a list of prompts to a list of replies (null: none)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions.vocabulary import Domain
from specloom.operators import domains as D
from specloom.operators.domains import Domains

Model = Callable[[list[str]], list[str | None]]
TYPES = ("Mandatory", "Prohibition", "Recommendation", "Permission")
HEADINGS, IMPLICIT, TABULAR, BOILERPLATE, TERMS, EDGES, CONFLICTS = 100, 8, 5, 100, 120, 15, 15  # rows of a document in one prompt


def batched(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """``rows`` with batch: each document's rows in order, ``size`` to a batch."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("int"))


def prompts(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """doc_id, batch, prompt: the batch's rows as a JSON array of the columns asked for."""
    item = F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("_row"))))
    return rows.groupBy("doc_id", "batch").agg(F.to_json(F.transform(item, lambda x: x["_row"])).alias("prompt"))


def ask(asked: DataFrame, model: Model | None) -> DataFrame:
    """``asked`` (doc_id, batch, prompt) with reply; without a model all replies are null."""
    if model is None:
        return asked.withColumn("reply", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model(batch.column("prompt").to_pylist()), pa.string())], [*batch.schema.names, "reply"])

    schema = asked.select("doc_id", "batch", "prompt").schema.add("reply", "string")
    return asked.select("doc_id", "batch", "prompt").mapInArrow(run, schema)


def unfenced(reply: Column) -> Column:
    """A reply without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?\s*", ""), r"\s*```\z", ""))


def items(replies: DataFrame, schema: str) -> DataFrame:
    """One row for each element of the replies' JSON arrays; anything else gives none."""
    return replies.select("doc_id", "batch", F.posexplode(F.from_json(unfenced(F.col("reply")), f"array<{schema}>")).alias("pos", "item"))


def until_silence(replies: DataFrame) -> DataFrame:
    """The batches before a document's first null reply."""
    before = Window.partitionBy("doc_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return replies.withColumn("_null", F.sum(F.col("reply").isNull().cast("int")).over(before)).filter("_null = 0").drop("_null")


def new_rules(replies: DataFrame, asked: DataFrame, rules: DataFrame, stop_at_null: bool = True) -> DataFrame:
    """Rules that the replies name, numbered on from the document's last: a block of the same batch, a known type and a text are asked for.

    asked: doc_id, batch, id, section_number, page_number. Elements are {block_id, constraint_type, text}.
    """
    got = items(until_silence(replies) if stop_at_null else replies, "struct<block_id:string,constraint_type:string,text:string>").select("doc_id", "batch", "pos", "item.*")
    good = got.filter(F.col("constraint_type").isin(*TYPES) & (F.trim("text") != "")).withColumnRenamed("block_id", "source_block_id")
    home = asked.select("doc_id", "batch", F.col("id").alias("source_block_id"), F.coalesce(F.nullif("section_number", F.lit("")), F.lit("UNKNOWN")).alias("section_number"), "page_number")
    rows = good.join(home, ["doc_id", "batch", "source_block_id"])
    last = rules.groupBy("doc_id").agg(F.max("rule_ord").alias("_last"))
    order = Window.partitionBy("doc_id").orderBy("batch", "pos")
    rows = rows.join(last, "doc_id", "left").withColumn("rule_ord", F.coalesce("_last", F.lit(0)) + F.row_number().over(order))
    return rows.select("doc_id", "rule_ord", F.format_string("REQ-%03d", "rule_ord").alias("id"), "section_number", "constraint_type", F.trim("text").alias("text"), "source_block_id", "page_number")


def tabular_rules(replies: DataFrame, asked: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that replies about tables name, numbered on from the document's last; a batch without a reply is passed over.

    asked: doc_id, batch, id, section_number, parent_hierarchy, heading_context, page_number. Elements are
    {blockId, constraintType, requirementText}; a block of the same batch, a known type and a text are asked for.
    """
    got = items(replies, "struct<blockId:string,constraintType:string,requirementText:string>").select("doc_id", "batch", "pos", "item.*")
    good = got.filter(F.col("constraintType").isin(*TYPES) & (F.col("requirementText") != ""))
    home = asked.select("doc_id", "batch", F.col("id").alias("blockId"), F.coalesce(F.nullif("section_number", F.lit("")), F.lit("UNKNOWN")).alias("section_number"), "parent_hierarchy", "heading_context", "page_number")
    last = rules.groupBy("doc_id").agg(F.max("rule_ord").alias("_last"))
    order = Window.partitionBy("doc_id").orderBy("batch", "pos")
    rows = good.join(home, ["doc_id", "batch", "blockId"]).join(last, "doc_id", "left").withColumn("rule_ord", F.coalesce("_last", F.lit(0)) + F.row_number().over(order))
    return rows.select("doc_id", "rule_ord", F.format_string("REQ-%03d", "rule_ord").alias("id"), "section_number", "parent_hierarchy", "heading_context", F.col("constraintType").alias("constraint_type"), F.array(F.lit("LLM_TABULAR_EXTRACTED")).alias("all_matched_constraints"), F.col("requirementText").alias("text"), F.col("blockId").alias("source_block_id"), "page_number")


def false_headings(replies: DataFrame) -> DataFrame:
    """doc_id, cid: the numbers of heading candidates that replies list."""
    return items(replies, "int").filter("item IS NOT NULL").select("doc_id", F.col("item").alias("cid")).distinct()


def inferred_domains(replies: DataFrame) -> DataFrame:
    """doc_id, name, terms, headers, role: the domain that a reply describes; a reply without a name and a list of terms gives none."""
    reply = F.from_json(unfenced(F.col("reply")), "domainName string, curatedTerms array<string>, cleanHeaders array<string>, roleDescription string")
    rows = replies.select("doc_id", reply.alias("r")).select("doc_id", "r.*").filter("domainName IS NOT NULL AND domainName <> '' AND curatedTerms IS NOT NULL")
    words = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return rows.select("doc_id", F.col("domainName").alias("name"), F.array_distinct(words(F.col("curatedTerms"))).alias("terms"), F.coalesce("cleanHeaders", F.array().cast("array<string>")).alias("headers"), F.coalesce("roleDescription", F.lit("")).alias("role"))


def named_ids(replies: DataFrame) -> DataFrame:
    """doc_id, id: the ids that replies list (boilerplate rules, false headings)."""
    return items(replies, "string").select("doc_id", F.col("item").alias("id")).distinct()


def model_terms(replies: DataFrame, domain: Domain | Domains) -> DataFrame:
    """doc_id, term, pos: terms of three letters or more that replies list, lower case, without the domain's actors, each at its first place."""
    d = D.table(replies.sparkSession, domain)
    rows = items(replies, "string").select("doc_id", F.lower(F.trim("item")).alias("term"), F.struct("batch", "pos").alias("pos"))
    return d.without(d.assign(rows.filter(F.length("term") >= 3)), "actor", "term").groupBy("doc_id", "term").agg(F.min("pos").alias("pos"))


def edge_changes(replies: DataFrame, allowed: tuple[str, ...] = ("REFERENCES", "IMPLEMENTS", "DEPENDS_ON", "SUPERSEDES")) -> DataFrame:
    """doc_id, batch, pos, source, target, new_type from replies of {source, target, type}."""
    rows = items(replies, "struct<source:string,target:string,type:string>").select("doc_id", "batch", "pos", "item.source", "item.target", F.col("item.type").alias("new_type"))
    return rows.filter(F.col("new_type").isin(*allowed))


def judged_conflicts(pairs: DataFrame, replies: DataFrame) -> DataFrame:
    """The pairs that replies of {source, target} confirm."""
    yes = items(replies, "struct<source:string,target:string>").select("doc_id", "item.source", "item.target").distinct()
    return pairs.join(yes, ["doc_id", "source", "target"], "left_semi")

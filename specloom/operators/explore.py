"""Questions that a viewer of the graph asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import text as T


def projected(nodes: DataFrame) -> DataFrame:
    """doc_id, id, grp, label, tooltip: how a node is shown."""
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    return nodes.select("doc_id", "id", F.col("label").alias("grp"), F.when(F.col("label") == "Requirement", F.col("id")).otherwise(first("title", "name", "id")).alias("label"), first("text", "title", "name", "id").alias("tooltip"))


def parents(edges: DataFrame) -> DataFrame:
    """doc_id, id, parent, edge_ord: the section above each section; the last edge counts."""
    inside = edges.filter((F.col("type") == "CONTAINS") & F.startswith("source", F.lit("SEC-")) & F.startswith("target", F.lit("SEC-")))
    return inside.groupBy("doc_id", F.col("target").alias("id")).agg(F.max_by(F.struct(F.col("source").alias("parent"), "edge_ord"), "edge_ord").alias("p")).select("doc_id", "id", "p.parent", "p.edge_ord")


def section_chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, section, chain: for each section itself and the sections above it, nearest first, each as (id, edge_ord of the edge into it).

    Containment follows section numbers, so what may stand above a section are the prefixes of its number: they are joined
    once, for all depths together, and the chain goes as far as each prefix is the parent of the one before.
    """
    sections = nodes.filter("label = 'Section'").select("doc_id", F.col("id").alias("section"), F.split("section_number", r"\.").alias("_p"))
    levels = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda j: F.struct(j.alias("j"), F.concat(F.lit("SEC-"), F.array_join(F.slice("_p", 1, j), ".")).alias("id")))
    rows = sections.select("doc_id", "section", F.inline(levels)).join(parents(edges), ["doc_id", "id"], "left")
    up = F.array_sort(F.collect_list(F.struct((-F.col("j")).alias("j"), "id", "parent", "edge_ord")))
    every = rows.groupBy("doc_id", "section").agg(up.alias("_up"))
    linked = F.transform("_up", lambda x, i: F.coalesce(x["parent"] == F.get("_up", i + 1)["id"], F.lit(False)))
    chain = F.slice("_up", 1, F.array_position(linked, False).cast("int"))  # the last one is never linked
    return every.select("doc_id", "section", F.transform(chain, lambda x: F.struct(x["id"].alias("id"), x["edge_ord"].alias("edge_ord"))).alias("chain"))


def first_sections(edges: DataFrame) -> DataFrame:
    """doc_id, id, section: the first section that contains each requirement."""
    inside = edges.filter((F.col("type") == "CONTAINS") & F.startswith("target", F.lit("REQ-")))
    return inside.groupBy("doc_id", F.col("target").alias("id")).agg(F.min_by("source", "edge_ord").alias("section"))


def section_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, id, path: from the root section down to each requirement's section, joined by " > "."""
    rows = first_sections(edges).join(section_chains(nodes, edges), ["doc_id", "section"])
    return rows.select("doc_id", "id", F.array_join(F.reverse(F.transform("chain", lambda x: x["id"])), " > ").alias("path"))


def relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, id, bucket, neighbor, edge_ord: every edge seen from both ends, sorted into eight buckets."""
    label = nodes.select("doc_id", F.col("id").alias("neighbor"), F.col("label").alias("grp"))
    out = edges.select("doc_id", F.col("source").alias("id"), F.col("target").alias("neighbor"), "type", "edge_ord", F.lit("out").alias("way"))
    into = edges.select("doc_id", F.col("target").alias("id"), F.col("source").alias("neighbor"), "type", "edge_ord", F.lit("in").alias("way"))
    rows = out.unionByName(into).join(label, ["doc_id", "neighbor"])
    kind, way, grp = F.col("type"), F.col("way"), F.col("grp")
    outgoing = F.when(grp == "Term", "terms").when(kind == "DEPENDS_ON", "dependsOn").when(kind == "IMPLEMENTS", "implements").when((kind == "CONFLICTS_WITH") & (grp == "Requirement"), "conflicts").otherwise("references")
    incoming = F.when(kind == "DEPENDS_ON", "requiredBy").when(kind == "IMPLEMENTS", "implementedBy").when(kind == "CONFLICTS_WITH", "conflicts").otherwise("referencedBy")
    bucket = F.when(way == "out", outgoing).when(grp == "Requirement", incoming)
    return rows.withColumn("bucket", bucket).filter("bucket IS NOT NULL").select("doc_id", "id", "bucket", "neighbor", "edge_ord")


def neighborhood(nodes: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, id, state: ``chosen`` (doc_id, id) are selected, what an edge joins to them is near, the rest dimmed."""
    c = chosen.select("doc_id", "id").distinct()
    both = edges.select("doc_id", F.col("source").alias("id"), F.col("target").alias("other")).unionByName(edges.select("doc_id", F.col("target").alias("id"), F.col("source").alias("other")))
    near = both.join(c, ["doc_id", "id"], "left_semi").select("doc_id", F.col("other").alias("id"), F.lit(1).alias("_near")).distinct()
    rows = nodes.select("doc_id", "id").join(c.withColumn("_own", F.lit(1)), ["doc_id", "id"], "left").join(near, ["doc_id", "id"], "left")
    return rows.select("doc_id", "id", F.when(F.col("_own") == 1, "selected").when(F.col("_near") == 1, "near").otherwise("dimmed").alias("state"))


def edge_states(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, edge_ord, state: edges that begin or end at ``chosen`` (doc_id, id) are highlighted, the rest dimmed."""
    c = chosen.select("doc_id", "id").distinct()
    ends = [c.select("doc_id", F.col("id").alias(end), F.lit(True).alias(f"_{end}")) for end in ("source", "target")]
    rows = edges.select("doc_id", "edge_ord", "source", "target").join(ends[0], ["doc_id", "source"], "left").join(ends[1], ["doc_id", "target"], "left")
    return rows.select("doc_id", "edge_ord", F.when(F.col("_source") | F.col("_target"), "highlighted").otherwise("dimmed").alias("state"))


def children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, id, kind, child, pos: each section's subsections and requirements, in section or number order."""
    inside = edges.filter("type = 'CONTAINS'").select("doc_id", F.col("source").alias("id"), F.col("target").alias("child"))
    kind = F.when(F.startswith("child", F.lit("SEC-")), "section").otherwise("requirement")
    number = F.regexp_replace("child", "^(SEC|REQ)-", "")
    order = Window.partitionBy("doc_id", "id", "kind").orderBy(T.section_key(number), "child")
    return inside.withColumn("kind", kind).withColumn("pos", F.row_number().over(order)).select("doc_id", "id", "kind", "child", "pos")


def terms_by_section(edges: DataFrame) -> DataFrame:
    """doc_id, term, section, n: rules that mention a term, by the first section that contains them."""
    uses = edges.filter(F.startswith("target", F.lit("TERM-"))).select("doc_id", F.col("target").alias("term"), F.col("source").alias("id")).distinct()
    return uses.join(first_sections(edges), ["doc_id", "id"], "left").groupBy("doc_id", "term", F.coalesce("section", F.lit("unknown")).alias("section")).agg(F.count("*").alias("n"))


def containing(nodes: DataFrame, query: str) -> DataFrame:
    """The nodes that hold the words anywhere in name, title, text, id or section number, without regard to case."""
    q = F.lit(query.lower())
    hit = F.lit(False)
    for c in ("name", "title", "text", "id", "section_number"):
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), q)
    return nodes.filter(hit)


def result_tree(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """doc_id, id, parent, matched: what matches and every section above it; a parent outside the set is null."""
    hits = containing(nodes, query).select("doc_id", "id")
    own = hits.filter(F.startswith("id", F.lit("SEC-"))).withColumn("section", F.col("id"))
    under = hits.join(first_sections(edges), ["doc_id", "id"])
    above = own.unionByName(under).select("doc_id", "section").distinct().join(section_chains(nodes, edges), ["doc_id", "section"])
    above = above.select("doc_id", F.explode(F.transform("chain", lambda x: x["id"])).alias("id")).distinct()
    every = hits.unionByName(above).distinct()
    up = parents(edges).drop("edge_ord").unionByName(first_sections(edges).withColumnRenamed("section", "parent"))
    rows = every.join(up, ["doc_id", "id"], "left").join(every.select("doc_id", F.col("id").alias("parent"), F.lit(True).alias("_in")), ["doc_id", "parent"], "left")
    rows = rows.join(hits.select("doc_id", "id", F.lit(True).alias("_hit")).distinct(), ["doc_id", "id"], "left")
    return rows.select("doc_id", "id", F.when(F.col("_in"), F.col("parent")).alias("parent"), F.coalesce("_hit", F.lit(False)).alias("matched"))

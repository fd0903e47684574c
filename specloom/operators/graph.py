"""The graph of sections, requirements and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import text as T
from specloom.functions.vocabulary import Domain
from specloom.operators import domains as D
from specloom.operators.domains import Domains
from specloom.operators.scans import SUM, in_cells, scan

TERM_EDGES = ("REFERENCES", "CONSTRAINS", "RECOMMENDS", "PERMITS")


def section_numbers(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, section, sec_ord: every normal section number of blocks, rules and their parents, in section order."""
    found = [d.select("doc_id", F.col("section_number").alias("s")) for d in (blocks, rules)] + [d.select("doc_id", F.explode("parent_hierarchy").alias("s")) for d in (blocks, rules)]
    rows = found[0]
    for d in found[1:]:
        rows = rows.unionByName(d)
    rows = rows.select("doc_id", T.normal_section(F.col("s")).alias("section")).distinct().filter("section NOT IN ('', 'UNKNOWN')")
    return rows.withColumn("sec_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(T.section_key(F.col("section")))))


def section_nodes(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, sec_ord, section, id, title: the title of the last heading with the number, or "Section n"."""
    titles = blocks.filter("type = 'heading'").groupBy("doc_id", T.normal_section(F.col("number")).alias("section")).agg(F.max_by("title", "block_no").alias("t"))
    rows = section_numbers(blocks, rules).join(titles, ["doc_id", "section"], "left")
    return rows.select("doc_id", "sec_ord", "section", F.concat(F.lit("SEC-"), "section").alias("id"), F.coalesce("t", F.concat(F.lit("Section "), "section")).alias("title"))


def section_contains(sections: DataFrame) -> DataFrame:
    """doc_id, source, target, ord: each section under its immediate parent, where there is one."""
    parent = F.when(F.contains("section", F.lit(".")), F.regexp_replace("section", r"\.[^.]*$", ""))
    child = sections.select("doc_id", parent.alias("_p"), F.col("id").alias("target"), F.col("sec_ord").alias("ord"))
    return child.join(sections.select("doc_id", F.col("section").alias("_p"), F.col("id").alias("source")), ["doc_id", "_p"]).select("doc_id", "source", "target", "ord")


def rule_contains(sections: DataFrame, rules: DataFrame) -> DataFrame:
    """doc_id, source, target, rule_ord: each rule under its section node; rules of unknown sections stand alone."""
    r = rules.select("doc_id", "rule_ord", F.col("id").alias("target"), T.normal_section(F.col("section_number")).alias("section"))
    return r.join(sections.select("doc_id", "section", F.col("id").alias("source")), ["doc_id", "section"]).select("doc_id", "source", "target", "rule_ord")


def term_edge_type(kind: Column) -> Column:
    return F.when(kind.isin("Mandatory", "Prohibition"), "CONSTRAINS").when(kind == "Recommendation", "RECOMMENDS").when(kind == "Permission", "PERMITS").otherwise("REFERENCES")


def term_edges(rules: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc_id, source, target, type, rule_ord, pos: rule to term, typed by the rule's constraint."""
    r = rules.select("doc_id", "rule_ord", "id", "constraint_type")
    return mentions.join(r, ["doc_id", "rule_ord"]).select("doc_id", F.col("id").alias("source"), F.concat(F.lit("TERM-"), "term").alias("target"), term_edge_type(F.col("constraint_type")).alias("type"), "rule_ord", F.col("term_ord").alias("pos"))


def section_refs(rules: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, source, target, type, rule_ord, pos: every reference to a section that exists, repeats included."""
    refs = rules.select("doc_id", "rule_ord", "id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(T.SECTION_REF), F.lit(1))).alias("pos", "ref"))
    refs = refs.withColumn("section", T.normal_section(F.col("ref"))).join(sections.select("doc_id", "section", F.col("id").alias("target")), ["doc_id", "section"])
    kind = F.when(F.col("text").rlike(T.IMPLEMENTS_CUE), "IMPLEMENTS").when(F.col("text").rlike(T.DEPENDS_CUE), "DEPENDS_ON").otherwise("REFERENCES")
    return refs.select("doc_id", F.col("id").alias("source"), "target", kind.alias("type"), "rule_ord", "pos")


def requirement_refs(rules: DataFrame) -> DataFrame:
    """doc_id, source, target, type, rule_ord, pos: every reference to another requirement, whether or not it exists."""
    refs = rules.select("doc_id", "rule_ord", "id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(T.REQUIREMENT_REF), F.lit(1))).alias("pos", "target")).filter("target <> id")
    kind = F.when(F.col("text").rlike(T.REQ_DEPENDS_CUE), "DEPENDS_ON").when(F.col("text").rlike(T.SUPERSEDES_CUE), "SUPERSEDES").otherwise("REFERENCES")
    return refs.select("doc_id", F.col("id").alias("source"), "target", kind.alias("type"), "rule_ord", "pos")


def conflicts(rules: DataFrame, mentions: DataFrame, domain: Domain | Domains) -> DataFrame:
    """doc_id, source, target, shared_term, term_ord, a, b: one pair of a mandatory and a prohibiting rule for the first term that both mention.

    The two kinds are split before they are joined, so pairs of one kind are never made; actors are left out first.
    By definition there are as many pairs as mandatory times prohibiting rules of a term inside a document.
    """
    m = disputed(rules, mentions, domain)
    must = m.filter("constraint_type = 'Mandatory'").select("doc_id", "term", "term_ord", F.col("rule_ord").alias("x"))
    never = m.filter("constraint_type = 'Prohibition'").select("doc_id", "term", F.col("rule_ord").alias("y"))
    return _named_pairs(rules, must, never)


def disputed(rules: DataFrame, mentions: DataFrame, domain: Domain | Domains) -> DataFrame:
    """doc_id, rule_ord, constraint_type, term, term_ord: what mandatory and prohibiting rules mention, without actors."""
    kinds = rules.filter("constraint_type IN ('Mandatory', 'Prohibition')").select("doc_id", "rule_ord", "constraint_type")
    d = D.table(rules.sparkSession, domain)
    return d.without(d.assign(mentions), "actor", "term").join(kinds, ["doc_id", "rule_ord"]).select("doc_id", "rule_ord", "constraint_type", "term", "term_ord")


def _named_pairs(rules: DataFrame, must: DataFrame, never: DataFrame) -> DataFrame:
    """The pairs of ``must`` (doc_id, term, term_ord, x) and ``never`` (doc_id, term, y) with their ids, each for its first shared term."""
    pairs = must.join(never.hint("merge"), ["doc_id", "term"]).groupBy("doc_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min(F.struct("term_ord", "term")).alias("t"))
    name = lambda c: F.format_string("REQ-%03d", c)
    ids = rules.select("doc_id", "rule_ord", "id")
    pairs = pairs.join(ids.select("doc_id", F.col("rule_ord").alias("a"), F.col("id").alias("source")), ["doc_id", "a"]).join(ids.select("doc_id", F.col("rule_ord").alias("b"), F.col("id").alias("target")), ["doc_id", "b"])
    return pairs.select("doc_id", "source", "target", F.col("t.term").alias("shared_term"), F.col("t.term_ord").alias("term_ord"), "a", "b")


def conflict_sides(rules: DataFrame, mentions: DataFrame, domain: Domain | Domains) -> DataFrame:
    """doc_id, constraint_type, terms (term_ord, term; in order), n: the mandatory and prohibiting rules that mention the same terms, counted.

    All rules of such a class conflict with the same rules for the same terms, so conflicts can be counted from classes without
    their pairs. Classes are at most as many as rules, and never more than the sets of terms that occur.
    """
    terms = F.array_sort(F.collect_set(F.struct("term_ord", "term"))).alias("terms")
    rows = disputed(rules, mentions, domain).groupBy("doc_id", "rule_ord", "constraint_type").agg(terms)
    return rows.groupBy("doc_id", "constraint_type", "terms").agg(F.count("*").alias("n"))


def conflict_totals(rules: DataFrame, mentions: DataFrame, domain: Domain | Domains) -> DataFrame:
    """doc_id, term, term_ord, n_mandatory, n_prohibiting, n_pairs: for each term that rules of both kinds mention, how many do, and how
    many of the pairs of :func:`conflicts` have it as their shared term (0 where an earlier term takes them all).

    No pair is made: two classes share their first common term, and stand for the product of their sizes.
    """
    sides = conflict_sides(rules, mentions, domain).withColumn("t", F.explode("terms"))
    side = lambda kind, n, terms: sides.filter(F.col("constraint_type") == kind).select("doc_id", "t", F.col("n").alias(n), F.col("terms").alias(terms))
    must, never = side("Mandatory", "x", "_a"), side("Prohibition", "y", "_b")
    first = F.array_min(F.array_intersect("_a", "_b")) == F.col("t")
    pairs = must.join(never, ["doc_id", "t"]).groupBy("doc_id", "t").agg(F.sum(F.when(first, F.col("x") * F.col("y")).otherwise(0)).alias("n_pairs"))
    count = lambda rows, n, name: rows.groupBy("doc_id", "t").agg(F.sum(n).alias(name))
    rows = count(must, "x", "n_mandatory").join(count(never, "y", "n_prohibiting"), ["doc_id", "t"]).join(pairs, ["doc_id", "t"])
    return rows.select("doc_id", "t.term", "t.term_ord", "n_mandatory", "n_prohibiting", "n_pairs")


def conflicts_of(rules: DataFrame, mentions: DataFrame, domain: Domain | Domains, asked: DataFrame) -> DataFrame:
    """The rows of :func:`conflicts` that a rule of ``asked`` (doc_id, id) is in; only the pairs of those rules are made."""
    m = disputed(rules, mentions, domain)
    own = m.join(rules.join(asked.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi").select("doc_id", "rule_ord").hint("merge"), ["doc_id", "rule_ord"], "left_semi")
    must = lambda rows: rows.filter("constraint_type = 'Mandatory'").select("doc_id", "term", "term_ord", F.col("rule_ord").alias("x"))
    never = lambda rows: rows.filter("constraint_type = 'Prohibition'").select("doc_id", "term", F.col("rule_ord").alias("y"))
    found = _named_pairs(rules, must(own), never(m)).unionByName(_named_pairs(rules, must(m), never(own)))
    return found.distinct()


def _plain_edges(sections: DataFrame, rules: DataFrame, mentions: DataFrame) -> DataFrame:
    """All edges but the conflicts, with the keys p, q, r, s of their order."""
    def row(df: DataFrame, phase: int, a: Column, sub: int, b: Column, kind: Column, context: str) -> DataFrame:
        return df.select("doc_id", F.lit(phase).alias("p"), a.cast("long").alias("q"), F.lit(sub).cast("long").alias("r"), b.cast("long").alias("s"), "source", "target", kind.alias("type"), F.lit(context).alias("context"))

    zero, contains, kind = F.lit(0), F.lit("CONTAINS"), F.col("type")
    rows = row(section_contains(sections), 0, F.col("ord"), 0, zero, contains, "hierarchy")
    rows = rows.unionByName(row(rule_contains(sections, rules), 1, F.col("rule_ord"), 0, zero, contains, "hierarchy"))
    rows = rows.unionByName(row(term_edges(rules, mentions), 1, F.col("rule_ord"), 1, F.col("pos"), kind, "text_mention"))
    rows = rows.unionByName(row(section_refs(rules, sections), 1, F.col("rule_ord"), 2, F.col("pos"), kind, "explicit_section_ref"))
    return rows.unionByName(row(requirement_refs(rules), 1, F.col("rule_ord"), 3, F.col("pos"), kind, "explicit_requirement_ref"))


def edges(sections: DataFrame, rules: DataFrame, mentions: DataFrame, domain: Domain | Domains, pairs: DataFrame | None = None, long: bool = False) -> DataFrame:
    """doc_id, edge_ord, source, target, type, context, reason, shared_term: all edges in their order.

    First the sections' own, then rule by rule (container, terms, sections, requirements), then the conflicts.
    ``pairs`` stands in for :func:`conflicts` when something else has judged them.
    """
    rows = _plain_edges(sections, rules, mentions)
    found = pairs if pairs is not None else conflicts(rules, mentions, domain)
    reason = F.concat(F.lit("Opposing constraints on '"), "shared_term", F.lit("'"))
    last = found.select("doc_id", F.lit(2).alias("p"), F.col("term_ord").cast("long").alias("q"), F.col("a").cast("long").alias("r"), F.col("b").cast("long").alias("s"), "source", "target", F.lit("CONFLICTS_WITH").alias("type"), F.lit("conflict").alias("context"), reason.alias("reason"), "shared_term")
    rows = rows.unionByName(last, allowMissingColumns=True)
    # a term's conflicts are cut at every rule, other edges at ranges of sections or rules
    cell = F.struct("p", F.when(F.col("p") == 2, F.col("q")).otherwise(in_cells("q")), F.when(F.col("p") == 2, F.col("r"))) if long else None
    rows = scan(rows, ["doc_id"], ["p", "q", "r", "s"], {"edge_ord": (SUM, F.lit(1))}, cell).withColumn("edge_ord", F.col("edge_ord").cast("int"))
    return rows.select("doc_id", "edge_ord", "source", "target", "type", "context", "reason", "shared_term")


def edge_totals(sections: DataFrame, rules: DataFrame, mentions: DataFrame, domain: Domain | Domains) -> DataFrame:
    """doc_id, type, n: how many edges of each type :func:`edges` has, with conflicts counted by :func:`conflict_totals`."""
    n = _plain_edges(sections, rules, mentions).groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    c = conflict_totals(rules, mentions, domain).groupBy("doc_id", F.lit("CONFLICTS_WITH").alias("type")).agg(F.sum("n_pairs").alias("n"))
    return n.unionByName(c)


def nodes(sections: DataFrame, rules: DataFrame, terms: DataFrame, long: bool = False) -> DataFrame:
    """doc_id, node_ord, id, label, name, frequency, section_number, title, text, constraint_type, page_number: terms, sections, requirements."""
    t = terms.select("doc_id", F.lit(0).alias("p"), F.col("term_ord").alias("q"), F.concat(F.lit("TERM-"), "term").alias("id"), F.lit("Term").alias("label"), F.col("term").alias("name"), F.col("freq").alias("frequency"))
    s = sections.select("doc_id", F.lit(1).alias("p"), F.col("sec_ord").alias("q"), "id", F.lit("Section").alias("label"), F.col("section").alias("section_number"), "title")
    r = rules.select("doc_id", F.lit(2).alias("p"), F.col("rule_ord").alias("q"), "id", F.lit("Requirement").alias("label"), "section_number", "text", "constraint_type", "page_number")
    rows = t.unionByName(s, allowMissingColumns=True).unionByName(r, allowMissingColumns=True)
    rows = scan(rows, ["doc_id"], ["p", "q"], {"node_ord": (SUM, F.lit(1))}, F.struct("p", in_cells("q")) if long else None)
    return rows.withColumn("node_ord", F.col("node_ord").cast("int")).drop("p", "q")


def refinable(edges_: DataFrame) -> DataFrame:
    """The edges between requirements or from one to a section that are neither containment nor conflict."""
    able = ~F.col("type").isin("CONTAINS", "CONFLICTS_WITH") & F.startswith("source", F.lit("REQ-"))
    return edges_.filter(able & (F.startswith("target", F.lit("REQ-")) | F.startswith("target", F.lit("SEC-"))))


def refined(edges_: DataFrame, changes: DataFrame, strict: bool = False) -> DataFrame:
    """``edges_`` with the types of ``changes`` (doc_id, batch, pos, source, target, new_type) set on every edge between the same ends; the last change wins.

    strict: only on the edges that may be refined, between requirements or from one to a section, neither containment nor conflict.
    """
    c = changes.groupBy("doc_id", "source", "target").agg(F.max_by("new_type", F.struct("batch", "pos")).alias("_new"))
    able = ~F.col("type").isin("CONTAINS", "CONFLICTS_WITH") & F.startswith("source", F.lit("REQ-")) & (F.startswith("target", F.lit("REQ-")) | F.startswith("target", F.lit("SEC-")))
    new = F.when(able, F.col("_new")) if strict else F.col("_new")
    return edges_.join(c, ["doc_id", "source", "target"], "left").withColumn("type", F.coalesce(new, "type")).drop("_new")

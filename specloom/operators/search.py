"""Looking up nodes, ranking them for a question, and gathering what stands around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.functions import text as T
from specloom.functions.vocabulary import Domain
from specloom.operators import domains as D
from specloom.operators.domains import Domains
from specloom.operators.explore import section_chains
from specloom.operators.graph import TERM_EDGES
from specloom.sources.artifacts import settled

TARGETS = 3
SLOTS = {"target_requirements": "target", "structural_context": "section", "linked_rules": "requirement", "referenced_terms": "term", "potential_conflicts": "conflict"}


def each_asked(rows: DataFrame, questions: Sequence[str]) -> DataFrame:
    """``rows`` once for each question; the questions are a short list of the caller's."""
    return rows.withColumn("query", F.explode(F.array(*map(F.lit, dict.fromkeys(questions)))))


def names_of(spark: SparkSession, questions: Sequence[str]) -> DataFrame:
    """query, _p, id: the three ids that a question may stand for, in the order in which they count."""
    q = T.strip(F.col("query"))
    names = F.array(F.upper(q), F.concat(F.lit("TERM-"), F.lower(q)), F.concat(F.lit("SEC-"), T.normal_section(q)))
    return D.local(spark, [(q,) for q in dict.fromkeys(questions)], "query string").select("query", F.posexplode(names).alias("_p", "id"))


def resolve(nodes: DataFrame, questions: Sequence[str]) -> DataFrame:
    """doc_id, query, id, label, rank: the node that a question names as its id, its term or its section, in this order.

    A question has three names, which are joined with the nodes by equality.
    """
    named = names_of(nodes.sparkSession, questions)
    first = F.row_number().over(Window.partitionBy("doc_id", "query").orderBy("_p", "node_ord"))
    return nodes.join(named, "id").withColumn("rank", first).filter("rank = 1").select("doc_id", "query", "id", "label", "rank")


def question_words(question: Column) -> Column:
    return F.split(F.lower(question), r"[^a-zA-Z0-9_\-.]+")


def query_tokens(questions: Sequence[str], d: Domains) -> DataFrame:
    """domain, tokens: the words of the questions that are no stop words of the domain, each as (query, token, times)."""
    parts = question_words(T.strip(F.col("query")))
    words = each_asked(d.about.select("domain"), questions).select("domain", "query", F.explode(parts).alias("token")).filter("length(token) > 1")
    rows = d.without(words, "stop", "token").groupBy("domain", "query", "token").agg(F.count("*").cast("double").alias("times"))
    return rows.groupBy("domain").agg(F.collect_list(F.struct("query", "token", "times")).alias("tokens"))


def score(nodes: DataFrame, questions: Sequence[str], domain: Domain | Domains) -> DataFrame:
    """``nodes`` with query and score, for the questions that a node has a word of: 2 for each word that a requirement has; 4 for a section's
    number or 1.5 for its title; 3 for a term or 1 for a part of it.

    The nodes are read once for all questions, and only the pairs with a score are made.
    """
    d = D.table(nodes.sparkSession, domain)
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))

    def point(t: Column) -> Column:
        requirement = F.when(F.contains(low("text"), t), 2.0).otherwise(0.0)
        section = F.when(low("section_number") == t, 4.0).when(F.contains(low("title"), t), 1.5).otherwise(0.0)
        term = F.when(low("name") == t, 3.0).when(F.contains(low("name"), t), 1.0).otherwise(0.0)
        return F.when(F.col("label") == "Requirement", requirement).when(F.col("label") == "Section", section).otherwise(term)

    tokens = query_tokens(questions, d)
    rows = d.assign(nodes).join(F.broadcast(tokens) if d.of is None else tokens, "domain")  # one row for the only domain
    points = F.filter(F.transform("tokens", lambda t: F.struct(t["query"].alias("query"), (point(t["token"]) * t["times"]).alias("score"))), lambda p: p["score"] > 0)
    found = rows.select("doc_id", "node_ord", "id", "label", F.inline(points))
    return found.groupBy("doc_id", "query", "node_ord", "id", "label").agg(F.sum("score").alias("score"))


def top(nodes: DataFrame, questions: Sequence[str], domain: Domain | Domains, n: int = TARGETS) -> DataFrame:
    """doc_id, query, id, label, score, rank: the ``n`` best nodes with a score, in node order at a tie."""
    order = Window.partitionBy("doc_id", "query").orderBy(F.desc("score"), "node_ord")
    return score(nodes, questions, domain).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("doc_id", "query", "id", "label", "score", "rank")


def targets(nodes: DataFrame, questions: Sequence[str], domain: Domain | Domains) -> DataFrame:
    """doc_id, query, id, label, rank: what a question names, or else what it finds."""
    exact = resolve(nodes, questions)
    others = top(nodes, questions, domain).drop("score").join(exact.select("doc_id", "query").hint("merge"), ["doc_id", "query"], "left_anti")
    return exact.unionByName(others)


def below(targets_: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, query, rank, id, path (edge_ords from a target down), through (the nodes on the way, the last included): what stands below the target sections (doc_id, query, rank, me).

    Every section knows the chain of sections above it, so those below a target are found by one join for all depths.
    """
    chains = section_chains(nodes, edges).select("doc_id", "section", "chain", F.posexplode(F.transform("chain", lambda x: x["id"])).alias("_i", "me"))
    down = lambda field: F.reverse(F.transform(F.slice("chain", 1, F.col("_i")), lambda x: x[field]))
    sections = targets_.join(chains, ["doc_id", "me"]).select("doc_id", "query", "rank", F.col("section").alias("id"), down("edge_ord").alias("path"), down("id").alias("through"))
    inside = edges.filter((F.col("type") == "CONTAINS") & F.startswith("target", F.lit("REQ-"))).select("doc_id", F.col("source").alias("id"), "target", "edge_ord")
    rules = sections.join(inside, ["doc_id", "id"]).select("doc_id", "query", "rank", F.col("target").alias("id"), F.concat("path", F.array("edge_ord")).alias("path"), F.concat("through", F.array("target")).alias("through"))
    return sections.filter(F.size("path") > 0).unionByName(rules)


def expand(nodes: DataFrame, edges: DataFrame, targets_: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(context, conflicts). context: doc_id, query, role (requirement, section, term), pos, id. conflicts: doc_id, query, pos, edge_ord.

    Targets are worked off by rank. They share what was visited: a node is listed once, a term seen
    before leads to no more peers, a requirement seen before to no section, a section seen before is
    not entered. Conflicts are listed for every target. Peers of a term are as many as its rules.
    """
    key = ["doc_id", "query"]
    targets_ = settled(targets_)
    ranks = targets_.agg(F.max("rank")).first()[0] or 1
    e = edges.select("doc_id", "edge_ord", "source", "target", "type")
    known = nodes.select("doc_id", "id", "label")
    role = {"Requirement": "requirement", "Section": "section", "Term": "term"}
    labels = F.create_map(*[F.lit(x) for kv in role.items() for x in kv])
    visited = targets_.select(*key, "id").distinct()
    found, clashes = [], []
    sections = targets_.filter("label = 'Section'").select(*key, F.col("id").alias("me"), "rank")
    down = None if sections.isEmpty() else settled(below(sections, nodes, edges))
    tag = lambda *xs: F.array(*[x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long") for x in xs])
    for rank in range(1, ranks + 1):
        t = targets_.filter(F.col("rank") == rank).select(*key, F.col("id").alias("me"), "label")
        req, term = (t.filter(F.col("label") == k).drop("label") for k in ("Requirement", "Term"))
        out = req.join(e, (req["doc_id"] == e["doc_id"]) & (req["me"] == e["source"])).select(req["doc_id"], "query", "me", "edge_ord", F.col("target").alias("id"), "type")
        into = req.join(e, (req["doc_id"] == e["doc_id"]) & (req["me"] == e["target"])).select(req["doc_id"], "query", "me", "edge_ord", F.col("source").alias("id"), "type")
        is_ = lambda prefix: F.startswith("id", F.lit(prefix))
        to_term = F.col("type").isin(*TERM_EDGES) & is_("TERM-")
        to_sec = F.col("type").isin("REFERENCES", "IMPLEMENTS", "DEPENDS_ON") & is_("SEC-")
        to_req = F.col("type").isin("REFERENCES", "DEPENDS_ON", "SUPERSEDES") & is_("REQ-")
        cands = into.filter((F.col("type") == "CONTAINS") & is_("SEC-")).select(*key, "id", tag(0, F.col("edge_ord"), 0).alias("tag"))
        cands = cands.unionByName(out.filter(to_term | to_sec | to_req | (F.col("type") == "CONFLICTS_WITH")).select(*key, "id", tag(1, F.col("edge_ord"), 0).alias("tag")))
        fresh = out.filter(to_term).join(visited, [*key, "id"], "left_anti").join(known.select("doc_id", "id"), ["doc_id", "id"]).groupBy(*key, "me", "id").agg(F.min("edge_ord").alias("via"))
        peers = fresh.join(e.select("doc_id", F.col("target").alias("id"), "source", F.col("edge_ord").alias("peer")), ["doc_id", "id"]).filter(F.startswith("source", F.lit("REQ-")) & (F.col("source") != F.col("me")))
        cands = cands.unionByName(peers.select(*key, F.col("source").alias("id"), tag(1, F.col("via"), F.col("peer")).alias("tag")))
        cands = cands.unionByName(into.filter("type = 'CONFLICTS_WITH'").select(*key, "id", tag(2, F.col("edge_ord"), 0).alias("tag")))
        both = out.filter("type = 'CONFLICTS_WITH'").select(*key, "edge_ord", F.lit(0).alias("side")).unionByName(into.filter("type = 'CONFLICTS_WITH'").select(*key, "edge_ord", F.lit(1).alias("side")))
        clashes.append(both.withColumn("rank", F.lit(rank)))
        users = term.join(e, (term["doc_id"] == e["doc_id"]) & (term["me"] == e["target"])).filter(F.col("type").isin(*TERM_EDGES) & F.startswith("source", F.lit("REQ-"))).select(term["doc_id"], "query", F.col("source").alias("id"), "edge_ord")
        users = users.groupBy(*key, "id").agg(F.min("edge_ord").alias("via"))
        cands = cands.unionByName(users.select(*key, "id", tag(F.col("via"), 0).alias("tag")))
        new_users = users.join(visited, [*key, "id"], "left_anti").join(known.select("doc_id", "id"), ["doc_id", "id"])
        homes = new_users.join(e.filter("type = 'CONTAINS'").select("doc_id", F.col("target").alias("id"), "source", "edge_ord"), ["doc_id", "id"]).filter(F.startswith("source", F.lit("SEC-")))
        cands = cands.unionByName(homes.select(*key, F.col("source").alias("id"), tag(F.col("via"), F.col("edge_ord")).alias("tag")))
        if down is not None:
            inner = down.filter(F.col("rank") == rank).select(*key, "id", F.concat(F.array(F.size("path").cast("long")), F.col("path").cast("array<long>")).alias("tag"), "through")
            walls = inner.select(*key, "id", "tag", F.explode("through").alias("wall")).join(visited.select(*key, F.col("id").alias("wall")), [*key, "wall"], "left_semi").select(*key, "id", "tag").distinct()
            cands = cands.unionByName(inner.drop("through").join(walls, [*key, "id", "tag"], "left_anti"))
        new = cands.join(visited, [*key, "id"], "left_anti").join(known, ["doc_id", "id"]).groupBy(*key, "id", "label").agg(F.min("tag").alias("tag"))
        new = settled(new)
        found.append(new.withColumn("rank", F.lit(rank)))
        visited = visited.unionByName(new.select(*key, "id")).hint("merge")
    rows, pairs = found[0], clashes[0]
    for x, y in zip(found[1:], clashes[1:], strict=True):
        rows, pairs = rows.unionByName(x), pairs.unionByName(y)
    rows = rows.withColumn("role", labels[F.col("label")])
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(*key, "role").orderBy("rank", "tag")))
    pairs = pairs.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy("rank", "side", "edge_ord")))
    return rows.select(*key, "role", "pos", "id"), pairs.select(*key, "pos", "edge_ord")


def payload(nodes: DataFrame, edges: DataFrame, questions: Sequence[str], domain: Domain | Domains, found: DataFrame | None = None) -> DataFrame:
    """doc_id, query, payload: the template filled with targets, structure, rules, terms and conflicts. Texts are put in literally.

    ``found`` stands in for :func:`targets` where they are known. Of the conflicts, only those of target requirements are looked at.
    """
    key = ["doc_id", "query"]
    t = found if found is not None else targets(nodes, questions, domain)
    context, clash = expand(nodes, edges, t)
    text = nodes.select("doc_id", "id", "label", "name", "frequency", "section_number", "title", "text", "constraint_type", "page_number")
    say = F.format_string
    target_line = F.when(F.col("label") == "Requirement", say('- **%s** [%s in Section %s, Page %d]:\n  "%s"', "id", "constraint_type", "section_number", "page_number", "text")).when(F.col("label") == "Term", say("- **Term '%s'**: Mentions frequency = %d", "name", "frequency")).otherwise(say('- **Section %s**: "%s"', "section_number", "title"))
    lines = {
        "section": say('- Section %s: "%s"', "section_number", "title"), "requirement": say('- **%s** [Section %s - %s]: "%s"', "id", "section_number", "constraint_type", "text"), "term": say("- **%s** (Frequency: %d)", "name", "frequency"),
    }
    joined = context.join(text, ["doc_id", "id"])
    one = F.when(F.col("role") == "section", lines["section"]).when(F.col("role") == "requirement", lines["requirement"]).otherwise(lines["term"])
    rows = t.drop("label").join(text, ["doc_id", "id"]).select(*key, F.lit("target").alias("part"), F.col("rank").alias("pos"), target_line.alias("line")).unionByName(joined.select(*key, F.col("role").alias("part"), "pos", one.alias("line")))
    c = clash.join(edges.select("doc_id", "edge_ord", "source", "target", "shared_term", "reason"), ["doc_id", "edge_ord"])
    rows = rows.unionByName(c.select(*key, F.lit("conflict").alias("part"), "pos", say("- Conflict between **%s** and **%s** on term **'%s'**:\n  *Reason: %s*", "source", "target", "shared_term", "reason").alias("line")))
    by = rows.groupBy(*key, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n").alias("lines"))
    wide = by.groupBy(*key).pivot("part", ["target", "section", "requirement", "term", "conflict"]).agg(F.first("lines"))
    d = D.table(nodes.sparkSession, domain)
    # What stands in a part without lines.
    nothing = {"target": "", "section": "No direct structural context linked.", "requirement": "No semantically or structurally linked requirements found.", "term": "No specific technical terms mapped.", "conflict": "No explicit conflicts detected in this context segment."}
    info = F.when(F.col("info") != "", F.concat(F.lit("ADDITIONAL DOMAIN INFORMATION\n"), "info", F.lit("\n"))).otherwise("")
    slots = {"role_description": F.coalesce("role", F.lit("")), "additional_domain_info_section": info} | {slot: F.coalesce(F.col(part), F.lit(nothing[part])) for slot, part in SLOTS.items()}
    # the template is cut at its slots once, so what is put in is never looked at again
    named = "\\{(" + "|".join(slots) + ")\\}"
    around, holes = F.split("template", named, -1), F.regexp_extract_all("template", F.lit(named), F.lit(1))
    values = F.create_map(*[x for slot, v in slots.items() for x in (F.lit(slot), v)])
    out = F.concat(F.array_join(F.zip_with(F.slice(around, 1, F.size(holes)), holes, lambda a, h: F.concat(a, values[h])), ""), F.element_at(around, -1))
    wide = d.assign(wide).join(d.about, "domain")
    every = each_asked(nodes.select("doc_id").distinct(), questions)
    failed = F.concat(F.lit("Error: No matching node found for query '"), "query", F.lit("' in the Knowledge Graph."))
    return every.join(wide.select(*key, out.alias("payload")), key, "left").select(*key, F.coalesce("payload", failed).alias("payload"))

"""Every query by name: a function of (spark, folder of the tables)."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import text as T
from specloom.functions.vocabulary import detect_domain, domain, domain_scores
from specloom.operators import assist, blocks, explore, graph, lines, rules, search, terms
from specloom.plans import oracle
from specloom.plans.pipeline import Analysis
from specloom.sources.corpus import corpus_pages, document_pages
from specloom.sources.artifacts import shared_folder
from specloom.sources.replies import ReplyStore
from specloom.streaming import ingest

DOMAIN = domain("smartGrid")
SEARCH = ["how is communication latency or timeout handled", "gateway payload interface", "term-buffer 1.1", "the of and"]
NAMED = ["REQ-001", "req-003", "Timeout", "1.0", "A", "Annex A", "REQ-999", "payload"]
REQUIREMENT, TERM, SECTIONS, TEXT = "REQ-003", "timeout", ["1", "2", "3", "4", "5", "6", "A"], "heartbeat"

AUDITED = [REQUIREMENT, SEARCH[0], "zzz"]


@lru_cache(maxsize=2)
def _analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return Analysis(corpus_pages(spark, sf_dir), DOMAIN)


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """The corpus' tables, shared by the queries of a session on one folder."""
    return _analysis(spark, sf_dir)


def _bar(c: str):
    return F.array_join(c, "|").alias(c)


def line_kinds(spark, d):
    raw = lines.explode_pages(document_pages(spark, d)).withColumn("line", T.strip(F.col("raw")))
    kind = T.line_kind(F.col("line"))
    group = lambda n: F.when(F.col("kind") == "heading", F.regexp_extract("line", T.HEADING, n)).when(F.col("kind") == "list_item", F.regexp_extract("line", T.LIST, n))
    return raw.withColumn("kind", kind).select("doc_id", "line_idx", "kind", group(1).alias("g1"), group(2).alias("g2"))


def page_edge_clean(spark, d):
    return lines.clean_lines(lines.explode_pages(corpus_pages(spark, d)), DOMAIN.headers).select("doc_id", "page_number", "line_idx", "line")


def section_normalise(spark, d):
    h = blocks.headings(analysis(spark, d).plain_blocks).select("number", "norm").distinct()
    return h.select("number", "norm", F.when(F.contains("norm", F.lit(".")), F.regexp_replace("norm", r"\.[^.]*$", "")).alias("parent"))


def block_islands(spark, d):
    return analysis(spark, d).plain_blocks.select("doc_id", "block_no", "id", "type", "page_number")


def block_text(spark, d):
    return analysis(spark, d).plain_blocks.select("doc_id", "block_no", "text", "prefix", F.when(F.col("rows").isNotNull(), F.size("rows")).alias("n_rows"))


def section_propagation(spark, d):
    return blocks.with_sections(analysis(spark, d).plain_blocks).select("doc_id", "block_no", "section_number")


def heading_hierarchy(spark, d):
    b = analysis(spark, d).plain_blocks
    return blocks.hierarchy(b).join(b.select("doc_id", "block_no", "number"), ["doc_id", "block_no"]).select("doc_id", "block_no", "number", _bar("parents"), _bar("context"))


def outline_tree(spark, d):
    return blocks.outline(analysis(spark, d).plain_blocks)


def markdown(spark, d):
    return blocks.markdown(analysis(spark, d).plain_blocks)


def sentence_split(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence"))
    return docs


def rule_types(spark, d):
    a = analysis(spark, d)
    return rules.mine(blocks.with_sections(a.plain_blocks)).groupBy("doc_id", "constraint_type").agg(F.count("*").alias("n_rules"), F.countDistinct("source_block_id").alias("n_blocks"))


def rule_ledger(spark, d):
    r = analysis(spark, d).rules
    return r.select("doc_id", "rule_ord", "id", "section_number", F.array_join("parent_hierarchy", "|").alias("parents"), F.array_join("heading_context", "|").alias("context"), "constraint_type", F.array_join("all_matched_constraints", "|").alias("all_types"), "text", "source_block_id", "page_number")


def rollup_constraints(spark, d):
    return analysis(spark, d).rules.rollup("section_number", "constraint_type").agg(F.count("*").alias("n_rules"))


def implicit_candidates(spark, d):
    a = analysis(spark, d)
    return rules.implicit_candidates(a.blocks, a.rules).select("doc_id", "id", "text")


def _canned_rules(prompts: list[str]) -> list[str | None]:
    """A stand-in model: every other block is called mandatory, in a fence, with an unknown block at the end."""
    out = []
    for p in prompts:
        rows = [{"block_id": x["id"], "constraint_type": "Mandatory" if i % 2 == 0 else "Wish", "text": x["text"]} for i, x in enumerate(json.loads(p))]
        out.append("```json\n" + json.dumps([*rows, {"block_id": "BLK-none", "constraint_type": "Mandatory", "text": "x"}]) + "\n```")
    return out


def llm_reply_validate(spark, d):
    a = analysis(spark, d)
    asked = assist.batched(rules.implicit_candidates(a.blocks, a.rules), assist.IMPLICIT, ["block_no"])
    replies = assist.ask(assist.prompts(asked, ["id", "section_number", "text"], ["block_no"]), _canned_rules)
    return assist.new_rules(replies, asked, a.rules).select("doc_id", "rule_ord", "id", "section_number", "constraint_type", "text", "source_block_id")


def _canned_ids(prompts: list[str]) -> list[str | None]:
    return [json.dumps([x["id"] for x in json.loads(p) if x["id"].endswith("0")]) for p in prompts]


def boilerplate_filter(spark, d):
    r = analysis(spark, d).rules
    asked = assist.prompts(assist.batched(r, assist.BOILERPLATE, ["rule_ord"]), ["id", "text"], ["rule_ord"])
    return rules.without(r, assist.named_ids(assist.ask(asked, _canned_ids))).select("doc_id", "id", "text")


def term_frequency(spark, d):
    return terms.frequencies(analysis(spark, d).rules, DOMAIN).select("doc_id", "term", "freq")


def top_terms(spark, d):
    return terms.top_terms(analysis(spark, d).rules, DOMAIN).select("doc_id", "term", "freq", "rank")


def curated_frequency(spark, d):
    return terms.curated_frequencies(analysis(spark, d).rules, DOMAIN).select("doc_id", "term", "freq")


def term_merge(spark, d):
    return terms.merged(analysis(spark, d).rules, DOMAIN).select("doc_id", "term_ord", "term", "freq")


def stride_sample(spark, d):
    return terms.stride_sample(analysis(spark, d).rules, 30).select("doc_id", "id")


def _sections(spark, d):
    a = analysis(spark, d)
    return a, a.graph["sections"]


def section_nodes(spark, d):
    return _sections(spark, d)[1].select("doc_id", "sec_ord", "section", "id", "title")


def section_contains(spark, d):
    return graph.section_contains(_sections(spark, d)[1]).select("doc_id", "source", "target")


def requirement_contains(spark, d):
    a, s = _sections(spark, d)
    return graph.rule_contains(s, a.rules).select("doc_id", "source", "target")


def _mentions(spark, d):
    a = analysis(spark, d)
    return a.rules, a.graph["mentions"]


def term_edges(spark, d):
    return graph.term_edges(*_mentions(spark, d)).select("doc_id", "source", "target", "type")


def section_refs(spark, d):
    a, s = _sections(spark, d)
    return graph.section_refs(a.rules, s).select("doc_id", "source", "target", "type", "pos")


def req_refs(spark, d):
    return graph.requirement_refs(analysis(spark, d).rules).select("doc_id", "source", "target", "type", "pos")


def conflict_pairs(spark, d):
    r, m = _mentions(spark, d)
    return graph.conflicts(r, m, DOMAIN).select("doc_id", "source", "target", "shared_term")


def graph_edges(spark, d):
    return analysis(spark, d).edges.select("doc_id", "edge_ord", "source", "target", "type")


def node_counts(spark, d):
    return analysis(spark, d).nodes.groupBy("doc_id", "label").agg(F.count("*").alias("n"))


def edge_counts(spark, d):
    return analysis(spark, d).edges.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def edge_totals(spark, d):
    return analysis(spark, d).edge_totals()


def conflict_totals(spark, d):
    return analysis(spark, d).conflict_totals().select("doc_id", "term", "n_mandatory", "n_prohibiting", "n_pairs")


def conflicts_of_rule(spark, d):
    a = analysis(spark, d)
    return a.conflicts_of(a.rules.filter(F.col("id") == REQUIREMENT)).select("doc_id", "source", "target", "shared_term")


def _canned_edges(prompts: list[str]) -> list[str | None]:
    return [json.dumps([{"source": x["source"], "target": x["target"], "type": "REFERENCES"} for x in json.loads(p) if x["type"] == "IMPLEMENTS"]) for p in prompts]


def refine_edges(spark, d):
    e = analysis(spark, d).edges
    able = e.filter(~F.col("type").isin("CONTAINS", "CONFLICTS_WITH") & F.startswith("source", F.lit("REQ-")) & ~F.startswith("target", F.lit("TERM-")))
    asked = assist.prompts(assist.batched(able, assist.EDGES, ["edge_ord"]), ["source", "target", "type"], ["edge_ord"])
    return graph.refined(e, assist.edge_changes(assist.ask(asked, _canned_edges))).select("doc_id", "edge_ord", "source", "target", "type")


def resolve_exact(spark, d):
    return search.resolve(analysis(spark, d).nodes, NAMED).select("doc_id", "query", "id")


def search_top3(spark, d):
    return search.top(analysis(spark, d).nodes, SEARCH, DOMAIN).select("doc_id", "query", "id", "score", "rank")


def _context(questions: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        a = analysis(spark, d)
        return search.expand(a.nodes, a.edges, search.targets(a.nodes, questions, DOMAIN))[0]

    return run


def audit_payload(spark, d):
    return analysis(spark, d).audit(AUDITED)


def section_path(spark, d):
    a = analysis(spark, d)
    return explore.section_paths(a.nodes, a.edges)


def relationship_buckets(spark, d):
    a = analysis(spark, d)
    return explore.relationships(a.nodes, a.edges).groupBy("doc_id", "id", "bucket").agg(F.count("*").alias("n"))


def section_children(spark, d):
    a = analysis(spark, d)
    return explore.children(a.nodes, a.edges)


def term_by_section(spark, d):
    return explore.terms_by_section(analysis(spark, d).edges)


def substring_search(spark, d):
    return explore.containing(analysis(spark, d).nodes, TEXT).select("doc_id", "id")


def substring_indexed(spark, d):
    return analysis(spark, d).index.containing(TEXT).select("doc_id", "id")


def top3_indexed(spark, d):
    return analysis(spark, d).index.top(SEARCH, DOMAIN).select("doc_id", "query", "id", "score", "rank")


def neighborhood(spark, d):
    a = analysis(spark, d)
    return explore.neighborhood(a.nodes, a.edges, explore.containing(a.nodes, TEXT))


def edge_states(spark, d):
    a = analysis(spark, d)
    return explore.edge_states(a.edges, explore.containing(a.nodes, TEXT))


def search_tree(spark, d):
    a = analysis(spark, d)
    return explore.result_tree(a.nodes, a.edges, TEXT)


def domain_detect(spark, d):
    t = F.coalesce("text", F.lit(""))
    grid, security = domain_scores(t)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", grid.alias("grid"), security.alias("security"), detect_domain(t).alias("preset"))


def stream_rules(spark, d):
    """Pages are written as files by their number, so a document comes in several batches, and ingested as a stream."""
    base = shared_folder(spark)
    pages = corpus_pages(spark, d)
    pages.repartition(3, "page_number").write.parquet(f"{base}/pages")
    ingest.ingest_rules(ingest.page_stream(spark, f"{base}/pages", 1), f"{base}/rules", f"{base}/state", DOMAIN).awaitTermination()
    return ingest.latest_rules(spark, f"{base}/rules").groupBy("doc_id", "constraint_type").agg(F.count("*").alias("n_rules"))


def stream_events(spark, d):
    base = shared_folder(spark)
    ingest.event_counts(spark, f"{d}/events.parquet", f"{base}/counts", f"{base}/state").awaitTermination()
    return ingest.latest_counts(spark, f"{base}/counts").withColumn("total", F.round("total", 4))


def generic_terms(spark, d):
    return terms.merged(analysis(spark, d).rules, domain("generic")).select("doc_id", "term_ord", "term", "freq")


def security_terms(spark, d):
    return terms.merged(analysis(spark, d).rules, domain("security")).select("doc_id", "term_ord", "term", "freq")


def heading_candidates(spark, d):
    return analysis(spark, d).lines.filter("cid > 0").select("doc_id", "cid", "page_number", "line_idx", "line")


def _canned_headings(prompts: list[str]) -> list[str | None]:
    return ["```json\n" + json.dumps([x["id"] for x in json.loads(p) if x["id"] % 3 == 0]) + "\n```" for p in prompts]


def heading_demotion(spark, d):
    a = Analysis(corpus_pages(spark, d), DOMAIN, {"headings": _canned_headings})
    return a.lines.select("doc_id", "page_number", "line_idx", "kind", "cid")


def _canned_tables(prompts: list[str]) -> list[str | None]:
    """A stand-in model: a limit for every other table, an unknown type for the rest."""
    out = []
    for p in prompts:
        rows = json.loads(p)
        out.append(json.dumps([{"blockId": x["id"], "constraintType": "Mandatory" if int(x["id"][-1]) % 2 == 0 else "Wish", "requirementText": f"Limit of {x['id']} on page {x['page']}"} for x in rows]))
    return out


def tabular_rules(spark, d):
    a = analysis(spark, d)
    tables = a.blocks.filter("type = 'table'").withColumns({"section": F.col("section_number"), "page": F.col("page_number")})
    asked = assist.batched(tables, assist.TABULAR, ["block_no"])
    replies = assist.ask(assist.prompts(asked, ["id", "section", "page", "text"], ["block_no"]), _canned_tables)
    return assist.tabular_rules(replies, asked, a.rules).select("doc_id", "rule_ord", "id", "section_number", "constraint_type", "text", "source_block_id", "page_number")


def _canned_conflicts(prompts: list[str]) -> list[str | None]:
    return [json.dumps([{"source": x["source"], "target": x["target"]} for x in json.loads(p) if x["source"].endswith(("1", "3", "5"))]) for p in prompts]


def conflict_validation(spark, d):
    a = analysis(spark, d)
    pairs = graph.conflicts(a.rules, a.graph["mentions"], DOMAIN)
    asked = assist.batched(pairs, assist.CONFLICTS, ["term_ord", "a", "b"])
    return assist.judged_conflicts(pairs, assist.ask(assist.prompts(asked, ["source", "target", "shared_term"], ["term_ord", "a", "b"]), _canned_conflicts)).select("doc_id", "source", "target", "shared_term")


def _failing(prompts: list[str]) -> list[str | None]:
    """A stand-in model that fails at every prompt with REQ-002 in it, and has nothing to say to those with REQ-011."""
    if any('"REQ-002"' in p for p in prompts):
        raise ConnectionError("no route")
    return [None if '"REQ-011"' in p else json.dumps([x["id"] for x in json.loads(p) if x["id"].endswith("5")]) for p in prompts]


def stored_replies(spark, d):
    """Boilerplate as the first model names it, else the second, from the store that the first run has filled."""
    r = analysis(spark, d).rules
    asked = assist.prompts(assist.batched(r, 10, ["rule_ord"]), ["id", "text"], ["rule_ord"])
    store = ReplyStore(shared_folder(spark))
    store.ask(asked, "boilerplate", [_failing, _canned_ids])
    return rules.without(r, assist.named_ids(store.ask(asked, "boilerplate", None))).select("doc_id", "id", "text")


def _canned_terms(prompts: list[str]) -> list[str | None]:
    return ["```\n" + json.dumps(["Payload", "response time", "client", "ms", "Heartbeat ", "timeout", "payload"]) + "\n```" if "REQ-001" in p else "[]" for p in prompts]


def model_terms(spark, d):
    r = analysis(spark, d).rules
    asked = assist.prompts(assist.batched(terms.stride_sample(r), assist.TERMS, ["rule_ord"]), ["id", "text"], ["rule_ord"])
    found = terms.named(r, assist.model_terms(assist.ask(asked, _canned_terms), DOMAIN))[0]
    return found.select("doc_id", "term", "freq", "term_ord")


def node_projection(spark, d):
    return explore.projected(analysis(spark, d).nodes)


_FUNCTIONS = (
    line_kinds, page_edge_clean, section_normalise, block_islands, block_text, section_propagation, heading_hierarchy, outline_tree, markdown, sentence_split, rule_types, rule_ledger, rollup_constraints,
    implicit_candidates, llm_reply_validate, boilerplate_filter, stored_replies, term_frequency, top_terms, curated_frequency, term_merge, stride_sample, section_nodes, section_contains, requirement_contains, term_edges,
    section_refs, req_refs, conflict_pairs, graph_edges, node_counts, edge_counts, edge_totals, conflict_totals, conflicts_of_rule, refine_edges, resolve_exact, search_top3, audit_payload, section_path, relationship_buckets, section_children,
    generic_terms, security_terms, heading_candidates, heading_demotion, tabular_rules, conflict_validation, model_terms, node_projection, term_by_section, substring_search, substring_indexed, top3_indexed, neighborhood, edge_states, search_tree, domain_detect, stream_rules, stream_events,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _FUNCTIONS} | {
    "context_requirement": _context([REQUIREMENT]), "context_term": _context([TERM]), "context_section": _context(SECTIONS), "context_blend": _context(SEARCH),
}
ORACLE_SQL: dict[str, str] = oracle.queries(DOMAIN, SEARCH, NAMED, REQUIREMENT, TERM, SECTIONS, TEXT, AUDITED)

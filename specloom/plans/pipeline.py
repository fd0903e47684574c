"""From pages to the graph, as one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.functions.vocabulary import ROLES, Domain, detect_domain, domain
from specloom.operators import assist, blocks, graph, lines, rules, search
from specloom.operators import domains as D
from specloom.operators.domains import Domains
from specloom.operators.index import NodeIndex
from specloom.operators.scans import LONG, any_long
from specloom.operators import terms as term_ops
from specloom.sources.artifacts import settled, shared_folder
from specloom.sources.replies import ReplyStore

STEPS = ("headings", "implicit", "tabular", "boilerplate", "terms", "edges", "conflicts")


@dataclass
class Analysis:
    """All tables of a set of documents, made when asked for.

    Blocks, rules and the graph's tables are each read several times, so each is written once in the
    shared folder. Everything is dealt out by doc_id, so a document is the largest unit of a task. models
    holds, for any of STEPS, a function from prompts to replies; a step without one is left out. Each step
    is a method of the replies' validation in ``assist``, and what a reply gets wrong is passed over. ``domain`` is
    one domain for all documents, or the tables of any number of domains with each document's own. With a ``store`` a
    step may have several models, the next one for what the one before fails at, and stored replies are not asked for again;
    a failure leaves the batch without a reply.
    """

    pages: DataFrame
    domain: Domain | Domains
    models: Mapping[str, assist.Model | Sequence[assist.Model]] = field(default_factory=dict)
    store: ReplyStore | None = None
    long_from: int = LONG

    @cached_property
    def long(self) -> bool:
        """Whether a document is too long for one task; then documents are scanned by cells (:mod:`specloom.operators.scans`)."""
        return any_long(self.pages, self.long_from)

    def _replies(self, step: str, rows: DataFrame, size: int, columns: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
        asked = assist.batched(rows, size, order)
        written, model = assist.prompts(asked, columns, order), self.models[step]
        return asked, settled(self.store.ask(written, step, model) if self.store else assist.ask(written, model))

    @cached_property
    def domains(self) -> Domains:
        return D.table(self.pages.sparkSession, self.domain)

    @cached_property
    def lines(self) -> DataFrame:
        clean = lines.clean_lines(lines.explode_pages(self.pages), self.domain.headers if isinstance(self.domain, Domain) else self.domain)
        rows = lines.classify_lines(clean, long=self.long)
        if "headings" not in self.models:
            return rows
        candidates = rows.filter("kind = 'heading'").select("doc_id", F.col("cid").alias("id"), "line")
        _, replies = self._replies("headings", candidates, assist.HEADINGS, ["id", "line"], ["id"])
        return lines.classify_lines(clean, assist.false_headings(replies), self.long)

    @cached_property
    def plain_blocks(self) -> DataFrame:
        return settled(blocks.assemble(self.lines, self.long))

    @cached_property
    def blocks(self) -> DataFrame:
        return settled(blocks.with_sections(self.plain_blocks, self.long))

    @cached_property
    def mined(self) -> DataFrame:
        return rules.mine(self.blocks, self.long)

    @cached_property
    def rules(self) -> DataFrame:
        """The ledger: sentences with a modal word, then what models find in other blocks and in tables, less boilerplate."""
        found = settled(self.mined)
        if "implicit" in self.models:
            asked, replies = self._replies("implicit", rules.implicit_candidates(self.blocks, found), assist.IMPLICIT, ["id", "section_number", "text"], ["block_no"])
            found = settled(found.unionByName(assist.new_rules(replies, asked, found), allowMissingColumns=True))
        if "tabular" in self.models:
            tables = self.blocks.filter("type = 'table'").withColumns({"section": F.col("section_number"), "page": F.col("page_number")})
            asked, replies = self._replies("tabular", tables, assist.TABULAR, ["id", "section", "page", "text"], ["block_no"])
            found = settled(found.unionByName(assist.tabular_rules(replies, asked, found)))
        if "boilerplate" in self.models:
            _, replies = self._replies("boilerplate", found, assist.BOILERPLATE, ["id", "text"], ["rule_ord"])
            found = settled(rules.without(found, assist.named_ids(replies)))
        return found

    @cached_property
    def terms(self) -> tuple[DataFrame, DataFrame]:
        """(terms, mentions). Where a model names terms of a document, they take the place of its counted and curated ones."""
        found = settled(term_ops.curated_matches(self.rules, self.domains))
        terms = term_ops.merged(self.rules, self.domains, found)
        if "terms" not in self.models:
            terms = settled(terms)
            return terms, settled(term_ops.mentions(self.rules, terms, self.domains, found))
        _, replies = self._replies("terms", term_ops.stride_sample(self.rules), assist.TERMS, ["id", "text"], ["rule_ord"])
        named, by_name = (settled(x) for x in term_ops.named(self.rules, assist.model_terms(replies, self.domains)))
        others = settled(terms.join(named.select("doc_id").distinct(), "doc_id", "left_anti"))
        return others.unionByName(named), settled(term_ops.mentions(self.rules, others, self.domains, found).unionByName(by_name))

    @cached_property
    def sections(self) -> DataFrame:
        return settled(graph.section_nodes(self.blocks, self.rules))

    @cached_property
    def nodes(self) -> DataFrame:
        return settled(graph.nodes(self.sections, self.rules, self.terms[0], self.long))

    @cached_property
    def graph(self) -> dict[str, DataFrame]:
        terms, mentions = self.terms
        sections = self.sections
        pairs = None
        if "conflicts" in self.models:
            pairs = settled(graph.conflicts(self.rules, mentions, self.domains))
            _, replies = self._replies("conflicts", pairs, assist.CONFLICTS, ["source", "target", "shared_term"], ["term_ord", "a", "b"])
            pairs = assist.judged_conflicts(pairs, replies)
        edges = settled(graph.edges(sections, self.rules, mentions, self.domains, pairs, self.long))
        if "edges" in self.models:
            _, replies = self._replies("edges", graph.refinable(edges), assist.EDGES, ["source", "target", "type"], ["edge_ord"])
            edges = settled(graph.refined(edges, assist.edge_changes(replies)))
        return {"terms": terms, "mentions": mentions, "sections": sections, "nodes": self.nodes, "edges": edges}

    @property
    def edges(self) -> DataFrame:
        return self.graph["edges"]

    def edge_totals(self) -> DataFrame:
        """doc_id, type, n: edges by type; no pair of conflicting rules is made for it, unless a model judges pairs or changes types."""
        if {"conflicts", "edges"} & set(self.models):
            return self.edges.groupBy("doc_id", "type").agg(F.count("*").alias("n"))
        return graph.edge_totals(self.sections, self.rules, self.terms[1], self.domains)

    def conflict_totals(self) -> DataFrame:
        """doc_id, term, term_ord, n_mandatory, n_prohibiting, n_pairs, before any model's judgement."""
        return graph.conflict_totals(self.rules, self.terms[1], self.domains)

    def conflicts_of(self, asked: DataFrame) -> DataFrame:
        """The conflicting pairs of the rules ``asked`` (doc_id, id), before any model's judgement."""
        return graph.conflicts_of(self.rules, self.terms[1], self.domains, asked)

    def summary(self) -> DataFrame:
        """doc_id, kind, name, n: nodes by label and edges by type."""
        n = self.nodes.groupBy("doc_id", F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
        return n.unionByName(self.edge_totals().select("doc_id", F.lit("edge").alias("kind"), F.col("type").alias("name"), "n"))

    @cached_property
    def index(self) -> NodeIndex:
        """The nodes' index, for many searches on the same tables."""
        return NodeIndex.build(self.nodes, shared_folder(self.pages.sparkSession))

    def audit(self, questions: list[str]) -> DataFrame:
        """doc_id, query, payload. Only the conflicts of the requirements that are found are made, unless all edges are there or a model
        judges pairs or changes types; a node index that is there is searched instead of the nodes."""
        indexed = self.__dict__.get("index")
        found = settled((indexed.targets if indexed else partial(search.targets, self.nodes))(questions, self.domains))
        if "graph" in self.__dict__ or {"conflicts", "edges"} & set(self.models):
            return search.payload(self.nodes, self.edges, questions, self.domains, found)
        own = settled(self.conflicts_of(found.filter("label = 'Requirement'")))
        edges = settled(graph.edges(self.sections, self.rules, self.terms[1], self.domains, own, self.long))
        return search.payload(self.nodes, edges, questions, self.domains, found)


def domains_of(pages: DataFrame) -> DataFrame:
    """doc_id and the preset that the first pages' text suggests."""
    return lines.sample_text(pages).select("doc_id", detect_domain(F.col("sample")).alias("preset"))


def inferred(pages: DataFrame, model: assist.Model | Sequence[assist.Model], store: ReplyStore | None = None) -> DataFrame:
    """doc_id, name, terms, headers, role: what a model takes each document's domain to be, from its first pages."""
    asked = lines.sample_text(pages).select("doc_id", F.lit(0).alias("batch"), F.col("sample").alias("prompt"))
    return assist.inferred_domains(store.ask(asked, "domain", model) if store else assist.ask(asked, model))


def parse_documents(pages: DataFrame, preset: str = "generic", models: Mapping[str, assist.Model] | None = None, store: ReplyStore | None = None, **more) -> Analysis:
    """The tables of ``pages`` under a preset with additions (terms, stopwords, headers, actors, info)."""
    return Analysis(pages, domain(preset, **more), models or {}, store)


def parse_each(pages: DataFrame, models: Mapping[str, assist.Model] | None = None, store: ReplyStore | None = None, **more) -> Analysis:
    """The tables of ``pages``, each document under its own domain: what the model of the step "domain" infers, else the detected preset.

    However many domains there are, it is one plan: domains are tables that are joined to the documents. ``more`` (terms,
    stopwords, headers, actors, info) is added to every domain, actors only to the presets.
    """
    models = dict(models or {})
    ask = models.pop("domain", None)
    base = settled(domains_of(pages))
    each = D.table(pages.sparkSession, {preset: domain(preset, **more) for preset in ROLES}, base.withColumnRenamed("preset", "domain"))
    if ask:
        own = Domain("more", {t: rf"\b{p}s?\b" for t, p in (more.get("terms") or {}).items()}, tuple(more.get("stopwords", ())), tuple(more.get("headers", ())), info=more.get("info", ""))
        each = D.described(settled(inferred(pages, ask, store)), each, own)
    return Analysis(pages, each, models, store)


def audit(analysis: Analysis, query: str) -> DataFrame:
    return analysis.audit([query])

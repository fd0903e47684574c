"""Domains as tables: what belongs to each domain, and which document is of which. Any number of domains is one plan.

Terms are held against texts by their forms. A text is cut into pieces, runs of word characters and of others; a form
is the pieces that it spells, in lower case. A text holds a form where the same pieces follow each other, so the two are
joined by equality of domain and first piece, and the pieces that follow are compared afterwards. Forms that need a word
boundary at one end only are joined by three letters of a word.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions.vocabulary import STOPWORDS, TEMPLATE, Domain, forms_of, java

PIECE = "([a-z0-9_]+|[^a-z0-9_]+)"
WORD = "^[a-z0-9_]"
FORMS = "key string, how string, form array<string>"  # how: whole, starts, ends


@dataclass(frozen=True)
class Domains:
    """terms: domain, term, pos. forms: domain, term and FORMS. words: domain, kind (stop, header, actor), word. about: domain, name, role, template, info.

    of (doc_id, domain) has a row for each document; None if ``only`` is the domain of all. patterns lists the
    (domain, term, pattern) that the caller gave and that no forms spell.
    """

    terms: DataFrame
    forms: DataFrame
    words: DataFrame
    about: DataFrame
    of: DataFrame | None = None
    only: str | None = None
    patterns: tuple[tuple[str, str, str], ...] = ()

    def assign(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the domain of their document; rows of other documents are left out."""
        return rows.withColumn("domain", F.lit(self.only)) if self.of is None else rows.join(self.of, "doc_id")

    def of_kind(self, kind: str, name: str) -> DataFrame:
        return self.words.filter(F.col("kind") == kind).select("domain", F.col("word").alias(name))

    def without(self, rows: DataFrame, kind: str, name: str) -> DataFrame:
        """``rows`` (with domain) less those whose ``name`` is a word of the kind. The stop words that all domains have are literals."""
        if kind == "stop":
            rows = rows.filter(~F.col(name).isin(STOPWORDS))
        return rows.join(self.of_kind(kind, name), ["domain", name], "left_anti")


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(PIECE), F.lit(1))


def spelled(text: Column) -> Column:
    """The forms (structs of FORMS) of a term given by its own words, with or without an s. A text without a word's character has none."""
    own = pieces(text)
    more = F.concat(F.slice(own, 1, F.size(own) - 1), F.array(F.concat(F.element_at(own, -1), F.lit("s"))))
    others = F.concat(own, F.array(F.lit("s")))  # after a sign the s stands apart
    both = F.when(F.size(own) == 0, F.array().cast("array<array<string>>")).when(F.element_at(own, -1).rlike(WORD), F.array(own, more)).otherwise(F.array(own, others))
    return F.transform(both, lambda form: F.struct(form[0].alias("key"), F.lit("whole").alias("how"), form.alias("form")))


def held(rows: DataFrame, forms: DataFrame, by: str) -> DataFrame:
    """doc_id, rule_ord, term: which of ``rows`` (doc_id, rule_ord, ``by``, text) hold which terms of ``forms`` (``by``, term and FORMS).

    One small row is read of the forms first: their greatest length and which kinds there are.
    """
    kinds = forms.agg(F.max(F.size("form")).alias("longest"), F.max((~F.col("key").rlike(WORD) & (F.col("how") == "whole")).cast("int")).alias("signs"), F.max((F.col("how") != "whole").cast("int")).alias("parts")).first()
    longest = kinds["longest"] or 0
    cut = rows.select("doc_id", "rule_ord", by, pieces(F.col("text")).alias("_p"))
    if longest <= 1 and not kinds["signs"]:
        at = cut.select("doc_id", "rule_ord", by, F.explode(F.array_distinct("_p")).alias("_piece")).withColumns({"_i": F.lit(1), "_left": F.lit(2), "_next": F.array("_piece")})
    else:
        at = cut.select("doc_id", "rule_ord", by, "_p", F.posexplode("_p").alias("_i", "_piece"))
        at = at.select("doc_id", "rule_ord", by, "_piece", "_i", (F.size("_p") - F.col("_i")).alias("_left"), F.slice("_p", F.col("_i") + 1, max(longest, 1)).alias("_next"))
    if not kinds["signs"]:
        at = at.filter(F.col("_piece").rlike(WORD))
    key = lambda how, k: F.struct(F.lit(how).alias("how"), k.alias("key"))
    keys = [key("whole", F.col("_piece"))] + ([key("starts", F.left("_piece", F.lit(3))), key("ends", F.right("_piece", F.lit(3)))] if kinds["parts"] else [])
    at = at.select("*", F.inline(F.array(*keys)))
    found = at.join(forms, [by, "how", "key"])
    size, first, last = F.size("form"), F.col("form")[0], F.element_at("form", -1)
    whole = (F.slice("_next", 1, size) == F.col("form")) & (first.rlike(WORD) | (F.col("_i") > 0)) & (last.rlike(WORD) | (F.col("_left") > size))
    right = F.when(F.col("how") == "whole", whole).when(F.col("how") == "starts", F.startswith("_piece", first)).otherwise(F.endswith("_piece", first))
    return found.filter(right).select("doc_id", "rule_ord", "term").distinct()


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's own values, which is broadcast wherever it is joined."""
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return F.broadcast(spark.createDataFrame(pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})))


def table(spark: SparkSession, domains: Domain | Domains | Mapping[str, Domain], of: DataFrame | None = None) -> Domains:
    """The tables of one domain for all documents, or of several by the name that ``of`` (doc_id, domain) uses."""
    if isinstance(domains, Domains):
        return domains
    only = domains.name if isinstance(domains, Domain) else None
    each = {only: domains} if isinstance(domains, Domain) else dict(domains)
    terms, forms, words, about, patterns = [], [], [], [], []
    for name, d in each.items():
        about.append((name, d.name, d.role, d.template, d.info))
        words += [(name, kind, w) for kind, ws in (("stop", dict.fromkeys(d.stopwords)), ("header", dict.fromkeys(h.lower() for h in d.headers)), ("actor", dict.fromkeys(d.actors))) for w in ws if kind != "stop" or w not in _COMMON]
        for pos, (term, pattern) in enumerate(d.terms.items()):
            terms.append((name, term, pos))
            found = forms_of(pattern)
            if found is None:
                patterns.append((name, term, pattern))
            for how, text in found or ():
                own = _pieces(text)
                key = text[:3] if how == "starts" else text[-3:] if how == "ends" else own[0]
                forms.append((name, term, key, how, own))
    return Domains(
        local(spark, terms, "domain string, term string, pos int"), local(spark, forms, "domain string, term string, key string, how string, form array<string>"),
        local(spark, words, "domain string, kind string, word string"), local(spark, about, "domain string, name string, role string, template string, info string"), of, only, tuple(patterns),
    )


_COMMON = frozenset(STOPWORDS)


def _pieces(text: str) -> list[str]:
    return re.findall(PIECE[1:-1], text.lower())


def described(found: DataFrame, base: Domains, own: Domain) -> Domains:
    """``base`` and the domains of ``found`` (doc_id, name, terms, headers, role), equal descriptions being one domain.

    Their terms match by their own words; they have the general stop words and no actors. Terms, stop words and headers
    of ``own`` are added to each, as is its info. ``base`` has the other documents.
    """
    described_ = F.struct("name", "role", "terms", "headers")
    rows = found.select("doc_id", F.sha2(F.to_json(described_), 256).alias("domain"), "name", "role", "terms", "headers")
    each = rows.drop("doc_id").dropDuplicates(["domain"])
    more = {t: [f for f in forms_of(p) or ()] for t, p in own.terms.items()}
    count = F.size("terms")
    kept = F.filter(F.array(*map(F.lit, own.terms)).cast("array<string>"), lambda t: ~F.array_contains("terms", t))
    terms = each.select("domain", F.posexplode(F.concat("terms", kept)).alias("pos", "term")).select("domain", "term", "pos")
    forms = each.select("domain", F.explode("terms").alias("term"))
    if own.terms:
        forms = forms.filter(~F.col("term").isin(list(own.terms)))
    forms = forms.select("domain", "term", F.inline(spelled(F.col("term"))))
    names = each.select("domain")
    extra = [(t, text[:3] if how == "starts" else text[-3:] if how == "ends" else _pieces(text)[0], how, _pieces(text)) for t, fs in more.items() for how, text in fs]
    if extra:  # the caller's own terms, for each domain
        own_forms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(key).alias("key"), F.lit(how).alias("how"), F.array(*map(F.lit, form)).alias("form")) for t, key, how, form in extra])
        forms = forms.unionByName(names.select("domain", F.inline(own_forms)))
    lits = lambda xs, kind: F.transform(F.array(*map(F.lit, xs)).cast("array<string>"), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    headers = F.transform(F.array_distinct(F.transform(F.concat("headers", F.array(*map(F.lit, own.headers)).cast("array<string>")), F.lower)), lambda w: F.struct(F.lit("header").alias("kind"), w.alias("word")))
    words = each.select("domain", F.inline(F.concat(headers, lits([w for w in own.stopwords if w not in _COMMON], "stop"))))
    about = each.select("domain", "name", "role", F.lit(TEMPLATE).alias("template"), F.lit(own.info).alias("info"))
    of = rows.select("doc_id", "domain")
    other = base.of if base.of is not None else None
    return Domains(
        base.terms.unionByName(terms.withColumn("pos", F.col("pos").cast("int"))), base.forms.unionByName(forms), base.words.unionByName(words), base.about.unionByName(about),
        of if other is None else other.join(of.select("doc_id"), "doc_id", "left_anti").unionByName(of), None, (*base.patterns, *[("*", t, p) for t, p in own.terms.items() if forms_of(p) is None]),
    )


def matches(rules: DataFrame, domains: Domain | Domains) -> DataFrame:
    """doc_id, rule_ord, term: the curated terms of its domain that each rule holds."""
    d = table(rules.sparkSession, domains)
    rows = d.assign(rules.select("doc_id", "rule_ord", "text"))
    found = held(rows, d.forms, "domain")
    if d.patterns:  # a few literals
        hit = [F.when(((F.col("domain") == name) | F.lit(name == "*")) & F.col("text").rlike(java(pattern)), F.lit(term)) for name, term, pattern in d.patterns]
        others = rows.select("doc_id", "rule_ord", "domain", F.explode(F.array_compact(F.array(*hit))).alias("term"))
        found = found.unionByName(others.join(d.terms.select("domain", "term"), ["domain", "term"], "left_semi").select("doc_id", "rule_ord", "term")).distinct()
    return found


TABLES = ("terms", "forms", "words", "about", "of")


def tables_of(d: Domains, documents: DataFrame) -> dict[str, DataFrame]:
    """The tables to write so that :func:`read` finds these domains again; ``documents`` has the doc_ids."""
    of = d.of if d.of is not None else documents.select("doc_id").distinct().withColumn("domain", F.lit(d.only))
    return {f"domain_{name}": one for name, one in zip(TABLES, (d.terms, d.forms, d.words, d.about, of), strict=True)}


def read(spark: SparkSession, path: str) -> Domains:
    """Domains from the tables of :func:`tables_of`; patterns that no forms spell are not kept."""
    terms, forms, words, about, of = (spark.read.parquet(f"{path}/domain_{name}") for name in TABLES)
    return Domains(terms, forms, words, about, of)

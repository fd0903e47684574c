"""Terms of a document's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions.vocabulary import Domain
from specloom.operators import domains as D
from specloom.operators.domains import Domains

TOP = 20


def tokens(rules: DataFrame, domain: Domain | Domains) -> DataFrame:
    """doc_id, rule_ord, pos, term, domain: whole ASCII words of three letters or more, lower case, without stop words."""
    d = D.table(rules.sparkSession, domain)
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![A-Za-z0-9_])([a-z]{3,})(?![A-Za-z0-9_])"), F.lit(1))
    rows = d.assign(rules.select("doc_id", "rule_ord", "text")).select("doc_id", "rule_ord", "domain", F.posexplode(words).alias("pos", "term"))
    return d.without(rows, "stop", "term")


def frequencies(rules: DataFrame, domain: Domain | Domains) -> DataFrame:
    """doc_id, domain, term, freq, first: occurrences, and where a term comes first."""
    return tokens(rules, domain).groupBy("doc_id", "domain", "term").agg(F.count("*").alias("freq"), F.min(F.struct("rule_ord", "pos")).alias("first"))


def top_terms(rules: DataFrame, domain: Domain | Domains, n: int = TOP) -> DataFrame:
    """doc_id, domain, term, freq, rank: the ``n`` most frequent terms, the earlier one first at a tie."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("freq"), "first")
    return frequencies(rules, domain).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("first")


def curated_matches(rules: DataFrame, domain: Domain | Domains) -> DataFrame:
    """doc_id, rule_ord, term: the curated terms of its domain that a rule holds."""
    return D.matches(rules, domain)


def curated_frequencies(rules: DataFrame, domain: Domain | Domains, found: DataFrame | None = None) -> DataFrame:
    """doc_id, term, freq, pos: rules that hold each curated term; terms without a rule stay, with 0. ``found`` are the matches, if they are there already."""
    d = D.table(rules.sparkSession, domain)
    all_terms = d.assign(rules.select("doc_id").distinct()).join(d.terms, "domain").select("doc_id", "term", "pos")
    n = (curated_matches(rules, d) if found is None else found).groupBy("doc_id", "term").agg(F.count("*").alias("freq"))
    return all_terms.join(n, ["doc_id", "term"], "left").select("doc_id", "term", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"), "pos")


def merged(rules: DataFrame, domain: Domain | Domains, found: DataFrame | None = None) -> DataFrame:
    """doc_id, term_ord, term, freq, curated: curated terms and the top ones that are not curated, by falling frequency."""
    d = D.table(rules.sparkSession, domain)
    curated = curated_frequencies(rules, d, found).select("doc_id", "term", "freq", F.lit(True).alias("curated"), "pos")
    others = top_terms(rules, d).join(d.terms.select("domain", "term"), ["domain", "term"], "left_anti").select("doc_id", "term", "freq", F.lit(False).alias("curated"), F.col("rank").alias("pos"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("freq"), F.desc("curated"), "pos")
    return curated.unionByName(others).withColumn("term_ord", F.row_number().over(order)).drop("pos")


def mentions(rules: DataFrame, terms: DataFrame, domain: Domain | Domains, found: DataFrame | None = None) -> DataFrame:
    """doc_id, rule_ord, term, term_ord: which rules mention which terms.

    A term that is not curated is one alphabetic word with or without an s, so it joins with the rules'
    words by equality.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), F.lit(1)))
    by_word = rules.select("doc_id", "rule_ord", F.explode(words).alias("word"))
    forms = terms.filter("NOT curated").select("doc_id", "term", F.explode(F.array("term", F.concat("term", F.lit("s")))).alias("word"))
    plain = by_word.join(forms, ["doc_id", "word"]).select("doc_id", "rule_ord", "term").distinct()
    return plain.unionByName(curated_matches(rules, domain) if found is None else found).join(terms.select("doc_id", "term", "term_ord"), ["doc_id", "term"])


def stride_sample(rules: DataFrame, most: int = 120) -> DataFrame:
    """At most ``most`` rules of each document, at even steps: every max(1, n div most)-th."""
    doc = Window.partitionBy("doc_id")
    rows = rules.withColumn("_i", F.row_number().over(doc.orderBy("rule_ord")) - 1).withColumn("_step", F.greatest(F.lit(1), F.floor(F.count("*").over(doc) / most)).cast("int"))
    return rows.filter((F.col("_i") % F.col("_step") == 0) & (F.col("_i") / F.col("_step") < most)).drop("_i", "_step")


def named(rules: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terms, mentions) for the terms of ``found`` (doc_id, term, pos), like :func:`merged` and :func:`mentions`.

    freq counts the rules that hold a term, with or without an s. Rules and terms are joined by document and first piece.
    """
    forms = found.select("doc_id", "term", F.inline(D.spelled(F.col("term"))))
    held = D.held(rules.select("doc_id", "rule_ord", "text"), forms, "doc_id")
    n = held.groupBy("doc_id", "term").agg(F.count("*").alias("freq"))
    rows = found.join(n.hint("merge"), ["doc_id", "term"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)).cast("long"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("freq"), "pos")
    terms = rows.select("doc_id", "term", "freq", F.lit(False).alias("curated"), F.row_number().over(order).alias("term_ord"))
    return terms, held.join(terms.select("doc_id", "term", "term_ord"), ["doc_id", "term"])

"""Keeping the tables of a collection up to date: only documents that changed are worked on, only their buckets are written."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions.vocabulary import Domain
from specloom.operators import blocks
from specloom.operators.domains import Domains
from specloom.plans.pipeline import Analysis
from specloom.sources import artifacts

BUCKETS = 256  # of documents, by a hash of doc_id; fixed with the first build
MANIFEST = "manifest.json"
TABLES = ("blocks", "tree", "ledger", "nodes", "edges")


@dataclass(frozen=True)
class Update:
    changed: int  # documents that are new or whose pages or domain are not what they were
    removed: int
    buckets: tuple[int, ...]  # those that were written


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("bucket")


def fingerprints(pages: DataFrame, domain: Domain | Domains) -> DataFrame:
    """doc_id, fingerprint: of all pages by number, and of what the document's domain says. Pages are hashed before they are gathered."""
    by_page = pages.filter("text IS NOT NULL AND text <> ''").select("doc_id", "page_number", F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))
    own = by_page.groupBy("doc_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("page_number", "h")))), 256).alias("h"))
    if isinstance(domain, Domain):
        told = own.withColumn("d", F.lit(json.dumps(asdict(domain), sort_keys=True)))
    else:
        said = [t.select("domain", F.sha2(F.to_json(F.struct(*[c for c in t.columns if c != "domain"])), 256).alias("h")) for t in (domain.terms, domain.forms, domain.words, domain.about)]
        every = said[0].unionByName(said[1]).unionByName(said[2]).unionByName(said[3]).groupBy("domain").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
        told = domain.assign(own).join(every, "domain")
    return told.select("doc_id", F.sha2(F.concat("h", "d"), 256).alias("fingerprint"))


def _manifest(spark: SparkSession, folder: str) -> dict:
    text = artifacts.get_text(spark, f"{folder}/{MANIFEST}")
    return json.loads(text) if text else {}


def read(spark: SparkSession, folder: str, table: str, buckets: list[int] | None = None) -> DataFrame | None:
    """A table as the last finished update left it, with bucket; only some buckets if they are given. None before the first."""
    at = {int(b): v for b, v in _manifest(spark, folder).get("buckets", {}).items() if buckets is None or int(b) in buckets}
    out = None
    for version in sorted(set(at.values())):  # at most one for each bucket
        one = spark.read.parquet(f"{folder}/versions/{version}/{table}").filter(F.col("bucket").isin([b for b, v in at.items() if v == version]))
        out = one if out is None else out.unionByName(one)
    return out


def update(pages: DataFrame, folder: str, domain: Domain | Domains, models=None, buckets: int = BUCKETS) -> Update:
    """Bring the tables of TABLES under ``folder`` up to date with ``pages``, which are all pages there are.

    Documents are told by fingerprint. The tables of new and changed ones are made; in their buckets, and those of removed
    ones, the other documents' rows are copied. The buckets are written in a folder of their own, and a small file
    that names each bucket's folder is renamed into place at the end, so readers see all of an update or none of it.
    """
    spark = pages.sparkSession
    before = _manifest(spark, folder)
    buckets = before.get("n", buckets)
    with artifacts.tables_made() as made:
        now = artifacts.settled(fingerprints(pages, domain).select("doc_id", "fingerprint", _bucket(buckets)))
        old = read(spark, folder, "fingerprints")
        if old is None:
            old = now.filter("false")
        changed = artifacts.settled(now.join(old, ["doc_id", "fingerprint"], "left_anti").select("doc_id", "bucket"))
        removed = artifacts.settled(old.join(now, "doc_id", "left_anti").select("doc_id", "bucket"))
        gone = changed.unionByName(removed)
        touched = sorted(r["bucket"] for r in gone.select("bucket").distinct().collect())  # at most all buckets
        said = Update(changed.count(), removed.count(), tuple(touched))
        if touched:
            version = uuid.uuid4().hex
            a = Analysis(pages.join(changed.select("doc_id"), "doc_id", "left_semi"), domain, models or {})
            new = {"blocks": a.blocks, "tree": blocks.outline(a.plain_blocks), "ledger": a.rules, "nodes": a.nodes, "edges": a.edges, "fingerprints": now.join(changed.select("doc_id"), "doc_id", "left_semi").drop("bucket")}
            for name, df in new.items():
                rows, kept = df.withColumn("bucket", _bucket(buckets)), read(spark, folder, name, touched)
                if kept is not None:
                    rows = rows.unionByName(kept.join(gone.select("doc_id"), "doc_id", "left_anti"), allowMissingColumns=True)
                rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/versions/{version}/{name}")
            at = before.get("buckets", {}) | {str(b): version for b in touched}
            artifacts.put_text(spark, f"{folder}/{MANIFEST}", json.dumps({"n": buckets, "buckets": at}))
            used = set(at.values()) | set(before.get("buckets", {}).values())  # readers of the update before may still be at work
            for old_version in artifacts.children(spark, f"{folder}/versions"):
                if old_version not in used:
                    artifacts.delete(spark, f"{folder}/versions/{old_version}")
    artifacts.released(spark, made)
    return said

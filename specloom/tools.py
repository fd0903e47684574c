"""The two tools, parse and audit, for use from Python and from the command line.

    python -m specloom.tools parse PAGES [OUTPUT] [DOMAIN] [--info TEXT] [--kind parquet]
    python -m specloom.tools audit QUERY [OUTPUT]
"""

from __future__ import annotations

import argparse
import shlex
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions.vocabulary import domain as preset_of
from specloom.operators import blocks, search
from specloom.operators import domains as D
from specloom.operators.index import NodeIndex
from specloom.plans.pipeline import Analysis, parse_each
from specloom.sources import artifacts
from specloom.sources.corpus import read_pages

OUTPUT = "./output_standard_parser"
DOMAINS = ("auto", "generic", "smartGrid", "security")
TABLES = ("blocks", "tree", "ledger", "nodes", "edges")
INDEX = "index"


def _checked(**arguments) -> None:
    wrong = [f"{k}: a text of one character or more is expected" for k, v in arguments.items() if not isinstance(v, str) or not v]
    if wrong:
        raise ValueError("Invalid parameters: " + ", ".join(wrong))


def standard_parse(spark: SparkSession, pages: DataFrame | str, output_dir: str = OUTPUT, domain: str = "auto", additional_domain_info: str | None = None, models=None, base: str = ".", kind: str = "parquet", apart: bool = False) -> str:
    """Parse pages, write all tables and artefacts under ``output_dir`` (inside ``base``, on any file system), and say what was found.

    The tables of TABLES and the domains' are written as parquet in a new folder, which takes the place of the last one when
    all are there. The first three are also written as JSON, like each document's graph, cleaned text and explorer; many
    documents are packed in one file, or with ``apart`` the texts get a file each.
    """
    _checked(output_dir=output_dir, domain=domain)
    if domain not in DOMAINS:
        raise ValueError(f"Invalid parameters: domain: one of {', '.join(DOMAINS)} is expected")
    if isinstance(pages, str):
        _checked(pages=pages)
        pages = read_pages(spark, artifacts.inside(base, pages), kind)
    out = artifacts.inside(base, output_dir)
    info = additional_domain_info or ""
    with artifacts.tables_made() as made:
        a = parse_each(pages, models, info=info) if domain == "auto" else Analysis(pages, preset_of(domain, info=info), {k: v for k, v in (models or {}).items() if k != "domain"})
        if a.lines.isEmpty():
            raise ValueError("no page has a text")
        tables = {"blocks": a.blocks, "tree": blocks.outline(a.plain_blocks), "ledger": a.rules, "nodes": a.nodes, "edges": a.edges} | D.tables_of(a.domains, a.pages)
        folder = artifacts.write_tables(spark, tables, out)
        markdown = blocks.markdown(a.plain_blocks)
        artifacts.write_texts(markdown, "markdown", f"{out}/document_cleaned", apart)
    written, d = {t: spark.read.parquet(f"{folder}/{t}") for t in TABLES}, D.read(spark, folder)
    artifacts.released(spark, made)
    NodeIndex.build(written["nodes"], f"{folder}/{INDEX}")
    for t in TABLES[:3]:
        written[t].write.mode("overwrite").json(f"{out}/{t}_json")
    graphs = artifacts.graph_json(written["nodes"], written["edges"])
    about = d.assign(graphs.select("doc_id")).join(d.about, "domain").drop("domain").withColumnRenamed("name", "detected_domain")
    graphs.join(about, "doc_id").write.mode("overwrite").json(f"{out}/knowledge_graph")
    artifacts.write_texts(artifacts.html_pages(graphs), "html", f"{out}/graph_explorer", apart)
    names = d.of.groupBy("domain").agg(F.count("*").alias("n")).join(d.about, "domain").orderBy(F.desc("n"), "name").limit(SHOWN + 1).collect()
    lines = [f"Detected domains: {', '.join(r['name'] for r in names[:SHOWN])}{' and others' if len(names) > SHOWN else ''}", f"Outputs saved to: {out}", f"Parsed {written['blocks'].count()} layout blocks and mined {written['ledger'].count()} requirements.", "Nodes:"]
    lines += [f"  - {r['label']}: {r['n']}" for r in written["nodes"].groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()]
    lines += ["Edges:"] + [f"  - {r['type']}: {r['n']}" for r in written["edges"].groupBy("type").agg(F.count("*").alias("n")).orderBy("type").collect()]
    return "\n".join(lines)


SHOWN = 20  # of what the screen lists; all is written


def standard_audit(spark: SparkSession, query: str, output_dir: str = OUTPUT, base: str = ".", apart: bool = False) -> DataFrame:
    """doc_id, query, payload for each document that :func:`standard_parse` wrote under ``output_dir``; the payloads are written there too."""
    _checked(query=query, output_dir=output_dir)
    out = artifacts.inside(base, output_dir)
    folder = artifacts.current(spark, out)
    if not folder:
        raise ValueError(f"no graph is found in {output_dir}; parse the pages first")
    nodes, edges = (spark.read.parquet(f"{folder}/{t}") for t in ("nodes", "edges"))
    d = D.read(spark, folder)
    with artifacts.tables_made() as made:
        found = None  # an index is written last, so a parse that was ended before has none
        if artifacts.exists(spark, f"{folder}/{INDEX}/counts/_SUCCESS"):
            found = artifacts.settled(NodeIndex(spark, f"{folder}/{INDEX}", nodes.withColumn("bucket", F.lit(0)).schema).targets([query], d))
        payloads = artifacts.settled(search.payload(nodes, edges, [query], d, found))
        kept = made.pop()  # the result itself
    artifacts.released(spark, [x for x in made if x != kept])
    artifacts.write_payloads(payloads, out, apart)
    return payloads


def command(spark: SparkSession, line: str | list[str], base: str = ".") -> str:
    """Run a command given as one line (quotes hold words together) or as its words."""
    parser = argparse.ArgumentParser(prog="specloom", exit_on_error=False)
    tools = parser.add_subparsers(dest="tool", required=True)
    parse = tools.add_parser("parse", exit_on_error=False)
    parse.add_argument("pages")
    parse.add_argument("output", nargs="?", default=OUTPUT)
    parse.add_argument("domain", nargs="?", default="auto")
    parse.add_argument("--info", default=None)
    parse.add_argument("--kind", default="parquet")
    audit = tools.add_parser("audit", exit_on_error=False)
    audit.add_argument("query")
    audit.add_argument("output", nargs="?", default=OUTPUT)
    a = parser.parse_args(shlex.split(line) if isinstance(line, str) else line)
    if a.tool == "parse":
        return standard_parse(spark, a.pages, a.output, a.domain, a.info, base=base, kind=a.kind)
    shown = standard_audit(spark, a.query, a.output, base).orderBy("doc_id").limit(SHOWN).collect()
    return "\n\n".join(f"Document {r['doc_id']}\n{r['payload']}" for r in shown)


if __name__ == "__main__":
    print(command(SparkSession.builder.appName("specloom").getOrCreate(), sys.argv[1:]))

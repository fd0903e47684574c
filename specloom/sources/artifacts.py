"""Writing and reading what the pipeline makes, on any file system that Spark reads."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = "doc_id long, nodes array<struct<id:string,label:string,properties:map<string,string>>>, edges array<struct<source:string,target:string,type:string,properties:map<string,string>>>"


def shared_folder(spark: SparkSession) -> str:
    """A new folder inside the one that the driver and all executors share; for a local master without one, in a temporary folder of the session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("specloom.engine.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='specloom-')}"
        spark.conf.set("specloom.engine.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once in the shared folder and read again: its lineage ends there, and a lost executor costs nothing of it.

    It is joined by sorting: Spark takes the size of its compressed files for that of its rows, also of those that are exploded from
    them, and would send far more than it counts on through the driver. A union or a join above it needs the hint anew.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    for made in _scopes.get():
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("engine_scopes", default=())


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """Gathers the folders that :func:`settled` writes inside, so that :func:`released` can delete them when nothing reads them any more."""
    made: list[str] = []
    before = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(before)


def released(spark: SparkSession, folders: list[str]) -> None:
    for path in folders:
        delete(spark, path)
    folders.clear()


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system and the path in it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = _path(spark, path)
    return fs.exists(found)


def delete(spark: SparkSession, path: str) -> None:
    fs, found = _path(spark, path)
    fs.delete(found, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, found = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(found)) if fs.exists(found) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that a reader sees the old or the new one, never a part: it is renamed into its place."""
    fs, found = _path(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark._sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(found.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(found), how)


def get_text(spark: SparkSession, path: str) -> str | None:
    return spark.read.text(path, wholetext=True).first()["value"] if exists(spark, path) else None


_URI = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*")


def inside(base: str, target: str) -> str:
    """``target`` under ``base`` as a URI; anything that leads outside is refused. A base without a scheme is a folder of this machine's file system."""
    head = _URI.match(base)
    if not head:
        root, path = Path(base).resolve(), (Path(base) / target).resolve()
        if not path.is_relative_to(root):
            raise ValueError(f"{target} is outside {base}")
        return f"file://{path}"
    root = posixpath.normpath("/" + base[head.end() :].strip("/"))
    own = _URI.match(target)
    if own and own[0] != head[0]:
        raise ValueError(f"{target} is outside {base}")
    path = posixpath.normpath(target[own.end() :] if own else posixpath.join(root, target))
    if path != root and not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{target} is outside {base}")
    return head[0] + path


CURRENT = "current"


def write_tables(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> str:
    """Write all tables in a new folder of versions under ``path`` and then switch to it; a failure leaves the version before. Older ones but that go."""
    before = get_text(spark, f"{path}/{CURRENT}")
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/versions/{version}/{name}")
    put_text(spark, f"{path}/{CURRENT}", version)
    for old in children(spark, f"{path}/versions"):
        if old not in (version, before):
            delete(spark, f"{path}/versions/{old}")
    return f"{path}/versions/{version}"


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that was switched to last."""
    version = get_text(spark, f"{path}/{CURRENT}")
    return version and f"{path}/versions/{version.strip()}"


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per document with its graph as nested arrays, for a JSON writer."""
    props = lambda cs: F.map_filter(F.create_map(*[x for c in cs for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
    n = F.struct("node_ord", "id", "label", props(["name", "frequency", "section_number", "title", "text", "constraint_type", "page_number"]).alias("properties"))
    e = F.struct("edge_ord", "source", "target", "type", props(["context", "reason", "shared_term"]).alias("properties"))
    right = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(e), lambda a, b: a["edge_ord"] - b["edge_ord"]).alias("e"))
    left = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(n), lambda a, b: a["node_ord"] - b["node_ord"]).alias("n"))
    drop = lambda c, own: F.transform(c, lambda x: F.struct(*[x[k].alias(k) for k in own]))
    return left.join(right, "doc_id", "left").select("doc_id", drop(F.col("n"), ["id", "label", "properties"]).alias("nodes"), drop(F.coalesce("e", F.array()), ["source", "target", "type", "properties"]).alias("edges"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON graphs; rows without both arrays are left out."""
    rows = spark.read.schema(GRAPH).json(path).filter("nodes IS NOT NULL AND edges IS NOT NULL")
    n = rows.select("doc_id", F.posexplode("nodes").alias("i", "v"))
    p = lambda k: F.col("v.properties")[k].alias(k)
    nodes = n.select("doc_id", (F.col("i") + 1).alias("node_ord"), "v.id", "v.label", p("name"), F.col("v.properties")["frequency"].cast("long").alias("frequency"), p("section_number"), p("title"), p("text"), p("constraint_type"), F.col("v.properties")["page_number"].cast("int").alias("page_number"))
    e = rows.select("doc_id", F.posexplode("edges").alias("i", "v"))
    edges = e.select("doc_id", (F.col("i") + 1).alias("edge_ord"), "v.source", "v.target", "v.type", p("context"), p("reason"), p("shared_term"))
    return nodes, edges


def payload_name(query: str) -> str:
    return "audit_payload_" + "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in query) + ".md"


def explorer_html(graph: str) -> str:
    """A plain page that lists a graph given as JSON; what could end the script is escaped."""
    safe = graph.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    return (
        "<!doctype html><meta charset=utf-8><title>Graph</title><input id=q placeholder=Search><ul id=list></ul><script>"
        f"const graph = {safe};"
        "const show = () => { const q = document.getElementById('q').value.toLowerCase(), list = document.getElementById('list'); list.replaceChildren();"
        " for (const n of graph.nodes) if (JSON.stringify(n).toLowerCase().includes(q)) { const li = document.createElement('li'); li.textContent = n.id + ' ' + (n.properties.title || n.properties.text || n.properties.name || ''); list.append(li); } };"
        "document.getElementById('q').oninput = show; show();</script>"
    )


def write_texts(rows: DataFrame, column: str, path: str, apart: bool = False) -> None:
    """The documents' texts as JSON lines (doc_id, ``column``), many to a file; ``apart``: a text file for each document under path/doc_id=N."""
    if apart:
        rows.select("doc_id", F.col(column).alias("value")).repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").text(path)
    else:
        rows.select("doc_id", column).write.mode("overwrite").json(path)


def write_payloads(payloads: DataFrame, path: str, apart: bool = False) -> None:
    """Each query's payloads in a folder with the query's safe name."""
    for r in payloads.select("query").distinct().collect():  # the questions that were asked
        write_texts(payloads.filter(F.col("query") == r["query"]), "payload", f"{path}/{payload_name(r['query'])}", apart)


def html_pages(graphs: DataFrame) -> DataFrame:
    """doc_id, html: the explorer of each graph of :func:`graph_json`."""
    safe = F.to_json(F.struct("nodes", "edges"))
    for c, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        safe = F.replace(safe, F.lit(c), F.lit(code))
    before, after = explorer_html("\x00").split("\x00")
    return graphs.select("doc_id", F.concat(F.lit(before), safe, F.lit(after)).alias("html"))

from __future__ import annotations

import contextlib
import io
import json
import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from specloom import tools
from specloom.functions import text as T
from specloom.functions.vocabulary import Domain, domain, forms_of, java
from specloom.operators import assist, blocks, explore, graph, lines, rules, scans, search, terms
from specloom.operators import domains as D
from specloom.operators.index import NodeIndex
from specloom.plans import incremental, pipeline, registry
from specloom.plans.pipeline import Analysis, parse_documents, parse_each
from specloom.sources import artifacts
from specloom.sources.corpus import extract_pages, read_pages
from specloom.sources.replies import ReplyStore
from specloom.streaming import ingest
from tests.compare import database, difference

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE_SQL])
def test_query_equals_its_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, SMALL), database(SMALL), registry.ORACLE_SQL[name]) == ""


def test_all_constraint_types_occur(spark):
    assert {r["constraint_type"] for r in registry.rule_types(spark, SMALL).collect()} == set(T.MODALS)


@pytest.mark.parametrize(("line", "kind"), [
    ("1.0 Introduction", "heading"), ("Annex A (informative) - T", "heading"), ("A.1 General", "heading"), ("a device shall respond", "heading"), ("1. First item", "heading"), ("1) First", "list_item"), ("• B", "list_item"),
    ("150   $0.84", "table_row"), ("x | y", "table_row"), ("plain words", "text"), ("", "empty"), (" 1.2 Title", "heading"), ("éshall", "text"),
])
def test_line_kinds(spark, line, kind):
    assert spark.range(1).select(T.line_kind(T.strip(F.lit(line))).alias("k")).first()["k"] == kind


@pytest.mark.parametrize(("number", "normal"), [("1.0", "1"), ("1.0.0", "1"), ("0.0", "0"), ("Annex B.2", "B.2"), ("10", "10"), (" 4.0.1 ", "4.0.1")])
def test_normal_sections(spark, number, normal):
    assert spark.range(1).select(T.normal_section(F.lit(number)).alias("s")).first()["s"] == normal


@pytest.mark.parametrize(("text", "want"), [
    ("A b. C d! E?", ["A b.", "C d!", "E?"]), ("It is e.g. The rule. Next", ["It is e.g. The rule.", "Next"]), ('He said "no." Then left.', ['He said "no." Then left.']), ("vs . The x. Y", ["vs . The x.", "Y"]), ("one. 2 two", ["one. 2 two"]), ("", []), ("a\nb. C", ["a b.", "C"]),
])
def test_sentences(spark, text, want):
    assert spark.range(1).select(T.sentences(F.lit(text)).alias("s")).first()["s"] == want


def _hierarchy(numbers: list[str]) -> list[list[str]]:
    """Active ancestors after each heading, worked off one by one."""
    active: dict[str, str] = {}
    out = []
    for n in numbers:
        active[n] = n
        active = {k: v for k, v in active.items() if k == n or n.startswith(k + ".")}
        out.append([p for p in (".".join(n.split(".")[:i]) for i in range(1, n.count(".") + 1)) if p in active])
    return out


def test_hierarchy_of_random_headings(spark):
    rng = random.Random(3)
    docs = [["1", "1.1", "2", "1.1.2"]] + [[".".join(str(rng.randint(1, 3)) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 25))] for _ in range(60)]
    rows = [(d, i + 1, "heading", n, f"T{i}") for d, ns in enumerate(docs) for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "doc_id long, block_no int, type string, number string, title string")
    got = {(r["doc_id"], r["block_no"]): r for r in blocks.hierarchy(df).collect()}
    tree = {(r["doc_id"], r["sec_ord"]): r["parent_ord"] for r in blocks.outline(df).collect()}
    for d, ns in enumerate(docs):
        for i, want in enumerate(_hierarchy(ns)):
            assert got[d, i + 1]["parents"] == want and got[d, i + 1]["context"][-1] == f"T{i}"
            seen = [max((k for k in range(i) if ns[k] == ".".join(ns[i].split(".")[:j])), default=None) for j in range(ns[i].count("."), 0, -1)]
            parent = next((k for k in seen if k is not None), None)
            assert tree[d, i + 1] == (None if parent is None else parent + 1)


def test_page_edges(spark):
    page = "12\nTitle words\niv\nmild\nbody one\n7\nPrepared by X\nlast"
    kept = lines.clean_lines(lines.explode_pages(spark.createDataFrame([(1, 1, page), (2, 1, None), (3, 1, "")], "doc_id long, page_number int, text string")))
    assert [r["line"] for r in kept.orderBy("line_idx").collect()] == ["Title words", "mild", "body one", "last"]


def test_ids_do_not_lose_digits(spark):
    page = "\n\n".join(f"It shall be {i}." for i in range(1001))
    r = parse_documents(spark.createDataFrame([(1, 1, page)], "doc_id long, page_number int, text string")).rules
    assert r.filter("rule_ord = 1001").first()["id"] == "REQ-1001" and {x["section_number"] for x in r.collect()} == {"UNKNOWN"}


def test_replies_of_every_kind(spark):
    asked = spark.createDataFrame([(1, 0, "BLK-0001", "", 1), (1, 1, "BLK-0002", "2", 1), (1, 2, "BLK-0003", "2", 1)], "doc_id long, batch int, id string, section_number string, page_number int")
    ok = '```json\n[{"block_id":"BLK-0001","constraint_type":"Permission","text":" x "},{"block_id":"BLK-0002","constraint_type":"Mandatory","text":"y"},{"block_id":"BLK-0001","constraint_type":"Wish","text":"z"}]\n```'
    replies = spark.createDataFrame([(1, 0, ok), (1, 1, None), (1, 2, '[{"block_id":"BLK-0003","constraint_type":"Mandatory","text":"late"}]'), (2, 0, "not json"), (3, 0, "[]")], "doc_id long, batch int, reply string")
    none = spark.createDataFrame([(1, 4)], "doc_id long, rule_ord int")
    got = assist.new_rules(replies, asked, none).collect()
    assert [(r["id"], r["section_number"], r["text"]) for r in got] == [("REQ-005", "UNKNOWN", "x")]
    assert assist.new_rules(replies, asked, none, stop_at_null=False).count() == 2


def test_curated_patterns_keep_their_limits(spark):
    r = spark.createDataFrame([(1, 1, "a process"), (1, 2, "overcapacity capacities")], "doc_id long, rule_ord int, text string")
    assert {x["term"] for x in terms.curated_matches(r, domain("generic")).collect()} == set()
    assert {x["term"] for x in terms.curated_matches(r, domain("smartGrid")).collect()} == {"capacity"}
    more = domain("nothing", terms={"probe": "probe"}, stopwords=["probe"], actors=["robot"])
    assert more.name == "generic" and "probe" in more.terms and more.actors[-1] == "robot"


def test_documents_in_and_out(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "1 Scope\nThe unit shall wait.\n- <b>\n"), (1, 2, "It must not fail.")], "doc_id long, page_number int, text string")
    for kind in ("parquet", "json", "csv"):
        getattr(pages.write.option("header", True).option("escape", "\"").option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False) if kind == "csv" else pages.write, kind)(f"{tmp_path}/{kind}")
        assert sorted(map(tuple, read_pages(spark, f"{tmp_path}/{kind}", kind).collect())) == sorted(map(tuple, pages.collect()))
    a = parse_documents(pages, "security")
    artifacts.graph_json(a.nodes, a.edges).write.json(f"{tmp_path}/graph")
    nodes, edges = artifacts.read_graph(spark, f"{tmp_path}/graph")
    assert nodes.count() == a.nodes.count() and sorted(r["type"] for r in edges.collect()) == sorted(r["type"] for r in a.edges.collect())
    assert "<b>" not in artifacts.explorer_html('{"nodes": ["<b>"]}') and artifacts.payload_name("a b/c") == "audit_payload_a_b_c.md"
    with pytest.raises(ValueError):
        artifacts.inside(str(tmp_path), "../x")


def test_an_empty_table_gives_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, page_number int, text string")
    a = parse_documents(none)
    assert a.rules.count() == 0 and a.edges.count() == 0 and rules.implicit_candidates(a.blocks, a.rules).count() == 0


def _rows(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_edges_of_a_document_with_very_many_rules(spark):
    rules = _rows(spark, "doc_id long, rule_ord int, id string, section_number string, text string, constraint_type string", (1, 2_200, "REQ-2200", "1", "a widget shall", "Mandatory"), (1, 3_000_000, "REQ-3000000", "1", "a widget shall not", "Prohibition"), (1, 2_300, "REQ-2300", "1", "a widget shall not", "Prohibition"))
    mentions = _rows(spark, "doc_id long, rule_ord int, term string, term_ord int", *[(1, n, "widget", 1) for n in (2_200, 2_300, 3_000_000)])
    sections = _rows(spark, "doc_id long, sec_ord int, section string, id string, title string", (1, 1, "1", "SEC-1", "One")).withColumn("ord", F.col("sec_ord"))
    found = graph.edges(sections, rules, mentions, domain("generic")).filter("type = 'CONFLICTS_WITH'").orderBy("edge_ord").collect()
    assert [(r["source"], r["target"]) for r in found] == [("REQ-2200", "REQ-2300"), ("REQ-2200", "REQ-3000000")]


def test_sentences_keep_control_characters(spark):
    df = _rows(spark, "t string", ("One two\x01three. Four e.g. Five no. Six et al. Seven. Eight.\nNine",))
    assert df.select(T.sentences(F.col("t")).alias("s")).first()["s"] == ["One two\x01three.", "Four e.g. Five no. Six et al. Seven.", "Eight.", "Nine"]


def test_sentences_after_adjacent_abbreviations_are_those_of_the_sql(spark, tmp_path):
    said = ("Es la no. No. El fin.", "No. No. No. No. El fin.", "Y fig. Std. Vs. The x.", "La no. (No. El fin.", "Son. No. El fin.", "See et al. Et al. The x. No.", 'A "no." Ref. The x.')
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CAST(i AS BIGINT) AS doc_id, t AS text FROM (SELECT unnest(?) AS t, generate_subscripts(?, 1) AS i)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)", [said, said])
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert difference(registry.sentence_split(spark, str(tmp_path)), con, registry.ORACLE_SQL["sentence_split"]) == ""


def test_domain_patterns_keep_their_boundaries(spark):
    for pattern, text, want in ((r"\bc\+\+s?\b", "c++x", True), (r"\bc\+\+s?\b", "c++ ", False), (r"\btimeouts?\b", "a Timeouts.", True), (r"\btimeouts?\b", "timeouts_", False), (r"\bieee\s+\d+\b", "IEEE  2030", True), (r"\bieee\s+\d+\b", "IEEE 2030a", False)):
        assert _rows(spark, "t string", (text,)).select(F.col("t").rlike(java(pattern))).first()[0] == want


def test_the_last_reply_about_an_edge_wins(spark):
    edges = _rows(spark, "doc_id long, edge_ord int, source string, target string, type string", (1, 1, "REQ-001", "REQ-002", "REFERENCES"), (1, 2, "REQ-001", "SEC-1", "CONTAINS"))
    replies = _rows(spark, "doc_id long, batch int, reply string", (1, 0, '[{"source":"REQ-001","target":"REQ-002","type":"SUPERSEDES"},{"source":"REQ-001","target":"REQ-002","type":"IMPLEMENTS"}]'), (1, 1, '[{"source":"REQ-001","target":"REQ-002","type":"DEPENDS_ON"},{"source":"REQ-001","target":"REQ-002","type":"Wish"}]'))
    assert graph.refined(edges, assist.edge_changes(replies)).orderBy("edge_ord").first()["type"] == "DEPENDS_ON"
    assert [r["edge_ord"] for r in graph.refinable(edges).collect()] == [1]


def test_slots_in_texts_are_not_filled(spark):
    page = "1 Scope\nThe gateway shall show {linked_rules} and {role_description} at once.\nThe gateway shall not wait."
    a = parse_documents(_rows(spark, "doc_id long, page_number int, text string", (1, 1, page)))
    assert "show {linked_rules} and {role_description} at once" in a.audit(["REQ-001"]).first()["payload"]


def test_markdown_sets_top_sections_apart(spark):
    page = "1 One\nText.\n1.1 Sub\n- item\n2 Two\n| a | b |\n"
    a = parse_documents(_rows(spark, "doc_id long, page_number int, text string", (1, 1, page)))
    assert blocks.markdown(a.plain_blocks).first()["markdown"] == "# 1 One\n\nText.\n\n## 1.1 Sub\n\n- item\n\n\n\n# 2 Two\n\n```\n| a | b |\n```"


def _stream(spark, tmp_path, batch, **more):
    """Ingest one more file of pages."""
    _rows(spark, "doc_id long, page_number int, text string", *batch).coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages")
    query = ingest.ingest_rules(ingest.page_stream(spark, f"{tmp_path}/pages", 1), f"{tmp_path}/rules", f"{tmp_path}/state", domain("generic"), **more)
    query.awaitTermination()
    state = spark.read.format("statestore").load(f"{tmp_path}/state")
    values = [str(r["value"].asDict(True)) for r in state.collect()]
    return {(r["doc_id"], r["version"], r["rule_ord"], r["section_number"], r["text"]) for r in ingest.latest_rules(spark, f"{tmp_path}/rules").collect()}, values


def test_a_document_in_three_batches_gives_what_it_gives_at_once(spark, tmp_path):
    pages = [(7, 1, "1 One\nIt shall run."), (7, 2, "It may stop.\n2 Two\nIt must log."), (7, 3, "It should end."), (8, 1, "No modal here.")]
    _stream(spark, tmp_path, [pages[2], pages[3]])
    _stream(spark, tmp_path, [pages[0]])
    got, values = _stream(spark, tmp_path, [pages[1]])
    want = parse_documents(_rows(spark, "doc_id long, page_number int, text string", *pages)).rules.collect()
    assert got == {(7, 3, r["rule_ord"], r["section_number"], r["text"]) for r in want} and len(values) == 2
    got, _ = _stream(spark, tmp_path, [(7, 3, "Nothing more."), (8, 1, None)])  # a page that comes again
    assert {(d, v, t) for d, v, _, _, t in got} == {(7, 4, "It shall run."), (7, 4, "It may stop."), (7, 4, "It must log.")}


def test_closed_documents_leave_the_state_and_take_late_pages(spark, tmp_path):
    text, soon = "1 Scope\n" + "It shall be long. " * 500, {"hold_ms": 1, "late_ms": 1}
    _stream(spark, tmp_path, [(d, 1, f"{text} It shall be {d}.") for d in range(20)], **soon)
    _, values = _stream(spark, tmp_path, [(100, 1, "It may.")], **soon)
    assert len(values) == 21 and sum(map(len, values)) < 21 * 200  # the pages are gone, the versions stay
    got, values = _stream(spark, tmp_path, [(5, 2, "It must close.")], **soon)
    last = [r for r in sorted(got, key=lambda r: r[2]) if r[0] == 5]
    assert len(last) == 502 and last[-1][1:] == (2, 502, "1", "It must close.") and last[-2][4] == "It shall be 5."
    assert len(values) == 2  # the versions of the others have been forgotten


def test_an_update_writes_the_buckets_of_changed_documents_only(spark, tmp_path):
    schema = "doc_id long, page_number int, text string"
    pages = {d: f"1 Scope\nUnit {d} shall log a system{d % 3}.\n2 More\nIt must not fail." for d in range(24)}
    table = lambda: _rows(spark, schema, *[(d, 1, t) for d, t in pages.items()])
    folder = f"{tmp_path}/kept"
    first = incremental.update(table(), folder, domain("generic"), buckets=8)
    assert (first.changed, first.removed, len(first.buckets)) == (24, 0, 8)
    assert incremental.update(table(), folder, domain("generic")) == incremental.Update(0, 0, ())
    before = incremental._manifest(spark, folder)["buckets"]
    pages[3] = "1 Scope\nUnit 3 may rest."
    del pages[11]
    pages[30] = "1 New\nUnit 30 shall come."
    second = incremental.update(table(), folder, domain("generic"))
    after = incremental._manifest(spark, folder)["buckets"]
    assert (second.changed, second.removed) == (2, 1) and 1 <= len(second.buckets) <= 3 and {int(b) for b in after if after[b] != before.get(b)} == set(second.buckets)
    full = f"{tmp_path}/full"
    incremental.update(table(), full, domain("generic"), buckets=8)
    for name in incremental.TABLES:
        rows = [sorted(map(str, incremental.read(spark, f, name).select(*incremental.read(spark, full, name).columns).collect())) for f in (folder, full)]
        assert rows[0] == rows[1] and rows[0]
    with pytest.raises(Exception):  # noqa: B017
        incremental.update(table().withColumn("text", F.when(F.col("doc_id") == 4, F.raise_error(F.lit("no")).cast("string")).otherwise("x")), folder, domain("generic"))
    assert incremental._manifest(spark, folder)["buckets"] == after
    assert incremental.update(table(), folder, domain("generic", stopwords=["unit"])).changed == len(pages)  # another domain


def test_model_steps_of_the_pipeline(spark):
    page = "1 Scope\nOne heartbeat shall be sent. The heartbeat shall not stop.\n\n2 False one\nThe operator is responsible for logs.\n3 Limits\na | b\nc | d"
    say = lambda *x: lambda prompts: [json.dumps(list(x)) if "[" in p else None for p in prompts]
    models = {
        "headings": say(2), "implicit": say({"block_id": "BLK-0002", "constraint_type": "Mandatory", "text": "Logs."}, {"block_id": "BLK-0003", "constraint_type": "Mandatory", "text": "Keep logs."}),
        "tabular": lambda prompts: [json.dumps([{"blockId": x["id"], "constraintType": "Permission", "requirementText": "a may be c"} for x in json.loads(p)]) for p in prompts],
        "boilerplate": say("REQ-002"), "terms": say("Heartbeat", "client", "xy", "log"), "conflicts": say(), "edges": say(),
    }
    a = parse_documents(_rows(spark, "doc_id long, page_number int, text string", (1, 1, page)), "smartGrid", models)
    assert [r["line"] for r in a.lines.filter("kind = 'heading'").orderBy("line_no").collect()] == ["1 Scope", "3 Limits"]
    got = a.rules.orderBy("rule_ord").collect()
    assert "REQ-002" not in [r["id"] for r in got] and got[0]["text"] == "One heartbeat shall be sent." and "Keep logs." in [r["text"] for r in got] and (got[-1]["text"], got[-1]["all_matched_constraints"], got[-1]["section_number"]) == ("a may be c", ["LLM_TABULAR_EXTRACTED"], "3")
    terms = {r["term"]: r["freq"] for r in a.graph["terms"].collect()}
    assert terms["heartbeat"] == 1 and set(terms) == {"heartbeat", "log"} and a.edges.filter("type = 'CONFLICTS_WITH'").isEmpty()


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(4)
    words = ["timeout", "time", "out", "Log", "x", "ab", "é😀x", "😀", "the", "1.0", "A.1", "payload", "pay", "unit"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    rows = [(d, o, f"REQ-{o:03d}", "Requirement", None, None, text(8) or None, "1.0") if o % 3 else (d, o, f"SEC-{o}", "Section", None, text(3), None, "A.1") if o % 2 else (d, o, f"TERM-{o}", "Term", text(1), None, None, None) for d in range(12) for o in range(1, 30)]
    nodes = _rows(spark, "doc_id long, node_ord int, id string, label string, name string, title string, text string, section_number string", *rows)
    found = NodeIndex.build(nodes, f"file://{tmp_path}/index", 5)
    ids = lambda df: sorted((r["doc_id"], r["id"]) for r in df.collect())
    for q in ["timeout", "time out", "TIME", "out log", "x", "ab", "b", "é😀", "😀", "😀x", "d-0", "-", " ", "", "nothing", "eout", "1.0", "q", "log the unit pay"]:
        assert ids(found.containing(q)) == ids(explore.containing(nodes, q)), q
    asked = ["the timeout of a unit", "pay ab", "1.0", "zzz", "", "Log the payload x", "of the"]
    for d in (domain("generic"), Domain("x", {}, ("the", "unit"))):
        want = sorted(map(str, search.top(nodes, asked, d).collect()))
        assert want and sorted(map(str, found.top(asked, d).collect())) == want
        named = [*asked, "req-001", " REQ-002 ", "a.1", "SEC-5", "timeout", "Log", "x", "é😀x", "REQ-999"]
        assert sorted(map(str, found.targets(named, d).collect())) == sorted(map(str, search.targets(nodes, named, d).collect()))
    plan = found.candidates(["timeout"])._jdf.queryExecution().executedPlan().toString()
    assert "In(piece" in plan
    assert ids(NodeIndex(spark, found.folder).containing("pay")) == ids(explore.containing(nodes, "pay"))  # opened again
    empty = NodeIndex.build(nodes.limit(0), f"file://{tmp_path}/empty")
    assert empty.candidates(["timeout", "x"]).isEmpty() and empty.containing("").isEmpty() and empty.top(asked, domain("generic")).isEmpty()


def _sent_from_files(df) -> list[str]:
    """The files' scans that stand below a broadcast in the plan of ``df``: what goes through the driver by the size of its files alone."""
    out, found, depth = io.StringIO(), [], None
    with contextlib.redirect_stdout(out):
        df.explain()
    for line in out.getvalue().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        if depth is None and "BroadcastExchange" in line:
            depth = at
        found += [line] if depth is not None and "FileScan" in line else []
    return found


def test_model_terms_sends_no_table_through_the_driver(spark):
    assert _sent_from_files(registry.model_terms(spark, SMALL)) == []


def test_audit_sends_no_table_through_the_driver(spark, monkeypatch):
    a = Analysis(registry.corpus_pages(spark, SMALL), registry.DOMAIN)
    assert a.nodes.columns and a.terms
    sent = []
    keep = lambda df: (sent.extend(_sent_from_files(df)), artifacts.settled(df))[1]
    monkeypatch.setattr(pipeline, "settled", keep)
    monkeypatch.setattr(search, "settled", keep)
    made = a.audit(registry.AUDITED)
    assert sent == [] and _sent_from_files(made) == []


def test_context_sends_no_table_through_the_driver(spark, monkeypatch):
    a = registry.analysis(spark, SMALL)
    found, sent = search.targets(a.nodes, registry.SEARCH, registry.DOMAIN), []
    monkeypatch.setattr(search, "settled", lambda df: (sent.extend(_sent_from_files(df)), artifacts.settled(df))[1])
    made = search.expand(a.nodes, a.edges, found)
    assert sent == [] and [_sent_from_files(x) for x in made] == [[], []]


def test_audit_makes_only_the_conflicts_of_what_it_finds(spark):
    """Payloads made with a few pairs, and with the index, against those over all edges."""
    said = ["The gateway {} log a timeout within ten seconds.", "The payload {} reach the gateway, see Section 1.", "The interface {} keep the payload and the timeout."]
    text = "\n".join(["1 Scope", *[said[i % 3].format(["shall", "shall not", "may", "must", "must not"][i % 5]) for i in range(15)], "2 Rest", "Nothing else shall fail. See REQ-002."])
    pages = _rows(spark, "doc_id long, page_number int, text string", (1, 1, text), (2, 1, "1 Other\nThe gateway shall stop."), (3, 1, None), (4, 1, text))
    asked = ["REQ-001", "req-004", "gateway timeout payload", "TERM", "1", "Rest", "zzz", ""]
    a, b = parse_documents(pages, "smartGrid"), parse_documents(pages, "smartGrid")
    got = sorted(map(str, a.audit(asked).collect()))
    assert "graph" not in a.__dict__
    assert b.index and sorted(map(str, b.audit(asked).collect())) == got
    want = sorted(map(str, search.payload(a.nodes, a.edges, asked, a.domains).collect()))
    assert got == want == sorted(map(str, a.audit(asked).collect())) and any("Conflict between" in x for x in want)
    few = a.conflicts_of(search.targets(a.nodes, ["REQ-001"], a.domains)).count()
    assert 0 < few < a.edges.filter("type = 'CONFLICTS_WITH'").count() / 2


def test_long_documents_are_scanned_by_cells(spark, monkeypatch):
    """All tables made by cells of a few rows, against those of whole documents."""
    monkeypatch.setattr(scans, "CELL", 3)
    rng = random.Random(2)
    said = ["{0}.{1} Part {2}", "{0} Chapter", "{0}.{1}.{2} Small", "a | b", "", "- The log {1} shall hold. It shall not stop.", "The unit must log {2}.", "Units may stop the log, see Section {0}.{1}.", "lower words", "Annex A Rest"]
    pages = [(d, p, "\n".join(rng.choice(said).format(*(rng.randint(1, 3) for _ in range(3))) for _ in range(rng.randint(0, 25)))) for d in range(4) for p in range(1, 5)]
    pages = _rows(spark, "doc_id long, page_number int, text string", *pages, (9, 1, None), (10, 1, "The unit shall log."))
    whole, cells = Analysis(pages, domain("generic")), Analysis(pages, domain("generic"), long_from=5)
    assert cells.long and not whole.long
    for get in (lambda a: a.lines, lambda a: a.plain_blocks, lambda a: a.blocks, lambda a: a.rules, lambda a: a.nodes, lambda a: a.edges):
        want, got = get(whole), get(cells)
        assert want.schema.simpleString() == got.schema.simpleString()
        assert sorted(map(str, want.collect())) == sorted(map(str, got.collect())) and not want.isEmpty()
    empty = Analysis(pages.limit(0), domain("generic"), long_from=-1)
    assert empty.long and empty.edges.isEmpty()


def test_a_document_of_a_million_lines_takes_several_tasks(spark):
    line = F.concat(F.when(F.col("id") % 50 == 0, F.concat(F.col("id") / 50 + 1, F.lit(" Part"))).otherwise(F.concat(F.lit("word "), F.col("id"))))
    rows = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page_number"), F.col("id").cast("int").alias("line_idx"), F.lit(1_000_000).alias("n_lines"), line.alias("raw"), line.alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lines.classify_lines(rows, long=True)
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 1 and sum(sizes) == 1_000_000 and max(sizes) < 400_000
        assert got.filter("line_no <> line_idx + 1").isEmpty() and got.agg(F.max("cid")).first()[0] == got.filter("kind = 'heading'").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _counting(folder, name, answer):
    """A model that leaves a file for each prompt it gets, as it runs in other processes."""
    def model(prompts):
        for p in prompts:
            (folder / f"{name}-{uuid.uuid4().hex}").write_text(p)
        return answer(prompts)

    return model


def _calls(folder):
    return sorted((f.name.split("-")[0], f.read_text()) for f in folder.iterdir())


def test_stored_replies_are_asked_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def bad(prompts):
        if any(p in ("b", "c") for p in prompts):
            raise ConnectionError("no route")
        return [None if p == "d" else f"first {p}" for p in prompts]

    def good(prompts):
        if "c" in prompts:
            raise TimeoutError("late")
        return [f"second {p}" for p in prompts]

    one, two = _counting(seen, "one", bad), _counting(seen, "two", good)
    asked = _rows(spark, "doc_id long, batch int, prompt string", (1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "c"), (3, 0, "d"), (3, 0, None))
    store = ReplyStore(f"file://{tmp_path}/store", tries=2, size=1)
    rows = lambda out: sorted((r["doc_id"], r["batch"], r["prompt"] or "", r["reply"], r["provider"], r["error"]) for r in out.collect())
    got = rows(store.ask(asked, "s", [one, two]))
    assert got == [(1, 0, "a", "first a", 0, None), (1, 1, "b", "second b", 1, None), (2, 0, "a", "first a", 0, None), (2, 1, "c", None, None, "TimeoutError: late"), (3, 0, "", "first ", 0, None), (3, 0, "d", "second d", 1, None)]
    calls = _calls(seen)
    assert [p for n, p in calls if n == "one"] == ["", "a", "b", "b", "b", "c", "c", "c", "d"] and [p for n, p in calls if n == "two"] == ["b", "c", "c", "c", "d"]
    assert rows(store.ask(asked, "s", None)) == [(*r[:5], None) for r in got] and len(_calls(seen)) == len(calls)
    again = rows(store.ask(asked, "s", lambda prompts: [f"third {p}" for p in prompts]))  # only the failed one is asked again
    assert [r[3] for r in again] == ["first a", "second b", "first a", "third c", "first ", "second d"]
    assert rows(store.ask(asked, "other", None)) == [(*r[:3], None, None, None) for r in got]  # replies belong to their step
    assert rows(store.ask(asked.limit(0), "s", one)) == [] and len(_calls(seen)) == len(calls)
    wrong = store.ask(_rows(spark, "doc_id long, batch int, prompt string", (1, 0, "x")), "w", lambda prompts: [])
    assert rows(wrong)[0][5].startswith("ValueError")


def test_a_second_run_of_the_pipeline_asks_nothing(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    pages = _rows(spark, "doc_id long, page_number int, text string", *[(k, 1, f"1 Scope\nUnit {k} shall log. Unit {k} shall stop.\n2 More\nThe unit shall not log.") for k in range(5)])
    model = _counting(seen, "m", lambda prompts: [json.dumps(["REQ-002"]) for _ in prompts])
    store = ReplyStore(f"file://{tmp_path}/store")
    run = lambda m: sorted((r["doc_id"], r["id"]) for r in parse_documents(pages, "generic", {"boilerplate": m}, store).rules.collect())
    first = run(model)
    assert len(_calls(seen)) == 5 and (0, "REQ-002") not in first and (0, "REQ-001") in first
    assert run([model]) == first and len(_calls(seen)) == 5


def test_conflicts_are_counted_without_their_pairs(spark):
    """Totals, and the pairs of chosen rules, against all pairs made one by one."""
    rng = random.Random(5)
    kinds = ["Mandatory", "Prohibition", "Permission"]
    ledger = [(d, o, f"REQ-{o:03d}", rng.choice(kinds)) for d in (1, 2) for o in range(1, 60)]
    said = [(d, o, t, "abcdef".index(t) + 1) for d, o, _, _ in ledger for t in rng.sample("abcdef", rng.randint(0, 4))]
    r = _rows(spark, "doc_id long, rule_ord int, id string, constraint_type string", *ledger, (3, 1, "REQ-001", "Mandatory"), (4, 1, "REQ-001", None))
    m = _rows(spark, "doc_id long, rule_ord int, term string, term_ord int", *said, *said[:5], (3, 1, "a", 1), (4, 1, "a", 1))
    d = Domain("x", {}, actors=("f",))
    kind, terms_of = {(a, b): k for a, b, _, k in ledger}, {}
    for doc, o, t, _ in said:
        terms_of.setdefault((doc, o), set()).add(t)
    want = {}
    for doc in (1, 2):
        for x in range(1, 60):
            for y in range(x + 1, 60):
                shared = (terms_of.get((doc, x), set()) & terms_of.get((doc, y), set())) - {"f"}
                if shared and {kind[doc, x], kind[doc, y]} == {"Mandatory", "Prohibition"}:
                    want[doc, x, y] = min(shared)
    pairs = {(p["doc_id"], p["a"], p["b"]): p["shared_term"] for p in graph.conflicts(r, m, d).collect()}
    assert pairs == want
    totals = {(t["doc_id"], t["term"]): (t["n_mandatory"], t["n_prohibiting"], t["n_pairs"]) for t in graph.conflict_totals(r, m, d).collect()}
    side = lambda doc, t, k: sum(t in terms_of.get(key, ()) for key in kind if key[0] == doc and kind[key] == k)
    assert totals == {(doc, t): (side(doc, t, "Mandatory"), side(doc, t, "Prohibition"), sum(v == t for k, v in want.items() if k[0] == doc)) for doc in (1, 2) for t in "abcde"}
    x, (y, z) = next(k[1] for k in sorted(want) if k[0] == 1), next(k[1:] for k in sorted(want) if k[0] == 2)
    asked = _rows(spark, "doc_id long, id string", (1, f"REQ-{x:03d}"), (2, f"REQ-{y:03d}"), (2, f"REQ-{z:03d}"), (2, f"REQ-{z:03d}"), (9, "REQ-001"))
    got = graph.conflicts_of(r, m, d, asked).collect()
    few = {k: v for k, v in want.items() if (k[0] == 1 and x in k[1:]) or (k[0] == 2 and {y, z} & set(k[1:]))}
    assert few and {(p["doc_id"], p["a"], p["b"]): p["shared_term"] for p in got} == few and len(got) == len(few)
    assert graph.conflict_totals(r.limit(0), m, d).isEmpty() and graph.conflicts_of(r, m.limit(0), d, asked).isEmpty()


def test_a_term_of_very_many_rules_is_counted(spark):
    """100,000 mandatory and 100,000 prohibiting rules of one term are ten thousand million pairs."""
    r = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") + 1).cast("int").alias("rule_ord"), F.format_string("REQ-%03d", F.col("id") + 1).alias("id"), F.when(F.col("id") % 2 == 0, "Mandatory").otherwise("Prohibition").alias("constraint_type"))
    m = r.select("doc_id", "rule_ord", F.lit("log").alias("term"), F.lit(2).alias("term_ord"))
    m = m.unionByName(r.filter("rule_ord <= 20").select("doc_id", "rule_ord", F.lit("key").alias("term"), F.lit(1).alias("term_ord")))
    got = {t["term"]: (t["n_mandatory"], t["n_prohibiting"], t["n_pairs"]) for t in graph.conflict_totals(r, m, Domain("x", {})).collect()}
    assert got == {"key": (10, 10, 100), "log": (100_000, 100_000, 10**10 - 100)}
    one = graph.conflicts_of(r, m, Domain("x", {}), _rows(spark, "doc_id long, id string", (1, "REQ-001")))
    assert one.count() == 100_000 and one.filter("shared_term = 'key'").count() == 10


def test_domains_are_inferred_or_detected(spark):
    pages = _rows(spark, "doc_id long, page_number int, text string", (1, 1, "1 Scope\nThe reactor shall cool. Coolants must flow."), (2, 1, "1 Scope\nVoltage and inverter telemetry shall be logged."))
    ask = lambda prompts: [json.dumps({"domainName": "nuclear", "curatedTerms": ["Reactor", "coolant", " "], "cleanHeaders": ["draft"], "roleDescription": "Judge safety."}) if "reactor" in p else "no" for p in prompts]
    found = parse_each(pages, {"domain": ask}, info="Plant 3", terms={"flow": "flow"})
    d = found.domains
    about = {r["doc_id"]: r for r in d.assign(pages.select("doc_id")).join(d.about, "domain").collect()}
    assert (about[1]["name"], about[2]["name"], about[1]["info"], about[1]["role"]) == ("nuclear", "smartGrid", "Plant 3", "Judge safety.")
    assert d.assign(pages.select("doc_id")).join(d.of_kind("actor", "w"), "domain").select("doc_id").distinct().count() == 1  # an inferred domain has no actors
    terms = {r["name"]: r["frequency"] for r in found.nodes.filter("label = 'Term' AND doc_id = 1").collect()}
    assert (terms["coolant"], terms["reactor"], terms["flow"]) == (1, 1, 1)
    assert "Judge safety." in {r["doc_id"]: r["payload"] for r in found.audit(["REQ-001"]).collect()}[1]
    detected = parse_each(pages).domains
    assert {r["doc_id"]: r["domain"] for r in detected.of.collect()} == {1: "generic", 2: "smartGrid"}


MIXED = "1 Scope\nThe {0} shall log a timeout, and a policy or policies.\nieee std draft\nThe {0} process must not use overcapacity; processes may. The {1} shall verify the security access of client parameters.\n2 More\nClients should not {1} the response time. It is required that response times hold."


def test_presets_as_tables_give_what_each_preset_gives(spark):
    """Documents of three presets in one plan, against a run for each preset."""
    names = ["generic", "smartGrid", "security"]
    rows = [(k, 1, MIXED.format(["gateway", "token", "system"][k % 3], ["audit", "voltage", "interface"][k % 2])) for k in range(9)]
    pages = _rows(spark, "doc_id long, page_number int, text string", *rows)
    of = _rows(spark, "doc_id long, domain string", *[(k, names[k % 3]) for k in range(9)])
    together = Analysis(pages, D.table(spark, {n: domain(n) for n in names}, of))
    for n in names:
        own = of.filter(F.col("domain") == n).select("doc_id")
        alone = Analysis(pages.join(own, "doc_id", "left_semi"), domain(n))
        audits = [lambda a: a.audit(["REQ-001", "response access timeout"])] if n == "smartGrid" else []
        for get in (lambda a: a.lines, lambda a: a.terms[0], lambda a: a.terms[1], lambda a: a.edges, *audits):
            want = sorted(map(str, get(alone).collect()))
            got = get(together).join(own, "doc_id", "left_semi")
            assert want and sorted(map(str, got.select(*get(alone).columns).collect())) == want


def test_many_inferred_domains_are_one_plan(spark):
    def ask(prompts):
        number = lambda p: p.split("Plant ")[1].split(" ")[0]
        return [json.dumps({"domainName": f"plant {number(p)}", "curatedTerms": [f"valve{number(p)}", "response time", f"c{number(p)}++"], "cleanHeaders": []}) for p in prompts]

    def parse(n):
        return parse_each(_rows(spark, "doc_id long, page_number int, text string", *[(k, 1, f"1 Plant {k} \nA valve{k} shall open; valve{k + 1} shall not. The response times of valve{k}s must hold. c{k}++x may, c{k}++ not.") for k in range(n)]), {"domain": ask})

    few, many = parse(2), parse(60)
    size = lambda a: len(terms.curated_matches(a.rules, a.domains)._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(few) == size(many) and many.domains.about.count() == 63
    got = {(r["doc_id"], r["term"]): r["freq"] for r in many.terms[0].filter("curated").collect()}
    assert len(got) == 180 and all(got[k, f"valve{k}"] == 2 and got[k, "response time"] == 1 and got[k, f"c{k}++"] == 1 for k in range(60))
    plan = terms.named(many.rules, many.domains.assign(many.rules.select("doc_id").distinct()).join(many.domains.terms, "domain").select("doc_id", "term", "pos"))[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_like" not in plan.lower() and all(" RLIKE " not in line or "^[a-z0-9_]" in line for line in plan.split("\n"))


@pytest.mark.parametrize(("pattern", "texts"), [
    (r"\bfrequenc(?:y|ies)\b", ["frequency", "a Frequencies.", "frequencys"]), (r"\bcapacities|capacity\b", ["overcapacity", "capacitiesx", "capacity_", "Capacity"]), (r"\bprocesses?\b", ["process", "processe", "processes"]),
    (r"\bresponse times?\b", ["the response time.", "response  time", "response times", "xresponse time", "response timesx", "response-time"]), (r"\bc\+\+s?\b", ["c++x", "c++ ", "c++", "a c++s b", "cc++x"]),
])
def test_forms_match_what_their_pattern_matches(spark, pattern, texts):
    own = Domain("own", {"term": pattern})
    rows = _rows(spark, "doc_id long, rule_ord int, text string", *[(1, i, t) for i, t in enumerate(texts)])
    want = {r["rule_ord"] for r in rows.filter(F.col("text").rlike(java(pattern))).collect()}
    assert forms_of(pattern) and {r["rule_ord"] for r in terms.curated_matches(rows, own).collect()} == want


def test_patterns_without_forms_stay_patterns(spark):
    assert [forms_of(p) for p in (r"\bx\d+\b", r"\ba[bc]\b", r"abc", r"\ba|b\b")] == [None] * 4
    more = domain("generic", terms={"number": r"x\d+"})
    rows = _rows(spark, "doc_id long, rule_ord int, text string", (1, 1, "an x12 here"), (1, 2, "xy"), (1, 3, "system"))
    assert {(r["rule_ord"], r["term"]) for r in terms.curated_matches(rows, more).collect()} == {(1, "number"), (3, "system")}


@pytest.mark.parametrize("remote", [False, True])
def test_tools_parse_and_audit(spark, tmp_path, remote):
    base = str(tmp_path)
    if remote:  # a path that only Spark's file systems can open
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.specloom.link./data", f"file://{tmp_path}")
        base = "viewfs://specloom/data"
    _rows(spark, "doc_id long, page_number int, text string", (1, 1, "1 Scope\nThe gateway shall log a timeout.\nThe timeout must not pass."), (2, 1, "1 Other\nNothing </script> here may fail.")).write.parquet(f"{base}/pages in")
    for _ in range(3):
        said = tools.command(spark, "parse 'pages in' out smartGrid --info 'About \"it\"'", base)
    assert "Detected domains: smartGrid" in said and "mined 3 requirements" in said and "  - Requirement: 3" in said
    shown = tools.command(spark, ["audit", "REQ-001", "out"], base)
    assert "Document 1" in shown and "The gateway shall log a timeout." in shown and 'About "it"' in shown
    out = f"{base}/out"
    assert len(artifacts.children(spark, f"{out}/versions")) == 2 and artifacts.current(spark, out).startswith(out)
    texts = {r["doc_id"]: r["markdown"] for r in spark.read.json(f"{out}/document_cleaned").collect()}
    assert texts[1].startswith("# 1 Scope\n\nThe gateway") and spark.read.json(f"{out}/audit_payload_REQ-001.md").count() == 2
    assert spark.read.json(f"{out}/ledger_json").count() == 3 and {r["detected_domain"] for r in spark.read.json(f"{out}/knowledge_graph").collect()} == {"smartGrid"}
    html = {r["doc_id"]: r["html"] for r in spark.read.json(f"{out}/graph_explorer").collect()}[2]
    assert "\\u003c/script\\u003e" in html and html.count("</script>") == 1
    assert not [p for p in tmp_path.rglob("out/document_cleaned/*") if p.is_dir()]
    for line, what in (("parse '' out", "Invalid parameters: pages"), ("parse pages out tea", "domain"), ("parse ../x out", "outside"), ("audit '' out", "query"), ("audit REQ-001 nowhere", "parse the pages first")):
        with pytest.raises(ValueError, match=what):
            tools.command(spark, line, base)


def test_a_failed_parse_leaves_the_tables_of_the_last(spark, tmp_path):
    pages = _rows(spark, "doc_id long, page_number int, text string", (1, 1, "1 Scope\nIt shall log."))
    tools.standard_parse(spark, pages, "out", "generic", base=str(tmp_path), apart=True)
    assert next(tmp_path.glob("out/document_cleaned/doc_id=1/*.txt")).read_text().startswith("# 1 Scope")
    before = artifacts.current(spark, f"file://{tmp_path}/out")
    broken = pages.unionByName(pages.select("doc_id", F.lit(2).alias("page_number"), F.raise_error(F.lit("no")).cast("string").alias("text")))
    with pytest.raises(Exception):  # noqa: B017
        tools.standard_parse(spark, broken, "out", "generic", base=str(tmp_path))
    assert artifacts.current(spark, f"file://{tmp_path}/out") == before and spark.read.parquet(f"{before}/ledger").count() == 1
    with artifacts.tables_made() as made:
        artifacts.settled(pages)
    assert artifacts.exists(spark, made[0])
    path = made[0]
    artifacts.released(spark, made)
    assert not artifacts.exists(spark, path)


def test_unreadable_files_name_their_error(spark):
    def extract(content: bytes) -> list[str]:
        return content.decode().split("\f")

    rows = extract_pages(_rows(spark, "path string, content binary", ("a", bytearray(b"one\ftwo")), ("b", bytearray(b"\xff"))), extract).collect()
    assert sorted((r["page_number"], r["text"], (r["error"] or "")[:18]) for r in rows if r["text"]) == [(1, "one", ""), (2, "two", "")] and [r["error"][:18] for r in rows if not r["text"]] == ["UnicodeDecodeError"]


def test_chains_stop_at_gaps_and_deep_sections_need_no_loop(spark):
    page = "1 A\nIt shall a.\n1.1 B\nIt shall b.\n1.1.1 C\nIt shall c.\n1.1.1.1 D\nIt shall d.\n3 E\n3.1.1 F\nIt shall f.\n3.1.1.1 G\nIt shall g."
    a = parse_documents(_rows(spark, "doc_id long, page_number int, text string", (1, 1, page)))
    chains = {r["section"]: [x["id"] for x in r["chain"]] for r in explore.section_chains(a.nodes, a.edges).collect()}
    assert chains["SEC-1.1.1.1"] == ["SEC-1.1.1.1", "SEC-1.1.1", "SEC-1.1", "SEC-1"] and chains["SEC-3.1.1.1"] == ["SEC-3.1.1.1", "SEC-3.1.1"] and chains["SEC-3"] == ["SEC-3"]
    paths = {r["id"]: r["path"] for r in explore.section_paths(a.nodes, a.edges).collect()}
    assert paths["REQ-004"] == "SEC-1 > SEC-1.1 > SEC-1.1.1 > SEC-1.1.1.1" and paths["REQ-005"] == "SEC-3.1.1"
    context = search.expand(a.nodes, a.edges, search.targets(a.nodes, ["1.1"], domain("generic")))[0]
    assert [r["id"] for r in context.filter("role = 'section'").orderBy("pos").collect()] == ["SEC-1.1.1", "SEC-1.1.1.1"]
    assert [r["id"] for r in context.filter("role = 'requirement'").orderBy("pos").collect()] == ["REQ-002", "REQ-003", "REQ-004"]


def test_ancestors_of_section_numbers(spark):
    rows = _rows(spark, "a string, d string", ("1", "1.2"), ("1", "12.1"), ("1.2", "1.2"), ("A", "A.1.1"))
    assert [r[0] for r in rows.select(T.is_ancestor(F.col("a"), F.col("d"))).collect()] == [True, False, False, True]

"""The same results in another engine's SQL, formulated apart from the operators: one chain of common tables, and a query on it for each result."""

from __future__ import annotations

from dataclasses import replace

from specloom.functions.vocabulary import Domain, domain
from specloom.sources.corpus import CORPUS_SQL

HEADING = r"""(?i)^\s*(Annex\s+[A-Z](?:\.[0-9]+)*|[0-9]+(?:\.[0-9]+)*|[A-Z](?:\.[0-9]+)*)\.?\s+([a-zA-Z0-9_()"''“‘].*)$"""
LIST = r"^\s*(•|[*+-]|[0-9]+[.)]|[a-zA-Z][.)]|\([0-9]+\)|\([a-zA-Z]\))\s+(.*)$"
BOUND = r"""([.!?]["''”’)]?\s+)(["''“‘(]?[A-Z])"""
ABBR = r"""((?i:(?:^|[^A-Za-z0-9_])(?:e\.g|i\.e|vs|std|fig|no|approx|ref|et\s+al))\s*[.!?]["''”’)]?\s+)\x01"""
NORM = r"regexp_replace(regexp_replace(trim({0}), '^Annex\s+', '', 'i'), '^(.+?)(\.0)+$', '\1')"


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _split(text: str) -> str:
    marked = rf"regexp_replace(replace({text}, chr(10), ' '), '{BOUND}', '\1' || chr(1) || '\2', 'g')"
    kept = rf"regexp_replace({marked}, '{ABBR}', '\1', 'g')"
    return rf"list_filter(list_transform(string_split({kept}, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def _kind(line: str) -> str:
    return rf"CASE WHEN {line} = '' THEN 'empty' WHEN regexp_matches({line}, '{HEADING}') THEN 'heading' WHEN regexp_matches({line}, '{LIST}') THEN 'list_item' WHEN contains({line}, '|') OR regexp_matches({line}, '\S\s{{3,}}\S') THEN 'table_row' ELSE 'text' END"


def _groups(kind: str, line: str) -> str:
    return ", ".join(rf"CASE {kind} WHEN 'heading' THEN regexp_extract({line}, '{HEADING}', {g}) WHEN 'list_item' THEN regexp_extract({line}, '{LIST}', {g}) END AS g{g}" for g in (1, 2))


def chain(d: Domain) -> str:
    headers = " OR ".join(f"contains(lower(line), {_literal(h)})" for h in d.headers)
    terms = ", ".join(f"({i}, {_literal(t)}, {_literal('(?i)' + p)})" for i, (t, p) in enumerate(d.terms.items()))
    listed = lambda xs: ", ".join(map(_literal, xs))
    modal = lambda p: rf"regexp_matches(s, '(?i)\b(?:{p})\b')"
    term_kinds = "'REFERENCES', 'CONSTRAINS', 'RECOMMENDS', 'PERMITS'"
    tables = {
        "corpus": CORPUS_SQL.format(part="part", nation="nation"),
        "stripped": r"SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line, count(*) OVER (PARTITION BY doc_id, page_number) AS n_lines FROM corpus",
        "clean": rf"SELECT * FROM stripped WHERE line = '' OR regexp_matches(line, '{HEADING}') OR (line_idx > 2 AND line_idx < n_lines - 3) OR NOT (regexp_matches(line, '^([0-9]+|[ivxldcmIVXLDCM]+)$') OR {headers})",
        "kinds": f"SELECT *, {_kind('line')} AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, line_idx) AS line_no FROM clean",
        "cut": f"SELECT *, {_groups('kind', 'line')}, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM kinds",
        "islands": "SELECT *, sum(CASE WHEN kind IN ('heading', 'list_item') OR (kind = 'table_row' AND prev IS DISTINCT FROM 'table_row') OR (kind = 'text' AND (prev IS NULL OR prev NOT IN ('text', 'list_item'))) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM cut",
        "blk0": "SELECT doc_id, CAST(b AS INT) AS block_no, min_by(kind, line_no) AS k, min_by(page_number, line_no) AS page_number, min_by(g1, line_no) AS g1, min_by(g2, line_no) AS g2, string_agg(CASE WHEN kind = 'list_item' THEN g2 ELSE line END, chr(10) ORDER BY line_no) AS lines, count(*) AS n FROM islands WHERE kind <> 'empty' GROUP BY doc_id, b",
        "blk": r"SELECT doc_id, block_no, format('BLK-{:04d}', block_no) AS id, CASE k WHEN 'table_row' THEN 'table' WHEN 'text' THEN 'paragraph' ELSE k END AS type, CASE k WHEN 'table_row' THEN lines WHEN 'heading' THEN g1 || ' ' || g2 ELSE trim(regexp_replace(lines, '\s+', ' ', 'g')) END AS text, page_number, CASE WHEN k = 'list_item' THEN g1 END AS prefix, CASE WHEN k = 'table_row' THEN n END AS n_rows, CASE WHEN k = 'heading' THEN g1 END AS number, CASE WHEN k = 'heading' THEN g2 END AS title FROM blk0",
        "heads": f"SELECT doc_id, block_no, number, title, norm, len(string_split(norm, '.')) AS depth FROM (SELECT *, {NORM.format('number')} AS norm FROM blk WHERE type = 'heading')",
        "prefixes": "SELECT t.*, j, array_to_string(list_slice(string_split(norm, '.'), 1, j), '.') AS p FROM heads t, LATERAL (SELECT unnest(range(1, depth)) AS j) x",
        # a prefix is active if its last heading comes after the last one that stands elsewhere
        "active": "SELECT t.doc_id, t.block_no, t.j, max(h.block_no) FILTER (h.norm = t.p) AS s, max(h.block_no) FILTER (h.norm <> t.p AND NOT starts_with(h.norm, t.p || '.')) AS u FROM prefixes t JOIN heads h ON h.doc_id = t.doc_id AND h.block_no < t.block_no GROUP BY ALL",
        "parents": "SELECT a.doc_id, a.block_no, string_agg(h.number, '|' ORDER BY j) AS parents, string_agg(h.title, '|' ORDER BY j) AS titles FROM active a JOIN heads h ON h.doc_id = a.doc_id AND h.block_no = a.s WHERE u IS NULL OR s > u GROUP BY ALL",
        "hier": "SELECT h.doc_id, h.block_no, h.number, coalesce(parents, '') AS parents, coalesce(titles || '|', '') || h.title AS context FROM heads h LEFT JOIN parents p USING (doc_id, block_no)",
        "placed": "SELECT b.*, coalesce(h.number, '0.0') AS section_number, coalesce(h.parents, '') AS parents, coalesce(h.context, 'Document Root') AS context FROM blk b ASOF LEFT JOIN hier h ON b.doc_id = h.doc_id AND b.block_no >= h.block_no",
        "sents": f"SELECT b.* EXCLUDE (text), unnest(l) AS s, generate_subscripts(l, 1) - 1 AS si FROM (SELECT *, {_split('text')} AS l FROM placed) b",
        "typed": f"SELECT *, list_filter([CASE WHEN {modal('(?:shall|must|should)' + chr(92) + 's+not')} THEN 'Prohibition' END, CASE WHEN {modal('shall|must')} THEN 'Mandatory' END, CASE WHEN {modal('should')} THEN 'Recommendation' END, CASE WHEN {modal('may')} THEN 'Permission' END], lambda x: x IS NOT NULL) AS types FROM sents",
        "ledger": "SELECT doc_id, n AS rule_ord, format('REQ-{:03d}', n) AS id, section_number, parents, context, types[1] AS constraint_type, array_to_string(types, '|') AS all_types, s AS text, id AS source_block_id, page_number FROM (SELECT * REPLACE (CASE WHEN section_number = '0.0' THEN 'UNKNOWN' ELSE section_number END AS section_number), row_number() OVER (PARTITION BY doc_id ORDER BY block_no, si) AS n FROM typed WHERE len(types) > 0)",
        "words": "SELECT doc_id, rule_ord, i, w AS term FROM (SELECT doc_id, rule_ord, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM ledger)) WHERE regexp_full_match(w, '[a-z]{3,}') AND w NOT IN (" + listed(d.stopwords) + ")",
        "freq": "SELECT doc_id, term, count(*) AS freq, min(rule_ord * 100000 + i) AS first FROM words GROUP BY ALL",
        "ranked": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, first) AS rank FROM freq QUALIFY rank <= 20",
        "curated": f"SELECT * FROM (VALUES {terms}) v(pos, term, pattern)",
        "curfreq": "SELECT d.doc_id, c.term, c.pos, count(r.rule_ord) AS freq FROM (SELECT DISTINCT doc_id FROM ledger) d CROSS JOIN curated c LEFT JOIN ledger r ON r.doc_id = d.doc_id AND regexp_matches(r.text, c.pattern) GROUP BY ALL",
        "terms": "SELECT doc_id, term, freq, pattern, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, src, pos) AS term_ord FROM (SELECT doc_id, f.term, freq, 0 AS src, f.pos, pattern FROM curfreq f JOIN curated c USING (term) UNION ALL SELECT doc_id, term, freq, 1, rank, '(?i)\\b' || term || 's?\\b' FROM ranked WHERE term NOT IN (SELECT term FROM curated))",
        "mentions": "SELECT r.doc_id, r.rule_ord, r.id, r.constraint_type, t.term, t.term_ord FROM ledger r JOIN terms t ON t.doc_id = r.doc_id AND regexp_matches(r.text, t.pattern)",
        "numbers": f"SELECT DISTINCT doc_id, {NORM.format('x')} AS section FROM (SELECT doc_id, section_number AS x FROM placed UNION ALL SELECT doc_id, section_number FROM ledger UNION ALL SELECT doc_id, unnest(string_split(parents, '|')) FROM placed UNION ALL SELECT doc_id, unnest(string_split(parents, '|')) FROM ledger) WHERE x NOT IN ('', 'UNKNOWN')",
        "secs": "SELECT n.doc_id, section, 'SEC-' || section AS id, coalesce(t.title, 'Section ' || section) AS title, row_number() OVER (PARTITION BY n.doc_id ORDER BY array_to_string(list_transform(string_split(section, '.'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '0' || lpad(x, 9, '0') ELSE '1' || lower(x) || CASE WHEN x = lower(x) THEN '0' ELSE '1' END END), chr(1))) AS sec_ord FROM numbers n LEFT JOIN (SELECT doc_id, norm, max_by(title, block_no) AS title FROM heads GROUP BY ALL) t ON t.doc_id = n.doc_id AND t.norm = n.section",
        "secsec": "SELECT c.doc_id, p.id AS source, c.id AS target, c.sec_ord FROM secs c JOIN secs p ON p.doc_id = c.doc_id AND c.section LIKE '%.%' AND p.section = array_to_string(string_split(c.section, '.')[:-2], '.')",
        "secreq": f"SELECT r.doc_id, s.id AS source, r.id AS target, r.rule_ord FROM ledger r JOIN secs s ON s.doc_id = r.doc_id AND s.section = {NORM.format('r.section_number')}",
        "termedge": "SELECT doc_id, id AS source, 'TERM-' || term AS target, CASE constraint_type WHEN 'Recommendation' THEN 'RECOMMENDS' WHEN 'Permission' THEN 'PERMITS' ELSE 'CONSTRAINS' END AS type, rule_ord, term_ord AS pos FROM mentions",
        "secref": rf"SELECT q.doc_id, q.id AS source, s.id AS target, CASE WHEN regexp_matches(text, '(?i)\b(comply|conform|implement|according to|defined in)\b') THEN 'IMPLEMENTS' WHEN regexp_matches(text, '(?i)\b(require|depend|prerequisite|rely|relies)\b') THEN 'DEPENDS_ON' ELSE 'REFERENCES' END AS type, rule_ord, pos FROM (SELECT doc_id, id, rule_ord, text, unnest(m) AS ref, generate_subscripts(m, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(text, '(?i)\b(?:Section|Clause|Annex)\s+((?:Annex\s+[A-Z]|[A-Z]|[0-9]+)(?:\.[0-9]+)*)\b', 1) AS m FROM ledger)) q JOIN secs s ON s.doc_id = q.doc_id AND s.section = {NORM.format('ref')}",
        "reqref": r"SELECT doc_id, id AS source, ref AS target, CASE WHEN regexp_matches(text, '(?i)\b(depend|require|prerequisite|conditional|rely|relies)\b') THEN 'DEPENDS_ON' WHEN regexp_matches(text, '(?i)\b(supersede|replace|obsolete|deprecated)\b') THEN 'SUPERSEDES' ELSE 'REFERENCES' END AS type, rule_ord, pos FROM (SELECT doc_id, id, rule_ord, text, unnest(m) AS ref, generate_subscripts(m, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(text, '\b(REQ-[0-9]+)\b', 1) AS m FROM ledger)) WHERE ref <> id",
        "pairs": "SELECT a.doc_id, a.id AS source, b.id AS target, a.term AS shared_term, a.term_ord, a.rule_ord AS x, b.rule_ord AS y FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.term = b.term AND a.rule_ord < b.rule_ord AND (a.constraint_type, b.constraint_type) IN (('Mandatory', 'Prohibition'), ('Prohibition', 'Mandatory')) WHERE a.term NOT IN (" + listed(d.actors) + ") QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.id, b.id ORDER BY a.term_ord) = 1",
        "edges": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, q, r, s, t) AS INT) AS edge_ord, source, target, type FROM (SELECT doc_id, 0 AS p, sec_ord AS q, 0 AS r, 0 AS s, 0 AS t, source, target, 'CONTAINS' AS type FROM secsec UNION ALL SELECT doc_id, 1, rule_ord, 0, 0, 0, source, target, 'CONTAINS' FROM secreq UNION ALL SELECT doc_id, 1, rule_ord, 1, pos, 0, source, target, type FROM termedge UNION ALL SELECT doc_id, 1, rule_ord, 2, pos, 0, source, target, type FROM secref UNION ALL SELECT doc_id, 1, rule_ord, 3, pos, 0, source, target, type FROM reqref UNION ALL SELECT doc_id, 2, term_ord, x, y, 0, source, target, 'CONFLICTS_WITH' FROM pairs)",
        "nodes": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, q) AS INT) AS node_ord, id, label, name, section_number, title, text FROM (SELECT doc_id, 0 AS p, term_ord AS q, 'TERM-' || term AS id, 'Term' AS label, term AS name, NULL AS section_number, NULL AS title, NULL AS text FROM terms UNION ALL SELECT doc_id, 1, sec_ord, id, 'Section', NULL, section, title, NULL FROM secs UNION ALL SELECT doc_id, 2, rule_ord, id, 'Requirement', NULL, section_number, NULL, text FROM ledger)",
        "term_links": f"SELECT * FROM edges WHERE starts_with(target, 'TERM-') AND type IN ({term_kinds})",
        "homes": "SELECT doc_id, target AS id, min_by(source, edge_ord) AS section FROM edges WHERE type = 'CONTAINS' AND starts_with(target, 'REQ-') GROUP BY ALL",
        "up": "SELECT doc_id, target AS id, max_by(source, edge_ord) AS parent FROM edges WHERE type = 'CONTAINS' AND starts_with(target, 'SEC-') GROUP BY ALL",
    }
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in tables.items())


def _context(cands: str, extra: str = "") -> str:
    """Context of one target: the smallest tag of each node that exists and is not the target."""
    return f"""{extra}, cand AS ({cands}),
firsts AS (SELECT doc_id, query, c.id, label, min(tag) AS tag FROM cand c JOIN nodes n USING (doc_id, id) WHERE c.id <> me GROUP BY ALL)
SELECT doc_id, query, CASE label WHEN 'Requirement' THEN 'requirement' WHEN 'Section' THEN 'section' ELSE 'term' END AS role, CAST(row_number() OVER (PARTITION BY doc_id, query, label ORDER BY tag) AS INT) AS pos, id FROM firsts"""


def _tag(*xs: str) -> str:
    return " || '-' || ".join(f"lpad(CAST({x} AS VARCHAR), 8, '0')" for x in xs)


TERM_KINDS = "('REFERENCES', 'CONSTRAINS', 'RECOMMENDS', 'PERMITS')"


def _blend(d: Domain, questions: list[str], points: str) -> str:
    """Common tables for questions with up to three targets: tg (targets), ctx (context by role and place) and clash (conflicts).

    Each rank's step sees what the steps before it have visited.
    """
    listed = lambda xs: ", ".join(map(_literal, xs))
    q = f"(SELECT unnest([{listed(questions)}]) AS query)"
    seen = lambda r, t, i="id": f"EXISTS (FROM v{r} v WHERE v.doc_id = {t}.doc_id AND v.query = {t}.query AND v.id = {t}.{i})"
    known = lambda t: f"EXISTS (FROM nodes k WHERE k.doc_id = {t}.doc_id AND k.id = {t}.id)"
    tag = lambda *xs: "[" + ", ".join(f"CAST({x} AS BIGINT)" for x in xs) + "]"
    tables = {
        "asked": f"SELECT n.*, query FROM nodes n, {q}",
        "toks": f"SELECT query, t FROM (SELECT query, unnest(regexp_split_to_array(lower(query), '[^a-zA-Z0-9_.-]+')) AS t FROM {q}) WHERE length(t) > 1 AND t NOT IN ({listed(d.stopwords)})",
        "res": f"SELECT doc_id, query, id AS me, label FROM (SELECT *, CASE WHEN id = upper(query) THEN 0 WHEN id = 'TERM-' || lower(query) THEN 1 WHEN id = 'SEC-' || {NORM.format('query')} THEN 2 END AS p FROM asked) WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, query ORDER BY p, node_ord) = 1",
        "tops": f"SELECT doc_id, query, id AS me, label, row_number() OVER (PARTITION BY doc_id, query ORDER BY score DESC, node_ord) AS rank FROM (SELECT a.doc_id, a.query, a.id, a.label, a.node_ord, sum({points}) AS score FROM asked a JOIN toks USING (query) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 3",
        "tg": "SELECT doc_id, query, me, label, 1 AS rank FROM res UNION ALL SELECT doc_id, query, me, label, rank FROM tops ANTI JOIN res USING (doc_id, query)",
        "walked": "SELECT doc_id, id AS me, id, CAST([] AS BIGINT[]) AS path, CAST([] AS VARCHAR[]) AS through FROM nodes WHERE label = 'Section' UNION ALL SELECT w.doc_id, w.me, e.target, list_append(w.path, e.edge_ord), list_append(w.through, e.target) FROM walked w JOIN edges e ON e.doc_id = w.doc_id AND e.source = w.id AND e.type = 'CONTAINS'",
        "v1": "SELECT DISTINCT doc_id, query, me AS id FROM tg",
    }
    for r in (1, 2, 3):
        tables |= {
            f"t{r}": f"SELECT * FROM tg WHERE rank = {r}",
            f"o{r}": f"SELECT t.doc_id, t.query, me, edge_ord, target AS id, type FROM t{r} t JOIN edges e ON e.doc_id = t.doc_id AND e.source = me WHERE label = 'Requirement'",
            f"i{r}": f"SELECT t.doc_id, t.query, me, edge_ord, source AS id, type FROM t{r} t JOIN edges e ON e.doc_id = t.doc_id AND e.target = me WHERE label = 'Requirement'",
            f"f{r}": f"SELECT doc_id, query, me, id, min(edge_ord) AS via FROM o{r} o WHERE type IN {TERM_KINDS} AND starts_with(id, 'TERM-') AND NOT {seen(r, 'o')} AND {known('o')} GROUP BY ALL",
            f"u{r}": f"SELECT t.doc_id, t.query, source AS id, min(edge_ord) AS via FROM t{r} t JOIN edges e ON e.doc_id = t.doc_id AND e.target = me WHERE label = 'Term' AND type IN {TERM_KINDS} AND starts_with(source, 'REQ-') GROUP BY ALL",
            f"c{r}": f"""SELECT doc_id, query, id, {tag(0, 'edge_ord', 0)} AS tag FROM i{r} WHERE type = 'CONTAINS' AND starts_with(id, 'SEC-')
UNION ALL SELECT doc_id, query, id, {tag(1, 'edge_ord', 0)} FROM o{r} WHERE (type IN {TERM_KINDS} AND starts_with(id, 'TERM-')) OR (type IN ('REFERENCES', 'IMPLEMENTS', 'DEPENDS_ON') AND starts_with(id, 'SEC-')) OR (type IN ('REFERENCES', 'DEPENDS_ON', 'SUPERSEDES') AND starts_with(id, 'REQ-')) OR type = 'CONFLICTS_WITH'
UNION ALL SELECT f.doc_id, f.query, e.source, {tag(1, 'via', 'e.edge_ord')} FROM f{r} f JOIN edges e ON e.doc_id = f.doc_id AND e.target = f.id WHERE starts_with(e.source, 'REQ-') AND e.source <> f.me
UNION ALL SELECT doc_id, query, id, {tag(2, 'edge_ord', 0)} FROM i{r} WHERE type = 'CONFLICTS_WITH'
UNION ALL SELECT doc_id, query, id, {tag('via', 0)} FROM u{r}
UNION ALL SELECT u.doc_id, u.query, e.source, {tag('via', 'e.edge_ord')} FROM u{r} u JOIN edges e ON e.doc_id = u.doc_id AND e.target = u.id AND e.type = 'CONTAINS' AND starts_with(e.source, 'SEC-') WHERE NOT {seen(r, 'u')} AND {known('u')}
UNION ALL SELECT t.doc_id, t.query, w.id, list_prepend(CAST(len(path) AS BIGINT), path) FROM t{r} t JOIN walked w ON w.doc_id = t.doc_id AND w.me = t.me WHERE t.label = 'Section' AND len(path) > 0 AND NOT EXISTS (FROM v{r} v WHERE v.doc_id = t.doc_id AND v.query = t.query AND list_contains(w.through, v.id))""",
            f"n{r}": f"SELECT c.doc_id, c.query, c.id, n.label, min(tag) AS tag, {r} AS rank FROM c{r} c JOIN nodes n ON n.doc_id = c.doc_id AND n.id = c.id WHERE NOT {seen(r, 'c')} GROUP BY ALL",
            f"v{r + 1}": f"SELECT * FROM v{r} UNION ALL SELECT doc_id, query, id FROM n{r}",
        }
    tables["ctx"] = "SELECT doc_id, query, CASE label WHEN 'Requirement' THEN 'requirement' WHEN 'Section' THEN 'section' ELSE 'term' END AS role, CAST(row_number() OVER (PARTITION BY doc_id, query, label ORDER BY rank, tag) AS INT) AS pos, id FROM (FROM n1 UNION ALL FROM n2 UNION ALL FROM n3)"
    both = " UNION ALL ".join(f"SELECT doc_id, query, edge_ord, {side} AS side, {r} AS rank FROM {t}{r} WHERE type = 'CONFLICTS_WITH'" for r in (1, 2, 3) for side, t in enumerate("oi"))
    tables["clash"] = f"SELECT doc_id, query, edge_ord, row_number() OVER (PARTITION BY doc_id, query ORDER BY rank, side, edge_ord) AS pos FROM ({both})"
    return "".join(f",\n{k} AS MATERIALIZED ({v})" if k != "walked" else f",\n{k} AS ({v})" for k, v in tables.items())


def _payload(d: Domain, questions: list[str]) -> str:
    """The template cut at its slots; each part's lines from ctx, tg and clash."""
    nothing = {"target": "", "section": "No direct structural context linked.", "requirement": "No semantically or structurally linked requirements found.", "term": "No specific technical terms mapped.", "conflict": "No explicit conflicts detected in this context segment."}
    slots = {"target_requirements": "target", "structural_context": "section", "linked_rules": "requirement", "referenced_terms": "term", "potential_conflicts": "conflict"}
    text, at = [], d.template.replace("{role_description}", d.role).replace("{additional_domain_info_section}", d.info and f"ADDITIONAL DOMAIN INFORMATION\n{d.info}\n")
    while "{" in at:
        before, _, rest = at.partition("{")
        slot, _, at = rest.partition("}")
        text += [_literal(before), f"coalesce(max(lines) FILTER (part = '{slots[slot]}'), {_literal(nothing[slots[slot]])})"]
    text.append(_literal(at))
    asked = ", ".join(map(_literal, questions))
    return rf""", nx AS (SELECT n.*, t.freq, l.constraint_type, l.page_number FROM nodes n LEFT JOIN terms t ON t.doc_id = n.doc_id AND n.id = 'TERM-' || t.term LEFT JOIN ledger l ON l.doc_id = n.doc_id AND l.id = n.id),
rows AS (SELECT t.doc_id, query, 'target' AS part, rank AS pos, CASE x.label WHEN 'Requirement' THEN '- **' || x.id || '** [' || constraint_type || ' in Section ' || section_number || ', Page ' || page_number || ']:' || chr(10) || '  "' || text || '"' WHEN 'Term' THEN '- **Term ''' || name || '''**: Mentions frequency = ' || freq ELSE '- **Section ' || section_number || '**: "' || title || '"' END AS line FROM tg t JOIN nx x ON x.doc_id = t.doc_id AND x.id = t.me
UNION ALL SELECT c.doc_id, query, role, pos, CASE role WHEN 'section' THEN '- Section ' || section_number || ': "' || title || '"' WHEN 'requirement' THEN '- **' || x.id || '** [Section ' || section_number || ' - ' || constraint_type || ']: "' || text || '"' ELSE '- **' || name || '** (Frequency: ' || freq || ')' END FROM ctx c JOIN nx x ON x.doc_id = c.doc_id AND x.id = c.id
UNION ALL SELECT c.doc_id, query, 'conflict', c.pos, '- Conflict between **' || e.source || '** and **' || e.target || '** on term **''' || shared_term || '''**:' || chr(10) || '  *Reason: Opposing constraints on ''' || shared_term || '''*' FROM clash c JOIN edges e ON e.doc_id = c.doc_id AND e.edge_ord = c.edge_ord JOIN pairs p ON p.doc_id = e.doc_id AND p.source = e.source AND p.target = e.target),
parts AS (SELECT doc_id, query, part, string_agg(line, chr(10) ORDER BY pos) AS lines FROM rows GROUP BY ALL)
SELECT d.doc_id, d.query, CASE WHEN count(part) = 0 THEN 'Error: No matching node found for query ''' || d.query || ''' in the Knowledge Graph.' ELSE {' || '.join(text)} END AS payload
FROM (SELECT DISTINCT doc_id, query FROM nodes, (SELECT unnest([{asked}]) AS query)) d LEFT JOIN parts p ON p.doc_id = d.doc_id AND p.query = d.query GROUP BY d.doc_id, d.query"""


def queries(d: Domain, search: list[str], named: list[str], req: str, term: str, sections: list[str], text_query: str, audited: list[str]) -> dict[str, str]:
    listed = lambda xs: ", ".join(map(_literal, xs))
    doc_lines = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM documents WHERE text <> ''), s AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM l)"
    asked = f"asked AS (SELECT n.*, query FROM nodes n, (SELECT unnest([{listed(search)}]) AS query)), toks AS (SELECT query, t FROM (SELECT query, unnest(regexp_split_to_array(lower(query), '[^a-zA-Z0-9_.-]+')) AS t FROM (SELECT unnest([{listed(search)}]) AS query)) WHERE length(t) > 1 AND t NOT IN ({listed(d.stopwords)}))"
    points = "CASE label WHEN 'Requirement' THEN CASE WHEN contains(lower(text), t) THEN 2.0 ELSE 0 END WHEN 'Section' THEN CASE WHEN lower(section_number) = t THEN 4.0 WHEN contains(lower(title), t) THEN 1.5 ELSE 0 END ELSE CASE WHEN name = t THEN 3.0 WHEN contains(name, t) THEN 1.0 ELSE 0 END END"
    of_req = f"SELECT e.*, me, query FROM edges e JOIN (SELECT doc_id, id AS me, {_literal(req)} AS query FROM nodes WHERE id = {_literal(req)}) m ON m.doc_id = e.doc_id AND m.me"
    req_cands = f"""SELECT doc_id, query, me, source AS id, {_tag('0', 'edge_ord', '0')} AS tag FROM i WHERE type = 'CONTAINS'
UNION ALL SELECT doc_id, query, me, target, {_tag('1', 'edge_ord', '0')} FROM o
UNION ALL SELECT o.doc_id, query, me, t.source, {_tag('1', 'o.edge_ord', 't.edge_ord')} FROM o JOIN term_links t ON t.doc_id = o.doc_id AND t.target = o.target
UNION ALL SELECT doc_id, query, me, source, {_tag('2', 'edge_ord', '0')} FROM i WHERE type = 'CONFLICTS_WITH'"""
    term_cands = f"""SELECT t.doc_id, {_literal(term)} AS query, target AS me, source AS id, {_tag('t.edge_ord', '0')} AS tag FROM term_links t WHERE target = 'TERM-' || {_literal(term)}
UNION ALL SELECT t.doc_id, {_literal(term)}, t.target, c.source, {_tag('t.edge_ord', 'c.edge_ord')} FROM term_links t JOIN edges c ON c.doc_id = t.doc_id AND c.target = t.source AND c.type = 'CONTAINS' WHERE t.target = 'TERM-' || {_literal(term)}"""
    walk = f""", walk AS (SELECT doc_id, substr(id, 5) AS query, id AS me, id, '' AS path, 0 AS level FROM nodes WHERE id IN ({listed(['SEC-' + s for s in sections])})
UNION ALL SELECT w.doc_id, w.query, w.me, e.target, w.path || lpad(CAST(e.edge_ord AS VARCHAR), 8, '0'), w.level + 1 FROM walk w JOIN edges e ON e.doc_id = w.doc_id AND e.source = w.id AND e.type = 'CONTAINS')"""
    chain_up = "climb AS (SELECT doc_id, id, section AS place, 0 AS step FROM homes UNION ALL SELECT c.doc_id, c.id, u.parent, c.step + 1 FROM climb c JOIN up u ON u.doc_id = c.doc_id AND u.id = c.place)"
    q = _literal(text_query.lower())
    hit = f"contains(lower(coalesce(name, '')), {q}) OR contains(lower(coalesce(title, '')), {q}) OR contains(lower(coalesce(text, '')), {q}) OR contains(lower(id), {q}) OR contains(lower(coalesce(section_number, '')), {q})"
    grid = " + ".join([f"CASE WHEN contains(t, {_literal(w)}) THEN 1.5 ELSE 0 END" for w in _grid()[0]] + [f"CASE WHEN regexp_matches(t, {_literal(p)}) THEN 1 ELSE 0 END" for p in _grid()[1]])
    secure = " + ".join([f"CASE WHEN contains(t, {_literal(w)}) THEN 1.5 ELSE 0 END" for w in _grid()[2]] + [f"CASE WHEN regexp_matches(t, {_literal(p)}) THEN 1 ELSE 0 END" for p in _grid()[3]])
    c = chain(d)
    last_of = "row_number() OVER (PARTITION BY doc_id ORDER BY block_no)"
    out = {
        "page_edge_clean": "SELECT doc_id, page_number, line_idx, line FROM clean",
        "section_normalise": "SELECT DISTINCT number, norm, CASE WHEN norm LIKE '%.%' THEN array_to_string(string_split(norm, '.')[:-2], '.') END AS parent FROM heads",
        "block_islands": "SELECT doc_id, block_no, id, type, page_number FROM blk",
        "block_text": "SELECT doc_id, block_no, text, prefix, CAST(n_rows AS INT) AS n_rows FROM blk",
        "section_propagation": "SELECT doc_id, block_no, section_number FROM placed",
        "heading_hierarchy": "SELECT doc_id, block_no, number, parents, context FROM hier",
        "outline_tree": r"SELECT h.doc_id, h.block_no AS sec_ord, p.parent_ord, h.number AS section, regexp_replace(h.number || ' ' || h.title, '^\S+\s+', '') AS title FROM heads h LEFT JOIN (SELECT t.doc_id, t.block_no, arg_max(g.block_no, t.j * 1000000 + g.block_no) AS parent_ord FROM prefixes t JOIN heads g ON g.doc_id = t.doc_id AND g.block_no < t.block_no AND g.norm = t.p GROUP BY ALL) p USING (doc_id, block_no)",
        "rule_types": "SELECT doc_id, constraint_type, count(*) AS n_rules, count(DISTINCT source_block_id) AS n_blocks FROM ledger GROUP BY ALL",
        "rule_ledger": "SELECT doc_id, CAST(rule_ord AS INT) AS rule_ord, id, section_number, parents, context, constraint_type, all_types, text, source_block_id, page_number FROM ledger",
        "rollup_constraints": "SELECT section_number, constraint_type, count(*) AS n_rules FROM ledger GROUP BY ROLLUP (section_number, constraint_type)",
        "implicit_candidates": r"SELECT doc_id, id, text FROM blk b WHERE type IN ('paragraph', 'list_item') AND regexp_matches(text, '(?i)\b(required|mandatory|ensure|strictly|necessary|obligation|responsible|is\s+to|are\s+to|has\s+to|have\s+to)\b') AND NOT EXISTS (FROM ledger r WHERE r.doc_id = b.doc_id AND r.source_block_id = b.id)",
        "llm_reply_validate": rf"SELECT doc_id, CAST(rule_ord AS INT) AS rule_ord, format('REQ-{{:03d}}', rule_ord) AS id, section_number, constraint_type, text, source_block_id FROM (SELECT c.doc_id, m.last + row_number() OVER (PARTITION BY c.doc_id ORDER BY c.block_no) AS rule_ord, section_number, 'Mandatory' AS constraint_type, text, id AS source_block_id FROM (SELECT *, {last_of} - 1 AS i FROM placed b WHERE type IN ('paragraph', 'list_item') AND regexp_matches(text, '(?i)\b(ensure|necessary|are\s+to)\b') AND NOT EXISTS (FROM ledger r WHERE r.doc_id = b.doc_id AND r.source_block_id = b.id)) c JOIN (SELECT doc_id, max(rule_ord) AS last FROM ledger GROUP BY doc_id) m USING (doc_id) WHERE i % 8 % 2 = 0)",
        "boilerplate_filter": "SELECT doc_id, id, text FROM ledger WHERE id NOT LIKE '%0'",
        "stored_replies": "SELECT doc_id, id, text FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY rule_ord) - 1) // 10 AS batch FROM ledger) l WHERE NOT CASE WHEN EXISTS (FROM (SELECT doc_id, id, (row_number() OVER (PARTITION BY doc_id ORDER BY rule_ord) - 1) // 10 AS batch FROM ledger) o WHERE o.doc_id = l.doc_id AND o.batch = l.batch AND o.id IN ('REQ-002', 'REQ-011')) THEN ends_with(id, '0') ELSE ends_with(id, '5') END",
        "term_frequency": "SELECT doc_id, term, freq FROM freq",
        "top_terms": "SELECT doc_id, term, freq, CAST(rank AS INT) AS rank FROM ranked",
        "curated_frequency": "SELECT doc_id, term, freq FROM curfreq",
        "term_merge": "SELECT doc_id, CAST(term_ord AS INT) AS term_ord, term, freq FROM terms",
        "stride_sample": "SELECT doc_id, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule_ord) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY doc_id) // 30) AS step FROM ledger) WHERE i % step = 0 AND i // step < 30",
        "section_nodes": "SELECT doc_id, CAST(sec_ord AS INT) AS sec_ord, section, id, title FROM secs",
        "section_contains": "SELECT doc_id, source, target FROM secsec",
        "requirement_contains": "SELECT doc_id, source, target FROM secreq",
        "term_edges": "SELECT doc_id, source, target, type FROM termedge",
        "section_refs": "SELECT doc_id, source, target, type, CAST(pos AS INT) AS pos FROM secref",
        "req_refs": "SELECT doc_id, source, target, type, CAST(pos AS INT) AS pos FROM reqref",
        "edge_totals": "SELECT doc_id, type, count(*) AS n FROM edges GROUP BY ALL",
        "conflict_totals": "SELECT s.doc_id, s.term, n_mandatory, n_prohibiting, count(p.source) AS n_pairs FROM (SELECT doc_id, term, count(*) FILTER (constraint_type = 'Mandatory') AS n_mandatory, count(*) FILTER (constraint_type = 'Prohibition') AS n_prohibiting FROM mentions WHERE term NOT IN (" + listed(d.actors) + ") GROUP BY ALL) s LEFT JOIN pairs p ON p.doc_id = s.doc_id AND p.shared_term = s.term WHERE n_mandatory > 0 AND n_prohibiting > 0 GROUP BY ALL",
        "conflicts_of_rule": f"SELECT doc_id, source, target, shared_term FROM pairs WHERE '{req}' IN (source, target)",
        "conflict_pairs": "SELECT doc_id, source, target, shared_term FROM pairs",
        "graph_edges": "SELECT doc_id, edge_ord, source, target, type FROM edges",
        "node_counts": "SELECT doc_id, label, count(*) AS n FROM nodes GROUP BY ALL",
        "edge_counts": "SELECT doc_id, type, count(*) AS n FROM edges GROUP BY ALL",
        "refine_edges": "SELECT doc_id, edge_ord, source, target, CASE WHEN EXISTS (FROM edges x WHERE x.doc_id = e.doc_id AND x.source = e.source AND x.target = e.target AND x.type = 'IMPLEMENTS') THEN 'REFERENCES' ELSE type END AS type FROM edges e",
        "resolve_exact": f"SELECT doc_id, query, id FROM (SELECT doc_id, query, id, CASE WHEN id = upper(query) THEN 0 WHEN id = 'TERM-' || lower(query) THEN 1 WHEN id = 'SEC-' || {NORM.format('query')} THEN 2 END AS p FROM nodes, (SELECT unnest([{listed(named)}]) AS query)) WHERE p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, query ORDER BY p) = 1",
        "search_top3": f", {asked} SELECT doc_id, query, id, score, CAST(rank AS INT) AS rank FROM (SELECT doc_id, query, id, score, row_number() OVER (PARTITION BY doc_id, query ORDER BY score DESC, node_ord) AS rank FROM (SELECT a.doc_id, a.query, a.id, a.node_ord, CAST(sum({points}) AS DOUBLE) AS score FROM asked a JOIN toks USING (query) GROUP BY ALL) WHERE score > 0) WHERE rank <= 3",
        "context_requirement": _context(req_cands, f", o AS ({of_req} = e.source), i AS ({of_req} = e.target)"),
        "context_term": _context(term_cands),
        "context_section": _context("SELECT doc_id, query, me, id, CAST(level AS VARCHAR) || path AS tag FROM walk WHERE level > 0", walk),
        "section_path": f", {chain_up} SELECT doc_id, id, string_agg(place, ' > ' ORDER BY step DESC) AS path FROM climb GROUP BY ALL",
        "relationship_buckets": "SELECT doc_id, id, bucket, count(*) AS n FROM (SELECT e.doc_id, source AS id, CASE WHEN n.label = 'Term' THEN 'terms' WHEN type = 'DEPENDS_ON' THEN 'dependsOn' WHEN type = 'IMPLEMENTS' THEN 'implements' WHEN type = 'CONFLICTS_WITH' THEN 'conflicts' ELSE 'references' END AS bucket FROM edges e JOIN nodes n ON n.doc_id = e.doc_id AND n.id = e.target UNION ALL SELECT e.doc_id, target, CASE type WHEN 'DEPENDS_ON' THEN 'requiredBy' WHEN 'IMPLEMENTS' THEN 'implementedBy' WHEN 'CONFLICTS_WITH' THEN 'conflicts' ELSE 'referencedBy' END FROM edges e WHERE starts_with(source, 'REQ-')) GROUP BY ALL",
        "section_children": "SELECT doc_id, id, kind, child, CAST(row_number() OVER (PARTITION BY doc_id, id, kind ORDER BY s, r) AS INT) AS pos FROM (SELECT e.doc_id, e.source AS id, CASE WHEN starts_with(e.target, 'SEC-') THEN 'section' ELSE 'requirement' END AS kind, e.target AS child, s.sec_ord AS s, r.rule_ord AS r FROM edges e LEFT JOIN secs s ON s.doc_id = e.doc_id AND s.id = e.target LEFT JOIN ledger r ON r.doc_id = e.doc_id AND r.id = e.target WHERE type = 'CONTAINS')",
        "term_by_section": "SELECT t.doc_id, t.target AS term, coalesce(h.section, 'unknown') AS section, count(DISTINCT t.source) AS n FROM term_links t LEFT JOIN homes h ON h.doc_id = t.doc_id AND h.id = t.source GROUP BY ALL",
        "substring_search": f"SELECT doc_id, id FROM nodes WHERE {hit}",
        "neighborhood": f", m AS (SELECT doc_id, id FROM nodes WHERE {hit}), near AS (SELECT e.doc_id, e.target AS id FROM edges e SEMI JOIN m ON m.doc_id = e.doc_id AND m.id = e.source UNION SELECT e.doc_id, e.source FROM edges e SEMI JOIN m ON m.doc_id = e.doc_id AND m.id = e.target) SELECT doc_id, id, CASE WHEN (doc_id, id) IN (FROM m) THEN 'selected' WHEN (doc_id, id) IN (FROM near) THEN 'near' ELSE 'dimmed' END AS state FROM nodes",
        "edge_states": f", m AS (SELECT doc_id, id FROM nodes WHERE {hit}) SELECT doc_id, edge_ord, CASE WHEN (doc_id, source) IN (FROM m) OR (doc_id, target) IN (FROM m) THEN 'highlighted' ELSE 'dimmed' END AS state FROM edges",
        "search_tree": f", m AS (SELECT doc_id, id FROM nodes WHERE {hit}), links AS (SELECT * FROM up UNION ALL SELECT * FROM homes), tree AS (SELECT doc_id, id FROM m UNION SELECT t.doc_id, l.parent FROM tree t JOIN links l ON l.doc_id = t.doc_id AND l.id = t.id) SELECT t.doc_id, t.id, CASE WHEN (t.doc_id, l.parent) IN (SELECT (doc_id, id) FROM tree) THEN l.parent END AS parent, (t.doc_id, t.id) IN (SELECT (doc_id, id) FROM m) AS matched FROM tree t LEFT JOIN links l ON l.doc_id = t.doc_id AND l.id = t.id",
        "markdown": rf""", mdw AS (SELECT doc_id, sec_ord, section, title, lpad(CAST(sec_ord AS VARCHAR), 8, '0') AS path, 1 AS depth FROM ({{outline}}) WHERE parent_ord IS NULL
UNION ALL SELECT o.doc_id, o.sec_ord, o.section, o.title, w.path || '.' || lpad(CAST(o.sec_ord AS VARCHAR), 8, '0'), w.depth + 1 FROM ({{outline}}) o JOIN mdw w ON o.doc_id = w.doc_id AND o.parent_ord = w.sec_ord),
held AS (SELECT b.*, h.block_no AS home FROM blk b ASOF JOIN heads h ON b.doc_id = h.doc_id AND b.block_no >= h.block_no WHERE b.type <> 'heading'),
pieces AS (SELECT doc_id, path AS k, repeat('#', least(depth, 6)) || ' ' || section || ' ' || title || chr(10) AS piece FROM mdw UNION ALL SELECT doc_id, path || '~', chr(10) FROM mdw WHERE depth = 1
UNION ALL SELECT b.doc_id, w.path || '!' || lpad(CAST(b.block_no AS VARCHAR), 8, '0'), CASE b.type WHEN 'list_item' THEN coalesce(b.prefix, '-') || ' ' || b.text || chr(10) WHEN 'table' THEN '```' || chr(10) || b.text || chr(10) || '```' || chr(10) ELSE b.text || chr(10) END FROM held b JOIN mdw w ON w.doc_id = b.doc_id AND w.sec_ord = b.home)
SELECT doc_id, regexp_replace(string_agg(piece, chr(10) ORDER BY k), '^\s+|\s+$', '', 'g') AS markdown FROM pieces GROUP BY doc_id""",
        "context_blend": _blend(d, search, points) + " SELECT doc_id, query, role, pos, id FROM ctx",
        "audit_payload": _blend(d, audited, points) + _payload(d, audited),
        "heading_candidates": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INT) AS cid, page_number, line_idx, line FROM kinds WHERE kind = 'heading'",
        "heading_demotion": r"SELECT doc_id, page_number, line_idx, CASE WHEN cid > 0 AND cid % 3 = 0 THEN CASE WHEN contains(line, '|') OR regexp_matches(line, '\S\s{3,}\S') THEN 'table_row' ELSE 'text' END ELSE kind END AS kind, cid FROM (SELECT *, CAST(CASE WHEN kind = 'heading' THEN count(*) FILTER (kind = 'heading') OVER (PARTITION BY doc_id ORDER BY line_no) ELSE 0 END AS INT) AS cid FROM kinds)",
        "tabular_rules": "SELECT doc_id, CAST(n AS INT) AS rule_ord, format('REQ-{:03d}', n) AS id, section_number, 'Mandatory' AS constraint_type, 'Limit of ' || id || ' on page ' || page_number AS text, id AS source_block_id, page_number FROM (SELECT b.*, coalesce(last, 0) + row_number() OVER (PARTITION BY b.doc_id ORDER BY block_no) AS n FROM placed b LEFT JOIN (SELECT doc_id, max(rule_ord) AS last FROM ledger GROUP BY doc_id) l ON l.doc_id = b.doc_id WHERE type = 'table' AND right(id, 1) IN ('0', '2', '4', '6', '8'))",
        "conflict_validation": "SELECT doc_id, source, target, shared_term FROM pairs WHERE right(source, 1) IN ('1', '3', '5')",
        "model_terms": r"SELECT doc_id, term, freq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, pos) AS INT) AS term_ord FROM (SELECT doc_id, term, pos, count(*) FILTER (regexp_matches(text, '(?i)\b' || term || 's?\b')) AS freq FROM ledger, (VALUES ('payload', 0), ('response time', 1), ('heartbeat', 2), ('timeout', 3)) v(term, pos) GROUP BY ALL)",
        "node_projection": "SELECT doc_id, id, label AS grp, CASE WHEN label = 'Requirement' THEN id ELSE coalesce(nullif(title, ''), nullif(name, ''), id) END AS label, coalesce(nullif(text, ''), nullif(title, ''), nullif(name, ''), id) AS tooltip FROM nodes",
        "stream_rules": "SELECT doc_id, constraint_type, count(*) AS n_rules FROM ledger GROUP BY ALL",
    }
    out["markdown"] = out["markdown"].replace("{outline}", out["outline_tree"])
    found = {k: f"{c}\n{v}" for k, v in out.items()}
    for other in ("generic", "security"):  # other curated terms and stop words over the same rules
        mixed = replace(d, terms=domain(other).terms, stopwords=domain(other).stopwords)
        found[f"{other}_terms"] = f"{chain(mixed)}\n{out['term_merge']}"
    found |= {
        "line_kinds": f"{doc_lines}, k AS (SELECT *, {_kind('line')} AS kind FROM s) SELECT doc_id, CAST(line_idx AS INT) AS line_idx, kind, {_groups('kind', 'line')} FROM k",
        "sentence_split": f"SELECT doc_id, CAST(i - 1 AS INT) AS sent_idx, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_split('text')} AS l FROM documents))",
        "domain_detect": f"SELECT doc_id, g AS grid, s AS security, CASE WHEN g > 1 AND g >= s THEN 'smartGrid' WHEN s > 1 AND s > g THEN 'security' ELSE 'generic' END AS preset FROM (SELECT doc_id, CAST({grid} AS DOUBLE) AS g, CAST({secure} AS DOUBLE) AS s FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))",
        "stream_events": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    }
    # an index changes what is read, not what is found
    found |= {"substring_indexed": found["substring_search"], "top3_indexed": found["search_top3"]}
    return found


def _grid() -> tuple[list[str], list[str], list[str], list[str]]:
    from specloom.functions import vocabulary as v

    return v.GRID_WORDS, v.GRID_PATTERNS, v.SECURITY_WORDS, v.SECURITY_PATTERNS

"""Queries over the synthetic workspace: extraction, the query language, the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import context as C
from lodestone.operators import extract as E
from lodestone.operators import graph as G
from lodestone.operators import query as Q
from lodestone.operators.ordered import cut
from lodestone.sources import table
from lodestone.sources import workspace as W

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
MD = W.oracle_lines()


def _parsed(spark, d):
    return W.parsed(table(spark, d, "documents"))


def _add(name, query, sql):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = f"WITH {MD}{sql}"


_add("md_headings", lambda s, d: E.rows_of(_parsed(s, d), "headings"), " SELECT path, line, depth, text, slug FROM md_headings")
_add(
    "md_links",
    lambda s, d: E.resolved(E.rows_of(_parsed(s, d), "links")).select("path", "line", "text", "target", "image", "external", "resolved", "fragment"),
    " SELECT path, line, text, target, image, external, resolved, fragment FROM md_links",
)
_add("md_tasks", lambda s, d: E.rows_of(_parsed(s, d), "tasks"), " SELECT path, line, a = 'true' AS checked, b AS text FROM md_lines WHERE tag = 'task'")
_add(
    "md_code_blocks",
    lambda s, d: E.rows_of(_parsed(s, d), "code_blocks").select("path", "line", "end_line", "language", "content"),
    " SELECT path, line, line + 3 AS end_line, a AS language, concat('# not a heading', chr(10), '[fake](x.md)') AS content FROM md_lines WHERE tag = 'fence'",
)
_add(
    "md_tables",
    lambda s, d: E.rows_of(_parsed(s, d), "tables").select("path", "line", "end_line", "n_columns", "n_rows", F.array_join("align", ",").alias("align")),
    " SELECT path, line, line + 2 AS end_line, 2 AS n_columns, 1 AS n_rows, 'none,center' AS align FROM md_lines WHERE tag = 'table'",
)
_add(
    "md_sections",
    lambda s, d: E.sections(_parsed(s, d)),
    """, fm AS (SELECT doc_id, path, count(*) FILTER (tag = 'front') AS f, max(n_lines) AS n_lines FROM md_lines GROUP BY 1, 2),
heads AS (SELECT path, text AS heading, slug, depth, line AS start_line FROM md_headings UNION ALL SELECT path, NULL, NULL, 0, CAST(f + 1 AS INTEGER) FROM fm)
SELECT h.path, heading, slug, depth, start_line, CAST(coalesce(lead(start_line) OVER (PARTITION BY h.path ORDER BY start_line), n_lines + 1) - 1 AS INTEGER) AS end_line FROM heads h JOIN fm USING (path)""",
)
_add(
    "md_outline",
    lambda s, d: E.outline(_parsed(s, d)),
    " SELECT path, line, depth, slug, CASE WHEN depth = 2 THEN first_value(CASE WHEN depth = 1 THEN slug END) OVER (PARTITION BY path ORDER BY line) END AS parent FROM md_headings",
)
_add(
    "md_section_ends",
    lambda s, d: E.subtree_end(_parsed(s, d)),
    " SELECT path, slug, line, CAST(CASE WHEN depth = 1 THEN n_lines ELSE coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, n_lines) END AS INTEGER) AS last_line FROM md_headings",
)
_add(
    "md_toc",
    lambda s, d: E.toc(_parsed(s, d)),
    " SELECT path, string_agg(concat(repeat('  ', depth - low), '- [', text, '](#', slug, ')'), chr(10) ORDER BY line) AS toc FROM (SELECT *, min(depth) OVER (PARTITION BY path) AS low FROM md_headings) GROUP BY path",
)
_DOCS = """, md_doc AS (SELECT i AS doc_id, path, concat('Title ', i % 50) AS title, i % 11 <> 0 AS h1, CAST(i % 4 + CASE WHEN i % 11 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS headings,
  CAST(2 + CASE WHEN i % 4 = 1 THEN 1 ELSE 0 END + CASE WHEN i % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS links, CAST(i % 3 AS INTEGER) AS tasks, CAST((i + 1) % 2 AS INTEGER) AS code, lang, n_chars FROM md_docs)"""
_add(
    "md_documents",
    lambda s, d: Q.run(Q.relation(_parsed(s, d), "documents"), Q.plan("documents", select="file,title,h1,headings,links,tasks,code")),
    _DOCS + " SELECT path AS file, title, h1, headings, links, tasks, code FROM md_doc",
)
_add(
    "md_frontmatter",
    lambda s, d: Q.relation(_parsed(s, d), "frontmatter").select("file", "key", "value", "type"),
    """ SELECT path AS file, 'title' AS key, concat('Title ', i % 50) AS value, 'string' AS type FROM md_docs
UNION ALL SELECT path, 'lang', lang, 'string' FROM md_docs UNION ALL SELECT path, 'n_chars', CAST(n_chars AS VARCHAR), 'number' FROM md_docs
UNION ALL SELECT path, 'owner', CASE WHEN i % 7 = 0 THEN NULL ELSE concat('o', i % 4) END, CASE WHEN i % 7 = 0 THEN 'null' ELSE 'string' END FROM md_docs WHERE i % 5 <> 0
UNION ALL SELECT path, 'tags', concat('["a","b', i % 6, '"]'), 'array' FROM md_docs WHERE i % 3 = 0""",
)


def _query(name, entity, where, sql_where, select="file", sql_select="path AS file", source="md_doc", group=None):
    _add(f"md_query_{name}", lambda s, d: Q.run(Q.relation(_parsed(s, d), entity), Q.plan(entity, where, select, group)), f"{_DOCS} SELECT {sql_select} FROM {source} WHERE {sql_where}")


_OWNER = "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('o', doc_id % 4) END"
_query("eq", "documents", "title = Title 7", "title = 'Title 7'")
_query("ne_static", "code", "language != python", "tag = 'fence' AND a <> 'python'", "file,line", "path AS file, line", "md_lines")
_query("contains", "headings", "text ~ PART", "contains(lower(text), 'part')", "file,slug", "path AS file, slug", "md_headings")
_query("gt", "documents", "headings >= 4", "headings >= 4", "file,headings", "path AS file, headings")
_query("two_terms", "documents", "tasks > 0 AND h1 = false", "tasks > 0 AND NOT h1")
_query("has", "documents", "has:h1", "h1")
_query("has_not", "documents", "!has:h1", "NOT h1")
_query("has_dynamic", "documents", "has:frontmatter.owner", "doc_id % 5 <> 0 AND doc_id % 7 <> 0")
_query("not_has_dynamic", "documents", "!has:frontmatter.tags", "doc_id % 3 <> 0")
_query("ne_dynamic", "documents", "frontmatter.owner != o1", f"doc_id % 5 = 0 OR coalesce({_OWNER} <> 'o1', false)")
_query("array_any", "documents", "frontmatter.tags = b3", "doc_id % 3 = 0 AND doc_id % 6 = 3")
_query("array_none", "documents", "frontmatter.tags != b3", "NOT (doc_id % 3 = 0 AND doc_id % 6 = 3)")
_query("dynamic_number", "tasks", "frontmatter.n_chars < 900 AND status = done", "tag = 'task' AND a = 'true' AND (SELECT n_chars FROM md_doc WHERE md_doc.doc_id = md_lines.doc_id) < 900", "file,line", "path AS file, line", "md_lines")
_query("select_dynamic", "headings", "depth = 1", "depth = 1", "slug,frontmatter.owner", f"slug, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE {_OWNER} END AS frontmatter_owner", "md_headings")
_query("links_to", "links", "links-to:d1/doc-1.md#part-0", "resolved = 'd1/doc-1.md' AND fragment = 'part-0'", "file,line", "path AS file, line", "md_links")
_query("documents_links_to", "documents", "links-to:d8/doc-8.md", "path IN (SELECT path FROM md_links WHERE resolved = 'd8/doc-8.md')")
_query("not_links_to", "documents", "!links-to:d8/doc-8.md", "path NOT IN (SELECT path FROM md_links WHERE resolved = 'd8/doc-8.md')")
_add(
    "md_group_by_scalar",
    lambda s, d: Q.run(Q.relation(_parsed(s, d), "tasks"), Q.plan("tasks", group_by="status")).select("key", "count"),
    " SELECT CASE WHEN a = 'true' THEN 'done' ELSE 'pending' END AS key, count(*) AS count FROM md_lines WHERE tag = 'task' GROUP BY 1",
)
_add(
    "md_group_by_array",
    lambda s, d: Q.run(Q.relation(_parsed(s, d), "documents"), Q.plan("documents", group_by="frontmatter.tags")),
    """, k AS (SELECT path, unnest(CASE WHEN i % 3 = 0 THEN ['a', concat('b', i % 6)] ELSE [NULL] END) AS key FROM md_docs)
SELECT key, count(*) AS count, string_agg(path, ',' ORDER BY path) AS files FROM k GROUP BY key""",
)
_add(
    "md_group_by_missing",
    lambda s, d: Q.run(Q.relation(_parsed(s, d), "documents"), Q.plan("documents", group_by="frontmatter.owner")).select("key", "count"),
    " SELECT CASE WHEN i % 5 = 0 OR i % 7 = 0 THEN NULL ELSE concat('o', i % 4) END AS key, count(*) AS count FROM md_docs GROUP BY 1",
)
_add(
    "md_structure",
    lambda s, d: E.structure(_parsed(s, d)),
    """ SELECT path, line, CASE tag WHEN 'head' THEN 'heading' WHEN 'fence' THEN 'code' ELSE tag END AS kind, CASE tag WHEN 'head' THEN concat(repeat('#', CAST(a AS INTEGER)), ' ', b) WHEN 'fence' THEN a WHEN 'table' THEN '1x2' ELSE b END AS detail
FROM md_lines WHERE tag IN ('head', 'fence', 'table', 'task')""",
)


def _with_toc(s, d):
    tocs = E.toc(_parsed(s, d))
    docs = W.markdown(table(s, d, "documents")).join(tocs, "path", "left")
    block = F.concat(F.lit(E.TOC_START + "\n"), F.coalesce("toc", F.lit("")), F.when(F.col("doc_id") % 4 == 0, "x").otherwise(""), F.lit("\n"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(E.TOC_END))
    return E.toc_state(docs.select("path", F.when(F.col("doc_id") % 5 == 0, F.col("content")).otherwise(F.concat("content", F.lit("\n"), block)).alias("content")), tocs)


_add("md_toc_state", _with_toc, " SELECT path, CASE WHEN i % 5 = 0 THEN 'missing' WHEN i % 9 = 0 THEN 'malformed' WHEN i % 4 = 0 THEN 'stale' ELSE 'synchronised' END AS state FROM md_docs")
_add(
    "md_duplicates",
    lambda s, d: E.rows_of(_parsed(s, d), "headings").groupBy(F.lower("text").alias("value")).agg(F.count("*").alias("count"), F.min(F.struct("path", "line", "text"))["text"].alias("first")).where("count > 1"),
    " SELECT lower(text) AS value, count(*) AS count, arg_min(text, (path, line)) AS first FROM md_headings GROUP BY 1 HAVING count(*) > 1",
)
_add(
    "md_missing_h1",
    lambda s, d: _parsed(s, d).where(~F.exists("headings", lambda h: h["depth"] == 1)).select("path"),
    " SELECT path FROM md_docs WHERE i % 11 = 0",
)
_add(
    "md_frontmatter_keys",
    lambda s, d: (
        Q.relation(_parsed(s, d), "frontmatter").groupBy("key").agg(F.count_distinct("file").alias("documents"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types")).join(F.broadcast(_parsed(s, d).agg(F.count("*").alias("n"))))  # one row
        .select("key", "documents", F.round(F.col("documents") / F.col("n"), 4).alias("coverage"), "types")
    ),
    """, k AS (SELECT 'title' AS key, 'string' AS type FROM md_docs UNION ALL SELECT 'lang', 'string' FROM md_docs UNION ALL SELECT 'n_chars', 'number' FROM md_docs
  UNION ALL SELECT 'owner', CASE WHEN i % 7 = 0 THEN 'null' ELSE 'string' END FROM md_docs WHERE i % 5 <> 0 UNION ALL SELECT 'tags', 'array' FROM md_docs WHERE i % 3 = 0)
SELECT key, count(*) AS documents, round(count(*) / (SELECT count(*) FROM md_docs), 4) AS coverage, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM k GROUP BY key""",
)
_add(
    "md_stats",
    lambda s, d: _parsed(s, d).agg(
        F.count("*").alias("documents"), F.sum(F.size("headings")).alias("headings"), F.sum(F.size(F.filter("links", lambda x: x["image"]))).alias("images"), F.sum(F.size(F.filter("links", lambda x: x["external"]))).alias("external"),
        F.sum(F.size("tasks")).alias("tasks"), F.sum(F.size(F.filter("tasks", lambda t: t["checked"]))).alias("done"), F.sum(F.size("tables")).alias("tables"),
    ),
    " SELECT count(DISTINCT path) AS documents, count(*) FILTER (tag = 'head') AS headings, count(*) FILTER (tag = 'image') AS images, count(*) FILTER (tag = 'site') AS external, count(*) FILTER (tag = 'task') AS tasks, count(*) FILTER (tag = 'task' AND a = 'true') AS done, count(*) FILTER (tag = 'table') AS tables FROM md_lines",
)
_add(
    "md_code_languages",
    lambda s, d: E.rows_of(_parsed(s, d), "code_blocks").groupBy(F.coalesce("language", F.lit("(none)")).alias("language")).agg(F.count("*").alias("blocks")),
    " SELECT coalesce(a, '(none)') AS language, count(*) AS blocks FROM md_lines WHERE tag = 'fence' GROUP BY 1",
)
_add(
    "md_unused_assets",
    lambda s, d: s.range(8).select(F.concat(F.lit("img/pic-"), F.col("id").cast("string"), F.lit(".png")).alias("asset")).join(E.resolved(E.rows_of(_parsed(s, d), "links")).select(F.col("resolved").alias("asset")), "asset", "left_anti"),
    " SELECT concat('img/pic-', k, '.png') AS asset FROM (SELECT unnest(range(8)) AS k) WHERE asset NOT IN (SELECT resolved FROM md_links WHERE resolved IS NOT NULL)",
)


def _graph(spark, d):
    parsed = _parsed(spark, d).select("path", "links", "headings")
    links = E.resolved(E.rows_of(parsed, "links"))
    return links, parsed.select("path"), parsed


def _edges(spark, d):
    links, paths, _ = _graph(spark, d)
    return G.edges(links, paths), paths


_EDGES = """, e AS (SELECT path AS source, resolved AS target, list(line ORDER BY line) AS lines, count(*) AS occurrences FROM md_links WHERE NOT image AND NOT external AND resolved IN (SELECT path FROM md_docs) GROUP BY 1, 2)"""
_add("graph_edges", lambda s, d: _edges(s, d)[0].withColumn("lines", F.array_join("lines", ",")), f"{_EDGES} SELECT source, target, array_to_string(lines, ',') AS lines, occurrences FROM e")
_add("graph_broken", lambda s, d: G.broken(*_graph(s, d)[:2]), " SELECT path AS source, target, resolved, line FROM md_links WHERE NOT image AND NOT external AND resolved NOT IN (SELECT path FROM md_docs)")
_add(
    "graph_degrees",
    lambda s, d: G.degrees(*_edges(s, d)),
    f"{_EDGES} SELECT path, CAST(coalesce((SELECT sum(occurrences) FROM e WHERE target = path), 0) AS BIGINT) AS inbound, CAST(coalesce((SELECT sum(occurrences) FROM e WHERE source = path), 0) AS BIGINT) AS outbound, NOT EXISTS (SELECT 1 FROM e WHERE source = path) AS dead_end FROM md_docs",
)
_add("graph_orphans", lambda s, d: G.orphans(*_edges(s, d), ["d0/doc-0.md"]), f"{_EDGES} SELECT path FROM md_docs WHERE path <> 'd0/doc-0.md' AND path NOT IN (SELECT target FROM e)")
_add(
    "graph_missing_anchors",
    lambda s, d: (lambda g: G.missing_anchors(g[0], g[2].select("path", F.explode_outer("headings.slug").alias("slug"))))(_graph(s, d)),
    " SELECT path, line, target FROM md_links l WHERE fragment IS NOT NULL AND resolved IN (SELECT path FROM md_docs) AND NOT EXISTS (SELECT 1 FROM md_headings h WHERE h.path = l.resolved AND h.slug = l.fragment)",
)
_add(
    "graph_reach",
    lambda s, d: G.reachable(_edges(s, d)[0], s.createDataFrame([("d0/doc-0.md",)], "path string"), 6),
    f", {_EDGES[2:]}, r(path, distance) AS (SELECT 'd0/doc-0.md', 0 UNION ALL SELECT target, distance + 1 FROM r JOIN e ON e.source = r.path WHERE distance < 6) SELECT path, min(distance) AS distance FROM r GROUP BY path",
)
_add(
    "graph_reach_all",
    lambda s, d: G.reachable(_edges(s, d)[0], s.createDataFrame([("d0/doc-0.md",)], "path string")),
    f", {_EDGES[2:].replace('e AS (', 'e AS MATERIALIZED (', 1)}, r(path, distance) USING KEY (path) AS (SELECT 'd0/doc-0.md', 0 UNION SELECT target, min(distance) + 1 FROM r JOIN e ON e.source = r.path WHERE NOT EXISTS (SELECT 1 FROM recurring.r q WHERE q.path = e.target) GROUP BY target) SELECT path, distance FROM r",
)
_add(
    "graph_focus",
    lambda s, d: G.focus(_edges(s, d)[0], "d8/doc-8.md", 1),
    f"{_EDGES}, n AS (SELECT 'd8/doc-8.md' AS path UNION SELECT target FROM e WHERE source = 'd8/doc-8.md' UNION SELECT source FROM e WHERE target = 'd8/doc-8.md') SELECT source, target, occurrences FROM e WHERE source IN (SELECT path FROM n) AND target IN (SELECT path FROM n)",
)
for _n in ("graph_reach", "graph_reach_all"):
    ORACLE_SQL[_n] = ORACLE_SQL[_n].replace("WITH ", "WITH RECURSIVE ", 1)
QUERIES["graph_components"] = lambda s, d: G.components(*_edges(s, d))
ORACLE_SQL["graph_components"] = f"""WITH RECURSIVE {MD}{_EDGES}, both_ways AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e),
r(path, seen) AS (SELECT path, path FROM md_docs UNION SELECT b, seen FROM r JOIN both_ways ON a = r.path) SELECT path, min(seen) AS component FROM r GROUP BY path"""
QUERIES["graph_cycles"] = lambda s, d: G.cycles(*_edges(s, d))
ORACLE_SQL["graph_cycles"] = f"""WITH RECURSIVE {MD}{_EDGES}, r(a, b) AS (SELECT source, target FROM e UNION SELECT r.a, e.target FROM r JOIN e ON e.source = r.b)
SELECT x.a AS path, min(x.b) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a"""
_SEEDS = ["d8/doc-8.md", "d1/doc-1.md"]
_BUDGET = 6000


def _context(s, d):
    parsed = W.parsed(table(s, d, "documents"), keep=("content",)).select("path", "content", "n_lines", "frontmatter_end", "headings", "links")
    parsed = cut(parsed)  # read by the graph and by the units
    return C.pack(parsed, G.edges(E.resolved(E.rows_of(parsed, "links")), parsed.select("path")), C.seed_rows(s, _SEEDS), 2, _BUDGET, backlinks=True, frontmatter=True)


#: The text of each line of the synthetic workspace, and the documents within two hops of the seeds in order of discovery.
_PACK = f"""{_EDGES}, shown AS (SELECT m.path, m.line, n_lines, tag, CASE tag
    WHEN 'front' THEN CASE WHEN line = 1 OR line = f THEN '---' WHEN line = 2 THEN concat('title: Title ', i % 50) WHEN line = 3 THEN concat('lang: ', lang) WHEN line = 4 THEN concat('n_chars: ', n_chars)
      WHEN line = 5 AND i % 5 <> 0 THEN CASE WHEN i % 7 = 0 THEN 'owner: null' ELSE concat('owner: o', i % 4) END ELSE concat('tags: [a, b', i % 6, ']') END
    WHEN 'head' THEN concat(repeat('#', CAST(a AS INTEGER)), ' ', b) WHEN 'text' THEN a WHEN 'link' THEN concat('[', a, '](', b, ')') WHEN 'image' THEN concat('![', a, '](', b, ')') WHEN 'site' THEN concat('[', a, '](', b, ')')
    WHEN 'task' THEN concat(CASE WHEN a = 'true' THEN '- [x] ' ELSE '- [ ] ' END, b) WHEN 'fence' THEN concat('```', a) WHEN 'code' THEN CASE WHEN lag(tag) OVER (PARTITION BY m.path ORDER BY line) = 'fence' THEN '# not a heading' ELSE '[fake](x.md)' END
    WHEN 'end' THEN '```' WHEN 'table' THEN '| a | b |' WHEN 'rule' THEN '|---|:-:|' WHEN 'cells' THEN '| 1 | 2 |' ELSE '' END AS t, f
  FROM md_lines m JOIN (SELECT path, count(*) AS f FROM md_lines WHERE tag = 'front' GROUP BY path) USING (path) JOIN md_docs USING (path)),
starts AS (SELECT path, 1 AS start_line, 'frontmatter' AS kind, NULL AS slug FROM shown WHERE line = 1 UNION ALL SELECT path, CAST(f + 1 AS INTEGER), 'preamble', NULL FROM shown WHERE line = 1 UNION ALL SELECT path, line, 'section', slug FROM md_headings),
units AS (SELECT path, kind, slug, start_line, CAST(coalesce(lead(start_line) OVER (PARTITION BY path ORDER BY start_line), (SELECT max(line) + 1 FROM shown s WHERE s.path = starts.path)) - 1 AS INTEGER) AS end_line FROM starts),
step AS (SELECT source AS a, target AS b, 0 AS dir, lines[1] AS line FROM e UNION ALL SELECT target, source, 1, lines[1] FROM e),
l0 AS (SELECT unnest({_SEEDS}) AS path, unnest([['0'], ['1']]) AS key),
c1 AS (SELECT b AS path, list_append(key, concat(dir, b)) AS key, path AS via, line, dir FROM l0 JOIN step ON a = path WHERE b NOT IN (SELECT path FROM l0)),
l1 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY path ORDER BY key) = 1),
c2 AS (SELECT b AS path, list_append(key, concat(step.dir, b)) AS key, path AS via, step.line, step.dir FROM l1 JOIN step ON a = path WHERE b NOT IN (SELECT path FROM l0 UNION ALL SELECT path FROM l1)),
l2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY path ORDER BY key) = 1),
found AS (SELECT path, key, 0 AS distance, NULL AS via, NULL AS line, NULL AS dir FROM l0 UNION ALL SELECT path, key, 1, via, line, dir FROM l1 UNION ALL SELECT path, key, 2, via, line, dir FROM l2),
sized AS (SELECT path, key, distance, via, f.line, dir, kind, slug, start_line, end_line, (SELECT octet_length(encode(string_agg(t, chr(10) ORDER BY s.line))) FROM shown s WHERE s.path = f.path AND s.line BETWEEN start_line AND end_line) AS bytes FROM found f JOIN units USING (path)),
packed AS (SELECT concat(path, '#', coalesce(slug, kind)) AS id, CAST(distance AS INTEGER) AS distance, via, CAST(line AS INTEGER) AS via_line, CASE dir WHEN 0 THEN 'link' WHEN 1 THEN 'backlink' ELSE 'seed' END AS direction, start_line, end_line, CAST(bytes AS BIGINT) AS bytes,
  CAST(sum(bytes) OVER (ORDER BY distance, key, start_line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM sized)"""
_add("context_pack", lambda s, d: _context(s, d).select("id", "distance", "via", "via_line", "direction", "start_line", "end_line", "bytes", "running", "included"), f"{_PACK} SELECT *, running <= {_BUDGET} AS included FROM packed")
_add(
    "context_summary",
    lambda s, d: C.summary(_context(s, d), _BUDGET),
    f"""{_PACK}, r AS (SELECT *, split_part(id, '#', 1) AS file, running <= {_BUDGET} AS included FROM packed)
SELECT count(DISTINCT file) FILTER (included) AS files, count(*) FILTER (included) AS units, CAST({_BUDGET} AS BIGINT) AS limit_bytes, CAST(coalesce(sum(bytes) FILTER (included), 0) AS BIGINT) AS used_bytes, CAST(coalesce(sum(bytes) FILTER (NOT included), 0) AS BIGINT) AS omitted_bytes,
  CAST(ceil(coalesce(sum(bytes) FILTER (included), 0) / 4) AS BIGINT) AS token_estimate, bool_or(NOT included) AS truncated FROM r""",
)
_add(
    "graph_unreachable",
    lambda s, d: G.unreachable(*_edges(s, d), ["d0/doc-0.md", "no/such.md"]),
    f"{_EDGES.replace('e AS (', 'e AS MATERIALIZED (', 1)}, r(path) AS (SELECT 'd0/doc-0.md' UNION SELECT target FROM r JOIN e ON e.source = r.path) SELECT path FROM md_docs WHERE path NOT IN (SELECT path FROM r)",
)
ORACLE_SQL["graph_unreachable"] = ORACLE_SQL["graph_unreachable"].replace("WITH ", "WITH RECURSIVE ", 1)
_add(
    "graph_dot",
    lambda s, d: G.diagram(*_edges(s, d), "dot").select("ord", F.array_join("place", ",").alias("place"), "line"),
    f"""{_EDGES}, n AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS n FROM md_docs)
SELECT CAST(0 AS INTEGER) AS ord, '0,0' AS place, 'digraph markdown {{' AS line UNION ALL SELECT 3, '0,0', '}}' UNION ALL SELECT 1, concat(n, ',0'), concat('  n', n, ' [label="', path, '"];') FROM n
UNION ALL SELECT 2, concat(a.n, ',', b.n), concat('  n', a.n, ' -> n', b.n, ';') FROM e JOIN n a ON a.path = source JOIN n b ON b.path = target""",
)

"""Queries of the facets of a comparison, of sections and of listings over the synthetic workspace."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone.operators import diffs as D
from lodestone.operators import edits as X
from lodestone.operators import extract as E
from lodestone.operators import query as Q
from lodestone.sources import files, sinks, table
from lodestone.sources import workspace as W

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
MD = W.oracle_lines()
BOTH = f"{W.oracle_lines(0)},{W.oracle_lines(2)}"


def _two(s, d, keep=()):
    docs = table(s, d, "documents")
    return W.parsed(docs, 0, keep), W.parsed(docs, 2, keep)


def _add(name, query, sql, both=False):
    QUERIES[name] = query
    ORACLE_SQL[name] = f"WITH {BOTH if both else MD}{sql}"


# Revision 2 lacks every 17th document and changes links, code, tables and bodies of others.
_LINKS = """, a AS (SELECT * FROM md_links WHERE text NOT IN ('site', 'home')), b AS (SELECT * FROM md_links2 WHERE text NOT IN ('site', 'home')),
p AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS kind, coalesce(a.text, b.text) AS text, a.target AS old_target, b.target AS new_target,
  a.resolved AS old_resolved, b.resolved AS new_resolved, a.line AS old_line, b.line AS new_line, coalesce(a.resolved = b.resolved, false) AS fragment_changed
 FROM a FULL JOIN b ON a.path = b.path AND a.text = b.text WHERE a.target IS DISTINCT FROM b.target)
SELECT * FROM p UNION ALL SELECT path, 'removed', text, target, NULL, NULL, NULL, line, NULL, false FROM md_links WHERE text = 'site' AND path NOT IN (SELECT path FROM md_docs2)"""
_add("diff_links", lambda s, d: D.link_changes(*_two(s, d)), _LINKS, True)
_CODE = """, a AS (SELECT f.path, f.line, f.a AS lang, c.a AS content FROM md_lines f JOIN md_lines c ON c.path = f.path AND c.line = f.line + 1 WHERE f.tag = 'fence'),
b AS (SELECT f.path, f.line, f.a AS lang, c.a AS content FROM md_lines2 f JOIN md_lines2 c ON c.path = f.path AND c.line = f.line + 1 WHERE f.tag = 'fence')
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS kind, a.lang AS old_language, b.lang AS new_language, a.line AS old_line, b.line AS new_line,
 a.path = b.path AND a.lang IS DISTINCT FROM b.lang AS language_changed, coalesce(a.content <> b.content, false) AS content_changed, false AS mermaid
FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.lang IS DISTINCT FROM b.lang OR a.content <> b.content"""
_add("diff_code", lambda s, d: D.code_changes(*_two(s, d)), _CODE.replace("a.path = b.path AND a.lang IS", "coalesce(a.path = b.path, false) AND a.lang IS"), True)
_TABLES = """, a AS (SELECT path, line, a AS h, len(a) - len(replace(a, ',', '')) + 1 AS c, CAST(b AS INTEGER) AS n FROM md_lines WHERE tag = 'table'),
b AS (SELECT path, line, a AS h, len(a) - len(replace(a, ',', '')) + 1 AS c, CAST(b AS INTEGER) AS n FROM md_lines2 WHERE tag = 'table')
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS kind, a.line AS old_line, b.line AS new_line,
 a.c AS old_columns, b.c AS new_columns, a.n AS old_rows, b.n AS new_rows, coalesce(a.h <> b.h, false) AS headers_changed
FROM a FULL JOIN b ON a.path = b.path AND a.c = b.c WHERE a.path IS NULL OR b.path IS NULL OR a.h <> b.h OR a.n <> b.n"""
_add("diff_tables", lambda s, d: D.table_changes(*_two(s, d)), _TABLES, True)
_BODIES = """, bodies AS (SELECT path, own AS line, string_agg(concat_ws('|', tag, a, b), chr(10) ORDER BY line) FILTER (tag <> 'head') AS body FROM (SELECT *, max(CASE WHEN tag = 'head' THEN line END) OVER (PARTITION BY path ORDER BY line) AS own FROM md_lines) WHERE own IS NOT NULL GROUP BY 1, 2),
bodies2 AS (SELECT path, own AS line, string_agg(concat_ws('|', tag, a, b), chr(10) ORDER BY line) FILTER (tag <> 'head') AS body FROM (SELECT *, max(CASE WHEN tag = 'head' THEN line END) OVER (PARTITION BY path ORDER BY line) AS own FROM md_lines2) WHERE own IS NOT NULL GROUP BY 1, 2)
SELECT h.path, CASE WHEN y.path IS NULL THEN 'removed' ELSE 'changed' END AS kind, h.slug AS old_slug, CASE WHEN y.path IS NOT NULL THEN h.slug END AS new_slug, h.line AS old_line, y.line AS new_line,
 CASE WHEN y.path IS NOT NULL THEN 'slug' END AS matched_by, CAST(NULL AS BOOLEAN) AS heuristic, y.path IS NOT NULL AS body_changed
FROM md_headings h JOIN bodies x ON x.path = h.path AND x.line = h.line LEFT JOIN bodies2 y ON y.path = h.path AND y.line = h.line WHERE y.path IS NULL OR x.body <> y.body"""
_add("diff_bodies", lambda s, d: D.heading_changes(*_two(s, d, ("content",))), _BODIES, True)
_add(
    "diff_frontmatter_keys",
    lambda s, d: D.frontmatter_changes(*_two(s, d)),
    """ SELECT path, 'changed' AS kind, 'owner' AS key, concat('"o', i % 4, '"') AS old, concat('"o', (i + 2) % 4, '"') AS new FROM md_docs2 WHERE i % 5 <> 0 AND i % 7 <> 0 AND i % 8 = 3""",
    True,
)


def _status(s, d):
    before, after = _two(s, d)
    changes = D.table_changes(before, after)
    new_name = F.when(F.col("doc_id") % 13 == 5, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    renames = W.markdown(table(s, d, "documents"), 2).select(F.col("path").alias("old_path"), new_name.alias("path"))
    moved = after.select(F.col("path").alias("old_path")).join(renames, "old_path").select("path")
    return D.file_status(before.select("path"), moved, changes, renames)


_add(
    "diff_status",
    _status,
    """ SELECT CASE WHEN i % 17 <> 3 AND i % 13 = 5 THEN concat('moved/', path) ELSE path END AS path, path AS old_path,
 CASE WHEN i % 17 = 3 THEN 'removed' WHEN i % 13 = 5 THEN 'renamed' WHEN i % 7 = 2 AND (i % 3 < 2 OR i % 2 = 0) THEN 'modified' ELSE 'unchanged' END AS status FROM md_docs""",
)


def _totals(s, d):
    before, after = _two(s, d)
    return D.totals({"code": D.code_changes(before, after), "links": D.link_changes(before, after), "tables": D.table_changes(before, after)})


QUERIES["diff_totals"] = _totals
ORACLE_SQL["diff_totals"] = "\nUNION ALL\n".join(f"SELECT '{facet}' AS facet, count(*) AS changes, count(DISTINCT path) AS files FROM ({ORACLE_SQL[name]})" for facet, name in (("code", "diff_code"), ("links", "diff_links"), ("tables", "diff_tables")))


# Sections, outline and listings.
def _content(s, d):
    return W.parsed(table(s, d, "documents"), keep=("content",))


_add(
    "md_outline_tree",
    lambda s, d: E.outline_tree(W.parsed(table(s, d, "documents"))).withColumn("parents", F.array_join("parents", "/")),
    """ SELECT path, line, depth, text, slug, CASE WHEN depth = 2 THEN first_value(CASE WHEN depth = 1 THEN slug END) OVER w END AS parent, CASE WHEN depth = 2 THEN coalesce(first_value(CASE WHEN depth = 1 THEN text END) OVER w, '') ELSE '' END AS parents,
 CAST(CASE WHEN depth = 2 THEN count(*) FILTER (depth = 2) OVER w - 1 ELSE 0 END AS INTEGER) AS ordinal, CAST(CASE WHEN depth = 1 THEN n_lines ELSE coalesce(lead(line) OVER w - 1, n_lines) END AS INTEGER) AS last_line
FROM md_headings WINDOW w AS (PARTITION BY path ORDER BY line)""",
)
def _section(s, d):
    # a last section reaches to the document's end; only the others' text is known to the SQL
    found = E.find_section(_content(s, d), "PART 0", include_heading=False)
    return found.withColumn("content", F.when(F.col("end_line") == F.col("start_line") + 1, F.col("content")))


_add(
    "md_find_section",
    _section,
    """ SELECT path, slug, depth, CAST(line + 1 AS INTEGER) AS start_line, CAST(coalesce(nxt - 1, n_lines) AS INTEGER) AS end_line, CASE WHEN nxt IS NOT NULL THEN concat('some words for ', doc_id, chr(10)) END AS content
FROM (SELECT *, lead(line) OVER (PARTITION BY path ORDER BY line) AS nxt FROM md_headings) WHERE slug = 'part-0'""",
)


def _files(s, d):
    pics = s.range(4).select(F.concat(F.lit("img/pic-"), F.col("id").cast("string"), F.lit(".png")).alias("path"))
    return W.markdown(table(s, d, "documents")).select("path").unionByName(pics)


_LISTED = """SELECT path, line, text, target, CASE WHEN image THEN 'image' WHEN external THEN 'external' ELSE 'internal' END AS type,
 CASE WHEN NOT external THEN CASE WHEN image THEN resolved IN ('img/pic-0.png', 'img/pic-1.png', 'img/pic-2.png', 'img/pic-3.png') ELSE resolved IN (SELECT path FROM md_docs) END END AS exists,
 concat(CASE WHEN image THEN '!' ELSE '' END, '[', text, '](', target, ')') AS context FROM md_links"""
_add("md_link_listing", lambda s, d: E.link_listing(_content(s, d), _files(s, d)), f" {_LISTED}")
_add("md_broken_links", lambda s, d: E.link_listing(_content(s, d), _files(s, d), ("internal", "image"), broken_only=True), f" SELECT * FROM ({_LISTED}) WHERE NOT exists")
_add("md_references", lambda s, d: E.references(_content(s, d), _files(s, d), external=True), f" SELECT * FROM ({_LISTED}) WHERE type <> 'image'")
_add("md_first_table", lambda s, d: E.table_at(W.parsed(table(s, d, "documents")), 1).select("path", "line", "n_columns", "n_rows"), " SELECT path, line, 2 AS n_columns, 1 AS n_rows FROM md_lines WHERE tag = 'table'")
_add(
    "md_frontmatter_value",
    lambda s, d: Q.frontmatter_value(W.parsed(table(s, d, "documents")), "tags.1"),
    " SELECT path, CASE WHEN i % 3 = 0 THEN 'ok' ELSE 'absent' END AS state, CASE WHEN i % 3 = 0 THEN concat('b', i % 6) END AS value FROM md_docs",
)


# Snapshots, edit plans, sinks: whole texts of documents as files.
def _snapshots(s, d):
    docs = table(s, d, "documents").where("doc_id is not null")
    name = F.col("doc_id").cast("string")
    before = docs.select(F.concat(F.lit("f"), name).alias("path"), F.col("text").alias("content"))
    path = F.concat(F.when(F.col("doc_id") % 13 == 0, "g").otherwise("f"), name)
    return before, docs.select(path.alias("path"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content"))


QUERIES["file_changes"] = lambda s, d: files.changes_between(*_snapshots(s, d))
ORACLE_SQL["file_changes"] = """WITH b AS (SELECT concat('f', doc_id) AS path, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
a AS (SELECT concat(CASE WHEN doc_id % 13 = 0 THEN 'g' ELSE 'f' END, doc_id) AS path, coalesce(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END, '') AS t FROM documents WHERE doc_id IS NOT NULL),
gone AS (SELECT path, t, row_number() OVER (PARTITION BY t ORDER BY path) AS n FROM b WHERE path NOT IN (SELECT path FROM a)),
come AS (SELECT path, t, row_number() OVER (PARTITION BY t ORDER BY path) AS n FROM a WHERE path NOT IN (SELECT path FROM b))
SELECT path, path AS old_path, 'M' AS status FROM a JOIN b USING (path) WHERE a.t <> b.t
UNION ALL SELECT coalesce(come.path, gone.path), gone.path, CASE WHEN gone.path IS NULL THEN 'A' WHEN come.path IS NULL THEN 'D' ELSE 'R' END FROM gone FULL JOIN come ON gone.t = come.t AND gone.n = come.n"""


def _planned(s, d):
    docs = table(s, d, "documents").where("doc_id is not null and text is not null")
    i, name = F.col("doc_id"), F.concat(F.lit("w/"), F.col("doc_id").cast("string"))
    snapshots = docs.where(i % 10 != 7).select(name.alias("file"), F.col("text").alias("content"))
    wrong = F.when(i % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.substring("text", 1, 5))
    one = docs.select(F.when(i % 9 == 0, F.concat(F.lit("a/../../"), name)).otherwise(name).alias("file"), F.lit(0).alias("start"), F.lit(5).alias("end"), wrong.alias("expected"), F.lit("").alias("value"), F.lit("r1").alias("rule"))
    start = F.when(i % 4 == 0, 3).otherwise(5)
    two = docs.select(name.alias("file"), start.alias("start"), F.lit(9).alias("end"), F.substring("text", start + 1, F.lit(9) - start).alias("expected"), F.lit("").alias("value"), F.lit("r0").alias("rule"))
    return one.unionByName(two), snapshots


QUERIES["edit_conflicts"] = lambda s, d: X.conflicts(*_planned(s, d)).withColumn("rules", F.array_join("rules", ","))
ORACLE_SQL["edit_conflicts"] = """WITH e AS (SELECT doc_id AS i, CASE WHEN doc_id % 9 = 0 THEN concat('a/../../w/', doc_id) ELSE concat('w/', doc_id) END AS one, concat('w/', doc_id) AS two, CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 5 END AS start FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT one AS file, CASE WHEN i % 9 = 0 THEN 'outside-workspace' WHEN i % 10 = 7 THEN 'stale-input' ELSE 'expectation-mismatch' END AS kind, 0 AS start, 5 AS "end", 'r1' AS rules FROM e WHERE i % 9 = 0 OR i % 10 = 7 OR i % 6 = 0
UNION ALL SELECT two, 'stale-input', start, 9, 'r0' FROM e WHERE i % 10 = 7
UNION ALL SELECT two, 'overlap', start, 9, 'r0,r1' FROM e WHERE i % 9 <> 0 AND i % 10 <> 7 AND i % 6 <> 0 AND i % 4 = 0"""


def _log(s, d):
    listed = E.link_listing(_content(s, d), _files(s, d), broken_only=True)
    logs = sinks.sarif(listed.select(F.col("path").alias("file"), "line", F.concat(F.lit("broken-"), "type").alias("checker"), F.concat(F.lit("no file "), "target").alias("message")), {"broken-internal": "error"})
    first = lambda path: F.get_json_object("value", f"$.runs[0].results[0].{path}")
    return logs.select("file", F.json_array_length(F.get_json_object("value", "$.runs[0].results")).alias("results"), first("level").alias("level"), first("message.text").alias("message"), first("locations[0].physicalLocation.region.startLine").cast("int").alias("line"))


_add(
    "findings_log",
    _log,
    f""", f AS (SELECT * FROM ({_LISTED}) WHERE NOT exists)
SELECT path AS file, CAST(count(*) AS INTEGER) AS results, arg_min(CASE type WHEN 'internal' THEN 'error' ELSE 'warning' END, line) AS level, concat('no file ', arg_min(target, line)) AS message, min(line) AS line FROM f GROUP BY path""",
)
QUERIES["json_rows"] = lambda s, d: sinks.enveloped(table(s, d, "supplier").select("s_suppkey", "s_name"), "suppliers")
ORACLE_SQL["json_rows"] = f"""SELECT concat('{{"schemaVersion":"1.0","tool":{{"name":"{sinks.TOOL}","version":"{sinks.__version__}"}},"command":"suppliers","ok":true,"exitCode":0,"schema":null,"data":{{"s_suppkey":', s_suppkey, ',"s_name":"', s_name, '"}}}}') AS value FROM supplier"""
_add(
    "link_fragments",
    lambda s, d: E.rows_of(W.parsed(table(s, d, "documents")), "links").select("path", "line", fn.replace_fragment(F.col("target"), F.lit("a b")).alias("target")),
    " SELECT path, line, regexp_replace(target, '#.*$', '#a b') AS target FROM md_links",
)

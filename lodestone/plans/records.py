"""Queries of comparisons, findings, archive, layout, pages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone import streaming
from lodestone.operators import archive as A
from lodestone.operators import compare as C
from lodestone.operators import extract as E
from lodestone.operators import graph as G
from lodestone.operators import layout as L
from lodestone.sources import USAGE_EVENTS_SQL, table
from lodestone.sources import workspace as W

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BOTH = f"{W.oracle_lines(0)},{W.oracle_lines(1)}"

_SMALL = "abcdefghijklmnopqrstuvwxyz"


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _two(s, d, column):
    docs = table(s, d, "documents")
    return E.rows_of(W.parsed(docs, 0), column), E.rows_of(W.parsed(docs, 1), column)


def _files(s, d):
    docs = table(s, d, "documents")
    return W.markdown(docs, 0), W.markdown(docs, 1)


# Diff of two revisions: revision 1 lacks every 17th document, renames some first parts, flips some tasks, changes some owners.
_add(
    "diff_headings",
    lambda s, d: C.heading_changes(*_two(s, d, "headings")),
    f"""WITH {BOTH}, a AS (SELECT path, slug, text, depth, row_number() OVER (PARTITION BY path ORDER BY line) AS place FROM md_headings),
b AS (SELECT path, slug, text, depth, row_number() OVER (PARTITION BY path ORDER BY line) AS place FROM md_headings1),
s AS (SELECT a.path, a.slug AS old_slug, b.slug AS new_slug, a.place AS p, b.place AS q, a.text AS t, b.text AS u FROM a JOIN b ON a.path = b.path AND a.slug = b.slug),
a1 AS (SELECT *, row_number() OVER (PARTITION BY path, text ORDER BY place) AS n FROM a WHERE (path, slug) NOT IN (SELECT path, old_slug FROM s)),
b1 AS (SELECT *, row_number() OVER (PARTITION BY path, text ORDER BY place) AS n FROM b WHERE (path, slug) NOT IN (SELECT path, new_slug FROM s)),
s1 AS (SELECT a1.path, a1.slug AS old_slug, b1.slug AS new_slug, a1.place AS p, b1.place AS q, a1.text AS t, b1.text AS u FROM a1 JOIN b1 ON a1.path = b1.path AND a1.text = b1.text AND a1.n = b1.n),
a2 AS (SELECT * FROM a1 WHERE (path, slug) NOT IN (SELECT path, old_slug FROM s1)), b2 AS (SELECT * FROM b1 WHERE (path, slug) NOT IN (SELECT path, new_slug FROM s1)),
s2 AS (SELECT coalesce(a2.path, b2.path) AS path, a2.slug AS old_slug, b2.slug AS new_slug, a2.place AS p, b2.place AS q, a2.text AS t, b2.text AS u FROM a2 FULL JOIN b2 ON a2.path = b2.path AND a2.place = b2.place),
every AS (SELECT * FROM s UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)
SELECT path, CASE WHEN old_slug IS NULL THEN 'added' WHEN new_slug IS NULL THEN 'removed' WHEN t <> u THEN 'renamed' WHEN p <> q THEN 'moved' ELSE 'same' END AS kind, old_slug, new_slug FROM every WHERE kind <> 'same'""",
)
_add(
    "diff_tasks",
    lambda s, d: C.task_changes(*_two(s, d, "tasks")),
    f"""WITH {BOTH}, a AS (SELECT path, b AS text, a = 'true' AS c FROM md_lines WHERE tag = 'task'), b AS (SELECT path, b AS text, a = 'true' AS c FROM md_lines1 WHERE tag = 'task')
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS kind, coalesce(a.text, b.text) AS text, a.c AS old_checked, b.c AS new_checked FROM a FULL JOIN b ON a.path = b.path AND a.text = b.text WHERE a.c IS DISTINCT FROM b.c""",
)
_add(
    "diff_frontmatter",
    lambda s, d: (lambda r: C.value_changes(r(0), r(1), ["path", "key"], "value"))(lambda k: W.parsed(table(s, d, "documents"), k).select("path", F.explode(F.from_json("frontmatter", "map<string,string>")).alias("key", "value")).where("key <> 'n_chars'")),
    f"""WITH {BOTH}, v AS (SELECT i, path, path IN (SELECT path FROM md_docs1) AS kept FROM md_docs),
k AS (SELECT path, kept, 'title' AS key, concat('Title ', i % 50) AS o, concat('Title ', i % 50) AS n FROM v
 UNION ALL SELECT v.path, kept, 'lang', lang, lang FROM v JOIN md_docs USING (i)
 UNION ALL SELECT path, kept, 'owner', CASE WHEN i % 7 <> 0 THEN concat('o', i % 4) END, CASE WHEN i % 7 <> 0 THEN concat('o', (i + CASE WHEN i % 8 = 3 THEN 1 ELSE 0 END) % 4) END FROM v WHERE i % 5 <> 0
 UNION ALL SELECT path, kept, 'tags', concat('["a","b', i % 6, '"]'), concat('["a","b', i % 6, '"]') FROM v WHERE i % 3 = 0)
SELECT path, key, CASE WHEN kept THEN 'changed' ELSE 'removed' END AS kind, o AS old, CASE WHEN kept THEN n END AS new FROM k WHERE NOT kept OR o IS DISTINCT FROM n""",
)
_CHANGED = "(i % 4 > 0 AND i % 6 = 5) OR (i % 3 > 0 AND i % 10 = 4) OR (i % 5 <> 0 AND i % 7 <> 0 AND i % 8 = 3)"
_add("diff_files", lambda s, d: C.file_changes(*_files(s, d)), f"WITH {BOTH} SELECT path, CASE WHEN i % 17 = 3 THEN 'removed' WHEN {_CHANGED} THEN 'modified' ELSE 'unchanged' END AS status FROM md_docs")
_add(
    "diff_summary",
    lambda s, d: C.file_changes(*_files(s, d)).groupBy("status").agg(F.count("*").alias("files")),
    f"WITH {BOTH} SELECT CASE WHEN i % 17 = 3 THEN 'removed' WHEN {_CHANGED} THEN 'modified' ELSE 'unchanged' END AS status, count(*) AS files FROM md_docs GROUP BY 1",
)
_TREE = "SELECT doc_id, concat('f', doc_id) AS path, sha2(text, 256) AS digest, CASE WHEN doc_id % 9 = 0 THEN '755' ELSE '644' END AS mode, source FROM documents"


def _tree(s, d, shift=0):
    docs = table(s, d, "documents")
    mode = F.when((F.col("doc_id") + shift) % 9 == 0, "755").otherwise("644")
    return docs.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("digest"), mode.alias("mode"), "source")


_add(
    "tree_compare",
    lambda s, d: C.tree_compare(_tree(s, d).where("doc_id % 5 <> 0"), _tree(s, d, 1).where("doc_id % 10 <> 1")).where("state <> 'ok'"),
    "SELECT concat('f', doc_id) AS path, CASE WHEN doc_id % 5 = 0 THEN 'unmanaged' WHEN doc_id % 10 = 1 THEN 'missing' ELSE 'changed' END AS state FROM documents WHERE doc_id % 5 = 0 OR doc_id % 10 = 1 OR (doc_id % 9 = 0) <> ((doc_id + 1) % 9 = 0)",
)
_add(
    "tree_digest",
    lambda s, d: C.tree_digest(_tree(s, d), ["source"]),
    f"WITH t AS ({_TREE.replace('sha2(text, 256)', 'sha256(text)')}) SELECT source, sha256(string_agg(concat_ws(' ', path, mode, digest), chr(10) ORDER BY path)) AS tree FROM t GROUP BY source",
)
_add(
    "overlay_merge",
    lambda s, d: C.overlay(table(s, d, "documents").select("doc_id", "lang", "n_chars"), table(s, d, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit("top").alias("lang"), (-F.col("n_chars")).alias("n_chars")), ["doc_id"], ["lang", "n_chars"]),
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'top' ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN -n_chars ELSE n_chars END AS n_chars FROM documents",
)
_add(
    "nearest_wins",
    lambda s, d: C.nearest(table(s, d, "part").select(F.col("p_brand").alias("name"), "p_partkey", F.struct("p_size", "p_partkey").alias("distance")), "name", "distance").select("name", "p_partkey", "shadows"),
    "SELECT p_brand AS name, arg_min(p_partkey, (p_size, p_partkey)) AS p_partkey, count(*) - 1 AS shadows FROM part GROUP BY 1",
)
_add(
    "case_collisions",
    # whole texts stand for paths, each beside itself in capitals if its length is even
    lambda s, d: C.case_collisions(table(s, d, "documents").select(F.explode(F.array("text", F.when(F.col("n_chars") % 2 == 0, F.translate("text", _SMALL, _SMALL.upper())).otherwise(F.col("text")))).alias("path")), "path"),
    f"""SELECT lower(path) AS folded, count(DISTINCT path) AS paths
FROM (SELECT unnest([text, CASE WHEN n_chars % 2 = 0 THEN translate(text, '{_SMALL}', '{_SMALL.upper()}') ELSE text END]) AS path FROM documents) GROUP BY 1 HAVING count(DISTINCT path) > 1""",
)


# Findings: broken targets and missing anchors of the workspace.
def _findings(s, d):
    p = W.parsed(table(s, d, "documents")).select("path", "links", "headings")
    links, paths = E.resolved(E.rows_of(p, "links")), p.select("path")
    broken = G.broken(links, paths).select(F.col("source").alias("file"), "line", F.lit("graph/broken").alias("checker"), F.concat(F.lit("no document "), "resolved").alias("message"))
    ref = G.broken(links, paths).select(F.col("source").alias("file"), "line", F.lit("ref/link").alias("checker"), F.concat(F.lit("no target "), "resolved").alias("message"))
    anchors = G.missing_anchors(links, p.select("path", F.explode_outer("headings.slug").alias("slug"))).select(F.col("path").alias("file"), "line", F.lit("ref/anchor").alias("checker"), F.concat(F.lit("no heading for "), "target").alias("message"))
    every = C.without_superseded(broken.unionByName(ref).unionByName(anchors), "graph/broken", "ref/link")
    return every.withColumn("ord", F.col("line").cast("long"))


_FINDINGS = f"""WITH {W.oracle_lines()}, f AS (
  SELECT path AS file, line, 'graph/broken' AS checker, concat('no document ', resolved) AS message FROM md_links WHERE NOT image AND NOT external AND resolved NOT IN (SELECT path FROM md_docs)
  UNION ALL SELECT path, line, 'ref/anchor', concat('no heading for ', target) FROM md_links l WHERE fragment IS NOT NULL AND resolved IN (SELECT path FROM md_docs) AND NOT EXISTS (SELECT 1 FROM md_headings h WHERE h.path = l.resolved AND h.slug = l.fragment))"""
_add("audit_findings", lambda s, d: _findings(s, d).select("file", "line", "checker", "message"), f"{_FINDINGS} SELECT file, line, checker, message FROM f")
_add("audit_by_check", lambda s, d: _findings(s, d).groupBy(F.substring_index("checker", "/", 1).alias("category")).agg(F.count("*").alias("findings"), F.count_distinct("file").alias("files")), f"{_FINDINGS} SELECT split_part(checker, '/', 1) AS category, count(*) AS findings, count(DISTINCT file) AS files FROM f GROUP BY 1")


def _order_findings(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_returnflag").alias("checker"), F.col("l_linestatus").alias("file"), (F.col("l_partkey") % 50).cast("string").alias("message"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


_OF = "SELECT l_orderkey AS line, l_returnflag AS checker, l_linestatus AS file, CAST(l_partkey % 50 AS VARCHAR) AS message, l_orderkey * 10 + l_linenumber AS ord FROM lineitem"
_add("audit_baseline_build", lambda s, d: C.build_baseline(_order_findings(s, d)), f"SELECT checker, file, message, count(*) AS count FROM ({_OF}) GROUP BY ALL")
_add(
    "audit_baseline_match",
    lambda s, d: C.beyond_baseline(_order_findings(s, d), C.build_baseline(_order_findings(s, d).where("line % 4 <> 0"))),
    f"WITH f AS ({_OF}), b AS (SELECT checker, file, message, count(*) AS c FROM f WHERE line % 4 <> 0 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY checker, file, message ORDER BY ord) AS k FROM f) SELECT line, n.checker, n.file, n.message, ord FROM n LEFT JOIN b USING (checker, file, message) WHERE k > coalesce(c, 0)",
)
_EDIT = "SELECT source AS file, n_chars AS start, n_chars + doc_id % 40 AS \"end\", concat('r', doc_id) AS rule FROM documents"
_add(
    "edit_overlaps",
    lambda s, d: C.overlaps(table(s, d, "documents").select(F.col("source").alias("file"), F.col("n_chars").alias("start"), (F.col("n_chars") + F.col("doc_id") % 40).alias("end"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("rule"))),
    f"WITH e AS ({_EDIT}) SELECT file, start, \"end\", rule FROM (SELECT *, lag(\"end\") OVER (PARTITION BY file ORDER BY start, \"end\", rule) AS p FROM e) WHERE p > start",
)


def _edited(s, d):
    """Two edits of each text, also of one that is too short for them or null; an id that comes twice has them once."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("content"))
    two = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end"), F.lit("<x>").alias("value")), F.struct(F.lit(7).alias("start"), F.lit(7).alias("end"), F.lit("+").alias("value")))
    return C.apply_edits(docs, docs.select("file").distinct().select("file", F.explode(two).alias("e")).select("file", "e.*"))


_add(
    "edit_apply",
    lambda s, d: _edited(s, d).select("file", F.sha2("content", 256).alias("digest")),
    "SELECT doc_id AS file, sha256(concat(substr(text, 1, 2), '<x>', substr(text, 5, 3), '+', substr(text, 8))) AS digest FROM documents",
)


# Archive: documents as artifacts, providers by source, paths by a third of the ids.
def _artifacts(s, d):
    docs = table(s, d, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), (F.col("source")).alias("provider"), F.col("lang").alias("class"), F.concat(F.lit("p"), (F.col("doc_id") % 300).cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").cast("long").alias("size"), F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("last_seen"),
    )


_ART = "SELECT doc_id AS id, source AS provider, lang AS class, concat('p', doc_id % 300) AS path, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size, concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')) AS last_seen FROM documents"
_add(
    "archive_dispositions",
    lambda s, d: A.dispositions(_artifacts(s, d).where("id % 4 <> 0").withColumn("ord", F.col("id")), _artifacts(s, d).where("id % 4 = 0")).select("id", "disposition"),
    f"WITH a AS ({_ART}), h AS (SELECT DISTINCT sha256 FROM a WHERE id % 4 = 0) SELECT id, CASE WHEN sha256 IN (SELECT sha256 FROM h) THEN 'duplicate' WHEN row_number() OVER (PARTITION BY sha256 ORDER BY id) > 1 THEN 'pending' ELSE 'stored' END AS disposition FROM a WHERE id % 4 <> 0",
)
_add("archive_latest", lambda s, d: A.latest(_artifacts(s, d)).select("provider", "path", "id", "sha256", "versions"), f"WITH a AS ({_ART}) SELECT provider, path, max(id) AS id, arg_max(sha256, id) AS sha256, count(*) AS versions FROM a GROUP BY 1, 2")
_add(
    "archive_list",
    lambda s, d: A.listing(_artifacts(s, d), ["src0", "src1", "src2"], ["en"], "2024-01-10").select("provider", "path", "id", "last_seen"),
    f"WITH a AS ({_ART}), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY provider, path ORDER BY id DESC) = 1) SELECT provider, path, id, last_seen FROM l WHERE provider IN ('src0', 'src1', 'src2') AND class = 'en' AND last_seen >= '2024-01-10'",
)


def _blobs(s, d):
    return _artifacts(s, d).groupBy("sha256").agg(F.min("id").alias("first"), F.max("size").alias("size")).select("sha256", "size", (F.col("first") % 7).alias("segment_id"), F.col("first").alias("offset"))


_BLOB = ", b AS (SELECT sha256, max(size) AS size, min(id) % 7 AS segment_id, min(id) AS \"offset\" FROM a GROUP BY 1)"
_add(
    "archive_status",
    lambda s, d: A.status(_artifacts(s, d), _blobs(s, d)),
    f"WITH a AS ({_ART}){_BLOB} SELECT provider, class, count(*) AS artifacts, count(DISTINCT path) AS paths, count(DISTINCT sha256) AS contents, CAST(sum(b.size) AS BIGINT) AS bytes FROM a JOIN b USING (sha256) GROUP BY 1, 2",
)
_add(
    "archive_resolve",
    lambda s, d: A.resolve(_artifacts(s, d), _blobs(s, d), "a"),
    f"WITH a AS ({_ART}){_BLOB} SELECT sha256, arg_max(path, id) AS path, max(id) AS id, any_value(segment_id) AS segment_id, any_value(\"offset\") AS \"offset\", any_value(b.size) AS size FROM a JOIN b USING (sha256) WHERE starts_with(sha256, 'a') GROUP BY 1",
)
_add(
    "archive_verify",
    lambda s, d: A.verify(_artifacts(s, d), _blobs(s, d).where("offset % 10 <> 1"), table(s, d, "documents").where("doc_id % 13 <> 5").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min_by(F.when(F.col("doc_id") % 11 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "doc_id").alias("content"))),
    f"""WITH a AS ({_ART}){_BLOB}, t AS (SELECT sha256(text) AS sha256, min(doc_id) AS m FROM documents WHERE doc_id % 13 <> 5 GROUP BY 1)
SELECT DISTINCT a.sha256, CASE WHEN b.sha256 IS NULL THEN 'no blob' WHEN m IS NULL THEN 'no content' WHEN m % 11 = 2 THEN 'damaged' END AS finding FROM a LEFT JOIN (SELECT * FROM b WHERE "offset" % 10 <> 1) b USING (sha256) LEFT JOIN t USING (sha256) WHERE finding IS NOT NULL""",
)
_add(
    "archive_upsert",
    lambda s, d: A.upsert(_artifacts(s, d).where("id % 3 = 0").groupBy("sha256").agg(F.min("last_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")), _artifacts(s, d).where("id % 3 <> 0").select("sha256", F.col("last_seen").alias("seen")), ["sha256"]),
    f"WITH a AS ({_ART}), o AS (SELECT sha256, min(last_seen) AS f, max(last_seen) AS l FROM a WHERE id % 3 = 0 GROUP BY 1), n AS (SELECT sha256, max(last_seen) AS x FROM a WHERE id % 3 <> 0 GROUP BY 1) SELECT sha256, coalesce(f, x) AS first_seen, greatest(l, x) AS last_seen FROM o FULL JOIN n USING (sha256)",
)
_add(
    "archive_freshness",
    lambda s, d: A.freshness(*[table(s, d, "documents").where(w).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.expr(m).alias("mtime")) for w, m in (("doc_id % 5 <> 1", "doc_id % 8 = 0"), ("doc_id % 6 <> 1", "false"))]),
    "SELECT concat('p', doc_id) AS path, CASE WHEN doc_id % 6 = 1 THEN 'new' WHEN doc_id % 5 = 1 THEN 'gone' WHEN doc_id % 8 = 0 THEN 'stale' ELSE 'current' END AS state FROM documents WHERE doc_id % 5 <> 1 OR doc_id % 6 <> 1",
)
_add("archive_seals", lambda s, d: A.seals(_artifacts(s, d).select(F.col("provider").alias("shard"), F.col("id").alias("ord"), "size"), 20_000).groupBy("shard").agg(F.count_distinct("segment").alias("segments"), F.count("*").alias("blobs")),
    f"""WITH RECURSIVE a AS ({_ART}), n AS (SELECT provider AS shard, size, row_number() OVER (PARTITION BY provider ORDER BY id) AS k FROM a),
fold(shard, k, segment, held, sealed) AS (SELECT shard, 1, 0, CASE WHEN size >= 20000 THEN 0 ELSE size END, size >= 20000 FROM n WHERE k = 1
  UNION ALL SELECT n.shard, n.k, segment + CASE WHEN sealed THEN 1 ELSE 0 END, CASE WHEN held + size >= 20000 THEN 0 ELSE held + size END, held + size >= 20000 FROM fold JOIN n ON n.shard = fold.shard AND n.k = fold.k + 1)
SELECT shard, count(DISTINCT segment) AS segments, count(*) AS blobs FROM fold GROUP BY shard""",
)

# Layout: line items as runs on pages.
_RUN = "SELECT l_suppkey AS doc, CAST(l_orderkey % 6 AS BIGINT) AS page, l_orderkey * 8 + l_linenumber AS index, concat('w', l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'x' ELSE 'yy' END) AS text, CAST(l_partkey % 97 AS DOUBLE) * 6 AS x, CAST(l_orderkey % 31 AS DOUBLE) * 3 AS y, CAST(10 + l_linenumber AS DOUBLE) AS width, CAST(8 + 2 * (l_linenumber % 4) AS DOUBLE) AS size FROM lineitem"


def _runs(s, d):
    li = table(s, d, "lineitem")
    c = F.col
    return li.select(
        c("l_suppkey").alias("doc"), (c("l_orderkey") % 6).alias("page"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("index"), F.concat(F.lit("w"), c("l_linenumber").cast("string"), F.when(c("l_partkey") % 3 == 0, "x").otherwise("yy")).alias("text"),
        ((c("l_partkey") % 97).cast("double") * 6).alias("x"), ((c("l_orderkey") % 31).cast("double") * 3).alias("y"), (c("l_linenumber") + 10).cast("double").alias("width"), (8 + 2 * (c("l_linenumber") % 4)).cast("double").alias("size"),
    )


_LINES = f"WITH r AS ({_RUN}), g AS (SELECT *, lag(y) OVER w AS py, lag(size) OVER w AS ps FROM r WINDOW w AS (PARTITION BY doc, page ORDER BY y DESC, x, index)), l AS (SELECT *, CAST(sum(CASE WHEN abs(y - py) > 0.35 * greatest(size, ps) THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY y DESC, x, index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_no FROM g)"
_add("layout_lines", lambda s, d: L.lines(_runs(s, d)).select("doc", "page", "index", "line_no"), f"{_LINES} SELECT doc, page, index, line_no FROM l")
_FRAG = f"{_LINES}, h AS (SELECT *, max(x + width) OVER (PARTITION BY doc, page, line_no ORDER BY x, index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rx FROM l), fr AS (SELECT *, CAST(sum(CASE WHEN x - rx > greatest(3, size) THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page, line_no ORDER BY x, index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fragment FROM h)"
_add("layout_fragments", lambda s, d: L.fragments(L.lines(_runs(s, d))).select("doc", "page", "index", "fragment"), f"{_FRAG} SELECT doc, page, index, fragment FROM fr")
_add(
    "layout_tabular",
    lambda s, d: L.tabular(L.fragments(L.lines(_runs(s, d))).groupBy("doc", "page", "line_no").agg(F.count_distinct("fragment").alias("n_fragments"))),
    f"{_FRAG}, n AS (SELECT doc, page, line_no, count(DISTINCT fragment) AS n_fragments FROM fr GROUP BY 1, 2, 3), t AS (SELECT *, min(n_fragments) OVER w AS lo, max(n_fragments) OVER w AS hi, count(*) OVER w AS c FROM n WINDOW w AS (PARTITION BY doc, page ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT doc, page, line_no, n_fragments FROM t WHERE c = 3 AND lo = hi AND lo >= 2",
)
_add("layout_running_text", lambda s, d: L.running_text(_runs(s, d)), f"WITH r AS ({_RUN}), p AS (SELECT doc, count(DISTINCT page) AS n FROM r GROUP BY 1 HAVING count(DISTINCT page) >= 4) SELECT doc, CAST(floor(y / 4) AS BIGINT) AS y_bucket, regexp_replace(text, '\\d+', '#', 'g') AS masked, count(DISTINCT page) AS pages FROM r JOIN p USING (doc) GROUP BY 1, 2, 3, n HAVING count(DISTINCT page) >= 0.4 * n")
_BODY = "b AS (SELECT doc, arg_max(size, (n, size)) AS size FROM (SELECT doc, size, sum(length(text)) AS n FROM r GROUP BY 1, 2) GROUP BY 1)"
_add("layout_body_size", lambda s, d: L.body_size(_runs(s, d)), f"WITH r AS ({_RUN}), {_BODY} SELECT doc, size FROM b")
_add("layout_heading_levels", lambda s, d: L.heading_levels(_runs(s, d)), f"WITH r AS ({_RUN}), {_BODY} SELECT doc, size, least(dense_rank() OVER (PARTITION BY doc ORDER BY size DESC), 6) AS level FROM (SELECT DISTINCT r.doc, r.size FROM r JOIN b ON r.doc = b.doc WHERE r.size > b.size)")
_add("layout_median", lambda s, d: L.upper_median(_runs(s, d), ["doc"], "x"), f"WITH r AS ({_RUN}) SELECT doc, list_sort(list(x))[count(*) // 2 + 1] AS median FROM r GROUP BY 1")
_add(
    "layout_columns",
    lambda s, d: L.in_columns(_runs(s, d), _runs(s, d).select("doc", "page").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("doc", "page", "k", (F.col("k") * 200.0).alias("lo"), (F.col("k") * 200.0 + 200).alias("hi"))).groupBy("doc", "k").agg(F.count("*").alias("runs")),
    f"WITH r AS ({_RUN}), c AS (SELECT doc, page, CAST(k AS INTEGER) AS k FROM (SELECT DISTINCT doc, page FROM r), (SELECT unnest(range(3)) AS k)) SELECT r.doc, k, count(*) AS runs FROM r JOIN c ON r.doc = c.doc AND r.page = c.page AND x >= k * 200 AND x + width <= k * 200 + 200 GROUP BY 1, 2",
)
_add(
    "ocr_confidence",
    lambda s, d: L.ocr_confidence(_runs(s, d).withColumn("conf", F.col("index") % 101)).where("confidence is not null"),
    f"WITH r AS ({_RUN}) SELECT doc, page, round(CAST(sum((index % 101) * length(text)) AS DOUBLE) / sum(length(text)), 1) AS confidence FROM r GROUP BY 1, 2",
)

# Pages and scalars.
_HREF = "'href=\"([^\"]*)\"', 1"
_add("page_hrefs", lambda s, d: table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).withColumn("external", fn.is_external(F.col("href"))), f"SELECT page_id, href, regexp_matches(href, '^([A-Za-z][A-Za-z0-9+.-]+:|//)') AS external FROM (SELECT page_id, unnest(regexp_extract_all(html, {_HREF})) AS href FROM pages)")
_add(
    "page_link_hosts",
    lambda s, d: table(s, d, "pages").withColumn("host", F.parse_url("url", F.lit("HOST"))).where(~fn.host_matches(F.col("host"), ["example.net"])).groupBy("host").agg(F.count("*").alias("pages")),
    "SELECT regexp_extract(url, '://([^/?#:]*)', 1) AS host, count(*) AS pages FROM pages WHERE NOT (host = 'example.net' OR ends_with(host, '.example.net')) GROUP BY 1",
)
_add("text_entropy", lambda s, d: table(s, d, "benchmark").select("item_id", F.round(fn.entropy(F.col("text")), 6).alias("entropy")), "WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c FROM benchmark), n AS (SELECT item_id, c, count(*) AS k FROM c GROUP BY 1, 2), t AS (SELECT item_id, sum(k) AS n FROM n GROUP BY 1) SELECT item_id, round(-sum(k / n * log2(k / n)), 6) AS entropy FROM n JOIN t USING (item_id) GROUP BY 1")
_add("text_estimates", lambda s, d: table(s, d, "documents").select("doc_id", fn.token_estimate(F.octet_length("text")).alias("tokens"), F.sha2(fn.normal_text(F.col("text")), 256).alias("normal")), "SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS tokens, sha256(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS normal FROM documents")

_EV = f"WITH {USAGE_EVENTS_SQL}"
_add("stream_day_buckets", streaming.day_buckets, f"{_EV} SELECT CAST(day AS VARCHAR) AS day, kind, count(*) AS events, CAST(sum(requests) AS BIGINT) AS requests FROM ev GROUP BY 1, 2")
_add("stream_distinct", streaming.distinct_sessions, f"{_EV} SELECT DISTINCT file_id, k FROM ev")
_add("stream_deltas", streaming.running_deltas, f"{_EV} SELECT file_id, CAST(sum(s) AS BIGINT) AS spent, count(*) FILTER (s > 0) AS steps FROM (SELECT file_id, greatest(0, k - coalesce(lag(k) OVER (PARTITION BY file_id ORDER BY ts, seq), 0)) AS s FROM ev) GROUP BY 1")

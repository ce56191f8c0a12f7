"""Queries of log dialects and rules, over lines and trees made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import checks as K
from lodestone.operators import extract as E
from lodestone.sources import USAGE_EVENTS_SQL, logs, table, usage_events
from lodestone.sources import workspace as W

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _lines(s, d, line):
    ev = usage_events(table(s, d, "events"))
    return ev.select(F.col("file_id").cast("string").alias("file"), "seq", F.expr(line).alias("line"))


_RESPONSES = """CASE WHEN k % 10 = 7 THEN '{broken' ELSE to_json(named_struct('type', 'assistant', 'timestamp', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 'message', named_struct('id', concat('r', k % 20), 'model', concat('m', k % 4),
  'usage', named_struct('input_tokens', k, 'output_tokens', k * 2, 'cache_read_input_tokens', k % 13, 'cache_creation_input_tokens', k % 7), 'content', array(named_struct('type', CASE WHEN k % 3 = 0 THEN 'tool_use' ELSE 'text' END, 'name', concat('t', k % 5)))))) END"""
QUERIES["log_responses"] = lambda s, d: logs.events(_lines(s, d, _RESPONSES), "responses").groupBy("kind", "model", "tool", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("input").alias("input"), F.sum("cache_write").alias("cache_write"))
ORACLE_SQL["log_responses"] = f"""WITH {USAGE_EVENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id, k % 20 ORDER BY seq) AS nth FROM ev WHERE k % 10 <> 7)
SELECT 'request' AS kind, concat('m', k % 4) AS model, NULL AS tool, CAST(day AS VARCHAR) AS day, count(*) AS n, CAST(sum(k) AS BIGINT) AS input, CAST(sum(k % 7) AS BIGINT) AS cache_write FROM r WHERE nth = 1 GROUP BY ALL
UNION ALL SELECT 'tool', NULL, concat('t', k % 5), CAST(day AS VARCHAR), count(*), 0, 0 FROM r WHERE k % 3 = 0 GROUP BY ALL"""
QUERIES["log_malformed"] = lambda s, d: logs.malformed(logs.parse(_lines(s, d, _RESPONSES)))
ORACLE_SQL["log_malformed"] = f"WITH {USAGE_EVENTS_SQL} SELECT CAST(file_id AS VARCHAR) AS file, count(*) AS lines, count(*) FILTER (k % 10 = 7) AS malformed FROM ev GROUP BY 1"
_CUMULATIVE = """CASE WHEN k % 6 = 0 THEN to_json(named_struct('type', 'turn_context', 'payload', named_struct('model', concat('m', k % 4)))) ELSE
  to_json(named_struct('type', 'event_msg', 'timestamp', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 'payload', named_struct('info', named_struct('total_token_usage', named_struct('input_tokens', k * 3, 'cached_input_tokens', k, 'output_tokens', k % 50, 'reasoning_output_tokens', 0))))) END"""
QUERIES["log_cumulative"] = lambda s, d: logs.events(_lines(s, d, _CUMULATIVE), "cumulative").groupBy("model").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("input", "output", "cache_read")])
ORACLE_SQL["log_cumulative"] = f"""WITH {USAGE_EVENTS_SQL}, m AS (SELECT *, last_value(CASE WHEN k % 6 = 0 THEN concat('m', k % 4) END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mm FROM ev),
g AS (SELECT mm, k, coalesce(lag(k) OVER w, 0) AS p, coalesce(lag(k % 50) OVER w, 0) AS o FROM m WHERE k % 6 <> 0 WINDOW w AS (PARTITION BY file_id ORDER BY seq)),
d AS (SELECT mm, greatest(0, k * 3 - p * 3) AS di, greatest(0, k - p) AS dc, greatest(0, k % 50 - o) AS d_out FROM g)
SELECT coalesce(mm, '(unrecorded)') AS model, count(*) AS n, CAST(sum(greatest(0, di - dc)) AS BIGINT) AS input, CAST(sum(d_out) AS BIGINT) AS output, CAST(sum(dc) AS BIGINT) AS cache_read FROM d WHERE di + dc + d_out > 0 GROUP BY 1"""
_REPEATED = """to_json(named_struct('id', concat('r', k % 15), 'timestamp', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 'model', concat('m', k % 4), 'tokens', CASE WHEN k % 4 <> 1 THEN named_struct('input', k, 'output', 2 * k, 'cached', k % 13, 'thoughts', k % 5) END,
  'toolCalls', CASE WHEN k % 2 = 0 THEN array(named_struct('name', concat('t', k % 5)), named_struct('name', 'u')) END))"""
QUERIES["log_repeated"] = lambda s, d: logs.events(_lines(s, d, _REPEATED), "repeated").groupBy("kind", "model", "tool").agg(F.count("*").alias("n"), F.sum("input").alias("input"), F.sum("thinking").alias("thinking"))
ORACLE_SQL["log_repeated"] = f"""WITH {USAGE_EVENTS_SQL}, t AS (SELECT * FROM ev WHERE k % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY file_id, k % 15 ORDER BY seq) = 1), c AS (SELECT * FROM ev WHERE k % 2 = 0 QUALIFY row_number() OVER (PARTITION BY file_id, k % 15 ORDER BY seq DESC) = 1)
SELECT 'request' AS kind, concat('m', k % 4) AS model, NULL AS tool, count(*) AS n, CAST(sum(greatest(0, k - k % 13)) AS BIGINT) AS input, CAST(sum(k % 5) AS BIGINT) AS thinking FROM t GROUP BY ALL
UNION ALL SELECT 'tool', NULL, concat('t', k % 5), count(*), 0, 0 FROM c GROUP BY ALL UNION ALL SELECT 'tool', NULL, 'u', count(*), 0, 0 FROM c HAVING count(*) > 0"""

RULES = [{"required": "owner"}, {"prohibited": "tags"}, {"type": "integer", "key": "n_chars"}, {"type": "string", "key": "owner"}, {"allowed": ["en", "de"], "key": "lang"}, {"pattern": "^Title [0-4]", "key": "title"}, {"unique": "title"}]
QUERIES["check_frontmatter"] = lambda s, d: K.frontmatter_rules(W.parsed(table(s, d, "documents")), RULES).select("path", "rule", "message")
ORACLE_SQL["check_frontmatter"] = f"""WITH {W.oracle_lines()} SELECT path, 'required' AS rule, 'owner is missing' AS message FROM md_docs WHERE i % 5 = 0 UNION ALL SELECT path, 'prohibited', 'tags is not allowed' FROM md_docs WHERE i % 3 = 0
UNION ALL SELECT path, 'type', 'owner is no string' FROM md_docs WHERE i % 5 <> 0 AND i % 7 = 0 UNION ALL SELECT path, 'allowed', 'lang has another value' FROM md_docs WHERE lang NOT IN ('en', 'de')
UNION ALL SELECT path, 'pattern', 'title does not match' FROM md_docs WHERE NOT regexp_matches(concat('Title ', i % 50), '^Title [0-4]') UNION ALL SELECT path, 'unique', 'title is not unique' FROM (SELECT path, count(*) OVER (PARTITION BY i % 50) AS n FROM md_docs) WHERE n > 1"""
QUERIES["check_urls"] = lambda s, d: K.url_findings(
    E.rows_of(W.parsed(table(s, d, "documents")), "links"), s.range(9).select(F.concat(F.lit("https://h"), F.col("id").cast("string"), F.lit(".example.com/x")).alias("url"), F.when(F.col("id") % 3 == 1, 404).when(F.col("id") % 3 == 0, 403).otherwise(301).alias("status"), (F.col("id") * 100).alias("checked_ms")), [403], 700, 900
)
ORACLE_SQL["check_urls"] = f"WITH {W.oracle_lines()} SELECT path, line, target, 404 AS status FROM md_links WHERE external AND doc_id % 9 IN (4, 7)"


def _trees(s, d):
    docs = table(s, d, "documents")
    text = "named_struct('type', 'text', 'text', concat('w', doc_id), 'marks', CASE WHEN doc_id % 2 = 0 THEN array(named_struct('type', 'strong')) END)"
    para = f"named_struct('type', 'paragraph', 'content', array({text}))"
    body = f"concat('{{\"type\":\"doc\",\"content\":[', to_json({para}), CASE WHEN doc_id % 3 = 0 THEN ',{{\"type\":\"rule\"}}' ELSE '' END, CASE WHEN doc_id % 10 = 0 THEN ',{{\"type\":\"panel\",\"content\":[{{\"type\":\"table\"}}]}}' WHEN doc_id % 5 = 0 THEN ',{{\"type\":\"panel\",\"content\":[]}}' ELSE '' END, ']}}')"
    return docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.expr(body).alias("tree"))


QUERIES["rich_inventory"] = lambda s, d: K.rich_inventory(K.rich_nodes(_trees(s, d)))
ORACLE_SQL["rich_inventory"] = """SELECT * FROM (SELECT 'node' AS kind, t AS type, CASE t WHEN 'rule' THEN count(*) FILTER (doc_id % 3 = 0) WHEN 'panel' THEN count(*) FILTER (doc_id % 5 = 0) WHEN 'table' THEN count(*) FILTER (doc_id % 10 = 0) ELSE count(*) END AS count, CASE WHEN t IN ('panel', 'table') THEN 'approximate' ELSE 'exact' END AS fidelity
FROM documents, (SELECT unnest(['doc', 'paragraph', 'text', 'rule', 'panel', 'table']) AS t) GROUP BY t UNION ALL SELECT 'mark', 'strong', count(*) FILTER (doc_id % 2 = 0), 'exact' FROM documents) WHERE count > 0"""
QUERIES["rich_findings"] = lambda s, d: K.rich_findings(K.rich_nodes(_trees(s, d))).select("path", "type", "parent_type", "finding")
ORACLE_SQL["rich_findings"] = """SELECT concat('d', doc_id) AS path, 'panel' AS type, 'doc' AS parent_type, 'too-few' AS finding FROM documents WHERE doc_id % 5 = 0 AND doc_id % 10 <> 0
UNION ALL SELECT concat('d', doc_id), 'table', 'panel', f FROM documents, (SELECT unnest(['not-allowed', 'too-few']) AS f) WHERE doc_id % 10 = 0"""
QUERIES["rich_to_markdown"] = lambda s, d: K.to_markdown(_trees(s, d))
ORACLE_SQL["rich_to_markdown"] = "SELECT concat('d', doc_id) AS path, concat(CASE WHEN doc_id % 2 = 0 THEN concat('**w', doc_id, '**') ELSE concat('w', doc_id) END, CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), chr(10), '---') ELSE '' END) AS markdown FROM documents"

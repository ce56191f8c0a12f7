"""Usage queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import usage as U
from lodestone.sources import USAGE_EVENTS_SQL, table, usage_events

SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in U.COUNTERS)
TOTAL = "CAST(sum(input + output + cache_read + cache_write) AS BIGINT) AS total"
KIND = "CASE WHEN starts_with(tool, 'mcp__') THEN 'mcp' WHEN tool IN ('Task', 'Agent') THEN 'agent' WHEN tool = 'Skill' THEN 'skill' ELSE 'builtin' END"
SERVER = "CASE WHEN starts_with(tool, 'mcp__') THEN regexp_extract(tool, '^mcp__(.*?)(?:__|$)', 1) ELSE '(none)' END"
PROJECT = "coalesce(nullif(project, ''), '(unknown)')"
SESSIONS = "count(DISTINCT (provider, session_id)) AS sessions"
SINCE, UNTIL, LAST = "2024-01-05", "2024-01-20", 7

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _ev(spark, d):
    return usage_events(table(spark, d, "events"))


def _add(name, query, sql):
    QUERIES[name] = query
    ORACLE_SQL[name] = f"WITH {USAGE_EVENTS_SQL}{sql}"


for _by, _key in {"model": "model", "day": "CAST(day AS VARCHAR)", "week": "CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR)", "month": "strftime(day, '%Y-%m')", "project": PROJECT, "session": "provider || ':' || session_id", "provider": "provider"}.items():
    _add(f"usage_tokens_by_{_by}", lambda s, d, by=_by: U.tokens_by(_ev(s, d), by), f"SELECT {_key} AS key, {SUMS}, {SESSIONS}, {TOTAL} FROM ev WHERE kind = 'request' GROUP BY 1")
for _by, _key in {"name": "tool", "kind": KIND, "server": SERVER, "day": "CAST(day AS VARCHAR)", "session": "provider || ':' || session_id", "provider": "provider"}.items():
    _add(f"usage_tools_by_{_by}", lambda s, d, by=_by: U.tools_by(_ev(s, d), by), f"SELECT {_key} AS key, count(*) AS calls, {SESSIONS} FROM ev WHERE kind = 'tool' GROUP BY 1")
_add("usage_tools_mcp_only", lambda s, d: U.tools_by(_ev(s, d), "name", "mcp"), f"SELECT tool AS key, count(*) AS calls, {SESSIONS} FROM ev WHERE kind = 'tool' AND {KIND} = 'mcp' GROUP BY 1")

_SUMMARY = f"""SELECT {SESSIONS}, count(DISTINCT {PROJECT}) AS projects, count(DISTINCT day) AS days, count(DISTINCT (provider, file_id)) AS files, {SUMS}, {TOTAL},
  {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}s" for k in ("tool", "prompt", "hook", "command"))},
  count(*) FILTER (kind = 'tool' AND {KIND} = 'mcp') AS mcp_calls, count(*) FILTER (kind = 'hook' AND status = 'failed') AS hook_failures,
  CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM ev"""
_add("usage_summary", lambda s, d: U.summary(_ev(s, d)), _SUMMARY)

_SESSIONS = f"""SELECT provider, session_id, coalesce(arg_max(project, (ts, seq)) FILTER (project <> '' AND file_kind = 'main'), arg_min(project, (ts, seq)) FILTER (project <> '' AND file_kind <> 'main'), '') AS project, count(DISTINCT CASE WHEN file_kind = 'subagent' THEN file_id END) AS subagents,
  min(ts) AS first_ts, max(ts) AS last_ts, coalesce(string_agg(DISTINCT model, ',' ORDER BY model), '') AS models, count(*) FILTER (kind = 'tool') AS tool_calls, {SUMS}, {TOTAL},
  greatest(0, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) AS duration_ms FROM ev GROUP BY provider, session_id"""
for _sort, _order in {"recent": "last_ts", "tokens": "total", "tools": "tool_calls", "duration": "duration_ms"}.items():
    # the limit is the report's own: its first ten rows
    _add(
        f"usage_sessions_{_sort}",
        lambda s, d, sort=_sort: U.sessions(_ev(s, d), sort).limit(10).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")}),
        f"SELECT * FROM ({_SESSIONS}) ORDER BY {_order} DESC, provider, session_id LIMIT 10",
    )
_add("usage_projects", lambda s, d: U.projects(_ev(s, d)), f"SELECT {PROJECT} AS key, count(DISTINCT session_id) AS sessions, count(DISTINCT day) AS days, {SUMS}, {TOTAL} FROM ev GROUP BY 1")
_add("usage_skills", lambda s, d: U.named(_ev(s, d), "prompt"), f"SELECT name AS key, count(*) AS count, {SESSIONS} FROM ev WHERE kind = 'prompt' GROUP BY 1")
_add("usage_commands", lambda s, d: U.named(_ev(s, d), "command"), f"SELECT name AS key, count(*) AS count, {SESSIONS} FROM ev WHERE kind = 'command' GROUP BY 1")
_add(
    "usage_hooks",
    lambda s, d: U.hooks(_ev(s, d)),
    """SELECT name AS key, count(*) AS count, count(*) FILTER (status = 'failed') AS failures, count(*) FILTER (status = 'cancelled') AS cancelled, max(duration_ms) AS max_ms,
  CAST(floor(sum(duration_ms) / count(*) + 0.5) AS BIGINT) AS mean_ms FROM ev WHERE kind = 'hook' GROUP BY 1""",
)
_add(
    "usage_agents",
    lambda s, d: U.agents(_ev(s, d)),
    f""", starts AS (SELECT name AS key, count(*) AS spawned FROM ev WHERE kind = 'tool' AND {KIND} = 'agent' AND file_kind = 'main' GROUP BY 1),
own AS (SELECT name AS key, count(DISTINCT file_id) AS transcripts, max(depth) AS max_depth, {SUMS}, {TOTAL} FROM ev WHERE file_kind = 'subagent' GROUP BY 1)
SELECT key, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("spawned", "transcripts", "max_depth", *U.COUNTERS, "total"))} FROM starts FULL JOIN own USING (key)""",
)
_add(
    "usage_top_with_totals",
    lambda s, d: U.top(U.tools_by(_ev(s, d), "name"), 3, F.desc("calls"), F.asc("key")),
    f", r AS (SELECT tool AS key, count(*) AS calls, {SESSIONS} FROM ev WHERE kind = 'tool' GROUP BY 1) SELECT *, (SELECT count(*) FROM r) AS rows_all, (SELECT CAST(sum(calls) AS BIGINT) FROM r) AS calls_all, (SELECT CAST(sum(sessions) AS BIGINT) FROM r) AS sessions_all, (SELECT count(*) FROM r) > 3 AS truncated FROM r ORDER BY calls DESC, key LIMIT 3",
)
_add(
    "usage_last_sessions",
    lambda s, d: U.last_sessions(_ev(s, d), LAST).groupBy("provider", "session_id").agg(F.count("*").alias("events")),
    f"SELECT provider, session_id, count(*) AS events FROM ev GROUP BY 1, 2 ORDER BY max(ts) DESC, provider, session_id LIMIT {LAST}",
)
_add(
    "usage_window",
    lambda s, d: U.tokens_by(U.window(_ev(s, d), SINCE, UNTIL, ["alpha", "beta"], "/w", False), "model"),
    f"SELECT model AS key, {SUMS}, {SESSIONS}, {TOTAL} FROM ev WHERE kind = 'request' AND day BETWEEN '{SINCE}' AND '{UNTIL}' AND provider IN ('alpha', 'beta') AND (project = '/w' OR starts_with(project, '/w/')) AND file_kind = 'main' GROUP BY 1",
)
_add(
    "usage_window_fragment",
    lambda s, d: U.summary(U.window(_ev(s, d), project="P3")).select("sessions", "files", "requests"),
    f"SELECT {SESSIONS}, count(DISTINCT (provider, file_id)) AS files, CAST(sum(requests) AS BIGINT) AS requests FROM ev WHERE contains(lower(project), 'p3')",
)
_add(
    "usage_fold_days",
    lambda s, d: U.fold_days(_ev(s, d)).withColumn("day", F.col("day").cast("string")),
    f"SELECT provider, file_id, session_id, CAST(day AS VARCHAR) AS day, kind, CASE kind WHEN 'request' THEN model WHEN 'tool' THEN tool ELSE name END AS key, count(*) AS count, max(duration_ms) AS max_ms, CAST(sum(duration_ms) AS BIGINT) AS sum_ms, count(*) FILTER (status = 'failed') AS failures, {SUMS} FROM ev GROUP BY ALL",
)
_add("usage_rollup_from_days", lambda s, d: U.tokens_by_model_from_days(U.fold_days(_ev(s, d))), f"SELECT model AS key, {SUMS}, {SESSIONS}, {TOTAL} FROM ev WHERE kind = 'request' GROUP BY 1")
_add(
    "seq_cumulative_delta",
    lambda s, d: U.deltas(_ev(s, d), ["file_id"], ["ts", "seq"], "k").groupBy("file_id").agg(F.sum("delta").alias("spent"), F.count("*").alias("steps")),
    "SELECT file_id, CAST(sum(delta) AS BIGINT) AS spent, count(*) AS steps FROM (SELECT file_id, greatest(0, k - coalesce(lag(k) OVER (PARTITION BY file_id ORDER BY ts, seq), 0)) AS delta FROM ev) WHERE delta > 0 GROUP BY 1",
)
_add("seq_first_wins", lambda s, d: U.first_wins(_ev(s, d), ["file_id", "k"], ["ts", "seq"]).select("file_id", "k", "seq"), "SELECT file_id, k, seq FROM ev QUALIFY row_number() OVER (PARTITION BY file_id, k ORDER BY ts, seq) = 1")
_add("seq_last_wins", lambda s, d: U.last_wins(_ev(s, d), ["file_id", "k"], ["ts", "seq"], ["seq", "kind"]), "SELECT file_id, k, arg_max(seq, (ts, seq)) AS seq, arg_max(kind, (ts, seq)) AS kind FROM ev GROUP BY 1, 2")
_add(
    "seq_first_present",
    lambda s, d: U.first_present(_ev(s, d), ["session_id"], ["ts", "seq"], ["project", "model", "tool"]),
    "SELECT session_id, arg_min(project, (ts, seq)) FILTER (project <> '') AS project, arg_min(model, (ts, seq)) FILTER (model IS NOT NULL) AS model, arg_min(tool, (ts, seq)) FILTER (tool IS NOT NULL) AS tool FROM ev GROUP BY 1",
)
_add(
    "seq_model_in_force",
    lambda s, d: U.in_force(_ev(s, d), ["file_id"], ["ts", "seq"], F.col("model"), "in_force", "(unrecorded)").where("kind = 'tool'").groupBy("in_force").agg(F.count("*").alias("calls"), F.sum("k").alias("k_sum")),
    "SELECT in_force, count(*) AS calls, CAST(sum(k) AS BIGINT) AS k_sum FROM (SELECT *, coalesce(last_value(model IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), '(unrecorded)') AS in_force FROM ev) WHERE kind = 'tool' GROUP BY 1",
)
QUERIES["conv_turn_pairs"] = lambda s, d: (
    U.in_force(table(s, d, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.length("text")), "prompt_chars").where("role = 'assistant'").groupBy("conv_id").agg(F.count("*").alias("responses"), F.sum("prompt_chars").alias("prompt_chars"), F.sum(F.length("text")).alias("response_chars"))
)
ORACLE_SQL["conv_turn_pairs"] = "SELECT conv_id, count(*) AS responses, CAST(sum(p) AS BIGINT) AS prompt_chars, CAST(sum(length(text)) AS BIGINT) AS response_chars FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS p FROM conversations) WHERE role = 'assistant' GROUP BY 1"

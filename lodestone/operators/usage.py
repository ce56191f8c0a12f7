"""Usage reports over normalised events.

An event row has provider, session_id, project, file_id, file_kind (main, subagent),
seq, ts, day, kind, model, tool, name, status, duration_ms, depth and the counters.
Reports are one aggregation each; what a limit hides still counts in the totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import TOTAL_PARTS, duration_ms, half_up, month_of, tool_kind, tool_server, week_of

COUNTERS = (*TOTAL_PARTS, "requests")
NO_PROJECT = "(unknown)"


class DimensionError(ValueError):
    """A dimension, sort or kind that does not exist."""


def _pick(table: dict, name: str, what: str):
    if name not in table:
        raise DimensionError(f"unknown {what} {name!r}; known: {', '.join(table)}")
    return table[name]


def session_key() -> Column:
    """Sessions of different providers never meet."""
    return F.struct("provider", "session_id")


def project_name(col: str = "project") -> Column:
    return F.coalesce(F.when(F.col(col) != "", F.col(col)), F.lit(NO_PROJECT))


def _sums() -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in COUNTERS]


def _with_total(df: DataFrame) -> DataFrame:
    total = F.col(TOTAL_PARTS[0])
    for c in TOTAL_PARTS[1:]:
        total = total + F.col(c)
    return df.withColumn("total", total)


TOKEN_DIMENSIONS = {
    "model": lambda: F.col("model"),
    "day": lambda: F.col("day").cast("string"),
    "week": lambda: week_of(F.col("day")).cast("string"),
    "month": lambda: month_of(F.col("day")),
    "project": project_name,
    "session": lambda: F.concat_ws(":", "provider", "session_id"),
    "provider": lambda: F.col("provider"),
}
CHRONOLOGICAL = {"day", "week", "month"}


def tokens_by(events: DataFrame, by: str) -> DataFrame:
    """key, requests, the counters, total, sessions; only events with a model count (a day without them has no row)."""
    key = _pick(TOKEN_DIMENSIONS, by, "dimension")()
    out = events.where((F.col("kind") == "request") & F.col("model").isNotNull()).groupBy(key.alias("key")).agg(*_sums(), F.count_distinct(session_key()).alias("sessions"))
    out = _with_total(out)
    return out.orderBy("key") if by in CHRONOLOGICAL else out.orderBy(F.desc("total"), F.desc("requests"), "key")


TOOL_DIMENSIONS = {
    "name": lambda: F.col("tool"),
    "kind": lambda: tool_kind(F.col("tool")),
    "server": lambda: F.coalesce(tool_server(F.col("tool")), F.lit("(none)")),
    "day": lambda: F.col("day").cast("string"),
    "session": lambda: F.concat_ws(":", "provider", "session_id"),
    "provider": lambda: F.col("provider"),
}


def tools_by(events: DataFrame, by: str, kind: str | None = None) -> DataFrame:
    """key, calls, sessions; optionally of one kind of tool."""
    calls = events.where((F.col("kind") == "tool") & F.col("tool").isNotNull())
    if kind is not None:
        calls = calls.where(tool_kind(F.col("tool")) == _pick({"mcp": "mcp", "agent": "agent", "skill": "skill", "builtin": "builtin"}, kind, "kind"))
    out = calls.groupBy(_pick(TOOL_DIMENSIONS, by, "dimension")().alias("key")).agg(F.count("*").alias("calls"), F.count_distinct(session_key()).alias("sessions"))
    return out.orderBy("key") if by in CHRONOLOGICAL else out.orderBy(F.desc("calls"), "key")


def summary(events: DataFrame) -> DataFrame:
    """One row: distinct sessions, projects, days, files; counters; events by kind."""
    kinds = ("tool", "prompt", "hook", "command")
    return _with_total(
        events.agg(
            F.count_distinct(session_key()).alias("sessions"), F.count_distinct(project_name()).alias("projects"), F.count_distinct("day").alias("days"), F.count_distinct("provider", "file_id").alias("files"),
            *_sums(), *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds],
            F.count_if((F.col("kind") == "tool") & (tool_kind(F.col("tool")) == "mcp")).alias("mcp_calls"), F.count_if((F.col("kind") == "hook") & (F.col("status") == "failed")).alias("hook_failures"),
            F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
        )
    )


SESSION_SORTS = {
    "recent": [F.desc, "last_ts"],
    "tokens": [F.desc, "total"],
    "tools": [F.desc, "tool_calls"],
    "duration": [F.desc, "duration_ms"],
}


def sessions(events: DataFrame, sort: str = "recent") -> DataFrame:
    """A row per session: files, models, span, tokens. Ties follow provider and session id.

    The project is the last one that the main transcript names; only if it names none,
    the first that a subagent's does; else empty.
    """
    order = _pick(SESSION_SORTS, sort, "sort")
    named, main, place = F.col("project") != "", F.col("file_kind") == "main", F.struct("ts", "seq")
    out = events.groupBy("provider", "session_id").agg(
        F.coalesce(F.max_by("project", F.when(named & main, place)), F.min_by("project", F.when(named & ~main, place)), F.lit("")).alias("project"), F.count_distinct(F.when(F.col("file_kind") == "subagent", F.col("file_id"))).alias("subagents"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.count_if(F.col("kind") == "tool").alias("tool_calls"), *_sums(),
    )
    out = _with_total(out).withColumn("duration_ms", duration_ms(F.col("first_ts"), F.col("last_ts")))
    return out.orderBy(order[0](order[1]), "provider", "session_id")


def projects(events: DataFrame) -> DataFrame:
    """By project; sessions are counted by their bare id here."""
    out = events.groupBy(project_name().alias("key")).agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("day").alias("days"), *_sums())
    return _with_total(out).orderBy(F.desc("total"), F.desc("requests"), "key")


def named(events: DataFrame, kind: str) -> DataFrame:
    """Skills, commands: name, count, sessions."""
    return events.where((F.col("kind") == kind) & F.col("name").isNotNull()).groupBy(F.col("name").alias("key")).agg(F.count("*").alias("count"), F.count_distinct(session_key()).alias("sessions")).orderBy(F.desc("count"), "key")


def hooks(events: DataFrame) -> DataFrame:
    """count, failures, max and mean milliseconds (halves up). An error alone raises failures but not the count."""
    rows = events.where(F.col("kind").isin("hook", "hook_error"))
    runs = F.col("kind") == "hook"
    out = rows.groupBy(F.col("name").alias("key")).agg(
        F.count_if(runs).alias("count"), F.count_if(~runs | (F.col("status") == "failed")).alias("failures"), F.count_if(runs & (F.col("status") == "cancelled")).alias("cancelled"),
        F.max(F.when(runs, F.col("duration_ms"))).alias("max_ms"), F.sum(F.when(runs, F.col("duration_ms"))).alias("sum_ms"),
    )
    return out.select("key", "count", "failures", "cancelled", "max_ms", F.when(F.col("count") > 0, half_up(F.col("sum_ms") / F.col("count"))).otherwise(0).cast("long").alias("mean_ms")).orderBy(F.desc("count"), "key")


def agents(events: DataFrame) -> DataFrame:
    """By role: how often it was started (from main files) and what its own files spent; a role may lack either."""
    starts = events.where((F.col("kind") == "tool") & (tool_kind(F.col("tool")) == "agent") & (F.col("file_kind") == "main")).groupBy(F.col("name").alias("key")).agg(F.count("*").alias("spawned"))
    own = events.where(F.col("file_kind") == "subagent").groupBy(F.col("name").alias("key")).agg(F.count_distinct("file_id").alias("transcripts"), F.max("depth").alias("max_depth"), *_sums())
    both = starts.join(own, "key", "full")
    return _with_total(both.select("key", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("spawned", "transcripts", "max_depth", *COUNTERS)])).orderBy(F.desc("spawned"), "key")


def top(report: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows (0: all), each with the totals of the whole report and whether it was cut."""
    sums = [c for c, t in report.dtypes if t == "bigint"]
    whole = report.agg(F.count("*").alias("rows_all"), *[F.sum(c).cast("long").alias(f"{c}_all") for c in sums])
    cut = report.orderBy(*order).limit(n) if n else report.orderBy(*order)
    return cut.join(F.broadcast(whole)).withColumn("truncated", F.col("rows_all") > n if n else F.lit(False))  # whole: one row


def last_sessions(events: DataFrame, n: int) -> DataFrame:
    """All events of the n sessions that ended last."""
    ends = events.groupBy("provider", "session_id").agg(F.max("ts").alias("_last")).orderBy(F.desc("_last"), "provider", "session_id").limit(n)
    return events.join(ends.drop("_last"), ["provider", "session_id"], "left_semi")


def window(events: DataFrame, since: str | None = None, until: str | None = None, providers: list[str] | None = None, project: str | None = None, subagents: bool = True) -> DataFrame:
    """Both days included. A project is an absolute path prefix, or part of the name whatever its case."""
    out = events
    if since is not None and until is not None and since > until:
        raise ValueError(f"the window is inverted: {since} to {until}")
    if since is not None:
        out = out.where(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        out = out.where(F.col("day") <= F.lit(until).cast("date"))
    if providers:
        out = out.where(F.col("provider").isin(*providers))
    if project:
        inside = (F.col("project") == project) | F.col("project").startswith(project.rstrip("/") + "/")
        out = out.where(inside if project.startswith("/") else F.contains(F.lower("project"), F.lit(project.lower())))
    return out if subagents else out.where(F.col("file_kind") == "main")


SPAN_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}


def parse_day(text: str, today: str) -> str:
    """An ISO day as it is; 7d, 2w, 3m or 1y counted back from today."""
    import datetime as dt
    import re

    if m := re.fullmatch(r"(\d+)([dwmy])", text):
        return (dt.date.fromisoformat(today) - dt.timedelta(int(m[1]) * SPAN_DAYS[m[2]])).isoformat()
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return dt.date.fromisoformat(text).isoformat()
    raise ValueError(f"not a day: {text!r}")


def fold_days(events: DataFrame) -> DataFrame:
    """The day rollup: provider, file_id, day, kind, key with sums; the reports can be had from it."""
    key = F.when(F.col("kind") == "request", F.col("model")).when(F.col("kind") == "tool", F.col("tool")).otherwise(F.col("name"))
    return events.groupBy("provider", "file_id", "session_id", "day", "kind", key.alias("key")).agg(F.count("*").alias("count"), F.max("duration_ms").alias("max_ms"), F.sum("duration_ms").alias("sum_ms"), F.count_if(F.col("status") == "failed").alias("failures"), *_sums())


def tokens_by_model_from_days(days: DataFrame) -> DataFrame:
    """tokens_by(events, 'model') from the day rollup."""
    out = days.where((F.col("kind") == "request") & F.col("key").isNotNull()).groupBy("key").agg(*_sums(), F.count_distinct(session_key()).alias("sessions"))
    return _with_total(out).orderBy(F.desc("total"), F.desc("requests"), "key")


# Sequences within a file.


def deltas(readings: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Cumulative readings as steps, never negative; rows that add nothing are dropped."""
    step = F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*by).orderBy(*order)), F.lit(0))
    return readings.withColumn("delta", F.greatest(F.lit(0), step).cast("long")).where("delta > 0")


def first_wins(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """An aggregation, so a hot key is combined before it moves."""
    return rows.groupBy(*by).agg(*[F.max_by(v, F.struct(*order)).alias(v) for v in values])


def first_present(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The first value in order that is neither null nor empty."""
    has = lambda v: F.col(v).isNotNull() & (F.col(v).cast("string") != "")
    return rows.groupBy(*by).agg(*[F.min_by(F.when(has(v), F.col(v)), F.when(has(v), F.struct(*order))).alias(v) for v in values])


def in_force(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str, default: str | None = None) -> DataFrame:
    """As-of: the latest value at or before each row."""
    last = F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(last, F.lit(default)) if default is not None else last)

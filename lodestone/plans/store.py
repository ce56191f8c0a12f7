"""Queries over a usage store that is written in generations from the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators.ordered import cut
from lodestone.session import shared_dir
from lodestone.sources import USAGE_EVENTS_SQL, table, usage_events
from lodestone.sources.store import Store

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _stored(report):
    """First a third of each file's events, then half of the files whole, then alpha's files that a walk did not see again; the store goes once it is read."""

    def query(s, d):
        root = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
        store, events = Store(s, root), usage_events(table(s, d, "events"))
        store.write(events.where("seq % 3 = 0"), 1, "2024-02-01T00:00:00Z")
        store.write(events.where("file_id % 2 = 0"), 2, "2024-02-02T00:00:00Z")
        store.write(events, 2, "2024-02-03T00:00:00Z")  # sent again: changes nothing
        store.delete_missing("alpha", events.where("file_id % 5 <> 1").select("file_id"), 3)
        out = cut(report(store))
        at = s._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(s._jsc.hadoopConfiguration()).delete(at, True)
        return out

    return query


_LIVE = f"{USAGE_EVENTS_SQL}, live AS (SELECT * FROM ev WHERE (file_id % 2 = 0 OR seq % 3 = 0) AND NOT (provider = 'alpha' AND file_id % 5 = 1))"
QUERIES["store_models"] = _stored(lambda st: st.select("day_model", ["alpha", "beta"], "2024-01-05", "2024-01-20", subagents=False).groupBy("provider", "model").agg(*[F.sum(c).cast("long").alias(c) for c in ("input", "output", "requests")], F.count_distinct("session_id").alias("sessions")))
ORACLE_SQL["store_models"] = f"""WITH {_LIVE} SELECT provider, model, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(requests) AS BIGINT) AS requests, count(DISTINCT session_id) AS sessions
FROM live WHERE kind = 'request' AND model IS NOT NULL AND provider IN ('alpha', 'beta') AND day BETWEEN '2024-01-05' AND '2024-01-20' AND file_kind <> 'subagent' GROUP BY provider, model"""
QUERIES["store_hooks"] = _stored(lambda st: st.read("day_hook"))
ORACLE_SQL["store_hooks"] = f"""WITH {_LIVE} SELECT provider, file_id, day, name AS hook, count(*) AS count, count(*) FILTER (status = 'failed') AS failures, count(*) FILTER (status = 'cancelled') AS cancelled, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS total_ms, CAST(coalesce(max(duration_ms), 0) AS BIGINT) AS max_ms
FROM live WHERE kind = 'hook' AND name IS NOT NULL GROUP BY provider, file_id, day, name"""
QUERIES["store_status"] = _stored(lambda st: st.status())
ORACLE_SQL["store_status"] = f"""WITH {_LIVE}, p AS (SELECT provider, count(DISTINCT file_id) AS files, count(DISTINCT (file_id, day)) AS days, count(*) AS events, max(CASE WHEN file_id % 2 = 0 THEN '2024-02-02T00:00:00Z' ELSE '2024-02-01T00:00:00Z' END) AS updated_at FROM live GROUP BY provider)
SELECT provider, files, days, events, updated_at FROM p UNION ALL SELECT NULL, CAST(sum(files) AS BIGINT), CAST(sum(days) AS BIGINT), CAST(sum(events) AS BIGINT), max(updated_at) FROM p"""

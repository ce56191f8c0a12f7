"""The usage store: replacement by file, lost and repeated writes, deletions, compaction."""

from __future__ import annotations

import datetime as dt

import pytest

from lodestone.sources.store import TABLES, Store

SCHEMA = "provider string, file_id long, session_id string, file_kind string, project string, seq long, ts timestamp, day date, kind string, model string, tool string, name string, status string, duration_ms long, depth long, requests long, input long, output long, cache_read long, cache_write long"


def event(provider, file_id, seq, kind, what=None, day=1, status="ok", depth=0, n=1):
    at = dt.datetime(2024, 1, day, 12, 0, seq)
    own = {"request": (what, None, None), "tool": (None, what, None)}.get(kind, (None, None, what))
    request = kind == "request"
    return (provider, file_id, f"s{file_id}", "subagent" if file_id == 3 else "main", "/p", seq, at, at.date(), kind, *own, status, 10 * seq, depth, int(request), n * request, 2 * n * request, 0, 0)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_generations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        store.read("file")
    assert store.generations() == []
    first = [event("a", 1, 1, "request", "m", n=5), event("a", 1, 2, "tool", "Bash"), event("a", 2, 3, "hook", "h", status="failed"), event("b", 1, 4, "agent", "x", depth=2), event("a", 3, 5, "prompt")]
    assert store.write(spark.createDataFrame(first, SCHEMA), 1, "t1")
    assert not store.write(spark.createDataFrame(first[:1], SCHEMA), 1, "t9")  # a batch that is sent again
    assert rows(store.read("file"), "provider", "file_id", "imported_at") == [("a", 1, "t1"), ("a", 2, "t1"), ("a", 3, "t1"), ("b", 1, "t1")]
    assert rows(store.read("day_hook"), "hook", "count", "failures", "total_ms") == [("h", 1, 1, 30)] and rows(store.read("day_agent"), "agent", "count", "max_depth") == [("x", 1, 2)]
    assert rows(store.read("day"), "provider", "file_id", "prompts") == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("b", 1, 0)]

    # the whole of a file is replaced, other files stay
    assert store.write(spark.createDataFrame([event("a", 1, 1, "request", "m", day=2, n=7)], SCHEMA), 2, "t2")
    assert rows(store.read("day_model"), "file_id", "day", "input", "output") == [(1, dt.date(2024, 1, 2), 7, 14)] and store.read("day_tool").count() == 0
    assert store.read("event").count() == 4

    # a write that was lost before its line in the manifest is not seen, and is written over
    lost = spark.createDataFrame([event("a", 2, 9, "request", "m", n=100)], SCHEMA)
    lost.write.parquet(str(tmp_path / "store" / "event" / "generation=3"))
    assert store.read("event").count() == 4
    assert store.write(spark.createDataFrame([event("a", 2, 9, "request", "m", n=1)], SCHEMA), 3, "t3")
    assert rows(store.read("day_model"), "file_id", "input") == [(1, 7), (2, 1)] and store.read("day_hook").count() == 0
    with pytest.raises(ValueError):
        store.write(lost, 0, "t0")

    status = {r.provider: (r.files, r.days, r.events, r.updated_at) for r in store.status().collect()}
    assert status == {"a": (3, 3, 3, "t3"), "b": (1, 1, 1, "t1"), None: (4, 4, 4, "t3")}
    assert rows(store.select("day", ["a"], subagents=False), "file_id", "session_id") == [(1, "s1"), (2, "s2")]
    assert rows(store.select("day_model", ["a", "b"], "2024-01-02", "2024-01-02"), "file_id") == [(1,)]

    assert store.delete_missing("a", spark.createDataFrame([(1,)], "file_id long"), 4)
    assert rows(store.read("file"), "provider", "file_id") == [("a", 1), ("b", 1)]
    before = {t: sorted(map(str, store.read(t).collect())) for t in TABLES}
    assert store.compact(5) and store.generations() == [5]
    assert {t: sorted(map(str, store.read(t).collect())) for t in TABLES} == before
    assert store.write(spark.createDataFrame([event("a", 2, 1, "prompt")], SCHEMA), 6, "t6")  # a deleted file may come back
    assert rows(store.read("file"), "provider", "file_id") == [("a", 1), ("a", 2), ("b", 1)]
    assert store.clear(7, "a") and rows(store.read("file"), "provider", "file_id") == [("b", 1)]
    assert store.clear(8) and store.read("event").count() == 0
    with pytest.raises(ValueError):
        store.read("nothing")

"""Loaders: the driver's tables and what stands in for logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over as many partitions as there are cores if its files give fewer; a larger table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def usage_events(raw: DataFrame) -> DataFrame:
    """The events table as normalised usage events; the reports' tests take it for a transcript log.

    All columns are functions of one row, so filters and column pruning reach the scan.
    """
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "purchase", "hook").when(F.col("event_type") == "signup", "prompt").otherwise("command")
    request = F.col("kind") == "request"
    out = raw.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "value", k.alias("k"), kind.alias("kind"))
    out = out.withColumns(
        {
            "provider": F.when(F.col("user_id") % 3 == 0, "alpha").when(F.col("user_id") % 3 == 1, "beta").otherwise("gamma"),
            "session_id": F.concat(F.lit("s"), (F.col("user_id") % 100).cast("string")),
            "project": F.when(F.col("user_id") % 11 == 0, "").otherwise(F.concat(F.lit("/w/p"), (F.col("user_id") % 7).cast("string"))),
            "file_kind": F.when(F.col("user_id") % 5 == 0, "subagent").otherwise("main"),
            "file_id": F.col("user_id"),
            "day": F.to_date("ts"),
            "model": F.when(request, F.concat(F.lit("m"), (F.col("k") % 4).cast("string"))),
            "tool": F.when(F.col("kind") == "tool", F.when(F.col("k") % 4 == 0, F.concat(F.lit("mcp__srv"), (F.col("k") % 3).cast("string"), F.lit("__run"))).when(F.col("k") % 4 == 1, "Read").when(F.col("k") % 4 == 2, "Bash").otherwise("Task")),
            "name": F.concat(F.lit("n"), (F.col("k") % 6).cast("string")),
            "status": F.when(F.col("k") % 9 == 0, "failed").when(F.col("k") % 9 == 1, "cancelled").otherwise("ok"),
            "duration_ms": F.floor(F.col("value") * 10).cast("bigint"),
            "depth": (F.col("k") % 3).cast("bigint"),
            "requests": F.when(request, 1).otherwise(0).cast("bigint"),
            "input": F.when(request, F.col("k")).otherwise(0),
            "output": F.when(request, F.col("k") * 2).otherwise(0),
            "cache_read": F.when(request, F.col("k") % 13).otherwise(0),
            "cache_write": F.when(request, F.col("k") % 7).otherwise(0),
        }
    )
    return out.drop("user_id")


#: DuckDB SQL of usage_events(), as a WITH entry named ev.
USAGE_EVENTS_SQL = """
raw_ev AS (
  SELECT event_id AS seq, ts, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'hook' WHEN 'signup' THEN 'prompt' ELSE 'command' END AS kind FROM events),
ev AS (
  SELECT seq, ts, value, k, kind, CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider,
    's' || (user_id % 100) AS session_id, CASE WHEN user_id % 11 = 0 THEN '' ELSE '/w/p' || (user_id % 7) END AS project,
    CASE WHEN user_id % 5 = 0 THEN 'subagent' ELSE 'main' END AS file_kind, user_id AS file_id, CAST(ts AS DATE) AS day,
    CASE WHEN kind = 'request' THEN 'm' || (k % 4) END AS model,
    CASE WHEN kind = 'tool' THEN CASE k % 4 WHEN 0 THEN 'mcp__srv' || (k % 3) || '__run' WHEN 1 THEN 'Read' WHEN 2 THEN 'Bash' ELSE 'Task' END END AS tool,
    'n' || (k % 6) AS name, CASE k % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' ELSE 'ok' END AS status,
    CAST(floor(value * 10) AS BIGINT) AS duration_ms, k % 3 AS depth,
    CASE WHEN kind = 'request' THEN 1 ELSE 0 END AS requests, CASE WHEN kind = 'request' THEN k ELSE 0 END AS input, CASE WHEN kind = 'request' THEN k * 2 ELSE 0 END AS output,
    CASE WHEN kind = 'request' THEN k % 13 ELSE 0 END AS cache_read, CASE WHEN kind = 'request' THEN k % 7 ELSE 0 END AS cache_write
  FROM raw_ev)
"""

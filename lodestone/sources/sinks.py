"""Sinks: JSON lines, payloads in an envelope, findings as static-analysis logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import __version__

#: The format's version and schema. Fixed values.
SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"
LEVELS = ("error", "warning", "note")
TOOL = "lodestone"


def json_lines(df: DataFrame) -> DataFrame:
    """One column value: each row as a JSON object, nulls written out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def enveloped(df: DataFrame, command: str, exit_code: int = 0, schema: str | None = None) -> DataFrame:
    """json_lines() with each row as the data of a versioned envelope."""
    if exit_code not in (0, 1, 2):
        raise ValueError(f"an exit code is 0, 1 or 2, not {exit_code}")
    head = F.struct(F.lit("1.0").alias("schemaVersion"), F.struct(F.lit(TOOL).alias("name"), F.lit(__version__).alias("version")).alias("tool"), F.lit(command).alias("command"), F.lit(exit_code == 0).alias("ok"), F.lit(exit_code).alias("exitCode"), F.lit(schema).cast("string").alias("schema"), F.struct(*df.columns).alias("data"))
    return df.select(head.alias("e")).select(F.to_json("e", {"ignoreNullFields": "false"}).alias("value"))


def sarif(findings: DataFrame, levels: dict[str, str] | None = None) -> DataFrame:
    """file, value: for each file one log of its findings (file, line, checker, message), by line and checker.

    A log is bounded by a file's findings; nothing gathers all of them. Without a line a
    finding has no region. levels gives a checker's level, warning by default.
    """
    for level in (levels or {}).values():
        if level not in LEVELS:
            raise ValueError(f"no level: {level}")
    level = F.lit("warning")
    for checker, name in (levels or {}).items():
        level = F.when(F.col("checker") == checker, name).otherwise(level)
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    location = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("checker").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(location).alias("locations"))
    entry = F.struct(F.coalesce("line", F.lit(0)).alias("at"), F.col("checker").alias("by"), F.col("message").alias("text"), result.alias("result"))
    per = findings.groupBy("file").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    rules = F.transform(F.array_sort(F.array_distinct(F.transform("all", lambda x: x["by"]))), lambda r: F.struct(r.alias("id"), r.alias("name")))
    body = F.struct(F.struct(F.struct(F.lit(TOOL).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.transform("all", lambda x: x["result"]).alias("results"))
    head = f'{{"version":{json.dumps(SARIF_VERSION)},"$schema":{json.dumps(SARIF_SCHEMA)},"runs":['
    return per.select("file", F.concat(F.lit(head), F.to_json(body), F.lit("]}")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Writes the column value as text, one part per task."""
    lines.select("value").write.mode("overwrite").text(path)

"""Transcript logs: JSON lines of several dialects as one event model.

A line that is no JSON object is counted, never fatal. A dialect is a function from
parsed lines (file, seq, v) to events; the registry is open for more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The common columns of every dialect's events.
EVENT = ("file", "seq", "ts", "kind", "model", "tool", "input", "output", "cache_read", "cache_write", "thinking")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, line of all files below path. seq orders a file's lines: files are read whole, so it is exact."""
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path)
    return whole.select(F.col("path").alias("file"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("seq", "line")).where("trim(line) <> ''")


def parse(lines: DataFrame) -> DataFrame:
    """Adds v, the line as a variant, null if it is no JSON object."""
    v = F.try_parse_json("line")
    return lines.withColumn("v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def malformed(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.col("v").isNull()).alias("malformed"))


def _s(path: str) -> Column:
    return F.try_variant_get("v", path, "string")


def _n(path: str) -> Column:
    return F.coalesce(F.try_variant_get("v", path, "bigint"), F.lit(0))


def _day(ts: Column) -> Column:
    return F.to_date(F.try_to_timestamp(ts))


def _event(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    default = {"model": none, "tool": none, "input": zero, "output": zero, "cache_read": zero, "cache_write": zero, "thinking": zero, "kind": F.lit(kind)}
    return df.select(*[(columns.get(c, default.get(c)) if c in columns or c in default else F.col(c)).alias(c) for c in EVENT])


def responses(parsed: DataFrame) -> DataFrame:
    """A record per content block: tokens count once per response id, the first time; every tool block is a call."""
    rows = parsed.where(_s("$.type") == "assistant").select("file", "seq", "v", _s("$.timestamp").alias("ts"), F.coalesce(_s("$.message.id"), F.concat(F.lit("line "), F.col("seq").cast("string"))).alias("id"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file", "id").orderBy("seq"))).where("_n = 1")
    u = "$.message.usage"
    tokens = _event(first, "request", model=_s("$.message.model"), input=_n(f"{u}.input_tokens"), output=_n(f"{u}.output_tokens"), cache_read=_n(f"{u}.cache_read_input_tokens"), cache_write=_n(f"{u}.cache_creation_input_tokens"))
    blocks = F.try_variant_get("v", "$.message.content", "array<variant>")
    calls = rows.select("file", "seq", "ts", F.explode(blocks).alias("b")).where(F.try_variant_get("b", "$.type", "string") == "tool_use")
    return tokens.unionByName(_event(calls, "tool", tool=F.try_variant_get("b", "$.name", "string")))


def cumulative(parsed: DataFrame) -> DataFrame:
    """Running totals: an event is the step since the last reading, under the model in force; cached input is inside input."""
    t = "$.payload.info.total_token_usage"
    names = {"input": "input_tokens", "cached": "cached_input_tokens", "output": "output_tokens", "thinking": "reasoning_output_tokens"}
    rows = parsed.where("v is not null").select("file", "seq", _s("$.timestamp").alias("ts"), F.when(_s("$.type") == "turn_context", _s("$.payload.model")).alias("model"), F.try_variant_get("v", t, "variant").isNotNull().alias("reading"), *[_n(f"{t}.{p}").alias(c) for c, p in names.items()])
    w = Window.partitionBy("file").orderBy("seq")
    rows = rows.withColumn("model", F.last("model", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("reading")
    step = {c: F.greatest(F.lit(0), F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))) for c in names}
    rows = rows.withColumns({f"d_{c}": x for c, x in step.items()}).where(" + ".join(f"d_{c}" for c in names) + " > 0")
    return _event(rows, "request", model=F.coalesce("model", F.lit("(unrecorded)")), input=F.greatest(F.lit(0), F.col("d_input") - F.col("d_cached")), output=F.col("d_output"), cache_read=F.col("d_cached"), thinking=F.col("d_thinking"))


def repeated(parsed: DataFrame) -> DataFrame:
    """The same id comes again as a turn goes on: tokens of the first record that has some, tool list of the last."""
    rows = parsed.where(F.col("v").isNotNull() & _s("$.id").isNotNull()).select("file", "seq", "v", _s("$.timestamp").alias("ts"), _s("$.id").alias("id"), F.try_variant_get("v", "$.tokens", "variant").isNotNull().alias("has"))
    best = rows.where("has").groupBy("file", "id").agg(F.min_by(F.struct("seq", "ts", "v"), "seq").alias("r")).select("file", "r.*")
    cached = _n("$.tokens.cached")
    tokens = _event(best, "request", model=_s("$.model"), input=F.greatest(F.lit(0), _n("$.tokens.input") - cached), output=_n("$.tokens.output"), cache_read=cached, thinking=_n("$.tokens.thoughts"))
    calls = F.try_variant_get("v", "$.toolCalls", "array<variant>")
    last = rows.where(calls.isNotNull()).groupBy("file", "id").agg(F.max_by(F.struct("seq", "ts", "v"), "seq").alias("r")).select("file", "r.*").select("file", "seq", "ts", F.explode(calls).alias("b"))
    return tokens.unionByName(_event(last, "tool", tool=F.try_variant_get("b", "$.name", "string")))


DIALECTS: dict[str, Callable[[DataFrame], DataFrame]] = {"responses": responses, "cumulative": cumulative, "repeated": repeated}


def events(lines: DataFrame, dialect: str) -> DataFrame:
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}; known: {', '.join(DIALECTS)}")
    return DIALECTS[dialect](parse(lines)).withColumn("day", _day(F.col("ts")))

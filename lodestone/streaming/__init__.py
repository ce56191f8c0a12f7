"""Incremental forms of the usage operators: day buckets, duplicates by id, cumulative steps.

They read a folder of Parquet as a file stream and stop when nothing new is there, so
each equals its batch form; the same queries run on without an end on a cluster.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import shared_dir
from lodestone.sources import usage_events


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of normalised events; ts is a timestamp, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return usage_events(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*"))


def _drain(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """All that the stream has now, as a table in the shared folder; epochs are written once each."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/out/_epoch_dir={epoch}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_epoch", T.IntegerType())])).parquet(f"{path}/out/*")
    if mode == "complete":
        last = out.agg(F.max("_epoch").alias("_epoch"))
        out = out.join(F.broadcast(last), "_epoch", "left_semi")  # one row
    return out.drop("_epoch")


def day_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and requests by UTC day and kind, with a day of allowed lateness."""
    ev = events_stream(spark, sf_dir).withWatermark("ts", "1 day")
    out = ev.groupBy(F.window("ts", "1 day"), "kind").agg(F.count("*").alias("events"), F.sum("requests").alias("requests"))
    return _drain(spark, out, "complete").select(F.to_date("window.start").cast("string").alias("day"), "kind", "events", "requests")


def distinct_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sight of each (file, k): duplicates that come within the watermark are dropped."""
    ev = events_stream(spark, sf_dir).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["file_id", "k"])
    return _drain(spark, ev.select("file_id", "k"), "append")


def running_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, spent, steps from cumulative readings: the state of a file is its last reading."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, spent, steps = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])  # one file's rows of one trigger
        step = rows["k"].diff()
        step.iloc[0] = rows["k"].iloc[0] - last
        step = step.clip(lower=0)
        state.update((int(rows["k"].iloc[-1]), spent := spent + int(step.sum()), steps := steps + int((step > 0).sum())))
        yield pd.DataFrame({"file_id": [key[0]], "spent": [spent], "steps": [steps]})

    out = events_stream(spark, sf_dir).select("file_id", "ts", "seq", "k").groupBy("file_id").applyInPandasWithState(run, "file_id long, spent long, steps long", "last long, spent long, steps long", "update", "NoTimeout")
    return _drain(spark, out, "update").groupBy("file_id").agg(F.max("spent").alias("spent"), F.max("steps").alias("steps"))

"""A content-addressed archive's index: artifact, blob and segment tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dispositions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds disposition: stored (new content), pending (same content earlier in this run), duplicate (already held)."""
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("ord"))
    held = stored.select("sha256", F.lit(True).alias("_held")).distinct()
    out = incoming.withColumn("_n", first).join(held, "sha256", "left")
    return out.withColumn("disposition", F.when(F.col("_held"), "duplicate").when(F.col("_n") > 1, "pending").otherwise("stored")).drop("_n", "_held")


def latest(artifact: DataFrame) -> DataFrame:
    """The newest row of each provider and path, with its number of versions; an aggregation, not a sort."""
    rest = [c for c in artifact.columns if c not in ("provider", "path")]
    out = artifact.groupBy("provider", "path").agg(F.max_by(F.struct(*rest), "id").alias("r"), F.count("*").alias("versions"))
    return out.select("provider", "path", *[F.col(f"r.{c}").alias(c) for c in rest], "versions")


def listing(artifact: DataFrame, providers: list[str] = (), classes: list[str] = (), since: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest rows, filtered, last seen first."""
    out = latest(artifact)
    if providers:
        out = out.where(F.col("provider").isin(*providers))
    if classes:
        out = out.where(F.col("class").isin(*classes))
    if since:
        out = out.where(F.col("last_seen") >= since)
    out = out.orderBy(F.desc("last_seen"), "provider", "path")
    return out.limit(limit) if limit else out


def resolve(artifact: DataFrame, blob: DataFrame, what: str) -> DataFrame:
    """By hash or hash prefix; if no hash fits, the newest row of an exact path. With the blob's place."""
    by_hash = artifact.where(F.col("sha256").startswith(what)).groupBy("sha256").agg(F.max_by("path", "id").alias("path"), F.max("id").alias("id")).withColumn("turn", F.lit(0))
    newest = artifact.where(F.col("path") == what).agg(F.max_by("sha256", "id").alias("sha256"), F.max("id").alias("id")).where("id is not null")
    by_path = newest.select("sha256", F.lit(what).alias("path"), "id", F.lit(1).alias("turn"))
    found = by_hash.unionByName(by_path).join(blob.select("sha256", "segment_id", "offset", "size"), "sha256")
    first = found.agg(F.min("turn").alias("turn"))  # one row
    return found.join(F.broadcast(first), "turn").drop("turn")


def status(artifact: DataFrame, blob: DataFrame) -> DataFrame:
    """By provider and class: artifacts, paths, contents and bytes."""
    return artifact.join(blob.select("sha256", F.col("size").alias("bytes")), "sha256").groupBy("provider", "class").agg(F.count("*").alias("artifacts"), F.count_distinct("path").alias("paths"), F.count_distinct("sha256").alias("contents"), F.sum("bytes").alias("bytes"))


def seals(blobs: DataFrame, threshold: int) -> DataFrame:
    """segment of each blob in order: a segment is sealed once it holds threshold bytes.

    The fill starts anew at each seal, so it is a fold. A shard's blobs pass through one
    task in order, a batch at a time; the task holds two numbers.
    """

    def run(batches):
        shard, segment, held = None, 0, 0
        for b in batches:
            out = []
            for own, size in zip(b.column("shard").to_pylist(), b.column("size").to_pylist(), strict=True):
                if own != shard:
                    shard, segment, held = own, 0, 0
                out.append(segment)
                held += size
                if held >= threshold:
                    segment, held = segment + 1, 0
            yield b.append_column("segment", pa.array(out, pa.int64()))

    ordered = blobs.repartition("shard").sortWithinPartitions("shard", "ord")
    return ordered.mapInArrow(run, T.StructType([*blobs.schema.fields, T.StructField("segment", T.LongType())]))


def verify(artifact: DataFrame, blob: DataFrame, content: DataFrame) -> DataFrame:
    """sha256, finding: a missing blob, or content that hashes to something else."""
    wanted = artifact.select("sha256").distinct()
    there = content.select("sha256", F.sha2("content", 256).alias("actual"))
    out = wanted.join(blob.select("sha256", F.lit(True).alias("_b")), "sha256", "left").join(there, "sha256", "left")
    finding = F.when(F.col("_b").isNull(), "no blob").when(F.col("actual").isNull(), "no content").when(F.col("actual") != F.col("sha256"), "damaged")
    return out.withColumn("finding", finding).where("finding is not null").select("sha256", "finding")


def upsert(current: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """last_seen moves on for known keys; new keys come with first_seen = last_seen."""
    a, b = current.select(*key, "first_seen", "last_seen"), seen.groupBy(*key).agg(F.max("seen").alias("_seen"))
    return a.join(b, key, "full").select(*key, F.coalesce("first_seen", "_seen").alias("first_seen"), F.coalesce(F.greatest("last_seen", "_seen"), "last_seen", "_seen").alias("last_seen"))


def freshness(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """path, state by size and mtime: current, stale, new, gone."""
    a, b = listed.select("path", F.struct("size", "mtime").alias("l")), stored.select("path", F.struct("size", "mtime").alias("s"))
    return a.join(b, "path", "full").select("path", F.when(F.col("s").isNull(), "new").when(F.col("l").isNull(), "gone").when(F.col("l") == F.col("s"), "current").otherwise("stale").alias("state"))


def without_missing(stored: DataFrame, listed: DataFrame, complete: bool) -> DataFrame:
    """Forgets what a walk did not see, but only after a complete walk."""
    return stored.join(listed.select("path").distinct(), "path", "left_semi") if complete else stored

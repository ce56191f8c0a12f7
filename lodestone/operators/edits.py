"""Edit plans as rows: which edits must not be applied, and which go ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reasons against an edit. Fixed values.
OUTSIDE, STALE, MISMATCH, OVERLAP = "outside-workspace", "stale-input", "expectation-mismatch", "overlap"


def _judged(edits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """edits with the first reason against each by itself, which is null for a sound one."""
    steps = F.filter(F.split("file", "/"), lambda s: (s != "") & (s != "."))
    # how far below the root each step stands; a negative depth leaves it
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("low")))
    outside = F.col("file").startswith("/") | (depth["low"] < 0)
    known = snapshots.select("file", "content", F.lit(True).alias("_known"))
    held = F.substring("content", F.col("start") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0)))
    reason = F.when(outside, OUTSIDE).when(F.col("_known").isNull(), STALE).when(~held.eqNullSafe(F.col("expected")), MISMATCH)
    return edits.join(known, "file", "left").withColumn("reason", reason).drop("content", "_known")


def conflicts(edits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """file, kind, start, end, rules of every reason against a plan of edits (file, start, end, expected, value, rule).

    Files are paths below the workspace's root; snapshots (file, content) has a row per file as
    it was read. Ranges are 0-based, half open and count characters. Sound edits of a file are compared with
    the one before them by start, end and rule: a shared span is an overlap, and so are two
    insertions at one place, whose order nothing says.
    """
    judged = _judged(edits, snapshots)
    alone = judged.where("reason is not null").select("file", F.col("reason").alias("kind"), "start", "end", F.array("rule").alias("rules"))
    w = Window.partitionBy("file").orderBy("start", "end", "rule")
    near = judged.where("reason is null").select("file", "start", "end", "rule", F.lag(F.struct("start", "end", "rule")).over(w).alias("b"))
    point = (F.col("b.start") == F.col("b.end")) & (F.col("start") == F.col("end")) & (F.col("b.start") == F.col("start"))
    both = near.where((F.col("b.end") > F.col("start")) | point)
    return alone.unionByName(both.select("file", F.lit(OVERLAP).alias("kind"), "start", "end", F.array_sort(F.array("b.rule", "rule")).alias("rules")))


def sound(edits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The edits of files without any conflict; what is left out stands in conflicts()."""
    return edits.join(conflicts(edits, snapshots).select("file").distinct(), "file", "left_anti").select(edits.columns)

"""The usage store: events and day rollups by file, replaced a file at a time, in generations.

Every write is a generation: new Parquet parts below each table, then a line in the
manifest. Readers take the generations that the manifest names, so a write that was lost
half-way is not seen, and one that is run again with the same number changes nothing.
Of a file, the rows of its newest generation count; a deletion is a generation that says
so. Nothing is rewritten but by compact().
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import TOTAL_PARTS

FILE = ["provider", "file_id"]
COUNTERS = (*TOTAL_PARTS, "requests")
#: Child tables of a day: the kind of event that they count, the column that names what is counted, and what it is called there.
CHILDREN = {"day_model": ("request", "model", "model"), "day_tool": ("tool", "tool", "tool"), "day_skill": ("skill", "name", "skill"), "day_command": ("command", "name", "command"), "day_agent": ("agent", "name", "agent"), "day_hook": ("hook", "name", "hook")}
TABLES = ("event", "file", "day", *CHILDREN)


def _count(name: str, which: Column | None = None) -> Column:
    return (F.count("*") if which is None else F.count_if(which)).cast("long").alias(name)


def _measures(table: str) -> list[Column]:
    if table == "day_model":
        return [F.sum(c).cast("long").alias(c) for c in COUNTERS]
    if table == "day_agent":
        return [_count("count"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth")]
    if table == "day_hook":
        total, most = F.coalesce(F.sum("duration_ms"), F.lit(0)), F.coalesce(F.max("duration_ms"), F.lit(0))
        return [_count("count"), _count("failures", F.col("status") == "failed"), _count("cancelled", F.col("status") == "cancelled"), total.cast("long").alias("total_ms"), most.cast("long").alias("max_ms")]
    return [_count("calls")]


def _rollups(event: DataFrame, imported_at: str) -> dict[str, DataFrame]:
    """file, day and the child tables of events; a file's identity is that of its first event, a day is there even if nothing on it is counted."""
    first = lambda c: F.min_by(c, F.struct("ts", "seq")).alias(c)
    out = {
        "file": event.groupBy(*FILE).agg(first("session_id"), first("file_kind"), first("project"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumns({"imported_at": F.lit(imported_at), "deleted": F.lit(False)}),
        "day": event.groupBy(*FILE, "day").agg(_count("prompts", F.col("kind") == "prompt"), _count("errors", F.col("kind") == "error"), _count("compactions", F.col("kind") == "compaction")),
    }
    for name, (kind, column, key) in CHILDREN.items():
        own = event.where((F.col("kind") == kind) & F.col(column).isNotNull())
        out[name] = own.groupBy(*FILE, "day", F.col(column).alias(key)).agg(*_measures(name))
    return out


class Store:
    """A store below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str, generation: int | None = None) -> str:
        return f"{self.root}/{table}" + ("" if generation is None else f"/generation={generation}")

    def generations(self) -> list[int]:
        """The generations that count: those in the manifest from the last compaction on, a handful of numbers."""
        try:
            rows = self.spark.read.parquet(self._path("manifest")).select("generation", "whole").collect()
        except AnalysisException:  # nothing was ever written
            return []
        last = max((r["generation"] for r in rows if r["whole"]), default=0)
        return sorted(r["generation"] for r in rows if r["generation"] >= last)

    def _close(self, generation: int, whole: bool) -> None:
        self.spark.createDataFrame([(whole,)], "whole boolean").coalesce(1).write.mode("overwrite").parquet(self._path("manifest", generation))

    def _next(self, generation: int) -> bool:
        known = self.generations()
        if generation in known:
            return False
        if known and generation < known[-1]:
            raise ValueError(f"generation {generation} comes after {known[-1]}")
        return True

    def write(self, events: DataFrame, generation: int, imported_at: str) -> bool:
        """Replaces the files that events come from; False if that generation is there already.

        foreachBatch may call it with its batch's number: a batch that is sent again is
        not counted twice, and one that failed on its way is written over.
        """
        if not self._next(generation):
            return False
        events.write.mode("overwrite").parquet(self._path("event", generation))
        written = self.spark.read.schema(events.schema).parquet(self._path("event", generation))
        for name, df in _rollups(written, imported_at).items():
            df.write.mode("overwrite").parquet(self._path(name, generation))
        self._close(generation, False)
        return True

    def _parts(self, table: str) -> DataFrame:
        known = self.generations()
        if not known:
            raise FileNotFoundError(f"{self.root} holds no store")
        return self.spark.read.option("basePath", self._path(table)).option("mergeSchema", True).parquet(*[self._path(table, g) for g in known])

    def _owners(self, deleted: bool = False) -> DataFrame:
        newest = self._parts("file").groupBy(*FILE).agg(F.max_by(F.struct("generation", "deleted"), "generation").alias("n"))
        return newest.where(F.col("n.deleted") == deleted).select(*FILE, F.col("n.generation").alias("generation"))

    def read(self, table: str) -> DataFrame:
        """The live rows of a table."""
        if table not in TABLES:
            raise ValueError(f"unknown table {table!r}; known: {', '.join(TABLES)}")
        rows = self._parts(table)
        if table == "file":
            rows = rows.where("not deleted").drop("deleted")
        return rows.join(self._owners(), [*FILE, "generation"], "left_semi").drop("generation")

    def _bury(self, gone: DataFrame, generation: int) -> None:
        nothing = {f.name: F.lit(None).cast(f.dataType) for f in self._parts("file").schema.fields if f.name not in (*FILE, "generation", "deleted")}
        gone.select(*FILE, *[c.alias(n) for n, c in nothing.items()], F.lit(True).alias("deleted")).write.mode("overwrite").parquet(self._path("file", generation))
        for name in TABLES:
            if name != "file":
                self._parts(name).drop("generation").where("false").write.mode("overwrite").parquet(self._path(name, generation))
        self._close(generation, False)

    def delete_missing(self, provider: str, seen: DataFrame, generation: int) -> bool:
        """Drops a provider's files that a walk of all of them did not find. seen: file_id."""
        if not self._next(generation):
            return False
        own = self.read("file").where(F.col("provider") == provider)
        self._bury(own.join(seen.select("file_id").distinct(), "file_id", "left_anti"), generation)
        return True

    def clear(self, generation: int, provider: str | None = None) -> bool:
        """Drops all files, or one provider's."""
        if not self._next(generation):
            return False
        files = self.read("file")
        self._bury(files if provider is None else files.where(F.col("provider") == provider), generation)
        return True

    def compact(self, generation: int) -> bool:
        """Writes the live rows as one generation; those before it no longer count, and may be deleted once nobody reads them."""
        if not self._next(generation):
            return False
        for name in TABLES:
            df = self.read(name)
            (df.withColumn("deleted", F.lit(False)) if name == "file" else df).write.mode("overwrite").parquet(self._path(name, generation))
        self._close(generation, True)
        return True

    def status(self) -> DataFrame:
        """provider, files, days, events, updated_at, a row per provider and a last one of all with a null provider."""
        counts = self.read("file").groupBy("provider").agg(_count("files"), F.max("imported_at").alias("updated_at"))
        for name, table in (("days", "day"), ("events", "event")):
            counts = counts.join(self.read(table).groupBy("provider").agg(_count(name)), "provider", "left")
        counts = counts.select("provider", "files", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("days", "events")], "updated_at")
        total = counts.agg(F.lit(None).cast("string").alias("provider"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "days", "events")], F.max("updated_at").alias("updated_at"))
        return counts.unionByName(total)

    def select(self, table: str, providers: Iterable[str], since: str | None = None, until: str | None = None, subagents: bool = True) -> DataFrame:
        """Rows of a day table with the session, kind and project of their files; days included at both ends, filters reach the scans."""
        wanted = F.col("provider").isin(*providers)
        files, rows = self.read("file").where(wanted), self.read(table).where(wanted)
        if not subagents:
            files = files.where("file_kind <> 'subagent'")
        if since is not None:
            rows = rows.where(F.col("day") >= F.lit(since).cast("date"))
        if until is not None:
            rows = rows.where(F.col("day") <= F.lit(until).cast("date"))
        return rows.join(files.select(*FILE, "session_id", "file_kind", "project"), FILE)

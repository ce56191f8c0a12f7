"""What several operators of this subpackage share: stage tables, components, ordered starts."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import shared_dir

#: Stage tables of this process that are still there, in the order they were made.
_made: list[DataFrame] = []

def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again.

    That cuts the lineage: a lost executor costs its running tasks only, and two
    readers see the same rows even if df was not deterministic.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    _made.append(out)
    return out


def drop_stage(*frames: DataFrame) -> None:
    """Deletes stage tables that nothing reads any more, through Hadoop's file system."""
    for df in frames:
        path = getattr(df, "_stage_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            _made[:] = [x for x in _made if x is not df]


def mark() -> int:
    """A point in the order of stage tables, for release()."""
    return len(_made)


def release(since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Deletes the stage tables made since mark(), once nothing lazy reads them: results are written by then."""
    drop_stage(*[x for x in _made[since:] if not any(x is k for k in keep)])


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores added where a column of that name, in any case, is there already."""
    have, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Just these columns, whatever else df holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of edges(a, b): columns node, root; a stage table.

    Large-star / small-star contraction: each round is aggregations and joins on node,
    so no neighbourhood is gathered in a task; rounds grow with the log of the longest
    path, and each is a stage table. If max_rounds do not suffice, an error is raised:
    an unfinished result is never returned.
    """
    e = stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where(F.col("m") < F.col("a")).select("a", F.col("m").alias("b"))).where("a > b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(small_low.select("a", F.col("m").alias("b"))).distinct()
        done = stage(small, "edges")
        drop_stage(e)
        e = done
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.count_distinct("a")).first()
        if now == before or now[0] == now[2] and not e.join(e.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
            out = stage(roots, "components")
            drop_stage(e)
            return out
        before = now
    raise RuntimeError(f"components are not found after {max_rounds} rounds")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with sums over the rows before each one in a total order, without one window over all rows; a stage table.

    Rows are dealt by range; sums run within parts, and over one row per part.
    """
    names = list(sums)
    part, *inner = free_names(df.columns, "part", *[f"inner_{n}" for n in names])
    ranged = stage(df.withColumns(sums).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()), "running")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(part).agg(*[F.sum(n).alias(i) for n, i in zip(names, inner, strict=True)])
    totals = totals.select(part, *[F.coalesce(F.sum(i).over(before.orderBy(part)), F.lit(0)).alias(i) for i in inner])  # a row per part
    within = before.partitionBy(part).orderBy(*order)
    out = ranged.withColumns({n: F.coalesce(F.sum(n).over(within), F.lit(0)) for n in names}).join(F.broadcast(totals), part)
    out = stage(out.withColumns({n: F.col(n) + F.col(i) for n, i in zip(names, inner, strict=True)}).drop(part, *inner), "sums")
    drop_stage(ranged)
    return out


_held: dict = {}


def sole(key: tuple, make):
    """An object that a Python worker keeps between tasks, alone: workers outlive stages, and so would each stage's memory."""
    if key not in _held:
        _held.clear()
        gc.collect()
        _held[key] = make()
    return _held[key]


def text_batches(column, most_bytes: int = 2_000_000):
    """Slices (start, list of texts) of an Arrow string column; null counts as empty."""
    texts, size, start = [], 0, 0
    for k, x in enumerate(column):
        t = x.as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= most_bytes:
            yield start, texts
            texts, size, start = [], 0, k + 1
    if texts:
        yield start, texts

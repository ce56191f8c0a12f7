"""WARC records and a Merkle fixity audit of replicas.

Records lie in shards, in ascending page order, each at its offset. Leaves hash
records; a node hashes the offsets, lengths and hashes of up to FANOUT neighbours, so
moved records show as well as changed ones. Each shard has one root, and one root
stands over all shards.

A tree is stored in layers. A row of a layer is a subtree of HEIGHT levels: its root,
and in a nested column all that is below it. Two replicas are compared from the top
layer down: first only roots are read, and of a layer below only those subtrees whose
roots differ; within a subtree only differing branches are followed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import drop_stage, mark, release, stage

#: Neighbours under a node; levels in a stored subtree (FANOUT ** HEIGHT leaves at most).
FANOUT, HEIGHT = 16, 3
#: Records of a stretch, within which offsets are summed before the stretches are.
STRETCH = FANOUT**HEIGHT
DATE = "2024-01-01T00:00:00Z"


def record_bytes(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A response record; null fields count as empty."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The replica: shard, seq (place in the shard), page_id, length, record.

    Ordered by id, nulls first; ties (repeated or null ids) by length and checksum, so
    reruns agree. Null fields count as empty, repeated rows are records apiece, other
    columns are left out, an empty table has no records. The html is moved once, to its
    shard.
    """
    records = pages.select(F.col(id_col).alias("page_id"), record_bytes(F.col(id_col), F.col(url_col), F.col(html_col)).alias("record"))
    records = records.withColumn("length", F.octet_length("record").cast("long")).withColumn("tie", F.crc32("record"))
    ranged = records.repartitionByRange("page_id", "length", "tie").sortWithinPartitions("page_id", "length", "tie").withColumn("shard", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return stage(ranged.select("shard", "seq", "page_id", "length", "record"), "warc")


def leaves(replica: DataFrame) -> DataFrame:
    """shard, seq, page_id, at (offset in the shard), length, hash of every record.

    Offsets are summed in stretches, then over the stretches' totals, so that no shard
    is one task. Lengths are those of the bytes that were read.
    """
    hashed = replica.select("shard", "seq", F.floor(F.col("seq") / STRETCH).alias("stretch"), "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))
    hashed = stage(hashed, "hashed")
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = hashed.groupBy("shard", "stretch").agg(F.sum("length").alias("total"))
    totals = totals.select("shard", "stretch", F.coalesce(F.sum("total").over(before("shard").orderBy("stretch")), F.lit(0)).alias("base"))
    inner = hashed.withColumn("inner", F.coalesce(F.sum("length").over(before("shard", "stretch").orderBy("seq")), F.lit(0)))
    out = stage(inner.join(totals, ["shard", "stretch"]).select("shard", "seq", "page_id", (F.col("base") + F.col("inner")).alias("at"), "length", "hash"), "leaves")
    drop_stage(hashed)
    return out


def _subtrees(below: DataFrame) -> DataFrame:
    """shard, seq, at, length, hash, kids: roots over FANOUT ** HEIGHT nodes of shard, seq, at, length, hash.

    Nodes are dealt by subtree, and all levels are built where they lie: one shuffle.
    A group holds at most FANOUT children, of which gaps may be missing.
    """
    up = lambda k: F.floor(F.col("seq") / FANOUT**k)
    level = below.select("shard", up(3).alias("top"), up(2).alias("mid"), up(1).alias("low"), "seq", "at", "length", "hash").repartition("shard", "top")
    keys, node = ["shard", "top", "mid", "low"], ["seq", "at", "length", "hash"]
    line = lambda k: F.concat_ws(":", k["at"].cast("string"), k["length"].cast("string"), k["hash"])
    while len(keys) > 1:
        level = level.groupBy(*keys).agg(F.min("at").alias("at"), F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct(*node))).alias("kids"))
        level = level.select(*keys, "at", "length", F.sha2(F.concat_ws("\n", F.transform("kids", line)), 256).alias("hash"), "kids").withColumn("seq", F.col(keys[-1]))
        keys, node = keys[:-1], ["seq", "at", "length", "hash", "kids"]
    return level.select("shard", "seq", "at", "length", "hash", "kids")


@dataclass(frozen=True)
class Tree:
    """Leaves, then layers of stored subtrees, the last of which has one row; inner says how many layers lie within shards."""

    leaf: DataFrame
    layers: list[DataFrame]
    inner: int

    def root(self) -> str | None:
        """The hash of everything; None for an empty replica."""
        top = self.layers[-1].select("hash").first()
        return top and top[0]

    def shard_roots(self) -> DataFrame:
        """shard, hash."""
        return self.layers[self.inner - 1].select("shard", "hash")

    def drop(self) -> None:
        drop_stage(*self.layers)


def tree(leaf: DataFrame) -> Tree:
    """Layers until every shard has one root, then over the shards until one root is left.

    Their number follows from the longest shard and the number of shards.
    """
    layers = [stage(_subtrees(leaf), "layer")]
    while (layers[-1].agg(F.max("seq")).first()[0] or 0) > 0:
        layers.append(stage(_subtrees(layers[-1]), "layer"))
    inner = len(layers)
    over = layers[-1].select(F.lit(0).alias("shard"), F.col("shard").cast("long").alias("seq"), F.lit(0).cast("long").alias("at"), "length", "hash")
    layers.append(stage(_subtrees(over), "layer"))
    while (layers[-1].agg(F.max("seq")).first()[0] or 0) > 0:
        layers.append(stage(_subtrees(layers[-1]), "layer"))
    return Tree(leaf, layers, inner)


def _differ(x: Column, y: Column) -> Column:
    """Do two nodes differ, or is one not there?"""
    of = lambda n: F.when(n.isNotNull(), F.struct(n["at"], n["length"], n["hash"]))
    return ~of(x).eqNullSafe(of(y))


def _paired(rows: DataFrame) -> DataFrame:
    """shard, seq, x, y: differing children of rows' nodes x and y, paired by place within the row."""
    kids = lambda n: F.coalesce(F.col(n)["kids"], F.array())
    places = F.array_union(F.transform(kids("x"), lambda k: k["seq"]), F.transform(kids("y"), lambda k: k["seq"]))
    at = lambda n, s: F.get(F.filter(kids(n), lambda k: k["seq"] == s), F.lit(0))
    pairs = F.transform(places, lambda s: F.struct(s.alias("seq"), at("x", s).alias("x"), at("y", s).alias("y")))
    return rows.select("shard", F.explode(F.filter(pairs, lambda p: _differ(p["x"], p["y"]))).alias("p")).select("shard", "p.seq", "p.x", "p.y")


def _descend(a: DataFrame, b: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """shard, seq of differing nodes below two layers, in those subtrees that are wanted (or in all that differ)."""
    if wanted is None:
        roots = a.select("shard", "seq", F.struct("at", "length", "hash").alias("x")).join(b.select("shard", "seq", F.struct("at", "length", "hash").alias("y")), ["shard", "seq"], "full")
        wanted = roots.where(_differ(F.col("x"), F.col("y"))).select("shard", "seq")
    node = F.struct("at", "length", "hash", "kids")
    x, y = (side.join(wanted, ["shard", "seq"], "left_semi").select("shard", "seq", node.alias(n)) for side, n in ((a, "x"), (b, "y")))
    rows = x.join(y, ["shard", "seq"], "full")
    for _ in range(HEIGHT):
        rows = _paired(rows)
    return rows.select("shard", "seq")


def _bridged(t: Tree, layers: int, inner: int) -> list[DataFrame]:
    """The layers of t, with as many within shards and as many above them as asked for: roots are carried up."""

    def lifted(layer: DataFrame) -> DataFrame:
        return stage(_subtrees(layer.select("shard", "seq", "at", "length", "hash")), "layer")

    own, top = list(t.layers[: t.inner]), list(t.layers[t.inner :])
    while len(own) < inner:
        own.append(lifted(own[-1]))
    if len(own) > t.inner:  # the roots over the shards follow the shards' new roots
        over = own[-1].select(F.lit(0).alias("shard"), F.col("shard").cast("long").alias("seq"), F.lit(0).cast("long").alias("at"), "length", "hash")
        top = [stage(_subtrees(over), "layer")]
    while len(own) + len(top) < layers:
        top.append(lifted(top[-1]))
    return own + top


def damaged(a: Tree, b: Tree) -> DataFrame:
    """shard, seq of leaves that differ, are missing or are extra; found from the top down.

    Trees of different heights are brought to one height first. Equal trees, empty ones
    among them, give no rows.
    """
    inner, since = max(a.inner, b.inner), mark()
    layers = inner + max(len(t.layers) - t.inner for t in (a, b))
    la, lb = _bridged(a, layers, inner), _bridged(b, layers, inner)
    bad = None
    for k in range(layers - 1, -1, -1):
        bad = written = stage(_descend(la[k], lb[k], bad), "bad")
        if k == inner:  # what differs now are shards
            bad = bad.select(F.col("seq").cast("int").alias("shard"), F.lit(0).cast("long").alias("seq"))
    release(since, keep=[written])
    return bad


def audit(replica: DataFrame, other: DataFrame) -> DataFrame:
    """Every record of replica with its place and whether other differs there.

    Columns page_id, shard, at, offset (over all shards), length, sha256, damaged. Both
    are tables of shard, seq and record that are read from storage. Records that only
    other has are in damaged() alone. Null and repeated ids are records like any, an
    empty replica gives no rows.
    """
    la, lb = leaves(replica), leaves(other)
    ta, tb = tree(la), tree(lb)
    bad = damaged(ta, tb)
    shards = la.groupBy("shard").agg(F.sum("length").alias("total"))  # a row per shard: shards are the writer's partitions
    shards = shards.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    out = la.join(bad.withColumn("hit", F.lit(True)), ["shard", "seq"], "left").join(shards, "shard")
    ta.drop()
    tb.drop()
    drop_stage(lb)
    return out.select("page_id", "shard", "at", (F.col("base") + F.col("at")).alias("offset"), "length", F.col("hash").alias("sha256"), F.coalesce("hit", F.lit(False)).alias("damaged"))


def with_faults(replica: DataFrame, every: int) -> DataFrame:
    """A second replica, written down, in which the last byte of some records is wrong: those whose crc32 of the id, modulo every, is 0."""
    hit = F.crc32(F.encode(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "UTF-8")) % every == 0
    broken = F.concat(F.substring("record", F.lit(1), F.octet_length("record") - 1), F.encode(F.lit("X"), "UTF-8"))
    return stage(replica.withColumn("record", F.when(hit, broken).otherwise(F.col("record"))), "warc")

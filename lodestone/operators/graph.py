"""The link graph of a workspace: edges, degrees, components, cycles, reachability, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import cut, running_total


def edges(links: DataFrame, paths: DataFrame) -> DataFrame:
    """source, target, lines, occurrences of links between documents; images, external and anchor-only links are none."""
    inner = links.where(~F.col("image") & ~F.col("external") & F.col("resolved").rlike(r"(?i)\.(md|markdown)$") & ~F.col("target").startswith("#"))
    known = paths.select(F.col("path").alias("resolved")).distinct()
    return inner.join(known, "resolved", "left_semi").groupBy(F.col("path").alias("source"), F.col("resolved").alias("target")).agg(F.array_sort(F.collect_list("line")).alias("lines"), F.count("*").alias("occurrences"))


def broken(links: DataFrame, paths: DataFrame) -> DataFrame:
    """source, target, resolved, line of links to documents that do not exist."""
    inner = links.where(~F.col("image") & ~F.col("external") & F.col("resolved").rlike(r"(?i)\.(md|markdown)$"))
    return inner.join(paths.select(F.col("path").alias("resolved")).distinct(), "resolved", "left_anti").select(F.col("path").alias("source"), "target", "resolved", "line")


def missing_anchors(links: DataFrame, headings: DataFrame) -> DataFrame:
    """Local links whose fragment is no slug of an existing target."""
    local = links.where(F.col("resolved").isNotNull() & (F.col("fragment") != ""))
    there = headings.select(F.col("path").alias("resolved"), F.col("slug").alias("fragment")).distinct()
    exists = headings.select(F.col("path").alias("resolved")).distinct()
    return local.join(exists, "resolved", "left_semi").join(there, ["resolved", "fragment"], "left_anti").select("path", "line", "target")


def degrees(edge: DataFrame, paths: DataFrame) -> DataFrame:
    """path, inbound, outbound (occurrences, self-links included), dead_end."""
    into = edge.groupBy(F.col("target").alias("path")).agg(F.sum("occurrences").alias("inbound"))
    out = edge.groupBy(F.col("source").alias("path")).agg(F.sum("occurrences").alias("outbound"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return paths.select("path").join(into, "path", "left").join(out, "path", "left").select("path", zero("inbound"), zero("outbound")).withColumn("dead_end", F.col("outbound") == 0)


def orphans(edge: DataFrame, paths: DataFrame, entries: list[str] = ()) -> DataFrame:
    """Documents that nothing links to, entries aside."""
    return paths.select("path").where(~F.col("path").isin(*entries)).join(edge.select(F.col("target").alias("path")).distinct(), "path", "left_anti")


def components(edge: DataFrame, paths: DataFrame, max_rounds: int = 200) -> DataFrame:
    """path, component (smallest path that is reachable without regard to direction).

    Labels move to neighbours and then along labels themselves, so rounds grow with the
    log of the diameter.
    """
    both = edge.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edge.select(F.col("target").alias("a"), F.col("source").alias("b"))).where("a <> b").distinct()
    both = cut(both)
    label = paths.select(F.col("path").alias("n"), F.col("path").alias("c"))
    for _ in range(max_rounds):
        near = both.join(label, both["b"] == label["n"]).groupBy(F.col("a").alias("n")).agg(F.min("c").alias("m"))
        new = label.join(near, "n", "left").select("n", F.least("c", F.coalesce("m", "c")).alias("c2"), F.col("c").alias("was"))
        jump = new.select(F.col("n").alias("c2"), F.col("c2").alias("far"))
        new = cut(new.join(jump, "c2", "left").select("n", F.least("c2", F.coalesce("far", "c2")).alias("c"), "was"))
        if new.where("c <> was").isEmpty():
            return new.select(F.col("n").alias("path"), F.col("c").alias("component"))
        label = new.select("n", "c")
    raise RuntimeError("components did not settle")


def reachable(edge: DataFrame, seeds: DataFrame, depth: int | None = None, directed: bool = True) -> DataFrame:
    """path, distance of what seeds reach, breadth first; depth bounds the hops."""
    step = edge.select("source", "target")
    if not directed:
        step = step.unionByName(step.select(F.col("target").alias("source"), F.col("source").alias("target")))
    step = cut(step.distinct())
    seen = cut(seeds.select("path").distinct().withColumn("distance", F.lit(0)))
    frontier, d = seen, 0
    while depth is None or d < depth:
        d += 1
        new = frontier.join(step, frontier["path"] == step["source"]).select(F.col("target").alias("path")).distinct().join(seen.select("path"), "path", "left_anti").withColumn("distance", F.lit(d))
        frontier = cut(new)
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def cycles(edge: DataFrame, paths: DataFrame) -> DataFrame:
    """path, cycle (smallest path of its strongly connected component) for components of several documents or a self-link.

    Nodes that cannot lie on a cycle are trimmed; of the rest, the smallest unassigned
    node of each weak component colours what it reaches and is reached by, until none is left.
    """
    live = cut(edge.select("source", "target").distinct())
    selfs = live.where("source = target").select(F.col("source").alias("path"))
    live = cut(live.where("source <> target"))
    done = None
    while not live.isEmpty():
        while True:  # trim sources and sinks
            kept = live.join(live.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(live.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
            kept = cut(kept)
            if kept.count() == live.count():
                break
            live = kept
        if live.isEmpty():
            break
        nodes = live.select(F.col("source").alias("path")).unionByName(live.select(F.col("target").alias("path"))).distinct()
        weak = components(live.withColumn("occurrences", F.lit(1)), nodes)
        pivots = weak.select(F.col("component").alias("path")).distinct()
        ahead = reachable(live, pivots)
        behind = reachable(live.select(F.col("target").alias("source"), F.col("source").alias("target")), pivots)
        core = cut(ahead.select("path").join(behind.select("path"), "path", "left_semi").join(weak, "path").select("path", F.col("component").alias("cycle")))
        size = core.groupBy("cycle").agg(F.count("*").alias("n")).where("n > 1")
        found = core.join(size.select("cycle"), "cycle", "left_semi").select("path", "cycle")
        done = found if done is None else done.unionByName(found)
        gone = core.select("path")
        live = cut(live.join(gone.withColumnRenamed("path", "source"), "source", "left_anti").join(gone.withColumnRenamed("path", "target"), "target", "left_anti").select("source", "target"))
    alone = selfs.select("path", F.col("path").alias("cycle"))
    if done is None:
        return alone
    return done.unionByName(alone.join(done.select("path"), "path", "left_anti"))


def focus(edge: DataFrame, node: str, depth: int, spark=None) -> DataFrame:
    """Edges among documents within so many hops, whatever the direction."""
    seeds = edge.sparkSession.createDataFrame([(node,)], "path string")
    near = reachable(edge, seeds, depth, directed=False).select("path")
    return edge.join(near.withColumnRenamed("path", "source"), "source", "left_semi").join(near.withColumnRenamed("path", "target"), "target", "left_semi").select("source", "target", "occurrences")


def unreachable(edge: DataFrame, paths: DataFrame, entries: list[str]) -> DataFrame:
    """path of documents that no entry leads to. Entries that are no documents do not count; without any that is one, nothing is reported."""
    start = paths.select("path").distinct().where(F.col("path").isin(*entries))
    if start.isEmpty():
        return paths.select("path").where("false")
    return paths.select("path").distinct().join(reachable(edge, start).select("path"), "path", "left_anti")


def diagram(edge: DataFrame, paths: DataFrame, kind: str = "mermaid") -> DataFrame:
    """ord, place, line: the graph as a Mermaid flowchart or a DOT digraph, a row per line; sorted by ord, then place, they are the file.

    Nodes are numbered in order of path and come before the edges, which follow the order
    of their ends' numbers. No row holds more than a node or an edge.
    """
    if kind not in ("mermaid", "dot"):
        raise ValueError(f"{kind!r} is neither mermaid nor dot")
    nodes = running_total(paths.select("path").distinct().withColumn("one", F.lit(1)), [F.col("path")], "one", "n").select("path", (F.col("n") - 1).alias("n"))
    label = F.replace(F.replace("path", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    name = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    node, arrow, ends = (('["', '"]'), " --> ", ("flowchart LR", "", "")) if kind == "mermaid" else ((' [label="', '"];'), " -> ", ("digraph markdown {", ";", "}"))
    drawn = nodes.select(F.lit(1).alias("ord"), F.array("n", F.lit(0).cast("long")).alias("place"), F.concat(F.lit("  "), name("n"), F.lit(node[0]), label, F.lit(node[1])).alias("line"))
    both = edge.select("source", "target").join(nodes.select(F.col("path").alias("source"), F.col("n").alias("a")), "source").join(nodes.select(F.col("path").alias("target"), F.col("n").alias("b")), "target")
    links = both.select(F.lit(2).alias("ord"), F.array("a", "b").alias("place"), F.concat(F.lit("  "), name("a"), F.lit(arrow), name("b"), F.lit(ends[1])).alias("line"))
    frame = [(0, [0, 0], ends[0])] + ([(3, [0, 0], ends[2])] if ends[2] else [])
    return edge.sparkSession.createDataFrame(frame, "ord int, place array<long>, line string").unionByName(drawn).unionByName(links)

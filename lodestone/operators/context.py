"""Context packs: what lies around some documents of a workspace, in order, as far as a budget of bytes goes.

Documents are found breadth first over the link graph. Each keeps by which document it
was found first, and where; units (frontmatter, preamble, sections) follow the order of
discovery. The pack is a prefix of the units: nothing after the first that does not fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.extract import slug_of
from lodestone.operators.graph import broken
from lodestone.operators.ordered import cut, running_total

SEED, LINK, BACKLINK = "seed", "link", "backlink"
ORDER = ["distance", "key", "unit"]


def seed_rows(spark: SparkSession, seeds: list[str | tuple[str, str]], children: bool = False) -> DataFrame:
    """path, ord, heading, slug, children of seeds given by name: a path, or a path and the heading of a section."""
    pairs = [(s, None) if isinstance(s, str) else s for s in seeds]
    rows = [(path, k, heading and heading.lower(), heading and slug_of(heading), children) for k, (path, heading) in enumerate(pairs)]
    return spark.createDataFrame(rows, "path string, ord long, heading string, slug string, children boolean")


def backlink_seeds(links: DataFrame, target: str) -> DataFrame:
    """Seeds: the documents with a reference to target, in order of path. links has path and resolved."""
    found = links.where(F.col("resolved") == target).select("path").distinct()
    none = F.lit(None).cast("string")
    return found.select("path", F.lit(0).cast("long").alias("ord"), none.alias("heading"), none.alias("slug"), F.lit(False).alias("children"))


def select(edge: DataFrame, seeds: DataFrame, depth: int, backlinks: bool = False) -> DataFrame:
    """path, distance, key, via, via_line, direction, heading, slug, children of the seeds and what is found from them.

    A document belongs to its first discovery: at the least distance, from the document
    that was found first, along a link before against one, in order of path. key holds
    the steps that led to it, so that keys of one distance compare as discoveries do, and
    no round needs to number anything. edge has source, target and lines in order.
    """
    out = edge.select(F.col("source").alias("from"), F.col("target").alias("path"), F.get("lines", F.lit(0)).alias("via_line"), F.lit(LINK).alias("direction"))
    if backlinks:
        out = out.unionByName(edge.select(F.col("target").alias("from"), F.col("source").alias("path"), F.get("lines", F.lit(0)).alias("via_line"), F.lit(BACKLINK).alias("direction")))
    step = cut(out.withColumn("step", F.concat(F.when(F.col("direction") == LINK, "0").otherwise("1"), "path")))
    start = F.array(F.concat(F.lpad(F.col("ord").cast("string"), 19, "0"), "path"))
    first = seeds.withColumn("key", start).groupBy("path").agg(F.min_by(F.struct("key", "heading", "slug", "children"), "key").alias("s"))
    none = F.lit(None)
    found = cut(first.select("path", F.lit(0).alias("distance"), "s.key", none.cast("string").alias("via"), none.cast("int").alias("via_line"), F.lit(SEED).alias("direction"), "s.heading", "s.slug", "s.children"))
    frontier = found
    for distance in range(1, depth + 1):
        ahead = frontier.select(F.col("path").alias("from"), "key").join(step, "from")
        ahead = ahead.select("path", F.struct(F.concat("key", F.array("step")).alias("key"), F.col("from").alias("via"), "via_line", "direction").alias("d"))
        new = ahead.groupBy("path").agg(F.min_by("d", "d.key").alias("d")).join(found.select("path"), "path", "left_anti")
        string, flag = none.cast("string"), none.cast("boolean")
        frontier = cut(new.select("path", F.lit(distance).alias("distance"), "d.key", "d.via", "d.via_line", "d.direction", string.alias("heading"), string.alias("slug"), flag.alias("children")))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    return found


def units(parsed: DataFrame, selected: DataFrame, frontmatter: bool = False) -> DataFrame:
    """A row per unit: id, kind, file, heading, slug, depth, start_line, end_line, bytes, content, its place, and how its document was found.

    parsed holds content. A document's units are disjoint: its frontmatter on demand, what
    stands before its first heading, and a section per heading up to the next of any
    depth. A seed that names a heading gives that section only, with children also those
    below it; if there is no such section it gives none. Bytes are UTF-8.
    """
    doc = parsed.select("path", "n_lines", "frontmatter_end", F.split("content", "\n").alias("_lines"), F.filter("headings", lambda h: h["line"] > F.col("frontmatter_end")).alias("_heads"))
    df = doc.join(selected, "path")
    null, fm = F.lit(None).cast("string"), F.col("frontmatter_end")

    def unit(kind, heading, slug, depth, first, last):
        content = F.array_join(F.slice("_lines", first, F.greatest(last - first + 1, F.lit(0))), "\n")
        return F.struct(F.lit(kind).alias("kind"), heading.alias("heading"), slug.alias("slug"), depth.cast("int").alias("depth"), first.cast("int").alias("start_line"), last.cast("int").alias("end_line"), content.alias("content"))

    def end(k):
        return F.coalesce(F.get("_heads", k + 1)["line"], F.col("n_lines") + 1) - 1

    parts = F.transform("_heads", lambda h, k: unit("section", h["text"], h["slug"], h["depth"], h["line"], end(k)))
    before = F.coalesce(F.get("_heads", F.lit(0))["line"], F.col("n_lines") + 1) - 1
    preamble = F.when(before > fm, F.array(unit("preamble", null, null, F.lit(0), fm + 1, before)))
    df = df.withColumn("_body", F.concat(F.coalesce(preamble, F.array().cast(df.select(preamble.alias("x")).schema["x"].dataType)), parts))
    named = F.transform("_body", lambda s, k: F.when((s["kind"] == "section") & ((F.lower(s["heading"]) == F.col("heading")) | (s["slug"] == F.col("slug"))), k))
    df = df.withColumn("_at", F.array_min(F.filter(named, lambda k: k.isNotNull())))
    after = F.transform("_body", lambda s, k: F.when((k > F.col("_at")) & (~F.col("children") | (s["depth"] <= F.get("_body", F.col("_at"))["depth"])), k))
    df = df.withColumn("_to", F.coalesce(F.array_min(F.filter(after, lambda k: k.isNotNull())), F.size("_body")))
    chosen = F.when(F.col("heading").isNull(), F.col("_body")).when(F.col("_at").isNull(), F.array().cast(df.schema["_body"].dataType)).otherwise(F.slice("_body", F.col("_at") + 1, F.col("_to") - F.col("_at")))
    if frontmatter:
        head = F.when(fm > 0, F.array(unit("frontmatter", null, null, F.lit(0), F.lit(1), fm)))
        chosen = F.concat(F.coalesce(head, F.array().cast(df.schema["_body"].dataType)), chosen)
    rows = df.select(F.col("path").alias("file"), "distance", "key", "via", "via_line", "direction", F.posexplode(chosen).alias("unit", "u"))
    name = F.concat("file", F.lit("#"), F.coalesce("u.slug", "u.kind"))
    return rows.select("file", "distance", "key", "via", "via_line", "direction", "unit", "u.*", name.alias("id"), F.octet_length("u.content").cast("long").alias("bytes"))


def reason(rows: DataFrame) -> DataFrame:
    """Adds reason: how a unit's document was found, in words. Fixed texts."""
    hops = F.concat(F.col("distance").cast("string"), F.lit(" hop(s) from a seed"))
    line = F.coalesce("via_line", F.lit(0)).cast("string")
    back = F.concat(F.lit("Links to "), "via", F.lit(" at line "), line, F.lit(", "), hops)
    along = F.concat(F.lit("Linked to from "), "via", F.lit(":"), line, F.lit(", "), hops)
    return rows.withColumn("reason", F.when(F.col("direction") == SEED, "Requested as a seed").when(F.col("direction") == BACKLINK, back).otherwise(along))


def pack(parsed: DataFrame, edge: DataFrame, seeds: DataFrame, depth: int = 1, budget: int = 0, backlinks: bool = False, frontmatter: bool = False) -> DataFrame:
    """units() of everything that is found, with running (bytes up to and with each) and included.

    Sorted by ORDER, the rows are the pack and then what was left out for its budget. A
    budget of 0 is none.
    """
    rows = units(parsed, select(edge, seeds, depth, backlinks), frontmatter)
    total = running_total(rows, [F.col(c) for c in ORDER], "bytes", "running")
    return reason(total.withColumn("included", F.lit(budget <= 0) | (F.col("running") <= budget)))


def summary(packed: DataFrame, budget: int = 0) -> DataFrame:
    """One row: files, units, used and omitted bytes, a token estimate (a token per four bytes), whether anything was left out."""
    used = F.coalesce(F.sum(F.when(F.col("included"), F.col("bytes"))), F.lit(0))
    return packed.agg(
        F.count_distinct(F.when(F.col("included"), F.col("file"))).alias("files"),
        F.count_if("included").alias("units"),
        F.lit(budget if budget > 0 else None).cast("long").alias("limit_bytes"),
        used.alias("used_bytes"),
        F.coalesce(F.sum(F.when(~F.col("included"), F.col("bytes"))), F.lit(0)).alias("omitted_bytes"),
        F.ceil(used / 4).cast("long").alias("token_estimate"),
        F.coalesce(F.bool_or(~F.col("included")), F.lit(False)).alias("truncated"),
    )


def broken_links(links: DataFrame, paths: DataFrame, selected: DataFrame) -> DataFrame:
    """source, target, resolved, line of links to documents that do not exist, from documents that were found."""
    return broken(links, paths).join(selected.select(F.col("path").alias("source")), "source", "left_semi")

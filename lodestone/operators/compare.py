"""Comparisons of two revisions or trees, baselines, overlays: full outer joins over ranked keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_by_keys(before: DataFrame, after: DataFrame, within: list[str], passes: list[list[str]], order: list[str]) -> DataFrame:
    """Pairs rows of both sides pass by pass: equal keys in order of place; what a pass leaves goes to the next.

    Columns: within, o (struct of the old row or null), n (struct of the new row or null), pass (0-based, null if unpaired).
    Equal rows are told apart by their place, so each is paired once.

    Both sides are read once and dealt by within; every pass is windows inside that deal, so
    the plan grows by a sort for each, not by a join. In a pass, the k-th free old row of a
    key meets its k-th free new row if both sides have that many.
    """
    keys = [c for c in dict.fromkeys(c for one in passes for c in one) if c not in within]
    kind = {"o": F.struct(*[F.col(f"`{c}`") for c in before.columns]), "n": F.struct(*[F.col(f"`{c}`") for c in after.columns])}
    types = {"o": before.select(kind["o"].alias("x")).schema["x"].dataType, "n": after.select(kind["n"].alias("x")).schema["x"].dataType}

    def side(df: DataFrame, own: str) -> DataFrame:
        rows = [kind[x].alias(x) if x == own else F.lit(None).cast(types[x]).alias(x) for x in types]
        last = F.to_json(kind[own])
        return df.select(*within, *keys, *rows, F.lit(own).alias("_side"), F.struct(*order, last).alias("_order"))

    both = side(before, "o").unionByName(side(after, "n")).repartition(*within)
    both = both.withColumn("_place", F.row_number().over(Window.partitionBy(*within, "_side").orderBy("_order"))).drop("_order")
    both = both.withColumns({"pass": F.lit(None).cast("int"), "_first": F.lit(None).cast("int"), "_nth": F.lit(None).cast("int")})
    for k, own in enumerate(passes):
        group = [*within, *[c for c in own if c not in within], F.col("pass").isNull()]
        nth = F.row_number().over(Window.partitionBy(*group, "_side").orderBy("_place"))
        all_ = Window.partitionBy(*group)
        olds, news = F.count("o").over(all_), F.count("n").over(all_)
        first = F.min(F.when(F.col("_side") == "o", F.col("_place"))).over(all_)
        both = both.withColumns({"_k": nth, "_both": F.least(olds, news), "_f": first})
        hit = F.col("pass").isNull() & (F.col("_k") <= F.col("_both"))
        both = both.withColumns({"_nth": F.when(hit, F.col("_k")).otherwise(F.col("_nth")), "_first": F.when(hit, F.col("_f")).otherwise(F.col("_first")), "pass": F.when(hit, F.lit(k)).otherwise(F.col("pass"))})
    alone = F.when(F.col("pass").isNull(), F.struct("_side", "_place"))
    pairs = both.groupBy(*within, "pass", "_first", "_nth", alone.alias("_alone")).agg(F.first("o", ignorenulls=True).alias("o"), F.first("n", ignorenulls=True).alias("n"))
    return pairs.select(*within, "o", "n", "pass")


def change_kind(pairs: DataFrame, changed: Column) -> DataFrame:
    """Adds kind: added, removed, changed or same."""
    return pairs.withColumn("kind", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(changed, "changed").otherwise("same"))


def heading_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, kind, old_slug, new_slug of headings: by slug, then by text, then by place."""
    place = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("line")))
    pairs = pair_by_keys(place(before), place(after), ["path"], [["slug"], ["text"], ["place"]], ["line"])
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o.text") != F.col("n.text"), "renamed").when(F.col("o.depth") != F.col("n.depth"), "changed").when(F.col("o.place") != F.col("n.place"), "moved").otherwise("same")
    return pairs.select("path", kind.alias("kind"), F.col("o.slug").alias("old_slug"), F.col("n.slug").alias("new_slug")).where("kind <> 'same'")


def task_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tasks by their text whatever its case and blanks; a flipped checkbox is a change."""
    key = lambda df: df.withColumn("k", F.lower(F.regexp_replace(F.trim("text"), r"\s+", " ")))
    out = change_kind(pair_by_keys(key(before), key(after), ["path"], [["k"]], ["line"]), F.col("o.checked") != F.col("n.checked"))
    return out.where("kind <> 'same'").select("path", "kind", F.coalesce("n.text", "o.text").alias("text"), F.col("o.checked").alias("old_checked"), F.col("n.checked").alias("new_checked"))


def value_changes(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Flat key-value rows of both sides: added, removed, changed."""
    a, b = before.select(*key, F.col(value).alias("old"), F.lit(True).alias("_o")), after.select(*key, F.col(value).alias("new"), F.lit(True).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, key, "full").withColumn("kind", kind).where("kind is not null").select(*key, "kind", "old", "new")


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, status: added, removed, modified, unchanged, by the digest of the content."""
    a, b = before.select("path", F.sha2("content", 256).alias("x")), after.select("path", F.sha2("content", 256).alias("y"))
    return a.join(b, "path", "full").select("path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") == F.col("y"), "unchanged").otherwise("modified").alias("status"))


def tree_compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, state: missing, changed (content or mode), unmanaged, ok. Both have path, digest, mode."""
    a, b = expected.select("path", F.struct("digest", "mode").alias("e")), actual.select("path", F.struct("digest", "mode").alias("f"))
    return a.join(b, "path", "full").select("path", F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "unmanaged").when(F.col("e") != F.col("f"), "changed").otherwise("ok").alias("state"))


def tree_digest(tree: DataFrame, by: list[str]) -> DataFrame:
    """sha256 over path, mode and digest of each file, in order of path."""
    line = F.concat_ws(" ", "path", "mode", "digest")
    return tree.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("tree"))


def overlay(base: DataFrame, top: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """The top's row wins where both have a key."""
    a, b = base.select(*key, F.struct(*values).alias("a")), top.select(*key, F.struct(*values).alias("b"))
    return a.join(b, key, "full").withColumn("w", F.coalesce("b", "a")).select(*key, *[F.col(f"w.{v}").alias(v) for v in values])


def nearest(rows: DataFrame, name: str, distance: str) -> DataFrame:
    """Per name the row of the least distance, and how many it hides."""
    w = Window.partitionBy(name)
    return rows.withColumn("_n", F.row_number().over(w.orderBy(distance))).withColumn("shadows", F.count("*").over(w) - 1).where("_n = 1").drop("_n")


def case_collisions(rows: DataFrame, path: str) -> DataFrame:
    """Paths that differ in case only."""
    return rows.groupBy(F.lower(path).alias("folded")).agg(F.count_distinct(path).alias("paths")).where("paths > 1")


# Findings.

FINDING_KEY = ["checker", "file", "message"]


def build_baseline(findings: DataFrame) -> DataFrame:
    return findings.groupBy(*FINDING_KEY).agg(F.count("*").alias("count"))


def beyond_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that the baseline's counts do not cover, in their order."""
    n = F.row_number().over(Window.partitionBy(*FINDING_KEY).orderBy("ord"))
    known = baseline.select(*FINDING_KEY, F.col("count").alias("_allowed"))
    return findings.withColumn("_n", n).join(known, FINDING_KEY, "left").where(F.col("_n") > F.coalesce("_allowed", F.lit(0))).drop("_n", "_allowed")


def without_superseded(findings: DataFrame, winner: str, loser: str) -> DataFrame:
    """Drops the loser's findings at a place that the winner reports as well."""
    place = findings.where(F.col("checker") == winner).select("file", "line").distinct().withColumn("checker", F.lit(loser))
    return findings.join(place, ["file", "line", "checker"], "left_anti").select(findings.columns)


def overlaps(edits: DataFrame) -> DataFrame:
    """Edits that start before the one before them in the file ends; only neighbours are compared."""
    before = F.lag("end").over(Window.partitionBy("file").orderBy("start", "end", "rule"))
    return edits.withColumn("_e", before).where(F.col("_e") > F.col("start")).drop("_e")


def apply_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """file, content with the edits applied from the back; ranges are 0-based and half open.

    What of a range lies beyond the content's end is at its end, so no edit is lost in a
    text shorter than it was planned for. Content that is null stays null.
    """
    per = edits.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "end", "value")), asc=False).alias("_e"))
    # an edit nearer the end has left what lies before it, so places are held to the length of the content as given
    within = lambda at: F.least(at, F.length("content"))
    done = F.aggregate("_e", F.col("content"), lambda s, e: F.concat(F.substring(s, F.lit(1), within(e["start"])), e["value"], F.substring(s, within(e["end"]) + 1, F.length(s))))
    per = per.withColumnRenamed("file", "_file")
    out = documents.join(per, F.col("file").eqNullSafe(F.col("_file")), "left")
    return out.select("file", F.when(F.col("_e").isNull(), F.col("content")).otherwise(done).alias("content"))

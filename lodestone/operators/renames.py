"""Renames of headings and files, and canonical links, as edits: file, line, start, end, expected, value, rule.

Edits are what edits.conflicts() judges and compare.apply_edits() applies; ranges count
characters. A link's destination is rewritten in the style it was written in. parsed is
parse_documents(raw, keep=("content",)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import percent_encode, replace_fragment
from lodestone.operators import extract as E

EDIT = ["file", "line", "start", "end", "expected", "value", "rule"]
#: Characters besides letters and digits that stay as they are in an escaped path. Fixed values.
_PATH_CHARACTERS = ";/?:@&=+$,"


def heading_renames(spark: SparkSession, renames: list[tuple[str, str, str]]) -> DataFrame:
    """path, heading, slug, new of (path, heading or slug, new text) triples, one for a document."""
    return spark.createDataFrame([(p, h.lower(), E.slug_of(h), new) for p, h, new in renames], "path string, heading string, slug string, new string")


def _steps(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def relative(folder: Column, target: Column) -> Column:
    """The way from a folder (an array of steps) to a file (another one), as a path."""
    differs = F.filter(F.transform(F.zip_with(folder, target, lambda a, b: ~a.eqNullSafe(b)), lambda d, k: F.when(d, k)), lambda k: k.isNotNull())
    common = F.coalesce(F.array_min(differs), F.size(folder))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(folder) - common), F.slice(target, common + 1, F.greatest(F.size(target) - common, F.lit(0)))), "/")


def escaped_path(path: Column) -> Column:
    """Percent escapes of what a path may not hold, # among it; slashes and other separators stay."""
    out = percent_encode(path)
    for c in _PATH_CHARACTERS:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def in_style(path: Column, old: Column) -> Column:
    """A new path in the style of an old target: with ./ or percent escapes if that has them, with its query and fragment."""
    bare = F.regexp_extract(old, r"^[^?#]*", 0)
    dotted = F.when(bare.startswith("./") & ~path.startswith("."), F.concat(F.lit("./"), path)).otherwise(path)
    return F.concat(F.when(bare.contains("%"), escaped_path(dotted)).otherwise(dotted), F.substring(old, F.length(bare) + 1, F.length(old)))


def _local_links(parsed: DataFrame) -> DataFrame:
    """path, the link's fields, resolved, fragment (decoded) of links that are not external; a destination that several links share is there once."""
    rows = E.resolved(E.rows_of(parsed, "links").where(~F.col("external")))
    plain = F.replace("fragment", F.lit("+"), F.lit("%2B"))
    rows = rows.withColumn("fragment", F.coalesce(F.try_url_decode(plain), "fragment"))
    return rows.dropDuplicates(["path", "start", "end"])


def _edits(rows: DataFrame, value: Column, rule: str) -> DataFrame:
    out = rows.select(F.col("path").alias("file"), F.col("destination_line").alias("line"), "start", "end", F.col("target").alias("expected"), value.alias("value"), F.lit(rule).alias("rule"))
    return out.where(F.col("value").isNotNull() & (F.col("value") != F.col("expected")))


def rename_headings(parsed: DataFrame, renames: DataFrame) -> DataFrame:
    """Edits that give headings new texts and follow them in the links of all documents.

    renames is what heading_renames() makes: of each document the first heading that has
    the text, whatever its case, or the slug. Slugs are numbered anew in the renamed
    document, so links to its other headings follow, too. Documents without such a
    heading are left alone.
    """
    named = parsed.join(renames, "path")
    hit = F.filter("headings", lambda h: (F.lower(h["text"]) == F.col("heading")) | (h["slug"] == F.col("slug")))
    named = named.withColumn("h", F.get(hit, F.lit(0))).where("h is not null")
    lines = F.split("content", "\n")
    line = F.get(lines, F.col("h.line") - 1)
    mark = F.length(F.regexp_extract(line, r"^ *(#{1,6}[ \t]+)?", 0))
    body = F.substring(line, mark + 1, F.length(line))
    text = F.regexp_replace(body, r"([ \t]+#+)?[ \t\r]*$", "")
    before = F.length(F.array_join(F.slice(lines, 1, F.col("h.line") - 1), "\n")) + F.when(F.col("h.line") > 1, 1).otherwise(0)
    own = named.select("path", "content", "headings", "new", F.col("h.line").alias("line"), (before + mark).alias("start"), text.alias("expected")).withColumn("end", F.col("start") + F.length("expected"))
    head = own.select(F.col("path").alias("file"), "line", "start", "end", "expected", F.col("new").alias("value"), F.lit("rename-heading").alias("rule"))
    after = own.select("path", F.concat(F.substring("content", F.lit(1), F.col("start")), "new", F.substring("content", F.col("end") + 1, F.length("content"))).alias("content"))
    again = E.parse_documents(after).select("path", F.transform("headings", lambda h: h["slug"]).alias("news"))
    both = own.join(again, "path").select("path", "start", "end", F.explode(F.arrays_zip(F.transform("headings", lambda h: h["slug"]).alias("old"), F.col("news").alias("new"))).alias("s"))
    moved = both.where("s.old <> s.new").select(F.col("path").alias("resolved"), F.col("s.old").alias("fragment"), F.col("s.new").alias("slug"), F.col("start").alias("h_start"), F.col("end").alias("h_end"))
    links = _local_links(parsed).join(moved, ["resolved", "fragment"])
    inside = (F.col("path") == F.col("resolved")) & (F.col("start") >= F.col("h_start")) & (F.col("start") < F.col("h_end"))
    return head.unionByName(_edits(links.where(~inside), replace_fragment(F.col("target"), F.col("slug")), "rename-heading"))


def _rewritten(links: DataFrame, at: Column, to: Column, root_relative: Column) -> Column:
    """The target that leads from the document at a path to a file at another, in the old one's style; null where nothing is to be done."""
    folder = _steps(F.regexp_replace(at, r"[^/]*$", ""))
    path = F.when(F.col("target").startswith("/"), F.when(root_relative, F.concat(F.lit("/"), to))).otherwise(relative(folder, _steps(to)))
    path = F.when(path == "", F.regexp_extract(to, r"[^/]*$", 0)).otherwise(path)
    return F.when(~F.col("target").rlike(r"^[?#]|^$"), in_style(path, F.col("target")))


def rename_files(parsed: DataFrame, moves: DataFrame) -> DataFrame:
    """Edits that keep links right when documents move: moves has source and destination, a source once.

    Links to a moved file lead to where it goes, and a moved document's own relative links
    are counted from there, also those to files that do not exist. Root-relative links
    change only if their file moves. Edits name the documents by their old paths.
    """
    goes = moves.select(F.col("source").alias("resolved"), F.col("destination").alias("_to"))
    own = moves.select(F.col("source").alias("path"), F.col("destination").alias("_at"))
    links = _local_links(parsed).join(goes, "resolved", "left").join(own, "path", "left").where("_to is not null or _at is not null")
    value = _rewritten(links, F.coalesce("_at", "path"), F.coalesce("_to", "resolved"), F.col("_to").isNotNull())
    return _edits(links, value, "rename-file")


def canonical_links(parsed: DataFrame) -> DataFrame:
    """Edits that write local links the shortest way, without changing where they lead or their style."""
    links = _local_links(parsed).where(~F.col("anchor"))
    return _edits(links, _rewritten(links, F.col("path"), F.col("resolved"), F.lit(True)), "relative-links")

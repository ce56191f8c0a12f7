"""Facets of a comparison of two revisions of documents: headings with bodies, links, code, tables, nested frontmatter, totals.

Both sides are parsed documents with path and, where bodies are compared, content. All facets
have path, kind, old_line and new_line; within_file() orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone.operators import extract as E
from lodestone.operators.compare import change_kind, pair_by_keys

#: Order of kinds on one line. Fixed values.
KINDS = ("added", "changed", "moved", "removed", "renamed")


def within_file() -> list[Column]:
    """Sort keys of changes: the new line (else the old one), then the kind."""
    kind = F.lit(len(KINDS))
    for k, name in enumerate(KINDS):
        kind = F.when(F.col("kind") == name, k).otherwise(kind)
    return [F.coalesce("new_line", "old_line", F.lit(0)), kind]


def heading_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, kind, slugs, lines, matched_by, heuristic, body_changed of headings that differ.

    Paired by slug, then by text, then by place (depth, headings above, number among its
    siblings). Only the last one is a guess: heuristic is true for its renames. A heading that
    keeps its text and place but whose own body differs is changed.
    """

    def rows(parsed: DataFrame) -> DataFrame:
        real = F.filter("tree", lambda h: h["line"] > F.col("frontmatter_end"))
        heads = parsed.select("path", F.posexplode(real).alias("place", "x")).select("path", "place", "x.line", "x.depth", "x.slug", "x.ordinal", fn.normal_text(F.col("x.text")).alias("t"), F.transform("x.parents", fn.normal_text).alias("parents"))
        return heads.join(E.section_bodies(parsed).select("path", "line", F.sha2("body", 256).alias("body")), ["path", "line"])

    pairs = pair_by_keys(rows(before), rows(after), ["path"], [["slug"], ["t"], ["depth", "parents", "ordinal"]], ["line"])
    body = F.col("o.body") != F.col("n.body")
    renamed = F.col("o.t") != F.col("n.t")
    moved = (F.col("o.place") != F.col("n.place")) | (F.col("o.depth") != F.col("n.depth"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(renamed, "renamed").when(moved, "moved").when(body, "changed")
    matched = F.when(F.col("pass") == 0, "slug").when(F.col("pass") == 1, "text").when(F.col("pass") == 2, "position")
    out = pairs.select(
        "path", kind.alias("kind"), F.col("o.slug").alias("old_slug"), F.col("n.slug").alias("new_slug"), F.col("o.line").alias("old_line"), F.col("n.line").alias("new_line"),
        matched.alias("matched_by"), F.when(kind == "renamed", F.col("pass") == 2).alias("heuristic"), F.coalesce(body, F.lit(False)).alias("body_changed"),
    )
    return out.where("kind is not null")


def link_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Links by text and target, then by text, then by target, each in order of appearance; a pair is a change if its target differs.

    fragment_changed: the same document, another place in it.
    """

    def rows(parsed: DataFrame) -> DataFrame:
        links = E.resolved(parsed.select("path", F.posexplode("links").alias("place", "x")).select("path", "place", "x.*"))
        local = ~F.col("external") & ~F.col("anchor")
        bare = F.when(local, F.regexp_replace("target", r"[?#].*$", "")).otherwise(F.col("target"))
        return links.select("path", "line", "text", "target", F.when(local, F.col("resolved")).alias("resolved"), F.when(local, F.col("fragment")).alias("fragment"), bare.alias("bare"), "place")

    pairs = pair_by_keys(rows(before), rows(after), ["path"], [["text", "target"], ["text"], ["target"]], ["place"])
    out = change_kind(pairs, F.col("o.target") != F.col("n.target")).where("kind <> 'same'")
    fragment = (F.col("o.bare") == F.col("n.bare")) & ~F.col("o.fragment").eqNullSafe(F.col("n.fragment"))
    return out.select(
        "path", "kind", F.coalesce("n.text", "o.text").alias("text"), F.col("o.target").alias("old_target"), F.col("n.target").alias("new_target"), F.col("o.resolved").alias("old_resolved"), F.col("n.resolved").alias("new_resolved"),
        F.col("o.line").alias("old_line"), F.col("n.line").alias("new_line"), F.coalesce(fragment, F.lit(False)).alias("fragment_changed"),
    )


def code_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Code blocks by language and content, then by content, then by language."""
    rows = lambda p: E.rows_of(p.select("path", "code_blocks"), "code_blocks").withColumn("lang", F.coalesce("language", F.lit("")))
    pairs = pair_by_keys(rows(before), rows(after), ["path"], [["lang", "content"], ["content"], ["lang"]], ["line"])
    lang, content = F.col("o.lang") != F.col("n.lang"), F.col("o.content") != F.col("n.content")
    diagram = (F.lower("o.lang") == "mermaid") | (F.lower("n.lang") == "mermaid")
    return change_kind(pairs, lang | content).where("kind <> 'same'").select(
        "path", "kind", F.col("o.language").alias("old_language"), F.col("n.language").alias("new_language"), F.col("o.line").alias("old_line"), F.col("n.line").alias("new_line"),
        F.coalesce(lang, F.lit(False)).alias("language_changed"), F.coalesce(content, F.lit(False)).alias("content_changed"), F.coalesce(diagram, F.lit(False)).alias("mermaid"),
    )


def table_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Tables by headers, then by the number of columns; a pair is a change if headers or rows differ."""
    rows = lambda p: E.rows_of(p.select("path", "tables"), "tables").select("path", "line", "headers", "n_columns", "n_rows")
    pairs = pair_by_keys(rows(before), rows(after), ["path"], [["headers"], ["n_columns"]], ["line"])
    headers = F.col("o.headers") != F.col("n.headers")
    return change_kind(pairs, headers | (F.col("o.n_rows") != F.col("n.n_rows"))).where("kind <> 'same'").select(
        "path", "kind", F.col("o.line").alias("old_line"), F.col("n.line").alias("new_line"), F.col("o.n_columns").alias("old_columns"), F.col("n.n_columns").alias("new_columns"),
        F.col("o.n_rows").alias("old_rows"), F.col("n.n_rows").alias("new_rows"), F.coalesce(headers, F.lit(False)).alias("headers_changed"),
    )


def frontmatter_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, kind, key, old, new by dotted key, lists being leaves.

    Where the header's status differs, that is the only change, without a key. Values are
    compared and returned as JSON; documents of one side only have none.
    """
    both = before.select("path", F.col("frontmatter_status").alias("os"), F.col("frontmatter").alias("of")).join(after.select("path", F.col("frontmatter_status").alias("ns"), F.col("frontmatter").alias("nf")), "path")
    status = both.where("os <> ns").select("path", F.lit("changed").alias("kind"), F.lit(None).cast("string").alias("key"), F.col("os").alias("old"), F.col("ns").alias("new"))
    leaves = F.udf(_leaves, "map<string,string>", useArrow=True)
    pairs = both.where("os = 'valid' and ns = 'valid' and not (of <=> nf)").select("path", leaves("of").alias("a"), leaves("nf").alias("b"))
    keys = pairs.select("path", "a", "b", F.explode(F.array_union(F.map_keys("a"), F.map_keys("b"))).alias("key"))
    old, new = F.try_element_at("a", F.col("key")), F.try_element_at("b", F.col("key"))
    kind = F.when(~F.map_contains_key("a", F.col("key")), "added").when(~F.map_contains_key("b", F.col("key")), "removed").when(~old.eqNullSafe(new), "changed")
    return status.unionByName(keys.select("path", kind.alias("kind"), "key", old.alias("old"), new.alias("new")).where("kind is not null"))


def _leaves(source: str | None) -> dict[str, str]:
    """Dotted keys of a JSON object to the JSON of what stands there."""
    import json

    out: dict[str, str] = {}
    todo = [("", json.loads(source) if source else {})]
    while todo:
        prefix, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{prefix}.{k}" if prefix else k, v) for k, v in value.items()]
        elif prefix:
            out[prefix] = json.dumps(value, ensure_ascii=False)
    return out


def file_status(before: DataFrame, after: DataFrame, changes: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """path, old_path, status: added, removed, renamed, modified, unchanged.

    changes holds a path for every change of a facet; renames (old_path, path) says which
    documents go by a new name. Without any change of a facet a document is unchanged, whatever its bytes.
    """
    a = before.select(F.col("path").alias("old_path"))
    if renames is None:
        a = a.withColumn("path", F.col("old_path"))
    else:
        a = a.join(renames.select("old_path", "path"), "old_path", "left").withColumn("path", F.coalesce("path", "old_path"))
    touched = changes.select("path").distinct().withColumn("_touched", F.lit(True))
    both = a.join(after.select("path", F.lit(True).alias("_new")), "path", "full").join(touched, "path", "left")
    status = F.when(F.col("old_path").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("old_path") != F.col("path"), "renamed").when(F.col("_touched"), "modified").otherwise("unchanged")
    return both.select("path", "old_path", status.alias("status"))


def totals(facets: dict[str, DataFrame]) -> DataFrame:
    """facet, changes, files: how many changes each facet has, in how many documents. A facet without any has a row of zeros."""
    out = None
    for name, df in facets.items():
        one = df.agg(F.lit(name).alias("facet"), F.count("*").alias("changes"), F.count_distinct("path").alias("files"))
        out = one if out is None else out.unionByName(one)
    return out

"""Folders, snapshots, sinks, edit plans and the facets' corner cases on small literal rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone.operators import compare, diffs, edits, extract, query
from lodestone.sources import files, sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    for name, text in {"a.md": "# A\r\nx", "b/c.md": "y", "empty.md": "", "b/d e.markdown": "z", "node_modules/m.md": "no", "b/pic.PNG": "p", "b/n+1.txt": "t"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, newline="")
    return str(root)


def names(df):
    return sorted(r.path for r in df.collect())


def test_folders(spark, folder):
    assert {r.path: r.content for r in files.documents(spark, folder).collect()} == {"a.md": "# A\r\nx", "b/c.md": "y", "b/d e.markdown": "z"}
    assert names(files.documents(spark, folder, exclude=["b/**"])) == ["a.md"]
    assert names(files.listing(spark, folder)) == ["a.md", "b/c.md", "b/d e.markdown", "b/n+1.txt", "b/pic.PNG"]
    assert names(files.assets(spark, folder, ["png", ".TXT"])) == ["b/n+1.txt", "b/pic.PNG"]
    assert names(files.inputs(spark, folder, ["a.md", "b", "*.md"])) == ["a.md", "b/c.md", "b/d e.markdown"]
    assert names(files.inputs(spark, folder, ["b/*.md", "x/*.md"])) == ["b/c.md"]
    assert names(files.inputs(spark, folder, [], changed=spark.createDataFrame([("a.md",), ("q.md",)], "path string"))) == ["a.md"]
    with pytest.raises(FileNotFoundError):
        files.inputs(spark, folder, ["gone.md"])


@pytest.mark.parametrize(
    "glob,yes,no",
    [("**/*.md", ["a.md", "x/y/a.md"], ["a.mdx", "amd"]), ("*.md", ["a.md"], ["x/a.md"]), ("d/**", ["d/a", "d/e/f"], ["e/a"]), ("?.{md,txt}", ["a.md", "b.txt"], ["ab.md", "a.rs"]), ("[!a]x", ["bx"], ["ax", "/x"]), ("a+b.md", ["a+b.md"], ["aab.md"])],
)
def test_globs(glob, yes, no):
    import re

    assert [bool(re.match(files.glob_pattern(glob), x)) for x in yes + no] == [True] * len(yes) + [False] * len(no)


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "4")], "path string, content string")
    new = spark.createDataFrame([("a", "9"), ("x", "2"), ("e", "5"), ("d", "4")], "path string, content string")
    assert {tuple(r) for r in files.changes_between(old, new).select("path", "old_path", "status").collect()} == {("a", "a", "M"), ("x", "b", "R"), ("c", "c", "D"), ("e", None, "A")}
    assert files.changes_between(old.limit(0), new.limit(0)).count() == 0


def test_conflicts(spark):
    rows = [("a", 0, 2, "he", "r1"), ("a", 1, 3, "el", "r2"), ("a", 5, 5, "", "r4"), ("a", 5, 5, "", "r3"), ("../a", 0, 1, "h", "r5"), ("/a", 0, 1, "h", "r5"), ("b/../a", 0, 1, "h", "r6"), ("c", 0, 1, "y", "r7"), ("d", 0, 1, "o", "r8")]
    plan = spark.createDataFrame([(*r[:4], "", r[4]) for r in rows], "file string, start int, end int, expected string, value string, rule string")
    snaps = spark.createDataFrame([("a", "hello"), ("c", "x"), ("d", "ok")], "file string, content string")
    got = sorted((r.file, r.kind, tuple(r.rules)) for r in edits.conflicts(plan, snaps).collect())
    assert got == [("../a", "outside-workspace", ("r5",)), ("/a", "outside-workspace", ("r5",)), ("a", "overlap", ("r1", "r2")), ("a", "overlap", ("r3", "r4")), ("b/../a", "stale-input", ("r6",)), ("c", "expectation-mismatch", ("r7",))]
    assert [r.file for r in edits.sound(plan, snaps).collect()] == ["d"]


def test_sinks(spark):
    found = spark.createDataFrame([("f", 3, "k", 'a "b"'), ("f", None, "j", "c"), ("g", 1, "k", "d")], "file string, line int, checker string, message string")
    logs = {r.file: json.loads(r.value) for r in sinks.sarif(found, {"k": "error"}).collect()}
    assert logs["f"]["version"] == "2.1.0" and [r["ruleId"] for r in logs["f"]["runs"][0]["results"]] == ["j", "k"]
    assert [r["level"] for r in logs["f"]["runs"][0]["results"]] == ["warning", "error"] and "region" not in logs["f"]["runs"][0]["results"][0]["locations"][0]["physicalLocation"]
    assert [r["id"] for r in logs["f"]["runs"][0]["tool"]["driver"]["rules"]] == ["j", "k"] and sinks.sarif(found.limit(0)).count() == 0
    assert json.loads(sinks.json_lines(found.where("line is null")).first().value) == {"file": "f", "line": None, "checker": "j", "message": "c"}
    e = json.loads(sinks.enveloped(found.where("line = 3"), "x", 2).first().value)
    assert e["ok"] is False and e["data"]["message"] == 'a "b"'
    with pytest.raises(ValueError):
        sinks.enveloped(found, "x", 3)


OLD = "---\na: {b: 1, c: [1]}\nd: x\n---\n# T\n## A\none\n### C\n## B\n[l](x.md) [m](y.md#p)\n```mermaid\nq\n```\n"
NEW = "---\na: {b: 2}\nd: x\ne: null\n---\n# T\n## A\ntwo\n### D\n## B\n[l](z.md) [m](y.md#q) [n](n.md)\n```mermaid\nr\n```\n"


def test_facets(spark):
    a, b = (extract.parse_documents(spark.createDataFrame([("f.md", x)], "path string, content string"), ("content",)).cache() for x in (OLD, NEW))
    heads = {(r.kind, r.old_slug, r.new_slug, r.matched_by, r.heuristic) for r in diffs.heading_changes(a, b).collect()}
    assert heads == {("changed", "a", "a", "slug", None), ("renamed", "c", "d", "position", True), ("changed", "b", "b", "slug", None)}
    links = [(r.kind, r.text, r.fragment_changed) for r in diffs.link_changes(a, b).orderBy(*diffs.within_file(), "text").collect()]
    assert links == [("added", "n", False), ("changed", "l", False), ("changed", "m", True)]
    code = diffs.code_changes(a, b).first()
    assert (code.kind, code.content_changed, code.language_changed, code.mermaid) == ("changed", True, False, True)
    keys = {(r.kind, r.key, r.old, r.new) for r in diffs.frontmatter_changes(a, b).collect()}
    assert keys == {("changed", "a.b", "1", "2"), ("removed", "a.c", "[1]", None), ("added", "e", None, "null")}
    bare = extract.parse_documents(spark.createDataFrame([("f.md", "x")], "path string, content string"))
    assert [(r.kind, r.key, r.old, r.new) for r in diffs.frontmatter_changes(a, bare).collect()] == [("changed", None, "valid", "missing")]
    assert diffs.totals({"links": diffs.link_changes(a, b), "none": diffs.table_changes(a, b)}).collect() == [("links", 3, 1), ("none", 0, 0)]


def test_equal_rows_are_paired_once(spark):
    old = spark.createDataFrame([("p", 1, "x")] * 3, "path string, line int, k string")
    got = [(r.o is None, r.n is None) for r in compare.pair_by_keys(old, old.limit(1), ["path"], [["k"]], ["line"]).collect()]
    assert sorted(got) == [(False, False), (False, True), (False, True)]


def test_sections_and_values(spark):
    text = "---\nt: [a, {k: 5}]\n---\nIn\n# One\nbody\n### Deep\nd\n## Two\nt\n# One\n"
    p = extract.parse_documents(spark.createDataFrame([("a.md", text), ("b.md", None), ("c.md", "---\na: [\n---\n")], "path string, content string"), ("content",)).cache()
    at = lambda *a, **k: [(r.start_line, r.end_line, r.content) for r in extract.find_section(p, *a, **k).collect()]
    assert at("ONE") == [(5, 10, "# One\nbody\n### Deep\nd\n## Two\nt")] and at("one", children=False, include_heading=False) == [(6, 6, "body")]
    assert at("one-1") == [] or at("one-1")[0][0] == 11
    assert at("none") == []
    tree = [(r.slug, r.parent, r.parents, r.ordinal, r.last_line) for r in extract.outline_tree(p).orderBy("line").collect()]
    assert tree == [("one", None, [], 0, 10), ("deep", "one", ["One"], 0, 8), ("two", "one", ["One"], 0, 10), ("one-1", None, [], 1, 12)]
    assert {r.path: (r.state, r.value) for r in query.frontmatter_value(p, "t.1.k").collect()} == {"a.md": ("ok", "5"), "b.md": ("missing", None), "c.md": ("malformed", None)}
    assert query.frontmatter_value(p, "t.9").where("path = 'a.md'").first().state == "absent"


def test_dates_and_fragments(spark):
    rows = [("D:20240102030405+01'30'", "2024-01-02 01:34:05"), ("D:2024", "2024-01-01 00:00:00"), ("D:20240102030405Z", "2024-01-02 03:04:05"), ("D:202401020304-02", "2024-01-02 03:04:00"), ("2024", None), (None, None)]
    df = spark.createDataFrame(rows, "v string, w string")
    assert [r[0] for r in df.select(fn.pdf_date(F.col("v")).cast("string")).collect()] == [r[1] for r in rows]
    df = spark.createDataFrame([("a.md#x", "b c"), ("a.md#x%20y", "b (c)é"), ("a.md", "b")], "t string, f string")
    assert [r[0] for r in df.select(fn.replace_fragment(F.col("t"), F.col("f"))).collect()] == ["a.md#b c", "a.md#b%20(c)%C3%A9", "a.md"]

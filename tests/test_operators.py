"""Cases of single operators and errors, and every query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone.operators import archive, checks, compare, extract, graph, layout, query, usage
from lodestone.plans import diffs as diffs_plan, logs, pages, records, renames, usage as usage_plan, workspace

SMALL = "/root/testdata/sf0.001"
DOC = """---
title: x
tags: [a, b]
owner:
---
Intro [ref] and [full][ref] ![i](a.png "t") `[no](x)` [s](../q/./b.md#top)

Setext
======
## A *b* c
## A b c
- item [x](/y.md#z)
- [ ] todo
- [X] Done

    indented code
~~~ts meta here
# no
~~~
| a | b |
|:-|-:|
| 1 | 2 |

[ref]: https://e.org/x
[ref]: https://late.org
"""


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if isinstance(v, (dt.date, dt.datetime)) else v


EVERY = {**usage_plan.ORACLE_SQL, **workspace.ORACLE_SQL, **records.ORACLE_SQL, **diffs_plan.ORACLE_SQL, **logs.ORACLE_SQL, **pages.ORACLE_SQL, **renames.ORACLE_SQL}
CALLS = {**usage_plan.QUERIES, **workspace.QUERIES, **records.QUERIES, **diffs_plan.QUERIES, **logs.QUERIES, **pages.QUERIES, **renames.QUERIES}
#: Iterative and streaming queries take long here; the driver's comparison covers them.
SLOW = {"graph_cycles", "graph_components", "graph_reach", "graph_focus", "context_pack", "context_summary", "graph_unreachable", "stream_day_buckets", "stream_distinct", "stream_deltas"}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in os.listdir(SMALL):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SMALL}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(set(EVERY) - SLOW))
def test_query_equals_sql(spark, con, name):
    df = CALLS[name](spark, SMALL)
    want = con.sql(EVERY[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    rows = sorted(repr([norm(r[c]) for c in names]) for r in df.collect())
    at = [want.columns.index(c) for c in names]
    assert rows == sorted(repr([norm(r[k]) for k in at]) for r in want.fetchall())


def test_extraction():
    p = extract.parse(DOC)
    assert p["frontmatter_status"] == "valid" and p["frontmatter_end"] == 5
    assert [(h["line"], h["depth"], h["slug"]) for h in p["headings"]] == [(8, 1, "setext"), (10, 2, "a-b-c"), (11, 2, "a-b-c-1")]
    assert [(x["text"], x["target"], x["image"], x["kind"]) for x in p["links"]] == [("ref", "https://e.org/x", False, "shortcut"), ("full", "https://e.org/x", False, "full"), ("i", "a.png", True, "inline"), ("s", "../q/./b.md#top", False, "inline"), ("x", "/y.md#z", False, "inline")]
    assert [(t["checked"], t["text"]) for t in p["tasks"]] == [(False, "todo"), (True, "Done")]
    assert [(c["language"], c["meta"], c["content"]) for c in p["code_blocks"]] == [(None, None, "indented code"), ("ts", "meta here", "# no")]
    assert p["tables"][0]["align"] == ["left", "right"] and p["tables"][0]["n_rows"] == 1
    assert extract.parse("")["headings"] == [] and extract.parse("---\na: [\n---\n# h")["frontmatter_status"] == "malformed"
    assert extract.parse("---\n- a\n---\n")["frontmatter_status"] == "non-mapping" and extract.parse("# h\n---\n")["frontmatter_status"] == "missing"


def test_targets_resolve(spark):
    rows = [("d/a.md", t, False) for t in ("../q/./b.md#top", "/y.md", "#z", "x%20y.md?v=1", "a+b.md", "%zz.md")] + [("d/a.md", "https://e.org", True)]
    got = [r.resolved for r in extract.resolved(spark.createDataFrame(rows, "path string, target string, external boolean")).collect()]
    assert got == ["q/b.md", "y.md", "d/a.md", "d/x y.md", "d/a+b.md", "d/%zz.md", None]


@pytest.fixture(scope="module")
def two(spark):
    a = "---\ntitle: A\ntags: [x, y]\nn: 5\nempty:\n---\n# One\n\n## Two\n- [x] a\n- [ ] b\n\n[l](b.md#two)\n\n```js\nz\n```\n"
    b = "---\ntitle: B\nflag: true\n---\n- [ ] c\n\n[e](https://e.org) [a](a.md)\n"
    return extract.parse_documents(spark.createDataFrame([("a.md", a), ("b.md", b), ("c.md", None)], "path string, content string")).cache()


@pytest.mark.parametrize(
    "entity,where,files",
    [
        ("documents", "has:h1", ["a.md"]), ("documents", "!has:frontmatter.tags", ["b.md", "c.md"]), ("documents", "frontmatter.tags = y", ["a.md"]), ("documents", "frontmatter.tags != y", ["b.md", "c.md"]),
        ("documents", "frontmatter.empty != q", ["b.md", "c.md"]), ("documents", "title != A", ["b.md"]), ("documents", "frontmatter.n > 4", ["a.md"]), ("documents", "frontmatter.flag = true", ["b.md"]),
        ("tasks", "status = done AND text = a", ["a.md"]), ("tasks", "checked = false", ["a.md", "b.md"]), ("links", "links-to:b.md#two", ["a.md"]), ("documents", "links-to:a.md", ["b.md"]), ("code", "language = js", ["a.md"]),
        ("headings", "depth >= 2", ["a.md"]), ("links", "external = true", ["b.md"]), ("frontmatter", "type = null", ["a.md"]), ("headings", "text ~ TW", ["a.md"]), ("documents", "has:frontmatter.empty", []),
    ],
)
def test_query_language(spark, two, entity, where, files):
    got = query.run(query.relation(two, entity), query.plan(entity, where, "file")).collect()
    assert sorted(r.file for r in got) == files


def test_group_fans_out(spark, two):
    got = {r.key: r["count"] for r in query.run(query.relation(two, "documents"), query.plan("documents", group_by="frontmatter.tags")).collect()}
    assert got == {"x": 1, "y": 1, None: 2}


@pytest.mark.parametrize(
    "entity,term",
    [("documents", ""), ("documents", "has:"), ("documents", "what:x"), ("tasks", "links-to:a.md"), ("documents", "title"), ("documents", "= x"), ("documents", "nope = 1"), ("documents", "frontmatter. = 1"), ("documents", "h1 = yes"), ("documents", "words = many"), ("documents", "words > inf"), ("documents", "title > 3"), ("none", "a = b")],
)
def test_query_errors(entity, term):
    with pytest.raises(query.QueryError):
        query.plan(entity, [term])


def test_usage_errors(spark):
    ev = spark.createDataFrame([], "kind string, model string, day date, tool string")
    for call in (lambda: usage.tokens_by(ev, "colour"), lambda: usage.tools_by(ev, "name", "odd"), lambda: usage.sessions(ev, "size"), lambda: usage.window(ev, "2024-02-01", "2024-01-01"), lambda: usage.parse_day("soon", "2024-01-01")):
        with pytest.raises(ValueError):
            call()
    assert [usage.parse_day(x, "2024-03-10") for x in ("7d", "2w", "1m", "1y", "2024-01-02")] == ["2024-03-03", "2024-02-25", "2024-02-09", "2023-03-11", "2024-01-02"]


def test_half_up_and_tools(spark):
    df = spark.createDataFrame([(-0.5, "mcp__a__b"), (2.5, "Task"), (2.4, "Read")], "x double, t string")
    assert [tuple(r) for r in df.select(fn.half_up(F.col("x")), fn.tool_kind(F.col("t")), fn.tool_server(F.col("t"))).collect()] == [(0, "mcp", "a"), (3, "agent", None), (2, "builtin", None)]


@pytest.fixture(scope="module")
def little(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "a"), ("f", "g")]
    edges = spark.createDataFrame([(*r, 1) for r in rows], "source string, target string, occurrences long")
    return edges, spark.createDataFrame([(x,) for x in "abcdefgh"], "path string")


def test_graph(spark, little):
    edges, paths = little
    assert {r.path: r.component for r in graph.components(edges, paths).collect()} == dict(zip("abcdefgh", "aaadaffh", strict=True))
    assert {r.path: r.cycle for r in graph.cycles(edges, paths).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert {r.path: r.distance for r in graph.reachable(edges, spark.createDataFrame([("e",)], "path string")).collect()} == {"e": 0, "a": 1, "b": 2, "c": 3}
    assert {r.path for r in graph.orphans(edges, paths, ["e"]).collect()} == {"f", "h"}


def test_reach_has_no_hop_bound(spark, tmp_path):
    """By the fixture's links every document of the first 977 is reached from the first, the farthest in 12 hops."""
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want, front = {0: 0}, [0]
    for i in front:
        for t in ((i * 7 + 1) % 977, (i * 13 + 5) % 977):
            if t not in want:
                want[t] = want[i] + 1
                front.append(t)
    want = {f"d{i % 10}/doc-{i}.md": n for i, n in want.items()}
    assert len(want) == 977 and max(want.values()) == 12
    assert {r.path: r.distance for r in workspace.QUERIES["graph_reach_all"](spark, str(tmp_path)).collect()} == want
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(c.sql(workspace.ORACLE_SQL["graph_reach_all"]).fetchall()) == want


def test_pairs_and_edits(spark):
    old = spark.createDataFrame([("p", 1, "x", "s"), ("p", 2, "x", "t"), ("p", 3, "y", "u")], "path string, line int, k string, v string")
    new = spark.createDataFrame([("p", 5, "x", "s"), ("p", 6, "z", "u")], "path string, line int, k string, v string")
    got = {(r.o and r.o.line, r.n and r.n.line, r["pass"]) for r in compare.pair_by_keys(old, new, ["path"], [["k"], ["v"]], ["line"]).collect()}
    assert got == {(1, 5, 0), (3, 6, 1), (2, None, None)}
    docs = spark.createDataFrame([("f", "hello world"), ("g", "same")], "file string, content string")
    edits = spark.createDataFrame([("f", 0, 5, "bye"), ("f", 6, 6, "my ")], "file string, start int, end int, value string")
    assert {tuple(r) for r in compare.apply_edits(docs, edits).collect()} == {("f", "bye my world"), ("g", "same")}


def test_edits_beyond_the_end(spark, tmp_path):
    """Texts too short for their edits, a null one and an id twice: as the SQL has it, and nothing of a value lost."""
    texts = [(0, ""), (1, "a"), (2, "ab"), (3, "abc"), (4, "abcd"), (5, "abcde"), (6, "abcdefg"), (7, "abcdefghi"), (8, None), (9, "twice once"), (9, "twice again"), (None, "no id at all")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, records.QUERIES["edit_apply"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(c.sql(records.ORACLE_SQL["edit_apply"]).fetchall(), key=str)
    docs = spark.createDataFrame([("f", "abc"), ("g", None)], "file string, content string")
    edits = spark.createDataFrame([("f", 2, 4, "<x>"), ("f", 7, 7, "+"), ("g", 0, 0, "x")], "file string, start int, end int, value string")
    assert {tuple(r) for r in compare.apply_edits(docs, edits).collect()} == {("f", "ab<x>+"), ("g", None)}


def test_archive_rules(spark):
    stored, listed = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a",)], "path string")
    assert archive.without_missing(stored, listed, True).count() == 1 and archive.without_missing(stored, listed, False).count() == 2
    blobs = spark.createDataFrame([("s", k, 40) for k in range(6)], "shard string, ord long, size long")
    assert [r.segment for r in archive.seals(blobs, 100).orderBy("ord").collect()] == [0, 0, 0, 1, 1, 1]


def test_page_ranges():
    assert layout.page_ranges("1,3,5-8,-2,9-", 10) == [1, 2, 3, 5, 6, 7, 8, 9, 10]
    for bad in ("", "0", "3-2", "x", "11", "-"):
        with pytest.raises(ValueError):
            layout.page_ranges(bad, 10)


def test_pushdown_reaches_the_scan(spark, con):
    from lodestone.sources import table, usage_events

    plan = usage.window(usage_events(table(spark, SMALL, "events")), "2024-01-05", "2024-01-20").where("kind = 'request'").groupBy("model").agg(F.sum("requests"))._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1]  # a column that no report asked for


def test_rich_text_and_regions():
    tree = '{"type":"doc","content":[{"type":"heading","attrs":{"level":2},"content":[{"type":"text","text":"T"}]},{"type":"bulletList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"a","marks":[{"type":"link","attrs":{"href":"u"}}]}]}]}]},{"type":"codeBlock","attrs":{"language":"js"},"content":[{"type":"text","text":"x"}]},{"type":"rule"}]}'
    assert checks.rich_to_markdown(tree) == "## T\n\n- [a](u)\n\n```js\nx\n```\n\n---" and checks.rich_to_markdown(None) == ""
    source = "a\n# #region one\n    x\n      y\n# #endregion\n# #region two\n# #endregion\n# #region three\n"
    assert checks.extract_region(source, "one") == ("ok", "x\n  y") and checks.extract_region(source, "two")[0] == "empty" and checks.extract_region(source, "three")[0] == "unclosed" and checks.extract_region(source, "four")[0] == "missing"


def test_snippets(spark):
    df = spark.createDataFrame([("x \n\n", "x\r\n"), ("x", "y"), ("x", None)], "a string, b string")
    assert [r[0] for r in df.select(checks.snippet_state(F.col("a"), F.col("b"))).collect()] == ["current", "stale", "unresolved"]

"""Context packs, reachability and diagrams on literal workspaces; pairing and link order of comparisons."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from lodestone.operators import checks, compare, context, diffs, graph
from lodestone.operators import extract as E

DOCS = {
    "a.md": "---\ntitle: A\n---\nintro é\n# A\nsee [b](b.md) and [c](c.md)\n## Detail\nmore\n### Deep\nx\n## Other\n",
    "b.md": "# B\n[d](d.md)\n",
    "c.md": "# C\n[d](d.md) [gone](gone.md)\n",
    "d.md": "# D\nend\n",
    "e.md": "# E\n\n[a](a.md)\n",
    "f.md": "alone",
}


def _workspace(spark, docs=DOCS):
    parsed = E.parse_documents(spark.createDataFrame(list(docs.items()), "path string, content string"), keep=("content",)).cache()
    links = E.resolved(E.rows_of(parsed, "links"))
    return parsed, graph.edges(links, parsed.select("path")), links


def _pack(spark, seeds, **kw):
    parsed, edge, _ = _workspace(spark)
    rows = context.pack(parsed, edge, context.seed_rows(spark, seeds, kw.pop("children", False)), **kw)
    return rows.orderBy(*context.ORDER).collect()


def test_pack_follows_links_and_keeps_the_first_discovery(spark):
    rows = _pack(spark, ["a.md"], depth=2)
    assert [r.id for r in rows] == ["a.md#preamble", "a.md#a", "a.md#detail", "a.md#deep", "a.md#other", "b.md#b", "c.md#c", "d.md#d"]
    d = rows[-1]
    assert (d.distance, d.via, d.via_line, d.direction, d.reason) == (2, "b.md", 2, "link", "Linked to from b.md:2, 2 hop(s) from a seed")
    assert rows[0].content == "intro é" and rows[0].bytes == 8 and rows[0].reason == "Requested as a seed"
    assert "".join(r.content + "\n" for r in rows[:5]) == DOCS["a.md"].split("---\n", 2)[2] + "\n"
    assert [r.id for r in _pack(spark, ["a.md"], depth=0)] == [r.id for r in rows[:5]]


def test_pack_goes_backwards_on_demand_only(spark):
    assert {r.file for r in _pack(spark, ["d.md"], depth=1)} == {"d.md"}
    rows = _pack(spark, ["d.md"], depth=2, backlinks=True)
    assert [(r.file, r.via, r.via_line, r.direction) for r in rows if r.unit == 0] == [("d.md", None, None, "seed"), ("b.md", "d.md", 2, "backlink"), ("c.md", "d.md", 2, "backlink"), ("a.md", "b.md", 6, "backlink")]
    both = _pack(spark, ["a.md", "e.md"], depth=1, backlinks=True)
    assert [r.file for r in both if r.unit == 0] == ["a.md", "e.md", "b.md", "c.md"]
    assert next(r.reason for r in rows if r.file == "a.md") == "Links to b.md at line 6, 2 hop(s) from a seed"


def test_budget_takes_a_prefix(spark):
    rows = _pack(spark, ["a.md"], depth=1)
    sizes = [r.bytes for r in rows]
    limit = sum(sizes[:2]) + sizes[2] - 1
    got = _pack(spark, ["a.md"], depth=1, budget=limit)
    assert [r.included for r in got] == [True, True] + [False] * (len(rows) - 2)  # a later unit would fit, but is left out
    parsed, edge, links = _workspace(spark)
    s = context.summary(context.pack(parsed, edge, context.seed_rows(spark, ["a.md"]), 1, limit), limit).first()
    assert (s.files, s.units, s.used_bytes, s.omitted_bytes, s.truncated) == (1, 2, sum(sizes[:2]), sum(sizes[2:]), True)
    assert s.token_estimate == -(-sum(sizes[:2]) // 4)
    free = context.summary(context.pack(parsed, edge, context.seed_rows(spark, ["a.md"]), 1)).first()
    assert free.limit_bytes is None and not free.truncated
    found = context.select(edge, context.seed_rows(spark, ["a.md"]), 1)
    assert [tuple(r) for r in context.broken_links(links, parsed.select("path"), found).collect()] == [("c.md", "gone.md", "gone.md", 2)]


def test_units_of_frontmatter_and_sections(spark):
    rows = _pack(spark, ["a.md"], depth=0, frontmatter=True)
    assert (rows[0].id, rows[0].content, rows[0].start_line, rows[0].end_line) == ("a.md#frontmatter", "---\ntitle: A\n---", 1, 3)
    assert [r.id for r in _pack(spark, [("a.md", "DETAIL")], depth=0)] == ["a.md#detail"]
    assert [r.id for r in _pack(spark, [("a.md", "detail")], depth=0, children=True)] == ["a.md#detail", "a.md#deep"]
    assert _pack(spark, [("a.md", "no such")], depth=0) == []
    parsed, edge, links = _workspace(spark)
    assert [r.path for r in context.backlink_seeds(links, "d.md").orderBy("path").collect()] == ["b.md", "c.md"]


def test_unreachable_and_diagrams(spark):
    parsed, edge, _ = _workspace(spark)
    paths = parsed.select("path")
    assert {r.path for r in graph.unreachable(edge, paths, ["a.md"]).collect()} == {"e.md", "f.md"}
    assert graph.unreachable(edge, paths, ["nowhere.md"]).count() == 0
    docs = {'x"y.md': "[z](z.md)", "z.md": "q"}
    parsed, edge, _ = _workspace(spark, docs)
    text = lambda kind: [r.line for r in graph.diagram(edge, parsed.select("path"), kind).orderBy("ord", "place").collect()]
    assert text("mermaid") == ["flowchart LR", '  n0["x\\"y.md"]', '  n1["z.md"]', "  n0 --> n1"]
    assert text("dot") == ["digraph markdown {", '  n0 [label="x\\"y.md"];', '  n1 [label="z.md"];', "  n0 -> n1;", "}"]


def test_links_of_one_line_pair_in_order_of_appearance(spark):
    def side(text):
        return E.parse_documents(spark.createDataFrame([("p.md", text)], "path string, content string"))

    got = {(r.old_target, r.new_target) for r in diffs.link_changes(side("[x](b.md) [x](a.md)"), side("[x](c.md) [x](d.md)")).collect()}
    assert got == {("b.md", "c.md"), ("a.md", "d.md")}


def plain_pairs(old, new, passes):
    left, right, out = list(range(len(old))), list(range(len(new))), set()
    for k, keys in enumerate(passes):
        for i in list(left):
            j = next((j for j in right if all(old[i][c] == new[j][c] for c in keys)), None)
            if j is not None:
                out.add((i, j, k))
                left.remove(i)
                right.remove(j)
    return out | {(i, None, None) for i in left} | {(None, j, None) for j in right}


def test_pairs_equal_a_greedy_loop_and_read_each_side_once(spark):
    rnd = random.Random(4)
    schema = "path string, at int, a string, b string"
    olds, news, want = [], [], set()
    for d in range(25):
        sides = [[{"at": k, "a": rnd.choice(["x", "y", None]), "b": rnd.choice("pqr")} for k in range(rnd.randint(0, 9))] for _ in range(2)]
        for out, own in zip((olds, news), sides, strict=True):
            out += [(f"d{d}", r["at"], r["a"], r["b"]) for r in own]
        want |= {(f"d{d}", *p) for p in plain_pairs(*sides, [["a", "b"], ["b"], []])}
    old, new = spark.createDataFrame(olds, schema), spark.createDataFrame(news, schema)
    pairs = compare.pair_by_keys(old, new, ["path"], [["a", "b"], ["b"], []], ["at"])
    got = {(r.path, r.o and r.o["at"], r.n and r.n["at"], r["pass"]) for r in pairs.collect()}
    assert got == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and "Join" not in plan
    assert pairs.where(F.col("o").isNull() & F.col("n").isNull()).count() == 0


def test_repeated_yaml_keys_are_malformed():
    assert E.front_matter("---\na: 1\na: 2\n---".split("\n"))[0] == "malformed"
    assert E.front_matter("---\na: {b: 1, b: 2}\n---".split("\n"))[0] == "malformed"
    assert E.front_matter("---\na: {b: 1}\nc: {b: 1}\n---".split("\n"))[0] == "valid"


def test_markdown_corners():
    text = "> ## Quoted\n\n* * *\n[x](a(b).md) and [long\ntext](c.md \"T\") `[no](n.md)`\nmore [d](<e f.md>)\n***\nTwo line\nheading\n===\n- - -\n* item\n"
    p = E.parse(text)
    assert [(h["line"], h["depth"], h["text"], h["slug"]) for h in p["headings"]] == [(1, 2, "Quoted", "quoted"), (8, 1, "Two line heading", "two-line-heading")]
    assert p["lists"] == 1 and p["paragraphs"] == 1
    assert [(x["text"], x["target"], x["line"], x["destination_line"]) for x in p["links"]] == [("x", "a(b).md", 4, 4), ("long text", "c.md", 4, 5), ("d", "e f.md", 6, 6)]
    assert all(text[x["start"] : x["end"]] == x["target"] for x in p["links"])


def test_rich_text_content_model(spark):
    def node(kind, *content, **more):
        return {"type": kind, **more, **({"content": list(content)} if content else {})}

    text = node("text", text="t")
    para = node("paragraph", text)
    trees = {
        "ok": node("doc", node("panel", para), node("expand", node("nestedExpand", para)), node("taskList", node("taskItem", text), node("taskList", node("taskItem"))), node("table", node("tableRow")), node("mediaSingle", node("media"))),
        "bad": node("doc", node("panel"), node("blockquote", node("heading", text)), node("mediaSingle", node("media"), node("media")), node("odd"), node("paragraph", node("odd")), node("codeBlock", node("text", text="x", marks=[{"type": "strong"}])), node("listItem", para)),
        "root": node("paragraph"),
        "empty": node("doc"),
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in trees.items()] + [("none", None)], "path string, tree string")
    got = sorted((r.path, r.type, r.parent_type, r.finding) for r in checks.rich_findings(checks.rich_nodes(rows)).where("path <> 'root'").collect())
    assert got == sorted([
        ("bad", "panel", "doc", "too-few"), ("bad", "heading", "blockquote", "not-allowed"), ("bad", "mediaSingle", "doc", "too-many"), ("bad", "odd", "doc", "unknown"),
        ("bad", "odd", "paragraph", "not-allowed"), ("bad", "odd", "paragraph", "unknown"), ("bad", "text", "codeBlock", "marked-code"), ("bad", "listItem", "doc", "not-allowed"),
    ])
    assert [(r.path, r.finding) for r in checks.rich_findings(checks.rich_nodes(rows)).where("path = 'root'").collect()] == [("root", "no-doc")]

"""Reading order, blocks and renames on literal pages and workspaces."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import compare, edits
from lodestone.operators import extract as E
from lodestone.operators import pages as P
from lodestone.operators import renames as R
from lodestone.plans import pages as Plan

RUNS = "doc long, page int, index int, text string, x double, y double, width double, size double, angle double, vertical boolean, bold boolean"


def run(page, index, text, x, y, size=10.0, width=None, bold=False, angle=0.0):
    return (1, page, index, text, float(x), float(y), float(5 * len(text) if width is None else width), float(size), angle, False, bold)


def two_columns(page=1, first=0):
    rows = []
    for r in range(20):
        rows.append(run(page, first + 2 * r, f"left column line {r:02d} goes on here", 50, 80 + 14 * r, width=220))
        rows.append(run(page, first + 2 * r + 1, f"right column line {r:02d} goes on too", 320, 80 + 14 * r, width=220))
    return rows


def _order(spark, rows, columns=None):
    return P.reading_order(spark.createDataFrame(rows, RUNS), 612.0, columns)


def test_columns_below_a_wide_title(spark):
    rows = [run(1, 100, "A title that runs across both of the columns", 50, 40, 18, width=490), *two_columns(), run(1, 101, "A caption across", 50, 400, width=490), run(1, 102, "turned", 20, 100, angle=90.0)]
    out = {r["index"]: r for r in _order(spark, rows).collect()}
    assert out[100].group == 0 and {out[2 * r].group for r in range(20)} == {1} and {out[2 * r + 1].group for r in range(20)} == {2} and out[101].group == 3
    assert len(out[0].gutters) == 1 and 270 < out[0].gutters[0] < 320 and out[102].group in (1, 2, 3)
    text = P.page_text(_order(spark, rows[:-1])).first().text.split("\n")
    assert text[0].startswith("A title") and text[1] == "left column line 00 goes on here" and text[21] == "right column line 00 goes on too" and text[-1] == "A caption across"


def test_tables_and_short_pages_are_read_across(spark):
    cells = [run(1, 10 * r + c, "ab", 50 + 100 * c, 80 + 14 * r) for r in range(12) for c in range(5)]
    out = _order(spark, cells).collect()
    assert {r.group for r in out} == {0} and {r.candidates for r in out} == {5}  # four gutters are not believed
    three = [run(1, 10 * r + c, "ab", 50 + 200 * c, 80 + 14 * r) for r in range(12) for c in range(3)]
    assert {len(r.gutters) for r in _order(spark, three).collect()} == {0}  # cells too short for columns
    assert {len(r.gutters) for r in _order(spark, two_columns()[:7]).collect()} == {0}
    assert {len(r.gutters) for r in _order(spark, two_columns(), 1).collect()} == {0}
    assert {len(r.gutters) for r in _order(spark, three, 3).collect()} == {2}
    assert _order(spark, cells).where("false").count() == 0 and P.blocks(spark.createDataFrame([], RUNS), 612.0, 792.0).count() == 0


def test_pages_do_not_mix(spark):
    both = _order(spark, two_columns(1) + [r[:1] + (2,) + r[2:] for r in two_columns(1)][:8]).collect()
    assert {len(r.gutters) for r in both if r.page == 1} == {1} and {len(r.gutters) for r in both if r.page == 2} == {0}


def test_words_are_joined_by_gaps(spark):
    rows = [run(1, 1, "fi", 10, 10, width=8), run(1, 2, "ne", 18.5, 10, width=10), run(1, 3, "word", 32, 12, width=20), run(1, 4, "x ", 55, 10, width=8), run(1, 5, "y", 70, 10, width=5), run(1, 6, "next", 10, 30, width=20)]
    lines = P.text_lines(_order(spark, rows)).orderBy("line").collect()
    assert [r.text for r in lines] == ["fine word x y", "next"] and lines[0].gaps == [] and lines[0].n_runs == 5


def page_of(page, lines):
    return [run(page, 100 * page + k, t, x, y, size) for k, (t, x, y, size) in enumerate(lines)]


def test_blocks_of_a_document(spark):
    body = [("Heading One", 50, 100, 16), ("first line of a long paragraph that is hy-", 50, 120, 10), ("phenated here and goes on to the end.", 50, 132, 10), ("Short and final.", 50, 144, 10), ("Another paragraph starts here after that one.", 50, 170, 10)]
    items = [("1. first item", 50, 200, 10), ("2. second item", 50, 212, 10), ("a paragraph that the page's end splits in the", 50, 240, 10)]
    rows = page_of(1, [("Running head 1", 50, 20, 8), *body, *items]) + page_of(2, [("Running head 2", 50, 20, 8), ("middle goes on in the next page.", 50, 100, 10), ("Small Heading", 50, 130, 13), ("text below it, which is plain", 50, 150, 10)])
    rows += page_of(3, [("Running head 3", 50, 20, 8), ("third page is plain as well", 50, 100, 10)]) + page_of(4, [("Running head 4", 50, 20, 8), ("the fourth too", 50, 100, 10)])
    got = P.blocks(spark.createDataFrame(rows, RUNS), 612.0, 792.0).orderBy("block").collect()
    assert all("Running head" not in (b.text or "") for b in got)
    assert (got[0].kind, got[0].level, got[0].text) == ("heading", 1, "Heading One")
    assert got[1].text == "first line of a long paragraph that is hyphenated here and goes on to the end. Short and final." and got[1].kind == "paragraph"
    lists = [b for b in got if b.kind in ("list", "item")]
    assert [(b.kind, b.ordered, b.text) for b in lists] == [("list", True, None), ("item", None, "first item"), ("item", None, "second item")] and {b.parent for b in lists[1:]} == {lists[0].block}
    assert got[2].text == "Another paragraph starts here after that one."
    split = next(b for b in got if b.text and b.text.startswith("a paragraph that"))
    assert (split.text, split.first_page, split.last_page) == ("a paragraph that the page's end splits in the middle goes on in the next page.", 1, 2)
    assert next(b.level for b in got if b.text == "Small Heading") == 2


DOCS = {
    "a.md": "# Top\n## Part\n[x](sub/b.md#part) [y](#part-1)\n## Part\n[z](./sub/b.md?q#k) [w](/sub/b.md) [e](sub/my%20b.md)\n",
    "sub/b.md": "## Part ##\n[a](../a.md#part) [s](b.md) [d](../sub/../a.md#part-1) ![i](../img/p.png)\n[r] [r][r]\n\n[r]: ../a.md#part\n",
    "sub/my b.md": "Title\n=====\n[t](#title) [o](https://h/#part)\n",
}


def _workspace(spark, docs=DOCS):
    raw = spark.createDataFrame(list(docs.items()), "path string, content string")
    return raw, E.parse_documents(raw, keep=("content",)).cache()


def _applied(raw, plan):
    snapshots = raw.withColumnRenamed("path", "file")
    assert edits.conflicts(plan, snapshots).count() == 0
    return {r.file: r.content for r in compare.apply_edits(snapshots, plan).collect()}


def _led(spark, docs):
    """Where the links of a workspace lead, in order."""
    _, parsed = _workspace(spark, docs)
    links = E.resolved(parsed.select("path", F.posexplode("links").alias("k", "x")).select("path", "k", "x.*"))
    return {(r.path, r.k): (r.resolved, r.fragment) for r in links.collect()}


def test_renamed_heading_takes_its_links_along(spark):
    raw, parsed = _workspace(spark)
    new = _applied(raw, R.rename_headings(parsed, R.heading_renames(spark, [("a.md", "PART", "New One"), ("sub/my b.md", "title", "Other")])))
    assert new["a.md"].startswith("# Top\n## New One\n[x](sub/b.md#part) [y](#part)\n## Part\n")
    assert "[a](../a.md#new-one)" in new["sub/b.md"] and "a.md#part)" in new["sub/b.md"] and new["sub/b.md"].endswith("[r]: ../a.md#new-one\n") and new["sub/b.md"].startswith("## Part ##")
    assert new["sub/my b.md"] == "Other\n=====\n[t](#other) [o](https://h/#part)\n"
    slugs = {(r.path, h.slug) for r in _workspace(spark, new)[1].collect() for h in r.headings}
    broken = {k for k, (path, fragment) in _led(spark, new).items() if path in new and fragment and (path, fragment) not in slugs}
    assert broken == {("a.md", 2)}  # ?q#k led nowhere before, too
    assert R.rename_headings(parsed, R.heading_renames(spark, [("a.md", "none such", "x")])).count() == 0


def test_moved_file_keeps_all_links_right(spark):
    raw, parsed = _workspace(spark)
    moves = {"sub/b.md": "x/y/c d.md", "sub/my b.md": "my b(1).md"}
    plan = R.rename_files(parsed, spark.createDataFrame(list(moves.items()), "source string, destination string"))
    new = {moves.get(k, k): v for k, v in _applied(raw, plan).items()}
    assert "[z](./x/y/c d.md?q#k) [w](/x/y/c d.md) [e](my%20b(1).md)" in new["a.md"]
    assert "[s](c d.md)" in new["x/y/c d.md"] and "![i](../../img/p.png)" in new["x/y/c d.md"] and new["x/y/c d.md"].endswith("[r]: ../../a.md#part\n")
    assert R.rename_files(parsed, spark.createDataFrame([], "source string, destination string")).count() == 0


def test_canonical_links_keep_style_and_place(spark):
    raw, parsed = _workspace(spark, {"s/a.md": "[a](../s/b.md#f) [b](./../s/b.md) [c](/s/../s/b.md) [d](b.md) [e](./b.md) [f](#x) [g](../s/x%20y.md?q) [h](mailto:q@x)\n", "s/b.md": ""})
    new = _applied(raw, R.canonical_links(parsed))
    assert new["s/a.md"] == "[a](b.md#f) [b](./b.md) [c](/s/b.md) [d](b.md) [e](./b.md) [f](#x) [g](x%20y.md?q) [h](mailto:q@x)\n"


def _documents(spark, folder):
    """Long and short texts, none, a null one, one that comes twice under one id, and one without an id."""
    words = [f"word{k % 37}" + "x" * (k % 5) for k in range(700)]
    rows = [(0, " ".join(words)), (1, " ".join(words[5:])), (2, "  a few\twords\nonly "), (3, ""), (4, None), (5, " ".join(words[:400])), (6, " ".join(words[3:50])), (6, " ".join(words[3:50])), (None, "no id"), (7, " ".join(words[:321]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", ["layout_reading_order", "layout_page_text"])
def test_page_queries_of_odd_texts(spark, tmp_path, name):
    c = _documents(spark, tmp_path)
    got, want = Plan.QUERIES[name](spark, str(tmp_path)).collect(), c.sql(Plan.ORACLE_SQL[name]).fetchall()
    assert len(want) > 10 and sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["layout_reading_order", "layout_page_text", "layout_blocks"])
def test_pages_are_dealt_and_sorted_once(spark, name):
    """Texts are dealt by document; no later step deals the runs again, joins them or works them out a second time."""
    plan = Plan.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange"), plan.count("Join"), plan.count("FileScan"), plan.count("Sort [")) == (1, 0, 1, 1)


def test_texts_of_pages_in_one_pass(spark, monkeypatch):
    """Like the lines of the reading order put together, however the pages fall into batches."""
    rows = [run(1, 100, "A title that runs across both of the columns", 50, 40, 18, width=490), *two_columns(), run(1, 101, "A caption across ", 50, 400, width=490), run(1, 102, "turned", 20, 100, angle=90.0)]
    rows += [r[:1] + (2,) + r[2:] for r in two_columns()] + [run(3, 1, "fi", 10, 10, width=8), run(3, 2, "ne ", 18.5, 10, width=10), run(3, 3, "word", 32, 12, width=20), run(4, 1, " ", 10, 10), run(5, 1, "", 10, 10), run(5, 2, "x", 10, 30)]
    df = spark.createDataFrame(rows, RUNS)
    for columns in (None, 1, 2, 3):
        want = sorted(P.page_text(P.reading_order(df, 612.0, columns)).collect())
        for size in (1, 30, 60_000):
            monkeypatch.setattr(P.A, "ROWS", size)
            assert sorted(P.page_texts(df, 612.0, columns).collect()) == want and len(want) == 4
    assert P.page_texts(df.where("false"), 612.0).count() == 0


def test_blocks_of_documents_side_by_side(spark, monkeypatch):
    """Headers gone, items with lines of their own, markers as runs, words split by hyphens; in batches of any size; a run without a document is left out."""
    body = [("Heading One", 50, 100, 16), ("a line that is hy-", 50, 120, 10), ("phenated and a well-", 50, 132, 10), ("Known one goes on over the end", 50, 144, 10)]
    rows = page_of(1, [("Running head 1", 50, 20, 8), *body]) + page_of(2, [("Running head 2", 50, 20, 8), ("of its page.", 50, 100, 10), ("Sub heading", 50, 130, 13), ("1. first", 50, 150, 10), ("goes on", 50, 162, 10), ("2) second", 50, 174, 10), ("apart from it", 90, 186, 10)])
    rows += page_of(3, [("Running head 3", 50, 20, 8), ("After the list. And now a paragraph that is long.", 50, 100, 10)]) + [run(3, 390, "•", 50, 112, width=5), run(3, 391, "bullet", 62, 112), run(3, 392, "more of it", 62, 124), run(3, 393, "", 50, 136)]
    rows += page_of(4, [("Running head 4", 50, 20, 8), ("the fourth", 50, 100, 10)])
    both = rows + [(2, *r[1:]) for r in rows] + [(None, *r[1:]) for r in rows[:3]]
    want = [
        ("heading", 1, None, "Heading One", 1, 1, None), ("paragraph", None, None, "a line that is hyphenated and a well- Known one goes on over the end of its page.", 1, 2, None), ("heading", 2, None, "Sub heading", 2, 2, None),
        ("list", None, True, None, 2, 2, None), ("item", None, None, "first goes on", 2, 2, 3), ("item", None, None, "second", 2, 2, 3), ("paragraph", None, None, "apart from it After the list. And now a paragraph that is long.", 2, 3, None),
        ("list", None, False, None, 3, 3, None), ("item", None, None, "bullet more of it", 3, 3, 7), ("paragraph", None, None, "the fourth", 3, 4, None),
    ]
    for size in (1, 60_000):
        monkeypatch.setattr(P.A, "ROWS", size)
        got = P.blocks(spark.createDataFrame(both, RUNS), 612.0, 792.0).orderBy("doc", "block").collect()
        for doc in (1, 2):
            assert [(b.kind, b.level, b.ordered, b.text, b.first_page, b.last_page, b.parent) for b in got if b.doc == doc] == want and [b.block for b in got if b.doc == doc] == list(range(10))
        assert {b.doc for b in got} == {1, 2}

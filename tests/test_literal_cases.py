"""Single cases whose answers are given by the rules, not by a query's SQL."""

from __future__ import annotations

import json
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone.operators import archive, extract, query, usage

ROOT = Path(__file__).parent.parent


def header(text):
    status, data, lines = extract.front_matter(text.split("\n"))
    return status, data and json.loads(data), lines


def test_headers_are_yaml_1_2():
    assert header("---\nfl: no\non: yes\nn: 012\no: 0o14\nx: 1.5e3\nd: 2024-01-02\nt: True\ne: ~\nempty:\n---\nbody") == (
        "valid", {"fl": "no", "on": "yes", "n": 12, "o": 12, "x": 1500.0, "d": "2024-01-02", "t": True, "e": None, "empty": None}, 11)
    assert header("---\na: 1\nnever ends")[0] == "malformed"
    assert header("---\na: [1\n---")[0] == "malformed"
    assert header("---\n# a comment only\n---")[0] == "non-mapping"
    assert header("---\n- a\n---")[0] == "non-mapping"
    assert header("---\n\n---\nbody") == ("valid", {}, 3)
    assert header("--- \na: 1\n---")[0] == "missing" and header("body")[0] == "missing"
    assert header("---\r\na: 1\r\n--- \r\nbody") == ("valid", {"a": 1}, 3)
    assert header("---\na: 1\n...  \nbody") == ("valid", {"a": 1}, 3)


def test_dotted_names_walk_arrays_and_odd_keys(spark):
    data = {"tags": ["x", "y"], "deep": [{"k": [1, 2]}], "7": "key", "it's [1]": "odd"}
    df = spark.createDataFrame([(json.dumps(data),)], "frontmatter string")
    for name, want in {"tags.0": ["x"], "tags.1": ["y"], "tags": ["x", "y"], "tags.2": None, "deep.0.k.1": ["2"], "7": ["key"], "it's [1]": ["odd"], "none": None}.items():
        assert df.select(query._values(name)).first()[0] == want, name


def test_tools(spark):
    df = spark.createDataFrame([("Skill",), ("mcp__a__b__c",), ("mcp____x",), ("mcp__solo",), ("Read",)], "t string")
    assert [tuple(r) for r in df.select(fn.tool_kind(F.col("t")), fn.tool_server(F.col("t"))).collect()] == [("skill", None), ("mcp", "a"), ("mcp", "__x"), ("mcp", "solo"), ("builtin", None)]


def test_project_of_a_session_is_the_main_transcripts(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    from lodestone.sources import table, usage_events

    one = usage_events(table(spark, sf, "events")).limit(1).withColumn("session_id", F.lit("s"))
    rows = [("subagent", "/sub", 1), ("main", "", 2), ("main", "/first", 3), ("main", "/last", 4), ("main", "", 5), ("subagent", "/late", 6)]
    make = lambda rows: one.drop("file_kind", "project", "seq").crossJoin(spark.createDataFrame(rows, "file_kind string, project string, seq long"))
    assert usage.sessions(make(rows)).first().project == "/last"
    assert usage.sessions(make([r for r in rows if r[0] == "subagent"])).first().project == "/sub"
    assert usage.sessions(make([("main", "", 1)])).first().project == ""


def test_resolve_tries_hashes_then_the_path(spark):
    artifact = spark.createDataFrame([(1, "p", "cafe", "ab12"), (2, "p", "cafe", "cd34"), (3, "p", "other", "ab99")], "id long, provider string, path string, sha256 string")
    blob = spark.createDataFrame([("ab12", 1, 0, 5), ("cd34", 1, 5, 6), ("ab99", 2, 0, 7)], "sha256 string, segment_id int, offset long, size long")
    got = lambda what: sorted((r.sha256, r.path) for r in archive.resolve(artifact, blob, what).collect())
    assert got("ab") == [("ab12", "cafe"), ("ab99", "other")] and got("ab12") == [("ab12", "cafe")]
    assert got("cafe") == [("cd34", "cafe")] and got("nothing") == []


def test_the_rest_works_without_the_folder_llm(tmp_path):
    """Without lodestone/llm and tests/llm, with and without the pipeline's file."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline']"
    for name in ("", "corpus_pipeline.py"):
        if name:
            (tmp_path / "r" / name).unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)

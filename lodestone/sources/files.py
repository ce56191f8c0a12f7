"""Folders as tables: documents and other files by glob, inputs of several kinds, changed files, snapshots.

Listing reads names only; contents are read where a column of them is asked for. Spark's
file sources leave out files of no bytes and names that start with a dot or an underscore, and
so do these readers; union such names from a listing of another kind where they count.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that no scan enters. Fixed values.
SKIPPED = ("node_modules", ".git")
MARKDOWN = ("**/*.md", "**/*.markdown")


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: * and ? within a step, ** over steps, [..] and {a,b}."""
    out, k, depth = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out += "(?:[^/]+/)*"
            k += 3
            continue
        if glob.startswith("**", k):
            out += ".*"
            k += 2
            continue
        close = glob.find("]", k + 2) if c == "[" else -1
        if close > 0:
            inner = glob[k + 1 : close].replace("\\", "\\\\")
            out += f"[^/{inner[1:]}]" if inner[0] in "!^" else f"[{inner}]"
            k = close + 1
            continue
        if c == "{" and "}" in glob[k:]:
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        k += 1
    return f"^{out}$"


def is_glob(text: str) -> bool:
    return bool(re.search(r"[*?\[{]", text))


def matches(path: Column, globs: Iterable[str]) -> Column:
    """Whether any of the globs fits the whole path."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_pattern(g))
    return hit


def _relative(file: Column, root: str) -> Column:
    """A file's place below root, of which only the folders' own part of the URI is known."""
    plain = F.coalesce(F.try_url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), file)
    base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    path = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def _kept(path: Column) -> Column:
    return ~path.rlike(r"(^|/)(" + "|".join(re.escape(x) for x in SKIPPED) + ")/")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), size and modified of every file below root, without the skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = _relative(F.col("path"), root)
    return files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(_kept(F.col("path")))


def documents(spark: SparkSession, root: str, include: Iterable[str] = MARKDOWN, exclude: Iterable[str] = ()) -> DataFrame:
    """path, content of the files below root that a glob of include fits and none of exclude.

    The globs see paths below root. A missing folder raises. The result has no order; sort
    by path where one is shown. Bytes that are no UTF-8 become replacement marks.
    """
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = whole.select(_relative(F.col("path"), root).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    return rows.where(_kept(F.col("path")) & matches(F.col("path"), include) & ~matches(F.col("path"), exclude))


def assets(spark: SparkSession, root: str, extensions: Iterable[str], exclude: Iterable[str] = ()) -> DataFrame:
    """listing() of the files with one of the extensions, whatever their case and with or without the dot."""
    wanted = [("" if e.startswith(".") else ".") + e.lower() for e in extensions]
    extension = F.lower(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1))
    return listing(spark, root).where(extension.isin(*wanted) & ~matches(F.col("path"), exclude))


def inputs(spark: SparkSession, root: str, names: Iterable[str], include: Iterable[str] = MARKDOWN, exclude: Iterable[str] = (), changed: DataFrame | None = None) -> DataFrame:
    """documents() below root named by files, folders or globs, each once; all of them if no name is given.

    A name that is neither a glob nor there raises FileNotFoundError; a glob may fit nothing.
    changed (path) restricts the result to what has changed.
    """
    names = [n.strip("/").removeprefix("./") for n in names]
    every = documents(spark, root, include, exclude)
    if names:
        for n in names:
            if not is_glob(n):
                _must_exist(spark, f"{root.rstrip('/')}/{n}" if n not in ("", ".") else root, n)
        path = F.col("path")
        hit = F.lit(False)
        for n in names:
            hit = hit | (path.rlike(glob_pattern(n)) if is_glob(n) else F.lit(True) if n in ("", ".") else (path == n) | path.startswith(n + "/"))
        every = every.where(hit)
    return every if changed is None else changed_only(every, changed)


def _must_exist(spark: SparkSession, place: str, name: str) -> None:
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(place)
    except AnalysisException as e:
        raise FileNotFoundError(name) from e


def changed_only(rows: DataFrame, changed: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose file is among the changed ones."""
    return rows.join(changed.select(F.col("path").alias(column)).distinct(), column, "left_semi").select(rows.columns)


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, old_path, status (A, D, M, R) of two snapshots (path, content).

    A file that is gone and one that has come with the same bytes are one rename; where
    several have the same bytes they are paired in order of path.
    """
    from lodestone.operators.compare import pair_by_keys

    digest = lambda df: df.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"))
    a, b = digest(before), digest(after)
    both = a.select("path", F.col("digest").alias("x")).join(b.select("path", F.col("digest").alias("y")), "path", "full")
    kept = both.where("x is not null and y is not null and x <> y").select("path", F.col("path").alias("old_path"), F.lit("M").alias("status"))
    gone = both.where("y is null").select("path", F.col("x").alias("digest"))
    come = both.where("x is null").select("path", F.col("y").alias("digest"))
    pairs = pair_by_keys(gone, come, ["digest"], [[]], ["path"])
    status = F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").otherwise("R")
    return kept.unionByName(pairs.select(F.coalesce("n.path", "o.path").alias("path"), F.when(F.col("o").isNotNull(), F.col("o.path")).alias("old_path"), status.alias("status")))


def at_revision(history: DataFrame, revision: str) -> DataFrame:
    """path, content as of a revision of history (revision, path, content); partition history by revision, so that one part is read."""
    return history.where(F.col("revision") == revision).select("path", "content")

"""Page layout over positioned text runs: lines, fragments, columns, running headers, modes, headings, OCR confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A new line starts when the baseline moves by more than this share of the larger size.
LINE_GAP = 0.35


def lines(runs: DataFrame) -> DataFrame:
    """Adds line_no: a run starts a line if its baseline is too far from the run before it."""
    w = Window.partitionBy("doc", "page").orderBy(F.desc("y"), "x", "index")
    gap = F.abs(F.col("y") - F.lag("y").over(w)) > LINE_GAP * F.greatest("size", F.lag("size").over(w))
    return runs.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def fragments(lined: DataFrame) -> DataFrame:
    """Adds fragment: within a line a gap wider than max(3, size) after all text so far starts one."""
    w = Window.partitionBy("doc", "page", "line_no").orderBy("x", "index")
    right = F.max(F.col("x") + F.col("width")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("x") - right > F.greatest(F.lit(3.0), "size"), F.lit(False)).cast("int")
    return lined.withColumn("_new", new).withColumn("fragment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def in_columns(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """Boxes inside a column's bounds: an equi-join on document and page, then the range."""
    return boxes.join(columns, ["doc", "page"]).where((F.col("x") >= F.col("lo")) & (F.col("x") + F.col("width") <= F.col("hi")))


def running_text(runs: DataFrame, share: float = 0.4, least_pages: int = 4) -> DataFrame:
    """doc, y_bucket, masked, pages: text (digits masked) at one height on so many of a document's pages."""
    pages = runs.groupBy("doc").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= least_pages)
    seen = runs.groupBy("doc", F.floor(F.col("y") / 4).cast("long").alias("y_bucket"), F.regexp_replace("text", r"\d+", "#").alias("masked")).agg(F.count_distinct("page").alias("pages"))
    return seen.join(pages, "doc").where(F.col("pages") >= share * F.col("n")).select("doc", "y_bucket", "masked", "pages")


def body_size(runs: DataFrame) -> DataFrame:
    """doc, size: the size that most characters have; of equals the larger."""
    n = runs.groupBy("doc", "size").agg(F.sum(F.length("text")).alias("n"))
    return n.groupBy("doc").agg(F.max(F.struct("n", "size"))["size"].alias("size"))


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The item at floor(n / 2) of the sorted values; no average."""
    return rows.groupBy(*by).agg(F.element_at(F.sort_array(F.collect_list(value)), F.floor(F.count(value) / 2).cast("int") + 1).alias("median"))


def heading_levels(runs: DataFrame) -> DataFrame:
    """doc, size, level of sizes above the body's, largest first, at most 6."""
    big = runs.select("doc", "size").distinct().join(body_size(runs).withColumnRenamed("size", "body"), "doc").where("size > body")
    return big.select("doc", "size", F.least(F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size"))), F.lit(6)).cast("long").alias("level"))


def tabular(rows: DataFrame) -> DataFrame:
    """Lines that start three in a row with the same number of fragments, two or more."""
    w = Window.partitionBy("doc", "page").orderBy("line_no").rowsBetween(0, 2)
    return rows.withColumn("_lo", F.min("n_fragments").over(w)).withColumn("_hi", F.max("n_fragments").over(w)).withColumn("_c", F.count("*").over(w)).where("_c = 3 and _lo = _hi and _lo >= 2").drop("_lo", "_hi", "_c")


def ocr_confidence(words: DataFrame) -> DataFrame:
    """doc, page, confidence: mean weighted by word length, one decimal."""
    n = F.length("text")
    return words.groupBy("doc", "page").agg(F.round(F.sum(F.col("conf") * n) / F.sum(n), 1).alias("confidence"))


def page_ranges(spec: str, pages: int) -> list[int]:
    """1,3,5-8,-4,9- as an ascending list; ValueError for anything else."""
    out: set[int] = set()
    for part in spec.split(","):
        a, dash, b = part.strip().partition("-")
        if not part.strip() or not (a or b) or not all(x.isdigit() for x in (a, b) if x):
            raise ValueError(f"not a page range: {part!r}")
        lo = int(a) if a else 1
        hi = (int(b) if b else pages) if dash else lo
        if lo < 1 or hi > pages or lo > hi:
            raise ValueError(f"pages {lo} to {hi} are not among 1 to {pages}")
        out.update(range(lo, hi + 1))
    return sorted(out)

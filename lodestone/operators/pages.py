"""Pages as positioned runs: reading order across columns, lines of text, blocks.

Runs have doc, page, index, text, x, y, width, size, angle, vertical, bold; y grows
downwards. Columns are found by sweeps over the extents of line fragments. Runs are dealt
and sorted by page once, and whole pages go through pagearrays; runs that already lie
together by document are not dealt again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import pagearrays as A
from lodestone.operators.layout import LINE_GAP
from lodestone.operators.pagearrays import AUTO_COLUMNS, CELLS, COLUMN_CHARS, COLUMN_FILL, COLUMN_HEIGHT, COLUMN_LINES, COLUMN_TEXT, COLUMN_WIDTH, LEAST_RUNS, MAX_COLUMNS, WIDE  # noqa: F401

PAGE = ["doc", "page"]
#: Headers and footers: on such a share of a document's pages, if it has so many, within such a share of the height from an edge.
RUNNING_SHARE, RUNNING_PAGES, RUNNING_EDGE = 0.4, 4, 0.12


def _upright() -> Column:
    return (F.coalesce("angle", F.lit(-1.0)) == 0) & ~F.col("vertical")


def with_lines(runs: DataFrame, within: list[str]) -> DataFrame:
    """Adds line: runs of one baseline, each within LINE_GAP of the larger size from the run before it."""
    w = Window.partitionBy(*within).orderBy("y", "x", "index")
    new = F.abs(F.col("y") - F.lag("y").over(w)) > LINE_GAP * F.greatest("size", F.lag("size").over(w))
    return runs.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _checked(columns: int | None) -> None:
    if columns is not None and not 1 <= columns <= MAX_COLUMNS:
        raise ValueError(f"columns are 1 to {MAX_COLUMNS}, not {columns}")


def _through(runs: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """What work makes of tables of whole pages; in them runs come by page, y, x and index, and _k is their place in the page."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "index")
    sorted_ = runs.withColumns({"_upright": _upright(), "_chars": F.coalesce(F.length("text"), F.lit(0)), "_k": F.row_number().over(w)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.whole(batches, "_k"):
            yield work(t)

    return sorted_.mapInArrow(run, schema)


def reading_order(runs: DataFrame, page_width: float, columns: int | None = None) -> DataFrame:
    """runs with group (0-based, in reading order within the page), gutters (empty where the page is read top to bottom) and candidates.

    Pages are told apart. Without columns they are inferred: gutters are bands that narrow
    fragments leave empty, more than AUTO_COLUMNS of them are a table (candidates says how
    many columns those would be) and not believed, and each side must hold a column. Lines
    across a gutter are a group each; between them, columns are read in turn. Runs that
    are not upright find no columns; they go with their line, in the first column. Fewer
    than LEAST_RUNS upright runs are read top to bottom. A task holds some pages at a time.
    """
    _checked(columns)
    if columns == 1:
        return runs.withColumns({"group": F.lit(0).cast("long"), "gutters": F.array().cast("array<double>"), "candidates": F.lit(None).cast("int")})
    names = runs.columns
    schema = T.StructType([*runs.schema.fields, T.StructField("group", T.LongType()), T.StructField("gutters", T.ArrayType(T.DoubleType())), T.StructField("candidates", T.IntegerType())])

    def work(t: pa.Table) -> pa.RecordBatch:
        own = A.ordered(t, page_width, columns)
        return pa.RecordBatch.from_arrays([*[A.column(t, c) for c in names], *own], names=schema.names)

    return _through(runs, work, schema)


def text_lines(ordered: DataFrame) -> DataFrame:
    """A row per line: doc, page, group, line, text, x, y, size (modal, the larger of equals), bold, gaps, n_runs, second_x, first_text, rest.

    Between two runs comes a space if the gap is wider than a quarter of the size and
    neither side has one. gaps are places after more than one and a half sizes.
    """
    key = [*PAGE, "group", "line"]
    lined = with_lines(ordered, [*PAGE, "group"])
    w = Window.partitionBy(*key).orderBy("x", "index")
    gap = F.col("x") - (F.lag("x").over(w) + F.lag("width").over(w))
    size = F.lag("size").over(w)
    space = (gap > size * 0.25) & ~F.lag("text").over(w).rlike(r"\s$") & ~F.col("text").rlike(r"^\s")
    pieces = lined.withColumns({"_piece": F.concat(F.when(space, " ").otherwise(""), "text"), "_gap": F.when(gap > size * 1.5, F.round("x", 2)), "_k": F.row_number().over(w)})
    sizes = pieces.groupBy(*key, "size").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max(F.struct("n", "size"))["size"].alias("size"))
    item = F.struct("_k", "_piece", "_gap", "x", "y", "text")
    rows = pieces.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("r"), F.bool_and("bold").alias("bold"))
    joined = F.array_join(F.transform("r", lambda p: p["_piece"]), "")
    rest = F.trim(F.regexp_replace(F.array_join(F.transform(F.slice("r", 2, F.size("r")), lambda p: p["text"]), " "), r"\s+", " "))
    first = F.get("r", F.lit(0))
    return rows.join(sizes, key).select(
        *key, joined.alias("raw"), F.regexp_replace(joined, r"^\s+|\s+$", "").alias("text"), F.round(first["x"], 2).alias("x"), first["y"].alias("y"), "size", "bold", F.filter(F.transform("r", lambda p: p["_gap"]), lambda g: g.isNotNull()).alias("gaps"),
        F.size("r").alias("n_runs"), F.get("r", F.lit(1))["x"].alias("second_x"), F.trim(first["text"]).alias("first_text"), rest.alias("rest"),
    )


def page_text(ordered: DataFrame) -> DataFrame:
    """doc, page, text: the lines of each group in turn, without those groups that have no text."""
    rows = text_lines(ordered).groupBy(*PAGE, "group").agg(F.sort_array(F.collect_list(F.struct("line", F.regexp_replace("raw", r"\s+$", "").alias("t")))).alias("l"))
    rows = rows.select(*PAGE, "group", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("t")).where("t <> ''")
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group", "t"))), lambda x: x["t"]), "\n").alias("text"))


def page_texts(runs: DataFrame, page_width: float, columns: int | None = None) -> DataFrame:
    """page_text() of the runs in reading_order(), in one pass over each page."""
    _checked(columns)
    schema = T.StructType([*[runs.schema[c] for c in PAGE], T.StructField("text", T.StringType())])

    def work(t: pa.Table) -> pa.RecordBatch:
        row, text = A.texts(t, page_width, columns)
        return pa.RecordBatch.from_arrays([*[A.column(t, c).take(pa.array(row)) for c in PAGE], text.cast(pa.string())], names=schema.names)

    return _through(runs.select(*PAGE, "index", "text", "x", "y", "width", "size", "angle", "vertical"), work, schema)


def _masked() -> Column:
    return F.regexp_replace(F.trim("text"), r"\d+", "#")


def without_running_text(runs: DataFrame, page_height: float, share: float = RUNNING_SHARE, least_pages: int = RUNNING_PAGES) -> DataFrame:
    """Runs without headers and footers: text, digits masked, at one height within an eighth of an edge on so many pages of a document."""
    height = F.floor(F.col("y") / 2 + 0.5)
    keyed = runs.withColumns({"_y": height, "_masked": _masked()})
    pages = runs.groupBy("doc").agg(F.count_distinct("page").alias("_pages")).where(F.col("_pages") >= least_pages)
    seen = keyed.groupBy("doc", "_y", "_masked").agg(F.count_distinct("page").alias("_on")).join(pages, "doc")
    edge = page_height * RUNNING_EDGE
    gone = seen.where((F.col("_on") >= share * F.col("_pages")) & ~((F.col("_y") * 2 > edge) & (F.col("_y") * 2 < page_height - edge))).select("doc", "_y", "_masked")
    return keyed.join(gone, ["doc", "_y", "_masked"], "left_anti").select(runs.columns)


def blocks(runs: DataFrame, page_width: float, page_height: float, columns: int | None = None) -> DataFrame:
    """doc, block, kind (heading, paragraph, list, item), level, ordered, text, bold, first_page, last_page, parent.

    Upright runs without running headers are put in reading order. A line larger than the
    body's size is a heading, its level the rank of its size in the document; list items
    and paragraphs are told by markers, spacing, indents, sizes and final stops, and may go
    on over a page's end. Modes of a document's lines (size of the body, spacing, left
    margin) decide on each of them, so a task holds some whole documents at a time, and one
    document's runs at least. Runs without a document are left out. Empty tables give no blocks.
    """
    _checked(columns)
    kept = runs.where(_upright() & F.col("doc").isNotNull())
    height = F.floor(F.col("y") / 2 + 0.5)
    edge = page_height * RUNNING_EDGE
    at_edge = ~((height * 2 > edge) & (height * 2 < page_height - edge))
    sorted_ = kept.select(
        *PAGE, "index", "text", "x", "y", "width", "size", "bold", F.round("x", 2).alias("_x"), height.alias("_y"), F.when(at_edge, _masked()).alias("_edge"), (F.floor(F.col("size") * 4 + 0.5) / 4).alias("_bucket"),
        F.coalesce(F.length("text"), F.lit(0)).alias("_chars"), F.row_number().over(Window.partitionBy("doc").orderBy("page", "y", "x", "index")).alias("_k"),
    )
    kinds = {"block": T.LongType(), "kind": T.StringType(), "level": T.IntegerType(), "ordered": T.BooleanType(), "text": T.StringType(), "bold": T.BooleanType(), "first_page": runs.schema["page"].dataType, "last_page": runs.schema["page"].dataType, "parent": T.LongType()}
    schema = T.StructType([runs.schema["doc"], *[T.StructField(n, x) for n, x in kinds.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in A.whole(batches, "_k"):
            if (out := A.blocks(t, page_width, columns, RUNNING_SHARE, RUNNING_PAGES)) is not None:
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return sorted_.mapInArrow(run, schema)

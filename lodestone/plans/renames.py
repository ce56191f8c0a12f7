"""Queries of renames and canonical links over the synthetic workspace."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import renames as R
from lodestone.operators.ordered import cut
from lodestone.sources import table
from lodestone.sources import workspace as W

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
MD = W.oracle_lines()


def _parsed(s, d):
    return cut(W.parsed(table(s, d, "documents"), keep=("content",)).select("path", "content", "headings", "links"))  # read several times


def _shown(parsed, edits):
    """Edits without their ranges, and whether these hold what the edit expects."""
    held = F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("expected")
    return edits.join(parsed.select(F.col("path").alias("file"), "content"), "file").select("file", "line", "expected", "value", held.alias("exact"))


def _headings(s, d):
    parsed = _parsed(s, d)
    wanted = W.markdown(table(s, d, "documents")).where("doc_id % 5 = 0").select("path", F.lit("part 0").alias("heading"), F.lit("part-0").alias("slug"), F.lit("Part 9").alias("new"))
    return _shown(parsed, R.rename_headings(parsed, wanted))


def _files(s, d):
    parsed = _parsed(s, d)
    moves = W.markdown(table(s, d, "documents")).where("doc_id % 9 = 2").select(F.col("path").alias("source"), F.expr("concat('m/doc-', doc_id, '.md')").alias("destination"))
    return _shown(parsed, R.rename_files(parsed, moves))


def _canonical(s, d):
    parsed = _parsed(s, d)
    return _shown(parsed, R.canonical_links(parsed))


QUERIES["edit_rename_headings"] = _headings
ORACLE_SQL["edit_rename_headings"] = f"""WITH {MD}, d AS (SELECT path FROM md_docs WHERE i % 5 = 0 AND i % 4 >= 1)
SELECT path AS file, line, 'Part 0' AS expected, 'Part 9' AS value, true AS exact FROM md_headings WHERE path IN (SELECT path FROM d) AND slug = 'part-0'
UNION ALL SELECT path, line, target, replace(target, '#part-0', '#part-9'), true FROM md_links WHERE fragment = 'part-0' AND resolved IN (SELECT path FROM d)"""
QUERIES["edit_rename_files"] = _files
ORACLE_SQL["edit_rename_files"] = f"""WITH {MD}, moves AS (SELECT path AS source, concat('m/doc-', i, '.md') AS destination FROM md_docs WHERE i % 9 = 2),
l AS (SELECT path, line, target, coalesce(a.destination, path) AS own, coalesce(t.destination, resolved) AS goes FROM md_links LEFT JOIN moves a ON a.source = path LEFT JOIN moves t ON t.source = resolved WHERE NOT external AND (a.source IS NOT NULL OR t.source IS NOT NULL)),
v AS (SELECT path, line, target, concat(CASE WHEN split_part(own, '/', 1) = split_part(goes, '/', 1) THEN split_part(goes, '/', 2) ELSE concat('../', goes) END, regexp_extract(target, '#.*$')) AS value FROM l)
SELECT path AS file, line, target AS expected, value, true AS exact FROM v WHERE value <> target"""
QUERIES["edit_canonical_links"] = _canonical
ORACLE_SQL["edit_canonical_links"] = f"""WITH {MD}
SELECT path AS file, line, target AS expected, concat(split_part(resolved, '/', 2), regexp_extract(target, '#.*$')) AS value, true AS exact FROM md_links WHERE NOT external AND split_part(resolved, '/', 1) = split_part(path, '/', 1)"""

"""A synthetic Markdown workspace over the documents table: every document's markup follows from its doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import extract
from lodestone.sources import spread

#: Link targets are taken modulo this, so that some exist and some do not.
MODULUS = 977


def markdown(docs: DataFrame, revision: int = 0) -> DataFrame:
    """doc_id, path, content. Revision 1 changes headings, tasks and owners, revision 2 links, code, tables and bodies of some; both lack some documents."""
    i = "doc_id"
    r = revision
    part = f"concat('## Part ', k % 2, CASE WHEN {r} = 1 AND doc_id % 6 = 5 AND k = 0 THEN ' new' ELSE '' END)"
    also = f"(({i} * 13 + 5 + CASE WHEN {r} = 2 AND {i} % 9 = 1 THEN 1 ELSE 0 END) % {MODULUS})"
    lines = f"""concat(
      array('---', concat('title: Title ', {i} % 50), concat('lang: ', lang), concat('n_chars: ', n_chars)),
      CASE WHEN {i} % 5 = 0 THEN array() WHEN {i} % 7 = 0 THEN array('owner: null') ELSE array(concat('owner: o', ({i} + {r} * CASE WHEN {i} % 8 = 3 THEN 1 ELSE 0 END) % 4)) END,
      CASE WHEN {i} % 3 = 0 THEN array(concat('tags: [a, b', {i} % 6, ']')) ELSE array() END,
      array('---', ''),
      CASE WHEN {i} % 11 <> 0 THEN array(concat('# Doc ', {i}), '') ELSE array() END,
      flatten(transform(CASE WHEN {i} % 4 = 0 THEN array() ELSE sequence(0, cast({i} % 4 - 1 as int)) END, k -> array({part}, concat(CASE WHEN {r} = 2 AND {i} % 9 = 4 AND k = 0 THEN 'other' ELSE 'some' END, ' words for ', {i}), ''))),
      array(concat('[next](../d', ({i} * 7 + 1) % {MODULUS} % 10, '/doc-', ({i} * 7 + 1) % {MODULUS}, CASE WHEN {r} = 2 AND {i} % 4 = 2 THEN '.md#part-1)' ELSE '.md#part-0)' END)),
      CASE WHEN {r} = 2 AND {i} % 8 = 6 THEN array() ELSE array(concat('[also](../d', {also} % 10, '/doc-', {also}, '.md)')) END,
      CASE WHEN {r} = 2 AND {i} % 8 = 7 THEN array('[extra](../d0/doc-0.md)') ELSE array() END,
      CASE WHEN {i} % 4 = 1 THEN array(concat('![img](../img/pic-', {i} % 6, '.png)')) ELSE array() END,
      CASE WHEN {i} % 3 = 1 THEN array(concat(CASE WHEN {r} = 2 AND {i} % 5 = 3 THEN '[home]' ELSE '[site]' END, '(https://h', {i} % 9, '.example.com/x)')) ELSE array() END,
      array(''),
      transform(CASE WHEN {i} % 3 = 0 THEN array() ELSE sequence(0, cast({i} % 3 - 1 as int)) END, k -> concat(CASE WHEN ({i} + k + {r} * CASE WHEN {i} % 10 = 4 THEN 1 ELSE 0 END) % 2 = 0 THEN '- [x] item ' ELSE '- [ ] item ' END, k)),
      array(''),
      CASE WHEN {i} % 2 = 0 AND NOT ({r} = 2 AND {i} % 16 = 0) THEN array(concat('```', CASE WHEN {i} % 4 = 0 THEN 'python' WHEN {r} = 2 AND {i} % 8 = 2 THEN 'sql' ELSE '' END), CASE WHEN {r} = 2 AND {i} % 12 = 4 THEN '# other' ELSE '# not a heading' END, '[fake](x.md)', '```') ELSE array() END,
      CASE WHEN {i} % 7 <> 2 THEN array()
        WHEN {r} = 2 AND {i} % 3 = 0 THEN array('', '| a | c |', '|---|:-:|', '| 1 | 2 |')
        WHEN {r} = 2 AND {i} % 3 = 1 THEN array('', '| a | b |', '|---|:-:|', '| 1 | 2 |', '| 3 | 4 |')
        WHEN {r} = 2 AND {i} % 2 = 0 THEN array('', '| a | b | x |', '|---|:-:|---|', '| 1 | 2 | 3 |')
        ELSE array('', '| a | b |', '|---|:-:|', '| 1 | 2 |') END)"""
    out = docs.where("doc_id is not null").select("doc_id", F.expr("concat('d', doc_id % 10, '/doc-', doc_id, '.md')").alias("path"), F.expr(f"array_join({lines}, '\n')").alias("content"))
    if revision:
        out = out.where("doc_id % 17 <> 3")
    return out


def parsed(docs: DataFrame, revision: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """The workspace's parsed documents; a table in fewer partitions than there are cores is dealt anew, as parsing costs more than a shuffle."""
    return extract.parse_documents(markdown(spread(docs, "doc_id"), revision), keep)


def oracle_lines(revision: int = 0) -> str:
    """DuckDB WITH entries md_lines{revision}(doc_id, path, line, tag, a, b): what each line is, by arithmetic alone."""
    r, m, n = revision, MODULUS, ("" if not revision else str(revision))
    row = lambda tag, a="''", b="''": f"{{'tag': '{tag}', 'a': CAST({a} AS VARCHAR), 'b': CAST({b} AS VARCHAR)}}"
    link = lambda name, t: row("link", f"'{name}'", t)
    t1, t2 = f"(i * 7 + 1) % {m}", f"((i * 13 + 5 + CASE WHEN {r} = 2 AND i % 9 = 1 THEN 1 ELSE 0 END) % {m})"
    table = lambda headers, rows, more="": f"[{row('blank')}, {row('table', headers, rows)}, {row('rule')}, {row('cells')}{more}]"
    cells = ", " + row("cells")
    return f"""
md_docs{n} AS (SELECT doc_id AS i, lang, n_chars, concat('d', doc_id % 10, '/doc-', doc_id, '.md') AS path FROM documents WHERE doc_id IS NOT NULL{" AND doc_id % 17 <> 3" if r else ""}),
md_lists{n} AS (SELECT i, path, list_concat(
  [{row("front")}, {row("front")}, {row("front")}, {row("front")}],
  CASE WHEN i % 5 = 0 THEN [] ELSE [{row("front")}] END,
  CASE WHEN i % 3 = 0 THEN [{row("front")}] ELSE [] END,
  [{row("front")}, {row("blank")}],
  CASE WHEN i % 11 <> 0 THEN [{row("head", "1", "concat('Doc ', i)")}, {row("blank")}] ELSE [] END,
  flatten(list_transform(range(i % 4), lambda k: [{row("head", "2", f"concat('Part ', k % 2, CASE WHEN {r} = 1 AND i % 6 = 5 AND k = 0 THEN ' new' ELSE '' END)")}, {row("text", f"concat(CASE WHEN {r} = 2 AND i % 9 = 4 AND k = 0 THEN 'other' ELSE 'some' END, ' words for ', i)")}, {row("blank")}])),
  [{link("next", f"concat('../d', {t1} % 10, '/doc-', {t1}, CASE WHEN {r} = 2 AND i % 4 = 2 THEN '.md#part-1' ELSE '.md#part-0' END)")}],
  CASE WHEN {r} = 2 AND i % 8 = 6 THEN [] ELSE [{link("also", f"concat('../d', {t2} % 10, '/doc-', {t2}, '.md')")}] END,
  CASE WHEN {r} = 2 AND i % 8 = 7 THEN [{link("extra", "'../d0/doc-0.md'")}] ELSE [] END,
  CASE WHEN i % 4 = 1 THEN [{row("image", "'img'", "concat('../img/pic-', i % 6, '.png')")}] ELSE [] END,
  CASE WHEN i % 3 = 1 THEN [{row("site", f"CASE WHEN {r} = 2 AND i % 5 = 3 THEN 'home' ELSE 'site' END", "concat('https://h', i % 9, '.example.com/x')")}] ELSE [] END,
  [{row("blank")}],
  list_transform(range(i % 3), lambda k: {row("task", f"(i + k + {r} * CASE WHEN i % 10 = 4 THEN 1 ELSE 0 END) % 2 = 0", "concat('item ', k)")}),
  [{row("blank")}],
  CASE WHEN i % 2 = 0 AND NOT ({r} = 2 AND i % 16 = 0) THEN [{row("fence", f"CASE WHEN i % 4 = 0 THEN 'python' WHEN {r} = 2 AND i % 8 = 2 THEN 'sql' END")}, {row("code", f"CASE WHEN {r} = 2 AND i % 12 = 4 THEN 'other' ELSE '' END")}, {row("code")}, {row("end")}] ELSE [] END,
  CASE WHEN i % 7 <> 2 THEN [] WHEN {r} = 2 AND i % 3 = 0 THEN {table("'a,c'", "1")} WHEN {r} = 2 AND i % 3 = 1 THEN {table("'a,b'", "2", cells)} WHEN {r} = 2 AND i % 2 = 0 THEN {table("'a,b,x'", "1")} ELSE {table("'a,b'", "1")} END) AS l FROM md_docs{n}),
md_lines{n} AS (SELECT i AS doc_id, path, CAST(k AS INTEGER) AS line, l[k].tag AS tag, l[k].a AS a, l[k].b AS b, CAST(len(l) AS INTEGER) AS n_lines FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM md_lists{n})),
md_heads{n} AS (SELECT doc_id, path, line, CAST(a AS INTEGER) AS depth, b AS text, n_lines, lower(replace(b, ' ', '-')) AS base, row_number() OVER (PARTITION BY doc_id, b ORDER BY line) - 1 AS nth FROM md_lines{n} WHERE tag = 'head'),
md_headings{n} AS (SELECT doc_id, path, line, depth, text, n_lines, CASE WHEN nth = 0 THEN base ELSE concat(base, '-', nth) END AS slug FROM md_heads{n}),
md_links{n} AS (SELECT doc_id, path, line, a AS text, b AS target, tag = 'image' AS image, tag = 'site' AS external,
    CASE WHEN tag = 'site' THEN NULL ELSE regexp_replace(substr(b, 4), '#.*$', '') END AS resolved, CASE WHEN contains(b, '#') THEN regexp_extract(b, '#(.*)$', 1) END AS fragment
  FROM md_lines{n} WHERE tag IN ('link', 'image', 'site'))"""

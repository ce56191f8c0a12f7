"""Queries over pages: the documents' whole texts, set in one or two columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import pages as P
from lodestone.sources import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WIDTH, HEIGHT = 612.0, 792.0


def _runs(s, d):
    """Four words are a run; two documents of three are set in two columns of 40 lines, every fifth has a wide title on each page.

    Texts are dealt by document once, and all that comes after stays where they are. An id
    that comes twice has its words at each place together, as the SQL has them; one that is
    null has no pages.
    """
    texts = table(s, d, "documents").where("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list("text").alias("texts"))
    words = texts.select("doc", F.transform("texts", lambda t: F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    n = F.array_max(F.transform("words", F.size))
    four = lambda k: F.array_join(F.slice(F.get("words", F.lit(0)), k * 4 + 1, 4), " ")
    at = lambda k: F.array_sort(F.filter(F.transform("words", lambda w: F.get(w, k)), lambda x: x.isNotNull()))
    mixed = lambda k: F.array_join(F.flatten(F.transform(F.sequence(k * 4, k * 4 + 3), at)), " ")
    every = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), lambda k: F.when(F.size("words") == 1, four(k)).otherwise(mixed(k)))
    runs = words.select("doc", F.posexplode(F.when(n > 0, every)).alias("k", "text")).select("doc", F.col("k").cast("long").alias("index"), "text")
    two = F.col("doc") % 3 != 0
    page, column, row = F.floor(F.col("index") / F.when(two, 80).otherwise(40)), F.when(two, F.floor(F.col("index") % 80 / 40)).otherwise(0), F.col("index") % 40
    title = (F.col("doc") % 5 == 0) & (row == 0) & (column == 0)
    return runs.select(
        "doc", page.alias("page"), "index", "text", (50.0 + 260 * column).alias("x"), (60.0 + 14 * row).alias("y"), F.when(title, 500.0).otherwise(5.0 * F.length("text")).alias("width"), F.when(title, 18.0).otherwise(10.0).alias("size"),
        F.lit(0.0).alias("angle"), F.lit(False).alias("vertical"), title.alias("bold"),
    )


_RUNS = r"""w AS (SELECT doc, k, l[k + 1] AS word FROM (SELECT doc_id AS doc, l, unnest(range(len(l))) AS k FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents))),
c AS (SELECT doc, k // 4 AS index, string_agg(word, ' ' ORDER BY k) AS text FROM w GROUP BY ALL),
p AS (SELECT doc, index, text, index // CASE WHEN doc % 3 <> 0 THEN 80 ELSE 40 END AS page, CASE WHEN doc % 3 <> 0 THEN index % 80 // 40 ELSE 0 END AS col, index % 40 AS row FROM c),
r AS (SELECT doc, page, index, text, CAST(50 + 260 * col AS DOUBLE) AS x, CAST(60 + 14 * row AS DOUBLE) AS y, doc % 5 = 0 AND row = 0 AND col = 0 AS title,
  CASE WHEN title THEN 500.0::DOUBLE ELSE 5.0::DOUBLE * length(text) END AS width, CASE WHEN title THEN 18.0::DOUBLE ELSE 10.0::DOUBLE END AS size FROM p)"""
_ORDER = f"""{_RUNS},
s1 AS (SELECT *, CASE WHEN abs(y - lag(y) OVER t) > {P.LINE_GAP} * greatest(size, lag(size) OVER t) THEN 1 ELSE 0 END AS new FROM r WINDOW t AS (PARTITION BY doc, page ORDER BY y, x, index)),
l AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY y, x, index ROWS UNBOUNDED PRECEDING) AS line FROM s1),
s2 AS (SELECT *, CASE WHEN x - max(x + width) OVER (PARTITION BY doc, page, line ORDER BY x, index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > greatest(3, size) THEN 1 ELSE 0 END AS cut FROM l),
s3 AS (SELECT *, sum(cut) OVER (PARTITION BY doc, page, line ORDER BY x, index ROWS UNBOUNDED PRECEDING) AS fragment FROM s2),
f AS (SELECT doc, page, line, fragment, min(x) AS x0, max(x + width) AS x1, sum(length(text)) AS chars, min(y) AS y FROM s3 GROUP BY ALL),
pages AS (SELECT doc, page, min(x) AS a, max(x + width) AS b, max(y) - min(y) AS height, list_sort(list(size))[count(*) // 2 + 1] AS body FROM r GROUP BY ALL HAVING count(*) >= {P.LEAST_RUNS}),
n AS (SELECT f.*, a, b, height, (b - a) / {P.CELLS} AS step, greatest({WIDTH * 0.015}, body * 0.8) AS least FROM f JOIN pages USING (doc, page)),
cells AS (SELECT *, greatest(0, floor((x0 - a) / step)) AS c0, least({P.CELLS - 1}, floor((x1 - a) / step)) AS c1 FROM n WHERE b > a AND x1 - x0 < (b - a) * {P.WIDE}),
swept AS (SELECT *, max(c1) OVER (PARTITION BY doc, page ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS c9 FROM cells),
bands AS (SELECT doc, page, a + c9 * step AS low, a + c0 * step AS high FROM swept WHERE c0 > c9 AND (c0 - c9) * step >= least),
ranked AS (SELECT *, (low + high) / 2 AS gutter, row_number() OVER (PARTITION BY doc, page ORDER BY low - high, low DESC) AS rk, count(*) OVER (PARTITION BY doc, page) AS n FROM bands),
sets AS (SELECT doc, page, k, list_sort(list(gutter)) AS g FROM ranked, (SELECT unnest(range(1, {P.AUTO_COLUMNS + 1})) AS k) WHERE n <= {P.AUTO_COLUMNS} AND k <= n AND rk <= k GROUP BY doc, page, k),
sides AS (SELECT *, unnest(range(len(g) + 1)) AS col FROM sets),
stats AS (SELECT doc, page, k, g, col, count(DISTINCT line) AS lines, sum(chars) AS chars, max_by(y, line) - min_by(y, line) AS tall, max(x1) - min(x0) AS wide, list_sort(list(x1 - x0))[count(*) // 2 + 1] AS fill, list_sort(list(chars))[count(*) // 2 + 1] AS long, any_value(b - a) AS width, any_value(height) AS height
  FROM sides JOIN n USING (doc, page) WHERE x0 >= CASE WHEN col = 0 THEN '-inf'::DOUBLE ELSE g[col] END AND x1 <= CASE WHEN col = len(g) THEN 'inf'::DOUBLE ELSE g[col + 1] END GROUP BY ALL),
good AS (SELECT doc, page, k, g FROM stats JOIN (SELECT doc, page, sum(chars) AS total FROM f GROUP BY ALL) USING (doc, page)
  WHERE lines >= {P.COLUMN_LINES} AND chars >= total * {P.COLUMN_TEXT!r}::DOUBLE AND (height <= 0 OR tall >= height * {P.COLUMN_HEIGHT}) AND wide >= width * {P.COLUMN_WIDTH} AND fill >= wide * {P.COLUMN_FILL} AND long >= {P.COLUMN_CHARS}
  GROUP BY doc, page, k, g HAVING count(*) = len(g) + 1),
chosen AS (SELECT doc, page, max_by(g, k) AS g FROM good GROUP BY ALL),
crossing AS (SELECT doc, page, line, bool_or(len(list_filter(g, lambda q: x0 < q AND x1 > q)) > 0) AS crosses FROM f JOIN chosen USING (doc, page) GROUP BY ALL),
placed AS (SELECT s3.doc, s3.page, index, text, x, s3.y, size, width, g, coalesce(crosses, false) AS crosses, s3.line, len(list_filter(g, lambda q: (x0 + x1) / 2 >= q)) AS col,
    (SELECT count(*) FROM crossing k WHERE k.doc = s3.doc AND k.page = s3.page AND k.line < s3.line AND k.crosses) AS stretch
  FROM s3 JOIN f USING (doc, page, line, fragment) LEFT JOIN chosen ON chosen.doc = s3.doc AND chosen.page = s3.page LEFT JOIN crossing ON crossing.doc = s3.doc AND crossing.page = s3.page AND crossing.line = s3.line),
ordered AS (SELECT doc, page, index, text, x, y, size, width, CASE WHEN g IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY doc, page ORDER BY stretch, crosses, CASE WHEN crosses THEN 0 ELSE col END) - 1 END AS "group", coalesce(len(g), 0) + 1 AS columns FROM placed)"""

QUERIES["layout_reading_order"] = lambda s, d: P.reading_order(_runs(s, d), WIDTH).select("doc", "page", "index", "group", (F.size("gutters") + 1).alias("columns"), "candidates")
ORACLE_SQL["layout_reading_order"] = f"WITH {_ORDER} SELECT o.doc, o.page, index, CAST(\"group\" AS BIGINT) AS \"group\", CAST(columns AS INTEGER) AS columns, CAST(c.n + 1 AS INTEGER) AS candidates FROM ordered o LEFT JOIN (SELECT doc, page, n FROM ranked WHERE n > {P.AUTO_COLUMNS} GROUP BY ALL) c ON c.doc = o.doc AND c.page = o.page"
QUERIES["layout_page_text"] = lambda s, d: P.page_texts(_runs(s, d), WIDTH).select("doc", "page", F.sha2("text", 256).alias("text_sha256"))
ORACLE_SQL["layout_page_text"] = f"""WITH {_ORDER}, again AS (SELECT *, CASE WHEN abs(y - lag(y) OVER t) > {P.LINE_GAP} * greatest(size, lag(size) OVER t) THEN 1 ELSE 0 END AS new FROM ordered WINDOW t AS (PARTITION BY doc, page, "group" ORDER BY y, x, index)),
lined AS (SELECT *, sum(new) OVER (PARTITION BY doc, page, "group" ORDER BY y, x, index ROWS UNBOUNDED PRECEDING) AS line FROM again),
spaced AS (SELECT *, CASE WHEN x - lag(x + width) OVER t > 0.25 * lag(size) OVER t THEN ' ' || text ELSE text END AS piece FROM lined WINDOW t AS (PARTITION BY doc, page, "group", line ORDER BY x, index)),
rows_ AS (SELECT doc, page, "group", line, string_agg(piece, '' ORDER BY x, index) AS t FROM spaced GROUP BY ALL),
groups_ AS (SELECT doc, page, "group", string_agg(t, chr(10) ORDER BY line) AS t FROM rows_ GROUP BY ALL)
SELECT doc, page, sha256(string_agg(t, chr(10) ORDER BY "group")) AS text_sha256 FROM groups_ GROUP BY ALL"""
QUERIES["layout_blocks"] = lambda s, d: P.blocks(_runs(s, d), WIDTH, HEIGHT)

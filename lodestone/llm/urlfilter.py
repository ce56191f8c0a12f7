"""URL filters: host and path rules, then trust and distrust propagated over host links.

A url's longest fitting rule decides. Other hosts get a verdict from two personalised
PageRanks over host edges: trust flows along links from hosts whose pages are allowed,
distrust against them from hosts whose pages are blocked. Edges are absolute links
between hosts, and both ways between a host and its parent domain (of two labels or
more). All of it is joins and aggregations on host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_stage, stage

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING = 0.85
#: Propagation ends when less than this share of all trust and of all distrust is still on its way; it is an error if so many rounds do not suffice.
UNSETTLED, MOST_ROUNDS = 1e-6, 400
#: Rounds between two written tables.
WRITTEN_EVERY = 8
#: A host is blocked if its distrust exceeds so many times its trust; a little above 1, so that equal shares allow whatever their last digits.
BLOCK_RATIO = 1.000001
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?https?://([^/"'?#\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null urls and such without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of rule and verdict, or null. Rules are a parameter of at most some hundreds; of equal length a blocking one wins."""
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules; join longer lists on host suffixes")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for h, p, v in rules]
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct src, dst. pages: host, html. Null and empty html has no links, an empty host none; repeated pages change nothing, other columns do not matter, an empty table gives an empty result."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> '' and src <> dst").distinct()
    names = pages.select(F.col("host").alias("h")).unionByName(links.select(F.col("dst").alias("h"))).where("h <> ''").distinct()
    labels = F.split("h", r"\.")
    # a host's chain of domains: each step is an edge, both ways
    steps = names.select(F.explode(F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("a"), F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("b"))))).alias("s")).select("s.a", "s.b").distinct()
    return links.unionByName(steps.select(F.col("a").alias("src"), F.col("b").alias("dst"))).unionByName(steps.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, unsettled: float = UNSETTLED) -> DataFrame:
    """host, trust, distrust once they have settled; a stage table. seeds: host, trust, distrust (not negative), scaled to sum to 1 each.

    Each round passes on what came in the round before and adds it up: a share of damping
    of what a host got goes to its neighbours, so what is on its way shrinks by that
    factor at least. Without seeds, or without edges, hosts keep what they start with,
    times 1 - damping. Repeated edges count as often as they come.
    """
    sums = seeds.agg(F.sum("trust").alias("all_trust"), F.sum("distrust").alias("all_distrust"))
    share = lambda x, all_: F.coalesce(F.try_divide(x, all_), F.lit(0.0))
    start = seeds.join(F.broadcast(sums)).select("host", share("trust", "all_trust").alias("dt"), share("distrust", "all_distrust").alias("dd"))  # sums: one row
    now = stage(start.select("host", F.col("dt").alias("trust"), F.col("dd").alias("distrust"), "dt", "dd"), "score")
    out, into = edges.groupBy("src").agg(F.count("*").alias("n_out")), edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    flow = edges.join(out, "src").join(into, "dst")
    # trust goes from src to dst, shared among src's links; distrust from dst to src, shared among dst's
    no = F.lit(0.0)
    trust = flow.select(F.col("src").alias("giver"), F.col("dst").alias("taker"), (damping / F.col("n_out")).alias("t"), no.alias("d"), no.alias("keep"))
    distrust = flow.select(F.col("dst").alias("giver"), F.col("src").alias("taker"), no.alias("t"), (damping / F.col("n_in")).alias("d"), no.alias("keep"))
    # every host also keeps what it has, so that a round reads the one before it once
    hosts = edges.select(F.col("src").alias("h")).unionByName(edges.select(F.col("dst").alias("h"))).unionByName(seeds.select(F.col("host").alias("h"))).distinct()
    held = hosts.select(F.col("h").alias("giver"), F.col("h").alias("taker"), no.alias("t"), no.alias("d"), F.lit(1.0).alias("keep"))
    flow = stage(trust.unionByName(distrust).unionByName(held), "flow")
    for _ in range(0, MOST_ROUNDS, WRITTEN_EVERY):
        left = now.agg(F.coalesce(F.greatest(F.sum("dt"), F.sum("dd")), F.lit(0.0)).alias("x")).first()["x"]
        if left < unsettled:
            drop_stage(flow)
            return now.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
        step = now
        for _ in range(WRITTEN_EVERY):
            came = flow.join(step.withColumnRenamed("host", "giver"), "giver").groupBy(F.col("taker").alias("host"))
            came = came.agg(*[F.sum(F.col(x) * F.col(y)).alias(z) for x, y, z in (("trust", "keep", "at"), ("distrust", "keep", "ad"), ("dt", "t", "dt"), ("dd", "d", "dd"))])
            step = came.select("host", (F.col("at") + F.col("dt")).alias("trust"), (F.col("ad") + F.col("dd")).alias("distrust"), "dt", "dd")
        written = stage(step, "score")
        drop_stage(now)
        now = written
    raise RuntimeError(f"trust has not settled after {MOST_ROUNDS} rounds")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule (or null), verdict of every row.

    Null urls have no host: no rule and no link reaches them, they are allowed. A host
    that neither trust nor distrust reaches is allowed. Null html has no links. Null and
    repeated ids and repeated rows are judged by their urls; of rules of equal length
    the blocking one wins; other columns are left out; an empty table gives an empty
    result.
    """
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"), host.alias("host"), path.alias("path"))
    ruled = split.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("hit.verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("hit.verdict") == "block", 1.0).otherwise(0.0)).alias("distrust"))
    edges = stage(host_edges(split.select("host", "html")), "host_edges")
    score = propagate(edges, seeds)
    drop_stage(edges)
    blocked = score.where(F.col("distrust") > BLOCK_RATIO * F.col("trust")).select("host", F.lit("block").alias("host_verdict"))
    # only pages without a rule look their host up, so that a ruled hot host is not dealt to one task
    ready = ruled.where("hit is not null").withColumn("host_verdict", F.lit(None).cast("string"))
    asked = ruled.where("hit is null").join(blocked, "host", "left").select(*ready.columns)
    return ready.unionByName(asked).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "host_verdict", F.lit("allow")).alias("verdict"))


def judge_sql(rules=RULES) -> str:
    """DuckDB SQL of judge() over pages."""
    fits = "\n    UNION ALL ".join(f"SELECT '{h}' AS rh, '{p}' AS rp, '{v}' AS rv" for h, p, v in rules)
    return f"""
WITH RECURSIVE rules AS ({fits}),
cutoff AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
halves AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cutoff),
split AS (SELECT page_id, html, coalesce(translate(raw, '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM halves),
places AS (SELECT DISTINCT host, path FROM split),
hits AS (SELECT host, path, rh || rp AS rule, rv,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, rv DESC) AS n
  FROM places JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
ruled AS (SELECT s.*, rule, rv FROM split s LEFT JOIN hits h ON s.host = h.host AND s.path = h.path AND n = 1),
seeds AS (SELECT host, avg(CASE WHEN rv = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS trust, avg(CASE WHEN rv = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS distrust
  FROM ruled WHERE host <> '' GROUP BY host),
links AS (SELECT DISTINCT src, translate(d, '{_UPPER}', '{_LOWER}') AS dst
  FROM (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?https?://([^/"''?#\\s>]+)', 1)) AS d FROM split)
  WHERE src <> '' AND src <> translate(d, '{_UPPER}', '{_LOWER}')),
names AS (SELECT host AS h FROM split WHERE host <> '' UNION SELECT dst FROM links),
chain AS (SELECT string_split(h, '.') AS l, unnest(range(1, len(string_split(h, '.')) - 1)) AS k FROM names WHERE len(string_split(h, '.')) > 2),
steps AS (SELECT DISTINCT array_to_string(l[k:], '.') AS a, array_to_string(l[k + 1:], '.') AS b FROM chain),
edges AS (SELECT src, dst FROM links UNION SELECT a, b FROM steps UNION SELECT b, a FROM steps),
o AS (SELECT src, count(*) AS n_out FROM edges GROUP BY src),
i AS (SELECT dst, count(*) AS n_in FROM edges GROUP BY dst),
flow AS (
  SELECT src AS giver, dst AS taker, 1.0::DOUBLE / n_out AS ts, 0.0::DOUBLE AS ds FROM edges JOIN o USING (src)
  UNION ALL SELECT dst, src, 0.0, 1.0::DOUBLE / n_in FROM edges JOIN i USING (dst)),
base AS (SELECT host, coalesce(trust / nullif(sum(trust) OVER (), 0), 0) AS t0, coalesce(distrust / nullif(sum(distrust) OVER (), 0), 0) AS d0 FROM seeds),
way(k, host, dt, dd) AS (SELECT 0, host, t0, d0 FROM base
  UNION ALL SELECT k + 1, taker, {DAMPING} * sum(dt * ts), {DAMPING} * sum(dd * ds) FROM way JOIN flow ON giver = host WHERE k < 160 GROUP BY k, taker),
score AS (SELECT host, {1 - DAMPING} * sum(dt) AS trust, {1 - DAMPING} * sum(dd) AS distrust FROM way GROUP BY host)
SELECT page_id, ruled.host, path, rule,
  coalesce(rv, CASE WHEN distrust > {BLOCK_RATIO} * trust THEN 'block' END, 'allow') AS verdict
FROM ruled LEFT JOIN score s ON ruled.host = s.host
"""

"""Mixing sources to target weights, with DataFrame and SQL functions only.

Each source's words, in doc_id order, are packed into blocks of fixed length. Output
slots come in shards; a pseudorandom permutation deals all slots among the sources, so
a shard's source counts are a multinomial draw given exact totals. A source's slots
walk through a pseudorandom permutation of its block indices, afresh after each full
pass, and blocks are joined by index. No source is used more than MOST_PASSES times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import drop_stage, free_names, mark, release, running, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Words a block, slots a shard, times that a source may be used, rounds of the permutations (with 12, counts a shard strayed 2.8 times as far as a fair draw; with 24, 1.1 times), seed.
BLOCK, SHARD, MOST_PASSES, ROUNDS, SEED = 128, 1024, 3, 24, 20
#: Rounds of a permutation that are planned together.
STEPS = 8
#: Slots that one task draws: the second number, or fewer, down to the first, while there are cores without work.
SLOTS_TASK = (1 << 16, 1 << 22)
_M = 2147483647


def with_permuted(df: DataFrame, x: str, n: str, key: str, out: str, rounds: int = ROUNDS) -> DataFrame:
    """df with column out: x under a permutation of [0, n), swap-or-not. x, n and key are SQL of longs.

    In each round x may swap with its mirror image under a round key; a bit of a hash
    of the larger of both decides, so both decide alike. The arithmetic stays below
    2^63. A round is three plain columns, which are compiled, not a loop in a row.
    Every STEPS rounds are written down: longer chains cost the optimizer too much, and
    filters that follow would be pushed through them, doubling in each.
    """
    own, written = df.columns, []
    mirror, z = free_names([*own, out], "mirror", "z")
    df = df.withColumn(out, F.expr(f"cast({x} as bigint)"))
    for r in range(rounds):
        k = f"((({r + 1}L * 1103515 + {key} * 7919 + 9973) % {_M}) * 48271 % {_M} * {_M} + ({r + 3}L * 69621 + {key} * 16807) % {_M} * 39373 % {_M}) % {n}"
        df = df.select(*own, out, F.expr(f"(({k}) - {out} + {n}) % {n}").alias(mirror))
        m = f"greatest({out}, {mirror})"
        df = df.select(*own, out, mirror, F.expr(f"(({m}) % {_M} * 48271 + (({m}) div {_M}) * 16807 + {r}L * 7907 + {key}) % {_M} * 69621 % {_M}").alias(z))
        bit = f"shiftright((({z} ^ shiftright({z}, 15)) * 48271) % {_M}, 13) & 1"
        df = df.select(*own, F.expr(f"case when {bit} = 1 then {mirror} else {out} end").alias(out))
        if r % STEPS == STEPS - 1 or r == rounds - 1:
            df = stage(df, "permuted")
            drop_stage(*written)
            written = [df]
    return df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, uses).

    documents: doc_id, source, size, rank of the source, first (place of its first word
    in the source), for every row, and row if row_col names a key of docs. sources: source, rank, source_size, target, blocks,
    slots, base. uses: rank, block, uses of it in the mix, for blocks that are used.
    A null text has size 0; null is a source, the last one; repeated rows count apiece.
    """
    spark, since = docs.sparkSession, mark()
    row = ["row"] if row_col else []
    sizes = stage(docs.select(*[F.col(row_col).alias(c) for c in row], F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie")), "sizes")
    order = [F.col("source").asc_nulls_last(), "doc_id", "size", "tie"]
    ranged = stage(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranged")
    drop_stage(sizes)
    # A source's running sum: within parts of the range order, then over the parts' totals.
    parts = ranged.groupBy("part", "source").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "source", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_first"))
    inside = Window.partitionBy("part", "source").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    by_source = stage(_targets(ranged.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    same = placed["source"].eqNullSafe(parts["source"]) & (placed["part"] == parts["part"])
    placed = placed.join(parts, same).select(*row, placed["source"], "doc_id", "size", (F.col("part_first") + F.col("inner")).alias("first"))
    ranks = by_source.select("source", "rank")
    placed = placed.join(ranks, placed["source"].eqNullSafe(ranks["source"])).select(*row, "doc_id", placed["source"], "size", "rank", "first")
    documents, uses = stage(placed, "placed"), stage(_uses(spark, by_source), "uses")
    release(since, keep=[documents, by_source, uses])
    return documents, by_source, uses


def _targets(sizes: DataFrame) -> DataFrame:
    """Weights 1, 2, 3 in source order; targets filled up like water under caps of MOST_PASSES sizes.

    In order of cap per weight, a source is capped if its cap is within the level that
    is left once all before it are capped; the rest share what is left by weight. Sums
    run over sources dealt by range, as there may be many.
    """
    last = [F.col("source").asc_nulls_last()]
    named = running(sizes, last, {"rank": F.lit(1).cast("long")})
    named = named.withColumn("weight", F.col("rank") % 3 + 1).withColumn("cap", MOST_PASSES * F.col("source_size"))
    named = stage(named, "ranked")
    size, weights = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    named = running(named, [F.col("cap") / F.col("weight"), F.col("rank")], {"caps": F.col("cap"), "heavy": F.col("weight")})
    named = named.withColumn("capped", F.col("cap").cast("double") * (weights - F.col("heavy")) <= (size - F.col("caps")).cast("double") * F.col("weight")).drop("caps", "heavy")
    named = stage(named, "capped")
    fixed, light = named.agg(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0))).first()
    free = F.lit(float(size - fixed)) * F.col("weight") / F.lit(max(1, light))
    named = named.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free))
    named = named.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.least(MOST_PASSES * F.col("blocks"), F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long"))).otherwise(F.lit(0)).cast("long")
    named = named.withColumn("slots", slots)
    return running(named, last, {"base": F.col("slots")}).select("source", "rank", "source_size", "target", "blocks", "slots", "base")


def draws(spark, by_source: DataFrame) -> DataFrame:
    """One row per output slot: slot, shard, rank, block.

    Sources are found by coarse buckets of the dealt position, an equi-join; a bucket
    holds the sources that it meets. Tasks follow the number of slots.
    """
    total = by_source.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    width = max(1, total // 4096)
    owners = by_source.where("slots > 0").select("rank", "blocks", "slots", "base", F.explode(F.sequence(F.floor(F.col("base") / width), F.floor((F.col("base") + F.col("slots") - 1) / width))).alias("bucket"))
    least, most = SLOTS_TASK
    tasks = max(-(-total // most), min(-(-total // least), 4 * spark.sparkContext.defaultParallelism), 1)
    slots = spark.range(0, total, 1, tasks).select(F.col("id").alias("slot"), F.floor(F.col("id") / SHARD).alias("shard"))
    slots = with_permuted(slots, "slot", f"{max(1, total)}L", f"{SEED}L", "at")
    placed = slots.withColumn("bucket", F.floor(F.col("at") / width))
    hit = placed.join(owners, (placed["bucket"] == owners["bucket"]) & (F.col("at") >= F.col("base")) & (F.col("at") < F.col("base") + F.col("slots")))
    hit = hit.withColumn("turn", F.col("at") - F.col("base")).withColumn("key", SEED + 1 + F.col("rank") * MOST_PASSES + F.floor(F.col("turn") / F.col("blocks")))
    hit = hit.select("slot", "shard", "rank", "blocks", "turn", "key")
    hit = with_permuted(hit, "turn % blocks", "blocks", "key", "block")
    drop_stage(slots)
    return hit.select("slot", "shard", "rank", "block")


def shard_counts(draws: DataFrame) -> DataFrame:
    """shard, rank, n: how many slots of each output shard a source got, the multinomial draw given exact totals; no draws, no rows."""
    return draws.groupBy("shard", "rank").agg(F.count("*").alias("n"))


def _uses(spark, by_source: DataFrame) -> DataFrame:
    return draws(spark, by_source).groupBy("rank", "block").agg(F.count("*").alias("uses"))


def _pieces(documents: DataFrame, uses: DataFrame) -> DataFrame:
    """Rows of documents per block that the mix uses: from, words (within the document), uses; row if documents have it."""
    row = [c for c in documents.columns if c == "row"]
    cut = documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("size") - 1) / BLOCK))))
    cut = cut.withColumn("from", F.greatest(F.col("first"), F.col("block") * BLOCK) - F.col("first")).withColumn("to", F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * BLOCK) - F.col("first"))
    return cut.join(uses, ["rank", "block"]).select(*row, "doc_id", "rank", "first", "size", "block", "from", (F.col("to") - F.col("from")).alias("words"), "uses")


def taken(documents: DataFrame, by_source: DataFrame, uses: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    got = _pieces(documents, uses).groupBy("rank", "first").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    # a document of no words shares its place with the next one, and takes nothing
    key = F.when(F.col("size") > 0, F.col("first"))
    out = documents.withColumn("key", key).join(got.withColumnRenamed("first", "key"), ["rank", "key"], "left")
    return out.join(by_source.select("rank", "source_size", "target"), "rank").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    A null text has size 0 and a null source is one of its own, the last. Null ids come
    first in their source; repeated rows count apiece and, being alike in place and
    size, may change places. Columns of other names are left out; an empty table gives
    an empty result.
    """
    return taken(*plan(docs, id_col, text_col, source_col))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of docs: each document once per pass that takes it.

    Pass p holds the document's words whose block is used at least p times, in order.
    A pass that takes all words keeps the text as it is. n_chars follows the text. A
    document without words joins the first pass untouched. Ids may be null or repeated:
    rows are told apart by a number of their own, which is written with them. A null text
    is a document without words. An empty table gives an empty result.
    """
    row, words_, runs_, split_, text_ = free_names(docs.columns, "row", "words", "runs", "split", "whole")
    own = docs.columns
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    documents, _, uses = plan(docs, row_col=row)
    pieces = _pieces(documents, uses).withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    runs = pieces.groupBy("row", "pass").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("from", "words"))).alias("runs"))
    named = runs.select(F.col("row").alias(row), F.col("words").alias(words_), F.col("runs").alias(runs_))
    empty = documents.where("size = 0").select(F.col("row").alias(row), F.lit(0).cast("long").alias(words_), F.array().cast(named.schema[runs_].dataType).alias(runs_))
    joined = docs.join(named.unionByName(empty), row)
    # a column of its own, referred to twice, is worked out once a row and not once a run
    joined = joined.withColumn(split_, F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    part = F.array_join(F.flatten(F.transform(runs_, lambda r: F.slice(split_, r["from"].cast("int") + 1, r["words"].cast("int")))), " ")
    joined = joined.withColumn(text_, F.when(F.size(split_) == F.col(words_), F.col("text")).otherwise(part))
    out = {"text": F.col(text_), "n_chars": F.length(text_).cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return joined.select([out.get(c, docs[c]).alias(c) for c in own])


def mix_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL of mix() over documents."""

    def swap(table: str, x: str, n: str, key: str, out: str) -> str:
        steps = [f"{out}0 AS MATERIALIZED (SELECT *, CAST({x} AS BIGINT) AS {out} FROM {table})"]
        for r in range(rounds):
            k = f"(((({r}::BIGINT + 1) * 1103515 + {key} * 7919 + 9973) % {_M}) * 48271 % {_M} * {_M} + (({r}::BIGINT + 3) * 69621 + {key} * 16807) % {_M} * 39373 % {_M}) % {n}"
            steps.append(f"{out}m{r} AS MATERIALIZED (SELECT *, ({k} - {out} + {n}) % {n} AS mirror FROM {out}{r})")
            steps.append(f"{out}z{r} AS MATERIALIZED (SELECT *, ((greatest({out}, mirror) % {_M} * 48271 + (greatest({out}, mirror) // {_M}) * 16807 + {r}::BIGINT * 7907 + {key}) % {_M} * 69621 % {_M}) AS z FROM {out}m{r})")
            steps.append(f"{out}{r + 1} AS MATERIALIZED (SELECT * EXCLUDE (mirror, z, {out}), CASE WHEN (((xor(z, z >> 15) * 48271) % {_M}) >> 13) & 1 = 1 THEN mirror ELSE {out} END AS {out} FROM {out}z{r})")
        return ",\n".join(steps)

    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, (rank % 3) + 1 AS weight, {MOST_PASSES} * source_size AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM by_source)),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weights,
    CAST(coalesce(sum(cap) OVER w, 0) AS BIGINT) AS caps_before, CAST(coalesce(sum(weight) OVER w, 0) AS BIGINT) AS weights_before
  FROM named WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (
  SELECT *, CAST(cap AS DOUBLE) * (all_weights - weights_before) <= CAST(total - caps_before AS DOUBLE) * weight AS capped FROM levels),
targets AS (
  SELECT source, rank, source_size,
    CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
      CAST(total - CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT) AS DOUBLE) * weight
      / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS BIGINT) END AS target,
    CAST(ceil(source_size / {BLOCK}) AS BIGINT) AS blocks
  FROM judged),
slotted AS (
  SELECT *, CASE WHEN source_size > 0 THEN least({MOST_PASSES} * blocks, CAST(floor(target * blocks / source_size + 0.5) AS BIGINT)) ELSE 0 END AS slots FROM targets),
based AS (
  SELECT *, CAST(coalesce(sum(slots) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM slotted),
n_slots AS (SELECT CAST(coalesce(sum(slots), 0) AS BIGINT) AS n FROM based),
ids AS (SELECT t.slot, n FROM n_slots, LATERAL (SELECT unnest(range(n)) AS slot) t),
{swap("ids", "slot", "n", str(SEED), "dealt")},
hit AS (
  SELECT rank, blocks, dealt - base AS turn, {SEED} + 1 + rank * {MOST_PASSES} + (dealt - base) // blocks AS key
  FROM dealt{rounds} JOIN based ON dealt >= base AND dealt < base + slots),
{swap("hit", "turn % blocks", "blocks", "key", "block")},
uses AS (SELECT rank, block, count(*) AS uses FROM block{rounds} GROUP BY rank, block),
placed AS (
  SELECT s.doc_id, s.size, b.rank, b.source_size, b.target,
    row_number() OVER (ORDER BY s.doc_id) AS row_no,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY b.rank ORDER BY s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
  FROM sized s JOIN based b ON s.source IS NOT DISTINCT FROM b.source),
cut AS (
  SELECT *, unnest(range(first // {BLOCK}, (first + size - 1) // {BLOCK} + 1)) AS block FROM placed WHERE size > 0),
got AS (
  SELECT row_no, sum((least(first + size, (block + 1) * {BLOCK}) - greatest(first, block * {BLOCK})) * uses) AS taken
  FROM cut JOIN uses USING (rank, block) GROUP BY row_no)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN got USING (row_no)
"""

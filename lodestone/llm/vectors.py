"""Embedding near-duplicates by an inverted multi-index.

Codebooks for the two halves of a vector form a grid of cells. Every class of equal
vectors lies in the cell of its nearest codewords; as a query it visits cells in the
order of both halves' distances (multi-sequence traversal) until the share of links
that the index was calibrated for, and exact cosines decide. A link is met from either
of its ends.

A cell's members and visitors are dealt into tiles of bounded size. A tile returns
link counts and a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lodestone.llm.common import components, drop_stage, stage

#: Rows that fit the codebooks (at least, and for each codeword), vectors a cell is meant to hold.
FIT_ROWS, WORD_ROWS, CELL_ROWS = 8_192, 16, 48
#: Largest codebook. Its grid holds 800 million classes; beyond that results stay whole, but cells, and so the work a class, grow.
MOST_WORDS = 4_096
#: Partners made to calibrate the traversal.
PARTNERS = 1_024
#: Share of links right at the threshold that the traversal is calibrated to meet.
TARGET_RECALL = 0.985
#: Members and visitors of a tile, about.
TILE_ROWS, TILE_VISITS = 512, 2_048


class Index:
    """Codebooks of both halves and the number of cells that a query visits."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], visits: int):
        self.books, self.visits = books, visits
        self.words = len(books[0])
        self.half = books[0].shape[1]

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = unit[:, : self.half], unit[:, self.half :]
        return tuple((p * p).sum(1)[:, None] - 2 * p @ b.T + (b * b).sum(1)[None, :] for p, b in zip(parts, self.books, strict=True))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(1) * self.words + b.argmin(1)

    def traverse(self, da: np.ndarray, db: np.ndarray, visits: int) -> list[int]:
        """Cells in ascending sum of both distances: a frontier over two sorted lists."""
        oa, ob = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
        sa, sb, k = da[oa].tolist(), db[ob].tolist(), self.words
        heap, out, reach = [(sa[0] + sb[0], 0, 0)], [], [0] * (k + 1)
        while heap and len(out) < visits:
            _, i, j = heapq.heappop(heap)
            out.append(oa[i] * k + ob[j])
            reach[i] = j + 1
            # a cell enters the frontier once both its smaller neighbours were visited
            if j + 1 < k and (i == 0 or reach[i - 1] > j + 1):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if i + 1 < k and reach[i + 1] == j:
                heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
        return out

    def visited(self, unit: np.ndarray) -> list[list[int]]:
        a, b = self.distances(unit)
        return [self.traverse(x, y, self.visits) for x, y in zip(a, b, strict=True)]


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    words = rows[rng.choice(len(rows), k, replace=len(rows) < k)].copy()
    for _ in range(rounds):
        near = ((words * words).sum(1)[None, :] - 2 * rows @ words.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, rows)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def codewords(classes: int) -> int:
    """Words of each codebook, so that cells hold CELL_ROWS classes."""
    return max(2, min(MOST_WORDS, math.ceil(math.sqrt(classes / CELL_ROWS))))


def fit(sample: np.ndarray, classes: int, cosine: float, recall: float = TARGET_RECALL, seed: int = 8) -> Index:
    """Codebooks from unit vectors; visits from partners made at exactly the threshold.

    Such a partner is the farthest a link can be. The pair is lost only if both ends
    miss each other's cell, so one end needs a share of 1 - sqrt(1 - recall).
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    k = codewords(classes)
    half = max(1, dim // 2)
    right = sample[:, half:] if dim > half else np.zeros((len(sample), 1))
    index = Index((_k_means(sample[:, :half], k, rng), _k_means(right, k, rng)), k * k)
    some = _wide(np.resize(sample, (PARTNERS, dim)))  # few vectors get several partners
    side = rng.normal(size=some.shape)
    side -= (side * some).sum(1)[:, None] * some
    side /= np.maximum(np.linalg.norm(side, axis=1), 1e-12)[:, None]
    partner = cosine * some + math.sqrt(1 - cosine * cosine) * side
    at, (da, db) = index.cells(partner), index.distances(some)
    own = da[np.arange(len(some)), at // k] + db[np.arange(len(some)), at % k]
    # cells that are nearer: for every word of one half, the words of the other that leave the sum below
    rank = [1 + int(np.searchsorted(np.sort(y), z - x).sum()) for x, y, z in zip(da, db, own, strict=True)]
    index.visits = int(np.quantile(rank, 1 - math.sqrt(1 - recall), method="higher"))
    return index


def _units(column: pa.Array, dim: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    _, power = np.frexp(np.abs(v).max(axis=1, initial=0))
    v = np.ldexp(v, -power[:, None])  # by powers of two, so that squares neither overflow nor vanish and nothing is rounded
    return v / np.linalg.norm(v, axis=1)[:, None]


def _wide(unit: np.ndarray) -> np.ndarray:
    return unit if unit.shape[1] > 1 else np.concatenate([unit, np.zeros((len(unit), 1))], 1)


@lru_cache(4)
def _index(a: bytes, b: bytes, words: int, visits: int) -> Index:
    return Index((np.frombuffer(a).reshape(words, -1), np.frombuffer(b).reshape(words, -1)), visits)


def _links(classes: DataFrame, dim: int, cosine: float, recall: float) -> DataFrame:
    """key, links (a part of its count), root (a linked key, smaller or equal) for classes (key, rep, n, v) of one dimension."""
    total = classes.count()
    rows = max(FIT_ROWS, WORD_ROWS * codewords(total))  # 65,536 at most
    sample = classes.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(rows).select("v").toArrow().column("v").combine_chunks()
    index = fit(_units(sample, dim), total, cosine, recall)
    kind = classes.schema["v"].dataType.simpleString()
    packed = (index.books[0].tobytes(), index.books[1].tobytes(), index.words, index.visits)

    def place(batches):
        x = _index(*packed)
        for b in batches:
            unit = _wide(_units(b.column(2), dim))
            yield pa.record_batch({"key": b.column(0), "n": b.column(1), "v": b.column(2), "cell": pa.array(x.cells(unit).astype(np.int32)), "visits": pa.array(x.visited(unit), pa.list_(pa.int32()))})

    placed = stage(classes.select("key", "n", "v").mapInArrow(place, f"key string, n long, v {kind}, cell int, visits array<int>"), "placed")
    held = placed.groupBy("cell").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("parts"))
    calls = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / TILE_VISITS).cast("int").alias("turns"))
    grid = stage(held.join(calls, "cell"), "grid")
    part, turn = F.pmod(F.xxhash64("key", F.lit(2)), "parts").cast("int"), F.pmod(F.xxhash64("key", F.lit(3)), "turns").cast("int")
    members = placed.join(grid, "cell").select("cell", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(True).alias("member"), "key", "n", "v", F.col("cell").alias("own"), "visits")
    callers = placed.select("key", "n", "v", F.col("cell").alias("own"), F.explode("visits").alias("cell")).join(grid, "cell")
    callers = callers.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), turn.alias("turn"), F.lit(False).alias("member"), "key", "n", "v", "own", F.lit(None).cast("array<int>").alias("visits"))
    def tile(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        member = t.column("member").to_numpy(zero_copy_only=False).astype(bool)
        keys, n, own = np.array(t.column("key").to_pylist(), object), t.column("n").to_numpy(), t.column("own").to_numpy()
        unit = _units(t.column("v").combine_chunks(), dim)
        x, q = np.flatnonzero(member), np.flatnonzero(~member)
        out: dict[str, list] = {"key": [], "links": [], "root": []}
        if len(x) and len(q):
            hit = unit[q] @ unit[x].T >= cosine
            hit &= keys[q][:, None] != keys[x][None, :]
            if hit.any():
                homes, home = np.unique(own[q], return_inverse=True)
                seen = np.stack([np.isin(homes, v) for v in t.column("visits").take(pa.array(x)).to_pylist()])
                both = seen[:, home].T  # the other end finds the link too, and counts it for itself
                credit_q = hit @ n[x]
                credit_x = n[q] @ (hit & ~both)
                root = np.arange(len(x))
                while True:
                    low_q = np.where(hit, root[None, :], len(x)).min(1)
                    low_x = np.minimum(root, np.where(hit, low_q[:, None], len(x)).min(0))
                    if (low_x == root).all():
                        break
                    root = low_x
                for at, credit, low in ((q, credit_q, low_q), (x, credit_x, root)):
                    some = np.flatnonzero((credit > 0) | (low < len(x)) & (hit.any(1) if at is q else hit.any(0)))
                    out["key"] += keys[at[some]].tolist()
                    out["links"] += credit[some].tolist()
                    out["root"] += keys[x[low[some]]].tolist()
        return pa.table({"key": pa.array(out["key"], pa.string()), "links": pa.array(out["links"], pa.int64()), "root": pa.array(out["root"], pa.string())})

    found = stage(members.unionByName(callers).groupBy("cell", "part", "turn").applyInArrow(tile, "key string, links long, root string"), "found")
    drop_stage(placed, grid)
    return found


def near_duplicates(rows: DataFrame, cosine: float = 0.9, recall: float = TARGET_RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with
    nothing, nor do vectors of different lengths with each other; each length has an
    index of its own, one after the other. Equal vectors are a class: they are linked,
    counted apiece and looked up once. A null id is nobody's smallest; repeated ids are
    rows apiece; other columns are left out; an empty table gives an empty result.
    Vectors of single precision move as such; cosines are of double precision.
    """
    single = isinstance(rows.schema[vector_col].dataType.elementType, FloatType)
    kind = "float" if single else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    sound = F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = rows.select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0).cast(kind)).alias("v"))
    clean = clean.withColumn("key", F.when(sound, F.sha2(F.to_json(F.struct("v")), 256)))
    clean = stage(clean, "vectors")
    classes = stage(clean.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    lengths = sorted(map(tuple, classes.select(F.size("v")).distinct().collect()))
    parts = [_links(classes.where(F.size("v") == d), d, cosine, recall) for (d,) in lengths]
    base, roots = classes.select("key", "rep", "n"), None
    if parts:
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
        roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
        counts = found.groupBy("key").agg(F.sum("links").alias("links"))
        base = base.join(counts, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    else:
        base = base.withColumns({"links": F.lit(0).cast("long"), "root": F.lit(None).cast("string")})
    base = stage(base.select("key", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")), "linked")
    # written down, so that the join by root is one of two tables and a large component's rows can be split
    lowest = stage(base.groupBy("root").agg(F.min("rep").alias("component_id")), "lowest")
    by_key = stage(base.join(lowest, "root").select("key", "n_links", "component_id"), "by_key")
    drop_stage(classes, base, lowest, *parts, *([] if roots is None else [roots]))
    out = clean.drop("v").join(by_key, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

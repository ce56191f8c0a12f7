"""Periodic runs: stretches of words that repeat with a short period, found lag by lag.

A run is a stretch of words with smallest period q and at least max(LEAST_WORDS,
LEAST_EXPONENT * q) words that no neighbouring word extends. A document's words become
an array of numbers, which is compared with itself at every lag up to a third of its
length. A run of lag q is a stretch of so many equal places in a row that a comparison
at a fixed stride cannot step over it; where the strided comparison of a lag has enough
hits in a row, the whole arrays are compared at that lag and their true stretches are
measured. Short documents are scanned where they lie; the lags of long ones are dealt
out over the cluster in ranges of equal work.
"""

from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage, text_batches

LEAST_WORDS, LEAST_EXPONENT = 24, 3
#: Texts of more characters have their lags dealt out in so many ranges.
LONG_CHARS, RANGES = 1 << 16, 4
#: Places of the strided comparison that must agree in a row, and how many places are compared at once.
PROBES, AT_ONCE = 4, 1 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def numbers(words: list[str]) -> np.ndarray:
    """Equal words have equal numbers."""
    return pa.array(words, pa.string()).dictionary_encode().indices.to_numpy() if words else np.zeros(0, np.int32)


def _need(q: np.ndarray) -> np.ndarray:
    """Equal places in a row that make a run at lag q."""
    return np.maximum(LEAST_WORDS - q, (LEAST_EXPONENT - 1) * q)


def lag_range(n: int, part: int, parts: int) -> tuple[int, int]:
    """Lags [lo, hi) of one of so many parts with about as many compared places each, for n words."""
    last = n // LEAST_EXPONENT
    if parts == 1 or n < LEAST_WORDS:
        return 1, last + 1
    q = np.arange(1, last + 1)
    work = np.cumsum(n / np.maximum(1, _need(q) // PROBES))
    cut = np.searchsorted(work, work[-1] * np.arange(1, parts) / parts) + 1
    edges = [1, *cut.tolist(), last + 1]
    return edges[part], edges[part + 1]


def _smallest_period(ids: np.ndarray, q: int) -> int:
    """Smallest period of a stretch of period q that is at least twice as long: it divides q."""
    r, rest, f = q, q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f:
            f += 1
            continue
        rest //= f
        if r % f == 0 and np.array_equal(ids[: len(ids) - r // f], ids[r // f :]):
            r //= f
    return r


def _strided_hits(ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lag, first and last place of PROBES agreeing places in a row, each a stride from the next."""
    step = np.maximum(1, _need(q) // PROBES)
    count = (len(ids) - q - 1) // step + 1
    first = np.cumsum(count) - count
    lag, stride = np.repeat(q, count), np.repeat(step, count)
    at = (np.arange(len(lag)) - np.repeat(first, count)) * stride
    hit = ids[at] == ids[at + lag]
    k = PROBES - 1
    if len(hit) <= k:
        return lag[:0], at[:0], at[:0]
    row = hit[: len(hit) - k].copy()
    for j in range(1, PROBES):
        row &= hit[j : len(hit) - k + j]
    i = np.flatnonzero(row)
    i = i[lag[i] == lag[i + k]]
    return lag[i], at[i], at[i + k]


def find_runs(ids: np.ndarray, part: int = 0, parts: int = 1) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs that show at the lags of one part; over all parts these are all runs.

    A run also shows at the multiples of its period, as the same run. Those places are
    not compared again once the run is known.
    """
    n = len(ids)
    if n < LEAST_WORDS:
        return set()
    lo, hi = lag_range(n, part, parts)
    runs: set[tuple[int, int, int]] = set()
    known = np.zeros((0, 3), np.int64)
    while lo < hi:
        q = np.arange(lo, hi)
        work = np.cumsum(n // np.maximum(1, _need(q) // PROBES) + 1)
        q = q[: max(1, int(np.searchsorted(work, AT_ONCE)))]
        lo = int(q[-1]) + 1
        lag, first, last = _strided_hits(ids, q)
        start = np.flatnonzero(np.diff(lag, prepend=0))
        for a, b in zip(start, np.append(start[1:], len(lag))[: len(start)], strict=True):
            p = int(lag[a])
            inside = known[(p % known[:, 2] == 0) & (known[:, 1] >= LEAST_EXPONENT * p)]
            left = np.ones(b - a, bool)
            for s, length, _ in inside:
                left &= (first[a:b] < s) | (last[a:b] >= s + length - p)
            if not left.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], ids[: n - p] == ids[p:], [False]]).astype(np.int8)))
            at, size = edge[::2], edge[1::2] - edge[::2] + p
            at, size = (x[size >= max(LEAST_WORDS, LEAST_EXPONENT * p)].tolist() for x in (at, size))
            new = [(x, length, _smallest_period(ids[x : x + length], p)) for x, length in zip(at, size, strict=True)]
            fresh = [r for r in new if r not in runs]
            if fresh:
                runs.update(fresh)
                known = np.concatenate([known, np.array(fresh, np.int64)])
    return runs


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return " ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return " ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most repetitions, exactly compared; of equals the first, then the shortest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _as_rows(runs: list[tuple[int, int, int]]) -> list[dict]:
    return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]


def _finish(words: list[list[str]], runs: list[list[tuple[int, int, int]]]) -> list[pa.Array]:
    top = [strongest(r) for r in runs]
    return [
        pa.array([len(w) for w in words], pa.int64()),
        pa.array([_as_rows(r) for r in runs], _RUNS),
        pa.array([_as_rows([t])[0] if t else None for t in top], _RUNS.value_type),
        pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.string()),
    ]


_FOUND = f"n_words bigint, runs {RUNS}, strongest struct<start:bigint,length:bigint,period:bigint>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_chars: int = LONG_CHARS, ranges: int = RANGES) -> DataFrame:
    """A row per row of docs: doc_id, n_words, runs (by start, then period), strongest (null without runs), collapsed.

    Words are what [^\\x20\\x09-\\x0D]+ matches. A null or empty text, and one of fewer than
    LEAST_WORDS words, has no run and collapses to its words joined by single spaces (null
    and empty: the empty text). Rows are judged one by one: null and repeated ids stay,
    equal texts have equal results, other columns are left out whatever their names, an
    empty table gives an empty result. Texts of more than long_chars characters are
    written down with a number of their own, scanned by lag range, and meet their runs by
    that number; the result does not depend on long_chars or ranges.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))

    def whole(batches):
        for b in batches:
            for start, texts in text_batches(b.column(1)):
                words = [words_of(t) for t in texts]
                runs = [sorted(find_runs(numbers(w)), key=lambda r: (r[0], r[2])) for w in words]
                yield pa.record_batch([b.column(0).slice(start, len(texts)), *_finish(words, runs)], names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    def scan(batches):
        for b in batches:
            for row, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found = list(find_runs(numbers(words_of(text.as_py())), part, ranges))
                yield pa.record_batch({"row": pa.array([row] * len(found), pa.int64()), **{n: pa.array([r[k] for r in found], pa.int64()) for k, n in enumerate(("start", "length", "period"))}})

    def finish(batches):
        for b in batches:
            for k in range(b.num_rows):  # long texts, one at a time
                words = words_of(b.column(1)[k].as_py())
                runs = [(r["start"], r["length"], r["period"]) for r in b.column(2)[k].as_py() or []]
                yield pa.record_batch([b.column(0).slice(k, 1), *_finish([words], [sorted(runs, key=lambda r: (r[0], r[2]))])], names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    out = f"doc_id {kind}, {_FOUND}"
    short = rows.where(~is_long).mapInArrow(whole, out)
    long_rows = stage(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long_texts")
    parts = long_rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("part"), "text").repartition("row", "part")
    found = parts.mapInArrow(scan, "row bigint, start bigint, length bigint, period bigint")
    by_row = found.groupBy("row").agg(F.collect_set(F.struct("start", "length", "period")).alias("runs"))
    long_out = long_rows.join(by_row, "row", "left").select("doc_id", "text", "runs").mapInArrow(finish, out)
    return short.unionByName(long_out)


def with_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, with repetition planted in one document of ten, as words joined by a space.

    With h the unsigned crc32 of the decimal id: if 10 divides h, and the text has n > 0
    words, then from word a = g % n on, g = floor(h / 10), the words repeat with period
    1 + floor((n - a) / (3 + g % 8)). Null ids are not planted, null texts stay null;
    other columns are left out, so their names do not matter. Repeated rows are planted
    alike, an empty table gives an empty result.
    """
    h = F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.concat(F.slice(words, 1, a), F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, period), 11)), 1, n - a)), " ")

    found = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    once = F.transform(F.array(found), lambda w: F.when(F.size(w) > 0, repeated(w)))  # a variable, so that words are found once
    text = F.coalesce(F.when(h % 10 == 0, F.get(once, 0)), F.col(f"`{text_col}`"))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent in thousandths, and digests of runs and collapsed text.

    One row per row of periodic_runs(); without runs the four numbers are null and the
    digest of the runs is that of the empty text.
    """
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    top = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )

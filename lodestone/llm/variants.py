"""Spelling variants: words one edit apart, found as points in rectangles.

Words of one length are points: their rank in code-point order against their rank in the
order of the reversed words. All words that have a given beginning and a given end are
then the points of a rectangle, which a wavelet tree over the ranks reports. For each
place where a word may have been edited, the words that agree before and after it are
one such rectangle: of the word's own length for a replaced letter, of one letter more
for an inserted one; a deletion is an insertion seen from the other word.

Spark deals the points out so that no tree holds all words. An edit lies in the first or
in the second half of the longer word, so both words have the other half in common:
words meet by halves, and a half that very many words share is dealt out further, its
points in parts and its questions to every part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_stage, stage, text_batches

#: Shortest word, fewest occurrences, and how many times as frequent a form must be.
LEAST_LETTERS, LEAST_TIMES, FORM_TIMES = 6, 5, 5
#: Points that share a half before they are dealt out in parts; rows of one task.
MOST_POINTS, TASK_ROWS = 50_000, 200_000
#: Words whose counts a task holds before it hands them on; cells of one pass over questions.
KEPT_WORDS, CELLS = 250_000, 1 << 21
#: A deletion is planted where this divides the checksum of document and word.
PLANTED = 199
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def misspelt(doc_id: object, word: str) -> str:
    """The word as the document has it: without one letter where the checksum says so. A null id has none."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % PLANTED:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_times: int = LEAST_TIMES) -> DataFrame:
    """word, n: words of LEAST_LETTERS letters or more (A-Za-z, À to ÿ; A-Z lower-cased) that occur often enough.

    Deletions are planted by document and word. Null and empty texts have no words,
    repeated rows count as often as they come, other columns do not matter whatever
    their names, an empty table gives an empty result.
    """

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.record_batch({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return out

        for b in batches:
            ids = b.column(0).to_pylist()
            for start, texts in text_batches(b.column(1)):
                for doc_id, text in zip(ids[start:], texts, strict=False):
                    for w, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
                        if len(w) >= LEAST_LETTERS and len(own := misspelt(doc_id, w)) >= LEAST_LETTERS:
                            counts[own] += n
                    if len(counts) > KEPT_WORDS:
                        yield flush()
        yield flush()

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


class WaveletTree:
    """Ranks in order of places, as one bit array a level; answers which ranks of a rectangle occur."""

    def __init__(self, ranks: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        now = ranks
        for k in reversed(range(max(1, int(len(ranks) - 1).bit_length()))):
            zero = (now >> k & 1) == 0
            before = np.concatenate([[0], np.cumsum(zero)])
            self.levels.append((k, before, int(before[-1])))
            now = np.concatenate([now[zero], now[~zero]])

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the rectangle, rank) for every place in [a, b) whose rank lies in [c, d)."""
        own = np.flatnonzero((a < b) & (c < d))
        a, b, low = a[own], b[own], np.zeros(len(own), np.int64)
        for k, before, zeros in self.levels:
            a0, b0 = before[a], before[b]
            own, low = np.concatenate([own, own]), np.concatenate([low, low + (1 << k)])
            a, b = np.concatenate([a0, zeros + a - a0]), np.concatenate([b0, zeros + b - b0])
            keep = (a < b) & (low < d[own]) & (low + (1 << k) > c[own])
            own, a, b, low = own[keep], a[keep], b[keep], low[keep]
        return own, low


def _as_bytes(letters: np.ndarray) -> np.ndarray:
    """Rows of letters as byte strings, to be sorted and searched; letters are never 0."""
    if not letters.shape[1]:
        return np.zeros(len(letters), "S1")
    return np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel()


def _bisect(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """First place of each stretch [lo, hi) of a sorted column whose letter is not below the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        up = open_ & (column[np.minimum(mid, len(column) - 1)] < letter)
        lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)


def intervals(points: np.ndarray, asked: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of the sorted points that begin as each asked word does, by beginnings of first to last letters."""
    lo = np.zeros((last - first + 1, len(asked)), np.int64)
    hi = np.full_like(lo, len(points))
    if first:
        heads, own = _as_bytes(points[:, :first]), _as_bytes(asked[:, :first])
        lo[0], hi[0] = np.searchsorted(heads, own, "left"), np.searchsorted(heads, own, "right")
    for k in range(1, last - first + 1):
        some = np.flatnonzero(lo[k - 1] < hi[k - 1])
        lo[k] = hi[k] = 0
        if len(some):
            column, letter = points[:, first + k - 1], asked[some, first + k - 1].astype(np.int64)
            lo[k, some] = _bisect(column, lo[k - 1, some], hi[k - 1, some], letter)
            hi[k, some] = _bisect(column, lo[k, some], hi[k - 1, some], letter + 1)
    return lo, hi


def _letters(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), n)


def near_points(points: list[str], same: list[str], shorter: list[str], shared: int, mirrored: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs one edit apart whose edit lies behind the first shared letters (one at least) of the longer word.

    points and same have one length, shorter one letter less. Returned are numbers of
    same with their points (a letter replaced), then of shorter with theirs (a letter
    inserted). A letter inserted beside its like could stand in several places; only the
    leftmost counts, so that no two halves report a pair. With mirrored, the words are
    given backwards, and leftmost is as they are read.
    """
    n = len(points[0])
    plain = _letters(points, n)
    forth = np.argsort(_as_bytes(plain), kind="stable")
    front = plain[forth]
    turned = front[:, ::-1]
    back = np.argsort(_as_bytes(turned), kind="stable")  # places in code-point order, by reversed words
    ends = np.ascontiguousarray(turned[back])
    rank = np.empty(len(points), np.int64)
    rank[back] = np.arange(len(points))
    tree = WaveletTree(rank)
    out = []
    for asked, size in ((same, n), (shorter, n - 1)):
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        at_once = max(1, CELLS // (n - shared + 1))
        for k in range(0, len(asked), at_once):
            own = _letters(asked[k : k + at_once], size)
            a, b = intervals(front, own, shared, n - 1)
            c, d = (x[::-1] for x in intervals(ends, own[:, ::-1], 0, n - 1 - shared))  # after place i come n - 1 - i letters
            i, q = np.nonzero((a < b) & (c < d))
            r, reported = tree.report(a[i, q], b[i, q], c[i, q], d[i, q])
            q, i, p = q[r], i[r] + shared, back[reported]
            if size == n:
                real = front[p, i] != own[q, i]
            elif mirrored:
                real = (i == n - 1) | (front[p, i] != own[q, np.minimum(i, n - 2)])
            else:
                real = front[p, i] != own[q, i - 1]
            found.append((q[real] + k, forth[p[real]]))
        out.append(tuple(np.concatenate(x) for x in zip(*found, strict=True)))
    return out


def _cards(words: DataFrame) -> DataFrame:
    """Every word under the halves by which it can meet others: size, side, half, asks (with a letter less), word, n."""
    size = F.length("word")

    def card(n, side, half, asks):
        return F.struct(n.alias("size"), F.lit(side).alias("side"), half.alias("half"), F.lit(asks).alias("asks"))

    own, more = F.floor(size / 2).cast("int"), F.floor((size + 1) / 2).cast("int")
    cards = F.array(
        card(size, 0, F.substring("word", F.lit(1), own), False),
        card(size, 1, F.substring("word", own + 1, size), False),
        card(size + 1, 0, F.substring("word", F.lit(1), more), True),
        card(size + 1, 1, F.substring("word", more, size), True),
    )
    return words.select(F.explode(cards).alias("card"), "word", "n").select("card.*", "word", "n")


def near_words(words: DataFrame, most_points: int = MOST_POINTS, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, n_near, near, near_n: how many words are one edit away, the most frequent of them (ties: the first in code-point order).

    words holds distinct words of letters up to U+00FF, of three letters or more, and n.
    Words without a near one have no row. Halves that more than most_points words of a
    length share are dealt out in parts.
    """
    cards = _cards(words)
    half = ["size", "side", "half"]
    hot = cards.where(~F.col("asks")).groupBy(half).agg(F.count("*").alias("n_points")).where(F.col("n_points") > most_points)
    hot = hot.select(*half, F.ceil(F.col("n_points") / most_points).cast("int").alias("parts"))
    dealt = cards.join(hot, half, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own_part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("size", "side", "part", (~F.col("asks") & (F.col("part") == F.col("own_part"))).alias("point"), "asks", "half", "word", "n")
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, 1 + 4 * words.count() // task_rows)

    def run(batches):
        own = [b for b in batches if b.num_rows]  # task_rows rows, and what copies of hot questions add
        if not own:
            return
        table = pa.Table.from_batches(own)
        key = np.stack([table.column(c).to_numpy() for c in ("size", "side", "part")])
        order = np.lexsort(key)
        edges = np.flatnonzero(np.any(np.diff(key[:, order], axis=1, prepend=-1), axis=0))
        point, asks, n = (table.column(c).to_numpy() for c in ("point", "asks", "n"))
        spelt = table.column("word").to_pylist()
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            rows = order[a:b]
            size, side, _ = key[:, rows[0]].tolist()
            points, same, shorter = rows[point[rows]], rows[~asks[rows]], rows[asks[rows]]
            if not len(points):
                continue
            step = -1 if side else 1
            shared = size - size // 2 if side else size // 2
            (q, p), (s, t) = near_points(*[[spelt[k][::step] for k in x] for x in (points, same, shorter)], shared, bool(side))
            one = np.concatenate([same[q], shorter[s], points[t]])
            other = np.concatenate([points[p], points[t], shorter[s]])
            if len(one):
                yield _best(one, other, spelt, n)

    found = dealt.repartition(tasks, "size", "side", "half", "part").mapInArrow(run, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def _best(one: np.ndarray, other: np.ndarray, spelt: list[str], n: np.ndarray) -> pa.RecordBatch:
    """A row per word: how many others it has here, and the first of them by frequency, then spelling."""
    others, at = np.unique(other, return_inverse=True)
    place = np.empty(len(others), np.int64)
    place[sorted(range(len(others)), key=lambda k: spelt[others[k]])] = np.arange(len(others))
    order = np.lexsort((place[at], -n[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.diff(one, prepend=-1))
    count = np.diff(np.append(first, len(one)))
    return pa.record_batch({
        "word": pa.array([spelt[k] for k in one[first]], pa.string()),
        "n_near": pa.array(count, pa.int64()),
        "near_n": pa.array(n[other[first]], pa.int64()),
        "near": pa.array([spelt[k] for k in other[first]], pa.string()),
    })


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """word, root of forms(word, form): what is reached by following forms to the last, by doubling the steps each round.

    A form is far more frequent than its words, so there is no cycle and a chain is
    short; if max_rounds do not suffice, an error is raised.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_stage(now)
        now = step
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
    raise RuntimeError(f"roots are not found after {max_rounds} rounds")


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_points: int = MOST_POINTS, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that word_counts() gives.

    form is the near word of largest n if that is FORM_TIMES the word's own or more, else
    null, and form_n with it. root is where forms lead to, the word itself without one.
    Ties go to the first in code-point order. Nulls, empty and repeated rows and other
    columns: see word_counts().
    """
    words = stage(word_counts(docs, id_col, text_col), "words")
    near = near_words(words, most_points, task_rows)
    has_form = F.coalesce(F.col("near_n") >= FORM_TIMES * F.col("n"), F.lit(False))
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("near_n")).alias("form_n"),
    )
    found = stage(found, "variants")
    drop_stage(words)
    last = roots(found.where(F.col("form").isNotNull()))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Toxicity: character n-gram embeddings averaged into a linear softmax, trained in numpy.

A word's vector is the mean of its n-grams' vectors (hashed into buckets), a passage's
the mean of its words'. Embeddings and softmax are trained together by stochastic
gradient descent: at first on whole documents, then on each document's worst window,
so that a few abusive words are not lost in a long text. As all is linear up to the
softmax, a trained model is one number a bucket, and scoring a window is a running mean
of word scores. Misspellings share most of their n-grams with the words they come from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import sole, text_batches

BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4, 5)
#: Words in a window; passes over whole documents, then over worst windows.
WINDOW, WHOLE_PASSES, WINDOW_PASSES, RATE = 24, 3, 9, 0.1
#: The windows of a small sample are passed more often, up to so many steps.
LEAST_STEPS = 40_000
#: The training sample: at most so many labelled ids of each label, lowest hash first, one row each.
MOST_TOXIC, MOST_CLEAN = 2_000, 6_000
#: Bytes of text in the sample: rows are taken in that order while they fit; one that does not is left out whole.
MOST_BYTES = 64_000_000
#: Of the sample, one row in so many sets where scores cross the threshold; a false alarm weighs as so many misses.
ASIDE, THRESHOLD, ALARM = 5, 0.3, 3.0
#: With fewer of either label aside, nothing is put aside and the border is set by the rows learnt from.
LEAST_ASIDE = 20
#: Words after which a worker's memory of scores starts anew.
KEPT_WORDS = 250_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, each between < and >, word after word; how many each word has."""
    marked = [f"<{w}>" for w in words]
    size = np.array([len(w) for w in marked])
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.repeat(np.cumsum(size), size)
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(points))
    own, owners = [], []
    for n in GRAMS:
        fits = np.flatnonzero(at + n <= end)
        h = np.full(len(fits), n, np.uint64)
        for j in range(n):
            h = (h ^ points[fits + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        own.append((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BUCKETS))
        owners.append(owner[fits])
    flat, who = np.concatenate(own).astype(np.int64), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return flat[order], np.bincount(who, minlength=len(words))


@dataclass(frozen=True)
class Model:
    """Score of each bucket and of nothing."""

    weight: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        grams, n = gram_buckets(words)
        start = np.cumsum(n) - n
        return np.add.reduceat(self.weight[grams], start) / n  # a marked word has an n-gram at least


def fresh(ids: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """0 for a word that stands among the size - 1 words before as well, else 1: junk that repeats one word says it once."""
    order = np.argsort(ids, kind="stable")
    again = (ids[order[1:]] == ids[order[:-1]]) & (np.diff(order) < size)
    out = np.ones(len(ids))
    out[order[1:][again]] = 0
    return out


def worst_window(scores: np.ndarray, size: int = WINDOW) -> tuple[float, int, int]:
    """Highest mean over windows of so many words (or all), and its place."""
    n = len(scores)
    if n <= size:
        return (float(scores.mean()) if n else 0.0), 0, n
    run = np.concatenate([[0.0], np.cumsum(scores)])
    mean = (run[size:] - run[:-size]) / size
    k = int(mean.argmax())
    return float(mean[k]), k, k + size


def train(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    """Joint training of embeddings and softmax; without both labels, a constant model."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), 6.0 if share else -6.0)
    rng = np.random.default_rng(seed)
    names: dict[str, int] = {}
    all_ids = [np.array([names.setdefault(w, len(names)) for w in words_of(t)], np.int32) for t in texts]
    if not names:
        return Model(np.zeros(BUCKETS), -6.0)
    aside = rng.permutation(len(y)) % ASIDE == 0
    judged = aside.copy()
    if min(np.bincount(y[aside], minlength=2)) < LEAST_ASIDE:  # too few to set anything by
        aside[:], judged[:] = False, True
    ids, own_y = [own for own, a in zip(all_ids, aside, strict=True) if not a], y[~aside]
    news = [fresh(own).astype(np.float32) for own in ids]
    every = list(names)
    parts = [gram_buckets(every[k : k + 20_000]) for k in range(0, len(every), 20_000)]  # small parts bound the memory
    grams, count = np.concatenate([g.astype(np.int32) for g, _ in parts]), np.concatenate([n for _, n in parts])
    start = np.cumsum(count) - count
    embed = np.zeros((BUCKETS, DIM))  # so that n-grams never seen say nothing
    soft, bias = np.zeros((2, DIM)), np.zeros(2)
    soft[1] = rng.normal(0, 0.5, DIM)
    whole = WHOLE_PASSES
    passes = whole + max(WINDOW_PASSES, round(LEAST_STEPS / len(ids)))
    for p in range(passes):
        rate = RATE * (1 - p / passes)
        by_word = np.add.reduceat((embed @ (soft[1] - soft[0]))[grams], start) / count
        for d in rng.permutation(len(ids)):
            own = ids[d]
            if not len(own):
                continue
            if p >= whole:
                _, a, b = worst_window(by_word[own] * news[d])
                own = own[a:b]
            uniq, times = np.unique(own, return_counts=True)
            if p >= whole:
                times = np.ones(len(uniq))
            size = count[uniq]
            at = np.repeat(start[uniq] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            bucket = grams[at]
            part = np.repeat(times / len(own) / size, size)
            mean = part @ embed[bucket]
            z = soft @ mean + bias
            q = np.exp(z - z.max())
            q /= q.sum()
            q[own_y[d]] -= 1  # gradient at the softmax's input
            step = rate * (q @ soft)
            soft -= rate * np.outer(q, mean)
            bias -= rate * 0.1 * q
            # a bucket's step follows its share, scaled up as in sparse bags
            np.subtract.at(embed, bucket, np.outer(part * len(own), step))
    model = Model(embed @ (soft[1] - soft[0]), float(bias[1] - bias[0]))
    by_word = np.add.reduceat(model.weight[grams], start) / count
    raw = np.array([worst_window(by_word[own] * fresh(own))[0] for own, j in zip(all_ids, judged, strict=True) if j])
    return Model(model.weight, float(np.log(THRESHOLD / (1 - THRESHOLD))) - _border(raw, y[judged]))


def _border(raw: np.ndarray, y: np.ndarray) -> float:
    """Where to tell the labels apart: the middle of the best gap between neighbouring scores."""
    order = np.argsort(raw, kind="stable")
    raw, y = raw[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y == 1)]) / max(1, int((y == 1).sum()))
    alarms = 1 - np.concatenate([[0], np.cumsum(y == 0)]) / max(1, int((y == 0).sum()))
    edge = np.concatenate([[raw[0] - 1], (raw[1:] + raw[:-1]) / 2, [raw[-1] + 1]])
    cost = missed + ALARM * alarms
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    return float(edge[best].mean())


class Scorer:
    """Scores words once while it remembers them; what it forgets it can work out again."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[str, int] = {}
        self.word_scores = np.zeros(0)

    def _learn(self, docs: list[list[str]]) -> None:
        if len(self.number) > KEPT_WORDS:
            self.number, self.word_scores = {}, np.zeros(0)
        new = list({w for ws in docs for w in ws if w not in self.number})
        self.number.update((w, len(self.word_scores) + k) for k, w in enumerate(new))
        self.word_scores = np.concatenate([self.word_scores, self.model.word_scores(new)])

    def _worst(self, words: list[str]) -> float:
        ids = np.array([self.number[w] for w in words], np.int64)
        return worst_window(self.word_scores[ids] * fresh(ids))[0]

    def score(self, texts: list[str]) -> list[float]:
        docs = [words_of(t) for t in texts]
        self._learn(docs)
        top = np.array([self._worst(ws) for ws in docs])
        return (1 / (1 + np.exp(-np.clip(top + self.model.bias, -500, 500)))).tolist()


def _scorer(weight: bytes, bias: float) -> Scorer:
    return sole(("scorer", weight, bias), lambda: Scorer(Model(np.frombuffer(weight, np.float32).astype(float), bias)))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_bytes: int = MOST_BYTES) -> DataFrame:
    """_id, _text, _label: the bounded sample that fit() learns from, at most MOST_TOXIC + MOST_CLEAN rows.

    Rows with a null id or label are left out, as are held-out ones; of repeated labels
    the highest counts. Of several rows of one id the one whose text has the lowest hash
    is taken, so an id is one row however often it comes. A null text counts as empty.
    Texts are cut off neither: rows are taken whole, in order of their ids' hashes, as
    far as most_bytes go; a row that does not fit is skipped.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    order = [F.xxhash64("_id", F.lit(5)), F.col("_id")]
    sample = known.where("_label = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(known.where("_label = 0").orderBy(*order).limit(MOST_CLEAN))
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # sample: at most 8,000 rows of an id and a label
    rows = text.join(F.broadcast(sample), "_id")
    sized = rows.groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("hash"), F.octet_length("_text").cast("long").alias("size"))).alias("m"))
    sized = sized.select("_id", "_label", "m.hash", "m.size", F.xxhash64("_id", F.lit(5)).alias("order"))
    taken, room = [], {0: most_bytes // 2, 1: most_bytes // 2}
    for r in sorted(sized.collect(), key=lambda r: (r["order"], r["_id"])):  # numbers only, a row per id of the sample
        if r["size"] <= room[r["_label"]]:
            room[r["_label"]] -= r["size"]
            taken.append((r["_id"], r["hash"]))
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(taken, f"_id {kind}, _hash long")
    return rows.withColumn("_hash", F.xxhash64("_text")).join(F.broadcast(chosen), ["_id", "_hash"]).dropDuplicates(["_id"]).select("_id", "_text", "_label")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from sample_rows() in one task, whose input that bounds; the driver gets the model only.

    If the executor is lost, the task runs again and learns the same: rows are put in
    order of their ids. Without labels of both kinds the model is constant.
    """

    def run(batches):
        rows = []
        for b in batches:
            rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
        rows.sort(key=lambda r: r[0])
        model = train([r[1] for r in rows], [r[2] for r in rows])
        yield pa.record_batch({"weight": pa.array([model.weight.astype(np.float32).tobytes()], pa.binary()), "bias": pa.array([model.bias], pa.float64())})

    row = sample_rows(docs, labels, id_col, text_col, label_col).repartition(1).mapInArrow(run, "weight binary, bias double").first()
    if row is None:  # no task ran, as nothing is labelled
        return train([], [])
    return Model(np.frombuffer(bytes(row["weight"]), np.float32).astype(float), float(row["bias"]))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; whole texts are read.

    A null text counts as empty, an empty one scores what the model says of no words. A
    null id is not held out. Repeated rows and ties score alike, other columns are left
    out, an empty table gives an empty result.
    """
    weight, bias = model.weight.astype(np.float32).tobytes(), model.bias
    packed = docs.sparkSession.sparkContext.broadcast(weight)  # BUCKETS floats, whatever the input

    def run(batches):
        s = _scorer(packed.value, bias)
        for b in batches:
            for start, texts in text_batches(b.column(1)):
                out = s.score(texts)
                yield pa.record_batch({"doc_id": b.column(0).slice(start, len(out)), "score": pa.array(out, pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below THRESHOLD, all columns as they are, whatever their names.

    Null texts count as empty, null ids are rows like others, repeated rows stay or go
    together, an empty table stays empty.
    """
    weight, bias = model.weight.astype(np.float32).tobytes(), model.bias
    packed = docs.sparkSession.sparkContext.broadcast(weight)
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def run(batches):
        s = _scorer(packed.value, bias)
        for b in batches:
            keep = [x < THRESHOLD for _, texts in text_batches(b.column(at)) for x in s.score(texts)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)

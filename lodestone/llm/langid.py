"""Language of a text by unigrams over pieces, summed over all segmentations.

The pieces are those of a public vocabulary, fixed. A language gives each piece a
probability; a word's probability is the sum over all ways to cut it into pieces of the
products of theirs, found by a forward pass over its letters. Pieces start at a word's
mark or lie inside a word, so a text's probability is the product over its words.

The probabilities are learnt by expectation-maximisation on word counts of all labelled
rows: each round sums, for each language and piece, how often the piece is expected in
the words' segmentations (forward and backward passes in the tasks, sums in Spark).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_stage, sole, stage, text_batches

#: Rounds of learning; what each piece is counted besides; the log probability of a letter that no piece holds.
ROUNDS, ADDED, UNKNOWN = 3, 0.1, -18.0
#: Expected counts are summed in whole parts of one in so many, so that sums do not depend on their order.
PARTS = 1024
#: A model is a number per language and piece; more languages than this are refused, none is dropped.
MOST_LANGUAGES = 500
#: Words after which a task's counts, and a worker's memory of scores, start anew.
KEPT_WORDS = 500_000
#: Cells (words x places x scores) of one pass.
CELLS = 1 << 20
MARK = "▁"
NO_LANGUAGE = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The same for texts of Latin-1, whose letters are few and which has no marks.
_LATIN = re.compile("[a-zA-ZªµºÀ-ÖØ-öø-ÿ]+")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WORD.findall(text)
    return _LATIN.findall(text)


class Pieces:
    """The lower-case pieces of a sentencepiece file: their mark, letters and nothing else."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.names = [p for p in every if p.lower() == p and MARK not in p[1:] and (p == MARK or _WORD.fullmatch(p.removeprefix(MARK)))]
        if MARK not in self.names:
            self.names.append(MARK)
        self.size = np.array([len(p) for p in self.names], np.int32)
        self.found = ahocorasick.Automaton()
        for k, p in enumerate(self.names):
            self.found.add_word(p, k)
        self.found.make_automaton()
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(p) for p in self.names if len(p) == 1]] = True

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every piece in every marked word: word, place before, place after, piece; and the words' sizes.

        A letter that is no piece by itself is an unknown one, with the number after the last.
        """
        marked = [MARK + w for w in words]
        size = np.array([len(w) for w in marked], np.int64)
        first = np.cumsum(size) - size
        text = "".join(marked)
        hits = np.fromiter(chain.from_iterable(self.found.iter(text)), np.int64).reshape(-1, 2)
        odd = np.flatnonzero(~self.known[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)])
        end = np.concatenate([hits[:, 0], odd]) + 1
        piece = np.concatenate([hits[:, 1], np.full(len(odd), len(self.names))])
        start = end - np.concatenate([self.size[hits[:, 1]], np.ones(len(odd), np.int32)])
        word = np.searchsorted(first, start, side="right") - 1
        return word, start - first[word], end - first[word], piece, size


def _steps(key: np.ndarray, word: np.ndarray):
    """Pieces by place: for each place their order by word, and where each word's begin."""
    order = np.lexsort((word, key))
    edges = np.flatnonzero(np.diff(key[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        own = order[a:b]
        yield int(key[own[0]]), own, np.flatnonzero(np.diff(word[own], prepend=-1))


def _log_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Logarithm of the sums of exp(values) over the stretches from each start."""
    top = np.maximum.reduceat(values, starts)
    size = np.diff(np.append(starts, len(values)))
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, size, axis=0)), starts))


def forward(word: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Log probability of each word's letters up to each place: words x places x columns of score."""
    out = np.full((len(size), int(size.max()) + 1, score.shape[1]), -np.inf)
    out[:, 0] = 0
    for t, own, starts in _steps(end, word):
        out[word[own[starts]], t] = _log_sums(out[word[own], start[own]] + score[own], starts)
    return out


def backward(word: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Log probability of each word's letters from each place on."""
    out = np.full((len(size), int(size.max()) + 1, score.shape[1]), -np.inf)
    out[np.arange(len(size)), size] = 0
    for t, own, starts in reversed(list(_steps(start, word))):
        out[word[own[starts]], t] = _log_sums(out[word[own], end[own]] + score[own], starts)
    return out


def _even(words: list[str], columns: int):
    """Numbers of words of like length, so many at once that a pass stays small."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    own: list[int] = []
    for k in order:
        if own and (len(own) + 1) * (len(words[k]) + 2) * columns > CELLS:
            yield own
            own = []
        own.append(k)
    if own:
        yield own


@lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


@dataclass(frozen=True)
class Model:
    """Log probabilities, languages x pieces with the unknown letter last; log shares of the languages."""

    path: str
    languages: tuple[str, ...]
    score: np.ndarray
    prior: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        for own in _even(words, len(self.languages)):
            word, start, end, piece, size = _pieces(self.path).lattice([words[k] for k in own])
            done = forward(word, start, end, size, self.score[:, piece].T.astype(float))
            out[own] = done[np.arange(len(own)), size]
        return out


def expected(pieces: Pieces, words: list[str], times: np.ndarray, row: np.ndarray, score: np.ndarray) -> np.ndarray:
    """How often each row's language is expected to use each piece in its words, in parts of 1/PARTS."""
    out = np.zeros(score.shape, np.int64)
    for own in _even(words, 1):
        word, start, end, piece, size = pieces.lattice([words[k] for k in own])
        lang = row[own][word]
        s = score[lang, piece][:, None]
        f, b = forward(word, start, end, size, s), backward(word, start, end, size, s)
        whole = f[np.arange(len(own)), size, 0]
        share = np.exp(f[word, start, 0] + s[:, 0] + b[word, end, 0] - whole[word])
        np.add.at(out, (lang, piece), np.rint(share * times[own][word] * PARTS).astype(np.int64))
    return out


def held_out(id_col: Column) -> Column:
    """Rows that nothing is learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word, n over all rows that are not held out and have a language; words are lower-case runs of letters."""

    def run(batches):
        counts: dict[str, Counter] = {}

        def flush():
            rows = [(lang, own) for lang, own in counts.items() if own]
            out = pa.record_batch({
                "lang": pa.array([lang for lang, own in rows for _ in own], pa.string()),
                "word": pa.array([w for _, own in rows for w in own], pa.string()),
                "n": pa.array([n for _, own in rows for n in own.values()], pa.int64()),
            })
            counts.clear()
            return out

        for b in batches:
            langs = b.column(0).to_pylist()
            for start, texts in text_batches(b.column(1)):
                for lang, text in zip(langs[start:], texts, strict=False):
                    counts.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, counts.values())) > KEPT_WORDS:
                    yield flush()
        yield flush()

    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`"))).select(F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS) -> Model:
    """Learns from all rows that are not held out and have a text and a language.

    Null texts and texts without letters add nothing but to a language's share; repeated
    rows count as often as they come. Without labelled rows the model has no language.
    What reaches the driver is one number per language and piece.
    """
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull() & ~held_out(F.col(f"`{id_col}`")))
    shares = {r["lang"]: r["n"] for r in known.groupBy(F.col(f"`{lang_col}`").cast("string").alias("lang")).agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = tuple(sorted(shares))
    pieces = _pieces(path)
    n = len(pieces.names)
    score = np.full((len(languages), n + 1), -np.log(n))
    score[:, n] = UNKNOWN
    if not languages:
        return Model(path, (), score.astype(np.float32), np.zeros(0))
    counts = stage(word_counts(docs, id_col, text_col, lang_col), "word_counts")
    number = {x: k for k, x in enumerate(languages)}
    for _ in range(rounds):
        packed = docs.sparkSession.sparkContext.broadcast(score)  # MOST_LANGUAGES x pieces at most

        def run(batches, packed=packed):
            total = np.zeros(packed.value.shape, np.int64)
            for b in batches:
                row = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
                total += expected(_pieces(path), b.column(1).to_pylist(), b.column(2).to_numpy(), row, packed.value)
            lang, piece = np.nonzero(total)
            yield pa.record_batch({"lang": pa.array(lang, pa.int32()), "piece": pa.array(piece, pa.int32()), "n": pa.array(total[lang, piece], pa.int64())})

        sums = counts.mapInArrow(run, "lang int, piece int, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        seen = np.full((len(languages), n), ADDED)
        lang, piece, times = (sums.column(c).to_numpy() for c in ("lang", "piece", "n"))
        inside = piece < n
        seen[lang[inside], piece[inside]] += times[inside] / PARTS
        score[:, :n] = np.log(seen) - np.log(seen.sum(axis=1, keepdims=True))
        packed.unpersist()
    drop_stage(counts)
    prior = np.array([shares[x] for x in languages], float)
    return Model(path, languages, score.astype(np.float32), np.log(prior / prior.sum()))


class Reader:
    """Scores words once while it remembers them; what it forgets it can work out again."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def _rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > KEPT_WORDS:
            self.number, self.scores, new = {}, self.scores[:0], words
        self.number.update((w, len(self.scores) + k) for k, w in enumerate(new))
        self.scores = np.concatenate([self.scores, self.model.word_scores(new)])
        return self.scores[[self.number[w] for w in words]]

    def judge(self, texts: list[str]) -> tuple[list[str], list[float]]:
        docs = [words_of(t) for t in texts]
        size = np.array([len(d) for d in docs])
        if not size.sum() or not self.model.languages:
            return [NO_LANGUAGE] * len(texts), [0.0] * len(texts)
        code = pa.array([w for d in docs for w in d], pa.string()).dictionary_encode()
        flat = self._rows(code.dictionary.to_pylist())[code.indices.to_numpy()]
        some = np.flatnonzero(size)
        total = np.add.reduceat(flat, (np.cumsum(size) - size)[some]) + self.model.prior
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        names, scores = [NO_LANGUAGE] * len(texts), [0.0] * len(texts)
        for k, d in enumerate(some):
            names[d], scores[d] = self.model.languages[best[k]], float(share[k, best[k]])
        return names, scores


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's share of the text's probability) of every row.

    A null or empty text, one without letters, and any text if nothing was learnt is
    `und` with score 0. Of equally likely languages the first in code-point order is
    taken. Whole texts are read; null and repeated ids stay, other columns are left out
    whatever their names, an empty table gives an empty result.
    """
    packed = docs.sparkSession.sparkContext.broadcast(model)  # MOST_LANGUAGES x pieces at most
    key = hash((model.languages, model.score.tobytes()))

    def run(batches):
        reader = sole(("languages", key), lambda: Reader(packed.value))
        for b in batches:
            for start, texts in text_batches(b.column(1)):
                names, scores = reader.judge(texts)
                yield pa.record_batch({"doc_id": b.column(0).slice(start, len(names)), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    judged = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

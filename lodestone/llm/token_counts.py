"""Exact token counts at every prefix, by dynamic programming.

For each prefix of a word exactly one token can end its encoding: the one that stays
apart from the last token of the shorter prefix it leaves. Its count is that prefix's
count plus one. Counts of a text's prefixes follow from the counts at word starts, so
truncation and budget questions need no second encoding.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.bpe import ByteBPE, load
from lodestone.llm.common import sole, text_batches

KEPT_WORDS, KEPT_CHARS, KEPT_PREFIXES = 300_000, 64, 1_000_000


class PrefixCounter:
    def __init__(self, path: str):
        self.bpe: ByteBPE = load(path)
        self.total: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.state: dict[bytes, tuple[int, int]] = {b"": (0, -1)}

    def _step(self, data: bytes, end: int, state_at) -> tuple[int, int]:
        """(count, last token) of data[:end] from the states of shorter prefixes."""
        token_of, apart = self.bpe.token_of, self.bpe.apart
        for size in range(min(self.bpe.most, end), 0, -1):
            t = token_of.get(data[end - size : end])
            if t is not None:
                count, last = state_at(end - size)
                if last < 0 or apart(last, t):
                    return count + 1, t
        raise ValueError("the vocabulary lacks a byte")

    def word(self, word: str) -> int:
        """Tokens of a whole word; prefixes of short words are shared between words."""
        data = word.encode()
        if len(data) > KEPT_CHARS:
            return int(self.byte_prefixes(data)[-1])
        if len(self.state) > KEPT_PREFIXES:
            self.state = {b"": (0, -1)}
        state, at = self.state, len(data)
        while data[:at] not in state:
            at -= 1
        for end in range(at + 1, len(data) + 1):
            state[data[:end]] = self._step(data, end, lambda k: state[data[:k]])
        return state[data][0]

    def byte_prefixes(self, data: bytes) -> np.ndarray:
        """Tokens of data[:k] for k = 0 .. len(data)."""
        rows = [(0, -1)]
        for end in range(1, len(data) + 1):
            rows.append(self._step(data, end, rows.__getitem__))
        return np.array([c for c, _ in rows], np.int64)

    def count(self, words: list[str]) -> list[int]:
        total, out = self.total, []
        for w in words:
            n = total.get(w)
            if n is None:
                n = self.older.get(w)
                if n is None:
                    n = self.word(w)
                if len(w) <= KEPT_CHARS:
                    total[w] = n
            out.append(n)
        if len(total) > KEPT_WORDS:
            self.total, self.older = {}, total
        return out

    def text(self, text: str) -> int:
        return sum(1 if special >= 0 else sum(self.count(self.bpe.words(part))) for part, special in self.bpe.parts(text))

    def _inside(self, word: str) -> np.ndarray:
        """Tokens of word[:k], k = 1 .. len(word), each prefix taken as the text's end."""
        if word[0] == "'" and len(word) > 1 and word[1].isalpha():
            out = np.arange(1, len(word) + 1)  # cut inside, a contraction is an apostrophe and a letter
            out[-1] = self.count([word])[0]
            return out
        data = word.encode()
        ends = np.cumsum([len(c.encode()) for c in word])
        return self.byte_prefixes(data)[ends]

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:k] for k = 0 .. len(text), each as if the text ended there.

        A special string counts as ordinary text until it is complete.
        """
        out, base, before, plain = [np.zeros(1, np.int64)], 0, 0, ""
        for part, special in self.bpe.parts(text):
            if special >= 0:
                inner = self.prefixes_plain(plain + part)[len(plain) + 1 :] + before
                base += 1
                inner[-1] = base
                before, plain = base, ""
            else:
                before, plain = base, part
                inner = self.prefixes_plain(part)[1:] + base
                base = int(inner[-1]) if len(inner) else base
            out.append(inner)
        return np.concatenate(out)

    def prefixes_plain(self, text: str) -> np.ndarray:
        words = self.bpe.words(text)
        out, base, blank, blank_base = [np.zeros(1, np.int64)], 0, "", 0
        for w, n in zip(words, self.count(words), strict=True):
            lead = len(w) - len(w.lstrip(_BLANK))
            inner = self._inside(w) + base
            if lead:  # a run of blanks that ends the text is one word, wherever it is split later
                blank_base = blank_base if blank else base
                for k in range(lead):
                    blank += w[k]
                    inner[k] = blank_base + self.count([blank])[0]
            if lead < len(w):
                blank = ""
            out.append(inner)
            base += n
        return np.concatenate(out)

    def longest_within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most so many tokens."""
        return self.measured(text, budget)[1]

    def measured(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of a text, and the characters of its longest prefix of at most budget tokens.

        Counts at word starts only grow, so whole words are passed over by their counts
        and prefixes are looked at in the last words that may still fit. Texts with
        special strings are looked at whole.
        """
        if any(special >= 0 for _, special in self.bpe.parts(text)):
            n = self.text(text)
            return n, len(text) if n <= budget else int(np.flatnonzero(self.prefixes(text) <= budget)[-1])
        words = self.bpe.words(text)
        counts = self.count(words)
        n = sum(counts)
        if n <= budget:
            return n, len(text)
        over, base = 0, 0
        while base + counts[over] <= budget:
            base += counts[over]
            over += 1
        first = max(0, over - 1)
        while first and words[first - 1].isspace():  # blanks before it may be one word with those that it starts with
            first -= 1
        base -= sum(counts[first:over])
        inner = self.prefixes_plain("".join(words[first : over + 2])) + base
        return n, sum(map(len, words[:first])) + int(np.flatnonzero(inner <= budget)[-1])


_BLANK = "\t\n\x0b\x0c\r \x85\xa0                　"


def counter(path: str) -> PrefixCounter:
    return sole(("counter", path), lambda: PrefixCounter(path))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chars_within for each row.

    n_chars_within is the length of the longest prefix of at most limit tokens, the
    whole text's if it is within. Null texts count as empty (0 bytes, 0 tokens, false,
    0); null ids and repeated rows stay; other columns are left out; an empty table
    gives an empty result. One narrow pass.
    """

    def run(batches):
        c = counter(path)
        for b in batches:
            for start, texts in text_batches(b.column(1)):
                n, within = zip(*[c.measured(t, limit) for t in texts], strict=True)
                yield pa.record_batch({id_col: b.column(0).slice(start, len(n)), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_()), "n_chars_within": pa.array(within, pa.int64())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chars_within long")


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, prefix_tokens: the array whose item k counts the tokens of the first k characters.

    A null text has one prefix, the empty one; an empty table gives an empty result.
    """

    def run(batches):
        c = counter(path)
        for b in batches:
            for start, texts in text_batches(b.column(1), 200_000):
                yield pa.record_batch({id_col: b.column(0).slice(start, len(texts)), "prefix_tokens": pa.array([c.prefixes(t).tolist() for t in texts], pa.list_(pa.int32()))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, prefix_tokens array<int>")

"""Byte-level byte-pair encoding from a tokenizers JSON file: split rule, merges, pair test.

The pair test decides whether two tokens stay apart when their bytes stand side by
side. A sequence of tokens in which every adjacent pair stays apart is the encoding
of its bytes: the first merge across a border would also happen in the pair alone.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import regex

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose class the regex module and the tokenizers library agree (a test walks them all).
_AGREED = re.compile("[^\x00-՗ -⁯]")
_NEVER = 1 << 30
#: What a file must say for the rules here to be its own, and options of the model that must be off.
_RULES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None}
_PLAIN = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte, by the byte-level rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        wrong = [k for k, v in _RULES.items() if spec.get(k) != v] + [k for k in _PLAIN if model.get(k)]
        if wrong or model.get("type") != "BPE":
            raise ValueError(f"{path}: not plain byte-level BPE ({', '.join(wrong) or model.get('type')})")
        vocab: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._special_re = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for s, i in vocab.items():
            if all(c in back for c in s):
                self.bytes_of[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.byte_id = [vocab[s] for s in symbols]
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.pair: dict[int, int] = {}
        self.made: list[int] = []
        many: set[int] = set()
        ordered = True
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pair[x << 32 | y] = r
            self.made.append(z)
            if self.rank[z] >= 0:
                many.add(z)
                continue
            ordered &= bool(self.rank[x] < r and self.rank[y] < r)
            self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array(sorted(self.pair), np.int64)
        self._keys, self._ranks = keys, np.array([self.pair[int(k)] for k in keys], np.int64)
        merged = np.array([z for z in dict.fromkeys(self.made)], np.int64)
        crossed = dict(zip(merged.tolist(), self.crosses(self.left[merged], self.right[merged], self.rank[merged]).tolist(), strict=True)) if len(merged) else {}
        whole = set(self.byte_id)
        for z in self.made if ordered else ():
            if z not in many and not crossed[z] and int(self.left[z]) in whole and int(self.right[z]) in whole:
                whole.add(z)
        self.token_of = {self.bytes_of[i]: i for i in whole}
        self.longest: dict[bytes, int] = {}
        for b in self.token_of:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 1), len(b))
        self.most = max(map(len, self.token_of))
        self._apart: dict[int, bool] = {}

    def crosses(self, a, b, limit=None) -> np.ndarray:
        """For pairs of tokens: is there a merge across their border, of a rank below limit?

        Going back in time, the later of the two merges at the border is undone
        first; of equal ones the right one, as merges run from the left.
        """
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        out = np.zeros(len(a), bool)
        top = np.full(len(a), _NEVER) if limit is None else np.asarray(limit)
        at, la, lb = np.arange(len(a)), np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(at):
            key = a << 32 | b
            k = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            r = np.where(self._keys[k] == key, self._ranks[k], _NEVER)
            hit = (r < top[at]) & (r < la) & (r <= lb)
            out[at[hit]] = True
            ra, rb = self.rank[a], self.rank[b]
            go = ~hit & (np.maximum(ra, rb) >= 0)
            undo_b = rb >= ra
            a, la = np.where(undo_b, a, self.right[a])[go], np.where(undo_b, la, ra)[go]
            b, lb = np.where(undo_b, self.left[b], b)[go], np.where(undo_b, rb, lb)[go]
            at = at[go]
        return out

    def apart(self, a: int, b: int) -> bool:
        """crosses() for one pair, remembered."""
        key = a << 32 | b
        if (known := self._apart.get(key)) is not None:
            return known
        pair, rank, la, lb, out = self.pair, self.rank, _NEVER, _NEVER, True
        while True:
            r = pair.get(a << 32 | b)
            if r is not None and r < la and r <= lb:
                out = False
                break
            ra, rb = int(rank[a]), int(rank[b])
            if ra < 0 and rb < 0:
                break
            if rb >= ra:
                b, lb = int(self.left[b]), rb
            else:
                a, la = int(self.right[a]), ra
        if len(self._apart) > 2_000_000:
            self._apart.clear()
        self._apart[key] = out
        return out

    def merge(self, data: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost first; a heap over a linked list."""
        ids: list[int] = [self.byte_id[b] for b in data]
        n = len(ids)
        if n <= 64:
            return self._merge_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair, made = self.pair, self.made
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i] if i < n else n
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := pair.get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[k]))
            if (p := before[i]) >= 0 and (q := pair.get(ids[p] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (q, p, ids[p], ids[i]))
        return [i for i in ids if i >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same for short words, where scanning a list beats a heap."""
        get, made = self.pair.get, self.made
        ranks = [get(x << 32 | y, _NEVER) for x, y in zip(ids, ids[1:], strict=False)]
        while ranks and (r := min(ranks)) != _NEVER:
            i = ranks.index(r)
            ids[i] = made[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], _NEVER)
        return ids

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings, as the library's byte-level rule splits it."""
        if _AGREED.search(text):
            return [text[a:b] for _, (a, b) in _library_split().pre_tokenize_str(text)]
        return _SPLIT.findall(text)

    def parts(self, text: str) -> list[tuple[str, int]]:
        """(ordinary text, -1) and (special string, its id), in order."""
        if self._special_re is None or not any(s in text for s in self.special):
            return [(text, -1)]
        out, at = [], 0
        for m in self._special_re.finditer(text):
            out += [(text[at : m.start()], -1), (m[0], self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], -1)]


_SPLIT = regex.compile(SPLIT)


@lru_cache(1)
def _library_split():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


def load(path: str) -> ByteBPE:
    return ByteBPE(path)

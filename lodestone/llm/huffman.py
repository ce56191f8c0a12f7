"""Token-id files: canonical length-limited Huffman coding in independent blocks.

Code lengths come from the counts of all ids, by package-merge. A file row is a block:
whole documents, packed code bits and the bit offset of every CHECKPOINT-th id, from
which a decoder starts anywhere, or in many places at once with one table look-up a
step. Rows lie in ascending id order; Spark's writers commit them, so a lost executor
leaves no half file.
"""

from __future__ import annotations

import gc
import json
import re
import zlib
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import byte_symbols
from lodestone.llm.common import drop_stage, sole, stage

#: Longest code in bits (more if there are more ids than fit), ids between checkpoints, ids after which a block ends.
MAX_BITS, CHECKPOINT, BLOCK_IDS = 18, 128, 262_144
#: Entries after which a memory of a Python worker starts anew.
KEPT_WORDS = 1_000_000
#: Bytes of text after which a task's texts are encoded.
TEXT_BYTES = 6_000_000
#: Longer words are not kept.
KEPT_CHARS = 256

_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"  # without the dotted capital I, whose lower case ends in a mark
#: Cuts where the word tokenizer always starts anew: blanks, and from Latin letters to ASCII signs.
_CHUNK = re.compile(rf"[{_LETTERS}]++(?=[!-@\[-`{{-~ \t\n\r]|\Z)|[^ \t\n\r]+")
_RUN = re.compile(rf"[{_LETTERS}]++(?=[!-@\[-`{{-~]|\Z)")
#: The same cuts over many words at once, with the blanks between them; and what a word must not hold for that.
_CHUNK_OR_BLANK = re.compile(rf"[{_LETTERS}]++(?=[!-@\[-`{{-~ ]|\Z)|[^ ]+| ")
_ODD = re.compile("[^\x00-įı-ɏ]")
_ODD_TEXT = r"[^\x00-\x{24F}]"
#: Words in one text for the library; many more make its own bookkeeping dearer.
_TOGETHER = 128


#: The normaliser, splitter and word end for which the cuts above hold.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: What a model says besides its vocabulary and merges.
_OPTIONS = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "dropout", "ignore_merges")


def cuts_hold(path: str) -> bool:
    """Does this tokenizer file follow the rules that the cuts rely on?"""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return all(spec.get(k) == v for k, v in _RULES.items()) and spec["model"].get("end_of_word_suffix") == "</w>"


def _plain(path: str):
    """The file's model alone, for words that need no normalising and no splitting any more, given as byte symbols between blanks.

    Without the library's own memory: a word comes here once.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
    options = {k: spec[k] for k in _OPTIONS if spec.get(k) is not None}
    out = Tokenizer(models.BPE(vocab=spec["vocab"], merges=merges, cache_capacity=0, **options))
    out.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return out


def _cut(w: str) -> list[str]:
    """The parts of a word without blanks, runs of letters in lower case; the usual shapes first."""
    if w.isascii():
        if w.isalpha():
            return [w.lower()]
        if (head := w[:-1]).isalpha() and w[-1] not in "0123456789":
            return [head.lower(), w[-1]]
    return [p.lower() if _RUN.match(p) else p for p in _CHUNK.findall(w)]


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A file with other rules than these cuts rely on gets whole texts, each apart. Else
    there are two memories: of what stands between blanks, and of its parts. Only parts that are
    new go to the library; runs of letters go together, as one text of byte symbols, whose ids part
    where a word ends.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, self.specials))
        vocab = self.library.get_vocab(with_added_tokens=True)
        size = max([end_id, *vocab.values()]) + 1
        self.kind = "<u2" if size < 1 << 16 else "<u4"  # the highest value is no id: it parts words
        self.mark = np.iinfo(self.kind).max
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.end = np.array([end_id], self.kind).tobytes()
        self.chunks: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        self.long, self.cuts = False, cuts_hold(path)
        self.plain = _plain(path) if self.cuts else None
        self.symbols = np.array([ord(c) for c in byte_symbols()], "<u2")
        self.symbols[32] = 32

    def _ask(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _ask_runs(self, words: list[str]) -> None:
        """Runs of lower-case letters, many in one text: the last id of each is a word's end."""
        for k in range(0, len(words), _TOGETHER):
            some = words[k : k + _TOGETHER]
            text = " ".join(some)
            if not text.isascii():
                text = self.symbols[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            at = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            raw = ids.tobytes()
            if len(at) == len(some):
                self.parts.update(zip(some, [raw[x:y] for x, y in zip([0, *at], at, strict=False)], strict=True))
            else:
                self.parts.update((p, self._ask(p).tobytes()) for p in some)

    def _cut_all(self, words: list[str]) -> list[str]:
        """The parts of all words, with a blank between words."""
        low = " ".join(words).lower()
        if not _ODD.search(low) and not any(s in low for s in self.specials):
            return _CHUNK_OR_BLANK.findall(low)
        flat = [p for w in words for p in (*_cut(w), " ")]
        return flat[:-1]

    def _learn(self, words: set[str]) -> None:
        """Takes words without blanks into both memories."""
        if len(self.parts) > KEPT_WORDS:
            self.parts = {}
        parts = self.parts
        parts[" "] = np.array([self.mark], self.kind).tobytes()
        odd = [w for w in words if not w.isascii() and _ODD.search(w)]
        usual = list(words.difference(odd))
        flat = [*self._cut_all(usual), *([" "] if usual and odd else []), *self._cut_all(odd)]
        new = set(flat).difference(parts)
        runs = [p for p in new if _RUN.fullmatch(p)]
        self._ask_runs(runs)
        for p in new.difference(runs):
            parts[p] = self._ask(p).tobytes()
        self.long = any(len(p) > KEPT_CHARS for p in new)
        raw = b"".join(map(parts.__getitem__, flat))
        width = len(self.end)
        at = (np.flatnonzero(np.frombuffer(raw, self.kind) == self.mark) * width).tolist()
        self.chunks.update(zip([*usual, *odd], [raw[x:y] for x, y in zip([0, *[x + width for x in at]], [*at, len(raw)], strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with the end id."""
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()

    def encode_column(self, texts: pa.StringArray) -> pa.BinaryArray:
        """Ids of each text with the end id. Nothing here is cyclic, so the collector need not look through the words meanwhile."""
        was = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _usual(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The texts to be cut, A-Z in lower case, and which ones the library must see whole (those are empty here).

        Lower case comes first only where nothing composes; a special string in any case keeps its text whole.
        """
        if not self.cuts:
            return pa.array([""] * len(texts), pa.string()), np.arange(len(texts))
        whole = pc.match_substring_regex(texts, self.special, ignore_case=True) if self.special else pa.array([False] * len(texts))
        odd = pc.match_substring_regex(texts, _ODD_TEXT)
        low = pc.ascii_lower(texts)
        if pc.any(odd).as_py():
            low = pc.if_else(odd, texts, low)
        if pc.any(whole).as_py():
            low = pc.if_else(whole, "", low)
        return low, np.flatnonzero(whole.to_numpy(zero_copy_only=False))

    def _encode(self, texts: pa.StringArray) -> pa.BinaryArray:
        """Every distinct word of the column is looked up once; Arrow puts their ids in the texts' order."""
        if not len(texts):
            return pa.array([], pa.binary())
        if len(self.chunks) > KEPT_WORDS:
            self.chunks = {"": b""}
        usual, whole = self._usual(texts)
        cut = pc.ascii_split_whitespace(usual)
        coded = cut.flatten().dictionary_encode()
        words, ends = coded.dictionary.to_pylist(), cut.offsets.to_numpy()[1:]
        new = set(words).difference(self.chunks)
        if new:
            self._learn(new)
        own = [self._ask(texts[int(k)].as_py()).tobytes() + self.end for k in whole]
        values = pa.array([*map(self.chunks.__getitem__, words), self.end, *own], pa.binary())
        last = np.full(len(texts), len(words), np.int32)
        last[whole] = len(words) + 1 + np.arange(len(whole))
        ids = values.take(pa.array(np.insert(coded.indices.to_numpy(), ends, last)))
        starts = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1]
        at = starts[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
        if new and self.long:
            for w in new:
                if len(w) > KEPT_CHARS:
                    del self.chunks[w]
            self.parts = {p: i for p, i in self.parts.items() if len(p) <= KEPT_CHARS}
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at), ids.buffers()[2]])


def encoder(path: str, end_id: int) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return sole(("encoder", path, end_id), lambda: Encoder(path, end_id))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code (0: the symbol does not occur), optimal below limit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        limit = int(np.ceil(np.log2(n)))
    order = used[np.argsort(counts[used], kind="stable")]
    coins = np.asarray(counts, np.int64)[order]
    merged, leaves = coins, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([coins, packs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        leaves.append(at < n)
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        bits[:own] += 1
        take = 2 * (take - own)
    out[order] = bits
    return out


class Codebook:
    """Canonical codes: by length, then by symbol."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        own = self.lengths[order]
        self.bits = int(own.max(initial=1))
        span = np.int64(1) << (self.bits - own)
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = first >> (self.bits - own)
        pad = (1 << self.bits) - int(span.sum())
        # symbol and length of the code that a window starts with, in one number: a length has five bits
        self.found = np.concatenate([np.repeat(order << 5 | own, span), np.ones(pad, np.int64)]).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Packed bits, and the bit offset of every CHECKPOINT-th id."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        start = end - size
        word, off = start >> 5, start & 31
        value = self.codes[ids] << (64 - off - size - 1)  # a 63-bit window, so that int64 holds it
        words = int(end[-1] >> 5) + 2 if len(ids) else 0
        high, low = value >> 31, (value & 0x7FFFFFFF) << 1
        out = np.bincount(word, high, words) + np.bincount(word + 1, low, words)
        return out.astype(np.uint64).astype(">u4").tobytes(), start[::CHECKPOINT]

    def decode(self, data: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        """All ids of a block: every checkpoint is a lane, all lanes move one id a step."""
        raw = np.frombuffer(data, np.uint8).astype(np.uint32)
        raw = np.concatenate([raw, np.zeros(8, np.uint32)])
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = np.asarray(marks, np.int64).copy()
        out = np.empty((CHECKPOINT, len(at)), np.uint32)
        shift, found = np.uint32(32 - self.bits), self.found
        for k in range(CHECKPOINT if len(at) else 0):
            code = window.take(at >> 3, mode="clip")
            code <<= (at & 7).astype(np.uint32)
            code >>= shift
            got = found.take(code)
            np.right_shift(got, 5, out=out[k])
            at += got & 31
        return out.T.ravel()[:n]


@lru_cache(2)
def _codebook(lengths: bytes) -> Codebook:
    return Codebook(np.frombuffer(lengths, np.uint8))


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian, 2 bytes each if the vocabulary allows) with end_id appended.

    A null text counts as empty: its only id is end_id. Null and repeated ids are rows
    like others, other columns are left out, an empty table gives an empty result.
    """

    def run(batches):
        c = encoder(path, end_id)
        width = np.dtype(c.kind).itemsize
        for b in batches:
            texts = b.column(1).cast(pa.string()).fill_null("")
            rows = np.flatnonzero(np.diff(np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // TEXT_BYTES)) + 1
            for start, end in pairwise([*sorted({0, *rows.tolist()}), b.num_rows]):
                ids = c.encode_column(texts.slice(start, end - start))
                sizes = pc.binary_length(ids).cast(pa.int64())
                yield pa.record_batch({"doc_id": b.column(0).slice(start, len(ids)), "n_tokens": pc.divide(sizes, width), "width": pa.array([width] * len(ids), pa.int32()), "ids": ids})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, width int, ids binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """Count of every id over all rows; what reaches the driver is bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            if b.num_rows:
                own = np.bincount(np.frombuffer(b"".join(b.column(1).to_pylist()), f"<u{b.column(0)[0].as_py()}"))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    rows = tokens.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    out[ids] = n
    return out


def write(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """The files of docs, as a table of blocks in ascending id order (nulls first), and the code lengths.

    Ties are ordered by size and checksum, so reruns agree; a null text is an empty
    document of one id; an empty table gives no blocks. Columns: part, block, start
    (ids of the part before the block), n_tokens, doc_ids, sizes, marks, payload.
    """
    tokens = stage(tokenize(docs, path, end_id, id_col, text_col), "tokens")
    lengths = code_lengths(id_counts(tokens))
    book = lengths.tobytes()
    id_type = docs.schema[id_col].dataType

    def run(batches):
        from pyspark import TaskContext

        part, c = TaskContext.get().partitionId(), _codebook(book)
        state = {"block": 0, "start": 0}
        held: list = []

        def flush():
            ids = np.concatenate([i for _, i in held])
            payload, marks = c.encode(ids)
            row = {"part": [part], "block": [state["block"]], "start": [state["start"]], "n_tokens": [len(ids)], "doc_ids": [[d for d, _ in held]], "sizes": [[len(i) for _, i in held]], "marks": [marks], "payload": [payload]}
            state["block"] += 1
            state["start"] += len(ids)
            held.clear()
            return pa.record_batch({k: pa.array(v, t) for (k, v), t in zip(row.items(), kinds, strict=True)})

        id_kind = None
        size = 0
        for b in batches:
            id_kind = id_kind or b.column(0).type
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(id_kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            for d, w, i in zip(b.column(0), b.column(1), b.column(2), strict=True):
                held.append((d.as_py(), np.frombuffer(i.as_py(), f"<u{w.as_py()}")))
                size += len(held[-1][1])
                if size >= BLOCK_IDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    ranged = tokens.withColumn("sum", F.crc32("ids")).repartitionByRange("doc_id", "n_tokens", "sum").sortWithinPartitions("doc_id", "n_tokens", "sum")
    blocks = ranged.select("doc_id", "width", "ids").mapInArrow(run, f"part int, block long, start long, n_tokens long, doc_ids array<{id_type.simpleString()}>, sizes array<long>, marks array<long>, payload binary")
    files = stage(blocks, "ids")
    drop_stage(tokens)
    return files, lengths


def read(files: DataFrame, lengths: np.ndarray) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit, little-endian) of each document.

    In the order of the files: null ids first, ties by size and checksum. No files, no
    rows. What reaches the driver is a row per part.
    """
    totals = sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.sum("n_tokens")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part], at = at, at + n
    book = lengths.tobytes()

    def run(batches):
        c = _codebook(book)
        for b in batches:
            for part, start, n, docs, sizes, marks, payload in zip(*b.columns, strict=True):
                ids = c.decode(payload.as_py(), np.array(marks.as_py(), np.int64), n.as_py())
                sizes = sizes.as_py()
                ends = np.cumsum(sizes)
                first = ends - sizes + base[part.as_py()] + start.as_py()
                borders = np.concatenate([[0], 4 * ends]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(borders), pa.py_buffer(ids.astype("<u4"))])
                yield pa.record_batch({"doc_id": docs.values, "start": pa.array(first, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids": raw})

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return files.select("part", "start", "n_tokens", "doc_ids", "sizes", "marks", "payload").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def digests(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids that were read; a row per row of read(), none for an empty table."""
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())

"""BPE encoding and decoding by speculating and verifying.

Greedy longest match proposes the tokens of each word; one vectorised test over all
adjacent pairs of a batch accepts or rejects the proposals; rejected words are merged
exactly. Words are remembered up to a bound, after which the memory starts anew, so
results never depend on it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.bpe import ByteBPE, load
from lodestone.llm.common import sole, text_batches

#: Words in the younger of two memories of a Python worker, and the longest that is kept.
KEPT_WORDS, KEPT_CHARS = 350_000, 64


class Codec:
    def __init__(self, path: str):
        self.bpe: ByteBPE = load(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.rejected = self.proposed = 0

    def propose(self, data: bytes) -> list[int]:
        """Greedy longest match."""
        token_of, longest, at, n, out = self.bpe.token_of, self.bpe.longest, 0, len(data), []
        while at < n:
            size = min(longest.get(data[at : at + 2], 1), n - at)
            while (t := token_of.get(data[at : at + size])) is None:
                size -= 1
            out.append(t)
            at += size
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        data = [w.encode() for w in words]
        runs = [self.propose(d) for d in data]
        self.proposed += len(runs)
        sizes = np.array([len(r) for r in runs])
        flat = np.fromiter((t for r in runs for t in r), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(runs)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        bad = np.unique(owner[inner[self.bpe.crosses(pairs >> 32, pairs & 0xFFFFFFFF)[where]]]) if len(inner) else []
        for k in bad:
            runs[k] = self.bpe.merge(data[k])
        self.rejected += len(bad)
        return [np.array(r, "<u4").tobytes() for r in runs]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [[(special, [part] if special >= 0 else self.bpe.words(part)) for part, special in self.bpe.parts(t)] for t in texts]
        own: dict[str, bytes] = {}  # of this batch only, and not to be kept
        known, older = self.known, self.older
        new = []
        for w in {w for doc in split for special, ws in doc if special < 0 for w in ws}:
            if w not in known:
                if (c := older.get(w)) is not None:
                    known[w] = c
                else:
                    new.append(w)
        for w, c in zip(new, self.encode_words(new) if new else (), strict=True):
            (known if len(w) <= KEPT_CHARS else own)[w] = c
        out = []
        for doc in split:
            pieces: list[bytes] = []
            for special, ws in doc:
                if special >= 0:
                    pieces.append(np.array([special], "<u4").tobytes())
                elif own:
                    pieces += [own[w] if w in own else known[w] for w in ws]
                else:
                    pieces += map(known.__getitem__, ws)
            out.append(b"".join(pieces))
        if len(known) > KEPT_WORDS:
            self.known, self.older = {}, known
        return out

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        of = self.bpe.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return sole(("codec", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of each row; a null text counts as empty.

    One narrow pass: rows keep their partition, ties and repeated rows stay as they are,
    other columns are left out.
    """

    def run(batches):
        c = codec(path)
        for b in batches:
            for start, texts in text_batches(b.column(1)):
                ids = c.encode(texts)
                yield pa.record_batch({id_col: b.column(0).slice(start, len(ids)), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode(coded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids and decoded, the text that ids stand for, of each row.

    Null ids stand for the empty text; rows keep their partition, repeated rows and
    null doc_ids stay, other columns are left out, an empty table stays empty.
    """

    def run(batches):
        c = codec(path)
        for b in batches:
            yield pa.record_batch({id_col: b.column(0), "n_tokens": b.column(1), "ids": b.column(2), "decoded": pa.array([c.decode(x.as_py() or b"") for x in b.column(2)], pa.string())})

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(id_col, "n_tokens", "ids").mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string")


def round_trip_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encode, decode and digest in one narrow pass.

    A null text counts as empty (0 ids); null and repeated doc_ids and repeated rows
    stay as they are, other columns are left out, an empty table gives an empty result.
    """

    def run(batches):
        c = codec(path)
        for b in batches:
            for start, texts in text_batches(b.column(1)):
                ids = c.encode(texts)
                yield pa.record_batch(
                    {
                        id_col: b.column(0).slice(start, len(ids)),
                        "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                        "decoded_sha256": pa.array([hashlib.sha256(c.decode(i).encode()).hexdigest() for i in ids]),
                    }
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

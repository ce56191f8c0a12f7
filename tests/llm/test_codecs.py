"""Encoders against the library, files and images by round trip."""

from __future__ import annotations

import hashlib
import heapq
import json
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from lodestone.llm import bpe, bpe_codec, huffman, media, token_counts

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, n_tokens string, ids string, media string, start string"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    signs = "aAbBćdeéÉßΣσ \n\t\x1c\x85\xa0 's't!?.,0123日本ñ😀_-=<|>İẞ"
    pieces = ["<|endoftext|>", "the ", "'re", "ing", "<|startoftext|>", "<|ENDOFTEXT|>", "aaaa", "    ", " idiots"]
    return ["", " ", "  \n"] + ["".join(rnd.choice(signs) if rnd.random() < 0.85 else rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(1500)]


@pytest.fixture(scope="module")
def rows(texts):
    return [(k, t, "en", "x", "y", "z", "w") for k, t in enumerate(texts[:200])] + [(None, "null id", None, None, None, None, None), (3, None, None, None, None, None, None), (3, "again", None, None, None, None, None), (3, "again", None, None, None, None, None)]


def test_split_classes_agree_with_the_library():
    rule = ByteLevel(add_prefix_space=False, use_regex=True)
    pattern = regex.compile(bpe.SPLIT)
    for cp in range(1, 0x110000):
        if 0xD800 <= cp < 0xE000 or bpe._AGREED.search(chr(cp)):
            continue
        s = f"a{chr(cp)}1{chr(cp)}{chr(cp)}!"
        assert [s[a:b] for _, (a, b) in rule.pre_tokenize_str(s)] == pattern.findall(s), hex(cp)


def test_bpe_codec_equals_library(texts):
    library, own = Tokenizer.from_file(BYTE), bpe_codec.Codec(BYTE)
    for t, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert 0 < own.rejected < own.proposed


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "!" * 3000, " " * 2000 + "x", "the" * 1000])
def test_long_words(text):
    want = Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe_codec.Codec(BYTE).encode([text])[0], "<u4").tolist() == want
    assert token_counts.PrefixCounter(BYTE).text(text) == len(want)


def test_pair_test_agrees_with_exact_merging():
    b = bpe.load(BYTE)
    rnd = np.random.default_rng(0)
    tokens = np.array(sorted(b.token_of.values()))
    x, y = rnd.choice(tokens, 3000), rnd.choice(tokens, 3000)
    for a, c, crossed in zip(x.tolist(), y.tolist(), b.crosses(x, y).tolist(), strict=True):
        assert (b.merge(b.bytes_of[a] + b.bytes_of[c]) != [a, c]) == crossed == (not b.apart(a, c))


def test_prefix_counts_are_exact(texts):
    library, own = Tokenizer.from_file(BYTE), token_counts.PrefixCounter(BYTE)
    for t in texts[:400]:
        want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert own.prefixes(t).tolist() == want
        assert own.text(t) == want[-1]
        assert own.longest_within(t, 5) == max(k for k, n in enumerate(want) if n <= 5)


LONG = "the long text, word by word " * 45_000  # over a million characters


def test_token_count_rows(spark, rows):
    library = Tokenizer.from_file(BYTE)
    rows = [*rows, (8_000, LONG, None, None, None, None, None)]
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA), BYTE, 8).collect()
    want = [(r[0], len((r[1] or "").encode()), n := size(r[1] or ""), n > 8) for r in rows]
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    texts = {(r[0], len((r[1] or "").encode())): r[1] or "" for r in rows}
    for r in got:
        t = texts[r.doc_id, r.n_bytes]
        fits = [k for k in range(len(t) + 1 if r.doc_id != 8_000 else 80) if size(t[:k]) <= 8]
        assert r.n_chars_within == fits[-1], repr(t)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), BYTE).count() == 0
    first = token_counts.prefix_counts(spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string"), BYTE).collect()
    assert {r[0]: r[1] for r in first} == {1: [size("ab cd"[:k]) for k in range(6)], 2: [0]}


def test_codec_rows(spark, rows):
    rows = [*rows, (8_000, LONG, None, None, None, None, None)]
    df, library = spark.createDataFrame(rows, SCHEMA), Tokenizer.from_file(BYTE)
    back = bpe_codec.decode(bpe_codec.encode(df, BYTE), BYTE).collect()
    assert sorted((r.doc_id, r.decoded) for r in back if r.doc_id is not None) == sorted((r[0], r[1] or "") for r in rows if r[0] is not None)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe_codec.round_trip_digest(df, BYTE).collect()), key=repr) == sorted(want, key=repr)
    assert bpe_codec.round_trip_digest(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_files_of_other_rules(tmp_path):
    """A file that splits otherwise is refused, or gets whole texts."""
    spec = json.loads(open(BYTE, encoding="utf-8").read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "byte.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="pre_tokenizer"):
        bpe.load(str(tmp_path / "byte.json"))
    spec = json.loads(open(WORD, encoding="utf-8").read())
    spec["normalizer"]["normalizers"].pop()  # keeps capitals
    (tmp_path / "word.json").write_text(json.dumps(spec))
    own, library = huffman.Encoder(str(tmp_path / "word.json"), 2), Tokenizer.from_file(str(tmp_path / "word.json"))
    for t in ("Hello World's end", "", "ABC abc"):
        assert np.frombuffer(own.encode([t])[0], own.kind).tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]


def test_word_encoder_equals_library(texts):
    library, own = Tokenizer.from_file(WORD), huffman.Encoder(WORD, 2)
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, own.kind).tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_a_word_is_learnt_once_whatever_its_case():
    own = huffman.Encoder(WORD, 2)
    own.encode(["The thing, THE Thing,", "tHe\tthing,\nthe"])
    assert set(own.chunks) - {""} == {"the", "thing,"}


def test_a_column_of_odd_texts_equals_the_library():
    """Marks that would compose with a lower-case letter only, special strings in other cases, long words, slices, an empty column."""
    texts = ["H\u0331 T\u0308 J\u030c İI ΣΑΣ ẞ", "A <|ENDOFTEXT|> B", "x<|endoftext|>Y", "Q" * 700 + " \x0b\x0cÀÉª1º's", "", "\u0301a É\u0301 e\u0301", "ǅ Ǆ Ĳ 12ab'S", "A" + "!" * 300]
    library, own = Tokenizer.from_file(WORD), huffman.Encoder(WORD, 2)
    column = pa.array(["left out", *texts, *texts, "left out"]).slice(1, 2 * len(texts))
    for t, ids in zip(texts * 2, own.encode_column(column).to_pylist(), strict=True):
        assert np.frombuffer(ids, own.kind).tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], repr(t)
    assert max(map(len, own.chunks)) <= huffman.KEPT_CHARS
    assert own.encode_column(column.slice(0, 0)).to_pylist() == []


def test_rows_are_whole_when_a_batch_is_encoded_in_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(huffman, "TEXT_BYTES", 40)
    library, df = Tokenizer.from_file(WORD), spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = [(r.doc_id, r.n_tokens, np.frombuffer(r.ids, f"<u{r.width}").tolist()) for r in huffman.tokenize(df, WORD, 2).collect()]
    want = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    assert sorted(got, key=repr) == sorted(((d, len(i), i) for d, i in want), key=repr)


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(0)
    for counts in (rng.integers(1, 9, 300), rng.zipf(1.2, 500) % 10_000 + 1, np.array([0, 5]), np.array([1, 1])):
        lengths = huffman.code_lengths(counts, 30)
        heap = [int(c) for c in counts if c]
        cost = heap[0] if len(heap) == 1 else 0
        heapq.heapify(heap)
        while len(heap) > 1:
            cost += (both := heapq.heappop(heap) + heapq.heappop(heap))
            heapq.heappush(heap, both)
        assert int((lengths * counts).sum()) == cost
    steep = huffman.code_lengths(np.array([1 << k for k in range(40)]), 12)
    assert steep.max() == 12 and (2.0 ** -steep[steep > 0].astype(float)).sum() <= 1


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 3000
    book = huffman.Codebook(huffman.code_lengths(np.bincount(ids)))
    payload, marks = book.encode(ids)
    assert (book.decode(payload, marks, n) == ids).all()
    if n > 128:  # any checkpoint alone starts a decoder
        assert (book.decode(payload, marks[1:2], 128)[: n - 128] == ids[128:256]).all()


def test_id_files(spark, rows):
    library = Tokenizer.from_file(WORD)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, huffman.digests(huffman.read(*huffman.write(df, WORD, 2))).collect()), key=lambda r: r[1])
    ordered = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows]
    ordered.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), zlib.crc32(np.array(r[1], "<u2").tobytes())))
    at, want = 0, []
    for doc, ids in ordered:
        want.append((doc, at, len(ids), huffman.crc_of(ids)))
        at += len(ids)
    assert got == want
    assert huffman.read(*huffman.write(spark.createDataFrame([], SCHEMA), WORD, 2)).count() == 0


def test_png_round_trip_and_checks():
    for data in (b"", b"x", b"y" * 192, bytes(range(256)) * 30):
        png = media.encode_png(media.pad(data))
        assert media.decode_png(png).tobytes() == media.pad(data)
        for at in (3, len(png) // 2, len(png) - 2):
            broken = bytearray(png)
            broken[at] ^= 1
            with pytest.raises((ValueError, zlib.error)):
                media.decode_png(bytes(broken))
        with pytest.raises(ValueError):
            media.decode_png(png[:-12])


def _filtered(samples: np.ndarray, bpp: int) -> np.ndarray:
    """Rows under filters 0 to 4 in turn, the plain way."""
    h, w = samples.shape
    out = np.zeros((h, w + 1), np.uint8)
    s = samples.astype(int)
    for y in range(h):
        out[y, 0] = kind = y % 5
        for x in range(w):
            a = s[y, x - bpp] if x >= bpp else 0
            b = s[y - 1, x] if y else 0
            c = s[y - 1, x - bpp] if y and x >= bpp else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out[y, x + 1] = (s[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256
    return out


@pytest.mark.parametrize("channels,colour", [(1, 0), (3, 2), (4, 6)])
def test_all_row_filters(channels, colour):
    samples = np.random.default_rng(channels).integers(0, 256, (11, 7 * channels), np.uint8)
    body = zlib.compress(_filtered(samples, channels).tobytes())
    png = media._SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 11, 8, colour, 0, 0, 0)) + media._chunk(b"IDAT", body[:9]) + media._chunk(b"IDAT", body[9:]) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png) == samples).all()


def test_cosine_hash_ignores_brightness_and_tells_pictures_apart():
    y, x = np.mgrid[0:64, 0:64]
    wave = (60 + 30 * np.sin(x / 9) + 20 * np.cos(y / 7)).astype(np.uint8)
    one, brighter, other = (np.repeat(p, 3, axis=1) for p in (wave, wave + 40, wave.T))
    distance = lambda a, b: bin(int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).count("1")
    assert distance(media.cosine_hash(one), media.cosine_hash(brighter)) <= 4
    assert distance(media.cosine_hash(one), media.cosine_hash(other)) > 4


def test_rows_filtered_one_by_one_come_back():
    rng = np.random.default_rng(3)
    images = []
    for height in (1, 2, 70, 9000, 3):
        slope = (np.arange(height)[:, None] * 3 + np.arange(64 * 3)[None, :] * rng.integers(1, 5)).astype(np.uint8)
        noise = rng.integers(0, 256, slope.shape).astype(np.uint8)
        images.append(np.where(rng.random((height, 1)) < 0.7, slope + (noise & 3), noise))
    bodies = [media.filter_rows(x, 3) for x in images]
    assert set(np.unique(np.concatenate([b[:, 0] for b in bodies]))) >= {1, 2, 3, 4}
    for x, y in zip(images, media.unfilter_all(bodies, 3), strict=True):
        assert (x == y).all()
    png = media.encode_png(images[2].tobytes())
    assert media.inflate_png(png)[0][:, 0].any()  # filtering wins here
    assert (media.decode_png(png) == images[2]).all()


def test_media_rows(spark, rows):
    long = (7_000, "long " * 400_000, "en", "x", "y", "z", "w")
    rows = [*rows, long]
    got = media.media_features(media.store(spark.createDataFrame(rows, SCHEMA))).collect()
    plain = lambda r: (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, bytes(r.hash))
    want = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        png = media.encode_png(payload)
        grey = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).mean(axis=2)
        small = grey
        for _ in range(2):  # rows, then columns
            n = len(small)
            cut = np.arange(33) * n // 32
            small = np.stack([small[cut[k] : max(cut[k] + 1, cut[k + 1])].mean(axis=0) for k in range(32)]).T
        wave = np.array([[np.cos(np.pi * k * (2 * x + 1) / 64) for x in range(32)] for k in range(8)])
        low = np.round(wave @ small @ wave.T, 6).ravel()
        bits = low > np.median(low[1:])
        bits[0] = False
        want.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), np.packbits(bits).tobytes()))
    assert sorted(map(plain, got), key=repr) == sorted(want, key=repr)
    assert media.media_features(media.store(spark.createDataFrame([], SCHEMA))).count() == 0
    with pytest.raises(Exception, match="document 9"):
        media.media_features(spark.createDataFrame([(9, 1, bytearray(b"no image"))], "doc_id long, n_bytes long, media binary")).collect()

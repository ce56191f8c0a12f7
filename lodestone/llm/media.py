"""Media columns: texts as PNG images and back, with low-frequency cosine hashes.

A payload fills RGB rows of 64 pixels (192 bytes). Encoding writes the PNG chunks over
one zlib stream; decoding walks the chunks, tests every checksum, inflates and undoes
the row filters in numpy. The hash compares the low frequencies of the grey image's
cosine transform with their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import stage, text_batches

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_MOST_CHUNK = 1 << 24
#: Side of the grey image that is transformed, and of the corner of frequencies that is kept.
SIDE, KEEP = 32, 8


def pad(data: bytes) -> bytes:
    """Blanks up to a positive multiple of a row."""
    return data + b" " * (ROW - len(data) % ROW if len(data) % ROW or not data else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


_MOST_ROWS = 8_192


def filter_rows(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Rows that start with the number of their filter: of the five, the one with the least sum of differences."""
    if len(rows) > _MOST_ROWS + 1:  # in parts, each with the row above it, which bounds the memory
        parts = [filter_rows(rows[max(0, k - 1) : k + _MOST_ROWS], bpp)[min(k, 1) :] for k in range(0, len(rows), _MOST_ROWS)]
        return np.concatenate(parts)
    x = rows.astype(np.int16)
    left, above = np.zeros_like(x), np.zeros_like(x)
    left[:, bpp:] = x[:, :-bpp]
    above[1:] = x[:-1]
    corner = np.zeros_like(x)
    corner[1:, bpp:] = x[:-1, :-bpp]
    guesses = [np.zeros_like(x), left, above, (left + above) >> 1, _paeth(left, above, corner)]
    coded = np.stack([((x - g) & 255).astype(np.uint8) for g in guesses])
    best = np.abs(coded.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    body = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    body[:, 0], body[:, 1:] = best, coded[best, np.arange(len(rows))]
    return body


def encode_png(payload: bytes, level: int = 4) -> bytes:
    """RGB, 8 bits, 64 pixels wide; rows filtered one by one or not at all, whichever is smaller."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    plain = np.zeros((len(rows), ROW + 1), np.uint8)
    plain[:, 1:] = rows
    packed = min((zlib.compress(body.tobytes(), level) for body in (plain, filter_rows(rows, CHANNELS))), key=len)
    parts = [_chunk(b"IDAT", packed[k : k + _MOST_CHUNK]) for k in range(0, len(packed), _MOST_CHUNK)]
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)) + b"".join(parts) + _chunk(b"IEND", b"")


def _paeth(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of left, above and corner the one nearest to left + above - corner, in that order of ties."""
    da, db = np.abs(above - corner), np.abs(left - corner)
    dc = np.abs(left + above - 2 * corner)
    return np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))


def unfilter_all(bodies: list[np.ndarray], bpp: int) -> list[np.ndarray]:
    """Samples of images of one width, whose rows start with their filter's number.

    A pixel needs its left, upper and upper left neighbours. So a step takes one pixel
    of each of many rows, row by row one pixel later (a diagonal); images are strung
    into lanes of about the same height, and all lanes step together.
    """
    if any(b[:, 0].max(initial=0) > 4 for b in bodies):
        raise ValueError("unknown row filter")
    out: list[np.ndarray] = [b[:, 1:] for b in bodies]
    todo = [k for k, b in enumerate(bodies) if b[:, 0].any()]
    if not todo:
        return out
    width = (bodies[0].shape[1] - 1) // bpp
    lanes = max(1, min(len(todo), round(sum(len(bodies[k]) for k in todo) / max(len(bodies[k]) for k in todo)), 64))
    load, lane_of = [0] * lanes, []
    for k in sorted(todo, key=lambda k: -len(bodies[k])):
        lane = load.index(min(load))
        lane_of.append((k, lane, load[lane]))
        load[lane] += len(bodies[k])
    height = max(load)
    kinds, first = np.zeros((lanes, height), np.int8), np.zeros((lanes, height), bool)
    code = np.zeros((lanes, height, width, bpp), np.int16)
    for k, lane, at in lane_of:
        n = len(bodies[k])
        kinds[lane, at : at + n], first[lane, at] = bodies[k][:, 0], True
        code[lane, at : at + n] = bodies[k][:, 1:].reshape(n, width, bpp)
    # one more row and column of zeros, for what lies outside
    done = np.zeros((lanes, height + 1, width + 1, bpp), np.int16)
    inside = (~first)[:, :, None].astype(np.int16)
    for step in range(height + width - 1):
        y = np.arange(max(0, step - width + 1), min(height, step + 1))
        x = step - y
        left, above, corner = done[:, y + 1, x], done[:, y, x + 1] * inside[:, y], done[:, y, x] * inside[:, y]
        kind = kinds[:, y, None]
        guess = np.where(kind == 4, _paeth(left, above, corner), np.where(kind == 3, (left + above) >> 1, np.where(kind == 2, above, np.where(kind == 1, left, 0))))
        done[:, y + 1, x + 1] = (code[:, y, x] + guess) & 255
    for k, lane, at in lane_of:
        n = len(bodies[k])
        out[k] = done[lane, at + 1 : at + n + 1, 1:].astype(np.uint8).reshape(n, -1)
    return out


def unfilter(body: np.ndarray, bpp: int) -> np.ndarray:
    """unfilter_all() of one image."""
    return unfilter_all([body], bpp)[0]


def inflate_png(data: bytes) -> tuple[np.ndarray, int]:
    """Filtered rows and channels of an 8-bit, non-interlaced image; ValueError if anything is wrong."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("the file is cut")
        size, kind = struct.unpack_from(">I4s", data, at)
        own = data[at + 8 : at + 8 + size]
        if len(own) != size or zlib.crc32(kind + own) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", own)
        elif kind == b"IDAT":
            packed.append(own)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height, depth, colour, *rest = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or any(rest):
        raise ValueError("only plain 8-bit images")
    body = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(body) != height * (width * channels + 1):
        raise ValueError("the image is cut")
    return body.reshape(height, -1), channels


def decode_png(data: bytes) -> np.ndarray:
    """Samples (height, width * channels) of an 8-bit, non-interlaced image; ValueError if anything is wrong."""
    return unfilter(*inflate_png(data))


@lru_cache(1)
def _cosines() -> np.ndarray:
    k, x = np.arange(KEEP)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def _shrink(a: np.ndarray, side: int) -> np.ndarray:
    """Mean of side equal shares of the rows; fewer rows than shares are repeated."""
    n = len(a)
    if n < side:
        return a[np.arange(side) * n // side]
    at = np.arange(side) * n // side
    return np.add.reduceat(a, at, axis=0) / np.diff(np.append(at, n))[:, None]


def cosine_hash(samples: np.ndarray, channels: int = CHANNELS) -> bytes:
    """KEEP * KEEP bits: is a low frequency above their median? The constant one counts as below."""
    grey = samples.reshape(len(samples), -1, channels).mean(axis=2)
    small = _shrink(_shrink(grey, SIDE).T, SIDE).T
    low = np.round(_cosines() @ small @ _cosines().T, 6)
    bits = low > np.median(low.ravel()[1:])
    bits[0, 0] = False
    return np.packbits(bits.ravel()).tobytes()


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a PNG in a binary column.

    Null texts count as empty: one row of blanks. Null ids, ties and repeated rows are
    rows apiece, equal texts have equal images; other columns are left out; an empty
    table gives an empty result.
    """

    def run(batches):
        for b in batches:
            for start, texts in text_batches(b.column(1)):
                data = [t.encode() for t in texts]
                yield pa.record_batch({"doc_id": b.column(0).slice(start, len(data)), "n_bytes": pa.array(map(len, data), pa.int64()), "media": pa.array([encode_png(pad(x)) for x in data], pa.binary())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def _groups(sizes: list[int], most: int):
    """Ranges of neighbours of so many in sum, or one."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if sizes:
        yield start, len(sizes)


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored images: digests of payload and file, and the hash as a binary column.

    A damaged image raises an error that names its document, rather than being left out;
    so does a null one. Null ids, ties and repeated rows are read apiece, equal images
    have equal features; other columns are left out; an empty table gives an empty
    result.
    """

    def run(batches):
        for b in batches:
            data = b.column(2).to_pylist()
            bodies = []
            for d, png in zip(b.column(0), data, strict=True):
                try:
                    body, channels = inflate_png(png or b"")
                    if channels != CHANNELS or body.shape[1] != ROW + 1:
                        raise ValueError("not an image of this width and colour")
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"document {d.as_py()}: {e}") from e
                bodies.append(body)
            samples = [s for a, z in _groups([len(x) for x in bodies], 16_384) for s in unfilter_all(bodies[a:z], CHANNELS)]
            rows = []
            for n, png, own in zip(b.column(1), data, samples, strict=True):
                payload = own.tobytes()
                rows.append((n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(own)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.record_batch({"doc_id": b.column(0)} | {k: pa.array(v, t) for k, v, t in zip(("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"), cols, kinds, strict=True)})

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media table, written and to be read back."""
    return stage(with_media(docs, id_col, text_col), "media")

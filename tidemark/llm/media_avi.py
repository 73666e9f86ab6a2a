"""AVI motion-JPEG columns: texts' bytes as 8-bit samples, RIFF indexes, intra frames and shots.

A sample is a flat 8 x 8 block of a baseline greyscale JPEG frame: with a DC quantiser of 8 the DC coefficient is
sample - 128, so any decoder gives back the exact sample. The Huffman code of a DC category c has 9 - c bits and is
followed by c bits, and the end-of-block code has 7, so every block is 16 bits and both directions are table lookups.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, table, text_slices, tidy, written

UNIT = 64  # samples of a row of blocks; payloads are padded to a multiple
ROWS = 16  # rows of blocks in a frame
FRAME = UNIT * ROWS
FPS = 25
HIST = 16
#: Bytes of texts that a task makes into files at a time.
SLICE = 1 << 20
#: Frames that are coded or decoded at a time.
TOGETHER = 256
#: Bytes of a Parquet row group of files.
MEDIA_GROUP = 16 << 20


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The 16 bits of each DC difference -255..255, and the difference of each 16 bits."""
    diff = np.arange(-255, 256)
    size = np.array([int(abs(d)).bit_length() for d in diff])
    value = np.where(diff < 0, diff + (1 << size) - 1, diff)
    prefix = ((1 << (8 - size)) - 1) << 1  # 8 - c ones, then a zero
    code = ((prefix << size) | value) << 7
    back = np.zeros(1 << 16, np.int16)
    back[code] = diff
    return code.astype(">u2"), back


CODE, BACK = _codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, 8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, ROWS * 8, UNIT * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1))))
    + _segment(0xC4, bytes([0x10] + [0] * 6 + [1] + [0] * 9 + [0]))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """Samples by frame (n x FRAME) as JPEG files."""
    k = samples.astype(np.int16)
    diff = np.empty_like(k)
    diff[:, 0] = k[:, 0] - 128
    np.subtract(k[:, 1:], k[:, :-1], out=diff[:, 1:])
    raw = CODE[diff + 255].tobytes()
    w = 2 * FRAME
    return [HEAD + raw[i : i + w].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for i in range(0, len(raw), w)]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The samples (n x FRAME) of JPEG files with this module's header, by table lookup."""
    scans = []
    for f in frames:
        if not f.startswith(HEAD) or not f.endswith(b"\xff\xd9"):
            raise ValueError("not an intra frame of this profile")
        scans.append(f[len(HEAD) : -2].replace(b"\xff\x00", b"\xff"))
    code = np.frombuffer(b"".join(scans), ">u2").reshape(len(frames), FRAME)
    return (np.cumsum(BACK[code], axis=1, dtype=np.int16) + 128).astype(np.uint8)


#: Rows and columns of an 8 x 8 block in zigzag order: diagonals, walked up and down in turn.
_ZIGZAG = np.array(sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else -x[0])))
_COSINE = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]


def _huffman(body: bytes, into: dict[int, list[int]]) -> None:
    """Put a DHT segment's tables into `into`: by class and number, for each 16 bits the code's length << 8 | symbol."""
    at = 0
    while at + 17 <= len(body):
        counts, symbols = body[at + 1 : at + 17], body[at + 17 : at + 17 + sum(body[at + 1 : at + 17])]
        table, code, k = np.zeros(1 << 16, np.int32), 0, 0
        for length, count in enumerate(counts, 1):
            for _ in range(count):
                table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        into[body[at]] = table.tolist()
        at += 17 + len(symbols)


class _Bits:
    """The entropy-coded bits between two restart markers, stuffed zeros removed."""

    def __init__(self, data: bytes):
        self.data, self.end = data.replace(b"\xff\x00", b"\xff") + bytes(3), 8 * len(data.replace(b"\xff\x00", b"\xff"))
        self.at = 0

    def take(self, n: int) -> int:
        d, i = self.data, self.at >> 3
        self.at += n
        if self.at > self.end:
            raise ValueError("a scan ends early")
        return ((d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> (24 - (self.at - n - 8 * i) - n)) & ((1 << n) - 1)

    def symbol(self, table: list[int]) -> int:
        d, i = self.data, self.at >> 3
        got = table[(d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> (8 - (self.at & 7)) & 0xFFFF]
        self.at += got >> 8
        if not got or self.at > self.end:
            raise ValueError("a scan has no such code, or ends early")
        return got & 0xFF

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _block(bits: _Bits, dc: list[int], ac: list[int], prior: int, out: np.ndarray) -> int:
    """One block's 64 coefficients in zigzag order into out; returns its DC coefficient."""
    out[0] = prior = prior + bits.value(bits.symbol(dc))
    k = 1
    while k < 64:
        got = bits.symbol(ac)
        run, size = got >> 4, got & 15
        if not size:
            if run < 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a run passes the end of its block")
        out[k] = bits.value(size)
        k += 1
    return prior


def decode_jpeg(data: bytes, tables: bytes = b"") -> np.ndarray:
    """The first component (luma or grey; height x width, uint8) of any baseline Huffman JPEG file.

    Tables are read from the file's DQT and DHT segments; `tables` is the body of a DHT segment for files that leave
    theirs out, as motion JPEG may. Sampling factors, restart markers and scans of one or more components are followed.
    Progressive, arithmetic, 12-bit and broken files raise a ValueError.
    """
    quant: dict[int, np.ndarray] = {}
    huffman: dict[int, list[int]] = {}
    if tables:
        _huffman(tables, huffman)
    parts: dict[int, dict] = {}
    every = height = width = at = 0
    try:
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:  # fill bytes
                at += 1
            mark, size = data[at + 1], 0
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            if mark == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float64)
                    k += 129 if wide else 65
            elif mark == 0xC4:
                _huffman(body, huffman)
            elif mark in (0xC0, 0xC1):
                bits, height, width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not height or not width:
                    raise ValueError("not an 8-bit frame of known size")
                parts = {body[6 + 3 * k]: {"h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(n)}
                top, wide = max(p["v"] for p in parts.values()), max(p["h"] for p in parts.values())
                down, across = -(-height // (8 * top)), -(-width // (8 * wide))
                for p in parts.values():
                    p["coef"] = np.zeros((down * p["v"], across * p["h"], 64), np.int32)
                    p["rows"], p["cols"] = -(-(-(-height * p["v"] // top)) // 8), -(-(-(-width * p["h"] // wide)) // 8)
            elif 0xC2 <= mark <= 0xCF:
                raise ValueError("not a baseline Huffman frame")
            elif mark == 0xDD:
                every = struct.unpack(">H", body)[0]
            elif mark == 0xDA:
                at = _scan(data, at, body, parts, huffman, every)
        first = next(iter(parts.values()))
        flat = first["coef"] * quant[first["q"]]
        square = np.zeros((*flat.shape[:2], 8, 8))
        square[..., _ZIGZAG[:, 0], _ZIGZAG[:, 1]] = flat
        plane = np.clip(np.rint(_COSINE.T @ square @ _COSINE + 128), 0, 255).astype(np.uint8)
        plane = plane.swapaxes(1, 2).reshape(8 * flat.shape[0], 8 * flat.shape[1])
        return plane[: -(-height * first["v"] // top), : -(-width * first["h"] // wide)]
    except (IndexError, KeyError, struct.error, StopIteration, ZeroDivisionError) as e:
        raise ValueError(f"a broken JPEG file: {e!r}") from e


def _scan(data: bytes, at: int, head: bytes, parts: dict[int, dict], huffman: dict[int, list[int]], every: int) -> int:
    """Decode the scan at `at` into the components' coefficients; the place behind it."""
    own = [(parts[head[1 + 2 * k]], head[2 + 2 * k]) for k in range(head[0])]
    pieces, begin = [], at
    while True:
        at = data.index(b"\xff", at)
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            pieces.append(data[begin:at])
            at = begin = at + 2
        else:
            pieces.append(data[begin:at])
            break
    if len(own) == 1:
        p = own[0][0]
        units = [[(0, r, c)] for r in range(p["rows"]) for c in range(p["cols"])]
    else:
        p = own[0][0]
        down, across = p["coef"].shape[0] // p["v"], p["coef"].shape[1] // p["h"]
        units = [[(k, r * q["v"] + y, c * q["h"] + x) for k, (q, _) in enumerate(own) for y in range(q["v"]) for x in range(q["h"])] for r in range(down) for c in range(across)]
    every = every or len(units)
    for number, piece in enumerate(pieces):
        bits, prior = _Bits(piece), [0] * len(own)
        for unit in units[number * every : (number + 1) * every]:
            for k, r, c in unit:
                p, of = own[k]
                prior[k] = _block(bits, huffman[of >> 4], huffman[0x10 | of & 15], prior[k], p["coef"][r, c])
    if len(pieces) * every < len(units):
        raise ValueError("a scan ends early")
    return at


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], n_bytes: int, payload_bytes: int) -> bytes:
    n, top = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, top * FPS, 0, 0x10, n, 0, 1, top, UNIT * 8, ROWS * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, n, top, 0xFFFFFFFF, 0, 0, 0, UNIT * 8, ROWS * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, UNIT * 8, ROWS * 8, 1, 24, b"MJPG", UNIT * ROWS * 64 * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", f"bytes={n_bytes} payload={payload_bytes}".encode() + b"\0"))
    at, index, movi = 4, [], [b"movi"]
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a RIFF chunk runs past its parent")
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


@dataclass
class Avi:
    frames: list[bytes]
    seconds: float  # a frame lasts
    n_bytes: int | None  # of the stored text, where a note says so
    payload_bytes: int | None


def read_avi(data: bytes) -> Avi:
    """The video frames of an AVI file by its idx1 entries, offsets from movi or from the file's start; without an idx1 by
    walking movi. A file that is no AVI or whose chunks are broken raises a ValueError."""
    try:
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        movi, index, note, micros = None, None, b"", 0
        for name, at, size in _chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
            kind = data[at : at + 4] if name == b"LIST" else b""
            if kind == b"hdrl":
                micros = next((struct.unpack_from("<I", data, a)[0] for k, a, _ in _chunks(data, at + 4, at + size) if k == b"avih"), 0)
            elif kind == b"movi":
                movi = (at, at + size)
            elif kind == b"INFO":
                note = next((data[a : a + s] for k, a, s in _chunks(data, at + 4, at + size) if k == b"ICMT"), b"")
            elif name == b"idx1":
                index = data[at : at + size]
        if movi is None:
            raise ValueError("an AVI file without movi")
        frames = []
        if index is None:
            frames = [data[a : a + s] for k, a, s in _movi_chunks(data, movi[0] + 4, movi[1]) if k[2:] in (b"dc", b"db")]
        else:
            entries = [x for x in struct.iter_unpack("<4sIII", index) if x[0][2:] in (b"dc", b"db")]
            base = movi[0] if entries and data[movi[0] + entries[0][2] :][:4] == entries[0][0] else 0
            for name, _, off, size in entries:
                at = base + off + 8
                if data[at - 8 : at - 4] != name or struct.unpack_from("<I", data, at - 4)[0] != size or at + size > movi[1]:
                    raise ValueError("idx1 and movi differ")
                frames.append(data[at : at + size])
        found = re.fullmatch(rb"bytes=(\d+) payload=(\d+)\0*", note)
        return Avi(frames, micros / 1e6 if micros else 1 / FPS, *(map(int, found.groups()) if found else (None, None)))
    except struct.error as e:
        raise ValueError(f"a broken AVI file: {e}") from e


def _movi_chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    for name, a, size in _chunks(data, at, end):
        if name == b"LIST" and data[a : a + 4] == b"rec ":
            yield from _movi_chunks(data, a + 4, a + size)
        else:
            yield name, a, size


def shot_cuts(bins: np.ndarray, first: np.ndarray, window: int = 8, factor: float = 3.0, floor: float = 0.1) -> np.ndarray:
    """Whether each frame starts a shot. bins: its histogram in shares (n x HIST); first: whether it starts a file.

    A frame's histogram difference to the one before (0 to 1) is a cut if it is at least `floor` and `factor` times
    the mean difference over the up to `window` frames before it in its file.
    """
    n = len(bins)
    if not n:
        return np.zeros(0, bool)
    d = np.zeros(n)
    d[1:] = np.abs(np.diff(bins, axis=0)).sum(1) / 2
    d[first] = 0
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    total = np.concatenate([[0], np.cumsum(d)])
    i = np.arange(n)
    low = np.maximum(start + 1, i - window)
    count = np.maximum(i - low, 0)
    mean = np.where(count > 0, (total[i] - total[np.minimum(low, i)]) / np.maximum(count, 1), 0)
    return first | ((d >= floor) & (d >= factor * mean))


def to_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs without `text` and with `media` binary: each whole text's payload as an AVI motion-JPEG file.

    The payload is the text's UTF-8 bytes and zero bytes up to a positive multiple of 64; null is empty. Every row
    has a file; equal texts have equal files, and repeated rows stay. Other columns stay; one named like the output is
    replaced; an empty table gives none. A task holds SLICE bytes of texts, or one longer text and its file.
    """
    keep = [c for c in docs.columns if c not in (text, media)]
    schema = docs.select(*keep).schema.add(media, "binary")
    body = free_name(docs.columns, "_t")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, off in text_slices(batch, body, SLICE):
                size = np.diff(off).tolist()
                payload = [max(1, -(-n // UNIT)) * UNIT for n in size]
                frames = [-(-p // FRAME) for p in payload]
                flat = np.zeros(sum(frames) * FRAME, np.uint8)
                at = 0
                for i, n, k in zip(off.tolist(), size, frames):
                    flat[at : at + n] = raw[i : i + n]
                    at += k * FRAME
                flat, jpeg = flat.reshape(-1, FRAME), []
                for i in range(0, len(flat), TOGETHER):
                    jpeg += encode_frames(flat[i : i + TOGETHER])
                files, at = [], 0
                for n, p, k in zip(size, payload, frames):
                    files.append(write_avi(jpeg[at : at + k], n, p))
                    at += k
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index(c)) for c in keep] + [pa.array(files, pa.binary())], names=keep + [media],
                )

    return docs.select(*keep, F.col(text).alias(body)).mapInArrow(run, schema)


@dataclass
class Decoded:
    avi: Avi | None
    error: str | None
    bins: np.ndarray  # histograms of the frames in shares
    samples: bytes | None  # of files with this module's header


def decode_avi(data: bytes) -> Decoded:
    """An AVI file's frames as histograms of their luma, TOGETHER frames at a time, and the samples where the frames are
    this module's. A broken file has the error and no frames."""
    try:
        avi = read_avi(data)
        bins, samples = np.zeros((len(avi.frames), HIST)), bytearray()
        own = all(f.startswith(HEAD) for f in avi.frames)
        for i in range(0, len(avi.frames), TOGETHER):
            part = avi.frames[i : i + TOGETHER]
            if own:
                x = decode_frames(part)
                at = (x >> 4).astype(np.int32) + np.arange(len(x), dtype=np.int32)[:, None] * HIST
                bins[i : i + len(x)] = np.bincount(at.ravel(), minlength=len(x) * HIST).reshape(len(x), HIST) / FRAME
                samples += x.tobytes()
            else:
                for k, f in enumerate(part, i):
                    plane = decode_jpeg(f)
                    bins[k] = np.bincount(plane.ravel() >> 4, minlength=HIST) / plane.size
        return Decoded(avi, None, bins, bytes(samples) if own else None)
    except ValueError as e:
        return Decoded(None, str(e), np.zeros((0, HIST)), None)


def _shots(d: Decoded) -> list[dict]:
    """The file's clips."""
    first = np.arange(len(d.bins)) == 0
    cut = np.flatnonzero(shot_cuts(d.bins, first)).tolist()
    s = d.avi.seconds if d.avi else 0.0
    return [{"clip": k, "first_frame": a, "n_frames": b - a, "start_s": a * s, "end_s": b * s} for k, (a, b) in enumerate(zip(cut, [*cut[1:], len(d.bins)]))]


_CLIP = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])
_CLIPS = T.ArrayType(T.StructType().add("clip", "integer").add("first_frame", "integer").add("n_frames", "integer").add("start_s", "double").add("end_s", "double"))


def _files(batch: pa.RecordBatch, media: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of at most 2 x SLICE bytes of files, or of one longer file."""
    for rows, raw, off in text_slices(batch, media, 2 * SLICE):
        yield rows, [raw[i:j].tobytes() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Timed clip rows: key, clip, first_frame, n_frames, start_s, end_s and error of each shot of each file.

    A shot starts where the histogram of a frame differs from the one before far more than in the frames before that
    (see shot_cuts). Any AVI file of baseline JPEG frames will do. A file that cannot be read has one row with the
    error and nulls; a null file or one without frames has none; repeated rows have their clips each.
    """
    schema = media.select(key).schema.add("clips", _CLIPS).add("error", "string")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, files in _files(batch, column):
                shots, errors = [], []
                for f in files:
                    d = decode_avi(f)
                    shots.append([None] if d.error else _shots(d))
                    errors.append(d.error)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(shots, pa.list_(_CLIP)), pa.array(errors, pa.string())], names=[key, "clips", "error"],
                )

    found = media.where(F.col(column).isNotNull()).select(key, column).mapInArrow(run, schema)
    return found.select(key, F.explode("clips").alias("_c"), "error").select(key, "_c.*", "error")


def features(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Of each file that to_media wrote: key, n_bytes and payload_bytes as its note says, payload_sha256 and tail_crc32
    (unsigned, last 64 bytes) of the samples read back, media_bytes and media_sha256 of the file, a feature text and the
    array of its clips. Files that cannot be read, were not written so, or are null have nulls and their error as the feature."""
    schema = media.select(key).schema
    for name, kind in (
        ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"),
        ("media_sha256", "string"), ("feature", "string"), ("clips", _CLIPS),
    ):
        schema = schema.add(name, kind)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_CLIP)]

    def one(f: bytes) -> tuple:
        d = decode_avi(f)
        if d.error or d.samples is None or d.avi.payload_bytes is None or d.avi.payload_bytes > len(d.samples):
            return (None, None, None, None, len(f), hashlib.sha256(f).hexdigest(), d.error or "not written by to_media", _shots(d))
        body, shots = memoryview(d.samples)[: d.avi.payload_bytes], _shots(d)
        said = f"frames={len(d.bins)} shots={len(shots)} mean={np.frombuffer(d.samples, np.uint8).mean():.3f}"
        return (d.avi.n_bytes, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(f), hashlib.sha256(f).hexdigest(), said, shots)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, files in _files(batch, column):
                out = list(zip(*map(one, files)))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x, t) for x, t in zip(out, types))], names=schema.names)

    return media.select(key, column).mapInArrow(run, schema)


def op5_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as an AVI file, written, read back and measured.

    Null and empty texts have a payload of 64 zero bytes; rows of one doc_id have a row each; equal texts have equal
    values but for doc_id; other columns of documents are ignored, so their names cannot clash; an empty table gives none.
    Row groups of MEDIA_GROUP bytes bound what a writing task holds.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    options = {"parquet.block.size": MEDIA_GROUP, "parquet.page.size": 256 << 10, "parquet.enable.dictionary": "false"}
    return features(written(to_media(docs), "media", **options))

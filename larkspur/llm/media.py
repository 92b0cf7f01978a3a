"""Media columns: AVI files of motion JPEG, their shots and timed clips.

``write_avi`` and ``read_avi`` build and parse RIFF files with an idx1 index (an
absent or broken index is replaced by a walk through movi).  Frames are intra
coded, see :mod:`larkspur.llm.jpeg`.  A shot ends where the luma histograms of
two frames differ by more than the mean of the shot's differences so far plus
``SPREAD`` standard deviations, and by ``LEAST`` at least.

``store_payloads`` turns texts into such files losslessly: the UTF-8 bytes, padded
with spaces to a positive multiple of 192, are the 8-bit samples of frames of
48 x 32, the last one filled with spaces; an INFO comment holds how many bytes
are payload.

Cases.  Null text counts as empty (one padded unit).  A null or broken file has
one clip row with a reason and no times.  A file without frames has no clips.
Repeated rows get equal rows.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.jpeg import decode_frames, encode_lossless
from larkspur.llm.texts import text_at

UNIT, WIDTH, HEIGHT, FPS, FILL = 192, 48, 32, 25, 32
BINS, SPREAD, LEAST = 16, 3.0, 0.15


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS, comment: bytes = b"") -> bytes:
    """A one-stream MJPG file with an idx1 index."""
    n, most = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, n, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment)) if comment else b""
    chunks = [_chunk(b"00dc", f) for f in frames]
    places = np.cumsum([4, *map(len, chunks)]).tolist()  # from the four letters movi
    idx1 = b"".join(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)) for at, f in zip(places, frames, strict=False))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + info + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", idx1))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of each chunk's body."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> tuple[list[bytes], float, bytes]:
    """Frames of the first video stream, frames per second and the comment."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, comment, movi, index = float(FPS), b"", None, None
    for name, a, b in _chunks(data, 12, len(data)):
        kind = data[a : a + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            for sub, c, d in _chunks(data, a + 4, b):
                if sub == b"avih" and (per := struct.unpack_from("<I", data, c)[0]):
                    fps = 1_000_000 / per
                elif sub == b"LIST":
                    for leaf, e, _ in _chunks(data, c + 4, d):
                        if leaf == b"strh" and data[e : e + 4] == b"vids":
                            scale, rate = struct.unpack_from("<II", data, e + 20)
                            fps = rate / scale if scale and rate else fps
        elif kind == b"INFO":
            comment = next((data[c:d] for sub, c, d in _chunks(data, a + 4, b) if sub == b"ICMT"), comment)
        elif kind == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = (a, b)
    if movi is None:
        raise ValueError("no movi list")
    frames = _indexed(data, movi[0], index) if index else None
    if frames is None:
        frames = [data[c:d] for sub, c, d in _chunks(data, movi[0] + 4, movi[1]) if sub[2:] in (b"dc", b"db")]
    return frames, fps, comment


def _indexed(data: bytes, movi: int, index: tuple[int, int]) -> list[bytes] | None:
    """Frames by idx1, whose places count from movi or from the file's start; None if it doesn't fit."""
    entries = [e for e in struct.iter_unpack("<4sIII", data[index[0] : index[1] - (index[1] - index[0]) % 16]) if e[0][2:] in (b"dc", b"db")]
    for base in (movi, 0):
        if all(data[base + at : base + at + 4] == name and struct.unpack_from("<I", data, base + at + 4)[0] == size for name, _, at, size in entries if base + at + 8 <= len(data)):
            return [data[base + at + 8 : base + at + 8 + size] for _, _, at, size in entries]
    return None


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """(frames, BINS) shares of luma values."""
    if not frames:
        return np.zeros((0, BINS))
    step = 256 // BINS
    if len({f.shape for f in frames}) == 1:
        out = np.empty((len(frames), BINS))
        for at in range(0, len(frames), 256):
            level = np.stack(frames[at : at + 256]).reshape(min(256, len(frames) - at), -1) // step
            own = level + BINS * np.arange(len(level))[:, None]
            out[at : at + 256] = np.bincount(own.ravel(), minlength=BINS * len(level)).reshape(-1, BINS) / level.shape[1]
        return out
    return np.stack([np.bincount(f.ravel() // step, minlength=BINS) / f.size for f in frames])


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """(first, after last) frame of every shot."""
    change = (0.5 * np.abs(np.diff(hist, axis=0)).sum(1)).tolist()
    cuts, n, total, squares = [0], 0, 0.0, 0.0
    for k, d in enumerate(change, 1):
        mean = total / n if n else 0.0
        spread = max(squares / n - mean * mean, 0.0) ** 0.5 if n else 0.0
        if d > max(LEAST, mean + SPREAD * spread):
            cuts.append(k)
            n, total, squares = 0, 0.0, 0.0
        else:
            n, total, squares = n + 1, total + d, squares + d * d
    return list(zip(cuts, [*cuts[1:], len(hist)], strict=True)) if len(hist) else []


def payload_avi(text: bytes | None) -> tuple[int, bytes]:
    """Bytes of payload and the file that stores it."""
    raw = text or b""
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    area = WIDTH * HEIGHT
    samples = np.full(-(-size // area) * area, FILL, np.uint8)
    samples[: len(raw)] = np.frombuffer(raw, np.uint8)
    frames = samples.reshape(-1, HEIGHT, WIDTH)
    coded = [f for at in range(0, len(frames), 512) for f in encode_lossless(frames[at : at + 512])]
    return size, write_avi(coded, WIDTH, HEIGHT, FPS, b"payload_bytes=%d" % size)


def payload_of(data: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """What :func:`payload_avi` stored, read back, with its frames and their rate."""
    files, fps, comment = read_avi(data)
    frames = decode_frames(files)
    return b"".join(f.tobytes() for f in frames)[: int(comment.partition(b"=")[2])], frames, fps


def store_payloads(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Per row: the stored form of its text and what reading that back gives."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_shots", "media"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    keep = len(names) if with_media else len(names) - 1
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_shots long" + ", media binary" * with_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # media of a few rows at a time
                part, rows = batch.slice(at, 256), []
                for doc_id, text in zip(part.column(0).to_pylist(), text_at(part.column(1)), strict=True):
                    size, data = payload_avi(text)
                    payload, frames, fps = payload_of(data)
                    hist = histograms(frames)
                    cuts = shots(hist)
                    tone = "".join(f"{int(x):02x}" for x in np.rint(255 * hist.mean(0)))
                    feature = f"{len(frames)} frames, tone {tone}, cuts {zlib.crc32(repr(cuts).encode()):08x}, first clip {cuts[0][1] / fps:.3f} s"
                    rows.append((doc_id, len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(frames), len(cuts), data)[:keep])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names[:keep])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def clips(videos: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per shot of every file: key, clip, first_frame, n_frames, start_s, end_s, reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    if not data.is_valid:
                        raise ValueError("null file")
                    files, fps, _ = read_avi(data.as_py())
                    hist = np.concatenate([np.zeros((0, BINS)), *(histograms(decode_frames(files[at : at + 512])) for at in range(0, len(files), 512))])
                    rows = [(k, i, a, b - a, a / fps, b / fps, None) for i, (a, b) in enumerate(shots(hist))]
                except (ValueError, KeyError, IndexError, struct.error) as broken:
                    rows = [(k, None, None, None, None, None, str(broken))]
                if rows:
                    kinds = (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "clip", "first_frame", "n_frames", "start_s", "end_s", "reason"])

    picked = videos.select(F.col(key).alias("key"), F.col(media).cast("binary").alias("media"))
    return picked.mapInArrow(run, f"key {picked.schema['key'].dataType.simpleString()}, clip int, first_frame long, n_frames long, start_s double, end_s double, reason string")

"""JPEG frames: lossless (SOF3) encoding and decoding, baseline (SOF0) decoding.

The lossless encoder writes 8-bit one-component frames with predictor 1.  Its
Huffman table gives the difference category s a code of 9 - s bits, so that code
and extra bits are nine bits for every sample; all samples of many frames are
then coded and decoded by a few array operations.  Frames of any other table go
through a bit reader.
"""

from __future__ import annotations

import struct

import numpy as np

#: Code lengths of the nine-bit table: the categories by rising code length, one each of 1 to 9 bits.
NINE_BIT_SYMBOLS = (8, 7, 6, 5, 4, 3, 2, 1, 0)
_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


def _nine_bit_words() -> np.ndarray:
    """Word of each difference -255..255."""
    words = np.empty(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2  # ones and a final zero
        words[d + 255] = code << s | (d if d > 0 else d + (1 << s) - 1 if d else 0)
    return words


_WORDS = _nine_bit_words()
_DIFFS = np.full(512, 0, np.int16)
_DIFFS[_WORDS] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def lossless_header(height: int, width: int) -> bytes:
    """Everything of a frame before its entropy-coded samples."""
    lengths = bytes([1] * 9 + [0] * 7)
    return (
        b"\xff\xd8"
        + _segment(0xC3, struct.pack(">BHHB", 8, height, width, 1) + bytes((1, 0x11, 0)))
        + _segment(0xC4, b"\x00" + lengths + bytes(NINE_BIT_SYMBOLS))
        + _segment(0xDA, bytes((1, 1, 0x00, 1, 0, 0)))
    )


def encode_lossless(frames: np.ndarray) -> list[bytes]:
    """JPEG files of frames (n, height, width) uint8; height x width a multiple of 8."""
    n, height, width = frames.shape
    samples = frames.astype(np.int16)
    diff = np.empty_like(samples)
    diff[:, :, 1:] = samples[:, :, 1:] - samples[:, :, :-1]
    diff[:, 1:, 0] = samples[:, 1:, 0] - samples[:, :-1, 0]
    diff[:, 0, 0] = samples[:, 0, 0] - 128
    w = _WORDS[diff.reshape(n, -1, 8) + 255]
    out = np.empty((n, w.shape[1], 9), np.uint8)
    out[:, :, 0] = w[:, :, 0] >> 1
    for k in range(1, 8):
        out[:, :, k] = (w[:, :, k - 1] & ((1 << k) - 1)) << (8 - k) | w[:, :, k] >> (k + 1)
    out[:, :, 8] = w[:, :, 7] & 0xFF
    head = lossless_header(height, width)
    return [head + coded.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for coded in out]


def _undo_predictor_1(diff: np.ndarray) -> np.ndarray:
    """Samples (n, height, width) of differences against the left, or above in column 0."""
    diff = diff.astype(np.int64)
    diff[:, :, 0] = 128 + np.cumsum(diff[:, :, 0], axis=1)
    return (np.cumsum(diff, axis=2) & 0xFFFF).astype(np.uint16)


def decode_frames(files: list[bytes]) -> list[np.ndarray]:
    """Luma (height, width) uint8 of each file; runs of nine-bit lossless frames at once."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(files):
        head = _nine_bit_head(files[at])
        end = at + 1
        if not head:
            out.append(decode_frame(files[at]))
        else:
            while end < len(files) and end - at < 512 and files[end].startswith(head):
                end += 1
            height, width = struct.unpack(">HH", head[7:11])
            coded = b"".join(f[len(head) : -2].replace(b"\xff\x00", b"\xff") for f in files[at:end])
            b = np.frombuffer(coded, np.uint8).astype(np.uint16).reshape(end - at, -1, 9)
            w = np.empty(b.shape[:2] + (8,), np.uint16)
            for k in range(8):
                w[:, :, k] = (b[:, :, k] & ((1 << (8 - k)) - 1)) << (k + 1) | b[:, :, k + 1] >> (7 - k)
            out.extend(_undo_predictor_1(_DIFFS[w].reshape(end - at, height, width)).astype(np.uint8))
        at = end
    return out


def _nine_bit_head(file: bytes) -> bytes | None:
    size = struct.unpack(">HH", file[7:11]) if len(file) > 11 else (0, 0)
    head = lossless_header(*size) if size[0] and size[1] and size[0] * size[1] % 8 == 0 else None
    return head if head and file.startswith(head) else None


class _Bits:
    """Reader of entropy-coded data without stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at, self.n = self.at + 1, self.n + 8
        self.n -= k
        value = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("bad Huffman code")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        value = self.take(size)
        return value if value >> (size - 1) else value - (1 << size) + 1


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    table, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def decode_frame(file: bytes) -> np.ndarray:
    """Luma of one lossless or baseline frame of 8-bit samples, by its markers."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quant, tables, frame, restart = 2, {}, {}, None, 0
    while at + 4 <= len(file):
        if file[at] != 0xFF:
            raise ValueError("marker expected")
        if file[at + 1] == 0xFF:
            at += 1
            continue
        marker, size = file[at + 1], struct.unpack(">H", file[at + 2 : at + 4])[0]
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                raw = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                quant[body[0] & 15], body = raw, body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = _huffman(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            precision, height, width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise ValueError("only 8-bit samples are read")
            frame = (marker, height, width, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)])
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError(f"JPEG process {marker:#x} is not read")
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("scan before frame")
            parts = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            return _scan(file[at:], frame, parts, body[1 + 2 * body[0]], quant, tables, restart)
    raise ValueError("no scan")


def _scan(data: bytes, frame: tuple, parts: list, predictor: int, quant: dict, tables: dict, restart: int) -> np.ndarray:
    pieces, begin, k = [], 0, 0  # entropy-coded data between restart markers
    while (k := data.find(b"\xff", k)) >= 0 and k + 1 < len(data):
        if data[k + 1] == 0:
            k += 2
            continue
        pieces.append(data[begin:k])
        begin = k = k + 2
        if not 0xD0 <= data[k - 1] <= 0xD7:
            break
    else:
        pieces.append(data[begin:])
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in pieces]
    return (_scan_lossless if frame[0] == 0xC3 else _scan_baseline)(pieces, frame, parts, predictor, quant, tables, restart)


def _scan_lossless(pieces, frame, parts, predictor, quant, tables, restart) -> np.ndarray:
    _, height, width, components = frame
    if len(components) != 1 or len(pieces) != 1:
        raise ValueError("lossless frames are read with one component and no restarts")
    bits, table = _Bits(pieces[0]), tables[parts[0][1] >> 4]
    diff = np.array([bits.signed(bits.symbol(table)) for _ in range(height * width)], np.int64).reshape(height, width)
    if predictor == 1:
        return _undo_predictor_1(diff[None])[0].astype(np.uint8)
    out = np.zeros((height, width), np.int64)
    for y in range(height):
        for x in range(width):
            a, b, c = (out[y, x - 1] if x else 0), (out[y - 1, x] if y else 0), (out[y - 1, x - 1] if x and y else 0)
            guess = 128 if not (x or y) else a if not y else b if not x else (0, a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor]
            out[y, x] = (guess + diff[y, x]) & 0xFFFF
    return out.astype(np.uint8)


def _scan_baseline(pieces, frame, parts, predictor, quant, tables, restart) -> np.ndarray:
    _, height, width, components = frame
    top_h, top_v = max(c[1] for c in components), max(c[2] for c in components)
    across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    scan = {ident: (tables[sel >> 4], tables[16 | (sel & 15)]) for ident, sel in parts}
    if len(components) == 1:  # one component: its blocks in rows, whatever its factors
        components = [(components[0][0], 1, 1, components[0][3])]
        across, down = -(-width // 8), -(-height // 8)
    _, h0, v0, q0 = components[0]
    coef = np.zeros((down * v0, across * h0, 64), np.int64)
    bits, last, piece = _Bits(pieces[0]), dict.fromkeys(scan, 0), 0
    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            piece += 1
            bits, last = _Bits(pieces[piece]), dict.fromkeys(scan, 0)
        for c, (ident, h, v, _) in enumerate(components):
            dc, ac = scan[ident]
            for k in range(h * v):
                block = np.zeros(64, np.int64)
                last[ident] += bits.signed(bits.symbol(dc))
                block[0], at = last[ident], 1
                while at < 64:
                    s = bits.symbol(ac)
                    if s == 0:
                        break
                    at += s >> 4
                    if s & 15:
                        block[at] = bits.signed(s & 15)
                    at += 1
                if c == 0:
                    coef[mcu // across * v + k // h, mcu % across * h + k % h] = block
    plain = np.zeros_like(coef)
    plain[:, :, _ZIGZAG] = coef * quant[q0]
    basis = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
    blocks = plain.reshape(*plain.shape[:2], 8, 8)
    luma = np.einsum("xu,rcuv,yv->rxcy", basis, blocks, basis).reshape(coef.shape[0] * 8, coef.shape[1] * 8)
    return np.clip(np.rint(luma) + 128, 0, 255).astype(np.uint8)[:height, :width]

"""Baseline JPEG to pixels: the entropy-coded part by table look-up, all else as array arithmetic over blocks.

Grey and three-component images of 8 bits with any sampling factors and restart intervals; progressive ones are an error.
Where OpenCV or Pillow is installed, :func:`loomery.sources.containers.decode_image` uses that instead.
"""

from __future__ import annotations

import re

import numpy as np

#: Order in which a block's 64 coefficients are coded: along its diagonals, turning at the edges.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
_COS = np.array([[(0.5 if u else np.sqrt(0.125)) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def segments(data: bytes):
    """(marker, start, end) of the segments before the first scan, and of that scan's header."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        kind = data[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield kind, at + 4, at + 2 + size
        if kind == 0xDA:
            return
        at += 2 + size


def jpeg_size(data: bytes) -> tuple[int, int]:
    """Width and height from the frame header."""
    for kind, at, _ in segments(data):
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 3 : at + 5], "big"), int.from_bytes(data[at + 1 : at + 3], "big")
    raise ValueError("a JPEG image has no frame")


def _table(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) for every 16 bits that may follow."""
    out, code = [(0, 0)] * 65536, 0
    symbol = iter(symbols)
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = [(length, next(symbol))] * (1 << (16 - length))
            code += 1
        code <<= 1
    return out


def _read_units(raw: bytes, units, n: int, last: list[int]) -> None:
    """Decodes n units (one restart interval); a unit lists (component, DC table, AC table, blocks of the unit)."""
    raw = raw.replace(b"\xff\x00", b"\xff") + b"\0" * 8
    acc, have, at = 0, 0, 0

    def fill():
        nonlocal acc, have, at
        acc = (acc & ((1 << have) - 1)) << 48 | int.from_bytes(raw[at : at + 6].ljust(6, b"\0"), "big")
        have, at = have + 48, at + 6

    def coded(table):
        nonlocal have
        if have < 32:
            fill()
        length, symbol = table[acc >> (have - 16) & 0xFFFF]
        if not length:
            raise ValueError("a JPEG code is not known")
        have -= length
        return symbol

    def number(size):
        nonlocal have
        if have < size:
            fill()
        have -= size
        v = acc >> have & (1 << size) - 1
        return v if v >> (size - 1) else v - (1 << size) + 1

    zigzag = ZIGZAG.tolist()
    for k in range(n):
        for c, dc, ac, blocks in units(k):
            for block in blocks:
                size = coded(dc)
                if size:
                    last[c] += number(size)
                block[0] = last[c]
                i = 1
                while i < 64:
                    symbol = coded(ac)
                    if symbol & 15:
                        i += symbol >> 4
                        if i > 63:
                            raise ValueError("a JPEG block is too long")
                        block[zigzag[i]] = number(symbol & 15)
                        i += 1
                    elif symbol == 0xF0:
                        i += 16
                    else:
                        break
    if at - have // 8 > len(raw):
        raise ValueError("a JPEG image ends too early")


def _twice(x: np.ndarray, axis: int) -> np.ndarray:
    """Twice the length along an axis; each value leans a quarter towards its nearer neighbour."""
    x = np.moveaxis(x, axis, 0)
    out = np.empty((2 * len(x), *x.shape[1:]))
    out[0::2] = 0.75 * x + 0.25 * x[np.maximum(np.arange(len(x)) - 1, 0)]
    out[1::2] = 0.75 * x + 0.25 * x[np.minimum(np.arange(len(x)) + 1, len(x) - 1)]
    return np.moveaxis(out, 0, axis)


def read_jpeg(data: bytes) -> np.ndarray:
    """Height, width, channels; colour is blue-green-red."""
    quant, codes, restart, adobe, frame, scan = {}, {}, 0, None, None, None
    for kind, at, end in segments(data):
        part = data[at:end]
        if kind == 0xDB:
            while part:
                wide = part[0] >> 4
                quant[part[0] & 15] = np.frombuffer(part, ">u2" if wide else "u1", 64, 1)
                part = part[65 + 64 * wide :]
        elif kind == 0xC4:
            while part:
                n = sum(part[1:17])
                codes[part[0]] = _table(part[1:17], part[17 : 17 + n])
                part = part[17 + n :]
        elif kind in (0xC0, 0xC1):
            frame = part
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("only baseline JPEG images are read here")
        elif kind == 0xDD:
            restart = int.from_bytes(part, "big")
        elif kind == 0xEE and part[:5] == b"Adobe":
            adobe = part[11]
        elif kind == 0xDA:
            scan, body = part, data[end:]
    if frame is None or scan is None or frame[0] != 8 or scan[0] != frame[5]:
        raise ValueError("the JPEG image is of an unknown kind")
    h, w = int.from_bytes(frame[1:3], "big"), int.from_bytes(frame[3:5], "big")
    parts = [(frame[6 + 3 * k], frame[7 + 3 * k] >> 4, frame[7 + 3 * k] & 15, frame[8 + 3 * k]) for k in range(frame[5])]
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-w // (8 * wide)), -(-h // (8 * high))
    tables = {scan[1 + 2 * k]: (codes[scan[2 + 2 * k] >> 4], codes[16 | scan[2 + 2 * k] & 15]) for k in range(scan[0])}
    blocks = [[[[0] * 64 for _ in range(across * a)] for _ in range(down * b)] for _, a, b, _ in parts]

    body = re.split(rb"\xff[\xd0-\xd7]", re.split(rb"\xff[^\x00\xd0-\xd7\xff]", body, maxsplit=1)[0])
    per, done = restart or across * down, 0
    for raw in body:
        n = min(per, across * down - done)

        def units(k, done=done):
            y, x = divmod(done + k, across)
            for c, (name, a, b, _) in enumerate(parts):
                yield c, *tables[name], [blocks[c][y * b + j][x * a + i] for j in range(b) for i in range(a)]

        _read_units(raw, units, n, [0] * len(parts))
        done += n
    if done < across * down:
        raise ValueError("a JPEG image ends too early")

    planes = []
    for c, (_, a, b, q) in enumerate(parts):
        scale = np.zeros(64)
        scale[ZIGZAG] = quant[q]
        x = np.array(blocks[c], "f8") * scale
        x = np.einsum("yxuv,ui,vj->yixj", x.reshape(down * b, across * a, 8, 8), _COS, _COS, optimize=True)
        x = np.clip(np.rint(x.reshape(8 * down * b, 8 * across * a) + 128), 0, 255)
        x = x[: -(-h * b // high), : -(-w * a // wide)]
        for axis, times in ((0, high // b), (1, wide // a)):
            x = _twice(x, axis) if times == 2 else np.repeat(x, times, axis)
        planes.append(x[:h, :w])
    out = np.stack(planes, 2)
    if len(parts) == 3:
        if adobe != 0 and [p[0] for p in parts] != [*b"RGB"]:
            y, cb, cr = out[..., 0], out[..., 1] - 128, out[..., 2] - 128
            out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        out = out[..., ::-1]
    elif len(parts) != 1:
        raise ValueError("the JPEG image has an unknown number of components")
    return np.clip(np.rint(out), 0, 255).astype("u1")

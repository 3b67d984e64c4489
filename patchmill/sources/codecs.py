"""Small codecs, so that images and maps need no imaging library: PNG with 8-bit grey or RGB, TIFF with one strip."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGN = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(image: np.ndarray) -> bytes:
    """PNG of (h, w) grey or (h, w, 3) RGB bytes."""
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    rows = image.reshape(h, -1)
    data = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    return _SIGN + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(data)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) bytes of a PNG with 8-bit grey or RGB, not interlaced; others raise ValueError."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2) or head[6]:
        raise ValueError("only plain 8-bit grey or RGB PNG can be read")
    w, h, _, colour = head[:4]
    step = 3 if colour == 2 else 1
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, (w + 1) * step), np.int32)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up, row = out[y], out[y + 1]
        if kind == 0:
            row[step:] = line
        elif kind == 2:
            row[step:] = (line + up[step:]) & 255
        else:
            for i, v in enumerate(line):
                a, b, c = row[i], up[i + step], up[i]
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[i + step] = (v + guess) & 255
    image = out[1:, step:].astype(np.uint8)
    return image.reshape(h, w, 3) if step == 3 else image


_KINDS = {np.dtype(np.uint8): (8, 1), np.dtype(np.uint16): (16, 1), np.dtype(np.float16): (16, 3), np.dtype(np.float32): (32, 3), np.dtype(np.float64): (64, 3)}


def write_tiff(image: np.ndarray) -> bytes:
    """Uncompressed little-endian TIFF of a 2-D array; its type is kept."""
    if image.ndim != 2:
        raise ValueError("only 2-D arrays can be written")
    bits, kind = _KINDS[image.dtype]
    data = image.astype(image.dtype.newbyteorder("<")).tobytes()
    h, w = image.shape
    tags = [(256, 4, w), (257, 4, h), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(data)), (339, 3, kind)]
    at = 8 + len(data) + len(data) % 2
    entries = b"".join(struct.pack("<HHII", tag, type_, 1, value) for tag, type_, value in tags)
    return b"II*\0" + struct.pack("<I", at) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(tags)) + entries + b"\0" * 4


def read_tiff(data: bytes) -> np.ndarray:
    """The first image of an uncompressed TIFF, (h, w) or (h, w, samples); others raise ValueError."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    size = {1: 1, 2: 1, 3: 2, 4: 4}
    tags: dict[int, list[int]] = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, type_, n = struct.unpack(order + "HHI", entry[:8])
        if type_ in size:
            body = entry[8:12] if n * size[type_] <= 4 else data[(p := struct.unpack(order + "I", entry[8:12])[0]) : p + n * size[type_]]
            tags[tag] = list(struct.unpack(order + f"{n}{'BBHI'[type_ - 1]}", body[: n * size[type_]]))
    w, h, samples = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    if tags.get(259, [1])[0] != 1 or samples > 1 and tags.get(284, [1])[0] != 1:
        raise ValueError("only uncompressed TIFF can be read")
    kind = next((d for d, v in _KINDS.items() if v == (tags.get(258, [1])[0], tags.get(339, [1])[0])), None)
    if kind is None:
        raise ValueError("unknown TIFF sample type")
    body = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279]))
    image = np.frombuffer(body, kind.newbyteorder(order)).astype(kind)
    return image.reshape(h, w, samples) if samples > 1 else image.reshape(h, w)

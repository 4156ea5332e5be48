"""PNG, TIFF and MAT (level 5) files to arrays and back; axes x, y, channel."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type (fixed): gray, RGB, palette, gray and alpha, RGBA.
_PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Element types by MAT data type, and classes by element type (fixed).
_MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MAT_CLASSES = {"f8": 6, "f4": 7, "i1": 8, "u1": 9, "i2": 10, "u2": 11, "i4": 12, "u4": 13, "i8": 14, "u8": 15}
#: TIFF sample formats and field sizes (fixed).
_TIFF_FORMATS = {1: "u", 2: "i", 3: "f"}
_TIFF_FIELDS = {1: "B", 3: "H", 4: "I"}


def _axes(rows: np.ndarray) -> np.ndarray:
    """(y, x, c) to (x, y) or (x, y, c)."""
    return rows[:, :, 0].T if rows.shape[2] == 1 else rows.transpose(1, 0, 2)


def _rows(a: np.ndarray) -> np.ndarray:
    """(x, y) or (x, y, c) to (y, x, c)."""
    return a.T[:, :, None] if a.ndim == 2 else a.transpose(1, 0, 2)


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A PNG scan line without its filter; ``step`` bytes are one pixel."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind not in (3, 4):
        raise ValueError("unknown PNG filter")
    raw, up, out = line.tolist(), above.tolist(), [0] * len(line)
    for i, value in enumerate(raw):
        left = out[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            corner = up[i - step] if i >= step else 0
            base = left + up[i] - corner
            guess = min((left, up[i], corner), key=lambda p: abs(p - base))  # of equals the first
        out[i] = value + guess & 255
    return np.array(out, dtype=np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """Gray, RGB, palette (as RGB) and alpha images of 1 to 16 bits, not interlaced;
    samples of under 8 bits are stretched to 0..255."""
    if not data.startswith(_PNG_MAGIC):
        raise ValueError("not a PNG file")
    at, packed, palette, head = len(_PNG_MAGIC), [], None, None
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("damaged PNG file")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        at += 12 + size
    w, h, bits, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced PNG files are not read")
    channels = _PNG_CHANNELS[colour]
    width, step = -(-w * channels * bits // 8), max(1, channels * bits // 8)
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, width + 1)
    plain, above = np.zeros((h, width), np.uint8), np.zeros(width, np.uint8)
    for y in range(h):
        plain[y] = above = _unfilter(int(lines[y, 0]), lines[y, 1:], above, step)
    if bits == 16:
        samples = plain.view(">u2").astype(np.uint16)
    elif bits == 8:
        samples = plain
    else:
        each = np.unpackbits(plain, axis=1).reshape(h, -1, bits)
        samples = (each @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, : w * channels]
        if colour != 3:
            samples = samples * np.uint8(255 // ((1 << bits) - 1))
    if colour == 3:
        return _axes(palette[samples])
    return _axes(samples.reshape(h, w, channels))


def encode_png(a: np.ndarray) -> bytes:
    """8- or 16-bit images of 1 to 4 channels."""
    rows = _rows(a)
    h, w, channels = rows.shape
    bits = 8 if a.dtype == np.uint8 else 16
    flat = np.ascontiguousarray(rows.astype("u1" if bits == 8 else ">u2")).reshape(h, -1).view(np.uint8)
    lines = np.concatenate((np.zeros((h, 1), np.uint8), flat), axis=1)  # filter 0 before each line

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    colour = {1: 0, 3: 2, 2: 4, 4: 6}[channels]
    return _PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode_tiff(data: bytes) -> np.ndarray:
    """The first image of a baseline file: strips, uncompressed or deflated, samples of
    8 to 64 bits, interleaved or in planes."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order:
        raise ValueError("not a TIFF file")
    (start,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, start)
    tags: dict[int, tuple] = {}
    for i in range(n):
        entry = start + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if kind in _TIFF_FIELDS:
            form = f"{order}{count}{_TIFF_FIELDS[kind]}"
            place = entry + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            tags[tag] = struct.unpack_from(form, data, place)
    w, h, bits, channels = tags[256][0], tags[257][0], tags.get(258, (1,))[0], tags.get(277, (1,))[0]
    packing = tags.get(259, (1,))[0]
    if packing not in (1, 8, 32946) or bits % 8 or tags.get(317, (1,))[0] != 1:
        raise ValueError("this kind of TIFF file is not read")
    strips = [data[a : a + size] for a, size in zip(tags[273], tags[279])]
    raw = b"".join(s if packing == 1 else zlib.decompress(s) for s in strips)
    dtype = np.dtype(f"{order}{_TIFF_FORMATS[tags.get(339, (1,))[0]]}{bits // 8}")
    flat = np.frombuffer(raw, dtype, w * h * channels).astype(dtype.newbyteorder("="))
    if tags.get(284, (1,))[0] == 2:
        return _axes(flat.reshape(channels, h, w).transpose(1, 2, 0))
    return _axes(flat.reshape(h, w, channels))


def encode_tiff(a: np.ndarray) -> bytes:
    """A little-endian file of one uncompressed strip."""
    rows = _rows(a)
    h, w, channels = rows.shape
    body = np.ascontiguousarray(rows.astype(a.dtype.newbyteorder("<"))).tobytes()
    code = {v: k for k, v in _TIFF_FORMATS.items()}[a.dtype.kind]
    bits, formats = [8 * a.dtype.itemsize] * channels, [code] * channels
    fields = [(256, "I", [w]), (257, "I", [h]), (258, "H", bits), (259, "H", [1]), (262, "H", [2 if channels >= 3 else 1]), (273, "I", [8]), (277, "H", [channels]), (278, "I", [h]), (279, "I", [len(body)]), (284, "H", [1])]
    extra = channels - (3 if channels >= 3 else 1)
    if extra:
        fields.append((338, "H", [0] * extra))
    fields.append((339, "H", formats))
    body += b"\0" * (len(body) % 2)
    entries, late, at = [], b"", 8 + len(body) + 2 + 12 * len(fields) + 4
    for tag, form, values in fields:
        packed = struct.pack(f"<{len(values)}{form}", *values)
        if len(packed) > 4:
            packed, late = struct.pack("<I", at + len(late)), late + packed
        entries.append(struct.pack("<HHI", tag, {"H": 3, "I": 4}[form], len(values)) + packed.ljust(4, b"\0"))
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(fields)) + b"".join(entries) + b"\0" * 4 + late


def _mat_elements(data: bytes, order: str):
    """(type, body) of each data element, small ones included."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (-size % 8 if kind != 15 else 0)


def decode_mat(data: bytes) -> np.ndarray:
    """The first real numeric array of a level 5 file; its first index is x."""
    order = {b"IM": "<", b"MI": ">"}.get(data[126:128])
    if not order:
        raise ValueError("not a MAT file of level 5")
    for kind, body in _mat_elements(data[128:], order):
        if kind == 15:
            kind, body = next(_mat_elements(zlib.decompress(body), order))
        if kind != 14:
            continue
        parts = list(_mat_elements(body, order))
        flags = struct.unpack_from(order + "I", parts[0][1])[0]
        names = {v: k for k, v in _MAT_CLASSES.items()}
        if flags & 0xFF not in names or flags & 0x800:
            continue
        shape = np.frombuffer(parts[1][1], order + "i4")
        stored, raw = parts[3]
        return np.frombuffer(raw, order + _MAT_TYPES[stored]).astype(names[flags & 0xFF]).reshape(shape, order="F")
    raise ValueError("no numeric array in the MAT file")


def encode_mat(a: np.ndarray, name: str = "image") -> bytes:
    """A little-endian file with one array of at least two dimensions."""
    kind = a.dtype.str[1:]

    def element(code: int, body: bytes) -> bytes:
        return struct.pack("<II", code, len(body)) + body + b"\0" * (-len(body) % 8)

    shape = (*a.shape, 1, 1)[: max(2, a.ndim)]
    stored = {v: k for k, v in _MAT_TYPES.items()}[kind]
    parts = element(6, struct.pack("<II", _MAT_CLASSES[kind], 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name.encode())
    parts += element(stored, a.astype("<" + kind).tobytes(order="F"))
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + element(14, parts)

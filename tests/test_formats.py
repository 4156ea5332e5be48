"""Image and array files: round trips, filters, byte orders, odd headers."""

import struct
import zlib

import numpy as np
import pytest

from tessera.sources import codecs, formats


def some(dtype, shape):
    rng = np.random.default_rng(3)
    return (rng.random(shape) * (200 if np.dtype(dtype).kind != "f" else 1)).astype(dtype)


@pytest.mark.parametrize("shape", [(5, 3), (4, 6, 2), (1, 7, 3), (6, 2, 4)])
@pytest.mark.parametrize("name, dtypes", [("a.png", "u1 u2"), ("a.tiff", "u1 u2 u4 i2 i4 f4 f8"), ("a.mat", "u1 i1 u2 i2 u4 i4 i8 f4 f8")])
def test_round_trip(name, dtypes, shape):
    for dtype in dtypes.split():
        a = some(dtype, shape)
        got = codecs.decode(name, codecs.encode(name, a))
        assert got.dtype == a.dtype and (got == a).all()


def png(w, h, bits, colour, lines, palette=b""):
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_filters():
    """Lines filtered here by the definition of each filter come back."""
    a = some("u1", (6, 5, 3))
    rows, lines = a.transpose(1, 0, 2).reshape(5, -1).astype(int), b""
    for y, kind in enumerate(range(5)):
        line = bytearray([kind])
        for i, v in enumerate(rows[y]):
            left, up = rows[y][i - 3] if i > 2 else 0, rows[y - 1][i] if y else 0
            corner = rows[y - 1][i - 3] if y and i > 2 else 0
            p = left + up - corner
            da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
            paeth = left if da <= db and da <= dc else up if db <= dc else corner
            line.append((v - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
        lines += bytes(line)
    assert (formats.decode_png(png(6, 5, 8, 2, lines)) == a).all()


def test_png_bits_and_palette():
    assert formats.decode_png(png(3, 2, 1, 0, b"\0\xa0\0\x40")).tolist() == [[255, 0], [0, 255], [255, 0]]
    got = formats.decode_png(png(2, 1, 4, 3, b"\0\x10", bytes([1, 2, 3, 7, 8, 9])))
    assert got.tolist() == [[[7, 8, 9]], [[1, 2, 3]]]
    broken = bytearray(png(3, 2, 1, 0, b"\0\xa0\0\x40"))
    broken[20] ^= 1
    with pytest.raises(ValueError):
        formats.decode_png(bytes(broken))


def test_tiff_big_endian_planes():
    planes = np.arange(12, dtype=">u2").reshape(2, 2, 3)  # channel, y, x
    fields = [(256, 3, 1, 3 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 1, 8), (277, 3, 1, 2 << 16), (279, 4, 1, 24), (284, 3, 1, 2 << 16)]
    data = b"MM\0*" + struct.pack(">I", 32) + planes.tobytes() + struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields) + b"\0" * 4
    assert (formats.decode_tiff(data) == planes.transpose(2, 1, 0)).all()


def test_mat_compressed_big_endian_and_small_elements():
    a = some("f8", (3, 2))
    plain = formats.encode_mat(a)
    packed = zlib.compress(plain[128:])
    assert (formats.decode_mat(plain[:128] + struct.pack("<II", 15, len(packed)) + packed) == a).all()
    body = struct.pack(">IIII", 6, 8, 9, 0) + struct.pack(">IIii", 5, 8, 2, 1) + struct.pack(">I4s", 1 << 16 | 1, b"v\0\0\0") + struct.pack(">I4s", 2 << 16 | 2, b"\x05\x06\0\0")
    assert formats.decode_mat(b" " * 124 + b"\1\0MI" + struct.pack(">II", 14, len(body)) + body).tolist() == [[5], [6]]


def test_files_through_spark(spark, tmp_path):
    a = some("u2", (5, 4, 3))
    for name in ("a.png", "b.tif", "c.mat"):
        (tmp_path / name).write_bytes(codecs.encode(name, a))
    got = codecs.load(spark, str(tmp_path / "*")).toPandas()
    assert len(got) == 3 * a.size
    assert (got["v"] == a[got["c0"], got["c1"], got["c2"]]).all()

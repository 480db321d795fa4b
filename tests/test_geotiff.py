"""GeoTIFF pixels against files written here."""

import struct
import zlib

import numpy as np
import pytest

from laneatlas.sources import geotiff


def _packbits(data):
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while at + n < len(data) and data[at + n] == data[at] and n < 128:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[at]])
        else:
            n = min(5, len(data) - at)
            out += bytes([n - 1]) + data[at : at + n]
        at += n
    return bytes(out) + b"\x80"


def _lzw(data):
    codes, table, last, wide = [(256, 9)], {bytes([i]): i for i in range(256)}, b"", 9
    size = 258
    for x in data:
        now = last + bytes([x])
        if now in table:
            last = now
            continue
        codes.append((table[last], wide))
        table[now] = size
        size += 1
        wide = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            codes.append((256, wide))
            table, size, wide = {bytes([i]): i for i in range(256)}, 258, 9
        last = bytes([x])
    if last:
        codes.append((table[last], wide))
        size += 1
        wide = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    codes.append((257, wide))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


PACK = {1: bytes, 5: _lzw, 8: zlib.compress, 32773: _packbits}


def tiff(image, order="<", packing=1, predictor=1, rows=7, tile=None, planar=False, bits=8, place=(0.5, 0.25, -74.0, 41.0)):
    """Bytes of a TIFF of image (high, wide, samples)."""
    high, wide, samples = image.shape
    bh, bw = tile or (rows, wide)
    kind = np.dtype(np.uint8 if bits == 8 else np.uint16)
    parts = []
    for plane in [image[:, :, k : k + 1] for k in range(samples)] if planar else [image]:
        for r in range(0, high, bh):
            for c in range(0, wide, bw):
                own = plane[r : r + bh, c : c + bw].astype(kind)
                if tile:
                    own = np.pad(own, ((0, bh - own.shape[0]), (0, bw - own.shape[1]), (0, 0)))
                if predictor == 2:
                    own = np.diff(own, axis=1, prepend=np.zeros_like(own[:, :1]))
                parts.append(PACK[packing](own.astype(kind.newbyteorder(order)).tobytes()))
    at, offsets = 8, []
    for p in parts:
        offsets.append(at)
        at += len(p)
    tags = {256: ("I", [wide]), 257: ("I", [high]), 258: ("H", [bits] * samples), 259: ("H", [packing]), 277: ("H", [samples]), 284: ("H", [2 if planar else 1]), 317: ("H", [predictor])}
    tags |= {322: ("I", [bw]), 323: ("I", [bh]), 324: ("I", offsets), 325: ("I", [len(p) for p in parts])} if tile else {273: ("I", offsets), 278: ("I", [bh]), 279: ("I", [len(p) for p in parts])}
    if place:
        tags |= {33550: ("d", [place[0], place[1], 0.0]), 33922: ("d", [0.0, 0.0, 0.0, place[2], place[3], 0.0])}
    kinds = {"H": 3, "I": 4, "d": 12}
    entries, far = b"", b""
    end = at + 2 + 12 * len(tags) + 4
    for tag, (k, v) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(v)}{k}", *v)
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", end + len(far))
        far += raw if len(raw) > 4 else b""
        entries += struct.pack(order + "HHI", tag, kinds[k], len(v)) + value
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at) + b"".join(parts) + struct.pack(order + "H", len(tags)) + entries + b"\0" * 4 + far


def _image(high=23, wide=31, samples=3, top=256):
    rng = np.random.default_rng(high * wide)
    return np.repeat(rng.integers(0, top, (high, (wide + 2) // 3, samples)), 3, axis=1)[:, :wide]


@pytest.mark.parametrize("how", [
    {}, {"order": ">"}, {"packing": 32773}, {"packing": 8, "predictor": 2}, {"packing": 5}, {"packing": 5, "predictor": 2, "order": ">"}, {"tile": (16, 16), "packing": 8}, {"planar": True, "packing": 32773},
    {"planar": True, "tile": (16, 16)}, {"bits": 16, "order": ">"}, {"bits": 16, "predictor": 2, "packing": 8},
])
def test_pixels_of_every_layout(spark, tmp_path, how):
    image = _image(top=256 if how.get("bits", 8) == 8 else 65536)
    (tmp_path / "a.tif").write_bytes(tiff(image, **how))
    want = (image if how.get("bits", 8) == 8 else image >> 8).astype(int)
    got = {(r.r, r.c, r.band): r.v for r in geotiff.pixels(geotiff.read_blocks(spark, str(tmp_path / "a.tif"))).collect()}
    assert got == {(r, c, b): int(want[r, c, b]) for r in range(23) for c in range(31) for b in range(3)}


def test_long_lzw_strips():
    data = np.random.default_rng(0).integers(0, 40, 60_000).astype(np.uint8).tobytes()
    assert geotiff.unpacked_lzw(_lzw(data)) == data and geotiff.unpacked_bits(_packbits(data)) == data


def test_windows_reach_the_reader(spark, tmp_path):
    image = _image(40, 33, 1)
    (tmp_path / "a.tif").write_bytes(tiff(image, rows=5))
    some = geotiff.read_blocks(spark, str(tmp_path), window=(12, 18, 4, 9))
    assert sorted((r.r, r.height) for r in some.collect()) == [(12, 3), (15, 4)]  # two of eight strips
    got = {(r.r, r.c): r.v for r in geotiff.pixels(some).collect()}
    assert got == {(r, c): int(image[r, c, 0]) for r in range(12, 19) for c in range(4, 10)}


def test_bands_damage_and_fallback(spark, tmp_path):
    four, two = _image(9, 10, 4), _image(9, 10, 2)
    (tmp_path / "four.tif").write_bytes(tiff(four))
    (tmp_path / "two.TIFF").write_bytes(tiff(two))
    hurt = bytearray(tiff(_image(20, 12, 1), packing=8, rows=5))
    hurt[8:14] = b"damage"
    (tmp_path / "hurt.tif").write_bytes(hurt)
    (tmp_path / "other.tif").write_bytes(b"no picture at all")
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "not.png").write_bytes(b"")
    pixels, bad = geotiff.images_or_fallback(spark, str(tmp_path))
    n = {(r.path.rpartition("/")[2], r.band): r["count"] for r in pixels.groupBy("path", "band").count().collect()}
    assert n == {("four.tif", 0): 90, ("four.tif", 1): 90, ("four.tif", 2): 90, ("two.TIFF", 0): 90, ("hurt.tif", 0): 180}
    assert sorted(r.path.rpartition("/")[2] for r in bad.collect()) == ["empty.tif", "other.tif"]
    found = geotiff.read_blocks(spark, str(tmp_path / "hurt.tif")).orderBy("r").collect()
    assert [r.data is None for r in found] == [True, False, False, False]
    (head,) = geotiff.geotiffs(spark, str(tmp_path)).where("path like '%four.tif'").collect()
    assert (head.width, head.height, head.bands) == (10, 9, 4) and head.max_lat == 41.0 and head.min_lat == 41.0 - 9 * 0.25

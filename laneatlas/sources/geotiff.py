"""GeoTIFF files: bounds and shape of their headers, and their pixels by a data source that reads a strip or tile a row.

`spark.read.format("geotiff")` reads only the bytes of headers and of the strips and tiles that a window meets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from laneatlas.session import ship

#: TIFF tags of width, height, samples a pixel, pixel scale, tie point and transformation.
WIDE, HIGH, SAMPLES, SCALE, TIE, TRANSFORM = 256, 257, 277, 33550, 33922, 34264
_KINDS = {3: "H", 4: "I", 12: "d"}
SCHEMA = "path string, width int, height int, bands int, min_lat double, max_lat double, min_lon double, max_lon double"


def header(data: bytes) -> tuple | None:
    """(width, height, bands, min_lat, max_lat, min_lon, max_lon) of a TIFF file's first directory; bounds are None without a place on earth
    that is upright, everything is None for other bytes."""
    try:
        order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            return None
        tags = {}
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if tag in (WIDE, HIGH, SAMPLES, SCALE, TIE, TRANSFORM) and kind in _KINDS:
                form = f"{order}{n}{_KINDS[kind]}"
                place = at + 10 + 12 * k
                tags[tag] = struct.unpack_from(form, data, place if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, place)[0])
        wide, high = tags[WIDE][0], tags[HIGH][0]
    except (KeyError, struct.error):
        return None
    bands = tags.get(SAMPLES, (1,))[0]
    if SCALE in tags and TIE in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIE][:5]
        west, north = x - i * sx, y + j * sy
    elif TRANSFORM in tags and tags[TRANSFORM][1] == tags[TRANSFORM][4] == 0:
        m = tags[TRANSFORM]
        sx, west, sy, north = m[0], m[3], -m[5], m[7]
    else:
        return (wide, high, bands, None, None, None, None)
    return (wide, high, bands, north - high * sy, north, west, west + wide * sx)


def geotiffs(spark: SparkSession, path: str) -> DataFrame:
    """One row a .tif, .tiff or .geotiff file below a folder, with shape and bounds; all null where the header cannot be read.
    Spark lists no empty files."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *(header(c) or (None,) * 7)) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            yield out.astype({c: "Int64" for c in ("width", "height", "bands")} | {c: float for c in ("min_lat", "max_lat", "min_lon", "max_lon")})

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.where(F.lower("path").rlike(r"\.(tif|tiff|geotiff)$")).select("path", "content").mapInPandas(run, SCHEMA)


def header_first(given: DataFrame, headers: DataFrame) -> DataFrame:
    """given (path and four bounds) with the bounds of the file's header where it has any; each side is null if neither has them."""
    h = headers.select("path", F.when(F.col("min_lat").isNotNull() & ~F.isnan("min_lat"), F.struct("min_lat", "max_lat", "min_lon", "max_lon")).alias("_h"))
    sides = [F.when(F.col("_h").isNotNull(), F.col(f"_h.{c}")).otherwise(F.col(c)).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
    return given.join(h, "path", "left").select("path", *sides)


# --- pixels ----------------------------------------------------------------------------------------------------------------------------------

#: Further TIFF tags.
BITS, PACKING, OFFSETS, ROWS, COUNTS, PLANES, PREDICTOR = 258, 259, 273, 278, 279, 284, 317
TILE_WIDE, TILE_HIGH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
#: Compressions.
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: a count n from 0 to 127 stands before n + 1 bytes as they are, a count from 129 to 255 before one byte that comes 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from 9 to 12 bits, highest bit first, wider one code early; 256 clears the table, 257 ends."""
    out, table, wide, last = [], [], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < wide:
            continue
        bits -= wide
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, wide, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("a code before the table is cleared")
        now = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + now[:1])
        out.append(now)
        last = now
        wide = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


@dataclass
class Block(InputPartition):
    """A strip or tile: where it lies in the file and in the image, of one plane (or of all samples, plane -1), and what of it a window wants."""

    path: str
    at: int
    size: int
    packing: int
    predictor: int
    r: int
    c: int
    high: int
    wide: int
    shown: tuple[int, int, int, int]
    samples: int
    bits: int
    plane: int
    order: str

    def __post_init__(self) -> None:
        super().__init__(self.path)


def decoded(block: Block, data: bytes) -> np.ndarray:
    """high x wide x samples of bytes; 16 bits are cut to the upper eight. ValueError or zlib.error where the bytes are not a block."""
    how = {PLAIN: bytes, LZW: unpacked_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpacked_bits}
    raw = how[block.packing](data)
    n = block.high * block.wide * block.samples
    kind = np.dtype(np.uint8) if block.bits == 8 else np.dtype(np.uint16).newbyteorder(block.order)
    if len(raw) < n * kind.itemsize:
        raise ValueError(f"{len(raw)} bytes for {n} samples")
    image = np.frombuffer(raw, kind, n).reshape(block.high, block.wide, block.samples)
    if block.predictor == 2:
        image = np.cumsum(image, axis=1, dtype=image.dtype.newbyteorder("="))
    return (image if block.bits == 8 else image >> 8).astype(np.uint8)


def directory(read, path: str) -> dict | None:
    """Tags of the first directory by range reads (read: offset, length to bytes); None for other files."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(bytes(head[:2]))
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        return None
    at = struct.unpack(order + "I", head[4:8])[0]
    n = struct.unpack(order + "H", read(at, 2))[0]
    entries, tags = read(at + 2, 12 * n), {"order": order}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * k)
        if kind in _KINDS:
            form = f"{order}{count}{_KINDS[kind]}"
            size = struct.calcsize(form)
            raw = entries[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else read(struct.unpack_from(order + "I", entries, 12 * k + 8)[0], size)
            tags[tag] = struct.unpack(form, raw)
    return tags


def blocks(tags: dict, path: str, window: tuple[int, int, int, int] | None = None) -> list[Block]:
    """Strips or tiles that meet a window (first row, last row, first column, last column; None: all)."""
    wide, high = tags[WIDE][0], tags[HIGH][0]
    samples, bits = tags.get(SAMPLES, (1,))[0], tags.get(BITS, (8,))[0]
    tiled = TILE_OFFSETS in tags
    bh, bw = (tags[TILE_HIGH][0], tags[TILE_WIDE][0]) if tiled else (min(tags.get(ROWS, (high,))[0], high), wide)
    at, sizes = tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS]
    down, across = -(-high // bh), -(-wide // bw)
    planar = tags.get(PLANES, (1,))[0] == 2
    r0, r1, c0, c1 = window or (0, high - 1, 0, wide - 1)
    out = []
    for plane in range(samples if planar else 1):
        for i in range(down):
            for j in range(across):
                r, c = i * bh, j * bw
                shown = (max(r, r0), min(r + bh - 1, r1, high - 1), max(c, c0), min(c + bw - 1, c1, wide - 1))
                if shown[0] <= shown[1] and shown[2] <= shown[3]:
                    k = (plane * down + i) * across + j
                    own = bh if tiled else min(bh, high - r)
                    out.append(Block(path, at[k], sizes[k], tags.get(PACKING, (1,))[0], tags.get(PREDICTOR, (1,))[0], r, c, own, bw, shown, 1 if planar else samples, bits, plane if planar else -1, tags["order"]))
    return out


PIXELS = "path string, r int, c int, height int, width int, bands int, plane int, data binary"


class GeoTiffReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.window = tuple(int(x) for x in options["window"].split(",")) if "window" in options else None

    @staticmethod
    def _file(path: str):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        return store, inner

    def _found(self) -> list[str]:
        from pyarrow import fs

        store, inner = self._file(self.path)
        one = store.get_file_info(inner)
        every = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
        return sorted(f.path for f in every if f.type == fs.FileType.File and f.path.lower().endswith((".tif", ".tiff", ".geotiff")))

    def partitions(self) -> list[InputPartition]:
        """A partition a strip or tile; headers are read here, by their own bytes only. A file that has no readable header gives one row without data."""
        store, _ = self._file(self.path)
        out: list[InputPartition] = []
        for path in self._found():
            try:
                with store.open_input_file(path) as f:
                    tags = directory(lambda at, n: f.read_at(n, at), path)  # noqa: B023
                found = blocks(tags, path, self.window) if tags else None
            except (KeyError, IndexError, struct.error, OSError):
                found = None
            out += [Block(path, 0, 0, 0, 1, 0, 0, 0, 0, (0, -1, 0, -1), 0, 8, -1, "<")] if found is None else found
        return out or [Block("", 0, 0, -1, 1, 0, 0, 0, 0, (0, -1, 0, -1), 0, 8, -1, "<")]

    def read(self, partition: Block) -> Iterator[tuple]:
        b = partition
        if b.packing < 0:
            return
        r0, r1, c0, c1 = b.shown
        data = None
        try:
            if not b.size:
                raise ValueError("no block")
            store, _ = self._file(self.path)
            with store.open_input_file(b.path) as f:
                data = decoded(b, f.read_at(b.size, b.at))[r0 - b.r : r1 - b.r + 1, c0 - b.c : c1 - b.c + 1].tobytes()
        except (KeyError, IndexError, ValueError, TypeError, zlib.error):
            data = None
        yield b.path, r0, c0, r1 - r0 + 1, c1 - c0 + 1, b.samples, b.plane, data


class GeoTiffSource(DataSource):
    """spark.read.format("geotiff").option("window", "first row,last row,first column,last column").load(file or folder): a row a strip or tile: path, r, c, height,
    width, bands, plane (-1: samples side by side), data (bytes, null where the block is damaged; a file without a header has one row of no size)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options)


def read_blocks(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Strips and tiles of a file or folder, as GeoTiffSource gives them."""
    ship(spark)
    spark.dataSource.register(GeoTiffSource)
    read = spark.read.format("geotiff")
    return (read.option("window", ",".join(map(str, window))) if window else read).load(path)


def pixels(found: DataFrame) -> DataFrame:
    """Blocks to rows path, r, c, band (from 0), v: of three bands and more the first three, else the first. Damaged blocks give nothing."""
    ship(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, r, c, high, wide, bands, plane, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                y, x, b = (v.ravel() for v in np.indices((high, wide, bands), np.int32))
                band = b if plane < 0 else np.full(len(b), plane, np.int32)
                v = np.frombuffer(data, np.uint8).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(v), pa.string()), *map(pa.array, (y + np.int32(r), x + np.int32(c), band, v))], names=["path", "r", "c", "band", "v"])

    most = found.groupBy("path").agg(F.greatest(F.max("bands"), F.max("plane") + 1).alias("_n"))  # a row a file
    whole = found.where("data is not null").join(most, "path")
    wanted = (F.col("plane") < F.when(F.col("_n") >= 3, 3).otherwise(1)) | (F.col("plane") < 0)
    out = whole.where(wanted).select("path", "r", "c", "height", "width", "bands", "plane", "data").mapInArrow(run, "path string, r int, c int, band int, v int")
    return out.join(most, "path").where(F.col("band") < F.when(F.col("_n") >= 3, 3).otherwise(1)).drop("_n")


def images_or_fallback(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pixels of the files that read as GeoTIFF, paths of those that do not): the latter are for the plain image reader (sources/files.py)."""
    found = read_blocks(spark, path)
    bad = found.groupBy("path").agg(F.max("height").alias("_h")).where("_h = 0").select("path")
    return pixels(found.where("height > 0")), bad

"""Imagery of an area from request to picture: tiles fetched at one rate over all tasks, written with a commit, put together to a picture.

`df.write.format("imagery")` takes rows zoom, x, y, data. Tasks write below a folder of the run's own; the commit moves their files into place and writes the sidecar last, so
that imagery with a sidecar is whole. A failed write leaves nothing.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from laneatlas.operators.tiles import TILE
from laneatlas.session import ship
from laneatlas.sources import tiles

SCHEMA = "zoom int, x int, y int, data binary"


@dataclass
class Written(WriterCommitMessage):
    """What a task has written (zoom, x, y), and the tiles it had no data for."""

    files: list[tuple[int, int, int]] = field(default_factory=list)
    missing: int = 0


class ImageryWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.sidecar = json.loads(options.get("sidecar", "{}"))
        self.suffix = options.get("suffix", ".png")
        store, folder = self._store()
        store.create_dir(f"{folder}/_{self.run}", recursive=True)  # on the driver alone: a task that is late finds no folder once the write is aborted

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator: Iterator) -> Written:
        store, folder = self._store()
        out = Written()
        for row in iterator:
            if row["data"] is None:
                out.missing += 1
                continue
            with store.open_output_stream(f"{folder}/_{self.run}/{row['zoom']}-{row['x']}-{row['y']}{self.suffix}") as f:
                f.write(bytes(row["data"]))
            out.files.append((row["zoom"], row["x"], row["y"]))
        return out

    def commit(self, messages: list[Written]) -> None:
        from pyarrow import fs

        store, folder = self._store()
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if old.base_name != f"_{self.run}":
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        kept = sorted({f for m in messages if m for f in m.files})
        for zoom in sorted({z for z, _, _ in kept}):
            store.create_dir(f"{folder}/{zoom}", recursive=True)
        for zoom, x, y in kept:
            store.move(f"{folder}/_{self.run}/{zoom}-{x}-{y}{self.suffix}", f"{folder}/{zoom}/{x}-{y}{self.suffix}")
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/_{self.run}.json") as f:
            f.write(json.dumps(self.sidecar | {"fetched": len(kept), "missing": sum(m.missing for m in messages if m)}, indent=2).encode())
        store.move(f"{folder}/_{self.run}.json", f"{folder}/sidecar.json")
        store.delete_dir(f"{folder}/_{self.run}")

    def abort(self, messages: list[Written]) -> None:
        from pyarrow import fs

        store, folder = self._store()
        if store.get_file_info(f"{folder}/_{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/_{self.run}")


class ImagerySink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imagery"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ImageryWriter:
        return ImageryWriter(self.options, overwrite)


def sidecar(extent: dict, attribution: str) -> dict:
    """The document beside a picture, from a row of operators.tiles.stitched_extent()."""
    b = extent["actual"]
    return {
        "bounds": {c: b[c] for c in ("min_lat", "max_lat", "min_lon", "max_lon")}, "zoom": extent["zoom"], "size": {"width": extent["width"], "height": extent["height"]},
        "source": attribution, "tiles": {c: extent[c] for c in ("min_x", "max_x", "min_y", "max_y")},
    }


def download(spark: SparkSession, extent: dict, path: str, server: str | None = "esri_satellite", template: str | None = None, attribution: str | None = None, rate: float = 100.0, slots: int = 4) -> dict:
    """Fetch the tiles of one area (a row of stitched_extent()) and write them to path/zoom/x-y.png with path/sidecar.json; the sidecar. `rate` requests a second over all tasks, of
    which at most `slots` fetch at a time. Tiles that cannot be had are missing from the picture and counted."""
    tiles.register(spark)
    spark.dataSource.register(ImagerySink)
    url, credit = (template, attribution or template) if template else tiles.SERVERS[server][:2]
    read = spark.read.format("tiles").option("template", url).option("rate", rate).option("slots", slots)
    for c in ("zoom", "min_x", "max_x", "min_y", "max_y"):
        read = read.option(c, extent[c])
    made = sidecar(extent, attribution or credit)
    read.load().write.format("imagery").mode("overwrite").option("sidecar", json.dumps(made)).save(path)
    return made


def png(image: np.ndarray) -> bytes:
    """An image (high, wide, 3) of red, green and blue bytes as PNG."""
    high, wide, _ = image.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.concatenate([np.zeros((high, 1), np.uint8), image.astype(np.uint8).reshape(high, wide * 3)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def pictures(spark: SparkSession, path: str, strip: int = 8) -> DataFrame:
    """zoom, strip, y (first tile row), width, height, png: the imagery of download() put together, `strip` tile rows a picture; tiles that are missing are
    black. A group is a strip of tiles, so a row's size follows the area's width, not its height."""
    ship(spark)
    meta = json.loads(spark.read.text(f"{path}/sidecar.json", wholetext=True).first()[0])
    x0, x1, y0, y1 = (meta["tiles"][c] for c in ("min_x", "max_x", "min_y", "max_y"))
    read = spark.read.format("image").option("pathGlobFilter", "*-*.png").option("recursiveFileLookup", True).load(path)
    at = F.split(F.regexp_extract("image.origin", r"(\d+-\d+)\.png$", 1), "-")
    cells = read.where("image.nChannels = 3").select(at[0].cast("int").alias("x"), at[1].cast("int").alias("y"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.data").alias("data"))
    every = spark.range(0, -(-(y1 - y0 + 1) // strip)).select(F.col("id").cast("int").alias("strip"))
    dealt = every.join(cells.withColumn("strip", F.floor((F.col("y") - y0) / strip).cast("int")), "strip", "left")

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["strip"].iloc[0]) * strip + y0
        rows = min(strip, y1 - first + 1)
        image = np.zeros((rows * TILE, (x1 - x0 + 1) * TILE, 3), np.uint8)
        for r in pdf.dropna(subset=["data"]).itertuples():
            own = np.frombuffer(r.data, np.uint8).reshape(int(r.h), int(r.w), 3)[:TILE, :TILE, ::-1]
            top, left = (int(r.y) - first) * TILE, (int(r.x) - x0) * TILE
            image[top : top + own.shape[0], left : left + own.shape[1]] = own
        return pd.DataFrame({"zoom": [meta["zoom"]], "strip": [int(pdf["strip"].iloc[0])], "y": [first], "width": [image.shape[1]], "height": [image.shape[0]], "png": [png(image)]})

    return dealt.groupBy("strip").applyInPandas(stitch, "zoom int, strip int, y int, width int, height int, png binary")

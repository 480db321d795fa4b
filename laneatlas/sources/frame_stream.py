"""Footage as a stream with offsets: spark.readStream.format("frames") over a folder of Parquet files of frames (frames.SCHEMA) that arrive in the order of their names.

An offset is (file, rows of it that are read), and all files of smaller names. The query's checkpoint keeps it, so that a query that is stopped anywhere goes on at
the next frame. Options: rate (every rate-th frame), max_frames (frames before that index), per_batch (rows of a micro-batch at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from laneatlas.session import ship
from laneatlas.sources.frames import SCHEMA

_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Part(InputPartition):
    """Rows first to before end of a file."""

    name: str
    first: int
    end: int

    def __post_init__(self) -> None:
        super().__init__(self.name)


class FrameStreamReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.rate, self.max_frames = int(options.get("rate", 1)), int(options["max_frames"]) if "max_frames" in options else None
        self.per_batch = int(options["per_batch"]) if "per_batch" in options else None
        self.at: dict | None = None
        self.rows: dict[str, int] = {}

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def _files(self) -> list[tuple[str, int]]:
        """(name, rows) by name; a file's footer is read once."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, folder = self._store()
        names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name.endswith(".parquet"))
        for n in names:
            if n not in self.rows:
                with store.open_input_file(f"{folder}/{n}") as f:
                    self.rows[n] = pq.ParquetFile(f).metadata.num_rows
        return [(n, self.rows[n]) for n in names]

    def initialOffset(self) -> dict:  # noqa: N802
        self.at = {"file": "", "rows": 0}
        return self.at

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of what is there, or per_batch rows on from where the last batch ended (once that is known: after a restart, with the first batch)."""
        files = self._files()
        if not files:
            return self.at or {"file": "", "rows": 0}
        end = {"file": files[-1][0], "rows": files[-1][1]}
        if self.per_batch is None or self.at is None:
            return end
        left = self.per_batch
        for name, n in files:
            if name < self.at["file"]:
                continue
            first = self.at["rows"] if name == self.at["file"] else 0
            if n - first >= left:
                return {"file": name, "rows": first + left}
            left -= n - first
        return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A partition for each file that the range touches."""
        self.at = end
        out: list[InputPartition] = []
        for name, n in self._files():
            if start["file"] <= name <= end["file"]:
                a, b = start["rows"] if name == start["file"] else 0, end["rows"] if name == end["file"] else n
                if a < b:
                    out.append(Part(name, a, b))
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        store, folder = self._store()
        at = 0
        with store.open_input_file(f"{folder}/{partition.name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=64, columns=_NAMES):
                a, b = max(partition.first - at, 0), min(partition.end - at, batch.num_rows)
                at += batch.num_rows
                if a < b:
                    some = pa.Table.from_batches([batch.slice(a, b - a)])
                    frame = some.column("frame_idx").to_numpy()
                    keep = frame % self.rate == 0
                    if self.max_frames is not None:
                        keep &= frame < self.max_frames
                    some = some.filter(pa.array(keep)).select(_NAMES)
                    yield from zip(*(c.to_pylist() for c in some.columns), strict=True)
                if at >= partition.end:
                    return

    def commit(self, end: dict) -> None:
        self.at = end


class FrameStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FrameStreamReader:  # noqa: N802
        return FrameStreamReader(self.options)


def stream_footage(spark: SparkSession, path: str, rate: int = 1, max_frames: int | None = None, per_batch: int | None = None) -> DataFrame:
    """Frames of a folder as a stream, with offsets."""
    ship(spark)
    spark.dataSource.register(FrameStream)
    read = spark.readStream.format("frames").option("rate", rate)
    for name, value in (("max_frames", max_frames), ("per_batch", per_batch)):
        read = read if value is None else read.option(name, value)
    return read.load(path)

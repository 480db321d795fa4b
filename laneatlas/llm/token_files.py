"""Writing documents as token-id files and reading them back (the frames of codec.py)."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laneatlas.session import ship, sparing

from .codec import BLOCK, LANES, decode_frame, encode_frame
from .common import in_order
from .tokens import slices, tokenizer

#: Ids of a frame; whole documents, so a longer one is a frame of its own.
FRAME_IDS = BLOCK * LANES


def _store(path: str):
    """(file system, path in it) of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 1, frame_ids: int = FRAME_IDS, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode all texts in ascending doc_id order (null first; null texts empty) and write them as files of one frame each to `path`/files,
    a folder that all executors reach by pyarrow's file systems (file, hdfs, s3, gs).

    Rows with one doc_id are ordered by their texts; further columns are ignored, whatever their names; an empty table gives no file.
    A task's files have names of their own, and `path`/manifest (part, seq, n_docs, n_ids, file), which Spark commits, names those that count: what
    lost or repeated tasks leave behind is never read. part and seq give the order. One shuffle, of the texts into ranges of doc_id.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path, end_id=end_id)
        store, folder = _store(f"{path}/files")
        held, size, seq, part = [], 0, 0, 0

        def made() -> pa.RecordBatch:
            name = f"part-{part:05d}-{seq:05d}-{uuid.uuid4().hex}.lat"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(encode_frame(held))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([name])], names=["part", "seq", "n_docs", "n_ids", "file"])

        for batch in batches:
            ids, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in slices(texts, 2_000_000):
                for k, coded in zip(range(a, b), own.encode(texts[a:b]), strict=True):
                    if held and size + len(coded) // 4 > frame_ids:
                        yield made()
                        held, size, seq = [], 0, seq + 1
                    if not held:
                        part = batch.column(0)[k].as_py()
                    held.append((ids[k], coded))
                    size += len(coded) // 4
        if held:
            yield made()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = in_order(rows, "doc_id", tie="text").select("_part", "doc_id", "text")
    ordered.mapInArrow(sparing(run), "part int, seq int, n_docs long, n_ids long, file string").write.mode("overwrite").parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document in the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32 and, if asked for, ids.

    Every checksum is verified. Starts come from the counts in the manifest, a small row for FRAME_IDS ids.
    """
    ship(spark)
    manifest = spark.read.parquet(f"{path}/manifest")
    before = F.sum("n_ids").over(Window.orderBy("part", "seq")) - F.col("n_ids")
    starts = manifest.select("file", before.alias("first"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not manifest.limit(1).count():
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, cols = batch.column(0)[i].as_py(), ([], [], [], [], [])
                for d, ids in decode_frame(batch.column(1)[i].as_py()):
                    n = len(ids) // 4
                    for c, x in zip(cols, (d, at, n, zlib.crc32(ids), ids), strict=True):
                        c.append(x)
                    at += n
                arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array(cols[4], pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.lat").load(f"{path}/files").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(starts, "file").select("first", "content").mapInArrow(sparing(run), schema)

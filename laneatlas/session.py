"""Making the package importable on executors."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
from collections.abc import Callable
from contextlib import suppress
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Arrow batches stand in the JVM and in each Python worker; texts and images fill Spark's default size.
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of this application, once; they need no installation of it.

    Arrow batches are held to 8 MB, unless the session says otherwise."""
    if spark.conf.get(_BATCH, None) == _DEFAULT:
        spark.conf.set(_BATCH, "8m")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here, tmp = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="laneatlas-")
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)  # executors fetch the archive as long as the application runs
    copy = Path(tmp, "src", here.name)
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(Path(tmp, here.name)), "zip", str(copy.parent)))


def give_back() -> None:
    """Return to the system what the allocators of Arrow and of the C library hold without using it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def sparing(run: Callable) -> Callable:
    """`run`, a function over a task's batches, whose worker gives unused memory back when the task ends.

    Spark keeps idle workers for a minute and takes them in turn, several for each core; what they hold counts as the executor's."""

    @wraps(run)
    def spared(batches):
        yield from run(batches)
        give_back()

    return spared


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only where tests on one machine name none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="laneatlas-")
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder, cut from what made them."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()

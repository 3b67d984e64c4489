"""What all operators share: table access, the shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list = []
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is what spark.checkpoint.dir names. Only a local session, where every task runs on this machine, may go
    without that setting; it then gets a temporary folder, removed when Python ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="patchmill-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def _forget(tables: list | None = None) -> None:
    """Deletes the tables that written() left: through their session while it lives, else those in a folder of this machine."""
    tables = _written if tables is None else tables
    while tables:
        spark, path = tables.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            shutil.rmtree(path.removeprefix("file://"), True)


atexit.register(_forget)


@contextmanager
def released() -> Iterator[None]:
    """Deletes, at its end, the tables that were written within. Their results must have been taken by then."""
    held = len(_written)
    try:
        yield
    finally:
        later = _written[held:]
        del _written[held:]
        _forget(later)


def _place(path: str):
    """(file system, path in it) of a path or URI, so that files lie where the tables lie."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def write_file(path: str, data: bytes) -> None:
    """A whole file, put in place at once, so a task that runs again leaves the same."""
    system, at = _place(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, at)


def read_file(path: str) -> bytes:
    system, at = _place(path)
    with system.open_input_stream(at) as f:
        return f.read()


def is_folder(path: str) -> bool:
    from pyarrow import fs

    system, at = _place(path)
    return system.get_file_info(at).type == fs.FileType.Directory


def bounded_batches(spark: SparkSession, size: str = "32m") -> None:
    """Lets an Arrow batch of long texts or images end at a size as well as at a number of rows, unless the session says so already."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: it is computed once and outlives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/patchmill-{uuid.uuid4().hex}"
    _written.append((spark, path))
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Shared helpers: table access, lineage cuts in the shared folder, null-safe texts."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode (tests), where none is set."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    made = getattr(shared_dir, "_made", None)
    if made is None:
        made = shared_dir._made = tempfile.mkdtemp(prefix="spark-")
    return made


def staged(df: DataFrame, name: str, *, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write `df` as Parquet below the shared folder and read it back; `compression`: a codec, by default the session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyfold/{name}-{uuid.uuid4().hex}"
    for paths in _recording.get():
        paths.append(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


_recording: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("recording", default=())


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that `staged` writes meanwhile, in this thread or task of the driver."""
    paths: list[str] = []
    before = _recording.set((*_recording.get(), paths))
    try:
        yield paths
    finally:
        _recording.reset(before)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that `staged` has written, wherever the shared folder lies."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        folder = hadoop.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a narrow table of ids that may be broadcast, 16 bytes each.
BROADCAST_IDS = 500_000


def ids_side(ids: DataFrame) -> DataFrame:
    """A written table of ids for one side of a join: broadcast while it is small, so that no text moves; shuffled beyond."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


#: Bytes of an Arrow batch on its way to Python, and of texts that a task works on at once.
ARROW_BYTES, SLICE_BYTES = 8 << 20, 4 << 20


def arrow_sized(df: DataFrame) -> DataFrame:
    """`df`, with its session's Arrow batches limited by bytes as well as by rows; a lower limit that the user has set holds."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not (conf.get(key) or "").rstrip("b").isdigit() or int(conf.get(key).rstrip("b")) > ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))
    return df


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices with at most `most` bytes of text, or one row."""
    size = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    at, n = 0, len(texts)
    while at < n:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield at, end - at
        at = end


#: What empties the tables that workers keep between tasks.
_kept_tables: list = []


def keeps_tables(forget) -> None:
    _kept_tables.append(forget)


def forget_tables() -> None:
    """Empty what other operators' tasks have left in this worker."""
    for forget in _kept_tables:
        forget()


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` goes by it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

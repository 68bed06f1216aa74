"""Small things shared by the text operators."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one where that is unset and all runs in one local JVM (tests), else ValueError."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-strideframe-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Where cut() and scratch() note what they make, if someone will remove it.
_MADE: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def tracked() -> Iterator[list]:
    """A list of what cut() and scratch() make meanwhile: tables, and paths; for release() once nothing reads them any more."""
    made: list = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that later stages and lost executors don't recompute it."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def scratch(df: DataFrame) -> DataFrame:
    """As cut(), for tables with texts: as compressed Parquet."""
    path = f"{shared_dir(df.sparkSession)}/scratch-{os.urandom(8).hex()}"
    df.write.parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of the shared folder, whatever kind of store that is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame | str) -> None:
    """Removes the files of tables made by cut(), or at paths, from which nothing more will be read."""
    for df in tables:
        if isinstance(df, str):
            delete(SparkSession.active(), df)
            continue
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


#: Rows of which a table goes to all tasks as a whole.
FEW_ROWS = 10_000


def lookup(rows: DataFrame, table: DataFrame, key: str, share: int = 1000, total: int | None = None) -> DataFrame:
    """rows with the columns of table, which has one row for each key and how many rows have it (n); both cheap to read again, as those made by cut().

    Keys of more than a share-th of all rows (total) are fewer than share: these go to all tasks, so that no task of the shuffle gets one.
    If all rows are at most FEW_ROWS, so are the keys: then all of them go there, which takes a single exchange.
    """
    if total is None:
        total = table.agg(F.sum("n")).first()[0] or 0
    if total <= FEW_ROWS:
        return rows.join(F.broadcast(table), key)
    hot = table.where(F.col("n") * share > total)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects the plans that made them: asks for that, after long chains of cut() tables."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def whole_text(column: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_blocks(texts: list[str], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about limit characters each, so that per-word arrays stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 64
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_runs(column: pa.Array, limit: int = 2 << 20) -> Iterator[list[str]]:
    """The texts of an Arrow column in runs of about limit bytes: only these are Python objects at one time."""
    lengths = np.r_[0, pc.binary_length(column).to_numpy(zero_copy_only=False)].cumsum()
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(lengths, lengths[start] + limit)))
        yield column.slice(start, min(end, len(column)) - start).to_pylist()
        start = end

"""Small helpers that the operators share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a new local one where all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_LARGEST = 2**63 - 1

#: For each scratch() that is open, the tables that go when it ends.
_scratch: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scratch", default=())


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a table written once in the shared folder: cuts lineage and survives the loss of executors.

    Inside scratch() it goes when that ends; if it is to be kept, when the scratch() around that ends, if there is one."""
    spark, level = df.sparkSession, len(_scratch.get()) - 1 - keep
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    if level >= 0:
        _scratch.get()[level].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def removed(df: DataFrame) -> None:
    """Deletes the files of a table that written() has made, once nothing reads it any more."""
    for folder in {os.path.dirname(x) for x in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are written inside are deleted at the end; results must be written with keep=True."""
    token = _scratch.set((*_scratch.get(), []))
    try:
        yield
    finally:
        paths = _scratch.get()[-1]
        _scratch.reset(token)
        for path in paths:
            _delete(spark, path)


def give_back() -> None:
    """Memory that Arrow and the allocator keep for later goes back to the machine: Python workers live on through later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last, unused memory goes back."""
    yield from rows
    give_back()


def lean_group(of_group: Callable[..., pa.Table], *group) -> pa.Table:
    """What of_group makes of a group; what it held meanwhile goes back."""
    made = of_group(*group)
    give_back()
    return made


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most so many bytes, unless the session has a limit of its own: whole texts go through them, and a
    batch is held several times over on its way to a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB"):
        spark.conf.set(key, size)


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def text_volume(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def range_bounds(df: DataFrame, column: str, parts: int, weight: Column | None = None) -> list[int]:
    """At most parts - 1 ascending values that cut a column of integers into parts of about as many rows (or of about as
    much weight, where one is given). Distances from the smallest value are exact in doubles where they matter: they are
    below 2**53 for ids that lie close together, wherever they lie."""
    if parts < 2:
        return []
    least = df.agg(F.min(column)).first()[0]
    if least is None:
        return []
    far = (F.col(column).cast("decimal(20,0)") - F.lit(int(least)).cast("decimal(20,0)")).cast("double")
    fine = parts if weight is None else 4 * parts
    found = df.where(F.col(column).isNotNull()).select(far.alias("x")).approxQuantile("x", [i / fine for i in range(1, fine)], 0.25 / fine)
    bounds = sorted({min(int(least) + int(x), _LARGEST) for x in found})
    if weight is None or len(bounds) < parts:
        return bounds
    heavy = {r["part"]: r["w"] for r in df.groupBy(range_part(F.col(column), bounds).alias("part")).agg(F.sum(weight).alias("w")).collect()}  # a row a part
    share, taken, kept = sum(w or 0 for w in heavy.values()) / parts, 0, []
    for i, bound in enumerate(bounds):
        taken += heavy.get(i) or 0
        if taken + (heavy.get(i + 1) or 0) / 2 >= share:
            kept.append(bound)
            taken = 0
    return kept


def range_part(column: Column, bounds: list[int]) -> Column:
    """The number of bounds that are below the value: which part of range_bounds it lies in.

    Two steps of about sqrt(len(bounds)) comparisons each, so thousands of parts stay cheap."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(np.sqrt(len(bounds))))
    exact = F.lit(bounds).cast("array<bigint>")
    coarse = F.size(F.filter(F.lit(bounds[step - 1 :: step]).cast("array<bigint>"), lambda b: b < column)) * step
    return (coarse + F.size(F.filter(F.slice(exact, coarse + 1, F.lit(step)), lambda b: b < column))).cast("int")

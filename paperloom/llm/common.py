"""Shared plumbing of the training-data operators: tables, shared storage, names of columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: The ASCII white space of the contracts, and the ASCII letters.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: dict[str, list[str]] = {}


#: Spark's own switch that removes a query's shuffle files when the query ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here, sizes are known.

    With ``release`` the shuffle files of this write go once it is done, not when the driver
    happens to collect garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(RELEASE, None)
    if release and before is not None:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if release and before is not None:
            spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``clear_scratch`` knows."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch(spark: SparkSession) -> list[str]:
    """The folders that this application has materialised and not removed."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def clear_scratch(spark: SparkSession, *needed: DataFrame, since: list[str]) -> None:
    """Removes what was materialised after ``since`` was taken from ``scratch``, but for the files that ``needed`` reads.

    For callers that have written a result: a DataFrame that an operator returned reads such
    files until then.
    """
    files = {file for df in needed for file in df.inputFiles()}
    for path in scratch(spark):
        if path in since or any(path.rsplit("/", 1)[-1] in file for file in files):
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _written[spark.sparkContext.applicationId].remove(path)


def in_parts(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in parts of about ``size`` bytes of the string ``column``; a longer value is a part."""
    if not len(batch):
        return iter(())
    column = batch[column]
    at = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    part = np.cumsum(np.diff(at), dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)  # noqa: B905


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before those that ``df`` has already."""
    taken, free = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        free.append(name)
    return free


def own_columns(df: DataFrame, *new: str) -> Column:
    """The columns of ``df`` but those named ``new`` (in any case) as one struct, which no other name can clash with."""
    given_way = {name.lower() for name in new}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in given_way]
    return F.struct(*(kept or [F.lit(None).cast("string").alias("nothing")]))


def unpacked(df: DataFrame, own: str, *rest: Column | str) -> DataFrame:
    """The columns in the struct ``own``, then the others."""
    return df.select(*[F.col(own).getField(c).alias(c) for c in df.schema[own].dataType.names if len(df.schema[own].dataType) > 1 or c != "nothing"], *rest)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  ``lower`` does just that, and faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with ``new`` appended; columns of the same name (in any case) give way."""
    taken = {name.lower() for name in new}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])

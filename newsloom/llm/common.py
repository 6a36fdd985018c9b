"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: What one step inside a task holds of a batch's texts, in bytes.
STEP_BYTES = 4 << 20
#: Rows of an Arrow batch; Spark's own default of 10000 is meant for short rows, and here a row is a text.
BATCH_ROWS = "2000"
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a local master, as in tests, may
    go without; it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/newsloom-shared"


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/newsloom-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors. See discard."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing that is still to run reads them."""
    for table in tables:
        delete(table.sparkSession, table.written_at)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts hold about `most` bytes; a longer row stands alone."""
    array = batch.column(batch.schema.get_field_index(column))
    sizes = pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if len(sizes) > start:
        yield batch.slice(start)


_held: list[tuple[str, object]] = []


def kept_in_worker(key: str, build: Callable[[], object]) -> object:
    """build()'s result, kept by this Python worker until another key is asked for: one large object at a time."""
    if not _held or _held[0][0] != key:
        _held.clear()
        _held.append((key, build()))
    return _held[0][1]


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for texts, unless the session has a value of its own."""
    if spark.conf.get(_BATCH_SETTING, "10000") == "10000":
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)


def map_rows(df: DataFrame, column: str, schema: str | StructType, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """work over bounded slices of df's batches, inside tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, column):
                yield work(part)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)

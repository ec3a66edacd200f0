"""Stored intermediate tables and Arrow batches shared by the operators."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearpath.session import delete_path, work_path

#: Bytes of text that a task turns into Python objects at once.
CHUNK_BYTES = 4_000_000
#: Rows of one Arrow batch; texts may be long.
BATCH_ROWS = 500

_WRITTEN: list[tuple[SparkSession, str]] = []
_BEFORE: list[tuple[SparkSession, str]] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` returned, if nothing reads them any more."""
    if (path := _PATHS.pop(df, None)) and (entry := (df.sparkSession, path)) in _WRITTEN:
        _WRITTEN.remove(entry)
        delete_path(*entry)


def release(tables: list[tuple[SparkSession, str]] = _WRITTEN) -> None:
    """Delete every stored table; results that are computed from them must have been written before."""
    while tables:
        spark, path = tables.pop()
        if (spark, path) in _WRITTEN:
            _WRITTEN.remove((spark, path))
        if spark.sparkContext._jsc is not None:  # else its whole folder goes when the driver ends
            delete_path(spark, path)


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose work tables go when the next stage begins: then its result has been written."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_BEFORE)
        known = set(_WRITTEN)
        out = work(spark, docs, sf_dir)
        _BEFORE.extend(entry for entry in _WRITTEN if entry not in known)
        return out

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS
) -> DataFrame:
    """``mapInArrow`` with slices small enough for long texts; Spark itself sends at most 64 MB at once."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))

    return df.mapInArrow(sliced, schema)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in ``column``; a longer text is a slice of its own."""
    start, size = 0, 0
    for i, value in enumerate(batch.column(column)):
        n = value.as_buffer().size if value.is_valid else 0
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def as_bytes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The two columns an operator on texts reads, under the names ``id`` and ``text``; UTF-8 bytes."""
    return df.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))

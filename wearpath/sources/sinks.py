"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearpath.operators.factors import factor_lines
from wearpath.operators.features import vector_columns


#: Measurements as they are, in large pages: zstd finds values that come again in them, which it does not in indices of a dictionary.
PAGES = {
    "parquet.enable.dictionary": "false",
    "parquet.page.size": str(8 << 20),
    "parquet.page.row.count.limit": "100000",
    "parquet.compression.codec.zstd.level": "9",
}


def write_parquet(df: DataFrame, path: str, fail_if_exists: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Parquet, replacing what is there unless ``fail_if_exists``."""
    df.write.mode("errorifexists" if fail_if_exists else "overwrite").options(**PAGES).parquet(
        path, partitionBy=list(partition_by) or None, compression="zstd"
    )


def flat(df: DataFrame, vector_names: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """A table of plain columns: each vector becomes one column per slot.

    Slots are called ``scaled_<feature>`` where the names of a vector's features are given. A vector
    without names becomes blank-separated text, since its width is not part of its type.
    """
    for field in df.schema:
        if isinstance(field.dataType, VectorUDT):
            names = (vector_names or {}).get(field.name)
            if names:
                df = vector_columns(df, field.name, names)
            else:
                df = df.withColumn(field.name, F.concat_ws(" ", vector_to_array(field.name).cast("array<string>")))
        elif isinstance(field.dataType, T.ArrayType):
            df = df.withColumn(field.name, F.concat_ws(" ", F.col(field.name).cast("array<string>")))
    return df


def write_csv(
    df: DataFrame,
    path: str,
    vector_names: dict[str, Sequence[str]] | None = None,
    fail_if_exists: bool = False,
    compression: str | None = None,
) -> None:
    """CSV in parts, each with a header."""
    flat(df, vector_names).write.mode("errorifexists" if fail_if_exists else "overwrite").csv(path, header=True, compression=compression or "none")


def write_text_table(df: DataFrame, path: str, separator: str = " ", compression: str | None = None) -> None:
    """Headerless separated text."""
    df.write.mode("overwrite").csv(path, sep=separator, header=False, compression=compression or "none")


def write_factors(factors: DataFrame, path: str) -> None:
    """Gzip text of factors, one line per item."""
    factor_lines(factors).write.mode("overwrite").text(path, compression="gzip")


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    table = df.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features"))
    table.write.format("libsvm").mode("overwrite").save(path)

"""Column expressions shared by the operators. All of them are built-in JVM expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_values(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows with a value in each of the columns, as plain IS NOT NULL filters that reach the scan."""
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in columns]))


def null_if_nan(column: Column) -> Column:
    return F.when(F.isnan(column), None).otherwise(column)


def time_axis(df: DataFrame, name: str) -> Column:
    """A monotone BIGINT reading of a time column: integers as they are, times in microseconds.

    A timestamp without zone is read field by field, so that no daylight-saving shift of the
    session zone can reorder rows. Any other type (text, floating point) raises ``TypeError``: its
    own order need not be that of a number.
    """
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{name} must be an integer, decimal, date or timestamp to order rows by, not {kind.simpleString()}")
    column = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        days = F.unix_date(column.cast("date")).cast("long")
        minutes = days * 1440 + F.hour(column) * 60 + F.minute(column)
        seconds = F.date_part(F.lit("SECOND"), column)  # decimal, with six digits after the point
        return minutes * 60_000_000 + (seconds * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    return column.cast("long")


def hash_fraction(*keys: str | Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key values and the seed alone.

    It stays the same whatever the partitioning and however often a lost task is run again,
    which ``rand()`` and ``DataFrame.sample`` do not promise.
    """
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def joined_decimals(values: Column, separator: str = " ") -> Column:
    """Array of numbers as text with six decimals each."""
    return F.concat_ws(separator, F.transform(values, lambda v: F.format_string("%.6f", v.cast("double"))))


def fields_of(line: Column, separator: str, types: list[str]) -> list[Column]:
    """Split a text line and cast each part; a part that does not fit its type gives NULL."""
    parts = F.split(line, separator)
    return [F.get(parts, F.lit(i)).try_cast(kind) for i, kind in enumerate(types)]

"""Feature vectors, scaling, label indices and class weights."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearpath.functions.names import renumbered
from wearpath.functions.scalar import with_values
from wearpath.operators.sizing import broadcast_if_small
from wearpath.spec import TURBOFAN, TelemetrySpec

#: Columns that never enter the feature vector.
NOT_FEATURES = ("id", "dataset", "maxcycle", "maxcykle", "rul", "label1", "label2")


def feature_columns(df: DataFrame, exclude: Iterable[str] = NOT_FEATURES) -> list[str]:
    """Every column that is not excluded, in table order."""
    excluded = set(exclude)
    return [c for c in df.columns if c not in excluded]


def one_hot(df: DataFrame, column: str, values: Sequence[int]) -> DataFrame:
    """Replace a category by one 0/1 column per value: ``operationmode_0``, ``operationmode_1``, ..."""
    flags = [(F.col(column) == v).cast("int").alias(f"{column}_{v}") for v in values]
    return df.select(*[c for c in df.columns if c != column], *flags)


def frame_features(spec: TelemetrySpec = TURBOFAN, mean_prefix="mean_s", dev_prefix="stdv_s") -> list[str]:
    """Cycle, all settings but the last, and each sensor with its mean and deviation."""
    trios = zip(spec.sensors, renumbered(spec.sensors, mean_prefix), renumbered(spec.sensors, dev_prefix))
    return [spec.time, *spec.settings[:-1], *[c for trio in trios for c in trio]]


def reject_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have a value in each of the columns."""
    return with_values(df, columns)


def count_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows read, rows kept, rows rejected for a NULL in one of the columns."""
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(complete).alias("rows_kept"),
        F.count_if(~complete).alias("rows_rejected"),
    )


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features", handle_invalid: str = "error"):
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid=handle_invalid).transform(df)


def fit_scaler(
    df: DataFrame, columns: Sequence[str], output: str = "scaledFeatures", handle_invalid: str = "error"
) -> PipelineModel:
    """Assemble and min-max scale to [0, 1]; a constant feature becomes 0.5.

    The fitted stages can be saved and applied to another table with the same scale.
    """
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid=handle_invalid)
    scaler = MinMaxScaler(inputCol="features", outputCol=output)
    return Pipeline(stages=[assembler, scaler]).fit(_range_rows(df, columns))


def _range_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two rows, the smallest and the largest value of each column, which give the same scale as the table.

    The table itself if a value is missing, which is for the assembler to judge, or a column is no plain number.
    """
    plain = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    if not columns or not plain.issuperset(columns):
        return df
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    missing = reduce(or_, [F.col(c).isNull() for c in columns])
    lows, highs = ([f(c) for c in columns] for f in (F.min, F.max))
    found = numbers.agg(F.array(*lows).alias("low"), F.array(*highs).alias("high"), F.count_if(missing).alias("missing")).first()
    # a NaN is larger than all numbers
    if found.missing or any(v is None or math.isnan(v) for v in found.high):
        return df
    return df.sparkSession.createDataFrame([found.low, found.high], numbers.schema).coalesce(1)


def apply_scaler(df: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(df).drop("features", "maxcycle")


def scaler_columns(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def vector_columns(df: DataFrame, vector: str, names: Sequence[str], prefix: str = "scaled_") -> DataFrame:
    """Replace a vector column by one DOUBLE column per slot."""
    rest = [c for c in df.columns if c != vector]
    slots = F.col("_slots")
    return df.withColumn("_slots", vector_to_array(vector)).select(
        *rest, *[slots[i].alias(f"{prefix}{name}") for i, name in enumerate(names)]
    )


def value_ranges(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value of each column, ``<column>_min`` and ``<column>_max``, in one pass."""
    stats = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*by).agg(*stats) if by else df.agg(*stats)


def minmax_columns(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Column-wise twin of the scaler: keeps names, keeps NULL, constant column -> 0.5.

    Without ``by`` the ranges are one row, read as a scalar subquery. With ``by`` (say the data
    set) each group has its own ranges, broadcast when their number was measured to be small.
    """
    ranges = value_ranges(df, columns, by)

    def scaled(c, low, high):
        spread = high - low
        return F.when(F.col(c).isNull(), None).when(spread == 0, 0.5).otherwise((F.col(c) - low) / spread).alias(c)

    # One struct column for all bounds: a subquery named once is planned once.
    row = F.struct(*[c for c in ranges.columns if c not in by]).alias("_range")
    if by:
        ranged = df.join(broadcast_if_small(ranges.select(*by, row)), list(by))
    else:
        ranged = df.withColumn("_range", ranges.select(row).scalar())
    bounds = {c: (F.col(f"_range.{c}_min"), F.col(f"_range.{c}_max")) for c in columns}
    return ranged.select(*[scaled(c, *bounds[c]) if c in bounds else F.col(c) for c in df.columns])


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def label_index(df: DataFrame, label: str) -> DataFrame:
    """Index of each label by falling frequency, ties in label order; one row per label."""
    order = Window.orderBy(F.desc("n"), F.col(label).cast("string"))
    return label_counts(with_values(df, [label]), label).withColumn(
        "label_index", (F.row_number().over(order) - 1).cast("double")
    )


def label_indexer(label: str, output: str = "indexedLabel", order: str = "frequencyDesc") -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType=order)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """One row per class with weight = rows / (classes * rows of the class)."""
    counts = label_counts(with_values(df, [label]), label)
    all_classes = Window.partitionBy()
    total, classes = F.sum("n").over(all_classes), F.count(F.lit(1)).over(all_classes)
    return counts.withColumn("weight", total / (classes * F.col("n")))


def with_class_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """Add the class weight to each row. There is one weight per class, so their table is broadcast
    when it was measured to be small."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(output))
    return df.join(broadcast_if_small(weights), label)

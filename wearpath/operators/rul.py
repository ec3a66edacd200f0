"""Remaining useful life and alarm labels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearpath.functions.scalar import with_values
from wearpath.operators.sequence import (
    ROWS_PER_TASK,
    LongUnits,
    UnitStep,
    last_time_step,
    lookup_step,
    row_step,
    run_per_unit,
)
from wearpath.spec import TURBOFAN, TelemetrySpec

#: Label thresholds in cycles, bounds included.
WARN_CYCLES = 30
ALARM_CYCLES = 15


def with_last_cycle(
    df: DataFrame,
    spec: TelemetrySpec = TURBOFAN,
    name: str = "maxcycle",
    long_units: LongUnits | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add the last cycle of each unit; rows without a unit key are dropped, as a join would."""
    steps = [last_time_step(spec.unit, spec.time, name)]
    return run_per_unit(with_values(df, spec.unit), spec.unit, spec.time, steps, long_units, rows_per_task)


def last_cycle_per_unit(df: DataFrame, spec: TelemetrySpec = TURBOFAN, name: str = "maxcycle") -> DataFrame:
    return df.groupBy(*spec.unit).agg(F.max(spec.time).alias(name))


def rul_steps(
    spec: TelemetrySpec = TURBOFAN, truth: DataFrame | None = None, truth_column: str = "RUL_at_maxcycle"
) -> list[UnitStep]:
    """Steps that add ``rul``: last cycle - cycle, plus the life left after it where truth is given."""
    last = last_time_step(spec.unit, spec.time, "_last")
    if truth is None:
        return [last, row_step(lambda df: df.withColumn("rul", F.col("_last") - F.col(spec.time)).drop("_last"))]
    rul = F.col(truth_column) + F.col("_last") - F.col(spec.time)
    return [
        last,
        lookup_step(truth.select(*spec.unit, truth_column), spec.unit),
        row_step(lambda df: df.withColumn("rul", rul).drop("_last", truth_column)),
    ]


def rul_from_run_to_failure(
    df: DataFrame,
    spec: TelemetrySpec = TURBOFAN,
    long_units: LongUnits | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``rul`` = last cycle of the unit - cycle, so the last row has 0."""
    df = with_values(df, spec.unit)
    return run_per_unit(df, spec.unit, spec.time, rul_steps(spec), long_units, rows_per_task)


def rul_from_truth(
    df: DataFrame,
    truth: DataFrame,
    spec: TelemetrySpec = TURBOFAN,
    truth_column: str = "RUL_at_maxcycle",
    long_units: LongUnits | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``rul`` of truncated series: life left after the last cycle + cycles until then.

    Units without truth are dropped.
    """
    df = with_values(df, spec.unit)
    steps = rul_steps(spec, truth, truth_column)
    return run_per_unit(df, spec.unit, spec.time, steps, long_units, rows_per_task)


def add_labels(
    df: DataFrame, rul: str = "rul", warn: int = WARN_CYCLES, alarm: int = ALARM_CYCLES
) -> DataFrame:
    """``label1``: 1 within ``warn`` cycles of failure. ``label2``: also 2 within ``alarm``.

    An unknown life (NULL) gives 0 in both.
    """
    life = F.col(rul)
    return df.withColumns(
        {
            "label1": F.when(life <= warn, 1).otherwise(0),
            "label2": F.when(life <= alarm, 2).when(life <= warn, 1).otherwise(0),
        }
    )


def merge_labels(df: DataFrame, columns: tuple[str, ...] = ("label", "prediction"), old=2, new=1) -> DataFrame:
    """Fold one class into another in each of the columns."""
    kinds = dict(df.dtypes)
    return df.withColumns(
        {c: F.when(F.col(c) == old, F.lit(new).cast(kinds[c])).otherwise(F.col(c)) for c in columns}
    )


def _observed(share: float, last: Column) -> Column:
    """Whole cycles in a share of a life. The share is taken as written: 0.7 of 90 is 63, not 62.99."""
    return F.floor(F.lit(Decimal(str(share))) * last).cast("int")


def truncate_steps(share: float, spec: TelemetrySpec = TURBOFAN) -> list[UnitStep]:
    kept = F.col(spec.time) <= _observed(share, F.col("_last"))
    return [last_time_step(spec.unit, spec.time, "_last"), row_step(lambda df: df.where(kept).drop("_last"))]


def truncate_units(
    df: DataFrame,
    share: float,
    spec: TelemetrySpec = TURBOFAN,
    long_units: LongUnits | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Keep the first ``floor(share * last cycle)`` cycles of each unit, as a test set would."""
    df = with_values(df, spec.unit)
    return run_per_unit(df, spec.unit, spec.time, truncate_steps(share, spec), long_units, rows_per_task)


def truth_of_truncation(df: DataFrame, share: float, spec: TelemetrySpec = TURBOFAN) -> DataFrame:
    """The truth table that goes with ``truncate_units``."""
    last = last_cycle_per_unit(with_values(df, spec.unit), spec, "_last")
    left = F.col("_last") - _observed(share, F.col("_last"))
    return last.select(*spec.unit, left.cast("int").alias("RUL_at_maxcycle"))

"""Rolling mean and deviation of sensors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearpath.functions.names import renumbered
from wearpath.functions.scalar import time_axis, with_values
from wearpath.operators.sequence import (
    ROWS_PER_TASK,
    LongUnits,
    UnitStep,
    find_long_units,
    number_in_slices,
    run_per_unit,
    window_in_slices,
    window_step,
)
from wearpath.spec import TURBOFAN, TelemetrySpec

#: Rows in the rolling frame, and the fixed divisor of the literal deviation.
FRAME = 5

_MODES = ("literal", "population", "full")


def _statistics(
    sensors: Sequence[str],
    means: Sequence[str],
    devs: Sequence[str],
    start: int,
    stop: int,
    mode: str,
    divisor: int,
) -> Callable[[DataFrame, WindowSpec], DataFrame]:
    """Builds ``compute(df, window)``, which adds the mean and deviation columns."""
    if mode not in _MODES:
        raise ValueError(f"mode must be one of {_MODES}, not {mode!r}")

    def compute(df: DataFrame, window: WindowSpec) -> DataFrame:
        frame = window.rowsBetween(start, stop)
        mean = {m: F.avg(s).over(frame) for s, m in zip(sensors, means)}
        if mode == "literal":
            # Each squared term uses the rolling mean of its own row, and the divisor is fixed.
            gap = {s: F.col(s) - F.col(m) for s, m in zip(sensors, means)}
            dev = {d: F.sqrt(F.sum(gap[s] * gap[s]).over(frame) / divisor) for s, d in zip(sensors, devs)}
            return df.withColumns(mean).withColumns(dev)
        dev = {d: F.stddev_pop(s).over(frame) for s, d in zip(sensors, devs)}
        if mode == "population":
            return df.withColumns({**mean, **dev})
        complete = F.count(F.lit(1)).over(frame) == stop - start + 1
        return df.withColumns({name: F.when(complete, value) for name, value in {**mean, **dev}.items()})

    return compute


def _reach(start: int, stop: int, mode: str) -> tuple[int, int]:
    """Rows needed before and after a row; the literal deviation looks through two frames."""
    depth = 2 if mode == "literal" else 1
    return depth * max(-start, 0), depth * max(stop, 0)


def rolling_step(
    spec: TelemetrySpec = TURBOFAN,
    start: int = 1 - FRAME,
    stop: int = 0,
    mode: str = "literal",
    divisor: int = FRAME,
    mean_prefix: str = "a",
    dev_prefix: str = "sd",
    dense: bool = False,
) -> UnitStep:
    """``rolling_by_unit`` as a step of a longer computation per unit.

    ``dense`` says that cycles are known to run 1, 2, 3, ... in each unit.
    """
    sensors = list(spec.sensors)
    compute = _statistics(
        sensors, renumbered(sensors, mean_prefix), renumbered(sensors, dev_prefix), start, stop, mode, divisor
    )
    return window_step(spec.unit, spec.time, *_reach(start, stop, mode), compute, dense)


def rolling_by_unit(
    df: DataFrame,
    spec: TelemetrySpec = TURBOFAN,
    start: int = 1 - FRAME,
    stop: int = 0,
    mode: str = "literal",
    divisor: int = FRAME,
    mean_prefix: str = "a",
    dev_prefix: str = "sd",
    long_units: LongUnits | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rolling statistics per unit in cycle order, over rows ``start..stop`` around each row.

    ``mode``
        ``literal``: deviation = sqrt(sum((s - own row's mean)^2) / divisor), short frames included;
        ``population``: population deviation of the frame;
        ``full``: mean and population deviation, NULL until the frame is complete.

    Rows without a unit are dropped: they belong to none.
    """
    df = with_values(df, spec.unit)
    step = rolling_step(spec, start, stop, mode, divisor, mean_prefix, dev_prefix)
    return run_per_unit(df, spec.unit, spec.time, [step], long_units, rows_per_task)


def rolling_by_mode(
    df: DataFrame,
    spec: TelemetrySpec = TURBOFAN,
    group: Sequence[str] = ("operationmode",),
    start: int = 0,
    stop: int = FRAME,
    mode: str = "literal",
    divisor: int = FRAME,
    mean_prefix: str = "a",
    dev_prefix: str = "sd",
    rows_per_task: int = ROWS_PER_TASK,
    units_per_block: int = 4096,
) -> DataFrame:
    """Rolling statistics per operation mode, in (unit, cycle) order across unit boundaries.

    There are only a handful of modes, so at scale each holds far more rows than a task can take.
    Such modes are numbered through cells of (block of units, unit, part of the cycle axis), where
    unique cycles bound a cell, and windowed in slices of that number. Small modes use one plain
    window. The last unit column must be an integer, else ``TypeError`` is raised at every size. Rows
    without a unit, cycle or mode are dropped, as attaching the mode by join on these keys does.
    """
    if not isinstance(df.schema[spec.unit[-1]].dataType, T.IntegralType):
        raise TypeError(f"{spec.unit[-1]} must be an integer, as units follow each other in its order")
    axis = time_axis(df, spec.time)
    df = with_values(df, [*spec.key, *group])
    sensors = list(spec.sensors)
    compute = _statistics(
        sensors, renumbered(sensors, mean_prefix), renumbered(sensors, dev_prefix), start, stop, mode, divisor
    )
    number = spec.unit[-1]
    units = find_long_units(df, group, number, rows_per_task)
    ordinary, long_rows = units.split(df)
    order = [*spec.unit, spec.time]
    result = compute(ordinary, Window.partitionBy(*group).orderBy(*order))
    if long_rows is None:
        return result
    cut = long_rows.drop("_n", "_lo", "_hi", "_cuts").withColumns(
        {
            "_block": F.floor(F.col(number) / units_per_block),
            "_part": F.floor(axis / rows_per_task),
        }
    )
    path = [*spec.unit[:-1], "_block", number, "_part"]
    placed = number_in_slices(cut, group, path, [spec.time], "_place").drop("_block", "_part")
    behind, ahead = _reach(start, stop, mode)
    sliced = window_in_slices(placed, group, "_place", behind, ahead, rows_per_task, compute)
    return result.unionByName(sliced.select(*result.columns))


def fill_undefined(
    df: DataFrame, spec: TelemetrySpec = TURBOFAN, mean_prefix: str = "mean_s", dev_prefix: str = "stdv_s"
) -> DataFrame:
    """Where the frame was not complete: mean -> the raw value, deviation -> 0."""
    filled = {}
    for sensor, mean, dev in zip(
        spec.sensors, renumbered(spec.sensors, mean_prefix), renumbered(spec.sensors, dev_prefix)
    ):
        filled[mean] = F.coalesce(F.col(mean), F.col(sensor))
        filled[dev] = F.coalesce(F.col(dev), F.lit(0.0))
    return df.withColumns(filled)


def standardise(
    df: DataFrame,
    spec: TelemetrySpec = TURBOFAN,
    mode: str = "literal",
    mean_prefix: str = "a",
    dev_prefix: str = "sd",
    prefix: str = "std",
) -> DataFrame:
    """Standardised sensors from their rolling columns.

    ``literal`` is s - a/sd, with a/1e-8 where sd is zero or unknown. ``zscore`` is (s - a)/sd,
    NULL where sd is zero.
    """
    if mode not in ("literal", "zscore"):
        raise ValueError(f"mode must be 'literal' or 'zscore', not {mode!r}")
    out = {}
    for sensor, mean, dev, name in zip(
        spec.sensors,
        renumbered(spec.sensors, mean_prefix),
        renumbered(spec.sensors, dev_prefix),
        renumbered(spec.sensors, prefix),
    ):
        s, a, sd = F.col(sensor), F.col(mean), F.col(dev)
        if mode == "literal":
            out[name] = s - F.coalesce(F.try_divide(a, sd), a / F.lit(1e-8))
        else:
            out[name] = F.try_divide(s - a, sd)
    return df.withColumns(out)

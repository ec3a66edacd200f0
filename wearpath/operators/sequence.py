"""Ordered rows per unit without gathering a long unit in one task.

A window partitioned by unit is the cheapest plan while every unit fits a task: one shuffle,
shared by all windows with that partitioning. A unit that holds a large share of the table
would put that share in one task, and adaptive execution does not split windows. So the units
that are too long are measured once (``find_long_units``), and only their rows take another
way: they are cut into slices of the time axis, get an exact dense row number from slice
counts (``number_in_slices``), and are windowed slice by slice with the few neighbouring rows
the frame needs copied along (``window_in_slices``). The result is the same row for row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wearpath.functions.scalar import time_axis, with_values
from wearpath.operators.sizing import SMALL_ROWS, broadcast_if_small, kept_if_small

#: Rows of one unit that a single task may sort and window.
ROWS_PER_TASK = 500_000

#: Parts of the time axis per ``ROWS_PER_TASK`` rows of a long unit. Rows may lie unevenly in time;
#: with small parts even a busy stretch stays a small group, and a part costs one counted row.
PARTS_PER_TASK = 16
#: Quantiles of a long unit's times. Each stretch between two of them is cut into parts of its own, so
#: a few rows with a wrong clock stretch one of them and not all.
STRETCHES = 256


@dataclass(frozen=True)
class LongUnits:
    """Units with more rows than one task should take, with their extent on the time axis.

    ``table`` (keys, ``_n``, ``_lo``, ``_hi``, ``_cuts``) is ``None`` when there are none. The extent
    and the quantiles ``_cuts`` only steer how a unit is cut: stale ones cost balance, never a result.
    """

    keys: tuple[str, ...]
    table: DataFrame | None
    small: bool
    rows_per_task: int

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows of ordinary units, and rows of long units with ``_n``, ``_lo``, ``_hi``."""
        if self.table is None:
            return df, None
        keys = list(self.keys)
        table = self.hint(self.table)
        ordinary = df.join(self.hint(self.table.select(*keys)), keys, "left_anti")
        return ordinary, df.join(table, keys)

    def hint(self, per_unit: DataFrame) -> DataFrame:
        """Broadcast a table with at most one row per long unit, if their number was small."""
        return F.broadcast(per_unit) if self.small else per_unit

    def renamed(self, keys: Sequence[str]) -> LongUnits:
        """The same units after their key columns were renamed and their rows numbered 1..n."""
        table = self.table
        if table is not None:
            for old, new in zip(self.keys, keys):
                table = table.withColumnRenamed(old, new)
            table = table.drop("_cuts").withColumns({"_lo": F.lit(1).cast("long"), "_hi": F.col("_n")})
        return replace(self, keys=tuple(keys), table=table)


def find_long_units(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    rows_per_task: int = ROWS_PER_TASK,
    broadcast_limit: int = SMALL_ROWS,
) -> LongUnits:
    """Measure which units exceed ``rows_per_task``: one aggregation over the key columns.

    It is combined on the map side, so a hot unit is no burden, and at most one unit in
    ``rows_per_task`` rows can be reported.
    """
    axis = time_axis(df, time)
    profile = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
        .where(F.col("_n") > rows_per_task)
    )
    table, count = kept_if_small(profile, broadcast_limit)
    if count != 0:
        shares = [i / STRETCHES for i in range(1, STRETCHES)]
        units = F.broadcast(table) if count is not None else table
        quantiles = (
            df.join(units.select(*keys), list(keys), "left_semi")
            .groupBy(*keys)
            .agg(F.array_distinct(F.percentile_approx(axis, shares, 20 * STRETCHES)).alias("_cuts"))
        )
        table, count = kept_if_small(table.join(quantiles, list(keys), "left"), broadcast_limit)
    return LongUnits(tuple(keys), None if count == 0 else table, count is not None, rows_per_task)


def time_part(df: DataFrame, time: str, rows_per_task: int) -> Column:
    """Part of the unit's own time extent that a long unit's row lies in.

    The stretches between the quantiles ``_cuts``, or the whole extent where there are none, are
    cut into equal parts. A row without a time sorts first, so it goes to a part before all others.
    """
    axis, low, high, stretch = time_axis(df, time), F.col("_lo"), F.col("_hi"), F.lit(0)
    parts = F.ceil(F.col("_n") / F.lit(rows_per_task)) * PARTS_PER_TASK
    if "_cuts" in df.columns:
        cuts = F.coalesce("_cuts", F.array().cast("array<bigint>"))
        stretch = F.size(F.filter(cuts, lambda c: c <= axis))
        low = F.coalesce(F.get(cuts, stretch - 1), low)
        high = F.coalesce(F.get(cuts, stretch), high)
        parts = F.ceil(parts / STRETCHES)
    offset = (axis - low).cast("double")
    share = F.greatest(F.lit(0.0), F.least(offset / (high.cast("double") - low + 1), F.lit(1.0)))
    part = (stretch * (parts + 1) + F.floor(share * parts)).cast("long")
    return F.when(F.col(time).isNull(), F.lit(-(2**62)).cast("long")).otherwise(part)


def number_in_slices(
    df: DataFrame, partition: Sequence[str], path: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """Dense row number 1..n per ``partition``, ordered by ``path`` and then ``order``.

    Each path column must be a non-decreasing function of the order in which rows are to be
    numbered. Only the rows of one (partition, path) cell are sorted together; the cells are
    linked through running totals of their counts, one path level at a time.
    """
    cell = [*partition, *path]
    before = _rows_before(df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_cell")), partition, path)
    within = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    return (
        df.join(before.select(*cell, "_before"), cell)
        .withColumn(name, F.col("_before") + within)
        .drop("_before")
    )


def _rows_before(cells: DataFrame, partition: Sequence[str], path: Sequence[str]) -> DataFrame:
    outer, last = [*partition, *path[:-1]], path[-1]
    earlier = Window.partitionBy(*outer).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum("_cell").over(earlier), F.lit(0))
    if len(path) == 1:
        return cells.withColumn("_before", here)
    groups = cells.groupBy(*outer).agg(F.sum("_cell").alias("_cell"))
    above = _rows_before(groups, partition, path[:-1]).select(*outer, F.col("_before").alias("_above"))
    return (
        cells.withColumn("_here", here)
        .join(above, outer)
        .withColumn("_before", F.col("_here") + F.col("_above"))
        .drop("_here", "_above")
    )


def window_in_slices(
    df: DataFrame,
    partition: Sequence[str],
    position: str,
    behind: int,
    ahead: int,
    rows_per_task: int,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
) -> DataFrame:
    """Apply a windowed computation to slices of ``rows_per_task`` positions.

    ``position`` must be dense (1..n per partition). A row is copied to each slice that holds a
    row whose frame reaches it: up to ``behind`` rows back and ``ahead`` rows forward. The copies
    are dropped again, so every input row appears once.
    """
    place = F.col(position) - 1

    def slice_of(row: Column) -> Column:
        return F.floor(row / F.lit(rows_per_task)).cast("long")

    first = F.greatest(slice_of(place - ahead), F.lit(0).cast("long"))
    copies = df.withColumn("_slice", F.explode(F.sequence(first, slice_of(place + behind))))
    window = Window.partitionBy(*partition, "_slice").orderBy(position)
    return compute(copies, window).where(F.col("_slice") == slice_of(place)).drop("_slice")


@dataclass(frozen=True)
class UnitStep:
    """One computation per unit, in the form for ordinary units and the form for long ones.

    The long form finds ``_n``, ``_lo`` and ``_hi`` in its rows and keeps them.
    """

    ordinary: Callable[[DataFrame], DataFrame]
    long: Callable[[DataFrame, LongUnits], DataFrame]


def row_step(function: Callable[[DataFrame], DataFrame]) -> UnitStep:
    """A step that looks at single rows, so it is the same for all units."""
    return UnitStep(function, lambda df, units: function(df))


def run_per_unit(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    steps: Sequence[UnitStep],
    long_units: LongUnits | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Run steps one after the other. The table is split once, and only if there are long units."""
    units = long_units or find_long_units(df, keys, time, rows_per_task)
    ordinary, long_rows = units.split(df)
    for step in steps:
        ordinary = step.ordinary(ordinary)
    if long_rows is None:
        return ordinary
    for step in steps:
        long_rows = step.long(long_rows, units)
    return ordinary.unionByName(long_rows.select(*ordinary.columns))


def number_step(keys: Sequence[str], order: Sequence[str], name: str) -> UnitStep:
    """Number the rows of each unit 1..n. The first ``order`` column is the time axis."""

    def ordinary(df):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    def long(df, units):
        cut = df.withColumn("_part", time_part(df, order[0], units.rows_per_task))
        placed = number_in_slices(cut, keys, ["_part"], order, name).drop("_part")
        return placed.withColumn(name, F.col(name).cast("int"))

    return UnitStep(ordinary, long)


def window_step(
    keys: Sequence[str],
    time: str,
    behind: int,
    ahead: int,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    dense: bool = False,
) -> UnitStep:
    """Row-frame windows in time order, reaching ``behind`` rows back and ``ahead`` forward.

    ``dense`` says that the time column is known to count the rows of each unit 1..n, so that long
    units need no numbering of their own.
    """

    def ordinary(df):
        return compute(df, Window.partitionBy(*keys).orderBy(time))

    def long(df, units):
        place = time
        if not dense:
            place = "_place"
            cut = df.withColumn("_part", time_part(df, time, units.rows_per_task))
            df = number_in_slices(cut, keys, ["_part"], [time], place).drop("_part")
        return window_in_slices(df, keys, place, behind, ahead, units.rows_per_task, compute).drop("_place")

    return UnitStep(ordinary, long)


def last_time_step(keys: Sequence[str], time: str, name: str) -> UnitStep:
    """Add the last time of each unit.

    Ordinary units use a window, whose shuffle later windows share; long units an aggregate, which
    is combined on the map side and has one row per long unit when joined back.
    """

    def ordinary(df):
        # Ordered although the maximum needs no order: rolling windows then find their rows sorted.
        whole = Window.partitionBy(*keys).orderBy(time)
        whole = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumn(name, F.max(time).over(whole))

    def long(df, units):
        last = df.groupBy(*keys).agg(F.max(time).alias(name))
        return df.join(units.hint(last), list(keys))

    return UnitStep(ordinary, long)


def lookup_step(table: DataFrame, keys: Sequence[str]) -> UnitStep:
    """Inner join with a table of one row per unit.

    For ordinary units the join carries no hint: a table under the session's broadcast threshold is
    broadcast by its known size, a larger one is merged in the partitioning the windows use. Long
    units need only their own few rows of the table, which are measured.
    """
    keys = list(keys)

    def ordinary(df):
        return df.join(table, keys)

    def long(df, units):
        own = table.join(units.hint(units.table.select(*keys)), keys, "left_semi")
        return df.join(broadcast_if_small(own), keys)

    return UnitStep(ordinary, long)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    long_units: LongUnits | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Number the rows of each unit 1..n. The first ``order`` column is the time axis.

    Rows without a unit are dropped: they belong to none.
    """
    df = with_values(df, keys)
    return run_per_unit(df, keys, order[0], [number_step(keys, order, name)], long_units, rows_per_task)

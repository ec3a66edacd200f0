"""Samples and splits, decided by a hash of the key or of the whole row.

A hashed decision does not change with the partitioning or when a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearpath.functions.scalar import hash_fraction
from wearpath.spec import TURBOFAN, TelemetrySpec


def row_fraction(seed: int) -> Column:
    """A number in [0, 1) hashed from all columns of a row; equal rows have the same. Maps cannot be hashed."""
    steps = 1 << 32
    return F.pmod(F.xxhash64(F.lit(seed), F.struct("*")), F.lit(steps)) / F.lit(float(steps))


def sample_about(df: DataFrame, rows: int, keys: Sequence[str] | None = None, seed: int = 123456) -> DataFrame:
    """About ``rows`` rows; all rows if there are fewer.

    The choice is hashed from ``keys``, or from the whole row without them.
    """
    count = df.agg(F.count(F.lit(1))).scalar()
    place = row_fraction(seed) if keys is None else hash_fraction(*keys, seed=seed)
    return df.where(place < F.lit(float(rows)) / count)


def pick_units(df: DataFrame, count: int, spec: TelemetrySpec = TURBOFAN, seed: int = 123456) -> DataFrame:
    """All rows of ``count`` units picked at random.

    The picked units are at most ``count`` rows by construction, so they are broadcast.
    """
    keys = list(spec.unit)
    units = df.select(*keys).distinct()
    picked = units.orderBy(hash_fraction(*keys, seed=seed), *keys).limit(count)
    return df.join(F.broadcast(picked) if count <= 100_000 else picked, keys, "left_semi")


def random_rows(df: DataFrame, weights: Sequence[float], seed: int = 11) -> list[DataFrame]:
    """Row-level split by the hash of the row. Neighbouring cycles of a unit land on both sides, equal rows on one."""
    return _parts(df, weights, row_fraction(seed))


def split_by_hash(
    df: DataFrame, weights: Sequence[float], by: Sequence[str], seed: int = 11
) -> list[DataFrame]:
    """Disjoint parts by the hash of ``by``: with the unit key, a unit stays in one part."""
    return _parts(df, weights, hash_fraction(*by, seed=seed))


def _parts(df: DataFrame, weights: Sequence[float], place: Column) -> list[DataFrame]:
    total = float(sum(weights))
    bounds = [0.0, *[w / total for w in accumulate(weights)]]
    bounds[-1] = 2.0
    return [df.where((place >= low) & (place < high)) for low, high in zip(bounds, bounds[1:])]

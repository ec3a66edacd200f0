"""Exploratory statistics. Each reads its columns once, and nothing but sums leaves a task."""

from __future__ import annotations

import random
from collections.abc import Sequence
from math import ceil, exp, factorial, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearpath.functions.scalar import null_if_nan


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, mean, sample deviation, min, max; all columns in one pass."""
    stats = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in stats.items()])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{c}_{n}").cast("long" if n == "count" else "double").alias(n) for n in stats],
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, both ways round, as (x, y, r).

    A pair is taken over the rows where both are known; a constant column has no correlation (NULL).
    All pairs are matrix products of Arrow batches, added up in each task, so a task sends one row
    of sums per pair. Hundreds of pairwise aggregates in one plan would not compile to one loop.
    """
    columns = list(columns)
    means = df.agg(F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in columns])).scalar()
    centred = [(F.col(c).cast("double") - F.col("_means")[i]).alias(f"c{i}") for i, c in enumerate(columns)]

    def products(batches):
        total = np.zeros((5, len(columns), len(columns)))
        for batch in batches:
            x = np.column_stack([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            total += [m.T @ m, x.T @ m, x.T @ x, (x * x).T @ m, m.T @ (x * x)]
        i, j = np.indices(total.shape[1:]).reshape(2, -1)
        n, sx, sxy, sxx, syy = total.reshape(5, -1)
        sy = total[1].T.reshape(-1)
        names = ["i", "j", "n", "sx", "sy", "sxy", "sxx", "syy"]
        arrays = [i.astype("int32"), j.astype("int32"), n, sx, sy, sxy, sxx, syy]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

    sums = ("n", "sx", "sy", "sxy", "sxx", "syy")
    schema = "i INT, j INT, " + ", ".join(f"{c} DOUBLE" for c in sums)
    rows = df.select(*columns).withColumn("_means", means).select(*centred)
    totals = [F.sum(c).alias(c) for c in sums]
    per_pair = rows.mapInArrow(products, schema).groupBy("i", "j").agg(*totals)
    n, sx, sy, sxy, sxx, syy = (F.col(c) for c in sums)
    spread_x, spread_y = sxx - F.try_divide(sx * sx, n), syy - F.try_divide(sy * sy, n)
    r = F.try_divide(sxy - F.try_divide(sx * sy, n), F.sqrt(spread_x) * F.sqrt(spread_y))
    names = F.array(*[F.lit(c) for c in columns])
    return per_pair.select(names[F.col("i")].alias("x"), names[F.col("j")].alias("y"), null_if_nan(r).alias("r"))


def _extent(df: DataFrame, column: str) -> tuple[Column, Column]:
    row = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("e")).scalar()
    return row["lo"], row["hi"]


#: Most bins that are chosen from the data.
MOST_BINS = 10_000
#: Rank error of the quantile sketches, as a share of the rows.
RANK_ERROR = 1e-4


def spread_of(df: DataFrame, column: str, accuracy: float = RANK_ERROR) -> tuple[int, float, float, float | None, float | None, float | None]:
    """Known rows, smallest, largest, first and third quartile, and sample deviation of a column.

    The quartiles come from a mergeable sketch, each task's being combined with the others':
    their ranks are off by at most ``accuracy`` of the rows.
    """
    quartiles = F.percentile_approx(column, [0.25, 0.75], int(1 / accuracy))
    row = df.agg(F.count(column), F.min(column), F.max(column), quartiles, F.stddev_samp(column)).first()
    first, third = row[3] or (None, None)
    return row[0], row[1], row[2], first, third, row[4]


def bins_of(df: DataFrame, column: str, accuracy: float = RANK_ERROR) -> int:
    """The number of equal bins between smallest and largest value whose width is at most twice the interquartile
    range over the cube root of the rows (Freedman and Diaconis); without such a range, by the logarithm of the rows (Sturges)."""
    n, low, high, first, third, _ = spread_of(df, column, accuracy)
    if not n or high == low:
        return 1
    if third == first:
        return 1 + ceil(log2(n))
    return max(1, min(MOST_BINS, ceil((high - low) / (2 * (third - first) / n ** (1 / 3)))))


def histogram(df: DataFrame, column: str, bins: int | None = 20) -> DataFrame:
    """Rows per equal-width bin between the smallest and the largest value, empty bins included.

    Columns: ``bin`` (0-based), ``lo``, ``hi``, ``n``. The last bin includes the largest value.
    ``bins=None`` chooses their number by ``bins_of``.
    """
    bins = bins_of(df, column) if bins is None else bins
    lo, hi = _extent(df, column)
    place = F.floor(F.try_divide(F.col(column) - lo, hi - lo) * bins)
    counts = (
        df.where(F.col(column).isNotNull())
        .select(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (hi - lo) / bins
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("lo"),
        (lo + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def _kernel(point: Column, column: str, bandwidth: float) -> Column:
    z = (point - F.col(column)) / bandwidth
    return F.exp(-0.5 * z * z)


#: Cells of the fine grid in one bandwidth, and bandwidths beyond which a kernel counts as nothing.
CELLS, REACH = 32, 8.0


def bandwidth_of(df: DataFrame, column: str, accuracy: float = RANK_ERROR) -> float:
    """0.9 times the smaller of the deviation and the interquartile range over 1.34, over the fifth root of the rows (Silverman)."""
    n, low, high, first, third, deviation = spread_of(df, column, accuracy)
    if not n or not deviation:
        return 1.0
    widths = [deviation, *([(third - first) / 1.34] if third > first else [])]
    return 0.9 * min(widths) / n**0.2


def _weights(df: DataFrame, column: str, cell: float) -> DataFrame:
    """(cell, w): each row's weight shared between the two neighbouring points of the fine grid, by closeness."""
    at = F.col(column) / cell
    low = F.floor(at)
    share = at - low
    both = F.array(F.struct(low.alias("cell"), (1 - share).alias("w")), F.struct((low + 1).alias("cell"), share.alias("w")))
    return df.where(F.col(column).isNotNull()).select(F.inline(both)).groupBy("cell").agg(F.sum("w").alias("w"))


def density(df: DataFrame, column: str, grid: Sequence[float], bandwidth: float | None = None, cells: int = CELLS) -> DataFrame:
    """Gaussian kernel density of a column at the grid points, as (x, density).

    Rows are first shared out to a fine grid of ``cells`` points a bandwidth, in one
    aggregation; only its cells meet the grid points within ``REACH`` bandwidths, so the
    cost for each row does not depend on the number of points. The result differs from the
    exact sum over all rows by at most 1 / (8 cells^2) of the kernel's peak (0.00013 of it
    with 32 cells). Without ``bandwidth`` it is ``bandwidth_of`` the column.
    """
    width = bandwidth_of(df, column) if bandwidth is None else bandwidth
    cell = width / cells
    weights = _weights(df, column, cell)
    reach = int(REACH * cells)
    # a point meets cells of its own neighbourhood only: both sides carry the block of cells it lies in
    points = df.sparkSession.createDataFrame([(float(g),) for g in grid], "x DOUBLE").withColumn("at", F.floor(F.col("x") / cell))
    blocks = F.sequence(F.floor((F.col("at") - reach) / reach), F.floor((F.col("at") + reach) / reach))
    near = points.select("x", F.explode(blocks).alias("block"))
    own = weights.withColumn("block", F.floor(F.col("cell") / reach))
    z = (F.col("x") - F.col("cell") * F.lit(cell)) / width
    sums = near.join(own, "block").groupBy("x").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("s"))
    total = weights.agg(F.round(F.sum("w"))).scalar()
    return points.select("x").join(sums, "x", "left").select(
        "x", F.try_divide(F.coalesce("s", F.lit(0.0)), total * F.lit(width * sqrt(2 * pi))).alias("density")
    )


def density2d(
    df: DataFrame,
    x: str,
    y: str,
    grid_x: Sequence[float],
    grid_y: Sequence[float],
    bandwidth_x: float,
    bandwidth_y: float,
) -> DataFrame:
    """Product-kernel density of two columns on a grid, as (x, y, density).

    Each row meets the x points inside its own task and the y points are sums, so a task sends
    one row of sums per x point.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    along_x = F.array(*[F.struct(F.lit(float(g)).alias("g"), _kernel(F.lit(float(g)), x, bandwidth_x).alias("k")) for g in grid_x])
    sums = [F.sum(F.col("p.k") * _kernel(F.lit(float(g)), y, bandwidth_y)).alias(f"g{i}") for i, g in enumerate(grid_y)]
    wide = (
        known.select(y, F.explode(along_x).alias("p"))
        .groupBy(F.col("p.g").alias("gx"))
        .agg(F.count(F.lit(1)).alias("_n"), *sums)
    )
    scale = F.col("_n") * F.lit(bandwidth_x * bandwidth_y * 2 * pi)
    points = [
        F.struct(F.col("gx").alias("x"), F.lit(float(g)).alias("y"), (F.col(f"g{i}") / scale).alias("density"))
        for i, g in enumerate(grid_y)
    ]
    return wide.select(F.inline(F.array(*points)))


def linear_trend(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line y = intercept + slope * x, one row."""
    return df.agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))


def _moments(x: Column, y: Column, weight: Column | None = None) -> dict[str, Column]:
    """The power sums a parabola is fitted from, each in one aggregation; rows may count ``weight`` times."""
    w = F.lit(1.0) if weight is None else weight
    powers = {"n": w, "s1": w * x, "s2": w * x * x, "s3": w * x * x * x, "s4": w * x * x * x * x}
    return {k: F.sum(v) for k, v in {**powers, "t0": w * y, "t1": w * x * y, "t2": w * x * x * y}.items()}


def _parabola(sums: dict[str, Column], shift: Column) -> list[Column]:
    """c0, c1, c2 from power sums around ``shift``, solved in closed form around the mean; NULL if the system has no one solution."""
    n = sums["n"]
    m = F.try_divide(sums["s1"], n)
    s1, s2, s3, s4, t0, t1, t2 = (sums[k] for k in ("s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    # the same sums around the mean m
    u2 = s2 - m * s1
    u3 = s3 - 3 * m * s2 + 2 * m * m * s1
    u4 = s4 - 4 * m * s3 + 6 * m * m * s2 - 3 * m * m * m * s1
    v1 = t1 - m * t0
    v2 = t2 - 2 * m * t1 + m * m * t0
    curve, bend = u4 - F.try_divide(u2 * u2, n), v2 - F.try_divide(u2 * t0, n)
    det = u2 * curve - u3 * u3
    det = F.when(F.abs(det) > 1e-12 * F.abs(u2 * u4), det)
    a, b = F.try_divide(u2 * bend - u3 * v1, det), F.try_divide(curve * v1 - u3 * bend, det)
    c, at = F.try_divide(t0 - a * u2, n), m + shift
    return [c - b * at + a * at * at, b - 2 * a * at, a]


def quadratic_trend(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares parabola y = c0 + c1 x + c2 x^2, one row; NULL with fewer than three distinct x.

    One pass: the sums are taken around some value of x, which keeps them accurate, and moved to the mean afterwards.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    some = known.limit(1).select("_x").scalar()
    sums = known.select((F.col("_x") - some).alias("_d"), "_y").agg(*[s.alias(k) for k, s in _moments(F.col("_d"), F.col("_y")).items()])
    fitted = _parabola({k: F.col(k) for k in sums.columns}, some)
    return sums.select(*[c.alias(f"c{i}") for i, c in enumerate(fitted)])


#: Replicates of the bootstrap, and the largest number of times that a row is drawn in one.
REPLICATES, MOST_DRAWS = 200, 8


#: Places of the draws are multiples of one over this prime.
MODULUS = (1 << 31) - 1


def multipliers(replicates: int, seed: int) -> tuple[list[int], list[int]]:
    """Two factors for each replicate (0 is the table itself), by which a row's hash becomes its place there."""
    rng = random.Random(seed)
    return tuple([rng.randrange(1, MODULUS) for _ in range(replicates + 1)] for _ in range(2))


def poisson_share(k: int) -> float:
    """Probability of at most ``k`` draws at mean 1."""
    return exp(-1.0) * sum(1 / factorial(i) for i in range(k + 1))


def _draws(place: Column) -> Column:
    """How often a row is in a replicate: Poisson of mean 1 at ``place`` in [0, 1)."""
    more = [F.when(place >= poisson_share(k), 1.0).otherwise(0.0) for k in range(MOST_DRAWS)]
    return sum(more[1:], more[0])


def trend_band(
    df: DataFrame, y: str, x: str, keys: Sequence[str], grid: Sequence[float], order: int = 2, replicates: int = REPLICATES, level: float = 0.95, seed: int = 7
) -> DataFrame:
    """The fitted line (``order`` 1) or parabola (2) at the grid points with a bootstrap band: (x, fit, low, high).

    Each of the ``replicates`` draws every row a Poisson number of times that follows from a hash of
    its ``keys`` and the replicate, so the band does not depend on partitions or retries. Their
    power sums are one aggregation: a task sends one row a replicate. ``low`` and ``high``
    are the quantiles of the replicates' curves, interpolated between them.
    """
    digest = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
        *[F.conv(F.substring(digest, 1 + 7 * i, 7), 16, 10).cast("bigint").alias(f"_h{i}") for i in (0, 1)],
    )
    middle = (min(grid) + max(grid)) / 2
    drawn = known.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    own = [F.array(*[F.lit(v).cast("bigint") for v in values])[F.col("replicate")] for values in multipliers(replicates, seed)]
    place = F.pmod(F.col("_h0") * own[0] + F.col("_h1") * own[1], F.lit(MODULUS)) / float(MODULUS)
    weight = F.when(F.col("replicate") == 0, 1.0).otherwise(_draws(F.col("_place")))
    drawn = drawn.withColumn("_place", place).select("replicate", (F.col("_x") - middle).alias("_d"), "_y", weight.alias("_w"))
    sums = drawn.where("_w > 0").groupBy("replicate").agg(*[s.alias(k) for k, s in _moments(F.col("_d"), F.col("_y"), F.col("_w")).items()])
    own = {k: F.col(k) for k in sums.columns[1:]}
    if order == 2:
        c0, c1, c2 = _parabola(own, F.lit(middle))
    else:
        m = F.try_divide(own["s1"], own["n"])
        c1 = F.try_divide(own["t1"] - m * own["t0"], own["s2"] - m * own["s1"])
        c0, c2 = F.try_divide(own["t0"], own["n"]) - c1 * (m + middle), F.lit(0.0)
    curves = sums.select("replicate", c0.alias("c0"), c1.alias("c1"), c2.alias("c2"))
    points = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("x")
    values = curves.select("replicate", points, "c0", "c1", "c2").withColumn("v", F.col("c0") + F.col("c1") * F.col("x") + F.col("c2") * F.col("x") * F.col("x"))
    drawn_only = F.when(F.col("replicate") > 0, F.col("v"))
    return values.groupBy("x").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("v"))).alias("fit"),
        F.percentile(drawn_only, (1 - level) / 2).alias("low"),
        F.percentile(drawn_only, (1 + level) / 2).alias("high"),
    )


def with_residual(df: DataFrame, y: str, x: str, name: str = "residual") -> DataFrame:
    """Distance of each row from the least-squares line, which is one row read as a scalar subquery."""
    fit = df.agg(
        F.struct(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b")).alias("fit")
    ).scalar()
    return df.withColumn(name, F.col(y) - fit["a"] - fit["b"] * F.col(x))


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First n rows in a total order. Each task keeps its own n rows, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)

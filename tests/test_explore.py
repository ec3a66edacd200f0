import numpy as np
import pytest
from pyspark.sql import functions as F

from wearpath.operators import explore, sampling
from wearpath.spec import TelemetrySpec


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(50, 9, 400)
    y = 3 + 2 * x + 0.1 * x * x + rng.normal(0, 1, 400)
    z = np.where(rng.random(400) < 0.2, np.nan, x - y)
    rows = [(i, float(a), float(b), None if np.isnan(c) else float(c), 1.5) for i, (a, b, c) in enumerate(zip(x, y, z))]
    return x, y, z, spark.createDataFrame(rows, "id INT, x DOUBLE, y DOUBLE, z DOUBLE, flat DOUBLE").cache()


def test_describe(data):
    x, _, z, df = data
    rows = {r.column: r for r in explore.describe(df, ["x", "z", "flat"]).collect()}
    assert rows["x"]["mean"] == pytest.approx(x.mean()) and rows["x"]["stddev"] == pytest.approx(x.std(ddof=1))
    assert rows["z"]["count"] == np.isfinite(z).sum() and rows["flat"]["stddev"] == 0


def test_correlations_use_the_rows_known_to_both(data):
    x, y, z, df = data
    found = {(r.x, r.y): r.r for r in explore.correlations(df, ["x", "y", "z", "flat"]).collect()}
    assert len(found) == 16
    assert found["x", "y"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    known = np.isfinite(z)
    assert found["z", "x"] == pytest.approx(np.corrcoef(z[known], x[known])[0, 1])
    assert found["x", "z"] == pytest.approx(found["z", "x"])
    assert found["x", "x"] == pytest.approx(1) and found["flat", "x"] is None


def test_histogram(data):
    x, _, _, df = data
    rows = explore.histogram(df, "x", 12).orderBy("bin").collect()
    counts, edges = np.histogram(x, 12)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.lo for r in rows] == pytest.approx(edges[:-1].tolist())


def test_histogram_of_a_constant(data):
    rows = explore.histogram(data[3], "flat", 4).orderBy("bin").collect()
    assert [r.n for r in rows] == [400, 0, 0, 0]


def test_density(data):
    x, y, _, df = data
    grid = [30.0, 50.0, 70.0]
    rows = explore.density(df, "x", grid, 4.0).orderBy("x").collect()
    expected = [np.exp(-0.5 * ((g - x) / 4) ** 2).sum() / (400 * 4 * np.sqrt(2 * np.pi)) for g in grid]
    peak = 1 / (4 * np.sqrt(2 * np.pi))
    assert [r.density for r in rows] == pytest.approx(expected, abs=peak / (8 * explore.CELLS**2))
    fine = explore.density(df, "x", grid, 4.0, cells=2000).orderBy("x").collect()
    assert [r.density for r in fine] == pytest.approx(expected, abs=peak / (8 * 2000**2))
    cells = {(r.x, r.y): r.density for r in explore.density2d(df, "x", "y", grid, [300.0, 400.0], 4.0, 50.0).collect()}
    k = np.exp(-0.5 * ((50 - x) / 4) ** 2) * np.exp(-0.5 * ((400 - y) / 50) ** 2)
    assert len(cells) == 6 and cells[50.0, 400.0] == pytest.approx(k.sum() / (400 * 4 * 50 * 2 * np.pi))


def test_density_far_from_the_data_and_of_nothing(data):
    df = data[3]
    rows = explore.density(df, "x", [-1000.0, 50.0, 1e6], 4.0).orderBy("x").collect()
    assert rows[0].density == 0 and rows[1].density > 0 and rows[2].density == 0
    assert [r.density for r in explore.density(df.where("false"), "x", [1.0], 4.0).collect()] == [None]


def test_bandwidth_and_bins_follow_the_data(spark, data):
    x, _, _, df = data
    first, third = np.quantile(x, [0.25, 0.75], method="inverted_cdf")
    assert explore.bandwidth_of(df, "x") == pytest.approx(0.9 * min(x.std(ddof=1), (third - first) / 1.34) / 400**0.2)
    assert explore.bins_of(df, "x") == int(np.ceil((x.max() - x.min()) / (2 * (third - first) / 400 ** (1 / 3))))
    assert explore.bins_of(df, "flat") == 1 and explore.bins_of(df.where("false"), "x") == 1
    assert explore.histogram(df, "x", None).agg({"n": "sum"}).first()[0] == 400
    rows = spark.range(200_000).selectExpr("CAST((id * 7919) % 200003 AS DOUBLE) AS v").repartition(6)
    _, _, _, first, third, _ = explore.spread_of(rows, "v", accuracy=1e-3)
    ranks = [rows.where(F.col("v") <= q).count() / 200_000 for q in (first, third)]
    assert ranks == pytest.approx([0.25, 0.75], abs=1e-3)
    skewed = spark.range(100).selectExpr("CASE WHEN id < 90 THEN 1.0D ELSE double(id) END AS v")
    assert explore.bins_of(skewed, "v") == 8


def test_trend_band_does_not_follow_the_partitioning(data):
    x, y, _, df = data
    grid = [30.0, 50.0, 70.0]
    band = {r.x: r for r in explore.trend_band(df, "y", "x", ["id"], grid, replicates=300).collect()}
    again = {r.x: r for r in explore.trend_band(df.repartition(7), "y", "x", ["id"], grid, replicates=300).collect()}
    curve = np.polynomial.Polynomial.fit(x, y, 2)
    design = np.vander(x - 50, 3)
    spread = np.linalg.inv(design.T @ design) * ((y - curve(x)) ** 2).sum() / (len(x) - 3)
    for g in grid:
        assert band[g].fit == pytest.approx(curve(g)) and band[g].low < band[g].fit < band[g].high
        assert (band[g].low, band[g].high) == (pytest.approx(again[g].low), pytest.approx(again[g].high))
        at = np.array([(g - 50) ** 2, g - 50, 1])
        assert band[g].high - band[g].low == pytest.approx(2 * 1.96 * np.sqrt(at @ spread @ at), rel=0.35)
    line = explore.trend_band(df, "y", "x", ["id"], grid, order=1, replicates=20).orderBy("x").collect()
    assert [r.fit for r in line] == pytest.approx(np.polyval(np.polyfit(x, y, 1), grid).tolist())


def test_draws_are_poisson():
    assert explore.poisson_share(0) == pytest.approx(0.3678794) and explore.poisson_share(20) == pytest.approx(1)


def test_trends_and_residuals(data):
    x, y, _, df = data
    slope, intercept = np.polyfit(x, y, 1)
    line = explore.linear_trend(df, "y", "x").first()
    assert (line.slope, line.intercept) == (pytest.approx(slope), pytest.approx(intercept))
    c2, c1, c0 = np.polyfit(x, y, 2)
    curve = explore.quadratic_trend(df, "y", "x").first()
    assert (curve.c0, curve.c1, curve.c2) == (pytest.approx(c0), pytest.approx(c1), pytest.approx(c2))
    rest = explore.with_residual(df, "y", "x").orderBy("id").collect()
    assert [r.residual for r in rest] == pytest.approx((y - slope * x - intercept).tolist())


def test_trends_of_a_constant_are_undefined(data):
    assert explore.quadratic_trend(data[3], "y", "flat").first().c2 is None
    assert explore.linear_trend(data[3], "y", "flat").first().slope is None


def test_sample_takes_everything_from_a_small_table(data):
    df = data[3]
    assert sampling.sample_about(df, 1000, ["id"]).count() == 400
    assert sampling.sample_about(df, 1000).count() == 400
    assert 50 < sampling.sample_about(df, 100, ["id"]).count() < 160
    assert 50 < sampling.sample_about(df, 100).count() < 160


def test_picks_and_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(3000).selectExpr("CAST(id % 60 AS INT) AS id", "CAST(id AS INT) AS cycle")
    spec = TelemetrySpec(settings=(), sensors=())
    picked = {r.id for r in sampling.pick_units(df, 20, spec).select("id").distinct().collect()}
    again = {r.id for r in sampling.pick_units(df.repartition(7), 20, spec).select("id").distinct().collect()}
    assert len(picked) == 20 and picked == again
    a, b = sampling.split_by_hash(df, [0.8, 0.2], ["id"])
    left, right = {r.id for r in a.collect()}, {r.id for r in b.collect()}
    assert not left & right and a.count() + b.count() == 3000
    parts = sampling.split_by_hash(df, [3, 1, 1], ["id", "cycle"])
    sizes = [p.count() for p in parts]
    assert sum(sizes) == 3000 and 1650 < sizes[0] < 1950
    assert sum(p.count() for p in sampling.random_rows(df, [0.6, 0.4])) == 3000


def test_random_rows_do_not_follow_the_partitioning(spark):
    df = spark.range(2000).selectExpr("id", "string(id % 7) AS t", "array(double(id)) AS a")
    parts = sampling.random_rows(df, [0.6, 0.4])
    other = sampling.random_rows(df.repartition(13, "t"), [0.6, 0.4])
    ids = lambda part: {r.id for r in part.collect()}
    assert [ids(p) for p in parts] == [ids(p) for p in other]
    assert not ids(parts[0]) & ids(parts[1]) and 1100 < len(ids(parts[0])) < 1300

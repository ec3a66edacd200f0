import pytest
from pyspark.sql import functions as F

from wearpath.operators.rolling import fill_undefined, rolling_by_unit, standardise
from wearpath.spec import TelemetrySpec

SPEC = TelemetrySpec(settings=(), sensors=("s1",))

MEANS = [1, 2.5, 4.666667, 7.5, 11, 18, 27, 38]
LITERAL = [0, 0.67082, 2.050745, 4.319208, 7.606284, 11.074997, 14.798836, 18.72031]
POPULATION = [0, 1.5, 3.299832, 5.678908, 8.648699, 11.436783, 14.240786, 17.052859]


@pytest.fixture(scope="module")
def squares(spark):
    return spark.range(1, 9).select(
        F.lit(1).alias("id"), F.col("id").cast("int").alias("cycle"), (F.col("id") * F.col("id")).cast("double").alias("s1")
    )


def columns(df, *names):
    rows = df.orderBy("cycle").collect()
    return [[r[n] for r in rows] for n in names]


def test_literal_deviation_uses_own_row_means_and_five(squares):
    mean, dev = columns(rolling_by_unit(squares, SPEC), "a1", "sd1")
    assert mean == pytest.approx(MEANS, abs=1e-6)
    assert dev == pytest.approx(LITERAL, abs=1e-6)


def test_population_deviation(squares):
    _, dev = columns(rolling_by_unit(squares, SPEC, mode="population"), "a1", "sd1")
    assert dev == pytest.approx(POPULATION, abs=1e-6)


def test_incomplete_frames_are_undefined_then_filled(squares):
    full = rolling_by_unit(squares, SPEC, mode="full", mean_prefix="mean_s", dev_prefix="stdv_s")
    mean, dev = columns(full, "mean_s1", "stdv_s1")
    assert mean[:4] == [None] * 4 and dev[:4] == [None] * 4
    assert mean[4:] == pytest.approx(MEANS[4:]) and dev[4:] == pytest.approx(POPULATION[4:], abs=1e-6)
    mean, dev = columns(fill_undefined(full, SPEC), "mean_s1", "stdv_s1")
    assert mean[:4] == [1, 4, 9, 16] and dev[:4] == [0] * 4


def test_standardise(squares):
    rolled = rolling_by_unit(squares, SPEC)
    (literal,) = columns(standardise(rolled, SPEC), "std1")
    assert literal[0] == pytest.approx(1 - 1 / 1e-8)
    assert literal[1] == pytest.approx(4 - 2.5 / 0.6708203932)
    (score,) = columns(standardise(rolled, SPEC, "zscore"), "std1")
    assert score[0] is None and score[1] == pytest.approx(1.5 / 0.6708203932)


def test_unknown_modes_are_refused(squares):
    with pytest.raises(ValueError):
        rolling_by_unit(squares, SPEC, mode="sample")
    with pytest.raises(ValueError):
        standardise(squares, SPEC, mode="other")

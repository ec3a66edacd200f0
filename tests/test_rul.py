from helpers import assert_same
from pyspark.sql import functions as F

from wearpath.operators.rul import (
    add_labels,
    merge_labels,
    rul_from_run_to_failure,
    rul_from_truth,
    truncate_units,
    truth_of_truncation,
)
from wearpath.plans import fixtures as fx
from wearpath.spec import TelemetrySpec

SPEC = TelemetrySpec(settings=(), sensors=("s1",))


def test_label_bounds_are_inclusive(spark):
    rows = [(31,), (30,), (16,), (15,), (0,), (-2,), (None,)]
    labels = {r.rul: (r.label1, r.label2) for r in add_labels(spark.createDataFrame(rows, "rul INT")).collect()}
    assert labels == {31: (0, 0), 30: (1, 1), 16: (1, 1), 15: (1, 2), 0: (1, 2), -2: (1, 2), None: (0, 0)}


def test_life_ends_at_zero_and_keyless_rows_vanish(spark):
    df = spark.createDataFrame([(1, 1), (1, 5), (2, 3), (None, 9)], "id INT, cycle INT")
    rul = {(r.id, r.cycle): r.rul for r in rul_from_run_to_failure(df, SPEC).collect()}
    assert rul == {(1, 1): 4, (1, 5): 0, (2, 3): 0}


def test_units_without_truth_vanish(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id INT, cycle INT")
    truth = spark.createDataFrame([(1, 7), (9, 1)], "id INT, RUL_at_maxcycle INT")
    rul = {(r.id, r.cycle): r.rul for r in rul_from_truth(df, truth, SPEC).collect()}
    assert rul == {(1, 1): 8, (1, 2): 7}


def test_truncated_series_with_truth_agree_with_the_full_series(spark, sf_dir):
    df, _ = fx.telemetry(spark, sf_dir, SPEC)
    df = df.cache()
    cut = truncate_units(df, 0.7, SPEC)
    known = rul_from_truth(cut, truth_of_truncation(df, 0.7), SPEC)
    full = rul_from_run_to_failure(df, SPEC).join(cut.select("id", "cycle"), ["id", "cycle"])
    assert cut.count() < df.count()
    assert_same(known, full.select(*known.columns), ["id", "cycle"])


def test_labels_agree_with_each_other(spark, sf_dir):
    df = fx.labelled(spark, sf_dir, SPEC)
    assert df.where((F.col("label2") >= 1) != (F.col("label1") == 1)).count() == 0


def test_merge_labels_keeps_types(spark):
    df = spark.createDataFrame([(2.0, 0.0), (1.0, 2.0), (0.0, 1.0)], "label DOUBLE, prediction DOUBLE")
    merged = merge_labels(df)
    assert merged.dtypes == df.dtypes
    assert [tuple(r) for r in merged.collect()] == [(1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]

import pytest
from helpers import assert_same
from pyspark.sql import functions as F

from wearpath.operators import features
from wearpath.spec import TURBOFAN, TelemetrySpec


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 1, 2.0, 7.0), (1, 2, 4.0, 7.0), (2, 1, 10.0, 7.0), (2, 2, None, 7.0)]
    return spark.createDataFrame(rows, "id INT, cycle INT, s1 DOUBLE, s2 DOUBLE")


def test_column_scaling_keeps_null_and_centres_constants(small):
    scaled = {(r.id, r.cycle): (r.s1, r.s2) for r in features.minmax_columns(small, ["s1", "s2"]).collect()}
    assert scaled == {(1, 1): (0.0, 0.5), (1, 2): (0.25, 0.5), (2, 1): (1.0, 0.5), (2, 2): (None, 0.5)}


def test_column_scaling_per_group(small):
    scaled = {(r.id, r.cycle): r.s1 for r in features.minmax_columns(small, ["s1"], ["id"]).collect()}
    assert scaled == {(1, 1): 0.0, (1, 2): 1.0, (2, 1): 0.5, (2, 2): None}


def test_vector_scaler_equals_column_scaling(small):
    known = small.dropna()
    model = features.fit_scaler(known, ["cycle", "s1", "s2"])
    flat = features.vector_columns(
        features.apply_scaler(known, model).select("id", "cycle", "scaledFeatures"),
        "scaledFeatures",
        ["cycle_", "s1", "s2"],
        "",
    ).drop("cycle_")
    assert_same(flat, features.minmax_columns(known, ["s1", "s2"]), ["id", "cycle"])


def test_scale_comes_from_the_ranges(small, monkeypatch):
    known, fitted_on = small.dropna(), []

    class Recorded(features.Pipeline):
        def fit(self, df):
            fitted_on.append(df.count())
            return super().fit(df)

    monkeypatch.setattr(features, "Pipeline", Recorded)
    scaler = features.fit_scaler(known, ["cycle", "s1", "s2"]).stages[1]
    assert fitted_on == [2]
    assert list(scaler.originalMin) == [1.0, 2.0, 7.0] and list(scaler.originalMax) == [2.0, 10.0, 7.0]


@pytest.mark.parametrize("value", [None, float("nan")])
def test_scaler_refuses_missing_values(spark, value):
    with pytest.raises(Exception, match="(?i)null|nan"):
        features.fit_scaler(spark.createDataFrame([(1.0,), (value,), (3.0,)], "s1 DOUBLE"), ["s1"])


def test_scaler_is_reused_on_another_table(small):
    known = small.dropna()
    model = features.fit_scaler(known, ["s1"])
    other = known.withColumn("s1", F.col("s1") + 8)
    top = features.apply_scaler(other, model).select("scaledFeatures").collect()
    assert max(r.scaledFeatures[0] for r in top) == pytest.approx(2.0)


def test_feature_lists():
    assert len(features.frame_features()) == 66
    assert features.frame_features()[:6] == ["cycle", "setting1", "setting2", "s1", "mean_s1", "stdv_s1"]


def test_feature_columns_leave_keys_and_targets_out(spark):
    columns = ["id", *TURBOFAN.key[1:], *TURBOFAN.measures, "operationmode", "rul", "label1", "label2"]
    columns += [f"{p}{i}" for p in ("a", "sd") for i in range(1, 22)]
    df = spark.createDataFrame([], ", ".join(f"{c} DOUBLE" for c in columns))
    assert len(features.feature_columns(df)) == 68
    assert features.feature_columns(df, {*features.NOT_FEATURES, "operationmode"})[-1] == "sd21"


def test_incomplete_rows_are_rejected_and_counted(small):
    assert features.reject_incomplete(small, ["id", "s1"]).count() == 3
    assert tuple(features.count_incomplete(small, ["id", "s1"]).first()) == (4, 3, 1)


def test_label_index_by_frequency_ties_by_label(spark):
    rows = [(0,)] * 40 + [(1,)] * 15 + [(2,)] * 16 + [(3,)] * 15
    df = spark.createDataFrame(rows, "y INT")
    index = {r.y: r.label_index for r in features.label_index(df, "y").collect()}
    assert index == {0: 0.0, 2: 1.0, 1: 2.0, 3: 3.0}
    indexed = features.label_indexer("y").fit(df).transform(df).distinct().collect()
    assert {r.y: r.indexedLabel for r in indexed} == index


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y INT")
    assert {r.y: r.weight for r in features.class_weights(df, "y").collect()} == {0: 8 / 12, 1: 2.0}
    weighted = features.with_class_weights(df, "y")
    assert weighted.count() == 8
    assert weighted.agg(F.sum("weight")).first()[0] == pytest.approx(8)


def test_spec_names():
    spec = TelemetrySpec(time="cykle").with_dataset()
    assert spec.key == ["dataset", "id", "cykle"]
    assert spec.schema().names[:3] == ["id", "cykle", "setting1"] and len(spec.schema()) == 26

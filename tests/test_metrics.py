import math
import shutil

import pytest
from pyspark.mllib.evaluation import MulticlassMetrics
from pyspark.sql import functions as F

from wearpath.operators import metrics


def pairs(spark, rows):
    return spark.createDataFrame([(float(a), float(b)) for a, b in rows], "label DOUBLE, prediction DOUBLE")


@pytest.fixture(scope="module")
def three(spark):
    rows = [(0, 0)] * 40 + [(0, 1)] * 5 + [(1, 1)] * 9 + [(1, 2)] * 6 + [(2, 2)] * 12 + [(2, 0)] * 4
    return rows, pairs(spark, rows)


def tidy(df):
    return {(r.metric, r.label): r.value for r in df.collect()}


def test_all_metrics_agree_with_the_library(spark, three):
    rows, df = three
    library = MulticlassMetrics(spark.sparkContext.parallelize([(float(b), float(a)) for a, b in rows]))
    found = tidy(metrics.evaluate(df))
    assert found["accuracy", None] == pytest.approx(library.accuracy)
    assert found["weighted_precision", None] == pytest.approx(library.weightedPrecision)
    assert found["weighted_recall", None] == pytest.approx(library.weightedRecall)
    assert found["weighted_f1", None] == pytest.approx(library.weightedFMeasure())
    assert found["weighted_f_beta", None] == pytest.approx(library.weightedFMeasure(beta=0.5))
    assert found["weighted_fpr", None] == pytest.approx(library.weightedFalsePositiveRate)
    for label in (0.0, 1.0, 2.0):
        assert found["precision", label] == pytest.approx(library.precision(label))
        assert found["recall", label] == pytest.approx(library.recall(label))
        assert found["fpr", label] == pytest.approx(library.falsePositiveRate(label))
        assert found["f1", label] == pytest.approx(library.fMeasure(label))
    matrix = library.confusionMatrix().toArray()
    cells = {(r.label, r.prediction): r.n for r in metrics.confusion(df).collect()}
    assert all(cells[float(i), float(j)] == matrix[i][j] for i in range(3) for j in range(3))
    assert sum(cells.values()) == len(rows)


def test_weighted_recall_is_accuracy(three):
    found = tidy(metrics.evaluate(three[1]))
    assert found["weighted_recall", None] == pytest.approx(found["accuracy", None])
    assert metrics.accuracy(three[1]).first().accuracy == pytest.approx(found["accuracy", None])


def test_class_that_is_never_predicted(spark):
    found = tidy(metrics.evaluate(pairs(spark, [(0, 0), (1, 0), (1, 0)])))
    assert found["precision", 1.0] == 0 and found["f1", 1.0] == 0 and found["recall", 1.0] == 0


def test_single_class_has_no_false_positive_rate(spark):
    found = tidy(metrics.evaluate(pairs(spark, [(0, 0), (0, 0)])))
    assert found["fpr", 0.0] is None and found["accuracy", None] == 1


def test_predicted_class_that_is_never_true(spark):
    df = pairs(spark, [(0, 0), (0, 2), (1, 1)])
    true_only = {(r.label, r.prediction): r.n for r in metrics.confusion(df).collect()}
    assert set(true_only) == {(a, b) for a in (0.0, 1.0) for b in (0.0, 1.0)}
    union = {(r.label, r.prediction): r.n for r in metrics.confusion(df, labels="union").collect()}
    assert union[0.0, 2.0] == 1 and union[2.0, 0.0] == 0 and len(union) == 9
    assert tidy(metrics.evaluate(df))["accuracy", None] == pytest.approx(2 / 3)
    percent = {(r.label, r.prediction): r.percent for r in metrics.confusion_percent(df, labels="union").collect()}
    assert percent[0.0, 2.0] == 50 and percent[2.0, 0.0] is None


def test_matrix_and_report(three):
    wide = metrics.confusion_matrix(three[1])
    assert wide.columns == ["label", "0.0", "1.0", "2.0"]
    assert [tuple(r) for r in wide.collect()] == [(0.0, 40, 5, 0), (1.0, 0, 9, 6), (2.0, 4, 0, 12)]
    text = metrics.report(three[1], "demo")
    assert text.startswith("demo") and "accuracy = 0.80" in text and "recall(2) = 0.75" in text


def test_beta(three):
    row = metrics.per_class(three[1], beta=2.0).where(F.col("label") == 0).first()
    p, r = 40 / 44, 40 / 45
    assert math.isclose(row.f, 5 * p * r / (4 * p + r))


def test_full_report_holds_the_confusion_cells(three):
    rows = metrics.full_report(three[1]).collect()
    cells = {(r.label, r.prediction): r.value for r in rows if r.metric == "confusion"}
    assert cells == {(float(r.label), float(r.prediction)): r.n for r in metrics.confusion(three[1], labels="union").collect()}
    assert all(r.prediction is None for r in rows if r.metric != "confusion")


def test_a_thousand_classes(spark):
    rows = spark.range(20_000).selectExpr("CAST(id % 1000 AS DOUBLE) AS label", "CAST((id * 7919) % 1003 AS DOUBLE) AS prediction")
    cells = metrics.confusion(rows)
    found = cells.agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("some")).first()
    assert found.cells == 1_000_000 and found.n == rows.where("prediction < 1000").count()
    assert found.some == rows.where("prediction < 1000").distinct().count()


def test_a_full_report_reads_its_rows_once(spark, tmp_path):
    """Rows that are gone after the report was built are not asked for again."""
    path = tmp_path / "scored"
    spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], "label DOUBLE, prediction DOUBLE").write.parquet(str(path))
    report = metrics.full_report(spark.read.parquet(str(path)))
    shutil.rmtree(path)
    assert {r.metric: r.value for r in report.collect() if r.label is None}["accuracy"] == pytest.approx(2 / 3)

"""Compiled models against the library's own scoring, in Spark and in another engine; softmax boosting."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wearpath.operators import boosting, compiled, models

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def blurred(spark):
    """Three classes that overlap, the rarest with a weight of its own; values tie at thresholds."""
    rng = np.random.default_rng(5)
    rows = []
    for label, count, centre in ((0, 150, (0.0, -0.5)), (1, 40, (0.7, 0.5)), (2, 80, (-0.7, 0.4))):
        for point in rng.normal(centre, 0.5, (count, 2)).round(1):
            rows.append((len(rows), label, min(label, 1), Vectors.dense(point)))
    return spark.createDataFrame(rows, ["id", "label2", "label1", "scaledFeatures"]).repartition(3).cache()


@pytest.mark.parametrize(
    ("kind", "label", "options"),
    [
        ("rf", "label2", {}),
        ("rf", "label1", {}),
        ("rf_weighted", "label2", {"numTrees": 10, "maxDepth": 4}),
        ("lr", "label2", {}),
        ("lr", "label1", {}),
        ("lr_weighted", "label2", {}),
        ("lr_weighted", "label1", {}),
        ("gbt_weighted", "label2", {"maxIter": 3, "maxDepth": 3}),
        ("gbt_weighted", "label1", {"maxIter": 7, "maxDepth": 2}),
    ],
)
def test_statement_scores_as_the_model_does(spark, blurred, tmp_path, kind, label, options):
    path = str(tmp_path / "model")
    models.save(models.train(blurred, kind, label, **options), path)
    model = models.load(path)
    own = models.score(blurred, model)
    width = len(model.stages[0].labels)
    p = F.array(*boosting.softmax([F.col("scores")[k] for k in range(width)])) if "scores" in own.columns else vector_to_array("probability")
    want = {r.id: (r.prediction, r.p) for r in own.select("id", "prediction", p.alias("p")).collect()}
    written = compiled.compile_model(model, ["f_a", "f_b"])
    table = compiled.feature_table(blurred, NAMES, ["id"])
    slots = table.toPandas()
    there = duckdb.connect().execute(written.sql("slots", ["id"])).fetchall()
    here = [tuple(r) for r in written.score(table, ["id"]).collect()]
    for rows in (here, there):
        assert len(rows) == len(want) == len(slots)
        for i, *shares, prediction in rows:
            assert prediction == want[i][0]
            assert shares == pytest.approx(want[i][1], abs=1e-12)


def test_large_models_and_other_kinds_are_refused(blurred):
    with pytest.raises(ValueError):
        compiled.compile_model(models.train(blurred, "rf", "label2", numTrees=200, maxDepth=6), NAMES)
    with pytest.raises(ValueError):
        compiled.boosted([[compiled.Node(values=(1.0,))] * 4000], 0.1, NAMES, ["0"])


def losses(model, df, label):
    """Mean weighted log loss after each round, from the scores of the first trees alone."""
    labels, fitted = model.stages[0].labels, models.classifier(model)
    rows = model.stages[0].transform(df).toPandas()
    k = len(labels)
    own = {t.getPredictionCol(): t for t in fitted.stages[:-2]}
    scores, out = np.zeros((len(rows), k)), []
    truth = rows["indexedLabel"].astype(int).to_numpy()
    for turn in range(len(own) // k):
        for j in range(k):
            tree = own[f"_t{turn}_{j}"]
            scores[:, j] += 0.3 * np.array([tree.predict(x) for x in rows["scaledFeatures"]])
        shares = np.exp(scores - scores.max(1, keepdims=True))
        shares /= shares.sum(1, keepdims=True)
        out.append(-np.log(shares[np.arange(len(rows)), truth]))
    return np.array(out), truth


def test_log_loss_falls_each_round(blurred):
    model = models.train(blurred, "gbt_weighted", "label2", maxIter=6, maxDepth=3)
    each, truth = losses(model, blurred, "label2")
    counts = np.bincount(truth)
    weights = len(truth) / (len(counts) * counts[truth])
    mean = (each * weights).mean(1)
    assert all(b < a for a, b in zip(mean, mean[1:])) and mean[0] < np.log(3)


def test_class_weights_are_honoured(blurred):
    weighted = models.score(blurred, models.train(blurred, "gbt_weighted", "label2", maxIter=4, maxDepth=2), "label2")
    plain = models.score(blurred, _unweighted(blurred), "label2")
    rare = [df.where("label2 = 1 AND prediction = 1").count() for df in (weighted, plain)]
    assert rare[0] > rare[1]
    assert set(weighted.columns) >= {"scores", "prediction"} and len(weighted.first().scores) == 3


def _unweighted(df):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import IndexToString

    from wearpath.operators.features import label_indexer

    indexer = label_indexer("label2").fit(df)
    fitted = boosting.SoftmaxBoosting("scaledFeatures", "indexedLabel", "_class", maxIter=4, maxDepth=2).fit(indexer.transform(df))
    return PipelineModel(stages=[indexer, fitted, IndexToString(inputCol="_class", outputCol="_label", labels=indexer.labels)])

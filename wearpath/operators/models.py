"""Classifiers as saved pipelines: label index, classifier, and the way back to labels.

The label index is fitted once and saved with the model, so a class number means the same label
on every table the model scores.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import partial

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from wearpath.operators.boosting import THREADS, SoftmaxBoosting, in_parallel
from wearpath.operators.features import label_indexer, with_class_weights
from wearpath.operators.metrics import full_report
from wearpath.session import delete_path, keep_checkpoints, work_path

#: Most trees that one fit grows, and how many of a forest's fits run at a time.
TREES_PER_FIT, FITS = 64, 2

_COLUMNS = {"labelCol": "indexedLabel", "predictionCol": "_class"}


def _logistic(features: str, **options) -> Estimator:
    settings = {"maxIter": 100, "regParam": 0.0, "tol": 1e-6, "fitIntercept": False, **options}
    return LogisticRegression(featuresCol=features, family="auto", **_COLUMNS, **settings)


def _forest(features: str, **options) -> "Estimator | ForestInParts":
    settings = {"impurity": "gini", "maxBins": 32, "featureSubsetStrategy": "auto", "seed": 11, **options}
    forest = RandomForestClassifier(featuresCol=features, **_COLUMNS, **settings)
    return ForestInParts(forest) if forest.getNumTrees() > TREES_PER_FIT else forest


@dataclass
class ForestInParts:
    """A forest of many trees, grown by several fits with seeds of their own and joined to one model.

    A fit keeps a count for each row and tree, and the statistics of all trees' nodes in every task. Those of
    hundreds of trees fit neither the memory nor a processor's cache.
    """

    forest: RandomForestClassifier

    def fit(self, df: DataFrame) -> RandomForestClassificationModel:
        trees, seed = self.forest.getNumTrees(), self.forest.getSeed()
        parts, others = -(-trees // TREES_PER_FIT), random.Random(seed)
        sizes = [trees // parts + (i < trees % parts) for i in range(parts)]
        seeds = [seed, *(others.getrandbits(48) for _ in sizes[1:])]
        return self._joined(in_parallel([partial(self._part(n, s).fit, df) for n, s in zip(sizes, seeds)], FITS))

    def _part(self, trees: int, seed: int) -> RandomForestClassifier:
        return self.forest.copy({self.forest.numTrees: trees, self.forest.seed: seed})

    def _joined(self, fits: list[RandomForestClassificationModel]) -> RandomForestClassificationModel:
        context = SparkSession.active().sparkContext
        kinds = context._jvm.org.apache.spark.ml.classification
        grown = [tree for fit in fits for tree in fit._java_obj.trees()]
        trees = context._gateway.new_array(kinds.DecisionTreeClassificationModel, len(grown))
        for at, tree in enumerate(grown):
            trees[at] = tree
        first = fits[0]
        joined = kinds.RandomForestClassificationModel(first.uid, trees, first.numFeatures, first.numClasses)
        model = self.forest._copyValues(RandomForestClassificationModel(joined))
        model._transfer_params_to_java()
        return model


def _boosted(features: str, **options) -> SoftmaxBoosting:
    return SoftmaxBoosting(features, _COLUMNS["labelCol"], _COLUMNS["predictionCol"], **options)


#: Model kinds: how to build them, their fixed parameters, whether classes are weighted.
KINDS: dict[str, tuple[Callable[..., Estimator | SoftmaxBoosting | ForestInParts], dict, bool]] = {
    "lr": (_logistic, {}, False),
    "rf": (_forest, {"numTrees": 3, "maxDepth": 4}, False),
    "rf_large": (_forest, {"numTrees": 666, "maxDepth": 6}, False),
    "lr_weighted": (_logistic, {"fitIntercept": True, "regParam": 0.01}, True),
    "rf_weighted": (_forest, {"numTrees": 50, "maxDepth": 6}, True),
    "gbt_weighted": (_boosted, {}, True),
}

_FITTED = {
    "lr": LogisticRegressionModel,
    "rf": RandomForestClassificationModel,
    "gbt": PipelineModel,
}


def label_column(label: int | str) -> tuple[str, int]:
    """Label choice 1 -> (``label1``, 2 classes); anything else -> (``label2``, 3 classes)."""
    return ("label1", 2) if label in (1, "1") else ("label2", 3)


def train(
    df: DataFrame,
    kind: str,
    label: str = "label2",
    features: str = "scaledFeatures",
    label_order: str = "frequencyDesc",
    keep: bool = True,
    indexer: StringIndexerModel | None = None,
    **options,
) -> PipelineModel:
    """Fit a classifier of ``KINDS``; ``options`` override its parameters.

    Only label, features and weight are kept for the iterations, in memory as far as it goes, then
    on disk. ``keep=False`` reads the table again instead, for one larger than the cluster's disks.
    ``indexer`` is a label index that was fitted before.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {sorted(KINDS)}, not {kind!r}")
    build, fixed, is_weighted = KINDS[kind]
    parameters = {**fixed, **options}
    keep_checkpoints(df.sparkSession)
    rows = df.select(label, features)
    if is_weighted:
        rows = with_class_weights(rows, label, "_weight")
        parameters.setdefault("weightCol", "_weight")
    if keep:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        indexer = indexer or label_indexer(label, order=label_order).fit(rows)
        back = IndexToString(inputCol="_class", outputCol="_label", labels=indexer.labels)
        indexed = indexer.transform(rows)
        return PipelineModel(stages=[indexer, _without_summary(build(features, **parameters).fit(indexed), df.sparkSession), back])
    finally:
        if keep:
            rows.unpersist()


def _without_summary(fitted, spark: SparkSession):
    """The model as it is read back from a saved form.

    The training summary of a two-class model holds the session, which goes to the tasks with the
    model and cannot be written there once the session has observed a table (``Observation``).
    """
    if not getattr(fitted, "hasSummary", False) or fitted.numClasses > 2:
        return fitted
    path = work_path(spark, "fitted")
    try:
        fitted.write().save(path)
        return type(fitted).load(path)
    finally:
        delete_path(spark, path)


def classifier(model: PipelineModel):
    return model.stages[1]


def score(df: DataFrame, model: PipelineModel, label: str | None = None) -> DataFrame:
    """Batch scoring: adds ``prediction`` in label units, and ``label`` if its column is named.

    The label index is not needed to predict, so tables without labels can be scored.
    """
    predicted = PipelineModel(stages=model.stages[1:]).transform(df)
    scored = predicted.withColumn("prediction", F.col("_label").cast("double")).drop("_class", "_label")
    scored = scored.drop("rawPrediction")
    return scored if label is None else scored.withColumn("label", F.col(label).cast("double"))


def evaluate_model(df: DataFrame, model: PipelineModel, label: str = "label2") -> DataFrame:
    """Score a table and report all metrics and the confusion cells by original label."""
    return full_report(score(df, model, label).select("label", "prediction"))


def save(model: PipelineModel, path: str | None) -> bool:
    """Save a model; nothing is done without a path."""
    if not path:
        return False
    model.write().overwrite().save(path)
    return True


def load(path: str, kind: str | None = None) -> PipelineModel:
    """Load a model. The saved model knows its kind; a given one (LR, RF, GBT) is checked."""
    if kind is not None and kind.lower() not in _FITTED:
        raise ValueError(f"kind must be one of {sorted(_FITTED)}, not {kind!r}")
    model = PipelineModel.load(path)
    if kind is not None and not isinstance(classifier(model), _FITTED[kind.lower()]):
        raise ValueError(f"the model at {path} is a {type(classifier(model)).__name__}, not {kind}")
    return model


def coefficients(model: PipelineModel, spark, names: Iterable[str]) -> DataFrame:
    """Logistic coefficients as (label, feature, value), smallest value first.

    For two classes the one row of coefficients belongs to class index 1.
    """
    indexer, fitted = model.stages[0], classifier(model)
    assert isinstance(indexer, StringIndexerModel)
    matrix = fitted.coefficientMatrix.toArray()
    labels = indexer.labels[1:] if len(matrix) == 1 else indexer.labels
    names = list(names)
    rows = [(y, x, float(v)) for y, row in zip(labels, matrix) for x, v in zip(names, row)]
    return spark.createDataFrame(rows, "label STRING, feature STRING, value DOUBLE").orderBy("value", "label", "feature")


def train_grid(
    tables: Mapping[str, DataFrame],
    kinds: Iterable[str],
    labels: Iterable[str] = ("label1", "label2"),
    features: str = "scaledFeatures",
    path: str | None = None,
    options: Mapping[str, dict] | None = None,
    threads: int = THREADS,
) -> DataFrame:
    """Train each kind on each table and label, ``threads`` models at a time; one tidy local table of metrics on the training rows.

    A data set's labels and features are kept once for all its models, which share one index
    for each label. Models are saved as ``<path>/<kind>_<table>_<label>`` if a path is given.
    A model that fails has one row, with metric ``error`` and its message in ``error``; the others go on.
    """
    kinds, labels, found = list(kinds), list(labels), []

    def one(name: str, rows: DataFrame, label: str, kind: str, indexer: StringIndexerModel) -> list[tuple]:
        tags = (name, label, kind)
        try:
            model = train(rows, kind, label, features, keep=False, indexer=indexer, **(options or {}).get(kind, {}))
            save(model, f"{path}/{kind}_{name}_{label}" if path else None)
            return [(*tags, r.metric, r.label, r.prediction, r.value, None) for r in evaluate_model(rows, model, label).collect()]
        except Exception as failure:  # noqa: BLE001  what one model meets is its own result
            return [(*tags, "error", None, None, None, f"{type(failure).__name__}: {failure}"[:500])]

    for name, table in tables.items():
        rows = table.select(*labels, features).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            indexers = {label: label_indexer(label).fit(rows) for label in labels}
            work = [partial(one, name, rows, label, kind, indexers[label]) for label in labels for kind in kinds]
            found += [row for report in in_parallel(work, threads) for row in report]
        finally:
            rows.unpersist()
    schema = "dataset STRING, target STRING, kind STRING, metric STRING, class DOUBLE, prediction DOUBLE, value DOUBLE, error STRING"
    return next(iter(tables.values())).sparkSession.createDataFrame(found, schema)

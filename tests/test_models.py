import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wearpath.operators import factors, metrics, models, modes
from wearpath.spec import TelemetrySpec


@pytest.fixture(scope="module")
def separable(spark):
    """Three classes of unlike size in three directions, so that no intercept is needed to part them."""
    rng = np.random.default_rng(2)
    rows = []
    for label, count, centre in ((0, 120, (0.0, -1.0)), (1, 30, (1.0, 0.5)), (2, 60, (-1.0, 0.5))):
        for point in rng.normal(centre, 0.05, (count, 2)):
            rows.append((label, min(label, 1), Vectors.dense(point)))
    return spark.createDataFrame(rows, ["label2", "label1", "scaledFeatures"]).repartition(4).cache()


def accuracy(df, model, label):
    scored = models.score(df, model, label)
    assert scored.count() == df.count()
    return metrics.accuracy(scored).first().accuracy


@pytest.mark.parametrize("kind", sorted(models.KINDS))
def test_every_kind_beats_the_majority_class(separable, kind):
    small = {"rf_large": {"numTrees": 20}, "gbt_weighted": {"maxIter": 3, "maxDepth": 3}}.get(kind, {})
    model = models.train(separable, kind, "label2", **small)
    assert accuracy(separable, model, "label2") > 120 / 210 + 0.2


def test_predictions_are_labels_not_ranks(separable):
    model = models.train(separable, "rf", "label2")
    assert model.stages[0].labels == ["0", "2", "1"]
    per_label = {r.label: r.recall for r in metrics.per_class(models.score(separable, model, "label2")).collect()}
    assert all(per_label[y] > 0.9 for y in (0.0, 1.0, 2.0))


def test_rows_without_label_are_scored(separable):
    model = models.train(separable, "lr", "label1")
    scored = models.score(separable.drop("label1", "label2"), model)
    assert {r.prediction for r in scored.collect()} == {0.0, 1.0}
    assert scored.where(~F.col("prediction").isin(0.0, 1.0)).count() == 0


@pytest.mark.parametrize("kind", ["lr", "rf", "lr_weighted"])
def test_two_classes_are_scored_after_a_table_was_observed(spark, separable, kind):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    model = models.train(separable, kind, "label1")
    assert accuracy(separable, model, "label1") == 1.0


def test_save_and_load(separable, tmp_path):
    model, path = models.train(separable, "lr", "label2", keep=False), str(tmp_path / "m")
    assert not models.save(model, None) and not models.save(model, "")
    assert models.save(model, path)
    first = models.score(separable, model).select("prediction").collect()
    assert models.score(separable, models.load(path, "LR")).select("prediction").collect() == first
    with pytest.raises(ValueError):
        models.load(path, "RF")
    with pytest.raises(ValueError):
        models.load(path, "SVM")


def test_fixed_parameters(separable):
    assert models.KINDS["rf"][1] == {"numTrees": 3, "maxDepth": 4}
    assert models.KINDS["rf_large"][1] == {"numTrees": 666, "maxDepth": 6}
    lr = models.classifier(models.train(separable, "lr", "label2"))
    assert (lr.getMaxIter(), lr.getRegParam(), lr.getFitIntercept(), lr.numClasses) == (100, 0.0, False, 3)
    with pytest.raises(ValueError):
        models.train(separable, "svm")


def test_label_choice():
    assert models.label_column(1) == ("label1", 2)
    assert models.label_column(2) == models.label_column("x") == ("label2", 3)


def test_coefficients(spark, separable):
    model = models.train(separable, "lr_weighted", "label1")
    rows = models.coefficients(model, spark, ["x", "y"]).collect()
    assert len(rows) == 2 and rows[0].value <= rows[1].value
    rows = models.coefficients(models.train(separable, "lr", "label2"), spark, ["x", "y"]).collect()
    assert len(rows) == 6 and {r.label for r in rows} == {"0", "1", "2"}


def test_grid(separable, tmp_path):
    table = models.train_grid({"a": separable}, ["rf"], path=str(tmp_path))
    targets = {(r.dataset, r.target, r.kind) for r in table.select("dataset", "target", "kind").distinct().collect()}
    assert targets == {("a", "label1", "rf"), ("a", "label2", "rf")}
    assert (tmp_path / "rf_a_label1").exists() and (tmp_path / "rf_a_label2").exists()


def test_grid_goes_on_when_a_model_fails(separable):
    table = models.train_grid({"a": separable, "b": separable}, ["rf", "lr"], ["label2"], options={"lr": {"maxIter": -1}})
    rows = table.collect()
    bad = [r for r in rows if r.metric == "error"]
    assert {(r.dataset, r.kind) for r in bad} == {("a", "lr"), ("b", "lr")} and all(r.error for r in bad)
    assert {(r.dataset, r.kind) for r in rows if r.metric == "accuracy"} == {("a", "rf"), ("b", "rf")}


def test_modes_follow_the_settings(spark):
    spec = TelemetrySpec(sensors=())
    rows = [(1, n, float(n % 6) * 10, float(n % 6), 100.0) for n in range(120)]
    df = spark.createDataFrame(rows, "id INT, cycle INT, setting1 DOUBLE, setting2 DOUBLE, setting3 DOUBLE")
    model = modes.fit_modes(df, spec, seed=4)
    ordered = modes.add_modes(df, model, in_centre_order=True)
    assert all(r.operationmode == r.setting2 for r in ordered.collect())
    assert ordered.columns == [*df.columns, "operationmode"]
    attached = modes.attach_mode(df, ordered.select("id", "cycle", "operationmode"), spec)
    assert attached.columns == ordered.columns and attached.count() == 120


def test_modes_of_weighted_settings_cost_no_more_than_of_all_rows(spark, monkeypatch):
    spec = TelemetrySpec(sensors=())
    rng = np.random.default_rng(8)
    rows = [(1, n, float(rng.integers(24)), float(rng.integers(100)), 100.0) for n in range(3000)]
    df = spark.createDataFrame(rows, "id INT, cycle INT, setting1 DOUBLE, setting2 DOUBLE, setting3 DOUBLE")
    points = np.array([r[2:] for r in rows])

    def cost(centres):
        return min(np.square(points[:, None, :] - np.array(centres)[None]).sum(2).min(1).sum(), np.inf)

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(spec.settings), outputCol="v").transform(df)
    whole = KMeans(k=6, featuresCol="v", seed=3, maxIter=100).fit(vectors)
    weighted = modes.fit_modes(df, spec, seed=3, maxIter=100)
    assert cost(weighted.stages[-1].clusterCenters()) < 1.15 * cost(whole.clusterCenters())
    table = modes.weighted_settings(df, spec.settings)
    assert table.count() == df.select(*spec.settings).distinct().count() and table.agg({"_weight": "sum"}).first()[0] == 3000
    coarse = modes.weighted_settings(df, spec.settings, most=400)
    assert coarse.count() <= 21 * 21 and coarse.agg({"_weight": "sum"}).first()[0] == 3000
    means = coarse.selectExpr("sum(setting1 * _weight) / 3000", "sum(setting2 * _weight) / 3000").first()
    assert tuple(means) == (pytest.approx(points[:, 0].mean()), pytest.approx(points[:, 1].mean()))


def test_modes_of_constant_settings(spark):
    rows = [(1, n, 1.0, 1.0, 1.0) for n in range(20)]
    df = spark.createDataFrame(rows, "id INT, cycle INT, setting1 DOUBLE, setting2 DOUBLE, setting3 DOUBLE")
    scored = modes.add_modes(df, modes.fit_modes(df, TelemetrySpec(sensors=())))
    assert scored.select("operationmode").distinct().count() == 1


def test_implicit_factors_rank_seen_items_first(spark):
    rows = [(u, i, 5.0) for u in range(12) for i in range(10) if i % 2 == u % 2]
    ratings = spark.createDataFrame(rows, "user INT, item INT, rating FLOAT")
    model = factors.fit_implicit(ratings, rank=4, iterations=6)
    vectors = factors.item_factors(model)
    assert vectors.count() == 10 and len(vectors.first().features) == 4
    pairs = spark.createDataFrame([(u, i) for u in range(12) for i in range(10)], "user INT, item INT")
    scores = {(r.user, r.item): r.prediction for r in model.transform(pairs).collect()}
    assert all(scores[u, i] > scores[u, 1 - i % 2] for u in range(12) for i in range(10) if i % 2 == u % 2)


def test_factor_shuffles_go_with_their_iteration(spark, monkeypatch):
    """ALS deletes a shuffle when it cuts the lineage, and sends a factor to each block that needs it."""
    built = []

    class Recorded(factors.ALS):
        def fit(self, *args):
            built.append(self)
            return super().fit(*args)

    monkeypatch.setattr(factors, "ALS", Recorded)
    ratings = spark.createDataFrame([(u, i, 5.0) for u in range(4) for i in range(3)], "user INT, item INT, rating FLOAT")
    factors.fit_implicit(ratings, rank=2, iterations=2)
    assert built[0].getCheckpointInterval() == 1
    assert built[0].getNumUserBlocks() == built[0].getNumItemBlocks() == 4


def test_user_vectors_solve_their_normal_equations(spark):
    rng = np.random.default_rng(4)
    rows = [(int(u), int(i), float(rng.integers(0, 4))) for u in range(25) for i in rng.choice(15, 6, replace=False)]
    ratings = spark.createDataFrame(rows, "user INT, item INT, rating FLOAT")
    model = factors.fit_implicit(ratings, rank=5, iterations=4)
    gaps = {r.id: r.residual for r in factors.user_residuals(model, ratings).collect()}
    assert len(gaps) == 25 and max(v for v in gaps.values() if v is not None) < 1e-3
    x = {r.id: np.array(r.features) for r in model.itemFactors.collect()}
    y = {r.id: np.array(r.features) for r in model.userFactors.collect()}
    gram = sum(np.outer(v, v) for v in x.values())
    other = factors.user_residuals(model, ratings, alpha=20.0)
    for r in other.collect():
        own = [(x[i], rating) for u, i, rating in rows if u == r.id]
        left = gram + 0.8 * sum(rating > 0 for _, rating in own) * np.eye(5) + sum(20 * rating * np.outer(v, v) for v, rating in own)
        right = sum((1 + 20 * rating) * v for v, rating in own if rating > 0)
        assert r.residual == pytest.approx(np.linalg.norm(left @ y[r.id] - right) / np.linalg.norm(right))


def test_factors_of_many_ratings_have_more_blocks(spark, monkeypatch):
    """Four tasks a step leave a larger cluster idle; what is shuffled grows with the blocks, so there are at most eight."""
    built = []

    class Recorded(factors.ALS):
        def fit(self, *args):
            built.append(self)
            return super().fit(*args)

    monkeypatch.setattr(factors, "ALS", Recorded)
    ratings = spark.createDataFrame([(u, i, 5.0) for u in range(4) for i in range(3)], "user INT, item INT, rating FLOAT")
    for size in (2, 1):
        monkeypatch.setattr(factors, "RATINGS_PER_BLOCK", size, raising=False)
        factors.fit_implicit(ratings, rank=2, iterations=1)
    factors.fit_implicit(ratings, rank=2, iterations=1, blocks=3)
    assert [(a.getNumUserBlocks(), a.getNumItemBlocks()) for a in built] == [(6, 6), (8, 8), (3, 3)]


def test_residuals_add_up_over_batches(spark):
    """A user's ratings may lie in many batches; unknown and negative ratings count as they do in SQL."""
    ratings = spark.createDataFrame([(u, i, float((u * i) % 4)) for u in range(9) for i in range(7)], "user INT, item INT, rating FLOAT")
    model = factors.fit_implicit(ratings, rank=3, iterations=3)
    odd = ratings.unionByName(spark.createDataFrame([(1, 2, None), (2, 3, -2.0), (None, 1, 1.0)], ratings.schema))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "2")
        found = {r.id: r.residual for r in factors.user_residuals(model, odd).collect()}
    finally:
        spark.conf.set(size, before)
    x = {r.id: np.array(r.features) for r in model.itemFactors.collect()}
    y = {r.id: np.array(r.features) for r in model.userFactors.collect()}
    gram = sum(np.outer(v, v) for v in x.values())
    assert set(found) == set(y)
    for u, residual in found.items():
        own = [(x[r.item], r.rating) for r in odd.collect() if r.user == u and r.rating is not None]
        left = gram + 0.8 * sum(r > 0 for _, r in own) * np.eye(3) + sum(150 * abs(r) * np.outer(v, v) for v, r in own)
        right = sum((1 + 150 * r) * v for v, r in own if r > 0) + np.zeros(3)
        if not right.any():
            assert residual is None
        else:
            assert residual == pytest.approx(np.linalg.norm(left @ y[u] - right) / np.linalg.norm(right), rel=1e-6)


def test_many_trees_are_grown_in_parts(spark, monkeypatch, tmp_path):
    """The parts have seeds of their own and are one model, which is saved, loaded and scored as any forest is."""
    fitted = []

    class Recorded(models.RandomForestClassifier):
        def _fit(self, df):
            fitted.append((self.getNumTrees(), self.getSeed()))
            return super()._fit(df)

    monkeypatch.setattr(models, "RandomForestClassifier", Recorded)
    monkeypatch.setattr(models, "TREES_PER_FIT", 3, raising=False)
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    rows = [(int(a[0] * 3), Vectors.dense(a.tolist())) for a in x]
    df = spark.createDataFrame(rows, ["label2", "scaledFeatures"])
    model = models.train(df, "rf_large", numTrees=8)
    assert sorted(n for n, _ in fitted) == [2, 3, 3] and len({seed for _, seed in fitted}) == 3
    forest = models.classifier(model)
    assert isinstance(forest, models.RandomForestClassificationModel)
    assert forest.getNumTrees == len(forest.trees) == 8 and forest.getMaxDepth() == 6 and forest.numClasses == 3
    assert len({tree.toDebugString.split("\n", 1)[1] for tree in forest.trees}) == 8
    scored = models.score(df, model, "label2")
    assert scored.where("label = prediction").count() > 380
    raw = models.PipelineModel(stages=model.stages[1:2]).transform(df).select("rawPrediction", "scaledFeatures").first()
    own = [t.predictRaw(raw.scaledFeatures).toArray() for t in forest.trees]
    assert raw.rawPrediction.toArray() == pytest.approx(sum(v / v.sum() for v in own))
    models.save(model, str(tmp_path / "forest"))
    back = models.load(str(tmp_path / "forest"), "RF")
    assert models.classifier(back).getNumTrees == 8
    assert sorted(models.score(df, back, "label2").select("prediction").collect()) == sorted(scored.select("prediction").collect())

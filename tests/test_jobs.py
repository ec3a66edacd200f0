import gzip
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from helpers import assert_same
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wearpath.operators.features import NOT_FEATURES
from wearpath.operators.rolling import rolling_by_mode
from wearpath.operators.rul import truncate_units, truth_of_truncation
from wearpath.plans import fixtures as fx
from wearpath.plans import catalog, learn, prepare
from wearpath.sources import sinks
from wearpath.spec import TURBOFAN, TURBOFAN_CYKLE


@pytest.fixture(scope="module")
def texts(spark, sf_dir, tmp_path_factory):
    """Train, test and truth files in the text layout; units are numbered from 1."""
    base = tmp_path_factory.mktemp("texts")
    df = fx.telemetry(spark, sf_dir)[0]
    df = df.withColumn("id", F.col("id") + 1 - df.select(F.min("id")).scalar()).cache()
    tables = {
        "train": df,
        "test": truncate_units(df, 0.7),
        "truth": truth_of_truncation(df, 0.7),
        "lines": truth_of_truncation(df, 0.7).orderBy("id").select("RUL_at_maxcycle").coalesce(1),
    }
    for name, table in tables.items():
        sinks.write_text_table(table, str(base / name), compression="gzip" if name == "lines" else None)
    return df, {name: str(base / name) for name in tables}


@pytest.fixture(scope="module")
def prepared(spark, texts, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("prepared") / "train")
    return prepare.prepare_train(spark, texts[1]["train"], out, seed=3)


def test_train_table_layout(spark, texts, prepared):
    unscaled, scaled = spark.read.parquet(prepared.unscaled), spark.read.parquet(prepared.scaled)
    assert len(unscaled.columns) == 72 and len(scaled.columns) == 73
    expected = [*TURBOFAN.key, *TURBOFAN.measures, "operationmode", "rul", "label1", "label2"]
    expected += [f"{p}{i}" for p in ("a", "sd") for i in range(1, 22)]
    assert unscaled.columns == expected and scaled.columns == [*expected, "scaledFeatures"]
    assert unscaled.count() == scaled.count() == texts[0].count()
    slots = vector_to_array("scaledFeatures")
    low, high, width = scaled.agg(
        F.min(F.array_min(slots)), F.max(F.array_max(slots)), F.max(F.size(slots))
    ).first()
    assert low == 0 and high == 1 and width == 68


def test_csv_outputs(spark, prepared):
    flat = spark.read.csv(f"{prepared.scaled}.csv", header=True)
    assert len(flat.columns) == 72 + 68 and "scaled_sd21" in flat.columns
    assert len(spark.read.csv(f"{prepared.scaled}_unscaled.csv", header=True).columns) == 72


def test_csv_of_a_large_table_is_compressed(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(prepare, "PLAIN_ROWS", 10)
    done = prepare.prepare_train(spark, texts[1]["train"], str(tmp_path / "train"), seed=3)
    for table, width in ((done.scaled, 72 + 68), (done.unscaled, 72)):
        files = [f.name for f in (tmp_path / f"{table.rsplit('/', 1)[-1]}.csv").glob("part-*")]
        assert files and all(f.endswith(".csv.gz") for f in files)
        back = spark.read.csv(f"{table}.csv", header=True, inferSchema=True)
        assert len(back.columns) == width
        assert back.agg(F.count("*"), F.max("a1")).first() == spark.read.parquet(table).agg(F.count("*"), F.max("a1")).first()


def test_test_table_uses_the_training_fit(spark, texts, prepared, tmp_path):
    paths = texts[1]
    fitted = prepare.prepare_test(spark, paths["test"], paths["truth"], str(tmp_path / "fitted"), prepared)
    anew = prepare.prepare_test(spark, paths["test"], paths["truth"], str(tmp_path / "anew"), seed=3)
    train, test = spark.read.parquet(prepared.unscaled), spark.read.parquet(fitted.unscaled)
    same = test.join(train.select("id", "cycle", *[F.col(c).alias(f"t_{c}") for c in ("rul", "operationmode", "sd7")]), ["id", "cycle"])
    assert same.count() == test.count() > 0
    assert same.where("rul != t_rul OR operationmode != t_operationmode OR abs(sd7 - t_sd7) > 1e-9").count() == 0
    assert spark.read.parquet(anew.scaled).count() == test.count()
    assert not (tmp_path / "fitted.csv").exists()


@pytest.mark.parametrize("mode_feature, width", [("exclude", 67), ("one_hot", 73)])
def test_mode_as_feature(spark, texts, tmp_path, mode_feature, width):
    paths = texts[1]
    fitted = prepare.prepare_train(
        spark, paths["train"], str(tmp_path / "train"), write_csv=False, seed=3, mode_feature=mode_feature
    )
    tested = prepare.prepare_test(spark, paths["test"], paths["truth"], str(tmp_path / "test"), fitted)
    for done in (fitted, tested):
        vectors = spark.read.parquet(done.scaled).select(F.size(vector_to_array("scaledFeatures")).alias("w"))
        assert {r.w for r in vectors.distinct().collect()} == {width}


def test_forward_table(spark, texts, tmp_path):
    done = prepare.prepare_forward(spark, texts[1]["train"], str(tmp_path / "v2"), seed=3, rows_per_task=50)
    table = spark.read.parquet(done.scaled)
    assert "features" not in table.columns and "maxcykle" not in table.columns and len(table.columns) == 73
    base = spark.read.parquet(done.unscaled)
    rolled = [f"{p}{i}" for p in ("a", "sd") for i in range(1, 22)]
    assert_same(rolling_by_mode(base.drop(*rolled), TURBOFAN_CYKLE), base, ["id", "cykle"])


def test_sets_are_scaled_on_their_own(spark, texts, tmp_path):
    df, _ = texts
    inputs = {}
    for name, factor in (("A", 1.0), ("B", 10.0)):
        inputs[name] = str(tmp_path / name)
        sinks.write_text_table(df.withColumn("s1", F.col("s1") * factor), inputs[name])
    out = spark.read.parquet(prepare.prepare_sets(spark, inputs, str(tmp_path / "sets"), seed=3))
    assert out.groupBy("dataset").count().count() == 2
    columns = [c for c in spark.read.parquet(str(tmp_path / "sets_unscaled")).columns if c not in NOT_FEATURES]
    s1 = vector_to_array("scaledFeatures")[columns.index("s1")]
    ranges = out.groupBy("dataset").agg(F.min(s1).alias("lo"), F.max(s1).alias("hi")).collect()
    assert all((r.lo, r.hi) == (0.0, 1.0) for r in ranges)
    assert out.where("label2 >= 1 AND label1 = 0").count() == 0


def test_saved_run_is_read_back(spark, texts, prepared, tmp_path):
    saved = str(tmp_path / "saved")
    prepared.save(saved)
    again = prepare.load_prepared(spark, saved)
    facts = ("scaled", "unscaled", "mode_feature", "rows_read", "rows_kept", "rows_rejected")
    assert [getattr(again, f) for f in facts] == [getattr(prepared, f) for f in facts]
    paths = texts[1]
    outs = [prepare.prepare_test(spark, paths["test"], paths["truth"], str(tmp_path / n), run) for n, run in (("a", prepared), ("b", saved))]
    assert_same(*(spark.read.parquet(o.scaled).withColumn("v", vector_to_array("scaledFeatures").cast("string")).drop("scaledFeatures") for o in outs), ["id", "cycle"])
    sets = prepare.prepare_sets(spark, {"A": paths["test"]}, str(tmp_path / "sets"), {"A": paths["truth"]}, fitted={"A": saved})
    x, y = vector_to_array("scaledFeatures"), F.col("y")
    one = spark.read.parquet(outs[0].scaled).select("id", "cycle", x.alias("y"))
    met = spark.read.parquet(sets).join(one, ["id", "cycle"])
    assert met.count() == one.count()
    assert met.where(F.exists(F.zip_with(x, y, lambda a, b: F.abs(a - b)), lambda d: d > 1e-9)).count() == 0


def test_toy_run(spark, texts, tmp_path):
    paths = texts[1]
    train, test = prepare.toy_run(spark, paths["train"], paths["test"], paths["truth"], str(tmp_path), seed=3)
    for done in (train, test):
        folder = tmp_path / f"{done.scaled.rsplit('/', 1)[-1]}_unscaled.csv"
        assert len(list(folder.glob("part-*.csv"))) == 1


def test_work_table_is_gone_before_the_scaled_table_is_written(spark, texts, tmp_path, monkeypatch):
    """The largest outputs do not lie on disk beside the typed copy of the text."""
    paths, typed, there = texts[1], [], []
    made, scaled = prepare._typed, prepare.apply_scaler

    def recorded(*args):
        table, path = made(*args)
        typed.append(Path(path))
        return table, path

    def looked(*args):
        there.append(typed[-1].exists())
        return scaled(*args)

    monkeypatch.setattr(prepare, "_typed", recorded)
    monkeypatch.setattr(prepare, "apply_scaler", looked)
    done = prepare.prepare_train(spark, paths["train"], str(tmp_path / "train"), seed=3, write_csv=False)
    prepare.prepare_test(spark, paths["test"], paths["truth"], str(tmp_path / "test"), done)
    prepare.prepare_forward(spark, paths["train"], str(tmp_path / "forward"), TURBOFAN_CYKLE, seed=3)
    assert there == [False] * 3 and not any(path.exists() for path in typed)


def test_staged_text_is_gzip(spark, texts):
    path = Path(catalog._staged_text(spark, texts[0], "staged"))
    names = [p.name for p in path.glob("part-*")]
    assert names and all(n.endswith(".csv.gz") for n in names)
    assert spark.read.text(str(path)).count() == texts[0].count()


def test_tables_are_packed_in_large_plain_pages(spark, tmp_path):
    """Rolling columns rarely fit a dictionary; in large pages zstd finds the values that come again."""
    path = str(tmp_path / "table")
    df = spark.range(0, 60_000, 1, 1).selectExpr("id", "double(id % 5000) / 7 AS x")
    sinks.write_parquet(df, path)
    (part,) = (tmp_path / "table").glob("part-*")
    chunk = pq.ParquetFile(part).metadata.row_group(0).column(1)
    assert chunk.compression == "ZSTD" and not any("DICTIONARY" in e for e in chunk.encodings)
    plain = str(tmp_path / "plain")
    df.write.parquet(plain, compression="zstd")
    (other,) = (tmp_path / "plain").glob("part-*")
    assert part.stat().st_size < other.stat().st_size
    assert spark.read.parquet(path).exceptAll(df).count() == 0 and spark.read.parquet(path).count() == 60_000


def test_train_save_evaluate(spark, prepared, tmp_path):
    model = str(tmp_path / "model")
    trained = learn.train_model(spark, prepared.scaled, model, label=2, kind="rf")
    loaded = learn.evaluate_saved(spark, model, prepared.scaled, kind="RF")
    assert sorted(map(str, trained.collect())) == sorted(map(str, loaded.collect()))
    merged = learn.evaluate_saved(spark, model, prepared.scaled, merged=True)
    assert {r.label for r in merged.collect()} == {None, 0.0, 1.0}


@pytest.mark.parametrize("by_unit", [False, True])
def test_holdout(spark, prepared, by_unit):
    report = learn.train_with_holdout(spark, prepared.scaled, label=1, kind="rf", by_unit=by_unit)
    found = {(r.part, r.metric): r.value for r in report.where("label IS NULL").collect()}
    assert found["training", "accuracy"] > 0.6 and found["validation", "accuracy"] > 0.5


def test_frame_study(spark, texts):
    paths = texts[1]
    options = {"rf_weighted": {"numTrees": 5}, "gbt_weighted": {"maxIter": 2, "maxDepth": 3}, "lr_weighted": {"maxIter": 10}}
    cells = learn.frame_study(spark, paths["train"], paths["test"], paths["lines"], options=options)
    totals = {(r.kind, r.target, r.part): r.n for r in cells.groupBy("kind", "target", "part").agg(F.sum("n").alias("n")).collect()}
    rows = texts[0].count()
    assert len(totals) == 8
    assert all(n == rows for (_, _, part), n in totals.items() if part == "train")
    assert all(0 < n < rows for (_, _, part), n in totals.items() if part == "test")


def test_simple_example(spark, tmp_path):
    assert learn.simple_example(spark, str(tmp_path)) == 12
    table = spark.read.parquet(str(tmp_path / "simple_example.parquet"))
    assert sorted(map(tuple, table.collect()))[:2] == [(1, 1, 1), (1, 2, 11)]
    with pytest.raises(AnalysisException):
        learn.simple_example(spark, str(tmp_path))


def test_implicit_factor_job(spark, tmp_path):
    lines = [f"{u}\t{i}\t{(u + i) % 3 + 1}" for u in range(8) for i in range(6)]
    (tmp_path / "r.tsv").write_text("\n".join(lines) + "\n")
    learn.implicit_factors(spark, str(tmp_path / "r.tsv"), str(tmp_path / "out"), rank=3, iterations=2)
    text = "".join(gzip.open(p, "rt").read() for p in sorted((tmp_path / "out").glob("part-*.gz")))
    rows = dict(line.split("\t") for line in text.splitlines())
    assert set(rows) == {str(i) for i in range(6)}
    assert all(len(v.split(" ")) == 3 and len(v.split(" ")[0].split(".")[1]) == 6 for v in rows.values())


def test_libsvm_job(spark, tmp_path):
    df = spark.range(300).selectExpr("CAST(id % 3 AS DOUBLE) AS label", "array(double(id % 3), double(id % 3 = 1), rand(5)) AS a")
    from pyspark.ml.functions import array_to_vector

    sinks.write_libsvm(df.select("label", array_to_vector("a").alias("features")), str(tmp_path / "svm"))
    report = learn.libsvm_metrics(spark, str(tmp_path / "svm"))
    assert {r.metric: r.value for r in report.where("label IS NULL").collect()}["accuracy"] > 0.9

import gzip

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wearpath.operators import tables
from wearpath.session import shared_folder, work_path
from wearpath.sources import scans, sinks
from wearpath.spec import TelemetrySpec

SPEC = TelemetrySpec(settings=("p",), sensors=("q",))


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_ragged_and_broken_lines(spark, tmp_path):
    path = write(tmp_path / "t.txt", "1 1 0.5 2.5  ", "1 x 0.1 3", "1 4 0.1", "2 1 7 8 9 10")
    rows = {tuple(r) for r in scans.read_telemetry(spark, path, SPEC).collect()}
    assert rows == {(1, 1, 0.5, 2.5), (1, None, 0.1, 3.0), (1, 4, 0.1, None), (2, 1, 7.0, 8.0)}


def test_gzip_positional_columns(spark, tmp_path):
    with gzip.open(tmp_path / "t.txt.gz", "wt") as f:
        f.write("1 1 0.5\n1 2 0.7\n")
    df = scans.read_positional(spark, str(tmp_path / "t.txt.gz"), 3, partitions=2)
    assert df.columns == ["X1", "X2", "X3"] and df.count() == 2
    assert tables.rename(df, {"X1": "id"}).columns == ["id", "X2", "X3"]


def test_line_numbers_run_through_all_splits_of_a_file(spark, tmp_path):
    expected = {n: (n * 37) % 101 for n in range(1, 4001)}
    path = write(tmp_path / "truth.txt", *[f"{v} " for v in expected.values()])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in before:
            spark.conf.set(key, "1000")
        df = scans.read_truth_by_position(spark, path)
        assert df.rdd.getNumPartitions() > 1
        assert {r.id: r.RUL_at_maxcycle for r in df.collect()} == expected
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_line_numbers_per_file_and_over_files(spark, tmp_path):
    write(tmp_path / "a.txt", "5", "6")
    write(tmp_path / "b.txt", "7")
    per_file = scans.read_truth_by_position(spark, str(tmp_path))
    assert sorted((r.id, r.RUL_at_maxcycle) for r in per_file.collect()) == [(1, 5), (1, 7), (2, 6)]
    all_files = scans.read_truth_by_position(spark, str(tmp_path), per_file=False)
    assert sorted((r.id, r.RUL_at_maxcycle) for r in all_files.collect()) == [(1, 5), (2, 6), (3, 7)]


def test_ratings(spark, tmp_path):
    path = write(tmp_path / "r.tsv", "1\t10\t2.5", "2\tx\t1")
    rows = {tuple(r) for r in scans.read_ratings(spark, path).collect()}
    assert rows == {(1, 10, 2.5), (2, None, 1.0)}
    lines = spark.read.text(path)
    assert {tuple(r) for r in scans.ratings_from_lines(lines).collect()} == rows


def test_vectors_become_columns_in_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, Vectors.dense(0.5, 2.0)), (2, Vectors.sparse(2, [1], [9.0]))], ["id", "v"])
    sinks.write_csv(df.coalesce(1), str(tmp_path / "named"), {"v": ["x", "y"]})
    back = spark.read.csv(str(tmp_path / "named"), header=True, inferSchema=True)
    assert back.columns == ["id", "scaled_x", "scaled_y"]
    assert sorted(tuple(r) for r in back.collect()) == [(1, 0.5, 2.0), (2, 0.0, 9.0)]
    assert len(list((tmp_path / "named").glob("part-*"))) == 1
    sinks.write_csv(df.withColumn("a", F.array("id", "id")), str(tmp_path / "plain"))
    plain = spark.read.csv(str(tmp_path / "plain"), header=True).orderBy("id").first()
    assert (plain.v, plain.a) == ("0.5 2.0", "1 1")


def test_existing_output(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "out")
    sinks.write_parquet(df, path, fail_if_exists=True)
    sinks.write_parquet(df.limit(2), path)
    assert scans.read_prepared(spark, path).count() == 2
    with pytest.raises(AnalysisException):
        sinks.write_parquet(df, path, fail_if_exists=True)
    with pytest.raises(AnalysisException):
        sinks.write_csv(df, path, fail_if_exists=True)


def test_sets_by_pattern(spark, tmp_path):
    for name in ("FD001", "FD002"):
        sinks.write_parquet(spark.range(2), str(tmp_path / f"test_{name}"))
    df = scans.read_prepared_sets(spark, str(tmp_path / "test_*"))
    assert sorted(r.dataset for r in df.collect()) == ["FD001", "FD001", "FD002", "FD002"]
    both = scans.read_prepared(spark, [str(tmp_path / "test_FD001"), str(tmp_path / "test_FD002")])
    assert both.count() == 4


def test_libsvm(spark, tmp_path):
    df = spark.createDataFrame([(1.0, Vectors.dense(0.0, 3.0))], ["label", "features"])
    sinks.write_libsvm(df, str(tmp_path / "svm"))
    row = scans.read_libsvm(spark, str(tmp_path / "svm"), 2).first()
    assert row.label == 1.0 and row.features.toArray().tolist() == [0.0, 3.0]


def test_factor_text(spark, tmp_path):
    df = spark.createDataFrame([(7, [0.5, -1.25])], "id INT, features ARRAY<FLOAT>")
    sinks.write_factors(df.coalesce(1), str(tmp_path / "f"))
    (part,) = (tmp_path / "f").glob("part-*.gz")
    assert gzip.open(part, "rt").read() == "7\t0.500000 -1.250000\n"


def test_table_operations(spark):
    a = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.2)], "id INT, cycle INT, s1 DOUBLE")
    b = a.withColumn("rul", 2 - F.col("cycle"))
    joined = tables.natural_join(a, b)
    assert joined.columns == ["id", "cycle", "s1", "rul"] and joined.count() == 2
    assert tables.natural_join(a, b.withColumn("s1", F.lit(0.1)), float_keys=True).count() == 1
    with pytest.raises(ValueError):
        tables.natural_join(a, spark.range(1).toDF("other"))
    assert tables.append({"x": a, "y": a}).groupBy("dataset").count().count() == 2
    assert tables.units_of(a).count() == 1
    assert tables.rows_of_units(a, [1]).count() == 2


def test_work_paths_lie_in_the_session_folder(spark):
    assert work_path(spark, "x").startswith(f"{shared_folder(spark)}/wearpath/{spark.sparkContext.applicationId}/x-")
    assert work_path(spark, "x") != work_path(spark, "x")


def test_positional_types_are_those_of_the_text(spark, tmp_path):
    path = write(tmp_path / "p.txt", "1 abc 9007199254740993\nx 2.50 1")
    assert sorted(map(tuple, scans.read_positional(spark, path, 3, "string").collect())) == [("1", "abc", "9007199254740993"), ("x", "2.50", "1")]
    mixed = {tuple(r) for r in scans.read_positional(spark, path, 3, ["int", "string", "bigint"]).collect()}
    assert mixed == {(1, "abc", 9007199254740993), (None, "2.50", 1)}


def test_pattern_scan_leaves_side_outputs_out(spark, tmp_path):
    for name in ("test_FD001", "test_FD002", "test_FD001_unscaled"):
        spark.range(3).write.parquet(str(tmp_path / name))
    spark.range(3).write.csv(str(tmp_path / "test_FD001.csv"))
    found = scans.read_prepared_sets(spark, str(tmp_path / "test_*")).groupBy("dataset").count().collect()
    assert sorted(map(tuple, found)) == [("FD001", 3), ("FD002", 3)]


def test_lines_that_do_not_fit_are_kept_apart(spark, tmp_path):
    lines = ["1 1 0.5 2.5  ", "1 x 0.1 3", "1 4 0.1", "", "2 1 NA  7", "2 2 1e3 4 5 6", "1.5 2 1 1", " 1 1 1", "3 1 nan inf", "3 2 NaN -Inf"]
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("\n".join(lines) + "\n")
    spec = TelemetrySpec(settings=(), sensors=("p", "q"))
    parsed = scans.read_telemetry_lines(spark, str(tmp_path / "*.txt"), spec)
    kept, side = scans.quarantine(parsed, str(tmp_path / "out"))
    assert kept.columns == ["id", "cycle", "p", "q"] and kept.count() + side.count() == 3 * len(lines)
    reasons = {r.line: r.reason for r in side.collect()}
    assert reasons == {
        "1 x 0.1 3": "cycle is not int",
        "1 4 0.1": "q is missing",
        "": "id is missing; cycle is missing; p is missing; q is missing",
        "2 1 NA  7": "p is not double; q is missing",
        "1.5 2 1 1": "id is not int",
        " 1 1 1": "id is missing",
        "3 1 nan inf": "p is not double; q is not double",
    }
    assert len({r.file for r in side.collect()}) == 3 and side.where("row IS NULL OR block IS NULL").count() == 0
    known = scans.read_telemetry(spark, str(tmp_path / "0.txt"), spec).where("id IS NOT NULL AND cycle IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL")
    assert sorted(map(str, known.collect())) == sorted(map(str, kept.where("true").distinct().collect()))
    only_key = scans.read_telemetry_lines(spark, str(tmp_path / "0.txt"), spec, required=["id", "cycle"])
    assert only_key.where("reason IS NULL").count() == 6

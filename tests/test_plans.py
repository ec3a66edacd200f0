"""The physical plans the operators are meant to have."""

import re

import pytest
from pyspark.sql import functions as F

from wearpath.operators import explore, features, rul
from wearpath.operators.rolling import rolling_by_unit
from wearpath.operators.sequence import find_long_units
from wearpath.plans import fixtures as fx
from wearpath.plans.catalog import QUERIES, _scaled
from wearpath.plans.prepare import enrich
from wearpath.spec import TelemetrySpec

SPEC = TelemetrySpec(settings=(), sensors=("s1", "s2"))

#: Queries that only build a plan, so that it can be looked at without running jobs.
LAZY = [n for n in QUERIES if re.match(r"(a\d|p\d|w\d|j\d|l[1345]|l6|u\d|m3_minmax$|flagship)", n) and "p10" not in n]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"Exchange hashpartitioning", text))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "telemetry")
    df = spark.range(5000).selectExpr(
        "CAST(id % 50 AS INT) AS id", "CAST(id / 50 AS INT) AS cycle", "rand(1) AS s1", "rand(2) AS s2", "rand(3) AS s3"
    )
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_one_shuffle_and_one_sort_serve_life_labels_and_rolling(stored):
    text = plan(enrich(stored, SPEC))
    assert exchanges(text) == 1
    assert len(re.findall(r"- Sort ", text)) == 1
    assert "Join" not in text
    assert "PushedFilters: [IsNotNull(id)]" in text


def test_a_large_truth_table_is_merged_in_the_same_partitioning(spark, stored):
    truth = stored.groupBy("id").agg(F.max("cycle").alias("RUL_at_maxcycle"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(enrich(stored, SPEC, truth))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text
    assert exchanges(text) == 2  # telemetry once, truth once


def test_long_units_leave_no_window_over_a_whole_unit(stored):
    units = find_long_units(stored, ["id"], "cycle", rows_per_task=10)
    assert units.table.count() == 50
    text = plan(rolling_by_unit(stored, SPEC, long_units=units))
    sliced = [m for m in re.findall(r"Window \[avg.*?\], \[(.*?)\]", text)]
    assert any("_slice" in keys for keys in sliced)


def test_scans_read_only_what_is_used(stored):
    for df, columns in (
        (explore.describe(stored, ["s1"]), "struct<s1:double>"),
        (explore.density(stored, "s2", [0.0, 1.0], 0.5), "struct<s2:double>"),
        (features.class_weights(rul.add_labels(stored.withColumn("rul", F.col("cycle"))), "label2"), "struct<cycle:int>"),
        (rul.last_cycle_per_unit(stored), "struct<id:int,cycle:int>"),
    ):
        assert set(re.findall(r"ReadSchema: (\S+)", plan(df))) == {columns}


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_row_by_row_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for forbidden in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "MapInPandas"):
        assert forbidden not in text


def test_only_the_fixture_shuffle_for_the_flagship(spark, sf_dir):
    df, units = fx.telemetry(spark, sf_dir, SPEC)
    assert exchanges(plan(enrich(df, SPEC, long_units=units))) == 1


def test_a_data_set_reads_its_own_files(spark):
    from wearpath.plans.prepare import _typed

    df = spark.range(40).selectExpr("CAST(id % 4 AS STRING) AS dataset", "CAST(id AS INT) AS id", "1.0D AS s1")
    typed, path = _typed(spark, df, ["dataset"])
    assert typed.dtypes == df.dtypes and typed.count() == 40
    own = typed.where("dataset = '2'")
    assert own.count() == 10 and {f.split("/")[-2] for f in own.select("_metadata.file_path").distinct().toPandas()["file_path"]} == {"dataset=2"}
    assert "PartitionFilters: [isnotnull(dataset" in own._jdf.queryExecution().executedPlan().toString()


def test_scaled_table_runs_its_windows_once(spark, sf_dir):
    """The scale and the result read one written table."""
    text = plan(_scaled(fx.labelled(spark, sf_dir, SPEC), SPEC))
    assert "Window" not in text and "Scan parquet" in text.replace("FileScan", "Scan")

"""Long units must give the same rows as ordinary ones, whatever their share and their gaps."""

import random

import pytest
from helpers import assert_same, brute_rolling, rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from wearpath.operators.rolling import rolling_by_mode, rolling_by_unit
from wearpath.operators.rul import add_labels, rul_from_run_to_failure, rul_from_truth, with_last_cycle
from wearpath.operators.sequence import find_long_units, number_rows, time_part, window_in_slices
from wearpath.plans.prepare import enrich
from wearpath.spec import TelemetrySpec

SPEC = TelemetrySpec(settings=(), sensors=("s1", "s2"))


def skewed_rows(seed=5, rows=900):
    """A third of the rows is unit 0; cycles have gaps; one sensor has unknown values."""
    rng = random.Random(seed)
    table, cycles = [], {}
    for n in range(rows):
        unit = 0 if n % 3 == 0 else 1 + n % 25
        cycles[unit] = cycles.get(unit, 0) + rng.choice([1, 1, 1, 2, 9])
        table.append((unit, cycles[unit], rng.uniform(0, 9), None if rng.random() < 0.1 else rng.random()))
    rng.shuffle(table)
    return table


@pytest.fixture(scope="module")
def skewed(spark):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "id INT, cycle INT, s1 DOUBLE, s2 DOUBLE").repartition(5).cache()
    return rows, df


def test_only_long_units_are_reported(skewed):
    _, df = skewed
    assert find_long_units(df, ["id"], "cycle", 10_000).table is None
    units = find_long_units(df, ["id"], "cycle", 100)
    assert [r.id for r in units.table.collect()] == [0]
    assert units.small


def test_too_many_long_units_are_not_broadcast(skewed):
    _, df = skewed
    units = find_long_units(df, ["id"], "cycle", 5, broadcast_limit=3)
    assert not units.small
    assert_same(enrich(df, SPEC, long_units=units), enrich(df, SPEC), ["id", "cycle"])


@pytest.mark.parametrize("rows_per_task", [1, 3, 17, 100, 10_000])
def test_rolling_matches_brute_force(skewed, rows_per_task):
    rows, df = skewed
    result = rolling_by_unit(df, SPEC, rows_per_task=rows_per_task)
    found = {(r.id, r.cycle): r for r in result.collect()}
    assert len(found) == len(rows)
    for sensor, place in (("1", 2), ("2", 3)):
        brute = brute_rolling(rows, lambda r: r[0], lambda r: r[1], lambda r: r[place], -4, 0, 5)
        for index, (mean, dev) in brute.items():
            row = found[rows[index][:2]]
            assert row["a" + sensor] == pytest.approx(mean, abs=1e-9)
            assert row["sd" + sensor] == pytest.approx(dev, abs=1e-9)


@pytest.mark.parametrize("mode", ["literal", "population", "full"])
@pytest.mark.parametrize("frame", [(-4, 0), (0, 5), (-2, 3)])
def test_sliced_frames_equal_plain_frames(skewed, mode, frame):
    _, df = skewed
    options = {"start": frame[0], "stop": frame[1], "mode": mode}
    assert_same(
        rolling_by_unit(df, SPEC, rows_per_task=7, **options),
        rolling_by_unit(df, SPEC, **options),
        ["id", "cycle"],
    )


@pytest.mark.parametrize("rows_per_task", [4, 50, 10_000])
def test_forward_rolling_by_mode_matches_brute_force(skewed, rows_per_task):
    rows, df = skewed
    mode = lambda unit: 0 if unit == 0 else unit % 3
    with_mode = df.withColumn("operationmode", F.when(F.col("id") == 0, 0).otherwise(F.col("id") % 3).cast("int"))
    result = rolling_by_mode(with_mode, SPEC, rows_per_task=rows_per_task, units_per_block=4)
    found = {(r.id, r.cycle): r for r in result.collect()}
    brute = brute_rolling(rows, lambda r: mode(r[0]), lambda r: r[:2], lambda r: r[2], 0, 5, 5)
    assert len(found) == len(rows)
    for index, (mean, dev) in brute.items():
        row = found[rows[index][:2]]
        assert row.a1 == pytest.approx(mean, abs=1e-9)
        assert row.sd1 == pytest.approx(dev, abs=1e-9)


def test_life_and_labels_of_long_units(skewed):
    _, df = skewed
    keys = ["id", "cycle"]
    assert_same(with_last_cycle(df, SPEC, rows_per_task=9), with_last_cycle(df, SPEC), keys)
    assert_same(
        add_labels(rul_from_run_to_failure(df, SPEC, rows_per_task=9)), add_labels(rul_from_run_to_failure(df, SPEC)), keys
    )
    truth = df.select("id").distinct().where("id != 3").withColumn("RUL_at_maxcycle", F.col("id") + 5)
    assert_same(
        rul_from_truth(df, truth, SPEC, rows_per_task=9), rul_from_truth(df, truth, SPEC), keys
    )


def test_numbering_by_time(spark):
    rng = random.Random(3)
    rows = [(0 if n % 3 else n % 7, 1_700_000_000 + rng.randrange(100_000), n) for n in range(600)]
    df = spark.createDataFrame(rows, "unit INT, seconds LONG, event INT")
    for kind in ("timestamp", "timestamp_ntz"):
        timed = df.withColumn("ts", F.timestamp_seconds("seconds").cast(kind)).drop("seconds")
        plain = number_rows(timed, ["unit"], ["ts", "event"], "n")
        assert_same(number_rows(timed, ["unit"], ["ts", "event"], "n", rows_per_task=13), plain, ["unit", "n"])
        assert dict(plain.dtypes)["n"] == "int"


def test_rows_without_time_are_kept(spark):
    rows = [(1, c) for c in range(1, 40)] + [(1, None)]
    df = spark.createDataFrame(rows, "id INT, cycle INT")
    numbered = number_rows(df, ["id"], ["cycle"], "n", rows_per_task=6)
    found = {r.cycle: r.n for r in numbered.collect()}
    assert found[None] == 1 and found[1] == 2 and found[39] == 40


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    size=st.integers(1, 60), rows_per_task=st.integers(1, 12), behind=st.integers(0, 9), ahead=st.integers(0, 9)
)
def test_slices_of_any_size(spark, size, rows_per_task, behind, ahead):
    df = spark.range(1, size + 1).select(F.lit(1).alias("id"), F.col("id").cast("int").alias("n"))

    def compute(table, window):
        frame = window.rowsBetween(-behind, ahead)
        return table.withColumns({"lo": F.min("n").over(frame), "hi": F.max("n").over(frame)})

    sliced = window_in_slices(df, ["id"], "n", behind, ahead, rows_per_task, compute)
    assert_same(sliced, compute(df, Window.partitionBy("id").orderBy("n")), ["n"])


def test_row_order_does_not_matter(skewed):
    _, df = skewed
    assert rows_of(rolling_by_unit(df.orderBy("s1"), SPEC), ["id", "cycle"]) == rows_of(
        rolling_by_unit(df, SPEC), ["id", "cycle"]
    )


def test_text_keys_raise_at_every_size(spark):
    df = spark.createDataFrame([(i % 3, str(i), float(i), 1) for i in range(30)], "id INT, cycle STRING, s1 DOUBLE, operationmode INT")
    for limit in (5, 500_000):
        with pytest.raises(TypeError):
            rolling_by_unit(df, SPEC, rows_per_task=limit)
        with pytest.raises(TypeError):
            rolling_by_mode(df.selectExpr("CAST(id AS STRING) id", "CAST(cycle AS INT) cycle", "s1", "operationmode"), SPEC, rows_per_task=limit)


def test_one_wrong_clock_leaves_parts_even(spark):
    """Rows a second apart and one row decades before: no part holds more than a task's rows."""
    rows = [(1, 1_700_000_000 + i, i) for i in range(20_000)] + [(1, 0, -1)]
    df = spark.createDataFrame(rows, "unit INT, seconds LONG, event INT").withColumn("ts", F.timestamp_seconds("seconds"))
    units = find_long_units(df, ["unit"], "ts", 1_000)
    _, long = units.split(df)
    parts = long.groupBy(time_part(long, "ts", 1_000)).count().agg(F.max("count"), F.count("*")).first()
    assert parts[0] <= 2_000 and parts[1] >= 20
    assert_same(number_rows(df, ["unit"], ["ts"], "n", rows_per_task=1_000), number_rows(df, ["unit"], ["ts"], "n"), ["unit", "event"])


def test_rows_without_unit_are_dropped(spark):
    df = spark.createDataFrame([(None if i % 2 else 1, i) for i in range(40)], "id INT, cycle INT")
    for limit in (6, 500_000):
        assert number_rows(df, ["id"], ["cycle"], "n", rows_per_task=limit).count() == 20

"""Telemetry, truth, ratings and predictions derived from the test tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearpath.functions.names import numbered
from wearpath.operators.rul import truncate_steps, truth_of_truncation
from wearpath.operators.sequence import LongUnits, UnitStep, find_long_units, number_step, run_per_unit
from wearpath.plans.prepare import label_steps
from wearpath.spec import TelemetrySpec

SPEC = TelemetrySpec()
#: Settings and two sensors, for queries that need no more.
NARROW = TelemetrySpec(sensors=("s1", "s2"))
#: Sensors read from line items.
LINE_SPEC = TelemetrySpec(settings=(), sensors=("s1", "s2", "s3"))

#: Share of its cycles a test unit has run.
TEST_SHARE = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(
    df: DataFrame, order: list[str], columns: list[Column], steps: Sequence[UnitStep]
) -> tuple[DataFrame, LongUnits]:
    """Number the rows of each ``id`` as cycles, keep ``columns``, then run further steps per unit."""
    units = find_long_units(df, ["id"], order[0])

    def ordinary(rows):
        return rows.select("id", "cycle", *columns)

    def long(rows, _):
        # From here on the time axis is the cycle, which runs from 1 to the number of rows.
        return rows.select("id", "cycle", *columns, "_n", F.lit(1).alias("_lo"), F.col("_n").alias("_hi"))

    numbering = [number_step(["id"], order, "cycle"), UnitStep(ordinary, long)]
    return run_per_unit(df, ["id"], order[0], [*numbering, *steps], units), units.renamed(["id"])


def telemetry(
    spark: SparkSession, sf_dir: str, spec: TelemetrySpec = SPEC, steps: Sequence[UnitStep] = ()
) -> tuple[DataFrame, LongUnits]:
    """Events as telemetry: a user is a unit, its events in time order are cycles 1..n.

    Returns the table, after further steps if any, and its long units.
    """
    events = table(spark, sf_dir, "events").where(F.col("user_id").isNotNull())
    events = events.withColumn("id", F.col("user_id").cast("int"))
    k, value = F.get_json_object("props", "$.k").cast("double"), F.col("value")
    sensors = {"s1": value, "s2": value * k, "s21": F.lit(8.5)}
    for i in range(3, 21):
        sensors[f"s{i}"] = value * F.lit(float(i % 5 + 1)) + k * F.lit(float(i % 7))
    settings = {
        "setting1": F.hour("ts").cast("double"),
        "setting2": k,
        "setting3": F.lit(100.0),
    }
    columns = [*[settings[c].alias(c) for c in spec.settings], *[sensors[c].alias(c) for c in spec.sensors]]
    return _numbered(events, ["ts", "event_id"], columns, steps)


def labelled(spark: SparkSession, sf_dir: str, spec: TelemetrySpec = SPEC) -> DataFrame:
    """Telemetry with life and labels."""
    return telemetry(spark, sf_dir, spec, label_steps(spec))[0]


def cut(
    spark: SparkSession, sf_dir: str, spec: TelemetrySpec = SPEC, steps: Sequence[UnitStep] = ()
) -> DataFrame:
    """Telemetry that ends before failure, as a test set does."""
    return telemetry(spark, sf_dir, spec, [*truncate_steps(TEST_SHARE, spec), *steps])[0]


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The life left after the last cycle of ``cut``."""
    return truth_of_truncation(telemetry(spark, sf_dir, TelemetrySpec(settings=(), sensors=()))[0], TEST_SHARE)


def line_telemetry(spark: SparkSession, sf_dir: str, steps: Sequence[UnitStep] = ()) -> DataFrame:
    """Line items as telemetry: a supplier is a unit, its lines in shipping order are cycles."""
    columns = ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_suppkey").isNotNull())
    lines = lines.select(F.col("l_suppkey").cast("int").alias("id"), *columns)
    sensors = [F.col(c).alias(s) for s, c in zip(LINE_SPEC.sensors, columns[3:])]
    return _numbered(lines, columns, sensors, steps)[0]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label2 against a fixed threshold rule on the first sensor."""
    df = labelled(spark, sf_dir, TelemetrySpec(settings=(), sensors=("s1",)))
    rule = F.when(F.col("s1") < 33, 2).when(F.col("s1") < 66, 1).otherwise(0)
    return df.select("id", "cycle", F.col("label2").cast("double").alias("label"), rule.cast("double").alias("prediction"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer ordered of each part, as implicit feedback."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item"))
        .agg(F.sum("l_quantity").cast("float").alias("rating"))
    )


SETTING_NAMES = list(SPEC.settings)
SENSOR_NAMES = list(SPEC.sensors)
MEAN_NAMES = list(numbered("a", 21))
DEV_NAMES = list(numbered("sd", 21))

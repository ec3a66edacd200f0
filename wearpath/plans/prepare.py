"""Preparation jobs: telemetry text in, prepared Parquet (and CSV) out.

A job parses the text once, into a typed work table; modes are fitted on three of its columns and
long units measured on two. It writes the relational result once, as ``<output>_unscaled``, deletes
the work table and fits the scaler on what it reads back. So neither text nor windows are
computed again for each fit and each output, and a lost executor costs a few file splits.

Rows without a key are rejected first. Life and labels are computed from all other rows, as the last
cycle of a unit counts even if a sensor failed in it. Then rows that miss a setting or sensor are
rejected, and rolling frames run over the rows that are left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearpath.functions.scalar import with_values
from wearpath.operators.features import (
    NOT_FEATURES,
    apply_scaler,
    feature_columns,
    fit_scaler,
    one_hot,
    reject_incomplete,
    scaler_columns,
)
from wearpath.operators.modes import MODES, add_modes, fit_modes
from wearpath.operators.rolling import rolling_by_mode, rolling_step
from wearpath.operators.rul import add_labels, rul_steps
from wearpath.operators.sequence import ROWS_PER_TASK, LongUnits, UnitStep, row_step, run_per_unit
from wearpath.sources.scans import read_prepared, read_telemetry, read_telemetry_sets, read_truth
from wearpath.sources.sinks import write_csv as to_csv
from wearpath.sources.sinks import write_parquet
from wearpath.session import delete_path, work_path
from wearpath.spec import TURBOFAN, TURBOFAN_CYKLE, TelemetrySpec

#: Most rows of a table whose CSV is plain text, to be looked at by hand; that of a larger one is gzip.
PLAIN_ROWS = 200_000


@dataclass(frozen=True)
class Prepared:
    """Where a preparation job wrote its tables, and the stages fitted on the way."""

    scaled: str
    unscaled: str
    modes: PipelineModel
    scaler: PipelineModel
    mode_feature: str = "number"
    rows_read: int | None = None
    rows_kept: int | None = None

    def save(self, path: str) -> None:
        """Keep the fitted stages, for a preparation in another session (``load_prepared``)."""
        spark = SparkSession.active()
        self.modes.write().overwrite().save(f"{path}/modes")
        self.scaler.write().overwrite().save(f"{path}/scaler")
        facts = (self.scaled, self.unscaled, self.mode_feature, self.rows_read, self.rows_kept)
        table = spark.createDataFrame([facts], "scaled STRING, unscaled STRING, mode_feature STRING, rows_read BIGINT, rows_kept BIGINT")
        table.coalesce(1).write.mode("overwrite").json(f"{path}/facts")

    @property
    def rows_rejected(self) -> int | None:
        return None if self.rows_read is None else self.rows_read - self.rows_kept


def load_prepared(spark: SparkSession, path: str) -> Prepared:
    """What ``Prepared.save`` wrote."""
    facts = spark.read.schema("scaled STRING, unscaled STRING, mode_feature STRING, rows_read BIGINT, rows_kept BIGINT").json(f"{path}/facts").first()
    modes, scaler = (PipelineModel.load(f"{path}/{stage}") for stage in ("modes", "scaler"))
    return Prepared(facts.scaled, facts.unscaled, modes, scaler, facts.mode_feature, facts.rows_read, facts.rows_kept)


def _with_mode_feature(df: DataFrame, mode_feature: str) -> tuple[DataFrame, list[str]]:
    """The table with the operation mode as wanted, and its feature columns."""
    if mode_feature == "one_hot":
        df = one_hot(df, "operationmode", range(MODES))
    elif mode_feature not in ("number", "exclude"):
        raise ValueError(f"mode_feature must be 'number', 'exclude' or 'one_hot', not {mode_feature!r}")
    left_out = ["operationmode"] if mode_feature == "exclude" else []
    return df, feature_columns(df, [*NOT_FEATURES, *left_out])


def label_steps(spec: TelemetrySpec = TURBOFAN, truth: DataFrame | None = None) -> list[UnitStep]:
    """Remaining life (from truth if given), then both labels."""
    return [*rul_steps(spec, truth), row_step(add_labels)]


def label_telemetry(
    df: DataFrame,
    spec: TelemetrySpec = TURBOFAN,
    truth: DataFrame | None = None,
    long_units: LongUnits | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    then: Sequence[UnitStep] = (),
) -> DataFrame:
    """Life and labels, and further steps per unit."""
    df = with_values(df, spec.unit)
    return run_per_unit(df, spec.unit, spec.time, [*label_steps(spec, truth), *then], long_units, rows_per_task)


def _complete_with_modes(spec: TelemetrySpec, modes: PipelineModel) -> UnitStep:
    """Reject rows that miss a measure and add the mode to the others, after the measures."""

    def step(df: DataFrame) -> DataFrame:
        scored = add_modes(reject_incomplete(df, spec.measures), modes)
        added = [c for c in scored.columns if c not in df.columns]
        last = 1 + max(df.columns.index(c) for c in [*spec.key, *spec.measures])
        return scored.select(*df.columns[:last], *added, *df.columns[last:])

    return row_step(step)


def _typed(spark: SparkSession, df: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """The parsed table, written once, and its path; a filter on a column of ``by`` reads its own files only."""
    path = work_path(spark, "typed")
    write_parquet(df, path, partition_by=by)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns), path


def enrich(
    df: DataFrame,
    spec: TelemetrySpec = TURBOFAN,
    truth: DataFrame | None = None,
    long_units: LongUnits | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    between: Sequence[UnitStep] = (),
) -> DataFrame:
    """Life, labels, steps ``between``, trailing mean and deviation: one shuffle by unit serves all of them."""
    return label_telemetry(df, spec, truth, long_units, rows_per_task, [*between, rolling_step(spec)])


def _finish(
    unscaled: DataFrame,
    output: str,
    modes: PipelineModel,
    scaler: PipelineModel | None,
    write_csv: bool,
    mode_feature: str = "number",
    rows_read: int | None = None,
    typed: str | None = None,
) -> Prepared:
    """Stage the unscaled table, after which its work table at ``typed`` goes, scale it, write the outputs."""
    spark, staged = unscaled.sparkSession, f"{output}_unscaled"
    write_parquet(unscaled, staged)
    if typed:
        delete_path(spark, typed)
    table, columns = _with_mode_feature(read_prepared(spark, staged), mode_feature)
    scaler = scaler or fit_scaler(table, columns)
    scaled = apply_scaler(table, scaler)
    write_parquet(scaled, output)
    if write_csv:
        names = {"scaledFeatures": scaler_columns(scaler)}
        compression = "gzip" if rows_read and rows_read > PLAIN_ROWS else None
        to_csv(read_prepared(spark, output), f"{output}.csv", names, compression=compression)
        to_csv(table, f"{output}_unscaled.csv", compression=compression)
    return Prepared(output, staged, modes, scaler, mode_feature, rows_read, read_prepared(spark, staged).count())


def prepare_train(
    spark: SparkSession,
    input: str,
    output: str,
    spec: TelemetrySpec = TURBOFAN,
    write_csv: bool = True,
    seed: int | None = None,
    mode_feature: str = "number",
) -> Prepared:
    """Run-to-failure telemetry -> prepared table.

    ``mode_feature``: the operation mode is a feature as a ``number``, as ``one_hot`` columns, or is
    left out (``exclude``).
    """
    typed, path = _typed(spark, read_telemetry(spark, input, spec))
    try:
        df = reject_incomplete(typed, spec.key)
        modes = fit_modes(reject_incomplete(df, spec.settings), spec, seed=seed)
        table = enrich(df, spec, between=[_complete_with_modes(spec, modes)])
        return _finish(table, output, modes, None, write_csv, mode_feature, typed.count(), path)
    finally:
        delete_path(spark, path)


def prepare_test(
    spark: SparkSession,
    input: str,
    truth: str,
    output: str,
    fitted: Prepared | str | None = None,
    spec: TelemetrySpec = TURBOFAN,
    write_csv: bool = False,
    seed: int | None = None,
    mode_feature: str = "number",
) -> Prepared:
    """Truncated telemetry + truth -> prepared table.

    Give the ``fitted`` training run, or the path it was saved to, to use its modes and scale;
    without it both are fitted anew on the test table, and their numbers do not compare with the
    training table's.
    """
    if isinstance(fitted, str):
        fitted = load_prepared(spark, fitted)
    typed, path = _typed(spark, read_telemetry(spark, input, spec))
    try:
        df = reject_incomplete(typed, spec.key)
        modes = fitted.modes if fitted else fit_modes(reject_incomplete(df, spec.settings), spec, seed=seed)
        table = enrich(df, spec, read_truth(spark, truth), between=[_complete_with_modes(spec, modes)])
        scaler, mode_feature = (fitted.scaler, fitted.mode_feature) if fitted else (None, mode_feature)
        return _finish(table, output, modes, scaler, write_csv, mode_feature, typed.count(), path)
    finally:
        delete_path(spark, path)


def prepare_forward(
    spark: SparkSession,
    input: str,
    output: str,
    spec: TelemetrySpec = TURBOFAN_CYKLE,
    truth: str | None = None,
    seed: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> Prepared:
    """The second preparation: rolling forward within each operation mode.

    Without ``truth`` the series must run to failure, as life is counted to their last cycle.
    """
    typed, path = _typed(spark, read_telemetry(spark, input, spec))
    try:
        df = reject_incomplete(typed, spec.key)
        modes = fit_modes(reject_incomplete(df, spec.settings), spec, seed=seed)
        life = read_truth(spark, truth) if truth else None
        labelled = label_telemetry(df, spec, life, then=[_complete_with_modes(spec, modes)])
        rolled = rolling_by_mode(labelled, spec, rows_per_task=rows_per_task)
        return _finish(rolled, output, modes, None, write_csv=False, rows_read=typed.count(), typed=path)
    finally:
        delete_path(spark, path)


def prepare_sets(
    spark: SparkSession,
    inputs: Mapping[str, str],
    output: str,
    truths: Mapping[str, str] | None = None,
    spec: TelemetrySpec = TURBOFAN,
    seed: int | None = None,
    fitted: Mapping[str, Prepared | str] | None = None,
) -> str:
    """Several data sets at once, written by ``dataset``; units are keyed by (dataset, id).

    Modes and scale are fitted per set, as separate runs would, or taken from the training run of
    the same name in ``fitted`` (a run or its saved path; its mode must be a number feature); life,
    labels and rolling columns are computed for all sets together.
    """
    runs = {n: load_prepared(spark, run) if isinstance(run, str) else run for n, run in (fitted or {}).items()}
    if any(run.mode_feature != "number" for run in runs.values()):
        raise ValueError("prepare_sets needs training runs with the mode as a number")
    keyed = spec.with_dataset()
    typed, path = _typed(spark, read_telemetry_sets(spark, inputs, spec), ["dataset"])
    df = reject_incomplete(typed, keyed.key)

    def each_set(table, step):
        return reduce(
            DataFrame.unionByName, [step(table.where(F.col("dataset") == name), runs.get(name)) for name in inputs]
        )

    # a row that misses a measure keeps its place in the unit's life, without a mode, until life is known
    whole = reject_incomplete(df, spec.measures)
    modes = each_set(whole, lambda part, run: add_modes(part, run.modes if run else fit_modes(part, spec, seed=seed)))
    rest = df.where(~reduce(and_, [F.col(c).isNotNull() for c in spec.measures]))
    with_modes = modes.unionByName(rest, allowMissingColumns=True)
    truth = None
    if truths is not None:
        truth = reduce(
            DataFrame.unionByName,
            [read_truth(spark, path).withColumn("dataset", F.lit(name)) for name, path in truths.items()],
        )
    complete = row_step(lambda rows: reject_incomplete(rows, spec.measures))
    table = enrich(with_modes, keyed, truth, between=[complete])
    try:
        write_parquet(table, f"{output}_unscaled", partition_by=["dataset"])
    finally:
        delete_path(spark, path)
    table = read_prepared(spark, f"{output}_unscaled")
    columns = feature_columns(table)
    scaled = each_set(table, lambda part, run: apply_scaler(part, run.scaler if run else fit_scaler(part, columns)))
    write_parquet(scaled, output, partition_by=["dataset"])
    return output


def toy_run(
    spark: SparkSession, train: str, test: str, truth: str, output: str, seed: int | None = None
) -> tuple[Prepared, Prepared]:
    """Prepare a small train and test set, with CSV files to look at by hand."""
    fitted = prepare_train(spark, train, f"{output}/toy_train", seed=seed)
    tested = prepare_test(spark, test, truth, f"{output}/toy_test", fitted, write_csv=True)
    return fitted, tested

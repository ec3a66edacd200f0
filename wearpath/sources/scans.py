"""Table scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearpath.functions.names import numbered
from wearpath.functions.scalar import fields_of
from wearpath.spec import RATINGS_SCHEMA, TRUTH_SCHEMA, TURBOFAN, TelemetrySpec


def _text_table(spark: SparkSession, path: str | list[str], schema: T.StructType | str, separator: str) -> DataFrame:
    return spark.read.schema(schema).options(header=False, sep=separator, mode="PERMISSIVE").csv(path)


def read_telemetry(spark: SparkSession, path: str | list[str], spec: TelemetrySpec = TURBOFAN) -> DataFrame:
    """Blank-separated telemetry without header; gzip is read as it is.

    Surplus fields of a line are dropped, missing ones are NULL, and a field that does not fit its
    type is NULL. Keys are not enforced: use ``reject_incomplete``.
    """
    return _text_table(spark, path, spec.schema(), " ")


def read_telemetry_lines(spark: SparkSession, path: str | list[str], spec: TelemetrySpec = TURBOFAN, required: Sequence[str] | None = None) -> DataFrame:
    """Telemetry lines with what is wrong with them, as ``read_telemetry`` types them.

    Beside the columns: ``line``, ``reason`` (NULL if the line is whole, else each required column
    that is missing or not of its type; all columns are required unless named), ``file``,
    ``block`` (the byte at which the part of the file begins that was read with the line) and
    ``row`` (the order of lines within one reading task). Surplus fields are no fault; an empty line misses all.
    """
    schema = spec.schema()
    parts = F.split("value", " ")
    need = [f.name for f in schema] if required is None else list(required)
    tokens = {f.name: F.nullif(F.get(parts, F.lit(i)), F.lit("")) for i, f in enumerate(schema)}
    words = ("NaN", "Inf", "-Inf", "Infinity", "-Infinity")  # the only spellings that the table scan takes
    plain = {n: F.when(t.isin(*words) | ~t.rlike("(?i)nan|inf"), t) for n, t in tokens.items()}
    typed = {f.name: plain[f.name].try_cast(f.dataType) for f in schema}
    faults = [
        F.when(tokens[f.name].isNull(), f"{f.name} is missing").when(typed[f.name].isNull(), f"{f.name} is not {f.dataType.simpleString()}")
        for f in schema
        if f.name in need
    ]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")
    )
    reason = F.nullif(F.concat_ws("; ", *faults), F.lit(""))
    return lines.select(*[c.alias(n) for n, c in typed.items()], F.col("value").alias("line"), reason.alias("reason"), "file", "block", "row")


def quarantine(lines: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the result of ``read_telemetry_lines`` once: whole rows, and the side table of (line, reason, file, block, row).

    Both lie under ``path``, as ``rejected=false`` and ``rejected=true``, from one pass over the
    text: what is kept and what is quarantined add up to what was read.
    """
    side = ["line", "reason", "file", "block", "row"]
    kept = [c for c in lines.columns if c not in side]
    whole = F.col("reason").isNull()
    rows = lines.select(*kept, *[F.when(~whole, F.col(c)).alias(c) for c in side], (~whole).alias("rejected"))
    rows.write.partitionBy("rejected").parquet(path)
    back = lines.sparkSession.read.schema(rows.schema).parquet(path)
    return back.where(~F.col("rejected")).select(*kept), back.where("rejected").select(*side)


def read_truth(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Blank-separated truth (unit, life after the last cycle) without header."""
    return _text_table(spark, path, TRUTH_SCHEMA, " ")


def read_positional(
    spark: SparkSession,
    path: str | list[str],
    columns: int,
    kind: str | Sequence[str] = "double",
    separator: str = " ",
    partitions: int | None = None,
) -> DataFrame:
    """Headerless text with columns named ``X1..Xn``.

    ``kind`` is the type of all columns, or a list with the type of each; a field that does not
    fit is NULL. A gzip file is one task, whatever its size; ``partitions`` spreads its rows
    afterwards.
    """
    kinds = [kind] * columns if isinstance(kind, str) else list(kind)
    if len(kinds) != columns:
        raise ValueError(f"{columns} columns need as many types, not {len(kinds)}")
    schema = ", ".join(f"{c} {k}" for c, k in zip(numbered("X", columns), kinds))
    table = _text_table(spark, path, schema, separator)
    return table.repartition(partitions) if partitions else table


def read_truth_by_position(
    spark: SparkSession, path: str | list[str], per_file: bool = True, name: str = "RUL_at_maxcycle"
) -> DataFrame:
    """Truth lines without unit number: the unit is the 1-based line number.

    Lines are counted per file, or through all files in path order. A file may be read in many
    splits: each split is counted, and only these counts are ordered.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("value"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
        )
        .withColumn("_line", F.monotonically_increasing_id())
    )
    splits = lines.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first")
    )
    order = Window.partitionBy("_file").orderBy("_start") if per_file else Window.orderBy("_file", "_start")
    earlier = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = splits.withColumn("_before", F.coalesce(earlier, F.lit(0))).drop("_n")
    number = F.col("_before") + F.col("_line") - F.col("_first") + 1
    value = F.get(F.split(F.trim("value"), " "), F.lit(0)).try_cast("int")
    return lines.join(placed, ["_file", "_start"]).select(
        number.cast("int").alias("id"), value.alias(name), F.col("_file").alias("file")
    )


def read_ratings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated (user, item, rating) without header."""
    return _text_table(spark, path, RATINGS_SCHEMA, "\t")


def ratings_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a column of text lines; fields that do not fit are NULL."""
    kinds = [f.dataType.simpleString() for f in RATINGS_SCHEMA]
    parts = fields_of(F.col(column), "\t", kinds)
    return lines.select(*[p.alias(f.name) for p, f in zip(parts, RATINGS_SCHEMA)])


def read_prepared(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_prepared_sets(spark: SparkSession, pattern: str, tag: str = "dataset") -> DataFrame:
    """Prepared sets by a path pattern such as ``.../test_*``.

    ``dataset`` is what follows the last ``_`` in the name of the folder a row came from. The
    unscaled tables and CSV exports that the jobs write beside a prepared set are left out.
    """
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(pattern)
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
    paths = sorted(str(f.getPath()) for f in found)
    sets = [p for p in paths if not p.endswith(("_unscaled", ".csv"))]
    if not sets:
        raise FileNotFoundError(f"no prepared set under {pattern}")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.parquet(*sets).withColumn(tag, F.element_at(F.split(folder, "_"), -1))


def read_libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """LIBSVM text as (label, features). Give the number of features to spare a counting pass."""
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", str(features)) if features else reader).load(path)


def read_telemetry_sets(
    spark: SparkSession, paths: Mapping[str, str], spec: TelemetrySpec = TURBOFAN
) -> DataFrame:
    """Several telemetry files in one table, each with its name in ``dataset``."""
    tables = [read_telemetry(spark, p, spec).withColumn("dataset", F.lit(n)) for n, p in paths.items()]
    return reduce(DataFrame.unionByName, tables)


def table_of_rows(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str] | str) -> DataFrame:
    """Rows from memory with named columns."""
    return spark.createDataFrame(rows, columns)

"""The registered queries: one per operator, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearpath.functions.names import renumbered
from wearpath.operators import boosting, compiled, explore, factors, features, metrics, models, modes, rolling, rul, sampling, tables
from wearpath.plans import fixtures as fx
from wearpath.plans import learn, oracle, prepare
from wearpath.plans.fixtures import DEV_NAMES, LINE_SPEC, MEAN_NAMES, NARROW, SENSOR_NAMES, SETTING_NAMES, SPEC
from wearpath.session import work_path
from wearpath.sources import scans, sinks
from wearpath.spec import TelemetrySpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ONE_SENSOR = TelemetrySpec(settings=(), sensors=("s1",))


def _query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _rounded_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return _rounded(df, *[c for c, kind in df.dtypes if kind == "double"], digits=digits)


def _sql(select: str, spec: TelemetrySpec = NARROW, **ctes: str) -> str:
    return oracle.with_ctes({"tel": oracle.telemetry(spec), **ctes}, select)


def _hash_sql(keys: str, seed: int) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {keys}, '{seed}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


_RULED = {"ruled": oracle.with_rul()}
_LABELLED = {**_RULED, "lab": oracle.with_labels()}
_PREDICTED = {
    **_LABELLED,
    "pred": "SELECT CAST(label2 AS DOUBLE) AS label, CAST(CASE WHEN s1 < 33 THEN 2 WHEN s1 < 66 THEN 1 ELSE 0 END"
    " AS DOUBLE) AS prediction FROM lab",
}
_TELEMETRY_NARROW = ["id", "cycle", *NARROW.measures]
_TELEMETRY_ALL = ["id", "cycle", *SPEC.measures]


# ---------------------------------------------------------------- sources and sinks


def _select_rounded(columns, table: str, keys=("id", "cycle")) -> str:
    rest = [c for c in columns if c not in keys]
    return f"SELECT {', '.join(keys)}, {oracle.rounded(rest)} FROM {table}"


@_query("s1_text_scan", _sql(_select_rounded(_TELEMETRY_ALL, "tel"), SPEC))
def s1_text_scan(spark, sf_dir):
    path = work_path(spark, "telemetry")
    sinks.write_text_table(fx.telemetry(spark, sf_dir)[0], path)
    return _rounded_doubles(scans.read_telemetry(spark, path))


@_query("s2_truth_scan", _sql("SELECT id, RUL_at_maxcycle FROM truth", NARROW, truth=oracle.truth()))
def s2_truth_scan(spark, sf_dir):
    path = work_path(spark, "truth")
    sinks.write_text_table(fx.truth(spark, sf_dir), path)
    return scans.read_truth(spark, path)


@_query("s5_gzip_positional", _sql(_select_rounded(_TELEMETRY_ALL, "tel"), SPEC))
def s5_gzip_positional(spark, sf_dir):
    path = work_path(spark, "telemetry-gz")
    sinks.write_text_table(fx.telemetry(spark, sf_dir)[0], path, compression="gzip")
    return _rounded_doubles(learn.frame_telemetry(spark, path))


@_query(
    "s6_truth_by_position",
    _sql(
        "SELECT CAST(row_number() OVER (ORDER BY id) AS INT) AS id, RUL_at_maxcycle FROM truth",
        NARROW,
        truth=oracle.truth(),
    ),
)
def s6_truth_by_position(spark, sf_dir):
    path = work_path(spark, "truth-lines")
    sinks.write_text_table(fx.truth(spark, sf_dir).orderBy("id").select("RUL_at_maxcycle"), path)
    return scans.read_truth_by_position(spark, path, per_file=False).drop("file")


@_query("s7_s12_parquet_roundtrip", _sql(_select_rounded([*_TELEMETRY_NARROW, "rul"], "ruled"), NARROW, **_RULED).replace("round(rul, 6) AS rul", "rul"))
def s7_s12_parquet_roundtrip(spark, sf_dir):
    path = work_path(spark, "prepared")
    sinks.write_parquet(fx.telemetry(spark, sf_dir, NARROW, rul.rul_steps(NARROW))[0], path)
    return _rounded_doubles(scans.read_prepared(spark, path))


def _minmax_sql(columns, table="tel", keys="id, cycle", prefix="") -> str:
    scaled = ", ".join(
        f"round(CASE WHEN {c}_max = {c}_min THEN 0.5 ELSE ({c} - {c}_min) / ({c}_max - {c}_min) END, 6) AS {prefix}{c}"
        for c in columns
    )
    ranges = ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in columns)
    return f"SELECT {keys}, {scaled} FROM {table}, (SELECT {ranges} FROM {table})"


@_query("s9_flat_csv", _sql(_minmax_sql(NARROW.measures, prefix="scaled_")))
def s9_flat_csv(spark, sf_dir):
    df = fx.telemetry(spark, sf_dir, NARROW)[0]
    scaled = features.apply_scaler(df, features.fit_scaler(df, NARROW.measures))
    path = work_path(spark, "scaled-csv")
    sinks.write_csv(scaled.select("id", "cycle", "scaledFeatures"), path, {"scaledFeatures": NARROW.measures})
    schema = ", ".join(["id INT", "cycle INT", *[f"scaled_{c} DOUBLE" for c in NARROW.measures]])
    return _rounded_doubles(spark.read.schema(schema).csv(path, header=True))


_DESCRIBED = ["cycle", *SETTING_NAMES, *SENSOR_NAMES]
_DESCRIPTION_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 9) AS mean,"
    f" round(stddev({c}), 6) AS stddev, round(CAST(min({c}) AS DOUBLE), 6) AS min,"
    f" round(CAST(max({c}) AS DOUBLE), 6) AS max FROM tel"
    for c in _DESCRIBED
)


def _description(df: DataFrame) -> DataFrame:
    """Means of two-decimal values over some ten thousand rows have fewer than nine digits, so none is a tie."""
    return _rounded_doubles(df.withColumn("mean", F.round("mean", 9)), digits=9).withColumn("stddev", F.round("stddev", 6))


@_query("s11_single_csv", _sql(f"SELECT *, CAST(1 AS BIGINT) AS files FROM ({_DESCRIPTION_SQL})", SPEC))
def s11_single_csv(spark, sf_dir):
    """The description of a table, a report of one row per column, as one file."""
    path = work_path(spark, "single-csv")
    table = explore.describe(fx.telemetry(spark, sf_dir)[0], _DESCRIBED)
    sinks.write_csv(table.coalesce(1), path)  # one row for each column, however long the table is
    read = spark.read.schema(table.schema).csv(path, header=True)
    files = read.select(F.input_file_name().alias("f")).distinct().agg(F.count("f")).scalar()
    return _description(read).withColumn("files", files)


@_query(
    "s13_glob_scan",
    _sql(
        "SELECT 'full' AS dataset, id, cycle, round(s1, 6) AS s1 FROM tel"
        " UNION ALL SELECT 'cut' AS dataset, id, cycle, round(s1, 6) AS s1 FROM cut",
        NARROW,
        cut=oracle.truncated(),
    ),
)
def s13_glob_scan(spark, sf_dir):
    base = work_path(spark, "sets")
    sinks.write_parquet(fx.telemetry(spark, sf_dir, ONE_SENSOR)[0], f"{base}/prepared_full")
    sinks.write_parquet(fx.cut(spark, sf_dir, ONE_SENSOR), f"{base}/prepared_cut")
    return _rounded_doubles(scans.read_prepared_sets(spark, f"{base}/prepared_*"))


@_query(
    "s15_libsvm_scan",
    _sql("SELECT CAST(label2 AS DOUBLE) AS label, round(s1, 6) AS s1, round(s2, 6) AS s2 FROM lab", NARROW, **_LABELLED),
)
def s15_libsvm_scan(spark, sf_dir):
    path = work_path(spark, "libsvm")
    df = features.assemble(fx.labelled(spark, sf_dir, NARROW), NARROW.sensors)
    sinks.write_libsvm(df, path, "label2")
    slots = vector_to_array("features")
    read = scans.read_libsvm(spark, path, len(NARROW.sensors))
    return _rounded_doubles(read.select("label", slots[0].alias("s1"), slots[1].alias("s2")))


@_query("s16_ratings_scan", f'SELECT "user", item, CAST(rating AS DOUBLE) AS rating FROM ({oracle.RATINGS})')
def s16_ratings_scan(spark, sf_dir):
    path = work_path(spark, "ratings")
    sinks.write_text_table(fx.ratings(spark, sf_dir), path, separator="\t")
    return scans.read_ratings(spark, path).withColumn("rating", F.col("rating").cast("double"))


@_query(
    "s17_factor_lines",
    _sql("SELECT concat(id, chr(9), format('{:.6f}', m1), ' ', format('{:.6f}', m2)) AS value"
         " FROM (SELECT id, sum(s1) / 7 AS m1, sum(s2) / 7 AS m2 FROM tel GROUP BY id)"),
)
def s17_factor_lines(spark, sf_dir):
    path = work_path(spark, "factors")
    df = fx.telemetry(spark, sf_dir, NARROW)[0]
    vectors = df.groupBy("id").agg(F.array(F.sum("s1") / 7, F.sum("s2") / 7).alias("features"))
    sinks.write_factors(vectors, path)
    return spark.read.text(path)


@_query(
    "s18_s19_model_roundtrip",
    _sql("SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS changed FROM tel"),
)
def s18_s19_model_roundtrip(spark, sf_dir):
    df = _prepared(spark, sf_dir)
    path = work_path(spark, "model")
    model = models.train(df, "rf", "label2")
    models.save(model, path)
    before = models.score(df, model).select("id", "cycle", F.col("prediction").alias("p"))
    after = models.score(df, models.load(path, "RF")).select("id", "cycle", F.col("prediction").alias("q"))
    both = before.join(after, ["id", "cycle"])
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("p") != F.col("q")).alias("changed"))


_SETS_CTE = {
    "sets": "SELECT 'FD00' || CAST(id % 4 + 1 AS INT) AS dataset, * FROM tel",
    "ruled": oracle.with_rul("sets", "dataset, id"),
    "lab": oracle.with_labels(),
}


def _sets(df: DataFrame) -> DataFrame:
    return df.withColumn("dataset", F.concat(F.lit("FD00"), (F.col("id") % 4 + 1).cast("string")))


@_query(
    "s20_multi_dataset",
    _sql("SELECT dataset, id, cycle, rul, label1, label2, round(s1, 6) AS s1 FROM lab", NARROW, **_SETS_CTE),
)
def s20_multi_dataset(spark, sf_dir):
    df, _ = fx.telemetry(spark, sf_dir, ONE_SENSOR)
    path = work_path(spark, "by-dataset")
    sinks.write_parquet(prepare.label_telemetry(_sets(df), ONE_SENSOR.with_dataset()), path, partition_by=["dataset"])
    read = scans.read_prepared(spark, path)
    return _rounded_doubles(read.select("dataset", "id", "cycle", "rul", "label1", "label2", "s1"))


# ---------------------------------------------------------------- projections and filters


@_query("p1_projection", _sql("SELECT id, cycle, setting1, setting2, setting3 FROM tel"))
def p1_projection(spark, sf_dir):
    return fx.telemetry(spark, sf_dir, NARROW)[0].select("id", "cycle", *SETTING_NAMES)


@_query(
    "p3_generated_columns",
    _sql(f"SELECT id, cycle, {oracle.rounded(SENSOR_NAMES)}, "
         + ", ".join(f"round({s} - a{s[1:]}, 6) AS gap{s[1:]}" for s in SENSOR_NAMES)
         + " FROM _means", SPEC, _means=oracle.rolling("tel", SENSOR_NAMES)[0]),
)
def p3_generated_columns(spark, sf_dir):
    spec = TelemetrySpec(settings=())
    rolled, _ = fx.telemetry(spark, sf_dir, spec, [rolling.rolling_step(spec, mode="population", dense=True)])
    gaps = [(F.col(s) - F.col(a)).alias(g) for s, a, g in zip(SENSOR_NAMES, MEAN_NAMES, renumbered(SENSOR_NAMES, "gap"))]
    return _rounded_doubles(rolled.select("*", *gaps).drop(*MEAN_NAMES, *DEV_NAMES))


@_query("p4_drop", _sql("SELECT id, cycle, s1, s2 FROM tel"))
def p4_drop(spark, sf_dir):
    return fx.telemetry(spark, sf_dir, NARROW)[0].drop(*SETTING_NAMES)


@_query(
    "p5_rename",
    _sql("SELECT id AS unit, cycle AS cykle, setting1, setting2, setting3, s1 AS temperature, s2 AS pressure FROM tel"),
)
def p5_rename(spark, sf_dir):
    names = {"id": "unit", "cycle": "cykle", "s1": "temperature", "s2": "pressure"}
    return tables.rename(fx.telemetry(spark, sf_dir, NARROW)[0], names)


@_query(
    "p8_unit_filter",
    _sql("SELECT id, cycle, s1 FROM tel WHERE id = (SELECT id FROM tel GROUP BY id ORDER BY max(cycle) DESC, id LIMIT 1)"),
)
def p8_unit_filter(spark, sf_dir):
    df = fx.telemetry(spark, sf_dir, ONE_SENSOR)[0]
    longest = rul.last_cycle_per_unit(df).orderBy(F.desc("maxcycle"), "id").limit(1).select("id")
    return df.where(F.col("id") == longest.scalar())


@_query("p9_labels", _sql("SELECT id, cycle, rul, label1, label2 FROM lab", NARROW, **_LABELLED))
def p9_labels(spark, sf_dir):
    return fx.labelled(spark, sf_dir, ONE_SENSOR).select("id", "cycle", "rul", "label1", "label2")


_BROKEN = {
    "broken": "SELECT CASE WHEN k = 7 THEN NULL ELSE id END AS id, cycle, setting1, CASE WHEN s1 < 5 THEN NULL ELSE s1 END AS s1"
    " FROM (SELECT *, setting2 AS k FROM tel)"
}


@_query(
    "p10_reject_incomplete",
    _sql("SELECT id, cycle, setting1, round(s1, 6) AS s1 FROM broken WHERE id IS NOT NULL AND s1 IS NOT NULL", NARROW, **_BROKEN),
)
def p10_reject_incomplete(spark, sf_dir):
    return _rounded_doubles(features.reject_incomplete(_broken_text(spark, sf_dir), ["id", "cycle", "setting1", "s1"]))


@_query(
    "p10_reject_counts",
    _sql(
        "SELECT CAST(count(*) AS BIGINT) AS rows_read, CAST(count_if(id IS NOT NULL AND s1 IS NOT NULL) AS BIGINT) AS rows_kept,"
        " CAST(count_if(id IS NULL OR s1 IS NULL) AS BIGINT) AS rows_rejected FROM broken",
        NARROW,
        **_BROKEN,
    ),
)
def p10_reject_counts(spark, sf_dir):
    return features.count_incomplete(_broken_text(spark, sf_dir), ["id", "cycle", "setting1", "s1"])


@_query(
    "s1_quarantine",
    _sql(
        "SELECT cycle, concat_ws('; ', CASE WHEN id IS NULL THEN 'id is not int' END, CASE WHEN s1 IS NULL THEN 's1 is not double' END) AS reason,"
        " (SELECT count(*) FROM broken WHERE id IS NOT NULL AND s1 IS NOT NULL) AS rows_kept, (SELECT count(*) FROM broken) AS rows_read"
        " FROM broken WHERE id IS NULL OR s1 IS NULL",
        NARROW,
        **_BROKEN,
    ),
)
def s1_quarantine(spark, sf_dir):
    """The lines that do not fit, why, and that no line is lost: kept and quarantined rows come from one written pass."""
    spec = TelemetrySpec(settings=("setting1",), sensors=("s1",))
    lines = scans.read_telemetry_lines(spark, _broken_file(spark, sf_dir), spec)
    kept, side = scans.quarantine(lines, work_path(spark, "quarantine"))
    whole, bad = (t.agg(F.count("*")).scalar() for t in (kept, side))
    cycle = F.split("line", " ")[1].cast("int")
    return side.select(cycle.alias("cycle"), "reason", whole.alias("rows_kept"), (whole + bad).alias("rows_read"))


def _broken_file(spark: SparkSession, sf_dir: str) -> str:
    """Telemetry text whose unit or sensor is not a number in some lines."""
    df = fx.telemetry(spark, sf_dir, NARROW)[0]
    unit = F.when(F.col("setting2") == 7, "x").otherwise(F.col("id").cast("string"))
    sensor = F.when(F.col("s1") < 5, "NA").otherwise(F.col("s1").cast("string"))
    path = work_path(spark, "broken")
    sinks.write_text_table(df.select(unit.alias("id"), "cycle", "setting1", sensor.alias("s1")), path)
    return path


def _broken_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.read_telemetry(spark, _broken_file(spark, sf_dir), TelemetrySpec(settings=("setting1",), sensors=("s1",)))


@_query("p11_rul_train", _sql("SELECT id, cycle, rul FROM ruled", NARROW, **_RULED))
def p11_rul_train(spark, sf_dir):
    df, _ = fx.telemetry(spark, sf_dir, ONE_SENSOR, rul.rul_steps(ONE_SENSOR))
    return df.select("id", "cycle", "rul")


_TEST_CTES = {
    "truth": oracle.truth(),
    "cut": oracle.truncated(),
    "ruled": "SELECT cut.*, CAST(RUL_at_maxcycle + max(cycle) OVER (PARTITION BY cut.id) - cycle AS INT) AS rul"
    " FROM cut JOIN truth ON cut.id = truth.id",
    "lab": oracle.with_labels(),
}


@_query("p12_rul_truth", _sql("SELECT id, cycle, rul, label1, label2 FROM lab", NARROW, **_TEST_CTES))
def p12_rul_truth(spark, sf_dir):
    steps = prepare.label_steps(ONE_SENSOR, fx.truth(spark, sf_dir))
    labelled = fx.cut(spark, sf_dir, ONE_SENSOR, steps)
    return labelled.select("id", "cycle", "rul", "label1", "label2")


@_query(
    "p13_merge_labels",
    _sql(
        "SELECT least(label, 1.0::DOUBLE) AS label, least(prediction, 1.0::DOUBLE) AS prediction,"
        " CAST(count(*) AS BIGINT) AS n FROM pred GROUP BY ALL",
        NARROW,
        **_PREDICTED,
    ),
)
def p13_merge_labels(spark, sf_dir):
    return metrics.pair_counts(rul.merge_labels(fx.predictions(spark, sf_dir)))


@_query(
    "f5_split_fields",
    'SELECT CAST("user" AS INT) AS "user", CAST(item AS INT) AS item, CAST(rating AS DOUBLE) AS rating FROM'
    " (SELECT l_orderkey AS \"user\", l_partkey AS item, l_quantity AS rating FROM lineitem)",
)
def f5_split_fields(spark, sf_dir):
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_quantity")]
    lines = fx.table(spark, sf_dir, "lineitem").select(F.concat_ws("\t", *parts).alias("value"))
    return scans.ratings_from_lines(lines).withColumn("rating", F.col("rating").cast("double"))


# ---------------------------------------------------------------- joins and set operations


@_query(
    "j1_attach_mode",
    _sql("SELECT id, cycle, s1, s2, CAST(setting1 % 6 AS INT) AS operationmode FROM tel"),
)
def j1_attach_mode(spark, sf_dir):
    df = fx.telemetry(spark, sf_dir, NARROW)[0]
    mode = df.select("id", "cycle", (F.col("setting1") % 6).cast("int").alias("operationmode"))
    return modes.attach_mode(df.drop(*SETTING_NAMES), mode)


@_query("j2_join_own_maximum", _sql("SELECT id, cycle, CAST(max(cycle) OVER (PARTITION BY id) AS INT) AS maxcycle FROM tel"))
def j2_join_own_maximum(spark, sf_dir):
    df = fx.telemetry(spark, sf_dir, ONE_SENSOR)[0]
    return df.join(rul.last_cycle_per_unit(df), "id").select("id", "cycle", "maxcycle")


@_query(
    "j3_join_maximum_truth",
    _sql("SELECT c.id, last_test_cycle, RUL_at_maxcycle, CAST(last_test_cycle + RUL_at_maxcycle AS INT) AS maxcycle"
         " FROM (SELECT id, max(cycle) AS last_test_cycle FROM cut GROUP BY id) c JOIN truth ON c.id = truth.id",
         NARROW, truth=oracle.truth(), cut=oracle.truncated()),
)
def j3_join_maximum_truth(spark, sf_dir):
    last = rul.last_cycle_per_unit(fx.cut(spark, sf_dir, ONE_SENSOR), ONE_SENSOR, "last_test_cycle")
    joined = last.join(fx.truth(spark, sf_dir), "id")
    return joined.withColumn("maxcycle", F.col("last_test_cycle") + F.col("RUL_at_maxcycle"))


@_query(
    "j4_natural_join",
    _sql("SELECT id, cycle, s1, rul, label1, label2 FROM lab", NARROW, **_LABELLED),
)
def j4_natural_join(spark, sf_dir):
    df = fx.telemetry(spark, sf_dir, ONE_SENSOR)[0]
    return tables.natural_join(df, fx.labelled(spark, sf_dir, ONE_SENSOR))


@_query(
    "u1_append",
    _sql(
        "SELECT 'train' AS dataset, id, cycle, round(s1, 6) AS s1 FROM tel"
        " UNION ALL SELECT 'test' AS dataset, id, cycle, round(s1, 6) AS s1 FROM cut",
        NARROW,
        cut=oracle.truncated(),
    ),
)
def u1_append(spark, sf_dir):
    train, test = fx.telemetry(spark, sf_dir, ONE_SENSOR)[0], fx.cut(spark, sf_dir, ONE_SENSOR)
    return _rounded_doubles(tables.append({"train": train, "test": test}))


@_query("u2_units", _sql("SELECT DISTINCT id FROM tel"))
def u2_units(spark, sf_dir):
    return tables.units_of(fx.telemetry(spark, sf_dir, ONE_SENSOR)[0])


# ---------------------------------------------------------------- aggregates and exploration


@_query("a1_max_per_unit", _sql("SELECT id, max(cycle) AS maxcycle FROM tel GROUP BY id"))
def a1_max_per_unit(spark, sf_dir):
    return rul.last_cycle_per_unit(fx.telemetry(spark, sf_dir, ONE_SENSOR)[0])


@_query("a2_count", _sql("SELECT CAST(count(*) AS BIGINT) AS n FROM tel"))
def a2_count(spark, sf_dir):
    return explore.row_count(fx.telemetry(spark, sf_dir, ONE_SENSOR)[0])


@_query("a3_describe", _sql(_DESCRIPTION_SQL, SPEC))
def a3_describe(spark, sf_dir):
    return _description(explore.describe(fx.telemetry(spark, sf_dir)[0], _DESCRIBED))


@_query("a4_distinct", _sql("SELECT DISTINCT label2 FROM lab", NARROW, **_LABELLED))
def a4_distinct(spark, sf_dir):
    return explore.distinct_values(fx.labelled(spark, sf_dir, ONE_SENSOR), "label2")


@_query(
    "a5_feature_ranges",
    _sql("SELECT " + ", ".join(f"round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max" for c in SENSOR_NAMES) + " FROM tel", SPEC),
)
def a5_feature_ranges(spark, sf_dir):
    return _rounded_doubles(features.value_ranges(fx.telemetry(spark, sf_dir)[0], SENSOR_NAMES))


_CORRELATED = ["rul", *SETTING_NAMES, *SENSOR_NAMES]


@_query(
    "a6_correlations",
    _sql(
        " UNION ALL ".join(
            f"SELECT '{x}' AS x, '{y}' AS y, round(CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN corr({x}, {y}) END, 6) AS r FROM ruled"
            for x in _CORRELATED
            for y in _CORRELATED
        ),
        SPEC,
        **_RULED,
    ),
)
def a6_correlations(spark, sf_dir):
    df = fx.telemetry(spark, sf_dir, SPEC, rul.rul_steps(SPEC))[0]
    return _rounded_doubles(explore.correlations(df, _CORRELATED))


@_query(
    "a7_histogram",
    _sql(
        "SELECT CAST(b.range AS INT) AS bin, round(lo + b.range * (hi - lo) / 20, 6) AS lo,"
        " round(lo + (b.range + 1) * (hi - lo) / 20, 6) AS hi, CAST(coalesce(n, 0) AS BIGINT) AS n"
        " FROM range(20) b CROSS JOIN ext LEFT JOIN"
        " (SELECT least(CAST(floor((s1 - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin, count(*) AS n FROM tel, ext GROUP BY 1) c"
        " ON c.bin = b.range",
        NARROW,
        ext="SELECT min(s1) AS lo, max(s1) AS hi FROM tel",
    ),
)
def a7_histogram(spark, sf_dir):
    return _rounded_doubles(explore.histogram(fx.telemetry(spark, sf_dir, ONE_SENSOR)[0], "s1", 20))


@_query(
    "a7_histogram_auto",
    _sql(
        "SELECT CAST(b.range AS INT) AS bin, round(lo + b.range * (hi - lo) / bins, 6) AS lo,"
        " round(lo + (b.range + 1) * (hi - lo) / bins, 6) AS hi, CAST(coalesce(n, 0) AS BIGINT) AS n"
        " FROM ext, range(10000) b LEFT JOIN"
        " (SELECT least(CAST(floor((s1 - lo) / (hi - lo) * bins) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM tel, ext GROUP BY 1) c"
        " ON c.bin = b.range WHERE b.range < bins",
        NARROW,
        ext="SELECT min(s1) AS lo, max(s1) AS hi, greatest(1, least(10000, ceil((max(s1) - min(s1))"
        " / (2 * (quantile_disc(s1, 0.75) - quantile_disc(s1, 0.25)) / pow(count(*), 1.0 / 3)))))::BIGINT AS bins FROM tel",
    ),
)
def a7_histogram_auto(spark, sf_dir):
    """Bins chosen from the data; the sketch is fine enough here to give the exact quartiles."""
    df = fx.telemetry(spark, sf_dir, ONE_SENSOR)[0]
    return _rounded_doubles(explore.histogram(df, "s1", explore.bins_of(df, "s1", accuracy=1e-7)))


def _density_sql(bandwidth: str, digits: int) -> str:
    """The binned form: rows shared between the neighbouring points of a grid of 1/32 of the bandwidth."""
    return _sql(
        "SELECT CAST(g.range * 10 AS DOUBLE) AS x, round(sum(w * exp(-0.5 * pow((g.range * 10 - cell * h / 32) / h, 2)))"
        f" / (sum(w) * any_value(h) * sqrt(2 * pi())), {digits}) AS density FROM range(50) g, shared, width GROUP BY g.range",
        NARROW,
        width=f"SELECT {bandwidth} AS h FROM tel",
        placed="SELECT s1 / (h / 32) AS p FROM tel, width",
        shared="SELECT cell, sum(w) AS w FROM (SELECT floor(p) AS cell, 1 - (p - floor(p)) AS w FROM placed"
        " UNION ALL SELECT floor(p) + 1, p - floor(p) FROM placed) GROUP BY cell",
    )


@_query("a8_density", _density_sql("any_value(5.0::DOUBLE)", 9))
def a8_density(spark, sf_dir):
    df = fx.telemetry(spark, sf_dir, ONE_SENSOR)[0]
    return _rounded(explore.density(df, "s1", [10.0 * i for i in range(50)], 5.0), "density", digits=9)


@_query(
    "a8_density_auto",
    _density_sql("0.9 * least(stddev_samp(s1), (quantile_disc(s1, 0.75) - quantile_disc(s1, 0.25)) / 1.34::DOUBLE) / pow(count(*), 0.2)", 8),
)
def a8_density_auto(spark, sf_dir):
    """The bandwidth comes from the data; the sketch is fine enough here to give the exact quartiles."""
    df = fx.telemetry(spark, sf_dir, ONE_SENSOR)[0]
    width = explore.bandwidth_of(df, "s1", accuracy=1e-7)
    return _rounded(explore.density(df, "s1", [10.0 * i for i in range(50)], width), "density", digits=8)


@_query(
    "a8_density2d",
    _sql(
        "SELECT CAST(gx.range * 5 AS DOUBLE) AS x, CAST(gy.range * 20 AS DOUBLE) AS y,"
        " round(sum(exp(-0.5 * pow((gx.range * 5 - rul) / 4.0, 2)) * exp(-0.5 * pow((gy.range * 20 - s1) / 10.0, 2)))"
        " / (count(*) * 40.0 * 2 * pi()), 9) AS density FROM range(12) gx, range(12) gy, ruled GROUP BY gx.range, gy.range",
        NARROW,
        **_RULED,
    ),
)
def a8_density2d(spark, sf_dir):
    ruled = fx.telemetry(spark, sf_dir, ONE_SENSOR, rul.rul_steps(ONE_SENSOR))[0]
    grid = explore.density2d(
        ruled, "rul", "s1", [5.0 * i for i in range(12)], [20.0 * i for i in range(12)], 4.0, 10.0
    )
    return _rounded(grid, "density", digits=9)


@_query(
    "a9_linear_trend",
    _sql("SELECT round(regr_intercept(s2, s1), 6) AS intercept, round(regr_slope(s2, s1), 6) AS slope FROM tel"),
)
def a9_linear_trend(spark, sf_dir):
    return _rounded_doubles(explore.linear_trend(fx.telemetry(spark, sf_dir, NARROW)[0], "s2", "s1"))


_QUADRATIC = {
    "m": "SELECT avg(s1) AS mx FROM tel",
    "p": "SELECT any_value(mx) AS mx, count(*) AS n, sum(d) AS u1, sum(d * d) AS u2, sum(d * d * d) AS u3,"
    " sum(d * d * d * d) AS u4, sum(y) AS t0, sum(d * y) AS t1, sum(d * d * y) AS t2"
    " FROM (SELECT s1 - mx AS d, s2 AS y, mx FROM tel, m)",
    "det": "SELECT *, n * (u2 * u4 - u3 * u3) - u1 * (u1 * u4 - u3 * u2) + u2 * (u1 * u3 - u2 * u2) AS dd FROM p",
    "c": "SELECT mx, (t0 * (u2 * u4 - u3 * u3) - u1 * (t1 * u4 - u3 * t2) + u2 * (t1 * u3 - u2 * t2)) / dd AS a0,"
    " (n * (t1 * u4 - u3 * t2) - t0 * (u1 * u4 - u3 * u2) + u2 * (u1 * t2 - t1 * u2)) / dd AS a1,"
    " (n * (u2 * t2 - t1 * u3) - u1 * (u1 * t2 - t1 * u2) + t0 * (u1 * u3 - u2 * u2)) / dd AS a2 FROM det",
}


@_query(
    "a9_quadratic_trend",
    _sql("SELECT round(a0 - a1 * mx + a2 * mx * mx, 6) AS c0, round(a1 - 2 * a2 * mx, 6) AS c1, round(a2, 6) AS c2 FROM c", NARROW, **_QUADRATIC),
)
def a9_quadratic_trend(spark, sf_dir):
    return _rounded_doubles(explore.quadratic_trend(fx.telemetry(spark, sf_dir, NARROW)[0], "s2", "s1"))


_MULTIPLIERS = explore.multipliers(50, 7)
_BAND_GRID = [50.0, 100.0, 150.0, 200.0]
_POISSON = " + ".join(
    f"CASE WHEN place >= {explore.poisson_share(k):.17e} THEN 1.0 ELSE 0.0 END" for k in range(explore.MOST_DRAWS)
)


@_query(
    "a9_trend_band",
    _sql(
        "SELECT x, round(max(CASE WHEN r = 0 THEN v END), 5) AS fit, round(quantile_cont(CASE WHEN r > 0 THEN v END, 0.025), 5) AS low,"
        " round(quantile_cont(CASE WHEN r > 0 THEN v END, 0.975), 5) AS high FROM curve GROUP BY x",
        NARROW,
        hashed="SELECT *, ('0x' || substr(h, 1, 7))::BIGINT AS h0, ('0x' || substr(h, 8, 7))::BIGINT AS h1"
        " FROM (SELECT *, md5(concat_ws(':', id, cycle, '7')) AS h FROM tel)",
        drawn="SELECT r, s1 - 125 AS d, s2 AS y, CASE WHEN r = 0 THEN 1.0::DOUBLE ELSE " + _POISSON + " END::DOUBLE AS w FROM"
        f" (SELECT *, ((h0 * {list(_MULTIPLIERS[0])}[r + 1] + h1 * {list(_MULTIPLIERS[1])}[r + 1]) % {explore.MODULUS}) / {explore.MODULUS}.0::DOUBLE AS place"
        " FROM hashed, (SELECT unnest(range(51)) AS r))",
        p="SELECT r, sum(w) AS n, sum(w * d) AS u1, sum(w * d * d) AS u2, sum(w * d * d * d) AS u3, sum(w * d * d * d * d) AS u4,"
        " sum(w * y) AS t0, sum(w * d * y) AS t1, sum(w * d * d * y) AS t2 FROM drawn GROUP BY r",
        det=_QUADRATIC["det"],
        c=_QUADRATIC["c"].replace("SELECT mx,", "SELECT r,"),
        curve="SELECT r, x, a0 + a1 * (x - 125) + a2 * (x - 125) * (x - 125) AS v FROM c, (SELECT unnest([50.0, 100.0, 150.0, 200.0]::DOUBLE[]) AS x)",
    ),
)
def a9_trend_band(spark, sf_dir):
    band = explore.trend_band(fx.telemetry(spark, sf_dir, NARROW)[0], "s2", "s1", ["id", "cycle"], _BAND_GRID, replicates=50)
    return _rounded_doubles(band, 5)


@_query(
    "a10_residual",
    _sql(
        "SELECT id, cycle, round(s2 - a - b * s1, 3) AS residual FROM tel, fit",
        NARROW,
        fit="SELECT regr_intercept(s2, s1) AS a, regr_slope(s2, s1) AS b FROM tel",
    ),
)
def a10_residual(spark, sf_dir):
    df = fx.telemetry(spark, sf_dir, NARROW)[0]
    return _rounded_doubles(explore.with_residual(df, "s2", "s1").select("id", "cycle", "residual"), 3)


_CELLS = {
    **_PREDICTED,
    "cls": "SELECT DISTINCT label AS c FROM pred",
    "cells": "SELECT x.c AS label, y.c AS prediction, CAST(count(pred.label) AS BIGINT) AS n FROM cls x CROSS JOIN cls y"
    " LEFT JOIN pred ON pred.label = x.c AND pred.prediction = y.c GROUP BY x.c, y.c",
}
_CLASSES = {
    **_PREDICTED,
    "tot": "SELECT c AS label, sum(CASE WHEN label = c AND prediction = c THEN 1 ELSE 0 END) AS tp,"
    " sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS p, sum(CASE WHEN prediction = c THEN 1 ELSE 0 END) AS pp,"
    " count(*) AS n FROM pred, (SELECT DISTINCT label AS c FROM pred) GROUP BY c",
    "per": 'SELECT label, coalesce(tp / nullif(pp, 0), 0) AS "precision", tp / nullif(p, 0) AS recall,'
    " (pp - tp) / nullif(n - p, 0) AS fpr, 2 * tp / (pp + p) AS f1, p / n AS share, tp, n FROM tot",
}
_F_HALF = 'coalesce(1.25 * "precision" * recall / nullif(0.25 * "precision" + recall, 0), 0)'


@_query("a11_confusion", _sql("SELECT label, prediction, n FROM cells", NARROW, **_CELLS))
def a11_confusion(spark, sf_dir):
    return metrics.confusion(fx.predictions(spark, sf_dir))


@_query(
    "a11_confusion_matrix",
    _sql(
        "SELECT label, "
        + ", ".join(f"CAST(sum(CASE WHEN prediction = {c} THEN n ELSE 0 END) AS BIGINT) AS p{c}" for c in range(3))
        + " FROM cells GROUP BY label",
        NARROW,
        **_CELLS,
    ),
)
def a11_confusion_matrix(spark, sf_dir):
    wide = metrics.confusion_matrix(fx.predictions(spark, sf_dir))
    return tables.rename(wide, {"0.0": "p0", "1.0": "p1", "2.0": "p2"})


@_query(
    "a12_confusion_percent",
    _sql("SELECT label, prediction, round(100.0 * n / sum(n) OVER (PARTITION BY label), 6) AS percent FROM cells", NARROW, **_CELLS),
)
def a12_confusion_percent(spark, sf_dir):
    return _rounded_doubles(metrics.confusion_percent(fx.predictions(spark, sf_dir)))


@_query(
    "a13_accuracy",
    _sql("SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred", NARROW, **_PREDICTED),
)
def a13_accuracy(spark, sf_dir):
    return _rounded_doubles(metrics.accuracy(fx.predictions(spark, sf_dir)))


@_query(
    "a14_per_class",
    _sql('SELECT label, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f FROM per', NARROW, **_CLASSES),
)
def a14_per_class(spark, sf_dir):
    table = metrics.per_class(fx.predictions(spark, sf_dir)).drop("share", "tp", "total")
    return _rounded_doubles(table)


_WEIGHTED = {
    "weighted_precision": 'sum(share * "precision")',
    "weighted_recall": "sum(share * recall)",
    "weighted_f1": "sum(share * f1)",
    "weighted_f_beta": f"sum(share * {_F_HALF})",
    "weighted_fpr": "sum(share * fpr)",
}


@_query(
    "a15_weighted",
    _sql("SELECT " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _WEIGHTED.items()) + " FROM per", NARROW, **_CLASSES),
)
def a15_weighted(spark, sf_dir):
    return _rounded_doubles(metrics.weighted(fx.predictions(spark, sf_dir)))


@_query(
    "a16_class_weights",
    _sql(
        "SELECT label2, CAST(count(*) AS BIGINT) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight"
        " FROM lab GROUP BY label2",
        NARROW,
        **_LABELLED,
    ),
)
def a16_class_weights(spark, sf_dir):
    return _rounded_doubles(features.class_weights(fx.labelled(spark, sf_dir, ONE_SENSOR), "label2"))


_REPORT = " UNION ALL ".join(
    ["SELECT 'accuracy' AS metric, CAST(NULL AS DOUBLE) AS label, round(sum(tp) / any_value(n), 6) AS value FROM per"]
    + [f"SELECT '{n}', NULL, round({e}, 6) FROM per" for n, e in _WEIGHTED.items()]
    + [f"SELECT '{n}', label, round(\"{n}\", 6) FROM per" for n in ("precision", "recall", "fpr", "f1")]
)


@_query("a17_report", _sql(_REPORT, NARROW, **_CLASSES))
def a17_report(spark, sf_dir):
    return _rounded_doubles(metrics.evaluate(fx.predictions(spark, sf_dir)))


@_query(
    "a17_report_merged",
    _sql(
        _REPORT,
        NARROW,
        **{k: v.replace("FROM pred", "FROM merged") if k in ("tot",) else v for k, v in {
            **_PREDICTED,
            "merged": "SELECT least(label, 1.0::DOUBLE) AS label, least(prediction, 1.0::DOUBLE) AS prediction FROM pred",
            "tot": _CLASSES["tot"],
            "per": _CLASSES["per"],
        }.items()},
    ),
)
def a17_report_merged(spark, sf_dir):
    return _rounded_doubles(metrics.evaluate(rul.merge_labels(fx.predictions(spark, sf_dir))))


# ---------------------------------------------------------------- windows


def _rolled_sql(spec: TelemetrySpec, base: str | None = None, extra: dict | None = None, keep=("id", "cycle"), **frame) -> str:
    sensors = list(spec.sensors)
    names = renumbered(sensors, "a") + renumbered(sensors, "sd")
    first, second = oracle.rolling("src", sensors, **frame)
    ctes = {"tel": base or oracle.telemetry(spec), **(extra or {"src": "SELECT * FROM tel"})}
    return oracle.with_ctes(
        {**ctes, "_means": first, "_devs": second}, f"SELECT {', '.join(keep)}, {oracle.rounded(names)} FROM _devs"
    )


@_query("w1_w2_trailing", _rolled_sql(SPEC))
def w1_w2_trailing(spark, sf_dir):
    spec = TelemetrySpec(settings=())
    df, _ = fx.telemetry(spark, sf_dir, spec, [rolling.rolling_step(spec, dense=True)])
    return _rounded_doubles(df.select("id", "cycle", *MEAN_NAMES, *DEV_NAMES))


@_query("w1_w2_line_items", _rolled_sql(LINE_SPEC, oracle.LINES))
def w1_w2_line_items(spark, sf_dir):
    rolled = fx.line_telemetry(spark, sf_dir, [rolling.rolling_step(LINE_SPEC, dense=True)])
    return _rounded_doubles(rolled.drop(*LINE_SPEC.sensors))


_FLAGSHIP = {**_LABELLED, "src": "SELECT * FROM lab"}


@_query("flagship_enrich", _rolled_sql(SPEC, extra=_FLAGSHIP, keep=("id", "cycle", "rul", "label1", "label2")))
def flagship_enrich(spark, sf_dir):
    spec = TelemetrySpec(settings=())
    steps = [*prepare.label_steps(spec), rolling.rolling_step(spec, dense=True)]
    return _rounded_doubles(fx.telemetry(spark, sf_dir, spec, steps)[0].drop(*SENSOR_NAMES))


def _by_rule(df: DataFrame) -> DataFrame:
    return df.withColumn("operationmode", (F.col("setting1") % 6).cast("int"))


@_query(
    "w3_forward_by_mode",
    _rolled_sql(
        SPEC,
        extra={"src": "SELECT *, CAST(setting1 % 6 AS INT) AS operationmode FROM tel"},
        keep=("id", "cycle", "operationmode"),
        partition="operationmode",
        order="id, cycle",
        frame="CURRENT ROW AND 5 FOLLOWING",
    ),
)
def w3_forward_by_mode(spark, sf_dir):
    df = _by_rule(fx.telemetry(spark, sf_dir)[0])
    rolled = rolling.rolling_by_mode(df, SPEC)
    return _rounded_doubles(rolled.select("id", "cycle", "operationmode", *MEAN_NAMES, *DEV_NAMES))


_FULL_NAMES = [f"{p}{i}" for p in ("mean_s", "stdv_s") for i in range(1, 22)]


def _full_sql(fill: bool) -> str:
    w = "OVER (PARTITION BY id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    columns = []
    for s in SENSOR_NAMES:
        raw, zero = (s, "0.0::DOUBLE") if fill else ("NULL", "NULL")
        columns.append(f"round(CASE WHEN count(*) {w} = 5 THEN avg({s}) {w} ELSE {raw} END, 6) AS mean_{s}")
        columns.append(f"round(CASE WHEN count(*) {w} = 5 THEN stddev_pop({s}) {w} ELSE {zero} END, 6) AS stdv_{s}")
    return _sql(f"SELECT id, cycle, {', '.join(columns)} FROM tel", SPEC)


def _full_frames(spark, sf_dir) -> DataFrame:
    spec = TelemetrySpec(settings=())
    step = rolling.rolling_step(spec, mode="full", mean_prefix="mean_s", dev_prefix="stdv_s", dense=True)
    return fx.telemetry(spark, sf_dir, spec, [step])[0]


@_query("w4_full_window", _full_sql(False))
def w4_full_window(spark, sf_dir):
    return _rounded_doubles(_full_frames(spark, sf_dir).select("id", "cycle", *_FULL_NAMES))


@_query("w4_p14_full_window_filled", _full_sql(True))
def w4_p14_full_window_filled(spark, sf_dir):
    return _rounded_doubles(rolling.fill_undefined(_full_frames(spark, sf_dir)).select("id", "cycle", *_FULL_NAMES))


def _standardised_sql(literal: bool) -> str:
    sensors = list(NARROW.sensors)
    first, second = oracle.rolling("tel", sensors)
    out = []
    for s, a, sd, std in zip(sensors, *[renumbered(sensors, p) for p in ("a", "sd", "std")]):
        expr = f"{s} - coalesce({a} / nullif({sd}, 0), {a} / 1e-8)" if literal else f"({s} - {a}) / nullif({sd}, 0)"
        out.append(f"round({expr}, 2) AS {std}")
    return _sql(f"SELECT id, cycle, {', '.join(out)} FROM _devs", NARROW, _means=first, _devs=second)


def _standardised(spark, sf_dir, mode) -> DataFrame:
    rolled, _ = fx.telemetry(spark, sf_dir, NARROW, [rolling.rolling_step(NARROW, dense=True)])
    return _rounded_doubles(rolling.standardise(rolled, NARROW, mode).select("id", "cycle", "std1", "std2"), digits=2)


@_query("w5_standardise", _standardised_sql(True))
def w5_standardise(spark, sf_dir):
    return _standardised(spark, sf_dir, "literal")


@_query("w5_zscore", _standardised_sql(False))
def w5_zscore(spark, sf_dir):
    return _standardised(spark, sf_dir, "zscore")


@_query(
    "w2_population",
    _sql(
        "SELECT id, cycle, round(avg(s1) OVER w, 6) AS a1, round(stddev_pop(s1) OVER w, 6) AS sd1 FROM tel"
        " WINDOW w AS (PARTITION BY id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    ),
)
def w2_population(spark, sf_dir):
    step = rolling.rolling_step(ONE_SENSOR, mode="population", dense=True)
    return _rounded_doubles(fx.telemetry(spark, sf_dir, ONE_SENSOR, [step])[0].drop("s1"))


# ---------------------------------------------------------------- sorts, samples, splits


@_query("l1_sorted", _sql("SELECT id, cycle, s1 FROM tel ORDER BY id, cycle"))
def l1_sorted(spark, sf_dir):
    return fx.telemetry(spark, sf_dir, ONE_SENSOR)[0].orderBy("id", "cycle")


@_query("l3_head", _sql("SELECT id, cycle, s1 FROM tel ORDER BY id, cycle LIMIT 10"))
def l3_head(spark, sf_dir):
    return explore.head(fx.telemetry(spark, sf_dir, ONE_SENSOR)[0], 10, ["id", "cycle"])


@_query(
    "l4_sample",
    _sql(f"SELECT id, cycle, s1 FROM tel WHERE {_hash_sql('id, cycle', 123456)} < 1000.0::DOUBLE / (SELECT count(*) FROM tel)"),
)
def l4_sample(spark, sf_dir):
    return sampling.sample_about(fx.telemetry(spark, sf_dir, ONE_SENSOR)[0], 1000, ["id", "cycle"])


@_query(
    "l5_pick_units",
    _sql(f"SELECT id, cycle, s1 FROM tel WHERE id IN (SELECT id FROM (SELECT DISTINCT id FROM tel) ORDER BY {_hash_sql('id', 123456)}, id LIMIT 20)"),
)
def l5_pick_units(spark, sf_dir):
    return sampling.pick_units(fx.telemetry(spark, sf_dir, ONE_SENSOR)[0], 20)


def _split_sql(keys: str) -> str:
    return _sql(
        f"SELECT id, cycle, CASE WHEN {_hash_sql(keys, 11)} < 0.8::DOUBLE THEN 'training' ELSE 'validation' END AS part FROM tel"
    )


def _split(spark, sf_dir, by) -> DataFrame:
    df = fx.telemetry(spark, sf_dir, ONE_SENSOR)[0].select("id", "cycle")
    training, validation = sampling.split_by_hash(df, [0.8, 0.2], by)
    return tables.append({"training": training, "validation": validation}, "part")


@_query("l6_split_units", _split_sql("id"))
def l6_split_units(spark, sf_dir):
    return _split(spark, sf_dir, ["id"])


@_query("l6_split_rows", _split_sql("id, cycle"))
def l6_split_rows(spark, sf_dir):
    return _split(spark, sf_dir, ["id", "cycle"])


# ---------------------------------------------------------------- features and models


def _scaled(df: DataFrame, spec: TelemetrySpec) -> DataFrame:
    """Scaled features. The table is written once and read for the scale and for the result, so its windows run once."""
    path = work_path(df.sparkSession, "unscaled")
    sinks.write_parquet(df, path)
    df = scans.read_prepared(df.sparkSession, path)
    columns = ["cycle", *spec.measures]
    return features.apply_scaler(df, features.fit_scaler(df, columns))


def _prepared_path(spark: SparkSession, sf_dir: str) -> str:
    """A prepared table on disk, which is what models are trained on."""
    path = work_path(spark, "prepared")
    sinks.write_parquet(_scaled(fx.labelled(spark, sf_dir, NARROW), NARROW), path)
    return path


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.read_prepared(spark, _prepared_path(spark, sf_dir))


@_query("m1_modes")
def m1_modes(spark, sf_dir):
    df = fx.telemetry(spark, sf_dir, TelemetrySpec(sensors=()))[0]
    return modes.mode_centres(modes.fit_modes(df), df)


@_query(
    "m1_modes_nearest",
    _sql("SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS not_nearest, CAST(6 AS BIGINT) AS modes FROM tel"),
)
def m1_modes_nearest(spark, sf_dir):
    """Every row must lie in the mode whose centre is nearest."""
    df = fx.telemetry(spark, sf_dir, TelemetrySpec(sensors=()))[0]
    model = modes.fit_modes(df)
    centres = model.stages[-1].clusterCenters()
    gaps = [
        sum((F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(SETTING_NAMES, centre))
        for centre in centres
    ]
    own = F.array(*gaps)[F.col("operationmode")]
    return modes.add_modes(df, model).agg(
        F.count("*").alias("n"),
        F.count_if(own > F.least(*gaps) + 1e-9).alias("not_nearest"),
        F.countDistinct("operationmode").alias("modes"),
    )


@_query(
    "m1_modes_fixed_point",
    _sql("SELECT CAST(count(*) AS BIGINT) AS n, CAST(6 AS BIGINT) AS modes, TRUE AS settled FROM tel"),
)
def m1_modes_fixed_point(spark, sf_dir):
    """Fitted on weighted settings, each centre is the mean of all rows that lie nearest to it."""
    df = fx.telemetry(spark, sf_dir, TelemetrySpec(sensors=()))[0]
    model = modes.fit_modes(df, maxIter=500, tol=1e-12)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.stages[-1].clusterCenters()])
    own = modes.mode_centres(model, df).withColumn("c", F.element_at(centres, F.col("operationmode") + 1))
    far = F.greatest(*[F.abs(F.col(s) - F.col("c")[i]) for i, s in enumerate(SETTING_NAMES)])
    return own.agg(F.sum("rows").alias("n"), F.count("*").alias("modes"), (F.max(far) < 1e-6).alias("settled"))


@_query("m3_minmax", _sql(_minmax_sql(SPEC.measures), SPEC))
def m3_minmax(spark, sf_dir):
    return _rounded_doubles(features.minmax_columns(fx.telemetry(spark, sf_dir)[0], SPEC.measures))


@_query("m2_m3_minmax_vector", _sql(_minmax_sql(SPEC.measures, prefix="scaled_"), SPEC))
def m2_m3_minmax_vector(spark, sf_dir):
    df = fx.telemetry(spark, sf_dir)[0]
    scaled = features.apply_scaler(df, features.fit_scaler(df, SPEC.measures)).select("id", "cycle", "scaledFeatures")
    return _rounded_doubles(features.vector_columns(scaled, "scaledFeatures", SPEC.measures))


@_query(
    "m3_minmax_by_dataset",
    _sql(
        "SELECT s.dataset, id, cycle, round((s1 - lo) / (hi - lo), 6) AS s1 FROM sets s JOIN"
        " (SELECT dataset, min(s1) AS lo, max(s1) AS hi FROM sets GROUP BY dataset) r ON s.dataset = r.dataset",
        NARROW,
        sets=_SETS_CTE["sets"],
    ),
)
def m3_minmax_by_dataset(spark, sf_dir):
    df = _sets(fx.telemetry(spark, sf_dir, ONE_SENSOR)[0])
    return _rounded_doubles(features.minmax_columns(df, ["s1"], ["dataset"]))


_INDEX_SQL = _sql(
    "SELECT label2, CAST(count(*) AS BIGINT) AS n,"
    " CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(label2 AS VARCHAR)) - 1 AS DOUBLE) AS label_index FROM lab GROUP BY label2",
    NARROW,
    **_LABELLED,
)


@_query("m4_label_index", _INDEX_SQL)
def m4_label_index(spark, sf_dir):
    return features.label_index(fx.labelled(spark, sf_dir, ONE_SENSOR), "label2")


@_query("m4_label_indexer", _INDEX_SQL)
def m4_label_indexer(spark, sf_dir):
    df = fx.labelled(spark, sf_dir, ONE_SENSOR).select("label2")
    indexed = features.label_indexer("label2", "label_index").fit(df).transform(df)
    return indexed.groupBy("label2", "label_index").agg(F.count("*").alias("n"))


def _facts(report: DataFrame, *by: str) -> DataFrame:
    """What SQL can confirm of a model's report: rows of each true class in the confusion cells, and
    that weighted recall is accuracy, which is the share of the diagonal."""
    cell = F.col("metric") == "confusion"
    total = lambda rows: F.sum(F.when(rows, F.col("value")).otherwise(0.0))
    one = lambda name: F.max(F.when(F.col("metric") == name, F.col("value")))
    right = total(cell & (F.col("label") == F.col("prediction"))) / total(cell)
    agree = (F.abs(one("weighted_recall") - one("accuracy")) < 1e-9) & (F.abs(right - one("accuracy")) < 1e-9)
    checked = report.groupBy(F.lit(0).alias("_all"), *by).agg(agree.alias("agree"))
    classes = report.where(cell).groupBy(F.lit(0).alias("_all"), *by, "label").agg(F.sum("value").cast("bigint").alias("n"))
    return classes.where("n > 0").join(checked, ["_all", *by]).drop("_all")


def _facts_sql(select: str, **ctes: str) -> str:
    """Rows of each true class in the rows that ``select`` gives (..., label)."""
    return _sql(f"SELECT *, CAST(count(*) AS BIGINT) AS n, TRUE AS agree FROM ({select}) GROUP BY ALL", NARROW, **{**_LABELLED, **ctes})


def _model_query(kind: str, label: str = "label2", **options) -> Query:
    def run(spark, sf_dir):
        df = _prepared(spark, sf_dir)
        return _facts(models.evaluate_model(df, models.train(df, kind, label, **options), label))

    return run


for _name, _kind, _label in (
    ("m6_logistic", "lr", "label2"),
    ("m6_logistic_label1", "lr", "label1"),
    ("m8_forest", "rf", "label2"),
    ("m9_forest_large", "rf_large", "label2"),
    ("m10_logistic_weighted", "lr_weighted", "label2"),
    ("m11_forest_weighted", "rf_weighted", "label2"),
    ("m12_boosted_weighted", "gbt_weighted", "label2"),
):
    _query(_name, _facts_sql(f"SELECT CAST({_label} AS DOUBLE) AS label FROM lab"))(_model_query(_kind, _label))


@_query(
    "m6_logistic_optimum",
    _sql(
        "SELECT CAST(label2 AS DOUBLE) AS label, CAST(count(*) AS BIGINT) AS n, TRUE AS at_optimum FROM lab GROUP BY label2",
        NARROW,
        **_LABELLED,
    ),
)
def m6_logistic_optimum(spark, sf_dir):
    """At the maximum likelihood the mean of (probability - hit) * feature is zero per class.

    A constant feature has no part in the fit: its coefficient is fixed at zero.
    """
    df = _prepared(spark, sf_dir)
    model = models.train(df, "lr", "label2")
    fitted = models.classifier(model).coefficientMatrix.toArray()
    x, p = vector_to_array("scaledFeatures"), vector_to_array("probability")
    scored = models.score(df, model, "label2").select("label", x.alias("x"), p.alias("p"))
    gaps = [
        F.abs(F.avg((F.col("p")[k] - F.when(F.col("label") == float(label), 1.0).otherwise(0.0)) * F.col("x")[j]))
        for k, label in enumerate(model.stages[0].labels)
        for j in range(fitted.shape[1])
        if fitted[:, j].any()
    ]
    steepest = scored.select(F.greatest(*gaps)).scalar()
    return scored.groupBy("label").agg(F.count("*").alias("n")).withColumn("at_optimum", steepest < 1e-3)


@_query(
    "m7_holdout",
    _facts_sql(
        f"SELECT CASE WHEN {_hash_sql('id', 11)} < 0.8::DOUBLE THEN 'training' ELSE 'validation' END AS part, CAST(label1 AS DOUBLE) AS label FROM lab"
    ),
)
def m7_holdout(spark, sf_dir):
    return _facts(learn.train_with_holdout(spark, _prepared_path(spark, sf_dir), label=1, by_unit=True), "part")


@_query(
    "l2_coefficients",
    _sql(
        "SELECT DISTINCT CAST(label2 AS VARCHAR) AS label, feature, TRUE AS finite FROM lab,"
        f" (SELECT unnest({['cycle', *NARROW.measures]}) AS feature)",
        NARROW,
        **_LABELLED,
    ),
)
def l2_coefficients(spark, sf_dir):
    """Each class has one finite coefficient for each feature."""
    df = _prepared(spark, sf_dir)
    table = models.coefficients(models.train(df, "lr_weighted", "label2"), spark, ["cycle", *NARROW.measures])
    return table.select("label", "feature", (F.abs("value") < float("inf")).alias("finite"))


@_query(
    "m13_score",
    _sql("SELECT id, cycle, CAST(label2 AS DOUBLE) AS label, TRUE AS likeliest FROM lab", NARROW, **_LABELLED),
)
def m13_score(spark, sf_dir):
    """Each row gets the class with the largest probability."""
    df = _prepared(spark, sf_dir)
    model = models.train(df, "rf", "label2")
    p, names = vector_to_array("probability"), F.array(*[F.lit(float(x)) for x in model.stages[0].labels])
    own = F.element_at(p, F.array_position(names, F.col("prediction")).cast("int"))
    return models.score(df, model, "label2").select("id", "cycle", "label", (own == F.array_max(p)).alias("likeliest"))


@_query(
    "m13_score_complete",
    _sql("SELECT id, cycle, CAST(label1 AS DOUBLE) AS label, TRUE AS is_class FROM lab", NARROW, **_LABELLED),
)
def m13_score_complete(spark, sf_dir):
    """Each row is scored once, with one of the classes."""
    df = _prepared(spark, sf_dir)
    scored = models.score(df, models.train(df, "rf", "label1"), "label1")
    return scored.select("id", "cycle", "label", F.col("prediction").isin(0.0, 1.0).alias("is_class"))


_CUT_LABELLED = {
    "truth": oracle.truth(),
    "cut": oracle.truncated(),
    "cutruled": _TEST_CTES["ruled"],
    "cutlab": oracle.with_labels("cutruled"),
}
_NAMES = ["cycle", *NARROW.measures]
_SLOTS = [f"f_{n}" for n in _NAMES]
#: A forest and a regression given by rule, to be scored in both engines.
_GIVEN_FOREST = [
    compiled.Node(
        t % 6, 0.1 + 0.07 * t,
        compiled.Node((t + 2) % 6, 0.05 * t, compiled.Node(values=(0.7, 0.2, 0.1)), compiled.Node(values=(0.1 * t / 9, 0.5, 0.5 - 0.1 * t / 9))),
        compiled.Node((t + 4) % 6, 0.9 - 0.08 * t, compiled.Node(values=(0.2, 0.3, 0.5)), compiled.Node(values=(0.25, 0.05 * t, 0.75 - 0.05 * t))),
    )
    for t in range(9)
]
_GIVEN = {
    "forest": compiled.forest(_GIVEN_FOREST, _SLOTS, ("0", "2", "1")),
    "regression": compiled.regression(
        [[(-1.0) ** (i + k) * (0.3 + 0.2 * i + 0.1 * k) for i in range(6)] for k in range(3)], [0.1, -0.2, 0.05], _SLOTS, ("0", "1", "2")
    ),
    "boosted": compiled.boosted([[n for n in _GIVEN_FOREST[k::3]] for k in range(3)], 0.3, _SLOTS, ("0", "1", "2")),
}
_SCALED_SLOTS = {
    **_LABELLED,
    "rng": "SELECT " + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in _NAMES) + " FROM lab",
    "slots": "SELECT id, lab.cycle, "
    + ", ".join(f"CASE WHEN {c}_hi = {c}_lo THEN 0.5::DOUBLE ELSE (lab.{c} - {c}_lo) / ({c}_hi - {c}_lo)::DOUBLE END AS f_{c}" for c in _NAMES)
    + " FROM lab, rng",
}


def _given_query(name: str) -> Query:
    model = _GIVEN[name]

    def run(spark, sf_dir):
        table = compiled.feature_table(_prepared(spark, sf_dir), _NAMES, ["id", "cycle"])
        return _rounded_doubles(model.score(table, ["id", "cycle"]))

    return run


for _name, _model in _GIVEN.items():
    _query(
        f"m13_given_{_name}",
        _sql(
            "SELECT id, cycle, prediction, " + ", ".join(f"round(probability_{k}, 6) AS probability_{k}" for k in range(3))
            + f" FROM ({_model.sql('slots', ['id', 'cycle'])})",
            NARROW,
            **_SCALED_SLOTS,
        ),
    )(_given_query(_name))


def _compiled_query(kind: str, label: str, **options) -> Query:
    def run(spark, sf_dir):
        """Each row: the compiled statement's class and probabilities against the model's own."""
        df = _prepared(spark, sf_dir)
        model = models.train(df, kind, label, **options)
        written = compiled.compile_model(model, _SLOTS)
        own = models.score(df, model, label)
        scores = [F.col("scores")[k] for k in range(len(written.labels))]
        own = own.withColumn("p", F.array(*boosting.softmax(scores)) if "scores" in own.columns else vector_to_array("probability"))
        keep = ["id", "cycle", "label", "own", "p"]
        source = own.select("id", "cycle", "label", F.col("prediction").alias("own"), "p", "scaledFeatures")
        scored = written.score(compiled.feature_table(source, _NAMES, keep), keep)
        gaps = [F.abs(F.col("p")[k] - F.col(f"probability_{k}")) for k in range(len(written.labels))]
        same = (F.col("prediction") == F.col("own")) & (F.greatest(*gaps) < 1e-9)
        return scored.select("id", "cycle", "label", same.alias("same"))

    return run


for _name, _kind, _label, _options in (
    ("m8_forest_compiled", "rf", "label2", {}),
    ("m11_forest_weighted_compiled", "rf_weighted", "label2", {"numTrees": 12, "maxDepth": 4}),
    ("m6_logistic_compiled", "lr", "label2", {}),
    ("m10_logistic_weighted_compiled", "lr_weighted", "label1", {}),
    ("m12_boosted_compiled", "gbt_weighted", "label2", {"maxIter": 3, "maxDepth": 3}),
):
    _query(_name, _sql(f"SELECT id, cycle, CAST({_label} AS DOUBLE) AS label, TRUE AS same FROM lab", NARROW, **_LABELLED))(
        _compiled_query(_kind, _label, **_options)
    )


@_query(
    "m14_saved_compiled",
    _sql("SELECT id, cycle, CAST(label2 AS DOUBLE) AS label, TRUE AS same FROM cutlab", NARROW, **_CUT_LABELLED),
)
def m14_saved_compiled(spark, sf_dir):
    """A model that was saved and loaded scores another table as its compiled statement does."""
    path = work_path(spark, "model")
    models.save(models.train(_prepared(spark, sf_dir), "rf", "label2"), path)
    model = models.load(path, "RF")
    rows = fx.cut(spark, sf_dir, NARROW, prepare.label_steps(NARROW, fx.truth(spark, sf_dir)))
    own = models.score(_scaled(rows, NARROW), model, "label2")
    source = own.select("id", "cycle", "label", F.col("prediction").alias("own"), "scaledFeatures")
    keep = ["id", "cycle", "label", "own"]
    scored = compiled.compile_model(model, _SLOTS).score(compiled.feature_table(source, _NAMES, keep), keep)
    return scored.select("id", "cycle", "label", (F.col("prediction") == F.col("own")).alias("same"))


@_query("m14_evaluate_saved", _facts_sql("SELECT CAST(least(label2, 1) AS DOUBLE) AS label FROM lab"))
def m14_evaluate_saved(spark, sf_dir):
    data, model = _prepared_path(spark, sf_dir), work_path(spark, "model")
    learn.train_model(spark, data, model, kind="rf")
    return _facts(learn.evaluate_saved(spark, model, data, kind="RF", merged=True))


_GRID_SQL = " UNION ALL BY NAME ".join(
    f"SELECT '{name}' AS dataset, '{target}' AS target, '{kind}' AS kind, CAST({target} AS DOUBLE) AS label FROM {table}"
    for name, table in (("train", "lab"), ("cut", "cutlab"))
    for target in ("label1", "label2")
    for kind in ("lr", "rf")
)


@_query("m15_grid", _facts_sql(_GRID_SQL, **_CUT_LABELLED))
def m15_grid(spark, sf_dir):
    with_truth = prepare.label_steps(NARROW, fx.truth(spark, sf_dir))
    by_set = {
        "train": fx.labelled(spark, sf_dir, NARROW),
        "cut": fx.cut(spark, sf_dir, NARROW, with_truth),
    }
    stored = {}
    for name, table in by_set.items():
        path = work_path(spark, f"grid-{name}")
        sinks.write_parquet(_scaled(table, NARROW), path)
        stored[name] = scans.read_prepared(spark, path)
    return _facts(models.train_grid(stored, ["lr", "rf"]).withColumnRenamed("class", "label"), "dataset", "target", "kind")


@_query(
    "m16_implicit_factors",
    "SELECT DISTINCT CAST(l_partkey AS INT) AS id, CAST(40 AS INT) AS rank, TRUE AS finite"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def m16_implicit_factors(spark, sf_dir):
    vectors = factors.item_factors(factors.fit_implicit(fx.ratings(spark, sf_dir)))
    finite = F.forall("features", lambda v: F.abs(v) < float("inf"))
    return vectors.select("id", F.size("features").alias("rank"), finite.alias("finite"))


@_query(
    "m16_user_residuals",
    "SELECT DISTINCT CAST(o_custkey AS INT) AS id, TRUE AS solved FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def m16_user_residuals(spark, sf_dir):
    """Every user vector solves its normal equations given the item vectors, to single precision."""
    ratings = fx.ratings(spark, sf_dir)
    gaps = factors.user_residuals(factors.fit_implicit(ratings), ratings)
    return gaps.select("id", (F.col("residual") < 1e-2).alias("solved"))


@_query("m17_libsvm_metrics", _sql("SELECT DISTINCT CAST(label2 AS DOUBLE) AS label, TRUE AS agree FROM lab", NARROW, **_LABELLED))
def m17_libsvm_metrics(spark, sf_dir):
    path = work_path(spark, "libsvm")
    df = _prepared(spark, sf_dir)
    sinks.write_libsvm(df, path, "label2", "scaledFeatures")
    return _facts(learn.libsvm_metrics(spark, path, 1 + len(NARROW.measures))).drop("n")


# ---------------------------------------------------------------- jobs


_PREPARED_COLUMNS = ["rul", "label1", "label2"]


def _staged_text(spark: SparkSession, df: DataFrame, name: str, **options) -> str:
    path = work_path(spark, name)
    sinks.write_text_table(df, path, **{"compression": "gzip", **options})
    return path


def _without_mode(df: DataFrame) -> DataFrame:
    return _rounded_doubles(df.drop("operationmode"))


_MEASURED = [*SETTING_NAMES, *SENSOR_NAMES, *MEAN_NAMES, *DEV_NAMES]


def _prepared_sql(extra: dict, more=(), partition="id", table="lab", fitted: dict | None = None) -> str:
    """The prepared table and its scaled features but the mode's; ``fitted`` are CTEs up to ``_fit``, the rows that give the ranges."""
    first, second = oracle.rolling(table, SENSOR_NAMES, partition=partition)
    scaled = ["cycle", *_MEASURED]
    keep = ", ".join([*(f"_devs.{c}" for c in more), "id", "cycle", *_PREPARED_COLUMNS])
    ranges = ", ".join([*more, *(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in scaled)])
    slots = ", ".join(
        f"round(CASE WHEN {c}_max = {c}_min THEN 0.5 ELSE ({c} - {c}_min) / ({c}_max - {c}_min) END, 6) AS scaled_{c}" for c in scaled
    )
    join = " AND ".join(["TRUE", *(f"_devs.{c} = _ranges.{c}" for c in more)])
    fit = fitted or {"_fit": "SELECT * FROM _devs"}
    return _sql(
        f"SELECT {keep}, {oracle.rounded(_MEASURED)}, {slots} FROM _devs JOIN _ranges ON {join}",
        SPEC, **extra, _means=first, _devs=second, **fit, _ranges=f"SELECT {ranges} FROM _fit{' GROUP BY ALL' if more else ''}",
    )


def _train_fit() -> dict:
    """CTEs of the training table, whose ranges a test table is scaled with."""
    first, second = oracle.rolling("trainlab", SENSOR_NAMES)
    return {
        "trainruled": oracle.with_rul(),
        "trainlab": oracle.with_labels("trainruled"),
        "_trainmeans": first,
        "_fit": second.replace("_means", "_trainmeans"),
    }


def _with_slots(df: DataFrame) -> DataFrame:
    """A scaled table with one column for each feature but the mode, whose number is arbitrary."""
    names = ["cycle", *SETTING_NAMES, *SENSOR_NAMES, "operationmode", *MEAN_NAMES, *DEV_NAMES]
    return _without_mode(features.vector_columns(df, "scaledFeatures", names).drop("scaled_operationmode"))


@_query("job_prepare_train", _prepared_sql(_LABELLED))
def job_prepare_train(spark, sf_dir):
    text = _staged_text(spark, fx.telemetry(spark, sf_dir)[0], "train")
    done = prepare.prepare_train(spark, text, work_path(spark, "job-train"), write_csv=False)
    return _with_slots(scans.read_prepared(spark, done.scaled))


def _csv_sql(extra: dict) -> str:
    """The unscaled table of a preparation job but the mode."""
    first, second = oracle.rolling("lab", SENSOR_NAMES)
    keep = ", ".join(["id", "cycle", *_PREPARED_COLUMNS])
    return _sql(f"SELECT {keep}, {oracle.rounded(_MEASURED)} FROM _devs", SPEC, **extra, _means=first, _devs=second)


def _csv_table(spark: SparkSession, done: prepare.Prepared) -> DataFrame:
    """The CSV of a job's unscaled table, read with the types of its Parquet form."""
    schema = scans.read_prepared(spark, done.unscaled).schema
    return _without_mode(spark.read.schema(schema).csv(f"{done.unscaled}.csv", header=True))


@_query("s10_csv_switch", _csv_sql(_LABELLED))
def s10_csv_switch(spark, sf_dir):
    text = _staged_text(spark, fx.telemetry(spark, sf_dir)[0], "train")
    return _csv_table(spark, prepare.prepare_train(spark, text, work_path(spark, "job-csv"), write_csv=True))


@_query("job_toy_run", _csv_sql(_TEST_CTES))
def job_toy_run(spark, sf_dir):
    """The test table that the run writes for looking at by hand."""
    texts = [_staged_text(spark, df, n) for df, n in ((fx.telemetry(spark, sf_dir)[0], "train"), (fx.cut(spark, sf_dir), "test"), (fx.truth(spark, sf_dir), "truth"))]
    return _csv_table(spark, prepare.toy_run(spark, *texts, work_path(spark, "job-toy"), seed=3)[1])


@_query(
    "job_implicit_factors",
    "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id, CAST(40 AS INT) AS factors, TRUE AS six_decimals"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def job_implicit_factors(spark, sf_dir):
    """Ratings as text in, a line of factors for each item out."""
    ratings, output = _staged_text(spark, fx.ratings(spark, sf_dir), "ratings", separator="\t"), work_path(spark, "factors")
    learn.implicit_factors(spark, ratings, output)
    line = F.split("value", "\t")
    values = F.split(line[1], " ")
    decimals = F.forall(values, lambda v: v.rlike(r"^-?\d+\.\d{6}$"))
    return spark.read.text(output).select(line[0].alias("id"), F.size(values).alias("factors"), decimals.alias("six_decimals"))


@_query(
    "m5_label_choice",
    _sql(
        "SELECT '1' AS choice, label1 AS label, CAST(count(*) AS BIGINT) AS n, CAST(2 AS INT) AS classes FROM lab GROUP BY label1"
        " UNION ALL SELECT choice, label2, CAST(count(*) AS BIGINT), CAST(3 AS INT) FROM lab, (VALUES ('2'), ('x')) AS c(choice) GROUP BY choice, label2",
        NARROW, **_LABELLED,
    ),
)
def m5_label_choice(spark, sf_dir):
    """The labels that a model is trained on for each choice, and how many classes it has."""
    df, out = fx.labelled(spark, sf_dir, NARROW), []
    for choice in ("1", "2", "x"):
        column, classes = models.label_column(choice)
        counts = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
        out.append(counts.select(F.lit(choice).alias("choice"), "label", "n", F.lit(classes).alias("classes")))
    return out[0].unionByName(out[1]).unionByName(out[2])


#: Every third unit misses a sensor in its last cycle, and some rows have no unit.
_INCOMPLETE = {
    **_LABELLED,
    "whole": "SELECT * FROM lab WHERE NOT (id % 3 = 0 AND rul = 0)",
}


@_query("job_prepare_incomplete", _prepared_sql(_INCOMPLETE, table="whole"))
def job_prepare_incomplete(spark, sf_dir):
    """A rejected last row still counts for the life of its unit."""
    df = fx.telemetry(spark, sf_dir, SPEC, rul.rul_steps(SPEC))[0]
    ill = (F.col("id") % 3 == 0) & (F.col("rul") == 0)
    broken = df.withColumn("s2", F.when(~ill, F.col("s2"))).drop("rul")
    lost = df.where("cycle = 1").withColumn("id", F.lit(None).cast("int")).drop("rul")
    text = _staged_text(spark, broken.unionByName(lost), "incomplete")
    done = prepare.prepare_train(spark, text, work_path(spark, "job-incomplete"), write_csv=False)
    return _with_slots(scans.read_prepared(spark, done.scaled))


@_query("job_prepare_test", _prepared_sql(_TEST_CTES))
def job_prepare_test(spark, sf_dir):
    text = _staged_text(spark, fx.cut(spark, sf_dir), "test")
    truth = _staged_text(spark, fx.truth(spark, sf_dir), "truth")
    done = prepare.prepare_test(spark, text, truth, work_path(spark, "job-test"))
    return _with_slots(scans.read_prepared(spark, done.scaled))


@_query("job_prepare_test_fitted", _prepared_sql(_TEST_CTES, fitted=_train_fit()))
def job_prepare_test_fitted(spark, sf_dir):
    """A test table scaled with a training run that was saved and is read from its path."""
    train = _staged_text(spark, fx.telemetry(spark, sf_dir)[0], "train")
    text = _staged_text(spark, fx.cut(spark, sf_dir), "test")
    truth = _staged_text(spark, fx.truth(spark, sf_dir), "truth")
    saved = work_path(spark, "fitted")
    prepare.prepare_train(spark, train, work_path(spark, "job-train"), write_csv=False).save(saved)
    done = prepare.prepare_test(spark, text, truth, work_path(spark, "job-test"), saved)
    return _with_slots(scans.read_prepared(spark, done.scaled))


@_query("job_prepare_sets", _prepared_sql(_SETS_CTE, ("dataset",), "dataset, id"))
def job_prepare_sets(spark, sf_dir):
    df = _sets(fx.telemetry(spark, sf_dir)[0])
    names = [f"FD00{i}" for i in range(1, 5)]
    inputs = {
        n: _staged_text(spark, df.where(F.col("dataset") == n).drop("dataset"), n) for n in names
    }
    output = prepare.prepare_sets(spark, inputs, work_path(spark, "job-sets"))
    return _with_slots(scans.read_prepared(spark, output))


@_query(
    "job_prepare_forward",
    _sql(f"SELECT id, cycle AS cykle, rul, label1, label2, {oracle.rounded(SENSOR_NAMES)}, 68 AS features FROM lab", SPEC, **_LABELLED),
)
def job_prepare_forward(spark, sf_dir):
    text = _staged_text(spark, fx.telemetry(spark, sf_dir)[0], "forward")
    done = prepare.prepare_forward(spark, text, work_path(spark, "job-forward"))
    width = F.size(vector_to_array("scaledFeatures")).alias("features")
    table = scans.read_prepared(spark, done.scaled)
    return _rounded_doubles(table.select("id", "cykle", "rul", "label1", "label2", *SENSOR_NAMES, width))


def _frame_texts(spark: SparkSession, sf_dir: str) -> list[str]:
    """Gzip text of train, test and truth; units are numbered from 1, as line numbers are."""
    df = fx.telemetry(spark, sf_dir)[0]
    from_one = F.col("id") - df.select(F.min("id")).scalar() + 1
    texts = {
        "train": df.withColumn("id", from_one),
        "test": fx.cut(spark, sf_dir).withColumn("id", from_one),
        "truth": fx.truth(spark, sf_dir).orderBy("id").select("RUL_at_maxcycle"),
    }
    return [_staged_text(spark, table, f"study-{name}") for name, table in texts.items()]


_FRAME_FEATURES = [c for c in features.frame_features() if c != "cycle"]


def _frame_features_sql() -> str:
    w = "OVER (PARTITION BY part, id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    columns = ["setting1", "setting2"]
    for s in SENSOR_NAMES:
        columns += [
            f"round({s}, 6) AS {s}",
            f"round(CASE WHEN count(*) {w} = 5 THEN avg({s}) {w} ELSE {s} END, 6) AS mean_{s}",
            f"round(CASE WHEN count(*) {w} = 5 THEN stddev_pop({s}) {w} ELSE 0 END, 6) AS stdv_{s}",
        ]
    both = "SELECT 'train' AS part, * FROM lab UNION ALL BY NAME SELECT 'test' AS part, * FROM cutlab"
    return _sql(
        f"SELECT part, CAST(id - first + 1 AS INT) AS id, cycle, rul, label1, label2, {', '.join(columns)}"
        " FROM rows, (SELECT min(id) AS first FROM tel)",
        SPEC,
        **_LABELLED,
        truth=oracle.truth(),
        cut=oracle.truncated(),
        cutruled=_TEST_CTES["ruled"],
        cutlab=oracle.with_labels("cutruled"),
        rows=both,
    )


@_query("job_frame_features", _frame_features_sql())
def job_frame_features(spark, sf_dir):
    train, test, truth = _frame_texts(spark, sf_dir)
    life = scans.read_truth_by_position(spark, truth, per_file=False).drop("file")
    parts = {
        "train": learn.frame_enrich(learn.frame_telemetry(spark, train)),
        "test": learn.frame_enrich(learn.frame_telemetry(spark, test), truth=life),
    }
    both = tables.append(parts, "part")
    return _rounded_doubles(both.select("part", "id", "cycle", "rul", "label1", "label2", *_FRAME_FEATURES))


_STUDY_SQL = " UNION ALL BY NAME ".join(
    f"SELECT '{kind}' AS kind, '{target}' AS target, '{part}' AS part, CAST({target} AS DOUBLE) AS label FROM {table}"
    for kind, target in (("lr_weighted", "label2"), ("lr_weighted", "label1"), ("rf_weighted", "label2"), ("gbt_weighted", "label2"))
    for part, table in (("train", "lab"), ("test", "cutlab"))
)


@_query("job_frame_study", _facts_sql(_STUDY_SQL, **_CUT_LABELLED).replace(", TRUE AS agree", ""))
def job_frame_study(spark, sf_dir):
    """Rows of each true class in the confusion cells of each model and part."""
    cells = learn.frame_study(spark, *_frame_texts(spark, sf_dir), truth_per_file=False)
    return cells.groupBy("kind", "target", "part", "label").agg(F.sum("n").alias("n")).where("n > 0")

"""SQL building blocks for the oracle side of the registered queries (DuckDB spelling)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from wearpath.functions.names import renumbered
from wearpath.plans.fixtures import SPEC, TEST_SHARE
from wearpath.spec import TelemetrySpec


def _sensor(name: str) -> str:
    i = int(name[1:])
    if i == 1:
        return "value"
    if i == 2:
        return "value * k"
    if i == 21:
        return "CAST(8.5 AS DOUBLE)"
    return f"value * {float(i % 5 + 1)}::DOUBLE + k * {float(i % 7)}::DOUBLE"


_SETTINGS = {
    "setting1": "CAST(hour(ts) AS DOUBLE)",
    "setting2": "k",
    "setting3": "CAST(100.0 AS DOUBLE)",
}


def telemetry(spec: TelemetrySpec = SPEC) -> str:
    """Body of the telemetry CTE."""
    columns = [f"{_SETTINGS[c]} AS {c}" for c in spec.settings] + [f"{_sensor(c)} AS {c}" for c in spec.sensors]
    return (
        "SELECT CAST(user_id AS INT) AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
        f" AS INT) AS cycle, {', '.join(columns)} FROM"
        " (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"
    )


LINES = (
    "SELECT CAST(l_suppkey AS INT) AS id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate,"
    " l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount) AS INT) AS cycle,"
    " l_quantity AS s1, l_extendedprice AS s2, l_discount AS s3 FROM lineitem"
)

RATINGS = (
    'SELECT CAST(o_custkey AS INT) AS "user", CAST(l_partkey AS INT) AS item, CAST(sum(l_quantity) AS FLOAT) AS rating'
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"
)


def labels(source: str = "rul") -> str:
    return (
        f"CASE WHEN {source} <= 30 THEN 1 ELSE 0 END AS label1,"
        f" CASE WHEN {source} <= 15 THEN 2 WHEN {source} <= 30 THEN 1 ELSE 0 END AS label2"
    )


def with_rul(table: str = "tel", keys: str = "id") -> str:
    return f"SELECT *, CAST(max(cycle) OVER (PARTITION BY {keys}) - cycle AS INT) AS rul FROM {table}"


def with_labels(table: str = "ruled") -> str:
    return f"SELECT *, {labels()} FROM {table}"


def truncated(table: str = "tel") -> str:
    return (
        f"SELECT * EXCLUDE (_m) FROM (SELECT *, max(cycle) OVER (PARTITION BY id) AS _m FROM {table})"
        f" WHERE cycle <= floor({TEST_SHARE} * _m)"
    )


def truth(table: str = "tel") -> str:
    return (
        f"SELECT id, CAST(max(cycle) - floor({TEST_SHARE} * max(cycle)) AS INT) AS RUL_at_maxcycle"
        f" FROM {table} GROUP BY id"
    )


def rolling(
    table: str, sensors: Sequence[str], partition: str = "id", order: str = "cycle", frame: str = "4 PRECEDING AND CURRENT ROW"
) -> tuple[str, str]:
    """Bodies of two CTEs: means of each row, then deviations from each row's own mean."""
    means, devs = renumbered(sensors, "a"), renumbered(sensors, "sd")
    window = f"WINDOW w AS (PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN {frame})"
    first = ", ".join(f"avg({s}) OVER w AS {m}" for s, m in zip(sensors, means))
    second = ", ".join(
        f"sqrt(sum(({s} - {m}) * ({s} - {m})) OVER w / 5) AS {d}" for s, m, d in zip(sensors, means, devs)
    )
    return f"SELECT *, {first} FROM {table} {window}", f"SELECT *, {second} FROM _means {window}"


def rounded(columns: Iterable[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def with_ctes(ctes: dict[str, str], select: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in ctes.items()) + " " + select

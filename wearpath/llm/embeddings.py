"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearpath.llm.common import map_batches, stored
from wearpath.llm.graph import components

#: Vectors the principal directions are fitted on, about.
FIT_VECTORS = 20_000
#: Leading directions of the grid.
DIMENSIONS = 6
#: Vectors of one interval of the sequence, and of an interval that is compared without further cutting.
INTERVAL, LEAF = 1_000, 64
#: Slack of the skipping tests, far above rounding and far below a cell.
_SLACK = 1e-6


def _unit(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which vectors can link, and all as double arrays of length one (or None)."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = np.array(v.values.to_pylist() if v.is_valid else [], dtype=object) if v.is_valid and v.values.null_count else (
            v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else np.empty(0)
        )
        if x.dtype == object or not len(x) or not np.isfinite(x).all():
            out.append(None)
            continue
        top = np.abs(x).max()
        if top == 0:
            out.append(None)
            continue
        x = x / top
        out.append(x / np.sqrt(x @ x))
    return np.array([u is not None for u in out], bool), out


def usable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(id, label, n, unit): linkable vectors scaled to length one, as bytes of doubles; ``n`` components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, units = _unit(b.column("v"))
            kept = [u for u in units if u is not None]
            mask = pa.array(ok)
            yield pa.record_batch(
                [
                    b.column("id").filter(mask),
                    b.column("label").filter(mask),
                    pa.array([len(u) for u in kept], pa.int32()),
                    pa.array([(u + 0.0).tobytes() for u in kept], pa.binary()),
                ],
                names=["id", "label", "n", "unit"],
            )

    rows = vectors.where(F.col(label_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).alias("v")
    )
    kind = vectors.schema[id_column].dataType.simpleString()
    return map_batches(rows, work, f"id {kind}, label string, n int, unit binary")


def principal_directions(units: DataFrame, vectors: int = FIT_VECTORS, k: int = DIMENSIONS) -> dict[int, np.ndarray]:
    """For each number of components, orthonormal leading directions of about ``vectors`` units drawn by a hash.

    Any orthonormal directions give right results, as a projection never lengthens a
    difference; good ones skip more.
    """
    total = units.count()
    share = min(1.0, vectors / max(1, total))
    drawn = units.where(F.pmod(F.xxhash64("unit"), F.lit(1_000_000)) < share * 1_000_000).select("n", "unit")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for n, u in zip(b.column("n").to_pylist(), b.column("unit").to_pylist()):
                x = np.append(np.frombuffer(u, np.float64), 1.0)
                sums[n] = sums.get(n, 0) + np.outer(x, x)
        for n, s in sums.items():
            yield pa.record_batch([pa.array([n], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["n", "s"])

    totals: dict[int, np.ndarray] = {}
    for n, s in map_batches(drawn, moments, "n int, s binary").toLocalIterator():
        totals[n] = totals.get(n, 0) + np.frombuffer(bytes(s), np.float64).reshape(n + 1, n + 1)
    out = {}
    for n, s in totals.items():
        mean = s[-1, :n] / s[-1, -1]
        values, axes = np.linalg.eigh(s[:n, :n] / s[-1, -1] - np.outer(mean, mean))
        out[n] = np.ascontiguousarray(axes[:, ::-1][:, :k])
    return out


def grid_join(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in a, j in b) with cosine of at least ``threshold``; i < j if ``same``.

    ``pa_`` and ``pb`` are the projections. Intervals of both sequences are halved until
    they are small; a pair of intervals whose boxes are farther apart than the threshold's
    distance is skipped.
    """
    reach = 2 - 2 * threshold + _SLACK
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if same and j1 <= i0:
            continue
        x, y = pa_[i0:i1], pb[j0:j1]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if gap @ gap > reach:
            continue
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            i, j = np.nonzero(a[i0:i1] @ b[j0:j1].T >= threshold)
            i, j = i + i0, j + j0
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
        elif i1 - i0 >= j1 - j0:
            m = (i0 + i1) // 2
            todo += [(i0, m, j0, j1), (m, i1, j0, j1)]
        else:
            m = (j0 + j1) // 2
            todo += [(i0, i1, j0, m), (i0, i1, m, j1)]


class _Forest:
    """Union-find over the rows of two intervals: of all links only those that join something are passed on."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", interval: int = INTERVAL) -> DataFrame:
    """One row for each row of ``vectors``: (id_column, n_links, component_id, kept).

    Two vectors of equal, known label and as many components link at a cosine of at least
    ``threshold`` in double precision. Vectors that are null, zero or hold null or
    non-finite components, and those without label, link with nothing and stay alone.
    Equal directions are one node with a weight, so copies make no pairs. Ids are
    integers and should be distinct: rows that share an id share their links. Null ids stay and link with nothing.

    1. The different unit vectors of each label are sorted by their grid cells on the
       leading principal directions and cut into intervals.
    2. Intervals whose boxes are within reach meet in a join on label and first cell, and
       are compared recursively inside a task.
    3. A task returns link counts and a spanning forest, not the links.
    """
    spark = vectors.sparkSession
    known = vectors.where(F.col(id_column).isNotNull())
    rows = stored(usable(known, id_column, vector_column, label_column).withColumn("node", F.sha2("unit", 256)), "units")
    nodes = rows.groupBy("label", "node").agg(F.first("unit").alias("unit"), F.first("n").alias("n"), F.count("*").alias("weight"), F.min("id").alias("least"))
    axes = spark.sparkContext.broadcast(principal_directions(rows))
    cell = float(np.sqrt(2 - 2 * threshold))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shown = []
            for n, u in zip(b.column("n").to_pylist(), b.column("unit").to_pylist()):
                shown.append((np.frombuffer(u, np.float64) @ axes.value[n]).tolist() if n in axes.value else [0.0])
            yield pa.record_batch([*b.columns, pa.array(shown, pa.list_(pa.float64()))], names=[*b.schema.names, "p"])

    schema = ", ".join(f"{c} {k}" for c, k in nodes.dtypes)
    placed = map_batches(nodes, project, f"{schema}, p array<double>").withColumn("group", F.concat_ws("|", "label", "n")).withColumn(
        "cells", F.transform("p", lambda x: F.floor(x / cell))
    )
    ordered = stored(placed.repartitionByRange(*(["group", "cells", "node"])).sortWithinPartitions("group", "cells", "node"), "grid_order")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            p = np.array([r["p"] for r in held])
            units = b"".join(r["unit"] for r in held)
            ids, weights = [r["least"] for r in held], [r["weight"] for r in held]
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "block": (task << 32) | number, "group": held[0]["group"], "n": held[0]["n"], "ids": ids, "weights": weights,
                        "units": units, "p": p.tobytes(), "lo": p.min(0).tolist(), "hi": p.max(0).tolist(),
                    }
                ],
                schema=block_schema,
            )

        for b in batches:
            for r in b.to_pylist():
                if held and (len(held) >= interval or r["group"] != held[0]["group"]):
                    yield block()
                    held = []
                held.append(r)
        if held:
            yield block()

    id_kind = vectors.schema[id_column].dataType.simpleString()
    block_schema = pa.schema(
        [("block", pa.int64()), ("group", pa.string()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())),
         ("units", pa.binary()), ("p", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]
    )
    blocks = stored(
        map_batches(
            ordered.select("group", "n", F.col("least").cast("bigint").alias("least"), "weight", "unit", "p"),
            cut,
            "block bigint, group string, n int, ids array<bigint>, weights array<bigint>, units binary, p binary, lo array<double>, hi array<double>",
        ),
        "intervals",
    )
    box = blocks.select("block", "group", "lo", "hi", F.floor(F.element_at("lo", 1) / cell).alias("c0"), F.floor(F.element_at("hi", 1) / cell).alias("c1"))
    # intervals meet in the cells of the two leading directions that they span, or in neighbouring ones
    last = F.least(F.size("lo"), F.lit(2))
    box = box.withColumns({"d0": F.floor(F.element_at("lo", last) / cell), "d1": F.floor(F.element_at("hi", last) / cell)})
    span = lambda df, more: df.select("*", F.explode(F.sequence(F.col("c0") - more, F.col("c1") + more)).alias("c")).select(
        "*", F.explode(F.sequence(F.col("d0") - more, F.col("d1") + more)).alias("d")
    )
    left, right = span(box, 0).alias("x"), span(box, 1).alias("y")
    gap = F.zip_with(
        F.zip_with("x.lo", "y.hi", lambda a, b: a - b), F.zip_with("y.lo", "x.hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))
    )
    near = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= cell * cell + _SLACK
    pairs = stored(
        left.join(right, (F.col("x.group") == F.col("y.group")) & (F.col("x.c") == F.col("y.c")) & (F.col("x.d") == F.col("y.d")) & (F.col("x.block") <= F.col("y.block")) & near)
        .select(F.col("x.block").alias("i"), F.col("y.block").alias("j"))
        .distinct(),
        "interval_pairs",
    )
    data = [F.struct("n", "ids", "weights", "units", "p").alias(c) for c in ("x", "y")]
    met = (
        pairs.repartition("i", "j").join(blocks.select(F.col("block").alias("i"), data[0]), "i").join(blocks.select(F.col("block").alias("j"), data[1]), "j")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x, y, same = r["x"], r["y"], r["i"] == r["j"]
                n, mx, my = x["n"], len(x["ids"]), len(y["ids"])
                ux, uy = (np.frombuffer(s["units"], np.float64).reshape(-1, n) for s in (x, y))
                px, py = (np.frombuffer(s["p"], np.float64).reshape(len(s["ids"]), -1) for s in (x, y))
                wx, wy = np.array(x["weights"]), np.array(y["weights"])
                cx, cy, forest, edges = np.zeros(mx, np.int64), np.zeros(my, np.int64), _Forest(mx + my), []
                shift = 0 if same else mx
                for i, j in grid_join(ux, px, uy, py, threshold, same):
                    np.add.at(cx, i, wy[j])
                    np.add.at(cx if same else cy, j, wx[i])
                    for s, t in zip(i.tolist(), j.tolist()):
                        if forest.join(s, t + shift):
                            edges.append((x["ids"][s], y["ids"][t], 0))
                rows = edges + [(x["ids"][k], None, int(cx[k])) for k in np.nonzero(cx)[0]] + ([] if same else [(y["ids"][k], None, int(cy[k])) for k in np.nonzero(cy)[0]])
                a, c, d = zip(*rows) if rows else ((), (), ())
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], names=["a", "b", "links"])

    found = stored(map_batches(met, compare, "a bigint, b bigint, links bigint", rows=8), "vector_links")
    joined = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    per_node = (
        nodes.withColumn("key", F.col("least").cast("bigint"))
        .join(joined.withColumnRenamed("id", "key"), "key", "left")
        .join(counts.withColumnRenamed("a", "key"), "key", "left")
        .select(
            "label", "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "key").alias("component_id")
        )
    )
    linked = rows.join(per_node, ["label", "node"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return (
        vectors.select(F.col(id_column).alias("id"))
        .join(linked, "id", "left")
        .select(
            F.col("id").alias(id_column),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component_id", F.col("id").cast("bigint")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
    )


#: ``near_vectors`` over ``embeddings`` in SQL.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id != y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(vec_id, m), vec_id) AS component_id,
  coalesce(least(vec_id, m), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON vec_id = a
LEFT JOIN (SELECT a AS c, min(b) AS m FROM reach GROUP BY a) ON vec_id = c
"""

"""Linking the members of buckets, and connected components, as joins and aggregations.

Hot buckets are the normal case: a third of all rows may be variants of one text. Neither a
bucket nor a component is ever gathered, and the pairs within a bucket are never listed
while they can already be reached from each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from wearpath.llm.common import dropped, map_batches, stored

#: Star rounds before the pairs that are left are compared; the rounds only save work.
STAR_ROUNDS = 5
#: Cross pairs for each member row at which comparing them beats one more star round.
FEW_PAIRS = 50
FEW_PAIRS_LEAST = 20_000_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (id, component), the smallest id of each.

    Tasks first link their own edges' nodes to the smallest they reach. Then each round deals
    all edges out by both ends, in order, and streams over them: a node and its neighbours
    are linked to the smallest of them. The rounds end when every node is that smallest one
    or has no other neighbour; their number is logarithmic. A round is one shuffle, and is written to
    the shared folder. The few nodes with a large share of all edges are dealt out in
    parts, which know the node's smallest neighbour from one aggregation. Repeated edges and
    loops do no harm; an id without an edge has no row, and no edges give no rows.
    """
    kind = edges.schema["a"].dataType.simpleString()
    now = stored(map_batches(edges.where("a != b").select("a", "b"), _contracted, f"hi {kind}, lo {kind}", rows=CHUNK), "edges")
    table, rows = now, 2 * now.count()
    if not rows:
        return now.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    while True:
        both = now.union(now.select("lo", "hi")).toDF("u", "v")
        hubs = _hubs(both, rows)
        part = F.when(F.col("u").isin(list(hubs)), F.pmod(F.xxhash64("v"), F.lit(HUB_PARTS))).otherwise(0) if hubs else F.lit(0)
        dealt = both.withColumn("part", part).repartition("u", "part").sortWithinPartitions("u", "part", "v").drop("part")
        seen = Observation()
        linked = dealt.mapInArrow(_linker(hubs), f"hi {kind}, lo {kind}, own boolean, open boolean")
        counts = [F.count_if(F.col("open")).alias("open"), F.count_if(~F.col("own") & (F.col("hi") != F.col("lo"))).alias("n"), F.count_if(F.col("own") & (F.col("hi") != F.col("lo"))).alias("m")]
        out = stored(linked.observe(seen, *counts), "edges")
        dropped(table)
        table, found = out, seen.get
        if not found["open"]:
            own = out.where("own").select(F.col("hi").alias("id"), F.col("lo").alias("component"))
            return own.distinct() if hubs else own  # a hub has a row from each of its parts
        now, rows = out.where("hi != lo").select("hi", "lo"), 2 * (found["n"] + found["m"])


#: Edges that a task links among themselves at once, rows from which a node may be a hub, and a hub's parts.
CHUNK, HUB, HUB_PARTS = 50_000, 50_000, 64


class _Sets:
    """Union-find with the smallest member as root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        up = self.up
        up[min(a, b)] = up[max(a, b)] = min(a, b)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's nodes with the smallest node that its edges reach."""
    for batch in batches:
        sets = _Sets()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.join(a, b)
        pairs = [(x, r) for x in sets.up if (r := sets.root(x)) != x]
        kind = batch.schema.field(0).type
        yield pa.record_batch([pa.array(c, kind) for c in (list(zip(*pairs)) or [(), ()])], names=["hi", "lo"])


def _hubs(both: DataFrame, rows: int) -> dict:
    """Nodes with over a thousandth of the rows, so fewer than a thousand, and the smallest neighbour of each."""
    if rows <= HUB:
        return {}
    many = [r["u"] for r in both.groupBy("u").count().where(F.col("count") > max(HUB, rows // 1000)).collect()]
    if not many:  # as most often: then no smallest neighbour is searched
        return {}
    return {r["u"]: r["m"] for r in both.where(F.col("u").isin(many)).groupBy("u").agg(F.min("v").alias("m")).collect()}


def _linker(hubs: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (u, v) in order: each u (``own``) and each other v with the smallest of u and its neighbours.

    ``open`` marks a u whose neighbourhood is not settled: u is not the smallest and has more than that neighbour.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = least = last = None
        for batch in batches:
            hi, lo, own, open_ = [], [], [], []
            for x, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x != u:
                    u, last = x, None
                    least = min(x, v, hubs.get(x, v))
                    hi.append(x)
                    lo.append(least)
                    own.append(True)
                    open_.append(False)
                if v != last:
                    last = v
                    if v != least:
                        hi.append(v)
                        lo.append(least)
                        own.append(False)
                        open_.append(least != u)
            kind = batch.schema.field(0).type
            yield pa.record_batch([pa.array(hi, kind), pa.array(lo, kind), pa.array(own, pa.bool_()), pa.array(open_, pa.bool_())], names=["hi", "lo", "own", "open"])

    return work


def joined_components(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``found`` (id, component) after more ``links`` (a, b): only the old components that these connect are searched again."""
    old = found.select(F.col("id").alias("x"), F.col("component").alias("c"))
    ends = links.select("a", "b")
    for end in "ab":
        ends = ends.join(old.withColumnRenamed("x", end), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    merged = stored(components(ends.distinct()), "merged")
    known = found.join(merged.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
    whole = known.select("id", F.coalesce("top", "component").alias("component"))
    return whole.unionByName(merged.join(found.select("id"), "id", "left_anti"))


def shared_buckets(rows: DataFrame, bucket: list[str], spread: bool = True) -> DataFrame:
    """Rows (bucket..., id, leader) of buckets with at least two ids: each id but the leader once.

    ``rows`` may repeat. One shuffle; the window streams over its sorted rows, so a hot
    bucket takes no memory. The same ids have different leaders in different buckets, or with
    ``spread=False`` the same leader wherever it is in the bucket.
    """
    order = Window.partitionBy(*bucket).orderBy(F.xxhash64("id", *(bucket if spread else [])), "id")
    first = F.first("id").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        rows.withColumn("leader", first)
        .withColumn("_last", F.lag("id").over(order))
        .where((F.col("leader") != F.col("id")) & (F.col("_last") != F.col("id")))
        .drop("_last")
    )


def link_buckets(
    members: DataFrame,
    bucket: list[str],
    verify: Callable[[DataFrame], DataFrame],
    compare: Callable[[DataFrame, list[str]], DataFrame],
    first_pairs: DataFrame | None = None,
) -> DataFrame:
    """Components (id, component) of all verified pairs that share a bucket.

    ``members`` comes from ``shared_buckets`` and is read several times (store it).
    ``verify`` keeps the true pairs of a table (a, b). ``compare`` gets rows (bucket..., id,
    c) and returns links (a, b) that connect whatever the true pairs with different ``c`` in
    a bucket connect.

    1. Each member is compared with its bucket's leader, or ``first_pairs`` (a, b) instead,
       and components are formed.
    2. Buckets whose members are in one component are done: further pairs would change
       nothing. In the others new leaders are compared, until the pairs between different
       components are few or the rounds are used up.
    3. Every pair in a bucket that is still in two components is compared.

    The components are those of comparing all pairs of all buckets. Ids without a link have
    no row.
    """
    pairs = members.select(F.col("id").alias("a"), F.col("leader").alias("b")) if first_pairs is None else first_pairs
    found = stored(components(stored(verify(pairs.distinct()), "links")), "components")
    leaders = members.select(*bucket, F.col("leader").alias("id")).distinct()
    everyone = stored(members.drop("leader").unionByName(leaders), "members")
    total = everyone.count()
    for turn in range(STAR_ROUNDS):
        marked = everyone.join(found, "id", "left").withColumn("c", F.coalesce("component", "id"))
        per = marked.groupBy(*bucket, "c").agg(F.count("*").alias("n"))
        mixed = (
            per.groupBy(*bucket)
            .agg(
                F.count("*").alias("parts"),
                F.sum("n").alias("n"),
                F.sum(F.col("n").cast("double") * F.col("n")).alias("q"),
            )
            .where("parts > 1")
            .select(*bucket, F.col("n").alias("size"), ((F.col("n").cast("double") * F.col("n") - F.col("q")) / 2 / F.col("n")).alias("w"))
        )
        open_rows = stored(marked.join(mixed, bucket).select(*bucket, "id", "c", "size", "w"), "open")
        left = open_rows.agg(F.count("*"), F.sum("w")).first()
        if not left[0]:
            return found
        if left[1] <= max(FEW_PAIRS * total, FEW_PAIRS_LEAST) or turn == STAR_ROUNDS - 1:
            break
        order = Window.partitionBy(*bucket).orderBy(F.xxhash64("id", F.lit(turn), *bucket), "id")
        first = F.first(F.struct("id", "c")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        pairs = open_rows.withColumn("f", first).where("f.c != c").select(F.col("id").alias("a"), F.col("f.id").alias("b"))
        found = stored(joined_components(found, stored(verify(pairs.distinct()), "links")), "components")
    more = stored(compare(open_rows.drop("w"), bucket), "links")
    return stored(joined_components(found, more), "components")

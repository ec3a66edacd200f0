"""Best-fit packing of token sequences: pack locally, emit full bins, merge what is left up a tree."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearpath.llm.common import as_bytes, chunks, map_batches, stored

#: Items that one task packs at a time; the tree narrows by this number.
ITEMS_PER_TASK = 40_000
#: Share of a bin from which a bin is closed before the last round.
NEARLY_FULL = 0.998

#: Letters that both tokenizer libraries are tested to class alike; other texts go to the slower one.
_COMMON = re.compile("[\x00-ɏ -⁯]*")


class Encoder:
    """Ids of a byte-level tokenizer file. ``tokenizers`` is the measure; ``tiktoken`` gives the same ids faster.

    The faster library takes texts of Latin letters and general punctuation. All others, and
    all texts if ``fast_ranks`` is not given, go through ``tokenizers``.
    """

    def __init__(self, tokenizer_json: str, fast_ranks: dict[bytes, int] | None = None, pattern: str = "", special: dict[str, int] | None = None):
        self.json, self.ranks, self.pattern, self.special = tokenizer_json, fast_ranks, pattern, special or {}
        self._slow = self._fast = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_slow": None, "_fast": None}

    @classmethod
    def read(cls, json_path: str, ranks_path: str | None = None, pattern: str = "") -> Encoder:
        import base64
        import json

        with open(json_path, encoding="utf-8") as f:
            text = f.read()
        special = {t["content"]: t["id"] for t in json.loads(text)["added_tokens"]}
        ranks = None
        if ranks_path:
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(text, ranks, pattern, special)

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks and _COMMON.fullmatch(text):
            if self._fast is None:
                import tiktoken

                self._fast = tiktoken.Encoding("packing", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens=self.special)
            return np.asarray(self._fast.encode(text, allowed_special="all"), dtype="<u4")
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.json)
        return np.asarray(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first takes the remainder, all others are full."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, encoder: Encoder, size: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", tokens: bool = False) -> DataFrame:
    """The pieces of all texts: (id, piece, start, length, ids_crc32), with ``ids`` if ``tokens``.

    Every text ends with ``end_id``; null and empty texts are that id alone. Only texts of
    more than ``size`` tokens are cut. The text is encoded whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(encoder)
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * tokens

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows, at = [], []
                for i, t in enumerate(part.column("text")):
                    text = t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else ""
                    ids = np.append(shared.value(text), np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cuts(len(ids), size)):
                        piece = ids[start : start + length]
                        rows.append((k, start, length, zlib.crc32(piece.tobytes())) + ((piece,) if tokens else ()))
                        at.append(i)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.record_batch([part.column("id").take(pa.array(at, pa.int64())), *columns], names=names)

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * tokens
    return map_batches(as_bytes(docs, id_column, text_column), work, schema)


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each item by best fit in decreasing order: the fullest bin that has room, else a new one."""
    bins = np.empty(len(lengths), np.int64)
    free: list[int] = []  # the sorted different amounts of room
    with_room: dict[int, list[int]] = {}
    count = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        k = bisect_left(free, n)
        if k == len(free):
            b, room = count, size
            count += 1
        else:
            room = free[k]
            b = with_room[room].pop()
            if not with_room[room]:
                del with_room[room], free[k]
        bins[i] = b
        if room > n:
            if room - n not in with_room:
                with_room[room - n] = []
                insort(free, room - n)
            with_room[room - n].append(b)
    return bins


def _pack(items: DataFrame, size: int, turn: int, closed_from: int, limit: int) -> DataFrame:
    """One round: (item, bin, length, done). Bins are numbered apart for all tasks and rounds.

    ``length`` is the item's; ``total`` the bin's. A task packs ``limit`` items at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        base = (turn << 56) | (task << 32)
        held: list[pa.RecordBatch] = []
        used = n = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal used
            t = pa.Table.from_batches(held).combine_chunks()
            lengths = t.column("length").to_numpy()
            bins = best_fit(lengths, size)
            totals = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
            out = pa.table(
                {"item": t.column("item"), "bin": bins + (base + used), "length": t.column("length"), "total": totals, "done": totals >= closed_from}
            )
            used += int(bins.max()) + 1
            yield from out.to_batches(max_chunksize=50_000)

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= limit:
                yield from packed()
                held, n = [], 0
        if n:
            yield from packed()

    return items.mapInArrow(work, "item bigint, bin bigint, length bigint, total bigint, done boolean")


def pack(lengths: DataFrame, size: int = 1024, items_per_task: int = ITEMS_PER_TASK, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """Bins for ``lengths`` (item BIGINT, length 1 to ``size``): (item, bin, offset).

    Partitions pack their items by best fit. Bins that are nearly full, or that no item
    could still enter as every item is longer than their room, are final. The others become
    items themselves and are packed again in a few partitions less, until one partition is
    left or a round saves no bin. No task holds more than ``items_per_task`` items at once.
    Offsets are gapless from 0 in each bin. Items must be distinct; an empty table gives no rows.
    """
    spark = lengths.sparkSession
    summary = lengths.agg(F.count("*").alias("n"), F.min("length").alias("least")).first()
    if not summary["n"]:
        return spark.createDataFrame([], "item bigint, bin bigint, offset bigint")
    closed_from = min(int(nearly_full * size), size - summary["least"] + 1) if summary["least"] else int(nearly_full * size)
    rounds: list[DataFrame] = []
    items, left = lengths.select("item", "length"), summary["n"]
    while True:
        parts = max(1, -(-left // items_per_task))
        spread = items.repartition(parts, F.xxhash64("item", F.lit(len(rounds))))
        packed = stored(_pack(spread, size, len(rounds), closed_from, items_per_task), "packed")
        rounds.append(packed)
        over = packed.where("!done").select(F.col("bin").alias("item"), F.col("total").alias("length")).distinct()
        now = over.count() if parts > 1 else 0
        if now < 2 or now >= left:
            break
        items, left = over, now
    # from the top down: a bin of a lower round lies in a bin of the next at some offset
    placed = None
    for packed in reversed(rounds):
        order = _offsets(packed)
        if placed is None:
            placed = order
        else:
            upper = placed.select(F.col("item").alias("bin"), F.col("bin").alias("outer"), F.col("offset").alias("shift"))
            placed = order.join(upper, "bin", "left").select(
                "item", F.coalesce("outer", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
            )
        placed = stored(placed, "placed")
    return placed


def _offsets(packed: DataFrame) -> DataFrame:
    """Place of each item in its bin; a bin holds at most ``size`` items."""
    from pyspark.sql import Window

    before = Window.partitionBy("bin").orderBy(F.desc("length"), "item").rowsBetween(Window.unboundedPreceding, -1)
    return packed.select("item", "bin", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, encoder: Encoder, size: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", tokens: bool = False) -> DataFrame:
    """(id_column, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    Full pieces are sequences of their own and take no part in the packing; each text has
    at most one other piece. Repeated rows and null ids are packed like any others, null and empty texts
    are one piece of the end id; an empty table gives no rows. With
    ``tokens`` the ids come along, for ``sequences``.
    """
    cut = stored(pieces(docs, encoder, size, end_id, id_column, text_column, tokens).withColumn("item", F.monotonically_increasing_id()), "pieces")
    bins = pack(cut.where(F.col("length") < size).select("item", "length"), size)
    out = [F.col("id").alias(id_column), *cut.columns[1:-1]]
    part = cut.where(F.col("length") < size).join(bins, "item").select(*out, F.col("bin").alias("sequence_id"), "offset")
    whole = cut.where(F.col("length") == size).select(*out, (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return part.unionByName(whole)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from ``pack_documents(tokens=True)``; at most ``size`` tokens meet in a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))

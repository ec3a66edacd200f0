"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearpath.llm.common import as_bytes, map_batches, stored
from wearpath.llm.graph import _Sets, link_buckets, shared_buckets

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Shingles whose bits are counted at once.
_SLICE = 200_000
#: Fingerprints of one bucket that a task compares with as many others at once.
BLOCK = 2_000


def word_shingles(text: bytes | None, width: int) -> Iterator[bytes]:
    """The shingles of a text in order, words lower-cased; a text of fewer words is one shingle, a wordless one has none."""
    words = _WORDS.findall(text.lower()) if text else []  # bytes.lower() touches A-Z only
    if len(words) < width:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(width))))


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The fingerprint of one UTF-8 text; zero if it has no word."""
    words = _WORDS.findall(text.lower()) if text else []  # bytes.lower() touches A-Z only
    if not words:
        return 0
    last = max(1, len(words) - width + 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for start in range(0, last, _SLICE):
        part = words[start : min(last, start + _SLICE) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)))) if last > 1 or len(words) >= width else [b" ".join(words)]
        h = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): the 64 majority bits of the shingles' XXH64, as a signed BIGINT. Null and wordless texts: 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("id"), pa.array(found)], names=["id", "fp"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(as_bytes(docs, id_column, text_column), work, f"id {kind}, fp bigint")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Bit masks such that any two values within ``radius`` agree under one of them at least.

    Each bit position carries a non-zero vector of radius + 1 bits; the mask of vector v
    holds the positions whose vector has odd overlap with v. At most ``radius`` differing
    positions leave a non-zero v that overlaps all of them evenly, so that mask misses every
    difference. There are 2^(radius+1) - 1 masks of about half the bits.
    """
    vectors = 2 ** (radius + 1) - 1
    return [
        sum(1 << i for i in range(bits) if (v & (1 + i % vectors)).bit_count() % 2) for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def compare_blocks(rows: DataFrame, bucket: list[str], radius: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the fingerprints within ``radius`` of each bucket in ``rows`` (bucket..., id, c, size).

    A bucket is cut into blocks of about ``block`` fingerprints, and each pair of blocks is one group of
    a task, so a group is bounded however large the bucket is.
    """
    own = rows.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    group = F.struct(*bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = (
        own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(F.to_json(group).alias("g"), "own", "id", "c")
        .repartition("g")
        .sortWithinPartitions("g", "own", "id")
    )

    def links(side: np.ndarray, ids: np.ndarray, comps: np.ndarray) -> list[tuple[int, int]]:
        first = int(np.searchsorted(side, side[-1]))  # of the second block; 0 if the group is one block
        out, sets = [], _Sets()
        for i in range(first or len(ids)):
            start = first or i + 1
            near = np.nonzero(np.bitwise_count(ids[start:].view(np.uint64) ^ ids[i : i + 1].view(np.uint64)) <= radius)[0] + start
            for j in near.tolist():
                a, b = sets.root(int(comps[i])), sets.root(int(comps[j]))
                if a != b:
                    sets.join(a, b)
                    out.append((int(ids[i]), int(ids[j])))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def packed() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            a, b = zip(*found) if (found := links(*columns)) else ((), ())
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            names = batch.column("g").to_pylist()
            arrays = [batch.column(c).to_numpy() for c in ("own", "id", "c")]
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for i, j in zip(cuts, cuts[1:]):
                if held and names[i] != last:
                    yield packed()
                    held = []
                last = names[i]
                held.append([c[i:j] for c in arrays])
        if held:
            yield packed()

    return met.mapInArrow(work, "a bigint, b bigint")


def near_components(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Connect equal or near fingerprints of ``fps`` (id, fp): rows (fp, component_id).

    ``component_id`` is the smallest id that can be reached by links of at most ``radius``
    differing bits. Equal fingerprints are one node however many rows have them. Every pair
    within the radius meets in some table, so the components are exact.
    """
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    masks = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(covering_masks(radius))))
    rows = nodes.select(F.col("fp").alias("id"), F.explode(masks).alias("x")).select(
        F.col("x.t").alias("t"), F.col("id").bitwiseAND(F.col("x.m")).alias("k"), "id"
    )
    members = stored(shared_buckets(rows, ["t", "k"]), "buckets")

    def close(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)

    found = link_buckets(members, ["t", "k"], close, lambda rows, bucket: compare_blocks(rows, bucket, radius))
    joined = nodes.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    least = joined.groupBy("c").agg(F.min("least").alias("component_id"))
    return joined.join(least, "c").select("fp", "component_id")


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """(id_column, fp, fingerprint, component_id) for every row of ``docs``.

    Null ids are kept as rows and never become a component's id unless all its ids are null.
    Repeated rows stay repeated. An empty table gives no rows. Other columns are not read.
    """
    fps = stored(fingerprints(docs, id_column, text_column, width), "simhash")
    return fps.join(near_components(fps, radius), "fp").select(
        F.col("id").alias(id_column), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Rows with that id all stay."""
    keep = (
        simhash_groups(docs, id_column, text_column, radius, width)
        .where(F.col(id_column).eqNullSafe(F.col("component_id")))
        .select(F.col(id_column).alias("keep"))
        .distinct()
    )
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name can clash
    key = F.col(f"c{docs.columns.index(id_column)}")
    return plain.join(keep, key.eqNullSafe(F.col("keep")), "left_semi").toDF(*docs.columns)

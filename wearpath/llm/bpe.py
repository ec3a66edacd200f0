"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from wearpath.llm.common import as_bytes, chunks, map_batches

_WORD = 0xFFFFFFFF
_ODD = 0x9E3779B97F4A7C15
#: Pre-tokens of one text that are handled at once.
SLICE_TOKENS = 400_000
#: Pre-tokens outside the vocabulary whose merges a Python worker remembers.
REMEMBERED = 1_000_000


class PerfectHash:
    """Minimal perfect hash of byte strings: hash, displace, compare. ``get`` gives a key's position in ``keys``."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.buckets = max(1, n // 3)
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            groups[(h >> 32) % self.buckets].append((h, i))
        self.shift = [0] * self.buckets
        self.slots: list[int] = [-1] * n
        self.keys = keys
        self.arrays: tuple[np.ndarray, np.ndarray] | None = None
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for b in order:
            group = groups[b]
            if len(group) < 2:
                break
            d = 0
            while True:
                d += 1
                places = [((h ^ d * _ODD) & _WORD) % n for h, _ in group]
                if len(set(places)) == len(places) and all(self.slots[p] < 0 for p in places):
                    break
            self.shift[b] = d
            for p, (_, i) in zip(places, group):
                self.slots[p] = i
        free = (p for p, i in enumerate(self.slots) if i < 0)
        for b in order:
            if len(groups[b]) == 1:  # a single key takes a free slot by its number
                p = next(free)
                self.shift[b] = -p - 1
                self.slots[p] = groups[b][0][1]

    def get(self, key: bytes) -> int:
        """Position of ``key``, or -1."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[(h >> 32) % self.buckets]
        i = self.slots[-d - 1 if d < 0 else ((h ^ d * _ODD) & _WORD) % len(self.slots)]
        return i if self.keys[i] == key else -1

    def get_all(self, keys: list[bytes]) -> list[int]:
        """``get`` for many keys; the arithmetic runs on arrays."""
        if self.arrays is None:
            self.arrays = np.array(self.shift), np.array(self.slots)
        shift, slots = self.arrays
        h = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        d = shift[((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)]
        with np.errstate(over="ignore"):
            moved = (h ^ d.astype(np.uint64) * np.uint64(_ODD)) & np.uint64(_WORD)
        found = slots[np.where(d < 0, -d - 1, (moved % np.uint64(len(slots))).astype(np.int64))].tolist()
        known = self.keys
        return [i if known[i] == key else -1 for i, key in zip(found, keys)]


class Vocabulary:
    """Ranks of byte strings and the pattern that cuts texts into pre-tokens. Sent to tasks as one broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.whole = PerfectHash(list(ranks))
        self.ids = list(ranks.values())
        self.piece = {i: b for b, i in ranks.items()}
        self.text = {i: str(i) for i in self.ids}
        self.merged: dict[str, tuple[int, ...]] = {}

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the pair of lowest rank, leftmost first, is merged until none has a rank.

        ``end`` and ``before`` link the parts; ``pair`` holds the rank of each part's pair
        with the next part. Heap entries that no longer agree with it are stale.
        """
        n, rank = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank(data[i : i + 2], -1) for i in range(n - 1)] + [-1]
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top & _WORD
            if pair[i] != top >> 32:
                continue
            j = end[i]
            k = end[i] = end[j]
            pair[j] = pair[i] = -1
            if k < n:
                before[k] = i
                r = rank(data[i : end[k]], -1)
                if r >= 0:
                    pair[i] = r
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = pair[h] = rank(data[h:k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def resolve(self, tokens: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of different pre-tokens: by the perfect hash, else merged; merges are remembered."""
        if len(self.merged) >= REMEMBERED:
            self.merged.clear()
        merged = self.merged
        out = {t: merged[t] for t in tokens if t in merged}
        rest = [t for t in tokens if t not in out]
        data = [t.encode("utf-8") for t in rest]
        for token, key, i in zip(rest, data, self.whole.get_all(data)):
            if i >= 0:
                out[token] = (self.ids[i],)
            else:
                out[token] = found = self.merge(key)
                if len(token) < 64:
                    merged[token] = found
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[Iterator[list[int]]]:
        """For each text its ids, in slices. Different pre-tokens of the texts are resolved once."""
        cut = regex.compile(self.pattern)
        split = [cut.findall(t) if len(t) <= SLICE_TOKENS else None for t in texts]
        known = self.resolve(set(chain.from_iterable(filter(None, split))))
        for text, tokens in zip(texts, split):
            if tokens is not None:
                yield iter([list(chain.from_iterable(map(known.__getitem__, tokens)))])
            else:
                yield self._slices(m[0] for m in cut.finditer(text))

    def _slices(self, tokens: Iterator[str]) -> Iterator[list[int]]:
        while part := list(islice(tokens, SLICE_TOKENS)):
            known = self.resolve(set(part))
            yield list(chain.from_iterable(map(known.__getitem__, part)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.piece.__getitem__, ids))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else "" for t in batch.column("text")]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, ids): the ids of every whole text. Null and empty texts: no ids.

    Repeated rows and null ids stay as they are; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = [list(chain.from_iterable(s)) for s in shared.value.encode(_texts(part))]
                yield pa.record_batch([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(as_bytes(docs, id_column, text_column), work, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id_column, text): the bytes of each row's ids. Null ids: null; an unknown id raises."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [shared.value.decode(x.as_py()) if x.is_valid else None for x in b.column("ids")]
            yield pa.record_batch([b.column("id"), pa.array(texts, pa.binary())], names=["id", "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    rows = encoded.selectExpr(f"`{id_column}` AS id", f"`{ids_column}` AS ids")
    return map_batches(rows, work, f"id {kind}, text binary").withColumnRenamed("id", id_column)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text, decode the ids, and return digests of both in one pass.

    Columns id_column, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256
    (decoded bytes). Long texts go through in slices, so neither ids nor bytes of a whole
    text are held. Null texts are empty. Repeated rows and null ids stay, other columns are
    not read, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def digests(slices: Iterator[list[int]], v: Vocabulary) -> tuple[int, str, str]:
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids in slices:
            ids_hash.update(((" " if n and ids else "") + " ".join(map(v.text.__getitem__, ids))).encode())
            text_hash.update(v.decode(ids))
            n += len(ids)
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                n, a, b = zip(*(digests(s, v) for s in v.encode(_texts(part))))
                yield pa.record_batch(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(as_bytes(docs, id_column, text_column), work, schema).withColumnRenamed("id", id_column)

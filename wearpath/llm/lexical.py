"""Ranked lexical search: every document is scanned once for the terms of all items, then scored; there is no index."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearpath.llm.common import as_bytes, chunks, map_batches

#: Bytes of item texts whose terms make one automaton; more items are searched in several blocks.
BLOCK_BYTES = 4_000_000
#: Cells of the (documents, items) table that a task fills at once, and candidates it holds.
CELLS, CANDIDATES = 1_000_000, 200_000
#: Parts of an item's candidates that are ranked before they meet.
PARTS = 64

#: Digits, letters and bytes above ASCII stay, A-Z becomes a-z, all others become the guard.
_GUARD = b" "
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def guarded(text: bytes) -> bytes:
    """A UTF-8 text with guards instead of everything between its terms, and at both ends."""
    return _GUARD + text.translate(_TABLE) + _GUARD


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order, as strings of Latin-1 characters that stand for the UTF-8 bytes."""
    return [t.decode("latin-1") for t in guarded((text or "").encode("utf-8", "replace")).split()]


class Items:
    """A block of items: their terms, and for each term the items that hold it and how often."""

    def __init__(self, rows: list[tuple], kind: pa.DataType):
        texts: dict = defaultdict(set)
        for item, text in rows:
            texts[item].add(text)
        self.ids = pa.array(list(texts), kind)
        number: dict[str, int] = {}
        held = [Counter(number.setdefault(t, len(number)) for text in some for t in terms_of(text)) for some in texts.values()]
        self.terms = list(number)
        flat = sorted((t, i, n) for i, found in enumerate(held) for t, n in found.items())
        self.items, self.times = np.array([f[1] for f in flat], np.int64), np.array([f[2] for f in flat], np.int64)
        self.first = np.searchsorted(np.array([f[0] for f in flat], np.int64), np.arange(len(number) + 1))
        self.weights = np.zeros(len(number), np.int64)
        self.documents = self.length = 0
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def hits(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Of a guarded text: its number of terms, the numbers of the items' terms in it, and their occurrences.

        A term is looked for between two guards, so it is never found inside another one, and at most one ends at each place.
        """
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, term in enumerate(self.terms):
                self._automaton.add_word(f" {term} ", k)
            self._automaton.make_automaton()
        found = [k for _, k in self._automaton.iter(text.decode("latin-1"))] if self.terms else []
        return len(text.split()), *np.unique(np.array(found, np.int64), return_counts=True)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for t in batch.column("text"):
        yield guarded(t.as_buffer().to_pybytes() if t.is_valid else b"")


def _weigh(docs: DataFrame, block: Items) -> Items:
    """``block`` with the term weights and the sums over all documents; each task sends a number for each term at most."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        df, documents, length = np.zeros(len(own.terms), np.int64), 0, 0
        for batch in batches:
            for text in _texts(batch):
                n, found, _ = own.hits(text)
                df[found] += 1
                documents += n > 0
                length += n
        held = np.nonzero(df)[0]
        yield pa.record_batch([pa.array([-1, -2, *held], pa.int64()), pa.array([documents, length, *df[held]], pa.int64())], names=["term", "n"])

    sums = dict(map_batches(docs, work, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())
    block.documents, block.length = sums.get(-1, 0), sums.get(-2, 0)
    block.weights = np.array(
        [math.floor(1000 * math.log((2 * block.documents + 2) / (2 * sums.get(k, 0) + 1))) for k in range(len(block.terms))], np.int64
    )
    shared.destroy()
    return block


def scores(block: Items, texts: list[bytes]) -> np.ndarray:
    """(texts, items) scores of guarded texts."""
    out = np.zeros((len(texts), len(block.ids)), np.int64)
    for row, text in zip(out, texts):
        n, term, tf = block.hits(text)
        if len(term):
            m = 100 - 25 + 25 * n * block.documents // block.length
            value = block.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            counts = block.first[term + 1] - block.first[term]
            places = np.repeat(block.first[term + 1] - np.cumsum(counts), counts) + np.arange(counts.sum())
            np.add.at(row, block.items[places], np.repeat(value, counts) * block.times[places])
    return out


def best(found: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows of each item in ``found`` (item, score, id)."""
    found = found.take(pc.sort_indices(found, [("item", "ascending"), ("score", "descending"), ("id", "ascending")]))
    item = found["item"].to_numpy()
    start = np.searchsorted(item, item)
    return found.filter(pa.array(np.arange(len(item)) - start < k))


def _candidates(docs: DataFrame, block: Items, k: int, schema: str) -> DataFrame:
    """Each task's ``k`` best documents of every item: (item, score, id)."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    cells, most = CELLS, CANDIDATES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        step = max(1, cells // max(1, len(own.ids)))
        floor = np.ones(len(own.ids), np.int64)  # what a document needs to be among the best
        held: list[pa.Table] = []
        for batch in batches:
            for part in chunks(batch, "text"):
                for i in range(0, part.num_rows, step):
                    some = part.slice(i, step)
                    table = scores(own, list(_texts(some)))
                    row, item = np.nonzero(table >= floor)
                    held.append(pa.table({"item": item, "score": table[row, item], "id": some.column("id").take(pa.array(row))}))
                    if sum(map(len, held)) > most:
                        held = [best(pa.concat_tables(held), k)]
                        at, score = held[0]["item"].to_numpy(), held[0]["score"].to_numpy()
                        full = np.nonzero(np.bincount(at, minlength=len(floor)) == k)[0]
                        floor[full] = score[np.searchsorted(at, full, "right") - 1]
        if held:
            out = best(pa.concat_tables(held), k)
            out = out.set_column(0, "item", own.ids.take(out["item"]))
            yield from out.combine_chunks().to_batches()

    return map_batches(docs, work, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: (item_column, rank, id_column, score).

    Terms are runs of digits, ASCII letters in lower case and characters above ASCII. A rare
    term weighs more; occurrences saturate, in long documents more slowly. Two scans: the
    first counts documents for each term, the second scores and keeps every task's best
    ``k`` of each item, ranked by (score, smaller id) in parts before they meet.

    The terms of at most about ``block_bytes`` of item texts are broadcast; more items are
    searched block after block over the same documents.

    Null, empty and termless texts score nothing and do not count as documents. Rows with the
    same id are documents of their own; null ids come last among equal scores. Different
    texts of one item are searched together, repeated item rows count once, and rows
    without an item id are no items. An empty table on either side gives no rows. Other
    columns are not read, whatever their names.
    """
    kinds = [docs.schema[id_column].dataType, items.schema[item_column].dataType]
    schema = f"item {kinds[1].simpleString()}, score bigint, id {kinds[0].simpleString()}"
    texts = as_bytes(docs, id_column, text_column)
    asked = items.select(F.col(item_column).alias("item"), F.col(item_text_column).alias("text")).where("item is not null and text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = max(1, math.ceil(size / block_bytes)), []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").toArrow()
        block = Items(list(zip(*(own[c].to_pylist() for c in ("item", "text")))), own.schema.field("item").type)
        if block.terms and _weigh(texts, block).documents:
            found.append(_candidates(texts, block, k, schema))
    if not found:
        return docs.sparkSession.createDataFrame([], f"{item_column} {kinds[1].simpleString()}, rank int, {id_column} {kinds[0].simpleString()}, score bigint")
    order = [F.desc("score"), F.asc_nulls_last("id")]
    rows = reduce(DataFrame.unionByName, found).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    for keys in (["item", "part"], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return rows.select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")


#: ``search`` over ``documents`` and ``benchmark`` in SQL.
SQL = r"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM len),
weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
score AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN len USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM score WHERE score > 0 QUALIFY rank <= 20
"""

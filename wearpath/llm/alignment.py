"""Alignment of two tokenizers: groups of tokens between common byte offsets, and how typical each linked pair of ids is."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import acero
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearpath.llm.common import as_bytes, chunks, map_batches, stored

#: Bytes of text in a block of documents; a block's pairs meet their corpus counts in one group.
BLOCK_BYTES = 16 << 20
#: Bytes of text that are aligned at once; a longer text is aligned in pieces, cut where a word ends.
PIECE_BYTES = 1 << 20
#: Words whose ids a task remembers before it starts afresh, and their longest.
REMEMBERED, WORD = 200_000, 100
#: Links of a group from which equal ids are counted before they are paired.
CROWDED = 64

#: Characters that both libraries for the first tokenizer are tested to class alike.
_COMMON = re.compile("[\x00-ɏ -⁯]*")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """A byte-level tokenizer file (A) and a piece model (B), with the bytes of their tokens.

    With ``ranks`` and their ``pattern``, the same vocabulary in another library's form, A
    encodes texts of Latin letters and general punctuation faster. No piece of B may hold a
    space after another character, and A's pattern begins a token at each such space, so
    words between single spaces are encoded alone and remembered.
    """

    def __init__(self, json_text: str, model: bytes, ranks: dict[bytes, int] | None = None, pattern: str = ""):
        self.json, self.model, self.ranks, self.pattern = json_text, model, ranks, pattern
        self._open = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": None}

    @classmethod
    def read(cls, json_path: str, model_path: str, ranks_path: str | None = None, pattern: str = "") -> Tokenizers:
        import base64

        with open(json_path, encoding="utf-8") as f, open(model_path, "rb") as m:
            text, model = f.read(), m.read()
        ranks = None
        if ranks_path:
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(text, model, ranks, pattern)

    def open(self) -> Tokenizers:
        """Load both vocabularies, once in each process."""
        if self._open:
            return self
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(self.json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.fast = None
        if self.ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("alignment", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        own, added = byte_alphabet(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        entry = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [
            t.encode() if t in added else bytes(own[c] for c in t) for t in (entry.get(i, "") for i in range(max(entry) + 1))
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.length_a, self.length_b = (pa.array([len(t) for t in own], pa.int64()) for own in (self.bytes_a, self.bytes_b))
        numbers = pa.array([str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))], pa.large_string())
        self.number = numbers
        self.width = len(self.bytes_b)
        self._forget()
        self._open = True
        return self

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        plain = [self.fast is not None and bool(_COMMON.fullmatch(t)) for t in texts]
        slow = iter(self.a.encode_batch_fast([" " + t for t, p in zip(texts, plain) if not p], add_special_tokens=False) if not all(plain) else ())
        return [self.fast.encode_ordinary(" " + t) if p else next(slow).ids for t, p in zip(texts, plain)]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids by A of each text after a space, and by B; None where either's bytes are not that space and the text."""
        return [
            (a, b) if self._spell(a, b, t) else None for t, a, b in zip(texts, self._encode_a(texts), self.b.encode(texts, num_threads=1))
        ]

    def _spell(self, a: Iterable[int], b: Iterable[int], text: str) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == b" " + text.encode() == b"".join(map(self.bytes_b.__getitem__, b))

    def words(self, words: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """``encode`` of words without white space at their ends: A's as one text, cut where words end, unless one isn't spelled."""
        if not words:
            return []
        text = " ".join(words)
        a, b = self._encode_a([text])[0], self.b.encode(words, num_threads=1)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        flat = np.fromiter(chain.from_iterable(b), np.int64)
        own = np.append(0, np.cumsum(self.length_b.to_numpy()[flat]))[np.cumsum([len(x) for x in b])]
        if not (np.array_equal(own, ends) and self._spell(a, flat.tolist(), text)):
            return self.encode(words)
        cuts = (np.searchsorted(np.cumsum(self.length_a.to_numpy()[a]), ends) + 1).tolist()
        return [(a[i:j], x) for i, j, x in zip([0, *cuts[:-1]], cuts, b)]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = _columns([])

    def units(self, words: list[str], texts: list[str]) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
        """Ids by A and by B of each word, then of each text, and whether both spell it; words are remembered."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.ids = _joined(self.ids, _columns(self.words(new)))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        own = [c.take(pa.array(at)) for c in self.ids]
        a, b, fine = _joined(own, _columns(self.encode(texts) if texts else []))
        return a, b, fine.to_numpy(zero_copy_only=False)


def _columns(found: list[tuple[list[int], list[int]] | None]) -> list[pa.Array]:
    lists = (pa.array([f[k] if f else [] for f in found], pa.list_(pa.int32())) for k in (0, 1))
    return [*lists, pa.array([f is not None for f in found], pa.bool_())]


def _joined(*parts: list[pa.Array]) -> list[pa.Array]:
    return [pa.concat_arrays(columns) for columns in zip(*parts)]


def _flat(ids: pa.ListArray, unit: np.ndarray, doc: np.ndarray, lengths: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The tokens of unit occurrences in order: ids, document, and the offset in it where each ends (a sum over its segment)."""
    some = ids.take(pa.array(unit))
    flat, parent = pc.list_flatten(some), pc.list_parent_indices(some).to_numpy()
    total = pc.cumulative_sum(lengths.take(flat)).to_numpy()
    own = doc[parent]
    first = np.searchsorted(own, np.arange(doc[-1] + 1 if len(doc) else 0))
    before = np.append(0, total)[first]
    return flat, own, total - before[own]


def _cuts(doc_a: np.ndarray, end_a: np.ndarray, doc_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens that end at the same offset of the same document, in order."""
    sides = [
        acero.Declaration("table_source", acero.TableSourceNodeOptions(pa.table({"key": doc << 40 | end, name: np.arange(len(doc))})))
        for name, doc, end in (("i", doc_a, end_a), ("j", doc_b, end_b))
    ]
    options = acero.HashJoinNodeOptions("inner", ["key"], ["key"], left_output=["i"], right_output=["j"])
    met = acero.Declaration("hashjoin", options, sides).to_table(use_threads=False)
    return np.sort(met["i"].to_numpy()), np.sort(met["j"].to_numpy())


def _pairs(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, width: int) -> pa.Table:
    """(group, ab, m): the linked id pairs of all groups; in crowded ones each pair once, with its number of links as ``m``."""
    crowded = size_a * size_b > CROWDED
    group = np.repeat(np.arange(len(size_a)), np.where(crowded, 0, size_a))  # of every A token in the other groups
    x = a[np.repeat(~crowded, size_a)]
    times = size_b[group]
    first = (np.cumsum(size_b) - size_b)[group]  # its group's B tokens, one after the other
    y = b[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())]
    out = [pa.table({"g": np.repeat(group, times), "ab": np.repeat(x, times).astype(np.int64) * width + y, "m": np.ones(len(y), np.int64)})]
    if crowded.any():
        sides = []
        for name, ids, size in (("a", a, size_a), ("b", b, size_b)):
            own = pa.table({"g": np.repeat(np.arange(len(size)), np.where(crowded, size, 0)), name: ids[np.repeat(crowded, size)]})
            sides.append(own.group_by(["g", name], use_threads=False).aggregate([([], "count_all")]).rename_columns(["g", name, f"m{name}"]))
        met = sides[0].join(sides[1], "g", join_type="inner", use_threads=False)
        ab = met["a"].to_numpy().astype(np.int64) * width + met["b"].to_numpy()
        out.append(pa.table({"g": met["g"], "ab": ab, "m": pc.multiply(met["ma"], met["mb"])}))
    return pa.concat_tables(out)


def _lists(values: pa.Array, sizes: np.ndarray, kind: type = pa.LargeListArray) -> pa.Array:
    offsets = np.append(0, np.cumsum(sizes))
    return kind.from_arrays(pa.array(offsets, pa.int64() if kind is pa.LargeListArray else pa.int32()), values)


def align(texts: list[str], both: Tokenizers) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Of the texts that both tokenizers spell: their places, and columns n_a, n_b, n_groups, n_links, groups, pairs, times."""
    units = pc.split_pattern(pa.array(texts, pa.string()), " ")
    code = pc.list_flatten(units).dictionary_encode()
    unit, doc = code.indices.to_numpy(), pc.list_parent_indices(units).to_numpy()
    words = code.dictionary.to_pylist()
    apart = np.array([both.apart and w != "" and not (w[0].isspace() or w[-1].isspace()) for w in words], bool)
    whole = np.zeros(len(texts), bool)
    whole[doc[~apart[unit]]] = True  # texts in which a space meets other white space or an end
    rest = np.nonzero(whole)[0]
    alone = [texts[i] for i in rest]
    short = apart & (np.array([len(w) for w in words]) <= WORD)
    long = np.nonzero(apart & ~short)[0]
    number = np.cumsum(short) - 1
    number[long] = short.sum() + np.arange(len(long))
    unit, doc = np.append(number[unit[~whole[doc]]], short.sum() + len(long) + np.arange(len(rest))), np.append(doc[~whole[doc]], rest)
    order = np.argsort(doc, kind="stable")
    unit, doc = unit[order], doc[order]
    ids_a, ids_b, fine = both.units([w for w, own in zip(words, short) if own], [words[i] for i in long] + alone)
    bad = np.zeros(len(texts), bool)
    bad[doc[~fine[unit]]] = True
    unit, doc = unit[~bad[doc]], (np.cumsum(~bad) - 1)[doc[~bad[doc]]]
    place = np.nonzero(~bad)[0]
    n = len(place)

    a, doc_a, end_a = _flat(ids_a, unit, doc, both.length_a)
    b, doc_b, end_b = _flat(ids_b, unit, doc, both.length_b)
    i, j = _cuts(doc_a, end_a, doc_b, end_b)
    size_a, size_b, owner = np.diff(i, prepend=-1), np.diff(j, prepend=-1), doc_a[i]
    links = size_a * size_b
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, owner, links)
    n_groups = np.bincount(owner, minlength=n)

    pairs = _pairs(a.to_numpy(), size_a, b.to_numpy(), size_b, both.width)
    pairs = pairs.append_column("doc", pa.array(owner[pairs["g"].to_numpy()]))
    pairs = pairs.group_by(["doc", "ab"], use_threads=False).aggregate([("m", "sum")])
    at, ab, m = (pairs[c].to_numpy() for c in ("doc", "ab", "m_sum"))
    order = np.argsort(at, kind="stable")
    per = np.bincount(at, minlength=n)

    comma, bar, semicolon = (pa.scalar(c, pa.large_string()) for c in ",|;")
    joined = [pc.binary_join(_lists(both.number.take(x), s), comma) for x, s in ((a, size_a), (b, size_b))]
    text = pc.binary_join(_lists(pc.binary_join_element_wise(*joined, bar), n_groups), semicolon)
    return place, {
        "n_a": pa.array(np.bincount(doc_a, minlength=n)),
        "n_b": pa.array(np.bincount(doc_b, minlength=n)),
        "n_groups": pa.array(n_groups),
        "n_links": pa.array(n_links),
        "groups": text,
        "pairs": _lists(pa.array(ab[order]), per, pa.ListArray),
        "times": _lists(pa.array(m[order]), per, pa.ListArray),
    }


_ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_SPACE = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str, size: int) -> Iterator[str]:
    """A text cut at single spaces between words, which both tokenizers begin a token with, into pieces of ``size`` characters or a word more."""
    start = 0
    while (found := _SPACE.search(text, start + size)) is not None:
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


def align_long(text: str, both: Tokenizers, size: int = PIECE_BYTES) -> dict[str, list] | None:
    """The columns of ``align`` with ``groups_sha256`` for one text, piece after piece; None if it isn't spelled."""
    counts, digest, ab, times = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k, piece in enumerate(pieces(text, size) if both.apart else [text]):
        place, columns = align([piece], both)
        if not len(place):
            return None
        counts += [columns[c][0].as_py() for c in _COUNTS]
        digest.update(b";" * (k > 0))
        digest.update(columns["groups"][0].as_buffer())
        ab, at = np.unique(np.append(ab, columns["pairs"].values.to_numpy()), return_inverse=True)
        now = np.zeros(len(ab), np.int64)
        np.add.at(now, at, np.append(times, columns["times"].values.to_numpy()))
        times = now
    return {c: [int(n)] for c, n in zip(_COUNTS, counts)} | {"groups_sha256": [digest.hexdigest()], "pairs": [ab], "times": [times]}


def aligned(docs: DataFrame, both: Tokenizers, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row of ``docs``.

    ``pairs`` holds each linked pair of ids once, as A's id times the size of B's vocabulary plus
    B's id, and ``times`` its links. A block is about ``block_bytes`` of a task's texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(both)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, task = shared.value.open(), TaskContext.get()
        kinds = dict.fromkeys(_COUNTS, pa.int64()) | {"groups_sha256": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}
        block, filled = (task.partitionId() if task else 0) << 32, 0
        for batch in batches:
            for part in chunks(batch, "text", PIECE_BYTES):
                texts, at = [], []
                for k, t in enumerate(part.column("text")):
                    if t.is_valid and t.as_buffer().size:
                        try:
                            texts.append(t.as_buffer().to_pybytes().decode())
                            at.append(k)
                        except UnicodeDecodeError:
                            pass  # no text whose tokens could spell it
                if len(texts) == 1:
                    columns = align_long(texts[0], tokenizers)
                    place = np.zeros(0 if columns is None else 1, np.int64)
                else:
                    place, columns = align(texts, tokenizers) if texts else (np.zeros(0, np.int64), {})
                    columns["groups_sha256"] = [hashlib.sha256(t.as_buffer()).hexdigest() for t in columns.pop("groups", ())]
                have = np.array(at, np.int64)[place]
                rest = np.setdiff1d(np.arange(part.num_rows), have)
                empty = dict.fromkeys(_COUNTS, [0] * len(rest)) | {"groups_sha256": [""] * len(rest), "pairs": [[]] * len(rest), "times": [[]] * len(rest)}
                for rows, values in ((have, columns), (rest, empty)):
                    if len(rows):
                        own = [pa.array([block] * len(rows)), part.column("id").take(pa.array(rows))]
                        own += [v if isinstance(v := values[c], pa.Array) else pa.array(v, t) for c, t in kinds.items()]
                        yield pa.RecordBatch.from_arrays(own, names=["block", "id", *kinds])
                filled += part.column("text").nbytes
                if filled >= block_bytes:
                    block, filled = block + 1, 0

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(as_bytes(docs, id_column, text_column), work, f"block bigint, id {kind}, {_ALIGNED}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(block, ab, n): in how many documents of each block of ``rows`` (block, pairs) a pair is linked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = b.column("pairs")
            flat = pa.table({"block": b.column("block").take(pc.list_parent_indices(pairs)), "ab": pc.list_flatten(pairs)})
            yield from flat.group_by(["block", "ab"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["block", "ab", "n"]).to_batches()

    parts = map_batches(rows.select("block", "pairs"), work, "block bigint, ab bigint, n bigint", rows=4000)
    return parts.groupBy("block", "ab").agg(F.sum("n").alias("n"))


def alignments(docs: DataFrame, both: Tokenizers, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_column, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    Tokens are grouped between the byte offsets where tokens of both tokenizers end; all
    tokens of a group are linked. A pair's count is the number of rows that hold it linked,
    ``n_best`` a row's links whose count is the highest of their A id (ties included), and
    ``count_sum`` the sum of the counts over its links.

    Texts are encoded once. Of each block of documents only its different pairs travel to
    meet their counts, and the counted pairs return to their block, which is bounded
    whatever the corpus holds. Null and empty texts, and texts that either tokenizer does
    not spell byte for byte, have zeros and an empty ``groups_sha256``. Repeated rows count
    each and stay; null ids are kept. An empty table gives no rows. Other columns are not read.
    """
    width = both.open().width
    rows = stored(aligned(docs, both, id_column, text_column, block_bytes), "aligned")
    per_block = stored(pair_counts(rows), "block_pairs")
    counts = per_block.groupBy("ab").agg(F.sum("n").alias("count")).withColumn("a", F.expr(f"ab div {width}"))
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    weighed = stored(counts.join(best, "a").select("ab", "count", (F.col("count") == F.col("most")).cast("bigint").alias("best")), "pair_counts")
    known = per_block.select("block", "ab").join(weighed, "ab").select(F.col("block").alias("own"), "ab", "count", "best")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["ab"].to_numpy())
        ab, values = right["ab"].to_numpy()[order], {c: right[c].to_numpy()[order] for c in ("best", "count")}
        out = {}
        pairs, times = (left[c].combine_chunks() for c in ("pairs", "times"))
        row, m = pc.list_parent_indices(pairs).to_numpy(), pc.list_flatten(times).to_numpy()
        found = np.searchsorted(ab, pc.list_flatten(pairs).to_numpy())
        for name, c in (("n_best", "best"), ("count_sum", "count")):
            total = np.zeros(left.num_rows, np.int64)
            np.add.at(total, row, values[c][found] * m)
            out[name] = pa.array(total)
        return pa.table({c: out.get(c, left[c] if c not in out else None) for c in names})

    schema = f"id {docs.schema[id_column].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    out = rows.groupBy("block").cogroup(known.groupBy("own")).applyInArrow(work, schema)
    return out.withColumnRenamed("id", id_column)

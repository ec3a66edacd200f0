"""Toxicity from a weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearpath.llm.common import as_bytes, map_batches

#: Labelled rows that the lexicon and its weights are learned from, at most about this many.
TRAIN_DOCUMENTS = 20_000
#: A word enters the lexicon if it is in this share of the toxic texts and this much likelier there.
LEAST_SHARE = 0.02
LEAST_LOG_ODDS = 2.5
LEXICON_WORDS = 2_000
#: Two words of which one is in the lexicon excuse it if this many clean texts hold them and they are no likelier in toxic ones.
EXCUSED_TEXTS = 3
EXCUSED_LOG_ODDS = 0.0
EXCUSED_PHRASES = 2_000
#: Characters beside a hit in which its neighbour is looked for.
LONGEST_WORD = 40

#: Fixed values. Letters of other scripts that look like Latin ones, in both alphabets' order.
_CYRILLIC = dict(zip("авеіјкмнорѕстухԁһԛԝԍ", "abeijkmhopsctyxdhqwg"))
_GREEK = dict(zip("αβεικνορτυχω", "abeiknoptuxw"))
#: Digits and signs that stand for letters within words.
_DIGITS = dict(zip("0134578@$!|+€£", "oieastbasilte" + "l"))
_INVISIBLE = dict.fromkeys("­​‌‍⁠﻿", "")


def _table() -> dict[int, str]:
    """Full-width forms, homoglyphs and accented Latin letters to plain lower-case ones."""
    import unicodedata

    table: dict[str, str] = dict(_CYRILLIC) | _GREEK | _INVISIBLE
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if base.isascii() and base.isalpha():
            table[chr(code)] = base
    for code in range(0xFF01, 0xFF5F):
        table[chr(code)] = chr(code - 0xFEE0).lower()
    return {ord(k): v for k, v in table.items()}


_FOLD = _table()
_SUBSTITUTES = {ord(k): v for k, v in _DIGITS.items()}
#: A substitute counts as a letter only beside a letter or another substitute that is.
_MIXED = re.compile(r"[^\W_]*[0-9@$!|+€£]+[a-z0-9@$!|+€£]*")
_WORD = re.compile(r"[^\W_]+")
_BEFORE = re.compile(r"[^\W_]+ \Z")
_AFTER = re.compile(r" [^\W_]+")


def _unmask(match: re.Match) -> str:
    word = match[0]
    if not any("a" <= c <= "z" for c in word):
        return word
    core = word.rstrip("!|+")
    return core.translate(_SUBSTITUTES) + word[len(core) :]


def fold(text: str) -> str:
    """Lower case, plain letters for look-alikes, and letters for the digits and signs within words."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    return _MIXED.sub(_unmask, low)


@dataclass
class Lexicon:
    """Weights of words, phrases that excuse them, and the line that turns a density into a probability."""

    weights: dict[str, float]
    exceptions: Sequence[str] = ()
    slope: float = 1.0
    offset: float = 0.0
    _found: ahocorasick.Automaton | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._found is None:
            a = ahocorasick.Automaton()
            for word, w in self.weights.items():
                a.add_word(word, (len(word), w))
            for phrase in map(fold, self.exceptions):
                a.add_word(phrase, (len(phrase), None))
            a.make_automaton()
            self._found = a
        return self._found

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the lexicon's words in a folded text that no exception phrase covers."""
        automaton = self.automaton()
        if not len(automaton):
            return []
        n, found, excused = len(folded), [], []
        for last, (length, weight) in automaton.iter(folded):
            start, end = last + 1 - length, last + 1
            if (start and folded[start - 1].isalnum()) or (end < n and folded[end].isalnum()):
                continue
            if weight is None:
                excused.append((start, end))
            else:
                found.append((start, end, weight))
        if not excused:
            return found
        found.sort()
        excused.sort()
        kept, at, reach = [], 0, 0  # reach: the furthest end of the phrases that begin at or before a hit
        for hit in found:
            while at < len(excused) and excused[at][0] <= hit[0]:
                reach = max(reach, excused[at][1])
                at += 1
            if hit[1] > reach:
                kept.append(hit)
        return kept

    def phrases(self, folded: str) -> set[str]:
        """Each hit with the word one space before it, and with the word one space after it."""
        found = set()
        for start, end, _ in self.hits(folded):
            if before := _BEFORE.search(folded, max(0, start - LONGEST_WORD), start):
                found.add(folded[before.start() : end])
            if after := _AFTER.match(folded, end, end + LONGEST_WORD):
                found.add(folded[start : after.end()])
        return found

    def density(self, text: str) -> float:
        """Weights of all hits over the logarithm of the number of words, so that long texts are not toxic for one word in many."""
        folded = fold(text)
        total = sum(h[2] for h in self.hits(folded))
        return total / math.log2(16 + len(folded.split())) if total else 0.0

    def score(self, text: str | None) -> float:
        z = self.slope * self.density(text or "") + self.offset
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _decoded(column: pa.Array) -> Iterator[str]:
    for t in column:
        yield t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else ""


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", documents: int = TRAIN_DOCUMENTS, exceptions: Sequence[str] = ()) -> Lexicon:
    """The lexicon of a sample of about ``documents`` labelled texts, drawn by a hash of the id.

    Counts, for every folded word, the toxic and the other texts that hold it; words
    clearly likelier in toxic texts enter with their log odds as weight, at most
    ``LEXICON_WORDS`` of them. Pairs of neighbouring words that hold such a word, but are as
    common in clean texts, are learned as phrases that excuse it, at most ``EXCUSED_PHRASES``,
    beside the caller's ``exceptions``. The density's slope and offset are a logistic regression on
    the same sample. Rows without label or text are left out; ids may repeat, a document
    with several labels takes the largest. The sampled ids are broadcast, as ``documents``
    bounds them. Without toxic texts the lexicon is empty and
    every score is low.
    """
    known = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(label_column).alias("label"))
    n = known.count()
    share = min(1.0, documents / max(1, n))
    drawn = known.where(F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1_000_000)) < share * 1_000_000)
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("binary").alias("text")).join(F.broadcast(drawn), "_id").select("text", "label")

    def marked(found_in: Callable[[str], set[str]]) -> DataFrame:
        """(word, b, n): toxic and all sampled texts in which ``found_in`` finds the word."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: list[str] = []
                marks: list[int] = []
                for text, label in zip(_decoded(b.column("text")), b.column("label").to_pylist()):
                    own = found_in(fold(text))
                    found += own
                    marks += [int(label)] * len(own)
                yield pa.record_batch([pa.array(found, pa.string()), pa.array(marks, pa.int32())], names=["word", "label"])

        is_bad = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
        return map_batches(rows, work, "word string, label int").groupBy("word").agg(is_bad.alias("b"), F.count("*").alias("n"))

    sizes = dict(drawn.groupBy("label").count().collect())
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Lexicon({}, exceptions, 0.0, -4.0)
    odds = F.log(((F.col("b") + 0.5) / (bad + 1)) / ((F.col("n") - F.col("b") + 0.5) / (good + 1)))
    kept = (
        marked(lambda folded: {w for w in _WORD.findall(folded) if len(w) > 2})
        .withColumn("w", odds)
        .where((F.col("b") >= max(3.0, LEAST_SHARE * bad)) & (F.col("w") >= LEAST_LOG_ODDS))
        .orderBy(F.desc("w"), "word")
        .limit(LEXICON_WORDS)
        .collect()
    )
    lexicon = Lexicon({r["word"]: float(r["w"]) for r in kept}, exceptions)
    excused = (
        marked(lexicon.phrases)
        .where((F.col("n") - F.col("b") >= EXCUSED_TEXTS) & (odds <= EXCUSED_LOG_ODDS))
        .orderBy(odds, "word")
        .limit(EXCUSED_PHRASES)
        .collect()
    )
    lexicon = Lexicon(lexicon.weights, [*exceptions, *(r["word"] for r in excused)])

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch(
                [pa.array([lexicon.density(t) for t in _decoded(b.column("text"))], pa.float64()), b.column("label").cast(pa.int32())],
                names=["x", "y"],
            )

    sample = map_batches(rows, densities, "x double, y int").groupBy(F.round("x", 2).alias("x"), "y").count().collect()
    x, y, w = (np.array([r[i] for r in sorted(sample)], float) for i in range(3))
    lexicon.slope, lexicon.offset = _logistic(x, y, w)
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression, by Newton steps."""
    a, theta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        grad = a.T @ (w * (p - y)) + ridge * theta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def score(docs: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, score) from 0 to 1 for every whole text; null and empty texts score as without a hit.

    An empty table gives no rows. Repeated rows and null ids stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("id"), pa.array(map(shared.value.score, _decoded(b.column("text"))), pa.float64())], names=["id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(as_bytes(docs, id_column, text_column), work, f"id {kind}, score double").withColumnRenamed("id", id_column)

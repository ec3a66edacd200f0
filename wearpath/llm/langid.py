"""Language identification by a small convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearpath.llm.common import as_bytes, map_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Windows of labelled texts that the network is trained on, at most about this many; languages share them equally.
TRAIN_WINDOWS = 24_000
EPOCHS = 6
#: Windows whose convolutions are in memory at once.
_AT_ONCE = 128
#: Letters of any script; numbers of other kinds (fractions, numerals) are none.
_LETTER = regex.compile(r"\p{L}")
#: Bytes from one window to the next: windows overlap, so that each n-gram lies whole in one.
STRIDE = WINDOW - max(WIDTHS) + 1


def windows(data: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """All of ``data`` (bytes) in rows of ``size`` that overlap by the widest filter's bytes but one; zeros fill up the last. At least one row."""
    stride = size - max(WIDTHS) + 1
    rows = max(1, -(-(len(data) - size + stride) // stride))
    out = np.zeros((rows - 1) * stride + size, np.uint8)
    out[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(out, size)[::stride].copy()


@dataclass
class ByteConvNet:
    """One-hot bytes, filters of several widths, rectifier, maximum over the window, softmax.

    A filter of width w over one-hot bytes is w tables of 256 weights, so the convolution is
    a sum of table rows: ``taps[j][byte]`` holds the weights of all filters at offset j.
    """

    languages: list[str]
    taps: np.ndarray  # (max width, 256, filters of all widths)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        taps = rng.normal(0, 0.3, (max(WIDTHS), 256, n)).astype(np.float32)
        for k, width in enumerate(WIDTHS):
            taps[width:, :, k * FILTERS : (k + 1) * FILTERS] = 0
        out = rng.normal(0, 0.3, (n, len(languages))).astype(np.float32)
        return cls(languages, taps, np.zeros(n, np.float32), out, np.zeros(len(languages), np.float32))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each window, and where it is."""
        span = x.shape[1] - len(self.taps) + 1
        best, where = [], []
        for i in range(0, len(x), _AT_ONCE):
            part = x[i : i + _AT_ONCE]
            total = np.take(self.taps[0], part[:, :span], axis=0)
            for j in range(1, len(self.taps)):
                total += np.take(self.taps[j], part[:, j : j + span], axis=0)
            where.append(total.argmax(1))
            best.append(np.take_along_axis(total, where[-1][:, None], 1)[:, 0])
        return np.concatenate(best), np.concatenate(where)

    def responses(self, x: np.ndarray) -> np.ndarray:
        span = x.shape[1] - len(self.taps) + 1
        best = []
        for i in range(0, len(x), _AT_ONCE):
            part = x[i : i + _AT_ONCE]
            total = np.take(self.taps[0], part[:, :span], axis=0)
            for j in range(1, len(self.taps)):
                total += np.take(self.taps[j], part[:, j : j + span], axis=0)
            best.append(total.max(1))
        return np.concatenate(best)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax for each window (rows of bytes)."""
        z = np.maximum(self.responses(x) + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.03, seed: int = 11) -> None:
        """Cross entropy by AdaGrad; the gradient passes the pooling at each filter's best place only."""
        rng = np.random.default_rng(seed)
        params = [self.taps, self.bias, self.out, self.out_bias]
        sums = [np.full(p.shape, 1e-2, np.float32) for p in params]
        widths = np.repeat(WIDTHS, FILTERS)
        filters = np.arange(len(widths))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                xb, yb, wb = x[rows], y[rows], weight[rows]
                best, where = self.pooled(xb)
                hidden = np.maximum(best + self.bias, 0)
                z = hidden @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), yb] -= 1
                p *= (wb / len(rows))[:, None]
                back = (p @ self.out.T) * (hidden > 0)
                taps = np.zeros_like(self.taps)
                for j in range(len(self.taps)):
                    g = back * (widths > j)
                    byte = np.take_along_axis(xb, where + j, 1)
                    np.add.at(taps[j], (byte, np.broadcast_to(filters, byte.shape)), g)
                for value, total, grad in zip(params, sums, (taps, back.sum(0), hidden.T @ p, p.sum(0))):
                    total += grad * grad
                    value -= rate * grad / np.sqrt(total)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """Language and mean probability over all windows of the text, each weighted by its bytes."""
        if not text or not self.languages or not _LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0
        data = np.frombuffer(text, np.uint8)
        total = np.zeros(len(self.languages))
        step = STRIDE * 4096
        for i in range(0, max(1, len(data) - WINDOW + STRIDE), step):
            part = data[i : i + step + WINDOW - STRIDE]
            x = windows(part)
            sizes = np.full(len(x), STRIDE)
            sizes[-1] = min(len(part), len(data) - i) - STRIDE * (len(x) - 1)
            total += sizes @ self.probabilities(x).astype(np.float64)
        total /= total.sum()
        k = int(total.argmax())
        return self.languages[k], float(min(1.0, total[k]))


def train(labelled: DataFrame, text_column: str = "text", label_column: str = "lang", sample: int = TRAIN_WINDOWS) -> ByteConvNet:
    """A network fitted on about ``sample`` windows of the labelled texts, at most, drawn by a hash of their bytes.

    All windows of all texts are candidates, with the same chance for each window of a
    language; a rare language gives as many as a common one, or all it has. Equal windows
    count once, so copies of a text add nothing. Rows without label or text are left out.
    Languages weigh alike. Without any labelled row the network knows no language, and every
    prediction is ``und``.
    """
    texts = labelled.where(F.col(label_column).isNotNull() & (F.length(text_column) > 0)).select(
        F.col(label_column).cast("string").alias("label"), F.col(text_column).cast("binary").alias("text")
    )
    many = F.greatest(F.lit(1), F.ceil((F.octet_length("text") - WINDOW) / F.lit(STRIDE)).cast("int") + 1)
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.sum(many).alias("n")).collect()}
    languages = sorted(sizes)
    net = ByteConvNet.fresh(languages)
    if not languages:
        return net
    spark, scale = labelled.sparkSession, 1_000_000_000
    shares = [(k, int(scale * min(1.0, max(1, sample // len(languages)) / n))) for k, n in sizes.items()]
    cut = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring("text", i * STRIDE + 1, F.lit(WINDOW)))
    drawn = texts.join(F.broadcast(spark.createDataFrame(shares, "label string, share bigint")), "label").select(
        "label", F.explode(F.filter(cut, lambda part: F.pmod(F.xxhash64(part), F.lit(scale)) < F.col("share"))).alias("part")
    )
    found = sorted((r["label"], bytes(r["part"])) for r in drawn.distinct().collect())
    if not found:
        return net
    y = np.array([languages.index(label) for label, _ in found])
    x = np.concatenate([windows(np.frombuffer(part, np.uint8)) for _, part in found])
    counts = np.maximum(np.bincount(y, minlength=len(languages)), 1)
    net.fit(x, y, (len(y) / len(languages) / counts)[y].astype(np.float32))
    return net


def predict(docs: DataFrame, net: ByteConvNet, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id_column, lang_pred, score) for every row. Null texts and texts without a letter: ``und``, 0.

    Every byte of a text is in one window. Repeated rows and null ids stay; other columns
    are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t.as_buffer().to_pybytes() if t.is_valid else None) for t in b.column("text")]
            yield pa.record_batch(
                [b.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["id", "lang_pred", "score"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(as_bytes(docs, id_column, text_column), work, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def recognised(docs: DataFrame, net: ByteConvNet, text_column: str = "text", least: float = 0.4) -> DataFrame:
    """``docs`` without texts that have no letter or no language with a score of ``least``. Same columns.

    Null and empty texts go, repeated rows and null ids are judged as any others, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t.as_buffer().to_pybytes() if t.is_valid else None) for t in b.column(at)]
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return map_batches(docs, work, docs.schema)


def held_out(id_column: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether crc32 of the id as text falls in the fold that is kept from training; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % folds == fold, F.lit(False))

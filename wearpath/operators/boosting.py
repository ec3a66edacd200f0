"""Boosted trees for any number of classes: softmax scores, one regression tree per class and round."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from wearpath.session import keep_checkpoints

#: Rounds after which the scores' lineage is cut.
CUT_EVERY = 5
#: Fits that run at a time.
THREADS = 4

T = TypeVar("T")


def softmax(scores: list[Column]) -> list[Column]:
    """Probabilities of the classes whose scores these are."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    powers = [F.exp(s - top) for s in scores]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def in_parallel(work: Sequence[Callable[[], T]], threads: int = THREADS) -> list[T]:
    """The results of calls that each start Spark jobs, some at a time; jobs keep this thread's properties, in a pool of their own each."""
    context = SparkSession.getActiveSession().sparkContext

    def run(at: int) -> T:
        context.setLocalProperty("spark.scheduler.pool", f"parallel-{at % threads}")
        return work[at]()

    if len(work) < 2:
        return [call() for call in work]
    with ThreadPool(min(threads, len(work))) as pool:
        return pool.map(inheritable_thread_target(run), range(len(work)), chunksize=1)


@dataclass
class SoftmaxBoosting:
    """Each round fits one regression tree per class to what the class indicator exceeds its probability by.

    The scores are columns: a round adds ``stepSize`` times its trees' values to them, so no
    earlier tree is evaluated again. ``weightCol`` weighs the rows in every tree.
    """

    features: str
    label: str
    prediction: str
    maxIter: int = 10
    maxDepth: int = 6
    stepSize: float = 0.3
    maxBins: int = 32
    seed: int = 11
    weightCol: str | None = None
    minInstancesPerNode: int = 1

    def fit(self, df: DataFrame) -> PipelineModel:
        """The trees, then the sum of their values as ``scores`` and the class with the highest. Needs labels 0, 1, ..."""
        keep_checkpoints(df.sparkSession)
        classes = int(df.agg(F.max(self.label)).first()[0]) + 1
        own = [self.features, self.label, *([self.weightCol] if self.weightCol else [])]
        scores = [f"_s{k}" for k in range(classes)]
        rows, held, trees = df.select(*own).withColumns({s: F.lit(0.0) for s in scores}), [], []
        for turn in range(self.maxIter):
            p = softmax([F.col(s) for s in scores])
            hits = [F.when(F.col(self.label) == k, 1.0).otherwise(0.0) for k in range(classes)]
            rows = rows.withColumns({f"_r{k}": hit - own for k, (hit, own) in enumerate(zip(hits, p))})
            rows = rows.checkpoint() if turn and turn % CUT_EVERY == 0 else rows.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(rows)
            new = in_parallel([partial(self._tree(turn, k).fit, rows) for k in range(classes)])
            trees += new
            for tree in new:
                rows = tree.transform(rows)
            step = {s: F.col(s) + self.stepSize * F.col(f"_t{turn}_{k}") for k, s in enumerate(scores)}
            rows = rows.withColumns(step).select(*own, *scores)
            for old in held[:-1]:
                old.unpersist()
        held[-1].unpersist()
        return PipelineModel(stages=[*trees, *self._ends(classes)])

    def _tree(self, turn: int, k: int) -> DecisionTreeRegressor:
        tree = DecisionTreeRegressor(
            featuresCol=self.features, labelCol=f"_r{k}", predictionCol=f"_t{turn}_{k}", maxDepth=self.maxDepth, maxBins=self.maxBins,
            seed=self.seed, minInstancesPerNode=self.minInstancesPerNode,
        )
        return tree.setWeightCol(self.weightCol) if self.weightCol else tree

    def _ends(self, classes: int) -> list[SQLTransformer]:
        sums = [" + ".join(["0D", *(f"{self.stepSize}D * _t{t}_{k}" for t in range(self.maxIter))]) for k in range(classes)]
        gone = ", ".join(f"_t{t}_{k}" for t in range(self.maxIter) for k in range(classes))
        return [
            SQLTransformer(statement=f"SELECT * EXCEPT ({gone}), array({', '.join(sums)}) AS scores FROM __THIS__"),
            SQLTransformer(
                statement=f"SELECT *, CAST(array_position(scores, array_max(scores)) - 1 AS DOUBLE) AS {self.prediction} FROM __THIS__"
            ),
        ]

"""Fitted classifiers as SQL text that Spark and other engines read alike."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import DataFrame

from wearpath.operators.features import vector_columns
from wearpath.operators.models import classifier

#: Tree nodes, counted once a class, up to which a model is written as one statement; more do not compile to one loop.
MOST_NODES = 3_000


@dataclass(frozen=True)
class Node:
    """A split of a feature at ``threshold`` (smaller or equal values go left), or a leaf with a value for each class."""

    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None
    values: tuple[float, ...] = ()

    def size(self) -> int:
        return 1 + (self.left.size() + self.right.size() if self.left else 0)


def number(value: float) -> str:
    """A literal that is a double everywhere."""
    return f"{float(value):.17e}"


def _case(node: Node, names: Sequence[str], k: int) -> str:
    if node.left is None:
        return number(node.values[k])
    left, right = (_case(child, names, k) for child in (node.left, node.right))
    if left == right:
        return left
    return f"CASE WHEN {names[node.feature]} <= {number(node.threshold)} THEN {left} ELSE {right} END"


@dataclass(frozen=True)
class Compiled:
    """Class labels and one SQL expression a class over the feature columns ``names``.

    Scores become probabilities by ``softmax`` or as shares of their sum. The class with the
    highest score is predicted, the first of equals.
    """

    labels: tuple[str, ...]
    scores: tuple[str, ...]
    softmax: bool

    def sql(self, table: str, keep: Sequence[str] = ()) -> str:
        """SELECT of the columns ``keep``, ``probability_0``... and ``prediction`` (in label units) for each row of ``table``."""
        n, held = range(len(self.labels)), "".join(f"{c}, " for c in keep)
        scores = ", ".join(f"{s} AS _s{k}" for k, s in enumerate(self.scores))
        top = f"greatest({', '.join(f'_s{k}' for k in n)})" if len(n) > 1 else "_s0"
        weights = ", ".join(f"exp(_s{k} - {top}) AS _w{k}" if self.softmax else f"_s{k} AS _w{k}" for k in n)
        total = " + ".join(f"_w{k}" for k in n)
        first = " ".join(
            f"WHEN {' AND '.join(['TRUE', *(f'_s{k} >= _s{j}' for j in n if j > k)])} THEN {number(float(self.labels[k]))}" for k in n
        )
        return (
            f"SELECT {held}{', '.join(f'_w{k} / ({total}) AS probability_{k}' for k in n)}, CASE {first} END AS prediction"
            f" FROM (SELECT {held}{', '.join(f'_s{k}' for k in n)}, {weights} FROM (SELECT {held}{scores} FROM {table}) AS _scored) AS _weighed"
        )

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return df.sparkSession.sql(self.sql("{rows}", keep), rows=df)


def forest(trees: Sequence[Node], names: Sequence[str], labels: Sequence[str]) -> Compiled:
    """Trees whose leaves hold class shares: the scores are their sums."""
    if len(labels) * sum(t.size() for t in trees) > MOST_NODES:
        raise ValueError(f"the trees have more than {MOST_NODES} nodes: score with the model itself")
    return Compiled(tuple(labels), tuple(_sum([_case(t, names, k) for t in trees]) for k in range(len(labels))), False)


def regression(matrix: Sequence[Sequence[float]], intercepts: Sequence[float], names: Sequence[str], labels: Sequence[str]) -> Compiled:
    """A row of coefficients and an intercept per class; one row for two classes belongs to the second."""
    rows = [_sum([number(b), *(f"{number(v)} * {n}" for v, n in zip(row, names))]) for row, b in zip(matrix, intercepts)]
    return Compiled(tuple(labels), tuple(rows if len(rows) == len(labels) else [number(0.0), *rows]), True)


def boosted(trees: Sequence[Sequence[Node]], step: float, names: Sequence[str], labels: Sequence[str]) -> Compiled:
    """For each class the regression trees of all rounds."""
    if sum(t.size() for own in trees for t in own) > MOST_NODES:
        raise ValueError(f"the trees have more than {MOST_NODES} nodes: score with the model itself")
    sums = [_sum([number(0.0), *(f"{number(step)} * {_case(t, names, 0)}" for t in own)]) for own in trees]
    return Compiled(tuple(labels), tuple(sums), True)


def _sum(terms: Sequence[str]) -> str:
    return "(" + " + ".join(terms) + ")"


def _nodes(node, shares: bool) -> Node:
    """A tree of the library as ``Node``; leaves of classifiers hold class shares, those of regressors one value."""
    if node.getClass().getSimpleName() == "LeafNode":
        if not shares:
            return Node(values=(node.prediction(),))
        counts = list(node.impurityStats().stats())
        return Node(values=tuple(c / sum(counts) if sum(counts) else 0.0 for c in counts))
    split = node.split()
    if split.getClass().getSimpleName() != "ContinuousSplit":
        raise ValueError("only numeric features can be compiled")
    return Node(split.featureIndex(), split.threshold(), _nodes(node.leftChild(), shares), _nodes(node.rightChild(), shares))


def compile_model(model: PipelineModel, names: Sequence[str]) -> Compiled:
    """A trained pipeline of ``models.train`` as SQL over feature columns ``names``, in the order of the feature vector."""
    labels, fitted = model.stages[0].labels, classifier(model)
    if isinstance(fitted, LogisticRegressionModel):
        return regression(fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist(), names, labels)
    if isinstance(fitted, RandomForestClassificationModel):
        return forest([_nodes(t._java_obj.rootNode(), True) for t in fitted.trees], names, labels)
    if isinstance(fitted, PipelineModel):
        trees = [t for t in fitted.stages if isinstance(t, DecisionTreeRegressionModel)]
        own = [[_nodes(t._java_obj.rootNode(), False) for t in trees if t.getPredictionCol().endswith(f"_{k}")] for k in range(len(labels))]
        return boosted(own, float(re.search(r"([\d.eE+-]+)D \* _t", fitted.stages[-2].getStatement())[1]), names, labels)
    raise ValueError(f"a {type(fitted).__name__} cannot be compiled")


def feature_table(df: DataFrame, names: Sequence[str], keep: Sequence[str], vector: str = "scaledFeatures") -> DataFrame:
    """``keep`` and the slots of the feature vector as columns ``f_<name>``."""
    return vector_columns(df.select(*keep, vector), vector, names, "f_").select(*keep, *(f"f_{n}" for n in names))

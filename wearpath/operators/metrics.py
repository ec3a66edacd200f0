"""Confusion matrix and the metrics that follow from it.

The (label, prediction) pairs are grouped once; everything else is arithmetic on that table of at
most classes x classes rows, of which only pairs that occur have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per (label, prediction). Counts are combined before the shuffle."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def counted(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The pair counts as a local table: what comes of them reads the rows no more."""
    counts = pair_counts(df, label, prediction)
    return df.sparkSession.createDataFrame(counts.collect(), counts.schema)


def confusion(
    df: DataFrame, label: str = "label", prediction: str = "prediction", labels: str = "true"
) -> DataFrame:
    """Long confusion matrix (label, prediction, n), with 0 for pairs that do not occur.

    ``labels="true"`` lists the true classes only, as the usual multi-class metrics do: a class that
    is predicted but never true has no cell. ``labels="union"`` lists true and predicted classes.
    """
    return confusion_cells(pair_counts(df, label, prediction), labels)


def confusion_cells(counts: DataFrame, labels: str = "true") -> DataFrame:
    """The confusion matrix of pair counts."""
    if labels == "true":
        classes = F.collect_set("label")
    elif labels == "union":
        classes = F.array_union(F.collect_set("label"), F.collect_set("prediction"))
    else:
        raise ValueError(f"labels must be 'true' or 'union', not {labels!r}")
    # The class list is as long as there are classes; the cells it spans are the result's rows, and counts join them.
    listed = counts.agg(classes.alias("c")).select(F.explode("c").alias("label"), "c").select("label", F.explode("c").alias("prediction"))
    return listed.join(counts, ["label", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def confusion_percent(
    df: DataFrame, label: str = "label", prediction: str = "prediction", labels: str = "true"
) -> DataFrame:
    """Confusion matrix in percent of each true class; NULL for a class without true rows."""
    row = F.sum("n").over(Window.partitionBy("label"))
    return confusion(df, label, prediction, labels).select(
        "label", "prediction", F.try_divide(F.lit(100.0) * F.col("n"), row).alias("percent")
    )


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction", labels: str = "true"
) -> DataFrame:
    """Wide confusion matrix: one row per true class, one column per predicted class, ascending.

    The columns are known only from the data, so the cells, classes x classes of them, are
    counted here once and pivoted as a local table.
    """
    cells = confusion(df, label, prediction, labels)
    local = df.sparkSession.createDataFrame(cells.collect(), cells.schema)
    return local.groupBy("label").pivot("prediction").agg(F.sum("n")).orderBy("label")


def class_totals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per true class: ``tp``, rows of the class ``actual``, rows predicted so, and all rows ``total``."""
    return _totals(pair_counts(df, label, prediction))


def _totals(counts: DataFrame) -> DataFrame:
    as_true = F.struct(
        F.col("label").alias("label"),
        F.col("n").alias("actual"),
        F.lit(0).cast("long").alias("predicted"),
        F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"),
    )
    as_predicted = F.struct(
        F.col("prediction").alias("label"),
        F.lit(0).cast("long").alias("actual"),
        F.col("n").alias("predicted"),
        F.lit(0).cast("long").alias("tp"),
    )
    return (
        counts.select(F.inline(F.array(as_true, as_predicted)))
        .groupBy("label")
        .agg(F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))
        .withColumn("total", F.sum("actual").over(Window.partitionBy()))
        .where(F.col("actual") > 0)
    )


def _f_score(precision, recall, beta: float):
    b = beta * beta
    return F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0))


def per_class(
    df: DataFrame, label: str = "label", prediction: str = "prediction", beta: float = 1.0
) -> DataFrame:
    """Precision, recall, false-positive rate and F-score of each true class.

    A class that is never predicted has precision and F-score 0. With a single class the
    false-positive rate is undefined and NULL.
    """
    return _per_class(class_totals(df, label, prediction), beta)


def _per_class(totals: DataFrame, beta: float) -> DataFrame:
    tp, actual, predicted = F.col("tp"), F.col("actual"), F.col("predicted")
    return (
        totals.withColumns(
            {
                "precision": F.coalesce(F.try_divide(tp, predicted), F.lit(0.0)),
                "recall": tp / actual,
                "fpr": F.try_divide(predicted - tp, F.col("total") - actual),
                "share": actual / F.col("total"),
            }
        )
        .select("label", "precision", "recall", "fpr", _f_score(F.col("precision"), F.col("recall"), beta).alias("f"), "share", "tp", "total")
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


def weighted(
    df: DataFrame, label: str = "label", prediction: str = "prediction", beta: float = 0.5
) -> DataFrame:
    """One row of class metrics weighted by the share of each true class."""
    share, p, r = F.col("share"), F.col("precision"), F.col("recall")
    return per_class(df, label, prediction).agg(
        F.sum(share * p).alias("weighted_precision"),
        F.sum(share * r).alias("weighted_recall"),
        F.sum(share * _f_score(p, r, 1.0)).alias("weighted_f1"),
        F.sum(share * _f_score(p, r, beta)).alias("weighted_f_beta"),
        F.sum(share * F.col("fpr")).alias("weighted_fpr"),
    )


def evaluate(
    df: DataFrame, label: str = "label", prediction: str = "prediction", beta: float = 0.5
) -> DataFrame:
    """All metrics as tidy rows (metric, label, value); ``label`` is NULL for overall metrics."""
    return _metrics(pair_counts(df, label, prediction), beta)


def _metrics(counts: DataFrame, beta: float) -> DataFrame:
    classes = _per_class(_totals(counts), 1.0)
    share, p, r = F.col("share"), F.col("precision"), F.col("recall")
    overall = classes.agg(
        (F.sum("tp") / F.first("total")).alias("accuracy"),
        F.sum(share * p).alias("weighted_precision"),
        F.sum(share * r).alias("weighted_recall"),
        F.sum(share * _f_score(p, r, 1.0)).alias("weighted_f1"),
        F.sum(share * _f_score(p, r, beta)).alias("weighted_f_beta"),
        F.sum(share * F.col("fpr")).alias("weighted_fpr"),
    )

    def tidy(table, names, key):
        cells = [F.struct(F.lit(n).alias("metric"), key.alias("label"), F.col(c).alias("value")) for n, c in names]
        return table.select(F.inline(F.array(*cells)))

    return tidy(overall, [(c, c) for c in overall.columns], F.lit(None).cast("double")).unionByName(
        tidy(
            classes,
            [("precision", "precision"), ("recall", "recall"), ("fpr", "fpr"), ("f1", "f")],
            F.col("label").cast("double"),
        )
    )


def full_report(df: DataFrame, label: str = "label", prediction: str = "prediction", beta: float = 0.5) -> DataFrame:
    """All metrics and the confusion cells as tidy rows (metric, label, prediction, value).

    ``prediction`` is set in the cells (metric ``confusion``) only. The table is scored and counted
    once, here; both halves read its classes x classes counts as a local table.
    """
    counts = counted(df, label, prediction)
    cells = confusion_cells(counts, "union").select(
        F.lit("confusion").alias("metric"),
        F.col("label").cast("double").alias("label"),
        F.col("prediction").cast("double").alias("prediction"),
        F.col("n").cast("double").alias("value"),
    )
    metrics = _metrics(counts, beta).withColumn("prediction", F.lit(None).cast("double"))
    return metrics.select("metric", "label", "prediction", "value").unionByName(cells)


def report(df: DataFrame, title: str, label: str = "label", prediction: str = "prediction") -> str:
    """The metrics of a model as text. Only the classes x classes table reaches the driver."""
    cells = {(r.label, r.prediction): r.n for r in confusion(df, label, prediction).collect()}
    classes = sorted({key[0] for key in cells})
    lines = [title, "confusion matrix (rows: true, columns: predicted)", "\t".join(["", *map(str, classes)])]
    lines += ["\t".join([str(a), *[str(cells[a, b]) for b in classes]]) for a in classes]
    rows = evaluate(df, label, prediction).orderBy("metric", "label").collect()
    for row in rows:
        name = row.metric if row.label is None else f"{row.metric}({row.label:g})"
        lines.append(f"{name} = {row.value}")
    return "\n".join(lines)

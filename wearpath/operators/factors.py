"""Implicit-feedback factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from wearpath.functions.scalar import joined_decimals
from wearpath.session import keep_checkpoints

#: Fewest and most blocks of a fit that is given none, and the ratings that make one more worth its shuffle.
FEWEST_BLOCKS, MOST_BLOCKS, RATINGS_PER_BLOCK = 4, 8, 300_000


def fit_implicit(
    ratings: DataFrame,
    rank: int = 40,
    iterations: int = 20,
    regularisation: float = 0.8,
    alpha: float = 150.0,
    seed: int = 11,
    blocks: int | None = None,
) -> ALSModel:
    """Implicit-feedback ALS on (user, item, rating).

    Each step sends a factor to every block that needs it, so what is shuffled grows with ``blocks``,
    which is also how many tasks work on a step: by default few ratings have few blocks and many at most
    ``MOST_BLOCKS``. The lineage is cut in every iteration, as ALS deletes a shuffle only when it does so.
    """
    keep_checkpoints(ratings.sparkSession)
    rows = ratings.select("user", "item", "rating").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        blocks = blocks or min(MOST_BLOCKS, max(FEWEST_BLOCKS, -(-rows.count() // RATINGS_PER_BLOCK)))
        als = ALS(
            rank=rank,
            maxIter=iterations,
            regParam=regularisation,
            alpha=alpha,
            implicitPrefs=True,
            userCol="user",
            itemCol="item",
            ratingCol="rating",
            seed=seed,
            numUserBlocks=blocks,
            numItemBlocks=blocks,
            checkpointInterval=1,
        )
        return als.fit(rows)
    finally:
        rows.unpersist()


def item_factors(model: ALSModel) -> DataFrame:
    return model.itemFactors.select("id", "features")


def factor_lines(factors: DataFrame) -> DataFrame:
    """One text line per item: id, a tab, then the factors with six decimals and blanks between."""
    return factors.select(
        F.concat(F.col("id").cast("string"), F.lit("\t"), joined_decimals(F.col("features"))).alias("value")
    )


def user_residuals(model: ALSModel, ratings: DataFrame, regularisation: float = 0.8, alpha: float = 150.0) -> DataFrame:
    """How far each user vector is from the ridge solution given the item vectors: (id, residual).

    The last step of a fit solves (G + sum of a r x x' + l n I) y = sum of (1 + a r) x for every
    user, with G the sum of x x' over all items. The residual is the length of the difference
    of both sides over that of the right one. It is linear in the rated items' vectors, so no
    matrix is built per user: a rating adds one multiple of its item's vector, and only the rank x rank sums of G go to the driver.
    All sums are matrix products of Arrow batches inside the tasks; a batch sends one row for each user in it.
    """
    rank = model.rank
    items = model.itemFactors.select(F.col("id").alias("item"), F.col("features").alias("x"))
    users = model.userFactors.select(F.col("id").alias("user"), F.col("features").alias("y"))
    own = range(rank)
    gram = _gram(items.select("x"), rank)
    rated = ratings.join(items, "item").join(users, "user").select("user", "x", "y", F.coalesce(F.col("rating").cast("double"), F.lit(0.0)).alias("rating"))
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([rated.schema["user"], T.StructField("c", vector), T.StructField("b", vector), T.StructField("n", T.LongType())])
    sums = rated.mapInArrow(lambda batches: _user_sums(batches, rank, alpha), schema).groupBy("user").agg(
        *[F.array(*[F.sum(F.col(side)[i]) for i in own]).alias(side) for side in ("c", "b")], F.sum("n").alias("n")
    )
    solved = sums.join(users, "user").select(F.col("user").alias("id"), "c", "b", "n", "y")

    def lengths(batches):
        for batch in batches:
            if not len(batch):
                continue
            c, b, y = (_vectors(batch.column(name), rank) for name in ("c", "b", "y"))
            gap = c + y @ gram + regularisation * batch.column("n").to_numpy()[:, None] * y
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((gap * gap).sum(1)), pa.array((b * b).sum(1))], names=["id", "gap", "right"])

    squares = solved.mapInArrow(lengths, T.StructType([solved.schema["id"], *(T.StructField(n, T.DoubleType()) for n in ("gap", "right"))]))
    return squares.select("id", F.sqrt(F.try_divide("gap", "right")).alias("residual"))


def _vectors(column: pa.Array, rank: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), rank)


def _gram(vectors: DataFrame, rank: int) -> np.ndarray:
    """The sum of x x' over a table of one column of vectors."""

    def products(batches):
        total = np.zeros((rank, rank))
        for batch in batches:
            x = _vectors(batch.column(0), rank)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rank * rank, dtype="int32")), pa.array(total.reshape(-1))], names=["at", "v"])

    total = np.zeros(rank * rank)
    for row in vectors.mapInArrow(products, "at INT, v DOUBLE").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[row["at"]] = row["v"]
    return total.reshape(rank, rank)


def _user_sums(batches: Iterator[pa.RecordBatch], rank: int, alpha: float) -> Iterator[pa.RecordBatch]:
    """For the users of each batch of (user, x, y, rating): the sums of (a r x'y - right) x and of right x, and how many items they saw."""
    for batch in batches:
        if not len(batch):
            continue
        user, rating = batch.column("user").to_numpy(), batch.column("rating").to_numpy()
        order = np.argsort(user, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(user[order]) != 0])
        x, y = (_vectors(batch.column(c), rank) for c in ("x", "y"))
        confidence, seen = alpha * np.abs(rating), ~(rating <= 0)  # a rating that is no number counts as seen, as in SQL
        right = np.where(seen, 1 + confidence, 0.0)
        left = confidence * (x * y).sum(1) - right
        c, b = (np.add.reduceat((w[:, None] * x)[order], starts) for w in (left, right))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (len(starts) + 1) * rank, rank, dtype="int32")), pa.array(v.reshape(-1))) for v in (c, b)]
        n = pa.array(np.add.reduceat(seen[order].astype("int64"), starts))
        yield pa.RecordBatch.from_arrays([pa.array(user[order][starts]), *lists, n], names=["user", "c", "b", "n"])

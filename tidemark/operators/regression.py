"""Ridge regression of a forward label on signals: sums by Spark, the small system on the driver, scores by columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: A pivot below this makes the system singular.
LEAST_PIVOT = 1e-12
#: The system has so many unknowns at most; it alone comes to the driver.
MOST_FEATURES = 100


def _complete(features: list[str], label: str) -> Column:
    """Rows with a number in every feature and in the label."""
    ok = F.lit(True)
    for c in [*features, label]:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return ok


def _products(features: list[str], label: str) -> dict[str, Column]:
    """What is summed up: xx_i_j (i <= j; 0 is the intercept) and xy_i."""
    if not 1 <= len(features) <= MOST_FEATURES:
        raise ValueError(f"1 to {MOST_FEATURES} features")
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    return {f"xx_{i}_{j}": x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))} | {f"xy_{i}": x[i] * F.col(label) for i in range(len(x))}


def normal_equations(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: n, xx_i_j (i <= j; 0 is the intercept) and xy_i, summed over the complete rows in one pass."""
    sums = (F.sum(x).alias(name) for name, x in _products(features, label).items())
    return rows.where(_complete(features, label)).agg(F.count("*").alias("n"), *sums)


def solution(matrix: Column, k: int) -> Column:
    """The solution of a system of k equations as an array; matrix is an array of k rows, each the k coefficients and the right side. All zero if it is singular.

    Gauss and Jordan's elimination with the largest pivot of each column (the first of equals), as one aggregate over
    the columns: a fold's system is a row, and as many as there are are solved where they lie.
    """
    wide = "array<array<double>>"

    def swapped(m: Column, c: Column, p: Column) -> Column:
        return F.transform(m, lambda row, i: F.when(i == c, F.element_at(m, p)).when(i == p - 1, F.element_at(m, c + 1)).otherwise(row))

    def without(m: Column, c: Column) -> Column:
        pivot_row = F.element_at(m, c + 1)
        pivot = F.element_at(pivot_row, c + 1)
        return F.transform(m, lambda row, i: F.when(i == c, row).otherwise(let(F.element_at(row, c + 1) / pivot, lambda f: F.zip_with(row, pivot_row, lambda x, y: x - f * y))))

    def step(m: Column, c: Column) -> Column:
        sizes = F.transform(m, lambda row, i: F.when(i < c, F.lit(-1.0)).otherwise(F.abs(F.element_at(row, c + 1))))
        done = let(sizes, lambda s: F.when(F.array_max(s) >= LEAST_PIVOT, let(swapped(m, c, F.array_position(s, F.array_max(s)).cast("int")), lambda x: without(x, c))))
        return F.when(m.isNotNull(), done)

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), matrix.cast(wide), step)
    zeros = F.array_repeat(F.lit(0.0), k)
    return F.when(solved.isNull(), zeros).otherwise(F.transform(solved, lambda row, i: F.element_at(row, k + 1) / F.element_at(row, i + 1)))


def fold_models(rows: DataFrame, folds: DataFrame, features: list[str], label: str, ridge: float = 1e-6) -> DataFrame:
    """fold, n and coefficients (intercept first) of the model fitted to each fold's training range; rows are (t, features, label).

    Sums by session are cumulated over the sessions, so that one pass over the rows gives every fold's sums, as the
    difference of two sessions. Sessions and folds are few; rows without a number in every feature and the label don't
    count. A fold without complete rows, or with a singular system, has coefficients of 0.
    """
    products, k = _products(features, label), len(features) + 1
    names = ["n", *products]
    by_session = rows.where(_complete(features, label)).groupBy("t").agg(F.count("*").cast("double").alias("n"), *(F.sum(x).alias(c) for c, x in products.items()))
    edges = folds.select("fold", F.explode(F.array(F.struct(F.col("train_end").alias("t"), F.lit(1.0).alias("sign")), F.struct((F.col("train_start") - 1).alias("t"), F.lit(-1.0).alias("sign")))).alias("e")).select("fold", "e.t", "e.sign")
    upto = Window.orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = by_session.unionByName(edges, allowMissingColumns=True).withColumns({c: F.coalesce(F.sum(c).over(upto), F.lit(0.0)) for c in names}).where("fold is not null")
    sums = known.groupBy("fold").agg(*(F.sum(F.col("sign") * F.col(c)).alias(c) for c in names))
    cell = lambda i, j: F.col(f"xx_{min(i, j)}_{max(i, j)}") + (ridge if i == j and i else 0.0)
    system = F.array(*(F.array(*(cell(i, j) for j in range(k)), F.col(f"xy_{i}")) for i in range(k)))
    return sums.select("fold", F.col("n").cast("bigint").alias("n"), solution(system, k).alias("coefficients"))


def fold_scores(rows: DataFrame, folds: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """rows (t, features) out of sample with their fold and `score`, by the fold's own model; null where a feature is missing."""
    asked = F.broadcast(folds.select("fold", "oos_start", "oos_end").join(models.select("fold", "coefficients"), "fold"))  # folds are few
    score = F.element_at("coefficients", 1)
    for i, c in enumerate(features):
        score = score + F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) * F.element_at("coefficients", i + 2)
    return rows.join(asked, F.col("t").between(F.col("oos_start"), F.col("oos_end"))).withColumn("score", score).drop("coefficients", "oos_start", "oos_end")


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a x = b; all zero if the system is singular."""
    a, b = a.astype(float).copy(), b.astype(float).copy()
    for i in range(len(b)):
        at = i + int(np.argmax(np.abs(a[i:, i])))
        if abs(a[at, i]) < LEAST_PIVOT:
            return np.zeros(len(b))
        a[[i, at]], b[[i, at]] = a[[at, i]], b[[at, i]]
        below = a[i + 1 :, i] / a[i, i]
        a[i + 1 :] -= below[:, None] * a[i]
        b[i + 1 :] -= below * b[i]
    for i in reversed(range(len(b))):
        b[i] = (b[i] - a[i, i + 1 :] @ b[i + 1 :]) / a[i, i]
    return b


def ridge_fit(rows: DataFrame, features: list[str], label: str, ridge: float = 1e-6) -> list[float]:
    """Intercept and coefficients; ridge is added to the diagonal of the features only. Without complete rows, all are 0."""
    sums, k = normal_equations(rows, features, label).first(), len(features) + 1
    if not sums["n"]:
        return [0.0] * k
    a = np.array([[sums[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    a[np.arange(1, k), np.arange(1, k)] += ridge
    return solve(a, np.array([sums[f"xy_{i}"] for i in range(k)], float)).tolist()


def linear_score(features: list[str], coefficients: list[float]) -> Column:
    """The fitted value; null if a feature is missing."""
    score = F.lit(coefficients[0])
    for c, w in zip(features, coefficients[1:], strict=True):
        score = score + F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) * F.lit(w)
    return score

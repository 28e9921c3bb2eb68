"""Linear regression on sufficient statistics: one aggregation over the data, the rest on (p + 1) squared numbers.

Rows with a null in a feature or the target are left out.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions.inference import ref

DIVERGED = 1e300


@dataclass(frozen=True)
class Sums:
    """X'X, X'y, y'y and n, with a leading column of ones in X."""

    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: int


def _terms(features: list[str]) -> list[Column]:
    return [F.lit(1.0), *(ref(c).cast("double") for c in features)]


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, c: a & ref(c).isNotNull(), columns, F.lit(True)))


def sufficient(df: DataFrame, features: list[str], target: str) -> Sums:
    x, y = _terms(features), ref(target).cast("double")
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = complete(df, [*features, target]).agg(
        F.count("*"), F.sum(y * y), *(F.sum(a * y) for a in x), *(F.sum(x[i] * x[j]) for i, j in cells)
    ).head()
    if not row[0]:
        raise ValueError("no complete rows to fit")
    xx = np.zeros((len(x), len(x)))
    for (i, j), v in zip(cells, row[2 + len(x) :], strict=True):
        xx[i, j] = xx[j, i] = v
    return Sums(xx, np.array(row[2 : 2 + len(x)], float), float(row[1]), int(row[0]))


@dataclass(frozen=True)
class Model:
    """Fitted coefficients, the intercept first."""

    features: list[str]
    coefficients: np.ndarray
    loss_history: list[float] = field(default_factory=list)
    iterations: int = 0
    converged: bool = True

    @property
    def intercept(self) -> float:
        return float(self.coefficients[0])

    @property
    def slope(self) -> float:
        return float(self.coefficients[1])

    def prediction(self) -> Column:
        return reduce(lambda a, b: a + b, (t * F.lit(float(c)) for t, c in zip(_terms(self.features), self.coefficients, strict=True)))

    def predict(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        return df.withColumn(column, self.prediction())

    def score(self, df: DataFrame, target: str) -> dict[str, float]:
        return scores(complete(df, [*self.features, target]), ref(target), self.prediction()).head().asDict()


def slope(df: DataFrame, x: str, y: str) -> float | None:
    return df.agg(F.regr_slope(ref(y).cast("double"), ref(x).cast("double"))).head()[0]


def intercept(df: DataFrame, x: str, y: str) -> float | None:
    return df.agg(F.regr_intercept(ref(y).cast("double"), ref(x).cast("double"))).head()[0]


def fit_ols(df: DataFrame, features: list[str], target: str) -> Model:
    """Normal equations; numpy's LinAlgError if they are singular."""
    s = sufficient(df, features, target)
    return Model(features, np.linalg.solve(s.xx, s.xy))


def drawn_batches(df: DataFrame, features: list[str], target: str, size: int, n: int, rounds: int, seed: int, draw: Callable[[int], Column] = F.rand) -> list[Sums]:
    """Sums of up to ``rounds`` random batches of about ``size`` of the n rows, by one pass.

    Every row goes to one batch at most, by the number from 0 to 1 that ``draw(seed)`` gives it, so a pass makes n / size batches
    and their sizes vary as those of coin tosses do.
    """
    some = min(rounds, max(1, n // size))
    x, y = _terms(features), ref(target).cast("double")
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = [F.count("*").alias("n"), F.sum(y * y).alias("yy"), *(F.sum(a * y).alias(f"y{k}") for k, a in enumerate(x)), *(F.sum(x[i] * x[j]).alias(f"x{k}") for k, (i, j) in enumerate(cells))]
    batch = F.floor(draw(seed) * (n / size)).cast("int").alias("batch")
    found = complete(df, [*features, target]).select("*", batch).where(F.col("batch") < some).groupBy("batch").agg(*sums)
    out = []
    for row in sorted(found.collect()):  # a row for each batch
        xx = np.zeros((len(x), len(x)))
        for (i, j), v in zip(cells, row[3 + len(x) :], strict=True):
            xx[i, j] = xx[j, i] = v
        out.append(Sums(xx, np.array(row[3 : 3 + len(x)], float), float(row[2]), int(row[1])))
    return out


@dataclass(frozen=True)
class GradientDescent:
    """Descent on the mean squared loss; with ``batch_size`` each round takes random rows of about that number, many rounds by one pass.

    ``draw`` makes the column of random numbers of a pass; one of the row's own columns draws alike under any partitioning.
    """

    learning_rate: float = 0.01
    max_iterations: int = 1000
    tolerance: float = 1e-6
    batch_size: int | None = None
    initial_beta: list[float] | None = None
    seed: int | None = None
    draw: Callable[[int], Column] = F.rand

    def _rounds(self, df: DataFrame, features: list[str], target: str, whole: Sums) -> Iterator[Sums]:
        if self.batch_size is None or self.batch_size >= whole.n:
            yield from repeat(whole, self.max_iterations)
            return
        left, seed = self.max_iterations, random.randrange(1 << 31) if self.seed is None else self.seed
        while left:
            batches = drawn_batches(df, features, target, self.batch_size, whole.n, left, seed, self.draw)
            yield from batches
            left, seed = left - len(batches), seed + 1

    def fit(self, df: DataFrame, features: list[str], target: str) -> Model:
        s = sufficient(df, features, target)
        beta = np.zeros(len(s.xy)) if self.initial_beta is None else np.array(self.initial_beta, float)
        history: list[float] = []
        for k, part in enumerate(self._rounds(df, features, target, s)):
            history.append(float(beta @ part.xx @ beta - 2 * beta @ part.xy + part.yy) / (2 * part.n))
            if k and abs(history[-1] - history[-2]) < self.tolerance:
                return Model(features, beta, history, k, True)
            if not abs(history[-1]) < DIVERGED:
                return Model(features, beta, history, k, False)
            beta = beta - self.learning_rate * (part.xx @ beta - part.xy) / part.n
        return Model(features, beta, history, self.max_iterations - 1, False)


class LinearRegression:
    """Facade: ("ordinary_least_squares" or "gradient_descent") x ("simple" or "multiple")."""

    KINDS = ("ordinary_least_squares", "gradient_descent")

    def __init__(self, kind: str = "ordinary_least_squares", complexity: str = "simple"):
        if kind not in self.KINDS or complexity not in ("simple", "multiple"):
            raise ValueError(f"no model for {(kind, complexity)}")
        self.kind, self.complexity, self.model = kind, complexity, None

    def fit(self, df: DataFrame, features: list[str] | str, target: str, **options) -> Model:
        features = [features] if isinstance(features, str) else list(features)
        if self.complexity == "simple" and len(features) != 1:
            raise ValueError("a simple regression has one feature")
        descent = self.kind == "gradient_descent"
        self.model = GradientDescent(**options).fit(df, features, target) if descent else fit_ols(df, features, target)
        return self.model

    def _fitted(self) -> Model:
        if self.model is None:
            raise ValueError("the model isn't fitted")
        return self.model

    def predict(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        return self._fitted().predict(df, column)

    def score(self, df: DataFrame, target: str) -> dict[str, float]:
        return self._fitted().score(df, target)


def scores(df: DataFrame, y: Column, p: Column) -> DataFrame:
    """One row: mse, rmse, r2 (null for a constant target), in one aggregation."""
    y, p = y.cast("double"), p.cast("double")
    square = F.pow(y - p, F.lit(2.0))
    return df.agg(F.avg(square).alias("mse"), F.sum(square).alias("s"), (F.var_pop(y) * F.count(y)).alias("t")).select(
        "mse", F.sqrt("mse").alias("rmse"), (1 - F.try_divide(F.col("s"), F.col("t"))).alias("r2")
    )

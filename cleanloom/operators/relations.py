"""Analyzers of how columns depend on each other, from one table of products or counts."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.functions import inference as I
from cleanloom.functions.inference import ref
from cleanloom.functions.special import chi_square_tail, f_tail
from cleanloom.operators.series import filled

#: A column whose variance is explained up to this share by those before it is singular.
SINGULAR = 1e-10


def gram(df: DataFrame, columns: list[Column]) -> tuple[int, np.ndarray]:
    """The number of rows and the sums of products about the means, by one aggregation whose parts merge without loss."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    x = [F.col(f"x{k}") for k in range(len(columns))]
    table = df.select(*(c.cast("double").alias(f"x{k}") for k, c in enumerate(columns)))
    row = table.agg(F.count("*"), *(F.covar_pop(x[i], x[j]) for i, j in pairs)).head()
    out = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        out[i, j] = out[j, i] = math.nan if v is None else v * row[0]
    return row[0], out


def sweep(a: np.ndarray, k: int) -> np.ndarray:
    """The matrix with column k regressed out of all others."""
    out = a - np.outer(a[:, k], a[k, :]) / a[k, k]
    out[k, :], out[:, k] = a[k, :] / a[k, k], -a[:, k] / a[k, k]
    out[k, k] = 1 / a[k, k]
    return out


def multicollinearity(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, vif, tolerance, singular, condition) of number columns, over rows without a null.

    The inflation of a column's variance is 1 over its tolerance, the share of its variance
    that the others don't explain. A column that is constant, or that those before it
    explain, is singular; it has no inflation, and others are judged without it. The condition number is the root of
    the ratio of the extreme eigenvalues of the correlations of the other columns, the same in all rows.
    """
    names = I.numbers(df) if columns is None else columns
    schema = "column string, vif double, tolerance double, singular boolean, condition double"
    n, a = gram(filled(df, names), [ref(c) for c in names])
    if n < 2 or not names:
        return df.sparkSession.createDataFrame([(c, None, None, None, None) for c in names], schema)
    left, kept = a.copy(), []
    for k in range(len(names)):
        if a[k, k] > 0 and left[k, k] > SINGULAR * a[k, k]:
            left = sweep(left, k)
            kept.append(k)
    size = np.sqrt(a[kept, kept])
    r = a[np.ix_(kept, kept)] / np.outer(size, size)
    share = dict(zip(kept, 1 / np.diag(np.linalg.inv(r)), strict=True)) if kept else {}
    values = np.linalg.eigvalsh(r) if kept else None
    condition = None if values is None else math.sqrt(values[-1] / values[0])
    rows = [(c, 1 / float(share[k]) if k in share else None, float(share[k]) if k in share else None, k not in share, condition) for k, c in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, schema)


def interaction_effects(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(left, right, effect, f, p_value): what the product of two features adds to a regression on all features.

    One aggregation has the products of features, of their pairs and of the target; the
    features are swept out of it, and what is left of a pair and the target gives its
    effect and partial F. Both are null where features explain the product wholly.
    """
    df = filled(df, [*features, target])
    # about the means products are less alike to their factors; the partial F is the same
    means = df.agg(*(F.avg(ref(c).cast("double")) for c in features)).head()
    x = [ref(c).cast("double") - F.lit(m) for c, m in zip(features, means, strict=True)]
    pairs = list(combinations(range(len(features)), 2))
    n, a = gram(df, [*x, *(x[i] * x[j] for i, j in pairs), ref(target)])
    left, used = a.copy(), 0
    for k in range(len(features)):
        if a[k, k] > 0 and left[k, k] > SINGULAR * a[k, k]:
            left, used = sweep(left, k), used + 1
    rows, free, y = [], n - used - 2, len(a) - 1
    for k, (i, j) in enumerate(pairs, len(features)):
        effect = f = None
        if free > 0 and left[k, k] > SINGULAR * a[k, k]:
            gain = left[k, y] ** 2 / left[k, k]
            effect = float(left[k, y] / left[k, k])
            rest = left[y, y] - gain
            f = float(gain / (rest / free)) if rest > 0 else None
        rows.append((features[i], features[j], effect, f, None if f is None else f_tail(f, 1, free)))
    return df.sparkSession.createDataFrame(rows, "left string, right string, effect double, f double, p_value double")


def contingency(df: DataFrame, columns: list[str]) -> DataFrame:
    """(left, right, a, b, n): how often two columns, of the named ones, have two values together; nulls are a value.

    Every pair of columns once, and every column with itself. Counted with map-side combine.
    """
    values = [F.coalesce(ref(c).cast("string"), F.lit("\0")) for c in columns]
    each = [F.struct(F.lit(i).alias("left"), F.lit(j).alias("right"), values[i].alias("a"), values[j].alias("b")) for i in range(len(columns)) for j in range(i, len(columns))]
    return df.select(F.inline(F.array(*each))).groupBy("left", "right", "a", "b").agg(F.count("*").alias("n"))


def feature_selection(df: DataFrame, features: list[str], target: str, most: int | None = None) -> DataFrame:
    """(feature, chi_square, p_value, mutual_information, rank, score): features of few values by what they tell of a target.

    One table of counts has every pair of columns. Chi-square and mutual information (in
    bits) with the target come from it; so does the redundancy by which features are
    chosen stepwise: the next is the one with the greatest mutual information with the
    target less its mean with the features chosen before (of equals the first named). ``rank`` counts the steps,
    null after ``most`` of them. Bin features of many values first.
    """
    columns = [*features, target]
    counts = contingency(df, columns)
    own = counts.where("left = right").select(F.col("left").alias("c"), F.col("a").alias("v"), F.col("n").alias("of"))
    total = df.count()
    both = counts.where("left < right")
    both = both.join(own.select(F.col("c").alias("left"), F.col("v").alias("a"), F.col("of").alias("na")), ["left", "a"])
    both = both.join(own.select(F.col("c").alias("right"), F.col("v").alias("b"), F.col("of").alias("nb")), ["right", "b"])
    n, expected = F.col("n").cast("double"), F.col("na").cast("double") * F.col("nb") / F.lit(float(total))
    # cells that never occur have their expectation as their part; all expectations sum to the total
    found = both.groupBy("left", "right").agg((F.sum(n * n / expected) - F.lit(float(total))).alias("chi"), (F.sum(n * F.log2(n / expected)) / F.lit(float(total))).alias("mi"))
    told = {(r["left"], r["right"]): (max(0.0, r["chi"]), max(0.0, r["mi"])) for r in found.collect()}  # a row for each pair of columns
    size = {r["c"]: r["count"] for r in own.groupBy("c").count().collect()}
    y, left, chosen = len(features), list(range(len(features))) if told else [], []
    mi = lambda i, j: told[min(i, j), max(i, j)][1]
    rank: dict[int, tuple[int, float]] = {}
    while left and len(chosen) < (len(features) if most is None else most):
        score = {i: mi(i, y) - (sum(mi(i, j) for j in chosen) / len(chosen) if chosen else 0.0) for i in left}
        best = max(left, key=lambda i: (round(score[i], 12), -i))
        chosen.append(best)
        left.remove(best)
        rank[best] = (len(chosen), score[best])
    rows = []
    for i, c in enumerate(features):
        chi, bits = told.get((i, y), (None, None))
        free = (size.get(i, 1) - 1) * (size.get(y, 1) - 1)
        p = None if chi is None or not free else chi_square_tail(chi, free)
        rows.append((c, chi, p, bits, *rank.get(i, (None, None))))
    return df.sparkSession.createDataFrame(rows, "feature string, chi_square double, p_value double, mutual_information double, rank int, score double")

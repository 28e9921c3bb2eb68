"""Anomalies by isolation forest: random trees of a bounded sample, every row scored by how soon they isolate it."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions import inference as I
from cleanloom.functions.inference import ref
from cleanloom.operators.series import filled

#: Trees, and rows that each is grown from: the driver sees TREES * ROWS rows at most, whatever the table's size.
TREES, ROWS = 50, 256


def expected_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n keys."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Tree:
    """Nodes in heap order (the children of i are 2i + 1 and 2i + 2): column that divides, -1 at leaves, and where; path length at leaves."""

    column: list[int]
    at: list[float]
    path: list[float]

    def length(self, x: np.ndarray) -> float:
        i = 0
        while self.column[i] >= 0:
            i = 2 * i + 1 + int(x[self.column[i]] >= self.at[i])
        return self.path[i]


def grown(rows: np.ndarray, depth: int, draw: np.random.Generator) -> Tree:
    """A tree that divides rows at random places of random columns that still vary."""
    size = 2 ** (depth + 1) - 1
    tree = Tree([-1] * size, [0.0] * size, [0.0] * size)
    stack = [(0, rows, 0)]
    while stack:
        i, part, level = stack.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        vary = np.flatnonzero(low < high)
        if level == depth or len(part) < 2 or not len(vary):
            tree.path[i] = level + expected_path(len(part))
            continue
        c = int(draw.choice(vary))
        at = float(draw.uniform(low[c], high[c]))
        at = at if low[c] < at <= high[c] else float(high[c])
        tree.column[i], tree.at[i] = c, at
        right = part[:, c] >= at
        stack += [(2 * i + 1, part[~right], level + 1), (2 * i + 2, part[right], level + 1)]
    return tree


def forest(df: DataFrame, columns: list[str], trees: int = TREES, rows: int = ROWS, seed: int = 0) -> tuple[list[Tree], int]:
    """Trees of a random sample of ``trees * rows`` rows without nulls, and how many rows each has seen."""
    x = filled(df.select(*columns), columns).select(*(ref(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)))
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *x.columns)
    pool = np.array([r[:-1] for r in x.withColumn("_h", place).orderBy("_h").limit(trees * rows).collect()], float)  # bounded by the parameters
    draw = np.random.default_rng(seed)
    if not len(pool):
        return [], 0
    each = min(rows, len(pool))
    depth = max(1, math.ceil(math.log2(max(2, each))))
    return [grown(pool[draw.choice(len(pool), each, replace=False)], depth, draw) for _ in range(trees)], each


def path_length(x: list[Column], trees: list[Tree]) -> Column:
    """Mean length of the paths of a row through the trees, in Arrow batches: all rows of a batch take a step at a time.

    As one expression of higher-order functions over the trees it takes some thirty times as long.
    """
    nodes = [(np.array(t.column), np.array(t.at), np.array(t.path)) for t in trees]
    levels = int(math.log2(len(trees[0].column) + 1)) - 1

    @F.pandas_udf(T.DoubleType())
    def mean(*values: pd.Series) -> pd.Series:
        rows = np.column_stack(values)
        every, total = np.arange(len(rows)), np.zeros(len(rows))
        for column, at, path in nodes:
            i = np.zeros(len(rows), int)
            for _ in range(levels):
                c = column[i]
                i = np.where(c < 0, i, 2 * i + 1 + (rows[every, np.maximum(c, 0)] >= at[i]))
            total += path[i]
        return pd.Series(total / len(nodes))

    return mean(*x)


def isolation_scores(df: DataFrame, columns: list[str] | None = None, trees: int = TREES, rows: int = ROWS, seed: int = 0) -> DataFrame:
    """``df`` with isolation_score from 0 to 1: near 1 where few cuts isolate a row, about 0.5 or less where many are needed.

    The forest is grown on the driver from a bounded sample; all rows are scored where they
    are, without a shuffle. Null where a column is null or NaN, or the table has
    no rows without nulls. The sample depends on the order of reading; ``seed`` decides the rest.
    """
    names = I.numbers(df) if columns is None else columns
    grown_, each = forest(df, names, trees, rows, seed)
    x = [F.nanvl(ref(c).cast("double"), F.lit(None)) for c in names]
    if not grown_ or not expected_path(each):
        return df.withColumn("isolation_score", F.lit(None).cast("double"))
    score = F.pow(F.lit(2.0), -path_length(x, grown_) / expected_path(each))
    whole = sum((F.when(c.isNull(), 1).otherwise(0) for c in x), F.lit(0)) == 0
    return df.withColumn("isolation_score", F.when(whole, score))

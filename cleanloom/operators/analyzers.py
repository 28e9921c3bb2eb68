"""Profiles of a table: a registry of named analyzers that return a DataFrame or a plain value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.functions import inference as I
from cleanloom.functions.inference import ROW_ID, user_columns
from cleanloom.operators.distributions import distribution_type, normality_test
from cleanloom.operators.forest import isolation_scores
from cleanloom.operators.ordered import looked_back
from cleanloom.operators.regression import LinearRegression
from cleanloom.operators.relations import feature_selection, interaction_effects, multicollinearity
from cleanloom.operators.segments import customer_segments, population_splits
from cleanloom.operators.series import causality, change_points, risk_metrics
from cleanloom.operators.steps import as_number, quantiles, with_row_id

REGISTRY: dict[str, Callable] = {}


def register(name: str, analyzer: Callable) -> None:
    REGISTRY[name] = analyzer


def analyze(name: str, df: DataFrame, **kwargs):
    if name not in REGISTRY:
        raise ValueError(f"unknown analyzer {name!r}; registered: {sorted(REGISTRY)}")
    return REGISTRY[name](df, **kwargs)


def types(df: DataFrame) -> dict[str, str]:
    return {c: kind for c, kind in df.dtypes if c != ROW_ID}


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(user_columns(df))


def _long(df: DataFrame, columns: dict[str, list], names: list[str]) -> DataFrame:
    """One row of statistics for each column, from one aggregation."""
    row = df.agg(*(F.struct(*(x.alias(n) for x, n in zip(xs, names, strict=True))).alias(f"c{k}") for k, xs in enumerate(columns.values())))
    each = [F.struct(F.lit(c).alias("column"), *(F.col(f"c{k}.{n}").alias(n) for n in names)) for k, c in enumerate(columns)]
    return row.select(F.inline(F.array(*each)))


def info(df: DataFrame) -> DataFrame:
    """(column, type, non_null)."""
    kinds = types(df)
    counted = {c: [F.lit(kinds[c]), F.count(I.ref(c))] for c in user_columns(df)}
    return _long(df, counted, ["type", "non_null"])


def describe(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of number columns; approximate quartiles with ``accuracy``."""
    names, stats = I.numbers(df), {}
    quarts = quantiles(df, [I.ref(c) for c in names], [0.25, 0.5, 0.75], accuracy) if names else []
    for c, q in zip(names, quarts, strict=True):
        x = as_number(df, c)
        stats[c] = [F.count(x), F.avg(x), F.stddev_samp(x), F.min(x), *(F.lit(v).cast("double") for v in q or [None] * 3), F.max(x)]
    return _long(df, stats, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"])


def columns(df: DataFrame) -> list[str]:
    return user_columns(df)


def index(df: DataFrame) -> DataFrame:
    """The row ids."""
    return with_row_id(df).select(ROW_ID)


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return with_row_id(df).orderBy(ROW_ID).limit(n).drop(ROW_ID)


def tail(df: DataFrame, n: int = 5) -> DataFrame:
    return with_row_id(df).orderBy(F.desc(ROW_ID)).limit(n).orderBy(ROW_ID).drop(ROW_ID)


def sample(df: DataFrame, n: int = 1, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def trend(df: DataFrame, x: str, y: str, type_of_prediction: str = "ordinary_least_squares", complexity: str = "simple", **options) -> DataFrame:
    """(trend_slope, trend_intercept) of y over x, by the model of that kind; ``options`` go to its fit."""
    if (type_of_prediction, complexity) == ("ordinary_least_squares", "simple"):
        a, b = I.ref(y).cast("double"), I.ref(x).cast("double")
        return df.agg(F.regr_slope(a, b).alias("trend_slope"), F.regr_intercept(a, b).alias("trend_intercept"))
    model = LinearRegression(type_of_prediction, complexity).fit(df, x, y, **options)
    return df.sparkSession.createDataFrame([(model.slope, model.intercept)], "trend_slope double, trend_intercept double")


def correlation(df: DataFrame) -> DataFrame:
    """(left, right, correlation) of each pair of number columns, in one aggregation."""
    names = I.numbers(df)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = df.agg(*(F.corr(I.ref(a), I.ref(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    each = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*each)))


def shape_of_distribution(df: DataFrame) -> DataFrame:
    """(column, skewness, kurtosis), of the population."""
    stats = {c: [F.skewness(I.ref(c)), F.kurtosis(I.ref(c))] for c in I.numbers(df)}
    return _long(df, stats, ["skewness", "kurtosis"])


for _name, _f in {
    "types": types, "shape": shape, "info": info, "describe": describe, "columns": columns, "index": index, "head": head, "tail": tail,
    "sample": sample, "trend_analysis": trend, "correlation": correlation, "skewness_kurtosis": shape_of_distribution,
}.items():
    register(_name, _f)


def seasonality(df: DataFrame, time: str, value: str) -> DataFrame:
    """(month, n, mean) over all years."""
    return df.groupBy(F.month(I.ref(time)).alias("month")).agg(F.count(I.ref(value)).alias("n"), F.avg(I.ref(value)).alias("mean"))


def moving(df: DataFrame, by: list[str], order: str, value: str, rows: int = 3) -> DataFrame:
    """moving_average and volatility (sample deviation) of the last ``rows`` values of a group, or of all rows where ``by`` is empty."""
    x = I.ref(value)

    def new(w):
        w = w.rowsBetween(1 - rows, 0)
        return {"moving_average": F.avg(x).over(w), "volatility": F.stddev_samp(x).over(w)}

    return looked_back(df, by, order, rows - 1, new)


def lags(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """lag, diff, growth (share of the value before) and momentum (change of diff) inside a group, or over all rows where ``by`` is empty."""
    x = I.ref(value)

    def new(w):
        before, earlier = F.lag(x, 1).over(w), F.lag(x, 2).over(w)
        return {"lag": before, "diff": x - before, "growth": F.try_divide(x - before, before), "momentum": x - 2 * before + earlier}

    return looked_back(df, by, order, 2, new)


def group_statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    x = I.ref(value)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def anomaly_scores(df: DataFrame, value: str) -> DataFrame:
    """z_score, by one aggregation; null where the deviation is 0."""
    x = I.ref(value)
    row = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).head()
    return df.withColumn("z_score", (x - F.lit(row["m"])) / F.lit(row["s"]) if row["s"] else F.lit(None).cast("double"))


def threshold_violations(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(column, below, above): how many values of each column lie outside its bounds."""
    counts = {
        c: [F.count_if(I.ref(c) < F.lit(low)) if low is not None else F.lit(0).cast("long"), F.count_if(I.ref(c) > F.lit(high)) if high is not None else F.lit(0).cast("long")]
        for c, (low, high) in bounds.items()
    }
    return _long(df, counts, ["below", "above"])


def information_content(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, entropy in bits) of text columns, from counts by value."""
    names = I.strings(df) if columns is None else columns
    long = df.select(*(I.ref(c).cast("string").alias(c) for c in names)).unpivot([], names, "column", "v").where("v IS NOT NULL")
    counts = long.groupBy("column", "v").agg(F.count("*").alias("k"))
    total = F.sum("k")
    return counts.groupBy("column").agg((F.log2(total.cast("double")) - F.sum(F.col("k") * F.log2(F.col("k").cast("double"))) / total).alias("entropy"))


def variance(df: DataFrame) -> DataFrame:
    """(column, variance) of number columns."""
    return _long(df, {c: [F.var_samp(I.ref(c))] for c in I.numbers(df)}, ["variance"])


def cohorts(df: DataFrame, member: str, time: str) -> DataFrame:
    """(cohort, age, members): members by the month they first appear, and months since."""
    month = F.date_trunc("month", I.ref(time))
    first = df.groupBy(member).agg(F.min(month).alias("cohort"))
    seen = df.select(member, month.alias("m")).distinct().join(first, member)
    age = (F.year("m") - F.year("cohort")) * 12 + F.month("m") - F.month("cohort")
    return seen.groupBy("cohort", age.alias("age")).agg(F.count("*").alias("members"))


for _name, _f in {
    "seasonality": seasonality, "moving_averages": moving, "lag_features": lags, "group_statistics": group_statistics, "anomaly_scores": anomaly_scores,
    "threshold_violations": threshold_violations, "information_content": information_content, "feature_variance": variance, "cohort_analysis": cohorts,
    "change_points": change_points, "risk_metrics": risk_metrics, "causality": causality, "multicollinearity": multicollinearity,
    "interaction_effects": interaction_effects, "feature_selection": feature_selection, "normality_test": normality_test, "distribution_type": distribution_type,
    "customer_segments": customer_segments, "isolation_forest": isolation_scores, "population_splits": population_splits,
}.items():
    register(_name, _f)

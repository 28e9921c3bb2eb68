"""Analyzers of rows in an order: change points, risk, causality. No task holds a whole series.

Rows with a null or NaN in a column that is asked for are left out. Ties of the order are
broken by a hash of the columns that are asked for, so equal keys give a defined result
only where the values beside them are equal too; name enough columns.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.functions.inference import ref
from cleanloom.functions.special import f_tail
from cleanloom.operators.ordered import ordered, within
from cleanloom.operators.regression import sufficient
from cleanloom.operators.steps import quantiles
from cleanloom.plans import tables


def _keys(order: str | list[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that have a value, and not NaN, in all of the columns."""
    kinds = dict(df.dtypes)
    tests = [F.nanvl(ref(c), F.lit(None)).isNotNull() if kinds[c] in ("double", "float") else ref(c).isNotNull() for c in columns]
    return df.where(reduce(Column.__and__, tests, F.lit(True)))


def _gain(s: Column, k: Column, low: int, high: int, a: float, b: float) -> Column:
    """How much the squares about the means fall if rows low + 1 to high are cut after row k."""
    left, right, all_ = s - F.lit(a), F.lit(b) - s, b - a
    return left * left / (k - low) + right * right / (high - k) - F.lit(all_ * all_ / (high - low))


def change_points(df: DataFrame, order: str | list[str], value: str, most: int = 5, penalty: float = 2.0) -> DataFrame:
    """(place, until, gain, mean_before, mean_after): where the mean of a series shifts, by binary segmentation.

    The cut that reduces the squares about the segments' means most is made first, then the
    best of the two parts and so on, ``most`` times at most, or until a gain is no more than
    ``penalty`` times ln(n) times the variance. ``place`` is that of the first row after a
    cut, counted from 0, ``until`` the (first) order column of the row before it. Of equal
    gains the first place counts. Each cut costs one pass over the table of running sums, in
    which a task passes on its best row.
    """
    keys = _keys(order)
    given = filled(df.select(*dict.fromkeys([*keys, value])), [value])
    o = ordered(given, keys)
    kind = dict(df.dtypes)
    schema = f"place long, until {kind[keys[0]]}, gain double, mean_before double, mean_after double"
    n = o.n
    if n < 2:
        o.release()
        return df.sparkSession.createDataFrame([], schema)
    sums = o.running({"_s": ref(value), "_q": ref(value).cast("double") * ref(value).cast("double")})
    table, path = tables.written(sums.select(ref(keys[0]).alias("until"), (F.col("_place") + 1).alias("k"), F.col("_s").cast("double").alias("s"), F.col("_q").alias("q")), "sums")
    o.release()
    last = table.where(F.col("k") == n).head()
    floor = penalty * math.log(n) * max(0.0, last["q"] / n - (last["s"] / n) ** 2)
    waiting, best, cuts = [(0, n, 0.0, float(last["s"]))], {}, []
    segments = list(waiting)
    while len(cuts) < most:
        asked = [seg for seg in waiting if seg[1] - seg[0] > 1]
        if asked:
            tests = [
                F.max(F.when((F.col("k") > low) & (F.col("k") < high), F.struct(_gain(F.col("s"), F.col("k"), low, high, a, b).alias("gain"), (-F.col("k")).alias("less"), "s", "until"))).alias(f"b{i}")
                for i, (low, high, a, b) in enumerate(asked)
            ]
            best |= dict(zip(asked, table.agg(*tests).head(), strict=True))
        if not best:
            break
        seg = max(best, key=lambda x: (best[x]["gain"], best[x]["less"]))
        found = best.pop(seg)
        if found["gain"] <= floor:
            break
        low, high, a, b = seg
        k = -found["less"]
        cuts.append((k, found["until"], found["gain"]))
        waiting = [(low, k, a, found["s"]), (k, high, found["s"], b)]
        segments = [x for x in segments if x != seg] + waiting
    tables.remove(df.sparkSession, path)
    mean = {end: ((b - a) / (high - low)) for low, high, a, b in segments for end in (("after", low), ("before", high))}
    rows = [(k, until, gain, mean["before", k], mean["after", k]) for k, until, gain in sorted(cuts)]
    return df.sparkSession.createDataFrame(rows, schema)


def risk_metrics(df: DataFrame, order: str | list[str], value: str, share: float = 0.05, risk_free: float = 0.0, periods: float = 1.0) -> DataFrame:
    """One row of risk of a series of levels such as prices: n, mean_return, volatility, sharpe, value_at_risk, expected_shortfall, max_drawdown.

    Returns are the changes from row to row as shares of the row before (none after a level
    of 0). Sharpe's ratio is of returns over ``risk_free``, times the root of ``periods``;
    value at risk the loss at the quantile ``share`` of the returns, expected shortfall the
    mean loss from there on. The greatest drawdown is the worst fall from an earlier level,
    as a share of it: of each range its peak, its trough and its worst fall are known, and
    two neighbours merge, so a row for each range goes to the driver.
    """
    keys = _keys(order)
    given = filled(df.select(*dict.fromkeys([*keys, value])), [value])
    o = ordered(given.withColumn("_v", ref(value).cast("double")).select(*dict.fromkeys([*keys, "_v"])), keys)
    before = F.lag("_v").over(Window.partitionBy("_block").orderBy("_place"))
    returns = o.blocks(1).withColumn("_r", F.when(before != 0, F.col("_v") / before - 1)).where(~F.col("_again") & F.col("_r").isNotNull())
    table, path = tables.written(returns.select("_r"), "returns")
    low = quantiles(table, [F.col("_r")], [share])[0]
    r = F.col("_r")
    worst = F.avg(F.when(r <= low[0], r)) if low else F.lit(None).cast("double")
    stats = table.agg(F.count(r).alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), worst.alias("w")).head()
    tables.remove(df.sparkSession, path)
    peak = F.max("_v").over(within())
    fall = F.when(peak > 0, 1 - F.col("_v") / peak)
    ranges = o.table.withColumn("_fall", fall).groupBy("_range").agg(F.max("_v").alias("peak"), F.min("_v").alias("trough"), F.max("_fall").alias("fall"))
    top, drawdown = -math.inf, 0.0
    for x in sorted(ranges.collect()):  # a row for each range
        drawdown = max(drawdown, x["fall"] or 0.0, 1 - x["trough"] / top if top > 0 else 0.0)
        top = max(top, x["peak"])
    o.release()
    sharpe = (stats["m"] - risk_free) / stats["s"] * math.sqrt(periods) if stats["s"] else None
    row = (o.n, stats["m"], stats["s"], sharpe, -low[0] if low else None, None if stats["w"] is None else -stats["w"], drawdown if o.n else None)
    names = "mean_return double, volatility double, sharpe double, value_at_risk double, expected_shortfall double, max_drawdown double"
    return df.sparkSession.createDataFrame([row], f"n long, {names}")


def residual(gram: np.ndarray, at: list[int], target: int) -> float:
    """What is left of a target's squares after regression on the columns ``at``, of sums of products."""
    x, y = gram[np.ix_(at, at)], gram[at, target]
    return float(gram[target, target] - y @ np.linalg.lstsq(x, y, rcond=None)[0])


def causality(df: DataFrame, order: str | list[str], x: str, y: str, lags: int = 1) -> DataFrame:
    """(cause, effect, rows, f, p_value), both ways: whether the past of one series helps to foretell another beside its own (Granger's test).

    The last ``lags`` values of both series stand beside each row, those of the block before
    included. One aggregation gives the sums of products about the means; both nested
    regressions are solved on these, and F compares what they leave.
    """
    keys = _keys(order)
    both = filled(df.select(*dict.fromkeys([*keys, x, y])), [x, y])
    means = both.agg(F.avg(ref(x).cast("double")), F.avg(ref(y).cast("double"))).head()
    if means[0] is None:
        raise ValueError("no complete rows")
    centred = [(ref(c).cast("double") - F.lit(m)).alias(n) for c, m, n in ((x, means[0], "_x"), (y, means[1], "_y"))]
    o = ordered(both.select(*keys, *centred), keys)
    w = Window.partitionBy("_block").orderBy("_place")
    past = {f"{c}{k}": F.lag(c, k).over(w) for c in ("_x", "_y") for k in range(1, lags + 1)}
    rows = o.blocks(lags).withColumns(past).where(~F.col("_again"))
    names = [*past, "_x"]
    s = sufficient(rows, names, "_y")
    o.release()
    gram = np.block([[s.xx, s.xy[:, None]], [s.xy[None, :], np.array([[s.yy]])]])
    of_x, of_y = [1 + k for k in range(lags)], [1 + lags + k for k in range(lags)]
    free, out = s.n - 2 * lags - 1, []
    for cause, effect, own, other, target in ((x, y, of_y, of_x, len(names) + 1), (y, x, of_x, of_y, len(names))):
        less, more = residual(gram, [0, *own], target), residual(gram, [0, *own, *other], target)
        f = (less - more) / lags / (more / free) if free > 0 and more > 0 else None
        out.append((cause, effect, s.n, f, None if f is None else f_tail(f, lags, free)))
    return df.sparkSession.createDataFrame(out, "cause string, effect string, rows long, f double, p_value double")

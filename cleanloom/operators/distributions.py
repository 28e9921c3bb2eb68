"""Analyzers of how values are distributed: tests of normality, and the family that fits best."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.functions import inference as I
from cleanloom.functions.special import log_tail_sql
from cleanloom.operators.ordered import ordered
from cleanloom.operators.steps import as_number

#: Of the normal family, p by the modified statistic: from, to, and the coefficients in it (fixed values, published with the test).
NORMAL_P = [(0.6, math.inf, 1.2937, -5.709, 0.0186), (0.34, 0.6, 0.9177, -4.279, -1.38), (0.2, 0.34, -8.318, 42.796, -59.938), (-math.inf, 0.2, -13.436, 101.14, -223.73)]
#: From here on the first of these rises again.
FAR = 150.0


def log_below_sql(z: str) -> str:
    """SQL for the logarithm of the normal probability below z."""
    return f"(CASE WHEN ({z}) < 0 THEN {log_tail_sql(f'(-({z}))')} ELSE ln(1e0 - exp({log_tail_sql(f'abs({z})')})) END)"


def normal_p(a: float) -> float:
    """The probability of a modified Anderson-Darling statistic this great, mean and deviation being estimated."""
    low, _, *c = next(row for row in NORMAL_P if row[0] <= a < row[1])
    a = min(a, FAR)
    p = math.exp(c[0] + c[1] * a + c[2] * a * a)
    return p if low >= 0.34 else 1 - p


def normality_test(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, anderson_darling, ad_p_value, jarque_bera, jb_p_value) of number columns, against the fitted normal; nulls and NaN are left out.

    Anderson and Darling's statistic needs every value's rank. Values are counted first, so
    that equal ones are one row; these are put in order by ranges, all columns at once, and
    running sums of the counts give the ranks. Null for a column without spread.
    """
    names = I.numbers(df) if columns is None else columns
    schema = "column string, n long, anderson_darling double, ad_p_value double, jarque_bera double, jb_p_value double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    table = df.select(*(as_number(df, c).alias(f"x{k}") for k, c in enumerate(names)))
    stats = table.agg(*(F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_samp(c).alias("s"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurt")).alias(c) for c in table.columns)).head()
    spread = [k for k in range(len(names)) if stats[k]["n"] > 1 and stats[k]["s"]]
    found: dict[int, float] = {}
    if spread:
        each = F.array(*(F.struct(F.lit(k).alias("c"), F.col(f"x{k}").alias("v")) for k in spread))
        o = ordered(table.select(F.inline(each)).where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("k")), ["c", "v"])
        ranks = o.running({"upto": F.col("k")})
        before = dict(zip(spread, [0, *(sum(stats[j]["n"] for j in spread[:i]) for i in range(1, len(spread)))], strict=True))
        of = lambda values: F.create_map(*(F.lit(x) for k in spread for x in (k, values(k))))[F.col("c")]
        n = of(lambda k: float(stats[k]["n"]))
        last = F.col("upto").cast("double") - of(lambda k: float(before[k]))
        terms = ranks.select("c", n.alias("n"), last.alias("last"), (last - F.col("k")).alias("first"), ((F.col("v") - of(lambda k: stats[k]["m"])) / of(lambda k: stats[k]["s"])).alias("z"))
        # the sums of 2i - 1 over the ranks i of a value, from below and from above
        below, above = "(last * last - first * first)", "((n - first) * (n - first) - (n - last) * (n - last))"
        sums = terms.groupBy("c").agg(F.sum(F.expr(f"{below} * {log_below_sql('z')} + {above} * {log_below_sql('(-z)')}")).alias("s"))
        found = {r["c"]: -stats[r["c"]]["n"] - r["s"] / stats[r["c"]]["n"] for r in sums.collect()}  # a row for each column
        o.release()
    rows = []
    for k, c in enumerate(names):
        n, a = stats[k]["n"], found.get(k)
        jb = None if a is None else n / 6 * (stats[k]["skew"] ** 2 + stats[k]["kurt"] ** 2 / 4)
        p = None if a is None else normal_p(a * (1 + 0.75 / n + 2.25 / (n * n)))
        rows.append((c, n, a, p, jb, None if jb is None else math.exp(-jb / 2)))
    return df.sparkSession.createDataFrame(rows, schema)


def _fits(n: int, mean: float, var: float, low: float, high: float, logs: float | None, log_var: float | None) -> dict[str, tuple[float, float | None, float]]:
    """(first parameter, second, log-likelihood) of each family that the values can come from."""
    out: dict[str, tuple[float, float | None, float]] = {}
    if var > 0:
        out["normal"] = (mean, math.sqrt(var), -n / 2 * (math.log(2 * math.pi * var) + 1))
        out["uniform"] = (low, high, -n * math.log(high - low))
    if low >= 0 and mean > 0:
        out["exponential"] = (1 / mean, None, -n * (math.log(mean) + 1))
    if low > 0 and var > 0 and log_var:
        out["lognormal"] = (logs, math.sqrt(log_var), -n / 2 * (math.log(2 * math.pi * log_var) + 1) - n * logs)
        s = math.log(mean) - logs
        if s > 0:
            shape = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
            scale = mean / shape
            out["gamma"] = (shape, scale, n * ((shape - 1) * logs - mean / scale - shape * math.log(scale) - math.lgamma(shape)))
    return out


def distribution_type(df: DataFrame, columns: list[str] | None = None, criterion: str = "bic") -> DataFrame:
    """(column, family, first, second, log_likelihood, aic, bic, best) of number columns: normal, uniform, exponential, lognormal and gamma.

    All families are fitted by maximum likelihood on the same few sums of one aggregation
    (the gamma's shape by the closed approximation to it), those only that can give every
    value: exponential no negative ones, lognormal and gamma positive ones. ``best`` has the least
    ``criterion``, aic or bic, of equals the first named here. Parameters are mean and
    deviation, ends, rate, mean and deviation of logarithms, shape and scale. Nulls and NaN are left out;
    columns without values or spread have no row but what fits them.
    """
    if criterion not in ("aic", "bic"):
        raise ValueError("the criterion is aic or bic")
    names = I.numbers(df) if columns is None else columns
    schema = "column string, family string, first double, second double, log_likelihood double, aic double, bic double, best boolean"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    table = df.select(*(as_number(df, c).alias(f"x{k}") for k, c in enumerate(names)))
    log = lambda c: F.ln(F.when(F.col(c) > 0, F.col(c)))
    row = table.agg(*(F.struct(F.count(c), F.avg(c), F.var_pop(c), F.min(c), F.max(c), F.avg(log(c)), F.var_pop(log(c))).alias(c) for c in table.columns)).head()
    rows = []
    for c, stats in zip(names, row, strict=True):
        if not stats[0]:
            continue
        n, fits = stats[0], _fits(*stats)
        scored = {}
        for family, (first, second, ll) in fits.items():
            free = 1 if second is None else 2
            scored[family] = (first, second, ll, 2 * free - 2 * ll, free * math.log(n) - 2 * ll)
        at = 3 if criterion == "aic" else 4
        best = min(scored, key=lambda f: scored[f][at], default=None)
        rows += [(c, family, *map(lambda v: None if v is None else float(v), x), family == best) for family, x in scored.items()]
    return df.sparkSession.createDataFrame(rows, schema)

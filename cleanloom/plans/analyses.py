"""Registered queries of the analyzers that put rows in order, relate columns or divide populations, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.functions import inference as I
from cleanloom.operators import analyzers, distributions, segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.selectExpr(*columns) if columns else df


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {c for c, k in df.dtypes if k == "double"}
    return df.select(*(F.round(I.ref(c), digits).alias(c) if c in doubles else I.ref(c) for c in df.columns))


# a shift of level for some months, in SQL that both engines read
_SHIFTED = "CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN year(o_orderdate) = 1997 THEN 20000000 WHEN year(o_orderdate) > 1999 THEN 9000000 ELSE 0 END"


def _segmentation(rows: str, most: int, penalty: float) -> str:
    """Binary segmentation of ``rows`` (k from 1, until, s): a common table for each cut."""
    floor = f"(SELECT {penalty} * ln(count(*)) * var_pop(v) FROM p)"
    parts = [f"p AS ({rows})", "g0 AS (SELECT 0 AS low, max(k) AS high, CAST(0 AS DOUBLE) AS a, CAST(max_by(s, k) AS DOUBLE) AS b FROM p)"]
    for r in range(most):
        parts.append(
            f"c{r} AS (SELECT * FROM (SELECT low, high, a, b, k, CAST(s AS DOUBLE) AS s, until, (s - a) * (s - a) / (k - low) + (b - s) * (b - s) / (high - k) - (b - a) * (b - a) / (high - low) AS gain "
            f"FROM g{r} JOIN (SELECT k, until, CAST(s AS DOUBLE) AS s FROM p) ON k > low AND k < high ORDER BY gain DESC, k LIMIT 1) WHERE gain > {floor})"
        )
        parts.append(f"g{r + 1} AS (SELECT low, high, a, b FROM g{r} WHERE low NOT IN (SELECT low FROM c{r}) UNION ALL SELECT low, k, a, s FROM c{r} UNION ALL SELECT k, high, s, b FROM c{r})")
    cuts = " UNION ALL ".join(f"SELECT k, until, gain FROM c{r}" for r in range(most))
    return (
        f"WITH {', '.join(parts)}, made AS ({cuts}) "
        f"SELECT CAST(c.k AS BIGINT) AS place, CAST(c.until AS VARCHAR) AS until, round(c.gain / 1e15, 4) AS gain, round(((x.b - x.a) / (x.high - x.low)) / 100, 2) AS mean_before, "
        f"round(((y.b - y.a) / (y.high - y.low)) / 100, 2) AS mean_after FROM made c JOIN g{most} x ON x.high = c.k JOIN g{most} y ON y.low = c.k"
    )


def _cuts(found: DataFrame) -> DataFrame:
    means = [F.round(F.col(c) / 100, 2).alias(c) for c in ("mean_before", "mean_after")]
    return found.select("place", F.col("until").cast("string").alias("until"), F.round(F.col("gain") / 1e15, 4).alias("gain"), *means)


_DAYS = f"SELECT CAST(o_orderdate AS DATE) AS until, sum({_SHIFTED}) AS v FROM orders GROUP BY 1"


@_query("analyze_change_points", _segmentation(f"SELECT row_number() OVER (ORDER BY until) AS k, until, v, sum(v) OVER (ORDER BY until) AS s FROM ({_DAYS})", 3, 2.0))
def _(spark, d):
    days = _table(spark, d, "orders", "CAST(o_orderdate AS DATE) AS day", f"{_SHIFTED} AS v").groupBy("day").agg(F.sum("v").alias("v"))
    return _cuts(analyzers.analyze("change_points", days, order="day", value="v", most=3))


_LINES = "SELECT o_orderkey, o_orderdate AS until, {} AS v FROM orders".format(_SHIFTED)


@_query("analyze_change_points_of_rows", _segmentation(f"SELECT row_number() OVER w AS k, CAST(until AS DATE) AS until, v, sum(v) OVER w AS s FROM ({_LINES}) WINDOW w AS (ORDER BY until, o_orderkey ROWS UNBOUNDED PRECEDING)", 4, 2.0))
def _(spark, d):
    rows = _table(spark, d, "orders", "CAST(o_orderdate AS DATE) AS day", "o_orderkey", f"{_SHIFTED} AS v")
    return _cuts(analyzers.analyze("change_points", rows, order=["day", "o_orderkey"], value="v", most=4))


@_query(
    "analyze_risk_metrics",
    """
WITH v AS (SELECT o_totalprice AS v, row_number() OVER w AS k, lag(o_totalprice) OVER w AS b, max(o_totalprice) OVER w AS peak FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)),
r AS (SELECT v / b - 1 AS r FROM v WHERE b <> 0), q AS (SELECT quantile_cont(r, 0.05) AS q FROM r)
SELECT CAST((SELECT count(*) FROM v) AS BIGINT) AS n, round(avg(r), 6) AS mean_return, round(stddev_samp(r), 6) AS volatility, round((avg(r) - 0.01) / stddev_samp(r) * sqrt(252), 6) AS sharpe,
  round(-any_value(q), 6) AS value_at_risk, round(-avg(r) FILTER (WHERE r <= q), 6) AS expected_shortfall, round((SELECT max(1 - v / peak) FROM v), 6) AS max_drawdown
FROM r, q""",
)
def _(spark, d):
    rows = _table(spark, d, "orders", "o_orderdate", "o_orderkey", "o_totalprice")
    return _rounded(analyzers.analyze("risk_metrics", rows, order=["o_orderdate", "o_orderkey"], value="o_totalprice", risk_free=0.01, periods=252))


def _granger(x: str, y: str, cause: str, effect: str) -> str:
    """F with one lag, by covariances of what is left after each regressor."""
    less = f"(var_pop({y}) - covar_pop({y}, {y}1) * covar_pop({y}, {y}1) / var_pop({y}1))"
    own = f"(var_pop({x}1) - covar_pop({x}1, {y}1) * covar_pop({x}1, {y}1) / var_pop({y}1))"
    both = f"(covar_pop({x}1, {y}) - covar_pop({x}1, {y}1) * covar_pop({y}, {y}1) / var_pop({y}1))"
    gain = f"({both} * {both} / {own})"
    return f"SELECT '{cause}' AS cause, '{effect}' AS effect, CAST(count(*) AS BIGINT) AS rows, round({gain} / (({less} - {gain}) / (count(*) - 3)), 6) AS f FROM t WHERE x1 IS NOT NULL"


_CAUSE_DAYS = "SELECT CAST(o_orderdate AS DATE) AS d, CAST(count(*) AS DOUBLE) AS n, sum(CAST(round(o_totalprice) AS BIGINT)) / 1000000.0 AS total FROM orders GROUP BY 1"


@_query("analyze_causality", f"WITH t AS (SELECT n AS x, CAST(total AS DOUBLE) AS y, lag(n) OVER (ORDER BY d) AS x1, lag(CAST(total AS DOUBLE)) OVER (ORDER BY d) AS y1 FROM ({_CAUSE_DAYS})) {_granger('x', 'y', 'n', 'total')} UNION ALL {_granger('y', 'x', 'total', 'n')}")
def _(spark, d):
    rows = _table(spark, d, "orders", "CAST(o_orderdate AS DATE) AS d", "CAST(round(o_totalprice) AS BIGINT) AS v")
    days = rows.groupBy("d").agg(F.count("*").cast("double").alias("n"), (F.sum("v") / F.lit(1e6)).alias("total"))
    return _rounded(analyzers.analyze("causality", days, order="d", x="n", y="total").drop("p_value"))


_INFLATED = "l_quantity AS q, l_extendedprice AS p, l_discount AS d, 2 * l_quantity + 1 AS twice, 7.5 AS one"


@_query(
    "analyze_multicollinearity",
    """
WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS x, corr(l_quantity, l_discount) AS y, corr(l_extendedprice, l_discount) AS z FROM lineitem),
t AS (SELECT unnest(['q', 'p', 'd']) AS "column", unnest([1 - (x*x + y*y - 2*x*y*z) / (1 - z*z), 1 - (x*x + z*z - 2*x*y*z) / (1 - y*y), 1 - (y*y + z*z - 2*x*y*z) / (1 - x*x)]) AS tolerance FROM r),
e AS (SELECT sqrt((x*x + y*y + z*z) / 3) AS h, x*y*z / pow(sqrt((x*x + y*y + z*z) / 3), 3) AS c FROM r),
k AS (SELECT sqrt((1 + 2 * h * cos(acos(c) / 3)) / (1 + 2 * h * cos(acos(c) / 3 + 2 * pi() / 3))) AS condition FROM e)
SELECT "column", round(1 / tolerance, 6) AS vif, round(tolerance, 6) AS tolerance, false AS singular, round(condition, 6) AS condition FROM t, k
UNION ALL SELECT unnest(['twice', 'one']), NULL, NULL, true, round(condition, 6) FROM k""",
)
def _(spark, d):
    return _rounded(analyzers.analyze("multicollinearity", _table(spark, d, "lineitem", *_INFLATED.split(", "))))


@_query(
    "analyze_interaction_effects",
    """
WITH m AS (SELECT avg(l_quantity) AS mq, avg(l_discount) AS md FROM lineitem),
t AS (SELECT l_quantity - mq AS a, l_discount - md AS b, (l_quantity - mq) * (l_discount - md) AS c, l_extendedprice * (1 - l_discount) AS y FROM lineitem, m),
v AS (SELECT count(*) AS n, var_pop(a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(a, y) AS ay, var_pop(b) AS bb, covar_pop(b, c) AS bc, covar_pop(b, y) AS bvy, var_pop(c) AS cc, covar_pop(c, y) AS cy, var_pop(y) AS yy FROM t),
s AS (SELECT n, bb - ab*ab/aa AS bb, bc - ab*ac/aa AS bc, bvy - ab*ay/aa AS bvy, cc - ac*ac/aa AS cc, cy - ac*ay/aa AS cy, yy - ay*ay/aa AS yy FROM v),
u AS (SELECT n, cc - bc*bc/bb AS cc, cy - bc*bvy/bb AS cy, yy - bvy*bvy/bb AS yy FROM s)
SELECT 'l_quantity' AS "left", 'l_discount' AS "right", round(cy / cc, 4) AS effect, round(cy*cy/cc / ((yy - cy*cy/cc) / (n - 4)), 4) AS f FROM u""",
)
def _(spark, d):
    rows = _table(spark, d, "lineitem", "l_quantity", "l_discount", "l_extendedprice * (1 - l_discount) AS y")
    return _rounded(analyzers.analyze("interaction_effects", rows, features=["l_quantity", "l_discount"], target="y").drop("p_value"), 4)


_TOLD = [("priority", "o_orderpriority"), ("hint", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'none' END"), ("copied", "CASE WHEN o_orderkey % 6 = 0 THEN o_orderstatus WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'none' END")]


def _selection() -> str:
    names = [c for c, _ in _TOLD]
    parts = [f"t AS (SELECT {', '.join(f'coalesce({x}, chr(0)) AS {c}' for c, x in _TOLD)}, o_orderstatus AS y FROM orders)"]
    pairs = [(a, b) for k, a in enumerate([*names, "y"]) for b in [*names, "y"][k + 1 :]]
    for a, b in pairs:
        parts.append(
            f"m_{a}_{b} AS (SELECT sum(n * n * 1.0 / e) - any_value(total) AS chi, sum(n * log2(n / e)) / any_value(total) AS mi FROM (SELECT n, total, 1.0 * na * nb / total AS e FROM "
            f"(SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY 1, 2) JOIN (SELECT {a} AS a, CAST(count(*) AS DOUBLE) AS na FROM t GROUP BY 1) USING (a) "
            f"JOIN (SELECT {b} AS b, CAST(count(*) AS DOUBLE) AS nb FROM t GROUP BY 1) USING (b), (SELECT CAST(count(*) AS DOUBLE) AS total FROM t)))"
        )
    every = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, mi FROM m_{a}_{b} UNION ALL SELECT '{b}', '{a}', mi FROM m_{a}_{b}" for a, b in pairs)
    own = " UNION ALL ".join(f"SELECT {k} AS k, '{c}' AS feature, chi, mi FROM m_{c}_y" for k, c in enumerate(names))
    parts += [f"pairs AS ({every})", f"own AS ({own})", "r1 AS (SELECT k, feature, mi AS score, 1 AS rank FROM own ORDER BY mi DESC, k LIMIT 1)"]
    for r in range(2, len(names) + 1):
        chosen = " UNION ALL ".join(f"SELECT * FROM r{j}" for j in range(1, r))
        parts.append(
            f"r{r} AS (SELECT k, feature, any_value(own.mi) - avg(pairs.mi) AS score, {r} AS rank FROM own, pairs WHERE pairs.a = feature AND pairs.b IN (SELECT feature FROM ({chosen})) "
            f"AND feature NOT IN (SELECT feature FROM ({chosen})) GROUP BY k, feature ORDER BY score DESC, k LIMIT 1)"
        )
    ranks = " UNION ALL ".join(f"SELECT * FROM r{j}" for j in range(1, len(names) + 1))
    return f"WITH {', '.join(parts)} SELECT feature, round(chi, 4) AS chi_square, round(mi, 6) AS mutual_information, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM own JOIN (SELECT feature, rank, score FROM ({ranks})) USING (feature)"


@_query("analyze_feature_selection", _selection())
def _(spark, d):
    rows = _table(spark, d, "orders", *(f"{x} AS {c}" for c, x in _TOLD), "o_orderstatus AS y")
    found = analyzers.analyze("feature_selection", rows, features=[c for c, _ in _TOLD], target="y")
    return found.select("feature", F.round("chi_square", 4).alias("chi_square"), F.round("mutual_information", 6).alias("mutual_information"), "rank", F.round("score", 6).alias("score"))


def _normality(column: str) -> str:
    below, above = distributions.log_below_sql("z"), distributions.log_below_sql("(-z)")
    return (
        f"""SELECT '{column}' AS "column", CAST(count(*) AS BIGINT) AS n, round(-count(*) - sum((2.0 * i - 1) * {below} + (2.0 * (n - i) + 1) * {above}) / count(*), 4) AS anderson_darling, """
        f"round(count(*) / 6.0 * (pow(avg(d * d * d) / pow(avg(d * d), 1.5), 2) + pow(avg(d * d * d * d) / pow(avg(d * d), 2) - 3, 2) / 4), 4) AS jarque_bera FROM "
        f"(SELECT row_number() OVER (ORDER BY {column}) AS i, n, {column} - m AS d, ({column} - m) / s AS z FROM lineitem, (SELECT count({column}) AS n, avg({column}) AS m, stddev_samp({column}) AS s FROM lineitem) WHERE {column} IS NOT NULL)"
    )


@_query("analyze_normality", " UNION ALL ".join(_normality(c) for c in ("l_quantity", "l_extendedprice")))
def _(spark, d):
    found = analyzers.analyze("normality_test", _table(spark, d, "lineitem", "l_quantity", "l_extendedprice"))
    return _rounded(found.drop("ad_p_value", "jb_p_value"), 4)


_FAMILIES = """
WITH t AS (SELECT unnest(['value', 'squared']) AS "column", unnest([value, value * value + 0.1]) AS v FROM events),
s AS (SELECT "column", CAST(count(*) AS DOUBLE) AS n, avg(v) AS m, var_pop(v) AS s2, min(v) AS low, max(v) AS high, avg(ln(CASE WHEN v > 0 THEN v END)) AS lm, var_pop(ln(CASE WHEN v > 0 THEN v END)) AS l2 FROM t GROUP BY 1),
g AS (SELECT *, ln(m) - lm AS u FROM s), h AS (SELECT *, (3 - u + sqrt((u - 3) * (u - 3) + 24 * u)) / (12 * u) AS shape FROM g),
f AS (
  SELECT "column", n, 0 AS o, 'normal' AS family, m AS first, sqrt(s2) AS second, -n / 2 * (ln(2 * pi() * s2) + 1) AS ll FROM s WHERE s2 > 0
  UNION ALL SELECT "column", n, 1, 'uniform', low, high, -n * ln(high - low) FROM s WHERE s2 > 0
  UNION ALL SELECT "column", n, 2, 'exponential', 1 / m, NULL, -n * (ln(m) + 1) FROM s WHERE low >= 0 AND m > 0
  UNION ALL SELECT "column", n, 3, 'lognormal', lm, sqrt(l2), -n / 2 * (ln(2 * pi() * l2) + 1) - n * lm FROM s WHERE low > 0 AND l2 > 0
  UNION ALL SELECT "column", n, 4, 'gamma', shape, m / shape, n * ((shape - 1) * lm - shape - shape * ln(m / shape) - lgamma(shape)) FROM h WHERE low > 0 AND l2 > 0 AND u > 0
), c AS (SELECT *, 2 * (CASE WHEN second IS NULL THEN 1 ELSE 2 END) - 2 * ll AS aic, ln(n) * (CASE WHEN second IS NULL THEN 1 ELSE 2 END) - 2 * ll AS bic FROM f)
SELECT "column", family, round(first, 4) AS first, round(second, 4) AS second, round(ll, 2) AS log_likelihood, round(aic, 2) AS aic, round(bic, 2) AS bic, row_number() OVER (PARTITION BY "column" ORDER BY bic, o) = 1 AS best FROM c"""


@_query("analyze_distribution_type", _FAMILIES)
def _(spark, d):
    found = analyzers.analyze("distribution_type", _table(spark, d, "events", "value", "value * value + 0.1 AS squared"))
    sums = [F.round(c, 2).alias(c) for c in ("log_likelihood", "aic", "bic")]
    return found.select("column", "family", F.round("first", 4).alias("first"), F.round("second", 4).alias("second"), *sums, "best")


_RFM = """
WITH g AS (SELECT o_custkey, max(o_orderdate) AS last, count(*) AS frequency, sum(CAST(round(o_totalprice) AS BIGINT)) AS monetary FROM orders GROUP BY 1),
rfm AS (SELECT *, CAST((row_number() OVER (ORDER BY last, o_custkey) - 1) * 5 // (SELECT count(*) FROM g) + 1 AS INTEGER) AS r, CAST((row_number() OVER (ORDER BY frequency, o_custkey) - 1) * 5 // (SELECT count(*) FROM g) + 1 AS INTEGER) AS f,
  CAST((row_number() OVER (ORDER BY monetary, o_custkey) - 1) * 5 // (SELECT count(*) FROM g) + 1 AS INTEGER) AS m FROM g)"""


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders", "o_custkey", "o_orderdate", "CAST(round(o_totalprice) AS BIGINT) AS price")


@_query("analyze_rfm", f"{_RFM} SELECT o_custkey, CAST(frequency AS BIGINT) AS frequency, CAST(monetary AS DOUBLE) AS monetary, r, f, m FROM rfm")
def _(spark, d):
    return segments.rfm(_orders(spark, d), "o_custkey", "o_orderdate", "price").drop("last")


_CENTRES = [[1.0, 1.0, 1.0], [3.0, 2.0, 4.0], [5.0, 5.0, 5.0]]


def _clusters(rounds: int) -> str:
    """Lloyd's rounds, a common table for each; of equal distances the first centre."""
    parts = [f"c0 AS ({' UNION ALL '.join(f'SELECT {j} AS j, {x} AS x, {y} AS y, {z} AS z' for j, (x, y, z) in enumerate(_CENTRES))})"]
    for k in range(rounds + 1):
        distance = "((r - x) * (r - x) + (f - y) * (f - y)) + (m - z) * (m - z)"
        parts.append(f"a{k} AS (SELECT o_custkey, r, f, m, j FROM (SELECT o_custkey, r, f, m, j, row_number() OVER (PARTITION BY o_custkey ORDER BY {distance}, j) AS n FROM rfm, c{k}) WHERE n = 1)")
        if k < rounds:
            parts.append(f"c{k + 1} AS (SELECT c.j, coalesce(avg(r), any_value(x)) AS x, coalesce(avg(f), any_value(y)) AS y, coalesce(avg(m), any_value(z)) AS z FROM c{k} c LEFT JOIN a{k} a ON a.j = c.j GROUP BY c.j)")
    return f"{_RFM}, {', '.join(parts)} SELECT o_custkey, CAST(j AS INTEGER) AS cluster FROM a{rounds}"


@_query("analyze_k_means", _clusters(4))
def _(spark, d):
    scores = segments.rfm(_orders(spark, d), "o_custkey", "o_orderdate", "price")
    return segments.k_means(scores, ["r", "f", "m"], 3, rounds=4, centres=_CENTRES, tolerance=-1.0)[0].select("o_custkey", "cluster")


@_query("analyze_customer_segments", None)
def _(spark, d):
    return analyzers.analyze("customer_segments", _orders(spark, d), customer="o_custkey", time="o_orderdate", money="price").select("o_custkey", "r", "f", "m", "cluster")


@_query(
    "analyze_population_splits",
    """
WITH u AS (SELECT c_custkey, c_mktsegment, CAST('0x' || sha256('spring:' || CAST(c_custkey AS VARCHAR))[1:15] AS BIGINT) AS h FROM customer),
r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM u)
SELECT c_custkey, CASE WHEN i <= floor(n * 0.5 + 0.5) THEN 'control' WHEN i <= floor(n * 0.8 + 0.5) THEN 'test' ELSE 'rest' END AS arm FROM r""",
)
def _(spark, d):
    rows = _table(spark, d, "customer", "c_custkey", "c_mktsegment")
    return analyzers.analyze("population_splits", rows, key="c_custkey", shares={"control": 0.5, "test": 0.3, "rest": 0.2}, strata=["c_mktsegment"], salt="spring").select("c_custkey", "arm")


@_query("analyze_isolation_forest", None)
def _(spark, d):
    rows = _table(spark, d, "orders", "o_orderkey", "CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price", "CAST(dayofyear(o_orderdate) AS DOUBLE) AS day")
    return analyzers.analyze("isolation_forest", rows, columns=["price", "day"]).select("o_orderkey", "isolation_score")

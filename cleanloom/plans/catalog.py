"""Registered queries over the driver's tables, each with its SQL for DuckDB.

The tables have no nulls, so queries put dirt into them first, by the same rule on both sides.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom import cli
from cleanloom.functions import exprs as X
from cleanloom.functions import inference as I
from cleanloom.operators import analyzers, regression
from cleanloom.operators import steps as S
from cleanloom.plans import pipeline, report, tables
from cleanloom.sources import readers
from cleanloom.streaming import clean

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-06-30 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, given as SQL expressions."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.selectExpr(*columns) if columns else df


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    doubles = {c for c, k in df.dtypes if k == "double"}
    return df.select(*(F.round(I.ref(c), digits).alias(c) if c in doubles else I.ref(c) for c in df.columns))


# dirt, in SQL that both engines read
PRICE = "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50 ELSE o_totalprice END"
STATUS = "CASE o_orderkey % 6 WHEN 0 THEN 'unknown' WHEN 1 THEN ' N/A ' WHEN 2 THEN '-' WHEN 3 THEN NULL ELSE o_orderstatus END"
BOOL = "CASE o_orderkey % 7 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN '0' WHEN 4 THEN NULL WHEN 5 THEN 'TRUE' ELSE 'n' END"
AMOUNT = (
    "CASE c_custkey % 5 WHEN 0 THEN concat('$', CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR(20))) "
    "WHEN 1 THEN concat('€', CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR(20)), ',25') WHEN 2 THEN ' Thirty ' WHEN 3 THEN NULL "
    "ELSE CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR(20)) END"
)
AMOUNT_NUMBER = (
    "CASE c_custkey % 5 WHEN 0 THEN round(c_acctbal) WHEN 1 THEN CASE WHEN round(c_acctbal) < 0 THEN round(c_acctbal) - 0.25 "
    "WHEN round(c_acctbal) = 0 THEN 0.25 ELSE round(c_acctbal) + 0.25 END WHEN 2 THEN 30.0 WHEN 3 THEN NULL ELSE round(c_acctbal) END"
)


def _dates_spark() -> str:
    return (
        "CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy') "
        "WHEN 2 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 3 THEN date_format(o_orderdate, 'MMMM d yyyy') WHEN 4 THEN {bad} ELSE NULL END"
    )


def _dates_duck() -> str:
    return "CASE WHEN o_orderkey % 6 < 4 THEN date_trunc('day', o_orderdate) ELSE NULL END"


def _orders_dirty(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders", "o_orderkey", f"{PRICE} AS price")


_SPIKES = f"SELECT o_orderkey, {PRICE} AS price FROM orders"
_CLIP = """
q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM {src}),
c AS (SELECT {src}.*, CASE WHEN price IS NULL THEN NULL ELSE greatest(least(price, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)) END AS clip FROM {src}, q),
z AS (SELECT avg(clip) AS m, stddev_samp(clip) AS s FROM c)"""
_FLAGSHIP_SQL = f"""
WITH d AS (SELECT o_orderkey, {PRICE} AS raw FROM orders), m AS (SELECT quantile_cont(raw, 0.5) AS med FROM d),
f AS (SELECT o_orderkey, coalesce(raw, med) AS price FROM d, m), {_CLIP.format(src="f")},
r AS (SELECT CASE WHEN abs((clip - m) / s) <= 2.5 THEN clip END AS price FROM c, z)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(price) AS BIGINT) AS n_prices, round(sum(price), 2) AS total,
       round(avg(1 - (CASE WHEN price IS NULL THEN 1 ELSE 0 END) / 2.0), 6) AS quality FROM r
"""


@_query("clean_orders_summary", _FLAGSHIP_SQL)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    df = _orders_dirty(spark, d)
    for name, kw in (("handle_sentinel_values", {}), ("fix_numeric_columns", {"columns": ["price"]}), ("handle_outliers", {"columns": ["price"], "z_threshold": 2.5}), ("flag_data_quality", {})):
        df = S.create(name, **kw)(df)
    return df.agg(
        F.count("*").alias("n_rows"), F.count("price").alias("n_prices"), F.round(F.sum("price"), 2).alias("total"), F.round(F.avg("_quality_score"), 6).alias("quality")
    )


@_query("step_titles", 'SELECT n_nationkey AS nation_key, n_name AS "the_name_(short)", n_regionkey AS nation_key_1 FROM nation')
def _(spark, d):
    return S.Titles()(_table(spark, d, "nation", "n_nationkey AS ` Nation Key `", "n_name AS `The  Name (Short)`", "n_regionkey AS `nation key`"))


@_query("step_sentinels", f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def _(spark, d):
    df = _table(spark, d, "orders", "o_orderkey", f"{STATUS} AS status", "o_orderpriority AS priority")
    return S.Sentinels(extra_sentinels=["1-urgent"])(df)


@_query("step_normalize_categories", "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'nan' WHEN lower(trim(p_brand)) = 'brand#11' THEN 'eleven' WHEN lower(trim(p_brand)) = 'brand#12' THEN 'twelve' ELSE lower(trim(p_brand)) END AS brand FROM part")
def _(spark, d):
    df = _table(spark, d, "part", "p_partkey", "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE concat(' ', p_brand, ' ') END AS brand")
    return S.Categories({"brand": {"brand#11": "eleven", "brand#12": "twelve"}, "absent": {"a": "b"}})(df)


@_query("step_safe_conversion_num", f"SELECT c_custkey, CAST({AMOUNT_NUMBER} AS DOUBLE) AS amount FROM customer")
def _(spark, d):
    return S.SafeConversion(now=now())(_table(spark, d, "customer", "c_custkey", f"{AMOUNT} AS amount"))


@_query("step_safe_conversion_date", f"SELECT o_orderkey, CAST({_dates_duck()} AS TIMESTAMP) AS day FROM orders")
def _(spark, d):
    return S.SafeConversion(now=F.lit("2050-01-01").cast("timestamp_ntz"))(_table(spark, d, "orders", "o_orderkey", f"{_dates_spark().format(bad='NULL')} AS day"))


@_query("step_safe_conversion_mixed", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '850.0' WHEN 1 THEN 'n' || c_custkey WHEN 2 THEN '2024-03-05 00:00:00' ELSE NULL END AS cell FROM customer""")
def _(spark, d):
    cell = "CASE c_custkey % 4 WHEN 0 THEN '$850' WHEN 1 THEN concat('n', c_custkey) WHEN 2 THEN 'March 5 2024' ELSE NULL END AS cell"
    return S.SafeConversion(now=now())(_table(spark, d, "customer", "c_custkey", cell))


@_query("step_text_normalize", "SELECT p_partkey, regexp_replace(lower(trim(p_name)), '\\s+', '_', 'g') AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE lower(p_brand) END AS brand FROM part")
def _(spark, d):
    df = _table(spark, d, "part", "p_partkey", "concat('  ', p_name, ' ') AS name", "CASE WHEN p_partkey % 5 = 0 THEN ' NaN' ELSE p_brand END AS brand")
    return S.TextColumns()(df)


@_query("step_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return S.Duplicates()(S.with_row_id(_table(spark, d, "events", "user_id", "event_type"))).drop(S.ROW_ID)


@_query("step_domain_rules", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 OR l_quantity > 40 THEN NULL ELSE l_quantity END AS l_quantity, CASE WHEN l_tax > 0.05 THEN NULL ELSE l_tax END AS l_tax, l_returnflag FROM lineitem")
def _(spark, d):
    df = _table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag")
    return S.DomainRules({"l_quantity": [5, 40], "l_tax": [None, 0.05], "l_returnflag": [1, 2], "absent": [0]})(df)


def _fill(kind: str, stat: str) -> None:
    sql = f"WITH d AS (SELECT o_orderkey, {PRICE} AS price FROM orders) SELECT o_orderkey, round(coalesce(price, ({stat})), 4) AS price FROM d"

    @_query(f"step_fix_numeric_{kind}", sql)
    def _(spark, d):
        return _rounded(S.NumericColumns(kind, ["price"])(_orders_dirty(spark, d)))


_fill("mean", "SELECT avg(price) FROM d")
_fill("median", "SELECT quantile_cont(price, 0.5) FROM d")


@_query("step_fix_numeric_mode", "WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem) SELECT l_orderkey, l_linenumber, coalesce(q, (SELECT q FROM d WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1)) AS q FROM d")
def _(spark, d):
    df = _table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_quantity END AS q")
    return S.NumericColumns("mode", ["q"])(df)


@_query("step_fix_numeric_text", f"WITH d AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 2 THEN NULL ELSE CAST({AMOUNT_NUMBER} AS DOUBLE) END AS amount FROM customer) SELECT c_custkey, round(coalesce(amount, (SELECT avg(amount) FROM d)), 4) AS amount FROM d")
def _(spark, d):
    return _rounded(S.NumericColumns("mean", ["amount"])(_table(spark, d, "customer", "c_custkey", f"{AMOUNT} AS amount")))


@_query("step_outliers_iqr_z", f"WITH d AS ({_SPIKES}), {_CLIP.format(src='d')} SELECT o_orderkey, round(CASE WHEN abs((clip - m) / s) <= 2.0 THEN clip END, 4) AS price FROM c, z")
def _(spark, d):
    return _rounded(S.Outliers(["price"], z_threshold=2.0)(_orders_dirty(spark, d)))


@_query("step_bools", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (1, 3, 6) THEN false ELSE true END AS active FROM orders")
def _(spark, d):
    return S.Bools()(_table(spark, d, "orders", "o_orderkey", f"{BOOL} AS active"))


@_query("step_dates", f"SELECT o_orderkey, CAST({_dates_duck()} AS TIMESTAMP) AS day FROM orders")
def _(spark, d):
    bad = "CASE WHEN o_orderkey % 4 = 0 THEN '1850-01-01' WHEN o_orderkey % 4 = 2 THEN '2999-01-01' ELSE '2024-02-30' END"
    return S.Dates(["day"], now=F.lit("2050-01-01").cast("timestamp_ntz"))(_table(spark, d, "orders", "o_orderkey", f"{_dates_spark().format(bad=bad)} AS day"))


@_query("step_cross_column", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def _(spark, d):
    df = _table(spark, d, "orders", "o_orderkey", "o_orderstatus AS status", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority")
    return S.CrossColumns([{"if_col": "status", "equals": "F", "then_col": "priority", "action": "set_nan"}, {"if_col": "status", "equals": "O", "then_col": "priority", "action": "other"}])(df)


@_query("step_quality_score", "SELECT c_custkey, round(1 - ((CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END)) / 3.0, 6) AS _quality_score FROM customer")
def _(spark, d):
    df = _table(spark, d, "customer", "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS a", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS b")
    return _rounded(S.Quality()(df).select("c_custkey", "_quality_score"), 6)


@_query("step_types", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(o_totalprice) END AS price, o_orderkey % 3 <> 0 AS flag, true AS word, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day FROM orders")
def _(spark, d):
    df = _table(
        spark, d, "orders", "o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING) END AS price",
        "o_orderkey % 3 AS flag", "CASE WHEN o_orderkey % 2 = 0 THEN 'false' ELSE NULL END AS word", "date_format(o_orderdate, 'yyyy-MM-dd') AS day",
    )
    return S.Types(["price"], ["flag", "word"], ["day"])(df)


@_query("step_drop_high_missing", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_retailprice END AS half FROM part")
def _(spark, d):
    df = _table(spark, d, "part", "p_partkey", "p_name", "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_retailprice END AS half", "CASE WHEN p_partkey % 10 > 0 THEN NULL ELSE p_size END AS few", "CAST(NULL AS STRING) AS none")
    return S.HighMissing(0.8)(df)


@_query("step_drop_constant", "SELECT p_partkey, p_name FROM part")
def _(spark, d):
    return S.Constant()(_table(spark, d, "part", "p_partkey", "p_name", "'x' AS same", "CAST(NULL AS INT) AS none", "CASE WHEN p_partkey % 2 = 0 THEN 5 END AS five"))


@_query("step_text_standardization", "SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'), '[^\\w\\s\\-]', ' ', 'g'), '\\s+', ' ', 'g'))) AS text FROM documents")
def _(spark, d):
    return S.TextStandard(["text"])(_table(spark, d, "documents", "doc_id", "text"))


@_query("step_cap_outliers", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(least(l_extendedprice, hi), lo), 4) AS price FROM lineitem, q")
def _(spark, d):
    return _rounded(S.Caps(["price"])(_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice AS price")))


_SEGMENT = "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment"


@_query("step_impute_categorical_mode", f"WITH d AS (SELECT c_custkey, {_SEGMENT} FROM customer) SELECT c_custkey, coalesce(segment, (SELECT segment FROM d WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)) AS segment FROM d")
def _(spark, d):
    return S.Impute()(_table(spark, d, "customer", "c_custkey", _SEGMENT))


@_query("step_impute_categorical_fixed", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'missing' ELSE c_mktsegment END AS segment FROM customer")
def _(spark, d):
    return S.Impute(strategy="fixed", fill_value="missing")(_table(spark, d, "customer", "c_custkey", _SEGMENT))


@_query("step_enforce_schema", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return S.Schema(["r_name"], 5)(_table(spark, d, "region"))


@_query("step_audit", f"SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS _original_index, TIMESTAMP '{NOW}' AS _cleaned_at FROM nation")
def _(spark, d):
    return S.Audit(now=now())(_table(spark, d, "nation", "n_nationkey"))


@_query("infer_types", """SELECT * FROM (VALUES ('amount', true, false, false), ('code', true, false, false), ('flag', false, true, false), ('name', false, false, false), ('day', false, false, true)) AS t("column", "numeric", "boolean", "date")""")
def _(spark, d):
    df = _table(
        spark, d, "orders", "concat('-', CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING), '.5') AS amount", "CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_orderkey AS STRING) END AS code",
        f"{BOOL} AS flag", "o_orderpriority AS name", "date_format(o_orderdate, 'M/d/yyyy') AS day",
    )
    numeric, truth, dates = I.numeric_columns(df), I.bool_columns(df), I.date_columns(df, F.lit("2050-01-01").cast("timestamp_ntz"))
    return spark.createDataFrame([(c, c in numeric, c in truth, c in dates) for c in df.columns], "column string, numeric boolean, boolean boolean, date boolean")


@_query("infer_number_cells", f"SELECT c_custkey, CAST({AMOUNT_NUMBER} AS DOUBLE) AS amount FROM customer")
def _(spark, d):
    return _table(spark, d, "customer", "c_custkey", f"{AMOUNT} AS amount").withColumn("amount", X.number(F.col("amount")))


def _dirty_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with odd titles, sentinels, repeated rows' worth of nulls, truth words and dates as text."""
    return _table(
        spark, d, "orders", "o_orderkey AS `Order Key`", f"{PRICE} AS `Total Price`", f"{STATUS} AS Status", f"{BOOL} AS Active",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS Day", "'x' AS Same",
    )


def _preset(name: str, fill: str, impute: str | None, cap: float | None, z: float | None, active: str) -> None:
    status = "CASE WHEN o_orderkey % 6 < 4 THEN NULL ELSE lower(o_orderstatus) END"
    sql = f"""
WITH a AS (SELECT CAST(o_orderkey AS DOUBLE) AS order_key, {PRICE} AS total_price, {status} AS status,
                  {active} AS active, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day FROM orders),
b AS (SELECT order_key, coalesce(total_price, (SELECT {fill} FROM a)) AS total_price, {"status" if impute is None else f"coalesce(status, {impute})"} AS status, active, day FROM a)"""
    last = "b"
    if cap is not None:
        def bound(c):
            return f"greatest(least({c}, (SELECT quantile_cont({c}, {1 - cap}) FROM b)), (SELECT quantile_cont({c}, {cap}) FROM b)) AS {c}"

        def fence(c):
            return f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM c)"

        sql += f""",
c AS (SELECT {bound("order_key")}, {bound("total_price")}, status, active, day FROM b),
e AS (SELECT greatest(least(order_key, k.q3 + 1.5 * (k.q3 - k.q1)), k.q1 - 1.5 * (k.q3 - k.q1)) AS order_key,
             greatest(least(total_price, p.q3 + 1.5 * (p.q3 - p.q1)), p.q1 - 1.5 * (p.q3 - p.q1)) AS total_price, status, active, day
      FROM c, {fence("order_key")} AS k, {fence("total_price")} AS p),
s AS (SELECT avg(order_key) AS km, stddev_samp(order_key) AS ks, avg(total_price) AS pm, stddev_samp(total_price) AS ps FROM e),
g AS (SELECT CASE WHEN abs((order_key - km) / ks) <= {z} THEN order_key END AS order_key,
             CASE WHEN abs((total_price - pm) / ps) <= {z} THEN total_price END AS total_price, status, active, day FROM e, s)"""
        last = "g"
    sql += f"""
SELECT round(order_key, 4) AS order_key, round(total_price, 4) AS total_price, status, active, day,
       round(1 - ((CASE WHEN order_key IS NULL THEN 1 ELSE 0 END) + (CASE WHEN total_price IS NULL THEN 1 ELSE 0 END) + (CASE WHEN status IS NULL THEN 1 ELSE 0 END)) / 5.0, 6) AS _quality_score
FROM {last}"""

    @_query(f"preset_{name}", sql)
    def _(spark, d):
        made = pipeline.from_preset(name, now=F.lit("2050-01-01").cast("timestamp_ntz"), keep="table")
        out = made.run(_dirty_orders(spark, d)).drop("_cleaned_at", "_original_index")
        return _rounded(out.withColumn("_quality_score", F.round("_quality_score", 6)), 6).withColumns({c: F.round(c, 4) for c in ("order_key", "total_price")})


# null truth is true, unless imputed first: by the mode (the words that come most often), or by a word that keeps the column text
_preset("light", "quantile_cont(total_price, 0.5)", None, None, None, "o_orderkey % 7 NOT IN (1, 3, 6)")
_MODE = "(SELECT status FROM a WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)"
_preset(
    "default", "quantile_cont(total_price, 0.5)", _MODE, 0.01, 3.0,
    f"CASE WHEN o_orderkey % 7 = 4 THEN (SELECT lower(trim({BOOL})) AS w FROM orders WHERE o_orderkey % 7 <> 4 GROUP BY w ORDER BY count(*) DESC, w LIMIT 1) "
    "NOT IN ('no', '0', 'n') ELSE o_orderkey % 7 NOT IN (1, 3, 6) END",
)
_preset("strict", "avg(total_price)", "'missing'", 0.05, 2.5, f"coalesce(lower(trim({BOOL})), 'missing')")

_CHANGE = f"""
WITH b AS (SELECT o_orderkey, {PRICE} AS price, {STATUS} AS status FROM orders)
SELECT 0.0::DOUBLE AS o_orderkey, round(avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0.0 END), 6) AS price,
       round(avg(CASE WHEN o_orderkey % 6 < 3 THEN 1.0 ELSE 0.0 END), 6) AS status FROM b
"""


def _before_after(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    before = S.with_row_id(_table(spark, d, "orders", "o_orderkey", f"{PRICE} AS price", f"{STATUS} AS status"))
    return before, S.NumericColumns("median", ["price"])(S.Sentinels()(before))


@_query("report_change_ratio", _CHANGE)
def _(spark, d):
    return _rounded(report.change_ratios(*_before_after(spark, d)), 6)


@_query("report_summary", f"""
WITH b AS (SELECT o_orderkey, {PRICE} AS price, {STATUS} AS status FROM orders), n AS (
  SELECT CAST(count(*) FILTER (WHERE price IS NULL) AS BIGINT) AS p, CAST(count(*) FILTER (WHERE status IS NULL) AS BIGINT) AS s,
         CAST(count(*) FILTER (WHERE o_orderkey % 6 < 3) AS BIGINT) AS t, count(*) AS c FROM b)
SELECT 'Sentinels' AS step, CAST(0 AS BIGINT) AS rows_removed, CAST(1 AS BIGINT) AS columns_changed, p + s AS nulls_before, p + s + t AS nulls_after, t AS null_diff, round(t / c / 3.0, 3) AS avg_change FROM n
UNION ALL SELECT 'NumericColumns', 0, 1, p + s + t, s + t, -p, round(p / c / 3.0, 3) FROM n
""")
def _(spark, d):
    steps = [{"handle_sentinel_values": None}, {"fix_numeric_columns": {"fixcase": "median", "columns": ["price"]}}]
    made = pipeline.build(steps, report="full")
    made.run(_table(spark, d, "orders", "o_orderkey", f"{PRICE} AS price", f"{STATUS} AS status"))
    return made.report.detailed_summary(spark).drop("elapsed_ms")


@_query("analyze_types", """SELECT * FROM (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) AS t("column", type)""")
def _(spark, d):
    return spark.createDataFrame(list(analyzers.analyze("types", _table(spark, d, "customer")).items()), "column string, type string")


@_query("analyze_shape", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(5 AS BIGINT) AS n_columns FROM customer")
def _(spark, d):
    return spark.createDataFrame([analyzers.analyze("shape", _table(spark, d, "customer"))], "n_rows long, n_columns long")


@_query("analyze_info", """SELECT 'a' AS "column", 'double' AS type, CAST(count(*) FILTER (WHERE c_custkey % 3 <> 0) AS BIGINT) AS non_null FROM customer UNION ALL SELECT 'c_name', 'string', count(*) FROM customer""")
def _(spark, d):
    return analyzers.analyze("info", _table(spark, d, "customer", "CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS a", "c_name"))


@_query("analyze_describe", """SELECT 'c_acctbal' AS "column", CAST(count(c_acctbal) AS BIGINT) AS count, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, round(min(c_acctbal), 4) AS min, round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(quantile_cont(c_acctbal, 0.5), 4) AS q50, round(quantile_cont(c_acctbal, 0.75), 4) AS q75, round(max(c_acctbal), 4) AS max FROM customer""")
def _(spark, d):
    return _rounded(analyzers.analyze("describe", _table(spark, d, "customer", "c_acctbal", "c_name")))


@_query("analyze_columns", """SELECT * FROM (VALUES ('r_regionkey'), ('r_name')) AS t("column")""")
def _(spark, d):
    return spark.createDataFrame([(c,) for c in analyzers.analyze("columns", _table(spark, d, "region"))], "column string")


@_query("analyze_index", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS _row_id FROM nation")
def _(spark, d):
    return analyzers.analyze("index", _table(spark, d, "nation"))


@_query("analyze_head", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def _(spark, d):
    return analyzers.analyze("head", _table(spark, d, "nation", "n_nationkey", "n_name"))


@_query("analyze_tail", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey DESC LIMIT 5")
def _(spark, d):
    return analyzers.analyze("tail", _table(spark, d, "nation", "n_nationkey", "n_name"))


@_query("analyze_sample", None)
def _(spark, d):
    return analyzers.analyze("sample", _table(spark, d, "customer"), n=3, seed=1)


@_query("analyze_trend", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS trend_slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS trend_intercept FROM lineitem")
def _(spark, d):
    return _rounded(analyzers.analyze("trend_analysis", _table(spark, d, "lineitem"), x="l_quantity", y="l_extendedprice"))


@_query("analyze_correlation", """SELECT 'l_quantity' AS "left", 'l_extendedprice' AS "right", round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem""")
def _(spark, d):
    return _rounded(analyzers.analyze("correlation", _table(spark, d, "lineitem", "l_quantity", "l_extendedprice")), 6)


@_query("linreg_simple", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem")
def _(spark, d):
    m = regression.LinearRegression("ordinary_least_squares", "simple").fit(_table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return spark.createDataFrame([(round(m.intercept, 3), round(m.slope, 3))], "intercept double, slope double")


_COV = """
WITH m AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_extendedprice) AS y FROM lineitem),
s AS (SELECT sum((l_quantity - a) * (l_quantity - a)) AS aa, sum((l_discount - b) * (l_discount - b)) AS bb, sum((l_quantity - a) * (l_discount - b)) AS ab,
             sum((l_quantity - a) * (l_extendedprice - y)) AS ay, sum((l_discount - b) * (l_extendedprice - y)) AS byy FROM lineitem, m),
f AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS f1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS f2 FROM s),
g AS (SELECT y - f1 * a - f2 * b AS f0, f1, f2 FROM f, m)
"""


@_query("linreg_ols_multiple", _COV + "SELECT round(f0, 2) AS b0, round(f1, 3) AS b1, round(f2, 2) AS b2 FROM g")
def _(spark, d):
    m = regression.LinearRegression("ordinary_least_squares", "multiple").fit(_table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    b = m.coefficients
    return spark.createDataFrame([(round(float(b[0]), 2), round(float(b[1]), 3), round(float(b[2]), 2))], "b0 double, b1 double, b2 double")


@_query("model_scores", _COV + """, e AS (SELECT avg(pow(l_extendedprice - (f0 + f1 * l_quantity + f2 * l_discount), 2)) AS mse,
       1 - sum(pow(l_extendedprice - (f0 + f1 * l_quantity + f2 * l_discount), 2)) / (var_pop(l_extendedprice) * count(*)) AS r2 FROM lineitem, g)
SELECT round(mse, 0) AS mse, round(sqrt(mse), 2) AS rmse, round(r2, 6) AS r2 FROM e""")
def _(spark, d):
    df = _table(spark, d, "lineitem")
    m = regression.fit_ols(df, ["l_quantity", "l_discount"], "l_extendedprice")
    return regression.scores(df, F.col("l_extendedprice"), m.prediction()).select(F.round("mse", 0).alias("mse"), F.round("rmse", 2).alias("rmse"), F.round("r2", 6).alias("r2"))


@_query("linreg_gd", """
WITH RECURSIVE s AS (SELECT count(*)::DOUBLE AS n, sum(l_discount) AS a, sum(l_tax) AS b, sum(l_discount * l_discount) AS aa, sum(l_discount * l_tax) AS ab, sum(l_tax * l_tax) AS bb,
  sum(l_extendedprice) AS y, sum(l_discount * l_extendedprice) AS ay, sum(l_tax * l_extendedprice) AS byy FROM lineitem),
g(k, w0, w1, w2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT k + 1, w0 - 0.01 * (n * w0 + a * w1 + b * w2 - y) / n, w1 - 0.01 * (a * w0 + aa * w1 + ab * w2 - ay) / n, w2 - 0.01 * (b * w0 + ab * w1 + bb * w2 - byy) / n
  FROM g, s WHERE k < 1000)
SELECT round(w0, 3) AS b0, round(w1, 3) AS b1, round(w2, 3) AS b2 FROM g WHERE k = 1000""")
def _(spark, d):
    m = regression.GradientDescent().fit(_table(spark, d, "lineitem"), ["l_discount", "l_tax"], "l_extendedprice")
    return spark.createDataFrame([tuple(round(float(x), 3) for x in m.coefficients)], "b0 double, b1 double, b2 double")


@_query("linreg_gd_simple", """
WITH RECURSIVE s AS (SELECT count(*)::DOUBLE AS n, sum(l_discount) AS a, sum(l_discount * l_discount) AS aa, sum(l_extendedprice) AS y, sum(l_discount * l_extendedprice) AS ay FROM lineitem),
g(k, w0, w1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT k + 1, w0 - 0.01 * (n * w0 + a * w1 - y) / n, w1 - 0.01 * (a * w0 + aa * w1 - ay) / n FROM g, s WHERE k < 1000)
SELECT round(w0, 3) AS intercept, round(w1, 3) AS slope FROM g WHERE k = 1000""")
def _(spark, d):
    m = regression.LinearRegression("gradient_descent", "simple").fit(_table(spark, d, "lineitem"), "l_discount", "l_extendedprice")
    return spark.createDataFrame([(round(m.intercept, 3), round(m.slope, 3))], "intercept double, slope double")


# a target of the features' own size, so that descent comes to rest
_REST = """
WITH RECURSIVE t AS (SELECT l_discount * 10 AS x, 2 + 3 * l_discount * 10 + l_tax AS y FROM lineitem),
s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS a, sum(x * x) AS aa, sum(y) AS y, sum(x * y) AS ay, sum(y * y) AS yy FROM t),
g(k, w0, w1, loss, last) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, (SELECT yy / (2 * n) FROM s), CAST('Infinity' AS DOUBLE) UNION ALL
  SELECT k + 1, v0, v1, (n * v0 * v0 + 2 * a * v0 * v1 + aa * v1 * v1 - 2 * (y * v0 + ay * v1) + yy) / (2 * n), loss
  FROM (SELECT *, w0 - 0.1 * (n * w0 + a * w1 - y) / n AS v0, w1 - 0.1 * (a * w0 + aa * w1 - ay) / n AS v1 FROM g, s WHERE k < 999 AND abs(loss - last) >= 1e-6))
"""


def _rested(spark: SparkSession, d: str) -> regression.Model:
    table = _table(spark, d, "lineitem", "l_discount * 10 AS x", "2 + 3 * l_discount * 10 + l_tax AS y")
    return regression.GradientDescent(learning_rate=0.1).fit(table, ["x"], "y")


@_query("linreg_gd_convergence", _REST + "SELECT CAST(max(k) AS INTEGER) AS iterations, true AS converged, round(arg_max(w0, k), 4) AS b0, round(arg_max(w1, k), 4) AS b1 FROM g")
def _(spark, d):
    m = _rested(spark, d)
    return spark.createDataFrame([(m.iterations, m.converged, round(m.intercept, 4), round(m.slope, 4))], "iterations int, converged boolean, b0 double, b1 double")


@_query("linreg_gd_loss_history", _REST + "SELECT CAST(k AS INTEGER) AS round, round(loss, 5) AS loss FROM g")
def _(spark, d):
    return spark.createDataFrame([(k, round(x, 5)) for k, x in enumerate(_rested(spark, d).loss_history)], "round int, loss double")


_DRAW = "((l_orderkey * 7919 + l_partkey * 31 + l_linenumber * 104729 + {seed} * 611953) % 1000003) / CAST(1000003 AS DOUBLE)"


@_query("linreg_gd_mini_batch", f"""
WITH RECURSIVE c AS (SELECT count(*) AS n, least(400, count(*) // 64) AS few FROM lineitem), p AS (SELECT unnest(range(0, CAST(ceil(400.0 / few) AS BIGINT))) AS p, n, few FROM c),
t AS (SELECT p * few + floor({_DRAW.format(seed="(5 + p)")} * (n / CAST(64 AS DOUBLE))) AS k, floor({_DRAW.format(seed="(5 + p)")} * (n / CAST(64 AS DOUBLE))) AS b, few, l_discount * 10 AS x, 2 + 3 * l_discount * 10 + l_tax AS y FROM lineitem, p),
s AS (SELECT CAST(k AS BIGINT) AS k, count(*)::DOUBLE AS n, sum(x) AS a, sum(x * x) AS aa, sum(y) AS y, sum(x * y) AS ay FROM t WHERE b < few AND k < 400 GROUP BY 1),
g(k, w0, w1) AS (SELECT CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT g.k + 1, w0 - 0.1 * (n * w0 + a * w1 - y) / n, w1 - 0.1 * (a * w0 + aa * w1 - ay) / n FROM g JOIN s ON s.k = g.k)
SELECT CAST(max(k) AS INTEGER) AS rounds, round(arg_max(w0, k), 6) AS b0, round(arg_max(w1, k), 6) AS b1 FROM g""")
def _(spark, d):
    """Batches drawn by numbers of the rows, which SQL can draw too."""
    table = _table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_discount * 10 AS x", "2 + 3 * l_discount * 10 + l_tax AS y")
    descent = regression.GradientDescent(learning_rate=0.1, max_iterations=400, tolerance=0.0, batch_size=64, seed=5, draw=lambda seed: F.expr(_DRAW.format(seed=seed)))
    m = descent.fit(table, ["x"], "y")
    return spark.createDataFrame([(len(m.loss_history), round(m.intercept, 6), round(m.slope, 6))], "rounds int, b0 double, b1 double")


@_query("analyze_trend_gradient_descent", """
WITH RECURSIVE s AS (SELECT count(*)::DOUBLE AS n, sum(l_discount) AS a, sum(l_discount * l_discount) AS aa, sum(l_quantity) AS y, sum(l_discount * l_quantity) AS ay, sum(l_quantity * l_quantity) AS yy FROM lineitem),
g(k, w0, w1, loss, last) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, (SELECT yy / (2 * n) FROM s), CAST('Infinity' AS DOUBLE) UNION ALL
  SELECT k + 1, v0, v1, (n * v0 * v0 + 2 * a * v0 * v1 + aa * v1 * v1 - 2 * (y * v0 + ay * v1) + yy) / (2 * n), loss
  FROM (SELECT *, w0 - 0.01 * (n * w0 + a * w1 - y) / n AS v0, w1 - 0.01 * (a * w0 + aa * w1 - ay) / n AS v1 FROM g, s WHERE k < 999 AND abs(loss - last) >= 1e-6))
SELECT round(arg_max(w1, k), 4) AS trend_slope, round(arg_max(w0, k), 4) AS trend_intercept FROM g""")
def _(spark, d):
    options = {"type_of_prediction": "gradient_descent", "complexity": "simple"}
    return _rounded(analyzers.analyze("trend_analysis", _table(spark, d, "lineitem"), x="l_discount", y="l_quantity", **options))


@_query("analyze_sample_members", "SELECT CAST(7 AS BIGINT) AS n, CAST(7 AS BIGINT) AS members, true AS repeatable")
def _(spark, d):
    """A sample is at random; what is compared: its size, that its rows are the table's, and that the seed decides."""
    table = _table(spark, d, "customer")
    one, two = (analyzers.analyze("sample", table, n=7, seed=3) for _ in range(2))
    members = one.join(table.select("c_custkey"), "c_custkey").count()
    same = sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    return spark.createDataFrame([(one.count(), members, same)], "n long, members long, repeatable boolean")


@_query("report_print_summary", f"""
WITH b AS (SELECT {PRICE} AS price FROM orders), n AS (SELECT count(*) FILTER (WHERE price IS NULL) AS p, count(*) AS c FROM b),
t AS (SELECT ['NumericColumns', '0', '1', CAST(p AS VARCHAR), '0', CAST(-p AS VARCHAR), printf('%.3f', p / c / 2.0)] AS v FROM n)
SELECT unnest(['step', 'rows_removed', 'columns_changed', 'nulls_before', 'nulls_after', 'null_diff', 'avg_change']) AS name, unnest(v) AS value FROM t""")
def _(spark, d):
    """The printed summary, read back by its columns; avg_change with three decimals."""
    made = pipeline.build([{"fix_numeric_columns": {"columns": ["price"]}}], report="full")
    made.run(_table(spark, d, "orders", "o_orderkey", f"{PRICE} AS price"))
    with contextlib.redirect_stdout(out := io.StringIO()):
        made.report.print_summary()
    names, values = (line.split() for line in out.getvalue().splitlines())
    rows = [(n, f"{float(v):.3f}" if n == "avg_change" else v) for n, v in zip(names, values, strict=True) if n != "elapsed_ms"]
    return spark.createDataFrame(rows, "name string, value string")


@_query("report_json", """
WITH b AS (SELECT o_orderkey, {p} AS price, {s} AS status FROM orders)
SELECT 'Sentinels' AS name, CAST(0 AS BIGINT) AS rows_removed, CAST(count(*) FILTER (WHERE price IS NULL) + count(*) FILTER (WHERE status IS NULL) AS BIGINT) AS nulls_before,
       CAST(count(*) FILTER (WHERE price IS NULL) + count(*) FILTER (WHERE status IS NULL) + count(*) FILTER (WHERE o_orderkey % 6 < 3) AS BIGINT) AS nulls_after,
       round(count(*) FILTER (WHERE o_orderkey % 6 < 3) / count(*)::DOUBLE, 6) AS status_ratio FROM b""".format(p=PRICE, s=STATUS))
def _(spark, d):
    made = pipeline.build([{"handle_sentinel_values": None}], report="full")
    made.run(_table(spark, d, "orders", "o_orderkey", f"{PRICE} AS price", f"{STATUS} AS status"))
    with tempfile.TemporaryDirectory() as folder:  # a report is a small file of the driver
        made.report.to_json(path := os.path.join(folder, "report.json"))
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
    rows = [(x["name"], x["metrics"]["rows_removed"], x["metrics"]["nulls_before"], x["metrics"]["nulls_after"], round(x["metrics"]["change_ratio"]["status"], 6)) for x in steps]
    return spark.createDataFrame(rows, "name string, rows_removed long, nulls_before long, nulls_after long, status_ratio double")


@_query("preview_rows", "SELECT 'r_regionkey | r_name' AS line UNION ALL SELECT r_regionkey || ' | ' || r_name FROM region WHERE r_regionkey < 3")
def _(spark, d):
    return spark.createDataFrame([(x,) for x in readers.preview(_table(spark, d, "region", "r_regionkey", "r_name").orderBy("r_regionkey"), 3)], "line string")


@_query("step_registered", "SELECT n_nationkey, upper(n_name) || '!' AS n_name FROM nation")
def _(spark, d):
    """A step of the user's own, registered by name and used in a configuration."""
    S.register("shout", lambda column: lambda df: S.replaced(df, {column: F.concat(F.upper(column), F.lit("!"))}))
    try:
        return pipeline.build([{"shout": {"column": "n_name"}}]).run(_table(spark, d, "nation", "n_nationkey", "n_name"))
    finally:
        S.REGISTRY.pop("shout")


@_query("cli_light", "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, replace(lower(n_name), ' ', '_') AS n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def _(spark, d):
    """The command line from a CSV file to one CSV file and its report."""
    readers.write_csv(_table(spark, d, "nation"), path := tables.folder(spark, "nation.csv"))
    with tempfile.TemporaryDirectory() as folder:
        cli.main(["-i", path, "-o", out := tables.folder(spark, "clean.csv"), "-p", "light", "-r", os.path.join(folder, "report.json")])
        assert os.path.getsize(os.path.join(folder, "report.json"))
    return readers.read(spark, out).selectExpr("double(n_nationkey) AS n_nationkey", "n_name", "double(n_regionkey) AS n_regionkey")


@_query("source_xlsx", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _(spark, d):
    rows = [("n_nationkey", "n_name"), *((r[0], r[1]) for r in _table(spark, d, "nation", "n_nationkey", "n_name").orderBy("n_nationkey").limit(100).collect())]
    readers.write_bytes(spark, path := tables.folder(spark, "nation.xlsx"), readers.workbook(rows))
    return readers.read(spark, path)


@_query("source_parquet", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return readers.read(spark, f"{d}/region.parquet")


_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


@_query("source_csv", _NATION)
def _(spark, d):
    readers.write_csv(_table(spark, d, "nation"), path := tables.folder(spark, "nation.csv"))
    return readers.read(spark, path)


@_query("source_csv_spaced", "SELECT CAST(c_custkey AS BIGINT) AS \"Cust Key\", '$' || CAST(c_custkey % 9 + 1 AS VARCHAR) || ',200.50' AS \"Spend\", CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS \"Segment\" FROM customer")
def _(spark, d):
    cells = "concat(c_custkey, ' , $', c_custkey % 9 + 1, ',200.50 , ', CASE WHEN c_custkey % 4 = 0 THEN 'NA' ELSE c_mktsegment END) AS value"
    header = spark.range(1).selectExpr("'Cust Key , Spend , Segment' AS value")
    header.union(_table(spark, d, "customer", cells)).coalesce(1).write.text(path := tables.folder(spark, "customer.csv"))
    return readers.read(spark, path)


@_query("source_json", _NATION)
def _(spark, d):
    rows = _table(spark, d, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value"))
    rows.coalesce(1).write.text(path := tables.folder(spark, "nation.json"))
    return readers.read(spark, path)


@_query("source_html", _NATION)
def _(spark, d):
    cells = "concat('<tr><td>', n_nationkey, '<td>', n_name, '<td>', n_regionkey, '</tr>') AS value"
    head = spark.range(1).selectExpr("'<table><tr><th>n_nationkey<th>n_name<th>n_regionkey</tr>' AS value")
    head.union(_table(spark, d, "nation", cells)).coalesce(1).write.text(path := tables.folder(spark, "nation.html"))
    return readers.read(spark, path)


@_query("sink_csv", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    counts = _table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    readers.write_csv(counts, path := tables.folder(spark, "counts.csv"), single=True)
    return readers.read(spark, path)


@_query("clean_stream", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN value < 10 OR value > 60 THEN NULL ELSE value END AS value FROM events")
def _(spark, d):
    """A stream of the events table through expression-only rules, into Parquet."""
    source = _table(spark, d, "events", "event_id", "CASE WHEN event_id % 5 = 0 THEN ' n/a ' ELSE event_type END AS event_type", "value")
    source.write.parquet(inbox := tables.folder(spark, "inbox"))
    stream = spark.readStream.schema(source.schema).parquet(inbox)
    rules = [{"handle_sentinel_values": None}, {"validate_domain_rules": {"rules": {"value": [10, 60]}}}]
    out = tables.folder(spark, "out")
    query = clean.clean_stream(stream, rules).writeStream.format("parquet").option("checkpointLocation", tables.folder(spark, "state")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(source.schema).parquet(out)


@_query("analyze_seasonality", "SELECT CAST(month(o_orderdate) AS INTEGER) AS month, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _(spark, d):
    return _rounded(analyzers.analyze("seasonality", _table(spark, d, "orders"), time="o_orderdate", value="o_totalprice"))


@_query("analyze_moving_averages", "SELECT o_orderkey, round(avg(o_totalprice) OVER w, 4) AS moving_average, round(stddev_samp(o_totalprice) OVER w, 4) AS volatility FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    out = analyzers.analyze("moving_averages", _table(spark, d, "orders"), by=["o_custkey"], order="o_orderkey", value="o_totalprice")
    return _rounded(out.select("o_orderkey", "moving_average", "volatility"))


@_query("analyze_lag_features", "SELECT o_orderkey, round(lag(o_totalprice) OVER w, 4) AS lag, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS diff, round((o_totalprice - lag(o_totalprice) OVER w) / lag(o_totalprice) OVER w, 6) AS growth, round(o_totalprice - 2 * lag(o_totalprice) OVER w + lag(o_totalprice, 2) OVER w, 4) AS momentum FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _(spark, d):
    out = analyzers.analyze("lag_features", _table(spark, d, "orders"), by=["o_custkey"], order="o_orderkey", value="o_totalprice")
    return _rounded(out.select("o_orderkey", "lag", "diff", F.round("growth", 6).alias("growth"), "momentum"), 6).withColumns({c: F.round(c, 4) for c in ("lag", "diff", "momentum")})


@_query("analyze_group_statistics", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    return _rounded(analyzers.analyze("group_statistics", _table(spark, d, "lineitem"), by=["l_returnflag"], value="l_quantity"))


@_query("analyze_anomaly_scores", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS z_score FROM customer")
def _(spark, d):
    return _rounded(analyzers.analyze("anomaly_scores", _table(spark, d, "customer", "c_custkey", "c_acctbal"), value="c_acctbal").select("c_custkey", "z_score"), 6)


@_query("analyze_threshold_violations", """SELECT 'l_quantity' AS "column", CAST(count(*) FILTER (WHERE l_quantity < 5) AS BIGINT) AS below, CAST(count(*) FILTER (WHERE l_quantity > 45) AS BIGINT) AS above FROM lineitem UNION ALL SELECT 'l_tax', 0, count(*) FILTER (WHERE l_tax > 0.05) FROM lineitem""")
def _(spark, d):
    return analyzers.analyze("threshold_violations", _table(spark, d, "lineitem"), bounds={"l_quantity": (5, 45), "l_tax": (None, 0.05)})


@_query("analyze_information_content", """WITH k AS (SELECT o_orderstatus AS v, count(*) AS k FROM orders GROUP BY 1) SELECT 'o_orderstatus' AS "column", round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) AS entropy FROM k""")
def _(spark, d):
    return _rounded(analyzers.analyze("information_content", _table(spark, d, "orders", "o_orderstatus")), 6)


@_query("analyze_feature_variance", """SELECT 'l_quantity' AS "column", round(var_samp(l_quantity), 4) AS variance FROM lineitem UNION ALL SELECT 'l_discount', round(var_samp(l_discount), 4) FROM lineitem""")
def _(spark, d):
    return _rounded(analyzers.analyze("feature_variance", _table(spark, d, "lineitem", "l_quantity", "l_discount")))


@_query("analyze_cohorts", "WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS m FROM orders), f AS (SELECT o_custkey, min(m) AS c FROM m GROUP BY 1) SELECT strftime(c, '%Y-%m') AS cohort, CAST((year(m) - year(c)) * 12 + month(m) - month(c) AS INTEGER) AS age, CAST(count(*) AS BIGINT) AS members FROM m JOIN f USING (o_custkey) GROUP BY 1, 2")
def _(spark, d):
    out = analyzers.analyze("cohort_analysis", _table(spark, d, "orders"), member="o_custkey", time="o_orderdate")
    return out.select(F.date_format("cohort", "yyyy-MM").alias("cohort"), "age", "members")


@_query("analyze_skewness_kurtosis", """WITH m AS (SELECT avg(l_extendedprice) AS a FROM lineitem), s AS (SELECT avg(pow(l_extendedprice - a, 2)) AS m2, avg(pow(l_extendedprice - a, 3)) AS m3, avg(pow(l_extendedprice - a, 4)) AS m4 FROM lineitem, m) SELECT 'l_extendedprice' AS "column", round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis FROM s""")
def _(spark, d):
    return _rounded(analyzers.analyze("skewness_kurtosis", _table(spark, d, "lineitem", "l_extendedprice")), 6)

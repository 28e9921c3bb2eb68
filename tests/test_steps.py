"""Edge cases of the cleaning steps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cleanloom.functions import exprs as X
from cleanloom.functions import inference as I
from cleanloom.operators import regression
from cleanloom.operators import steps as S



def now():
    return F.lit("2024-06-30 12:00:00").cast("timestamp_ntz")


def values(df, column=None):
    return [r[column or df.columns[0]] for r in df.collect()]


def test_numbers(table):
    cells = ["€950,30", "$1,000", "$1,200.50", "1.200,00", " Thirty ", "12f", "1_000", "inf", "nan", "-5", "1e3", "", None, "eleven"]
    df = table([(c,) for c in cells], "c string")
    assert values(df.select(X.number(F.col("c")))) == [950.3, 1.0, None, None, 30.0, None, None, None, None, -5.0, 1000.0, None, None, None]


def test_looks_numeric(table):
    cells = ["5", "-5.3", "--5", ".-5", "1.2.3", "1e5", " 5", "", "abc"]
    df = table([(c,) for c in cells], "c string")
    assert values(df.select(X.looks_numeric(F.col("c")))) == [True, True, True, True, False, False, False, False, False]


def test_dates(table):
    cells = ["2024-01-01", "01/15/2024", "1/5/2024", "2024/02/01", "March 5 2024", "Mar 5, 2024", "2024-13-01", "2024-02-30", "now", "2024", "10:00", None]
    df = table([(c,) for c in cells], "c string")
    got = values(df.select(X.any_date(F.col("c"))))
    day = lambda m, d: dt.datetime(2024, m, d)
    assert got == [day(1, 1), day(1, 15), day(1, 5), day(2, 1), day(3, 5), day(3, 5), None, None, None, None, None, None]


def test_dates_within_bounds(table):
    df = table([("1899-12-31",), ("1900-01-01",), ("2024-07-01",)], "c string")
    assert [v is not None for v in values(df.select(X.date_cell(F.col("c"), now())))] == [False, True, False]


def test_titles_clash(table):
    assert S.Titles()(table([(1, 2, 3)], "`A b` int, ` a  B ` int, `Purchase Amount (USD)` int")).columns == ["a_b", "a_b_1", "purchase_amount_(usd)"]


def test_sentinels(table):
    df = table([(" Unknown ", 1), ("$-", 2), ("ok", 3), ("X", 4)], "a string, b int")
    assert [tuple(r) for r in S.Sentinels()(df).collect()] == [(None, 1), (None, 2), ("ok", 3), ("X", 4)]
    assert values(S.Sentinels(["2"])(df), "b") == [1, None, 3, 4]
    assert values(S.Sentinels(["X"])(df)) == [None, None, "ok", "X"]  # extras are compared as given


def test_categories_null_becomes_text(table):
    df = table([("M ",), (None,), ("Other",)], "g string")
    assert values(S.Categories({"g": {"m": "male"}})(df)) == ["male", "nan", "other"]
    assert values(S.Categories({"g": {"m": "male"}}, keep_null=True)(df)) == ["male", None, "other"]


def test_safe_conversion_needs_digits(table):
    df = table([("1",), (None,), (None,), (None,)], "c string")
    assert dict(S.SafeConversion(now=now())(df).dtypes) == {"c": "string"}  # nulls count against the share
    assert dict(S.SafeConversion(["c"], now=now())(df).dtypes) == {"c": "double"}


def test_safe_conversion_mixed(table):
    df = table([("850",), ("x1",), ("March 5 2024",), ("12345678.5",)], "c string")
    assert values(S.SafeConversion(now=now())(df)) == ["850.0", "x1", "2024-03-05 00:00:00", "12345678.5"]


def test_duplicates_keep_the_first(spark, table):
    df = S.with_row_id(table([(1, None), (2, "a"), (1, None), (2, "b")], "a int, b string").coalesce(1))
    out = S.Duplicates()(df)
    assert sorted(values(out, S.ROW_ID)) == [0, 1, 3]


def test_domain_rules(table):
    df = table([("1",), ("x",), ("99",), (None,)], "c string")
    assert values(S.DomainRules({"c": [0, 50]})(df)) == ["1", "x", None, None]
    assert values(S.DomainRules({"c": [2]})(df)) == [None, "x", "99", None]


@pytest.mark.parametrize("how, fill", [("mean", 2.5), ("median", 2.0), ("mode", 2.0)])
def test_fill(table, how, fill):
    df = table([(1.0,), (2.0,), (2.0,), (5.0,), (None,)], "c double")
    assert values(S.NumericColumns(how)(df)) == [1.0, 2.0, 2.0, 5.0, fill]


def test_fill_all_null_and_unknown(table):
    assert values(S.NumericColumns("mode")(table([(None,)], "c double"))) == [None]
    with pytest.raises(ValueError):
        S.NumericColumns("best")


def test_exponents_survive(table):
    assert values(S.NumericColumns()(table([(1e-05,), (1e20,)], "c double"))) == [1e-05, 1e20]


def test_outliers_and_caps_keep_null(table):
    df = table([(float(x),) for x in (1, 2, 3, 4, 1000)] + [(None,)], "c double")
    assert values(S.Outliers()(df))[-1] is None
    out = values(S.Caps(lower_percentile=0.0, upper_percentile=0.75)(df))
    assert out == [1.0, 2.0, 3.0, 4.0, 4.0, None]
    empty = table([(None,)], "c double")
    assert values(S.Caps()(empty)) == values(S.Outliers()(empty)) == [None]


def test_bools(table):
    df = table([("Yes",), (" 0 ",), (None,)], "c string")
    assert values(S.Bools()(df)) == [True, False, True]
    assert values(S.Bools(["c"])(table([("",), ("maybe",)], "c string"))) == [False, True]
    assert values(S.Bools(null_as=None)(df)) == [True, False, None]


def test_types(table):
    df = table([("5", "false", None), ("x", "", 0)], "n string, t string, b int")
    assert [tuple(r) for r in S.Types(["n"], ["t", "b"])(df).collect()] == [(5.0, True, True), (None, False, False)]


def test_cross_column(table):
    df = table([("F", None), ("F", "x"), ("O", None), (None, None)], "s string, p string")
    assert values(S.CrossColumns([{"if_col": "s", "equals": "F", "then_col": "p", "action": "set_nan"}])(df)) == [None, "F", "O", None]


def test_missing_threshold_is_strict(table):
    df = table([(1, None), (2, 1), (3, 1), (4, None)], "a int, b int")
    assert S.HighMissing(0.5)(df).columns == ["a", "b"]
    assert S.HighMissing(0.49)(df).columns == ["a"]
    assert S.HighMissing()(df.limit(0)).columns == ["a", "b"]


def test_text_standard(table):
    df = table([("Éa  ß—Ǆ ﬁ-x_1!",), ("NaN",), (None,), ("Ĳ",)], "c string")
    assert values(S.TextStandard()(df))[1:] == [None, None, "ij"]
    assert values(S.TextStandard()(df))[0].startswith("ea")
    once = S.TextStandard()(df)
    assert values(S.TextStandard()(once)) == values(once)
    with pytest.raises(KeyError):
        S.TextStandard(["absent"])(df)


def test_folds_agree_with_full_decomposition(table):
    text = "".join(chr(c) for c in range(0x20, 0x250)) + "Ḁẞﬁ漢"
    df = table([(text,)], "c string")
    both = df.select(X.fold_ascii(F.col("c")).alias("a"), X.fold_ascii_any(F.col("c")).alias("b")).head()
    assert both["a"] == both["b"]


def test_impute(table):
    df = table([("b",), ("a",), (None,)], "c string")
    assert values(S.Impute()(df)) == ["b", "a", "a"]  # the least on a tie
    assert values(S.Impute(strategy="anything", fill_value="?")(df)) == ["b", "a", "?"]
    assert values(S.Impute()(table([(None,)], "c string"))) == [None]


def test_schema_warns(table):
    with pytest.warns(UserWarning, match="fewer than 3"):
        S.Schema(["a"], 3)(table([(1,)], "a int"))
    with pytest.warns(UserWarning, match="lacks"):
        S.Schema(["b"])(table([(1,)], "a int"))


def test_audit_places_are_contiguous(spark):
    out = S.Audit(now=now())(spark.range(100).repartition(7))
    assert sorted(values(out, "_original_index")) == list(range(100))


def test_places_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW_PARTITIONS", 3)
    df = spark.range(100).repartition(7)
    assert sorted(values(S.with_places(df, "at"), "at")) == list(range(100))


def rows_of_two(rows):
    return [(r[0], "x") for r in rows]


def test_date_columns_look_at_the_first_ten(spark, table):
    rows = [("2024-01-01",)] * 5 + [("x",)] * 5 + [("y",)] * 20
    assert I.date_columns(table(rows, "c string").coalesce(1), now()) == ["c"]
    assert I.date_columns(table(rows[1:], "c string").coalesce(1), now()) == []
    late = [(None, "2024-01-01")] * 1200 + rows_of_two(rows)
    assert I.date_columns(table(late, "c string, d string").coalesce(1), now()) == ["c", "d"]


def test_unknown_step():
    with pytest.raises(ValueError, match="unknown step"):
        S.create("nothing")


def test_own_step(table):
    S.register("plus_one", lambda by=1: lambda df: df.withColumn("a", F.col("a") + by))
    assert values(S.create("plus_one", by=2)(table([(1,)], "a int"))) == [3]
    del S.REGISTRY["plus_one"]


def test_quantiles_are_exact(spark, monkeypatch):
    """Brackets, narrowed as for a large table, give what all values give; hot values and nulls included."""
    df = spark.range(20_000).selectExpr("CASE WHEN id % 7 > 0 THEN randn(1) END AS a", "round(randn(2) * 2) AS b", "CAST(NULL AS DOUBLE) AS c", "double(id % 3 > 0) AS d")
    shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    names = ["a", "b", "c", "d"]
    want = df.agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in names)).head()
    for accuracy, few in ((10_000, 100_000), (200, 300)):
        monkeypatch.setattr(S, "ACCURACY", accuracy)
        monkeypatch.setattr(S, "FEW_VALUES", few)
        got = S.quantiles(df, [F.col(c) for c in names], shares)
        assert got[2] is None and want["c"] is None
        assert all(abs(x - y) < 1e-12 for k in (0, 1, 3) for x, y in zip(got[k], want[k], strict=True))


def test_batches_are_drawn_by_one_pass(spark):
    df = spark.range(10_000).selectExpr("double(id) AS x", "double(2 * id) AS y")
    batches = regression.drawn_batches(df, ["x"], "y", 100, 10_000, 30, 5)
    assert len(batches) == 30 and all(50 < b.n < 160 for b in batches)
    again = regression.drawn_batches(df, ["x"], "y", 100, 10_000, 30, 5)
    assert [b.n for b in again] == [b.n for b in batches]

"""Pipelines over a dirty file, reports, readers, the command line, streams, analyzers and models."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cleanloom import cli
from cleanloom.operators import analyzers, regression
from cleanloom.operators import steps as S
from cleanloom.plans import pipeline
from cleanloom.sources import readers
from cleanloom.streaming import clean

DIRTY = """Member No , Years , Sex , Spend (EUR) , Town , Joined , Active , Stars
101 , 31 , Male , $1,150.75 , Lyon , 2024-01-02 , yes , 4.5
102 ,  twenty , Female , 640 , lyon , 02/15/2024 , NO , 5
103 , , male , €720,40 , Unknown , 2024/03/01 , 1 , 
104 , 44 , FEMALE , $- , Nice , April 9 2024 , 0 , NaN
104 , 44 , FEMALE , $- , Nice , April 9 2024 , 0 , NaN
105 , 200 , , 1.300,00 , Paris , 2024-02-30 , true , 3"""


@pytest.fixture
def dirty(tmp_path):
    path = tmp_path / "dirty.csv"
    path.write_text(DIRTY)
    return str(path)


def test_spaced_commas(spark, dirty):
    df = readers.read(spark, dirty)
    assert df.columns == ["Member No", "Years", "Sex", "Spend (EUR)", "Town", "Joined", "Active", "Stars"]
    rows = df.collect()
    assert len(rows) == 6
    assert rows[0]["Spend (EUR)"] == "$1,150.75" and rows[2]["Years"] is None and rows[3]["Stars"] is None


@pytest.mark.parametrize("preset", ["light", "default", "strict"])
def test_presets(spark, dirty, preset):
    made = pipeline.from_preset(preset, report="full", keep="table")
    out = made.run(readers.read(spark, dirty))
    assert out.count() == 5
    assert {"member_no", "spend_(eur)", "_quality_score", "_original_index", "_cleaned_at"} <= set(out.columns)
    assert [s["name"] for s in made.report.steps][0] == "Schema"
    summary = made.report.summary(spark)
    assert summary.count() == len(made.steps)
    assert summary.where("step = 'Duplicates'").head()["rows_removed"] == 1
    made.report.print_summary()


def test_unknown_preset_is_the_default():
    assert len(pipeline.from_preset("nothing").steps) == len(pipeline.from_preset("default").steps) == 18
    assert len(pipeline.from_preset("light").steps) == 13


def test_errors_name_the_step(table):
    with pytest.raises(RuntimeError, match="Error in step 'TextStandard'"):
        pipeline.build([{"text_standardization": {"columns": ["absent"]}}]).run(table([(1,)], "a int"))


def test_empty_table(table):
    out = pipeline.from_preset("default", report="final").run(table([], "a int, b string, c double"))
    assert out.count() == 0


def test_nan_is_null(table):
    made = pipeline.build([{"flag_data_quality": None}])
    assert made.run(table([(float("nan"), 1)], "a double, b int")).head()["_quality_score"] == 0.5


def test_command_line(spark, dirty, tmp_path, capsys):
    assert cli.main(["-i", dirty, "-p", "light"]) == 0
    assert readers.read(spark, str(tmp_path / "clean_dirty.csv")).count() == 5
    steps = json.loads((tmp_path / "cleaning_report_dirty.csv.json").read_text())
    assert len(steps) == 13 and {"rows_removed", "change_ratio", "elapsed_ms"} <= set(steps[0]["metrics"])
    assert "member_no" in capsys.readouterr().out


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
def test_separators(spark, tmp_path, separator):
    path = tmp_path / "a.csv"
    path.write_text("\n".join(separator.join(r) for r in (["a", "b"], ["1", "x"], ["NA", "n/a"], ["3", "z"])))
    assert [tuple(r) for r in readers.read(spark, str(path)).collect()] == [(1, "x"), (None, None), (3, "z")]


@pytest.mark.parametrize("data", [
    [{"a": 1, "b": "x"}, {"a": 2, "b": None}], {"columns": ["a", "b"], "index": [0, 1], "data": [[1, "x"], [2, None]]}, {"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": None}},
])
def test_json(spark, tmp_path, data):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(data))
    assert [tuple(r) for r in readers.read(spark, str(path)).select("a", "b").collect()] == [(1, "x"), (2, None)]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"a": 1}\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.read(spark, str(path)).collect()) == [1, 2]


def test_html(spark, tmp_path):
    path = tmp_path / "a.html"
    path.write_text("<p>x</p><table></table><table><tr><th>a<th>b</tr><tr><td>1<td> y &amp; z </tr></table><table><tr><td>9</td></tr></table>")
    assert [tuple(r) for r in readers.read(spark, str(path)).collect()] == [(1, "y & z")]
    path.write_text("<p>none</p>")
    with pytest.raises(ValueError, match="no tables"):
        readers.read(spark, str(path))


def test_xlsx(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>a</t></si><si><t>b</t></si><si><r><t>x</t></r><r><t>y</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
                   '<row><c r="A2"><v>1.5</v></c><c r="B2" t="s"><v>2</v></c></row><row><c r="B3" t="inlineStr"><is><t>q</t></is></c></row></sheetData></worksheet>')  # fmt: skip
    assert [tuple(r) for r in readers.read(spark, str(path)).collect()] == [(1.5, "xy"), (None, "q")]
    with pytest.raises(ValueError, match="xlsx"):
        readers.read(spark, str(tmp_path / "a.xls"))


def test_no_reader(spark):
    with pytest.raises(ValueError, match="no reader"):
        readers.read(spark, "a.xyz")


def test_streams(spark, tmp_path, table):
    table([(" N/A ", 7.0), ("ok", 70.0)], "s string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, v double").parquet(str(tmp_path / "in"))
    rules = [{"handle_sentinel_values": None}, {"validate_domain_rules": {"rules": {"v": [0, 50]}}}]
    q = clean.clean_stream(stream, rules).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("cleaned").collect())) == sorted(["Row(s=None, v=7.0)", "Row(s='ok', v=None)"])
    with pytest.raises(ValueError, match="whole table"):
        clean.clean_stream(stream, [{"cap_outliers": None}])
    seen = []
    q = clean.clean_batches(stream, [{"fix_numeric_columns": None}], lambda df, _: seen.append(df.count()), str(tmp_path / "c"))
    q.awaitTermination()
    assert seen == [2]


def test_analyzers(spark, table):
    df = table([(1, 2.0, "x"), (2, 4.0, None), (3, 6.0, "y")], "a int, b double, c string").coalesce(1)
    assert analyzers.analyze("shape", df) == (3, 3)
    assert [r["non_null"] for r in analyzers.analyze("info", df).collect()] == [3, 3, 2]
    assert [tuple(r) for r in analyzers.analyze("tail", df, n=2).select("a").collect()] == [(2,), (3,)]
    assert analyzers.analyze("trend_analysis", df, x="a", y="b").head()["trend_slope"] == 2.0
    with pytest.raises(ValueError, match="unknown analyzer"):
        analyzers.analyze("nothing", df)


def test_regression(spark, table):
    df = table([(float(x), float(x * x % 7), 1 + 2.0 * x - 3 * (x * x % 7)) for x in range(20)] + [(None, 1.0, 1.0)], "x double, z double, y double")
    m = regression.LinearRegression("ordinary_least_squares", "multiple")
    with pytest.raises(ValueError, match="fitted"):
        m.predict(df)
    fitted = m.fit(df, ["x", "z"], "y")
    assert [round(float(b), 6) for b in fitted.coefficients] == [1.0, 2.0, -3.0]
    assert round(m.score(df, "y")["r2"], 6) == 1.0
    small = df.withColumn("x", F.col("x") / 20)
    gd = regression.GradientDescent(learning_rate=0.05, max_iterations=5000, tolerance=1e-12).fit(small, ["x", "z"], "y")
    assert gd.loss_history[-1] < gd.loss_history[0] and abs(gd.coefficients[2] + 3) < 0.05
    batch = regression.GradientDescent(max_iterations=5, batch_size=4, seed=1).fit(small, ["x"], "y")
    assert len(batch.loss_history) == 5 and not batch.converged
    with pytest.raises(ValueError, match="no model"):
        regression.LinearRegression("nothing")
    assert regression.scores(table([(1.0,), (1.0,)], "y double"), F.col("y"), F.lit(1.0)).head()["r2"] is None


def test_report_within_a_step_is_the_report_by_join(spark, table):
    """Built-in steps are compared in their own projection; the same steps as plain functions by a join."""
    rows = [(k, f" Name {k % 3} ", None if k % 4 == 0 else "n/a" if k % 5 == 0 else str(k), float("nan") if k % 7 == 0 else float(k)) for k in range(60)] * 2
    df = table(rows, "`My Id` long, name string, amount string, `_x` double")
    names = ["fix_columns_titles", "handle_sentinel_values", "safe_conversion", "fix_not_numeric_columns", "remove_duplicates_rows", "fix_numeric_columns", "drop_constant_columns", "flag_data_quality", "drop_high_missing_columns"]
    made = pipeline.Pipeline([S.create(n) for n in names], report="full")
    plain = pipeline.Pipeline([lambda x, step=S.create(n): step(x) for n in names], report="full")
    one, two = made.run(df), plain.run(df)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and "_before" not in one.columns
    without = lambda r: [{k: v for k, v in x["metrics"].items() if k != "elapsed_ms"} for x in r.steps]
    assert without(made.report) == without(plain.report) and any(m["rows_removed"] for m in without(made.report))


def test_summary_lines(capsys):
    from cleanloom.plans.report import Change, Report

    report = Report()
    report.print_summary()
    report.add("a", Change(1, 5, 3, {"x": 0.5, "y": 0.0}, 1.234))
    report.add("mine", {"rows_removed": 2, "custom": True})
    report.print_summary()
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "The report has no steps." and out[2].split() == ["a", "1.23", "1", "1", "5", "3", "-2", "0.25"] and out[3].split()[0] == "mine"
    assert report.steps[1]["metrics"] == {"rows_removed": 2, "custom": True}

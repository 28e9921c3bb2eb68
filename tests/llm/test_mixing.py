import re

import pytest

from cleanloom.llm import mixing as M
from cleanloom.llm._common import Scratch


def rows(sizes):
    return [(1000 * s + k, "w " * (1 + (k * 7 + s) % 9), f"s{s}") for s, n in enumerate(sizes) for k in range(n)]


def test_against_sql(spark, docs, against):
    df = docs([*rows([90, 20, 10, 3]), (9000, None, "s0"), (9001, "only one", None), (9002, "  ", "empty")]).select("doc_id", "source", "text")
    out = M.mixed(spark, df).selectExpr("row.doc_id", "row.source", "epoch", "digest AS place", "tokens", "round(weight, 6) AS weight")
    against(out, M.ORACLE, documents=df)


def test_weights_and_limit(spark, docs):
    df = docs(rows([200, 40, 20]))
    out = M.mixed(spark, df, max_repeat=1.3).select("row.doc_id", "row.source", "tokens", "weight")
    per = out.groupBy("source", "doc_id").count().groupBy("source").agg({"count": "max"}).collect()
    assert all(r[1] <= 2 for r in per)
    assert out.select("doc_id").distinct().count() == df.count()  # by default no document is lost
    tokens = {r[0]: r[1] for r in out.groupBy("source").agg({"tokens": "sum"}).collect()}
    weights = {r["source"]: r["weight"] for r in out.select("source", "weight").distinct().collect()}
    total = sum(tokens.values())
    assert abs(sum(weights.values()) - 1) < 1e-9
    assert all(abs(tokens[s] / total - weights[s]) < 0.05 for s in tokens)


@pytest.mark.parametrize("entropy", [0.4, 0.8])
def test_entropy(spark, entropy):
    import math

    sources = spark.createDataFrame([(900.0,), (80.0,), (20.0,)], "tokens double")
    a, _, z = M.solve_exponent(sources, 1e9, None, entropy)
    p = [(t / 1000) ** a / z for t in (900, 80, 20)]
    assert abs(-sum(x * math.log(x) for x in p) - entropy) < 1e-6


def test_limit_with_a_budget(spark):
    sources = spark.createDataFrame([(900.0,), (80.0,), (20.0,)], "tokens double")
    a, budget, z = M.solve_exponent(sources, 2.0, 1000.0, None)
    repeats = [budget * (t / 1000) ** a / z / t for t in (900, 80, 20)]
    assert budget == 1000.0 and abs(max(repeats) - 2.0) < 1e-6


def test_budget_is_kept(spark, docs):
    out = M.mixed(spark, docs(rows([50, 50])), max_repeat=3, budget=120.0)
    assert 100 <= out.agg({"tokens": "sum"}).head()[0] <= 120


def test_edges(spark, docs):
    assert M.mixture(spark, docs([])).count() == 0
    none = docs([(1, None, "a"), (2, "", None)])
    assert sorted(r["doc_id"] for r in M.mixture(spark, none).collect()) == [1, 2]
    df = docs([(None, "a b", "a"), (1, "c d", "a"), (1, "c d", "a")])
    out = M.mixture(spark, df)
    assert out.columns == df.columns and out.count() == 3


def test_columns_keep_their_names_and_values(spark):
    names = ["_key", "_tokens", "key", "tokens", "epochs", "last", "row", "name", "left", "a.b"]
    docs = spark.createDataFrame([(k, f"text {k}", "s", *(f"{c}{k}" for c in names)) for k in range(3)], ["doc_id", "text", "source", *names])
    out = M.mixture(spark, docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_documents_without_id_are_told_apart(spark, docs):
    df = docs([*rows([60, 6]), *((None, f"word number {k}", "s1") for k in range(40)), *[(None, "one copied text", "s1")] * 5])
    out = [r["row"]["text"] for r in M.mixed(spark, df, max_repeat=3, budget=400.0).where("row.doc_id IS NULL").collect()]
    times = {out.count(f"word number {k}") for k in range(40)}
    assert len(times) == 2 and out.count("one copied text") % 5 == 0  # the last block takes some of them


def test_no_python_in_the_plan(spark, docs):
    out = M.mixture(spark, docs(rows([5, 2])))
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    assert Scratch(spark, "x").count == 0


def test_a_budget_beyond_the_limit_is_an_error(spark, docs):
    given = docs([(k, "a b c d", "xy"[k % 2]) for k in range(20)])
    with pytest.raises(ValueError, match="repeats sources over 1.5 times"):
        M.mixed(spark, given, 1.5, budget=800)
    assert M.mixed(spark, given, 1.5, budget=120).count() == 30

"""Analyzers of order, relation and division against plain Python, with ties, nulls and hot values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cleanloom.functions import special
from cleanloom.operators import analyzers, distributions, forest, ordered, relations, segments, series
from cleanloom.operators import steps as S

NAN = float("nan")


def test_tails_of_distributions():
    assert special.f_tail(4.0, 1, 10**9) == pytest.approx(math.erfc(math.sqrt(2.0)), rel=1e-6)
    assert special.f_tail(3.0, 2, 8) == pytest.approx((1 + 2 * 3.0 / 8) ** -4, rel=1e-12)  # closed form for two degrees
    assert special.incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248, rel=1e-12)  # a polynomial for whole numbers
    assert special.chi_square_tail(3.84145882, 1) == pytest.approx(0.05, rel=1e-6) and special.chi_square_tail(7.0, 2) == pytest.approx(math.exp(-3.5), rel=1e-12)
    assert special.chi_square_tail(0.0, 3) == 1.0 and special.f_tail(0.0, 2, 3) == 1.0


def test_log_of_the_normal_probability(spark):
    z = [x / 7 for x in range(-140, 60)]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", F.expr(distributions.log_below_sql("z")).alias("p")).collect()
    for r in got:
        if r.z > -37:
            assert r.p == pytest.approx(math.log(0.5 * math.erfc(-r.z / math.sqrt(2))), rel=1e-6, abs=3e-8)


@pytest.fixture
def hot(spark):
    """A third of the keys are equal, and equal rows are there many times."""
    return spark.range(3000, numPartitions=5).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 4).alias("v"))


def test_places_and_running_sums(hot):
    o = ordered.ordered(hot, ["k"])
    rows = o.running({"s": F.col("v")}).orderBy("_place").collect()
    assert [r._place for r in rows] == list(range(3000)) and [r.k for r in rows] == sorted(r.k for r in rows)
    assert [r.s for r in rows] == np.cumsum([r.v for r in rows]).tolist()
    assert max(o.sizes.values()) < 1500  # the hot key is in several ranges
    o.release()


def test_running_sums_over_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 1)], "k int, v long")
    assert [r.s for r in ordered.ordered(df, ["k"]).running({"s": F.col("v")}).orderBy("k").collect()] == [None, 5, 5, 6]
    assert ordered.ordered(df.limit(0), ["k"]).running({"s": F.col("v")}).count() == 0


@pytest.mark.parametrize("block", [2, 7, 100_000])
def test_looking_back_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK", block)
    df = spark.range(60).select(F.when(F.col("id") < 40, "big").otherwise(F.lit(None)).alias("g"), F.col("id").alias("t"), (F.col("id") * F.col("id") % 17).cast("double").alias("v"))
    w = Window.partitionBy("g").orderBy("t")
    want = df.select("t", F.avg("v").over(w.rowsBetween(-4, 0)).alias("m"), F.lag("v", 2).over(w).alias("l")).orderBy("t").collect()
    moved = analyzers.moving(df, ["g"], "t", "v", rows=5).select("t", "moving_average").orderBy("t").collect()
    assert [(r.t, r.moving_average) for r in moved] == [(r.t, r.m) for r in want]
    lagged = analyzers.lags(df, ["g"], "t", "v").orderBy("t").collect()
    assert [(r.t, None if r["diff"] is None else r.v - r["diff"]) for r in lagged] == [(r.t, r.lag) for r in lagged]
    assert [None if r.momentum is None else round(r.momentum - r.v + 2 * r.lag, 9) for r in lagged] == [r.l for r in want]
    whole = analyzers.lags(df, [], "t", "v").orderBy("t").collect()
    assert [r.lag for r in whole] == [None, *(r.v for r in whole[:-1])]


def plain_cuts(v, most, penalty):
    v, floor = np.array(v, float), penalty * math.log(len(v)) * np.var(v)
    cost = lambda a, b: float(((v[a:b] - v[a:b].mean()) ** 2).sum())
    ends, cuts = [0, len(v)], []
    while len(cuts) < most:
        found = [(cost(a, b) - cost(a, k) - cost(k, b), -k) for a, b in zip(ends, ends[1:]) for k in range(a + 1, b)]
        if not found or max(found)[0] <= floor:
            break
        cuts.append(-max(found)[1])
        ends = sorted([*ends, cuts[-1]])
    return sorted(cuts)


@pytest.mark.parametrize("seed", range(4))
def test_change_points(spark, seed):
    draw = random.Random(seed)
    v = [draw.randrange(100) + (200 if 40 <= k < 90 else 0) + (70 if k > 120 else 0) for k in range(150)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)] + [(200, None)], "k int, v long").repartition(5)
    for most, penalty in ((1, 2.0), (5, 2.0), (5, 0.0)):
        got = series.change_points(df, "k", "v", most, penalty).orderBy("place").collect()
        assert [r.place for r in got] == plain_cuts(v, most, penalty) and [r.until for r in got] == [r.place - 1 for r in got]
        ends = [0, *(r.place for r in got), len(v)]
        assert [r.mean_before for r in got] == pytest.approx([np.mean(v[a:b]) for a, b in zip(ends, ends[1:])][:-1])


def test_change_points_of_little(spark):
    one = spark.createDataFrame([(1, 2.0), (2, None), (3, NAN)], "k int, v double")
    assert series.change_points(one, "k", "v").count() == 0 and series.change_points(one.limit(0), "k", "v").count() == 0
    flat = spark.range(50).select("id", F.lit(3.0).alias("v"))
    assert series.change_points(flat, "id", "v").count() == 0


def test_risk(spark):
    draw = random.Random(3)
    v = [100.0]
    for _ in range(300):
        v.append(v[-1] * (1 + draw.gauss(0.001, 0.03)))
    row = series.risk_metrics(spark.createDataFrame([(k, x) for k, x in enumerate(v)] + [(999, NAN), (1000, None)], "k int, v double"), "k", "v", periods=252).head()
    r = np.diff(v) / np.array(v[:-1])
    worst = max(1 - v[j] / max(v[: j + 1]) for j in range(len(v)))
    q = np.quantile(r, 0.05)
    want = (301, r.mean(), r.std(ddof=1), r.mean() / r.std(ddof=1) * math.sqrt(252), -q, -r[r <= q].mean(), worst)
    assert tuple(row) == pytest.approx(want)
    assert tuple(series.risk_metrics(spark.createDataFrame([], "k int, v double"), "k", "v").head()) == (0, None, None, None, None, None, None)
    assert tuple(series.risk_metrics(spark.createDataFrame([(1, 5.0)], "k int, v double"), "k", "v").head()) == (1, None, None, None, None, None, 0.0)


def test_causality_finds_the_cause(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 50)
    draw = random.Random(5)
    x = [draw.gauss(0, 1) for _ in range(400)]
    y = [0.0, 0.0] + [0.8 * x[k - 2] + 0.3 * draw.gauss(0, 1) for k in range(2, 400)]
    got = {r.cause: r for r in series.causality(spark.createDataFrame(list(zip(range(400), x, y)), "k int, x double, y double"), "k", "x", "y", lags=2).collect()}
    a = np.array([[1, y[k - 1], y[k - 2], x[k - 1], x[k - 2]] for k in range(2, 400)])
    rss = lambda m: float(((np.array(y[2:]) - m @ np.linalg.lstsq(m, np.array(y[2:]), rcond=None)[0]) ** 2).sum())
    f = (rss(a[:, :3]) - rss(a)) / 2 / (rss(a) / (398 - 5))
    assert got["x"].f == pytest.approx(f, rel=1e-6) and got["x"].rows == 398 and got["x"].p_value < 1e-9 < 0.001 < got["y"].p_value


def test_multicollinearity(spark):
    draw = random.Random(1)
    rows = [(a := draw.gauss(0, 1), a + draw.gauss(0, 0.5), draw.gauss(1e6, 1), 2 * a + 3, 5.0) for _ in range(200)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0, 1.0), (NAN, 1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double, e double")
    got = {r["column"]: r for r in relations.multicollinearity(df).collect()}
    inverse = np.linalg.inv(np.corrcoef(np.array(rows)[:, :3].T))
    assert [got[c].vif for c in "abc"] == pytest.approx(np.diag(inverse)) and [got[c].singular for c in "abcde"] == [False] * 3 + [True] * 2
    assert relations.multicollinearity(df.limit(0)).select("vif").distinct().collect() == [(None,)]


def test_interactions(spark):
    draw = random.Random(2)
    rows = [(a := draw.gauss(5, 1), b := draw.gauss(-3, 2), c := draw.gauss(0, 1), a + b + 0.4 * a * b + draw.gauss(0, 1)) for _ in range(300)]
    got = {(r.left, r.right): r for r in relations.interaction_effects(spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0)], "a double, b double, c double, y double"), ["a", "b", "c"], "y").collect()}
    m, y = np.array(rows)[:, :3], np.array(rows)[:, 3]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        less = np.column_stack([np.ones(300), m])
        more = np.column_stack([less, m[:, i] * m[:, j]])
        rss = [float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()) for x in (less, more)]
        r = got["abc"[i], "abc"[j]]
        assert r.f == pytest.approx((rss[0] - rss[1]) / (rss[1] / 295), rel=1e-6) and r.effect == pytest.approx(np.linalg.lstsq(more, y, rcond=None)[0][-1], rel=1e-6)
    assert got["a", "b"].p_value < 1e-6 < got["b", "c"].p_value


def test_feature_selection(spark):
    rows = [("x" if k % 2 else None, "x" if k % 2 else None, "same", str(k % 5), k % 2) for k in range(100)]
    got = {r.feature: r for r in relations.feature_selection(spark.createDataFrame(rows, "a string, b string, c string, d string, y int"), ["a", "b", "c", "d"], "y").collect()}
    assert got["a"].chi_square == pytest.approx(100) and got["a"].mutual_information == pytest.approx(1) and got["a"]["rank"] == 1
    assert got["c"].p_value is None and got["c"].mutual_information == 0 and got["b"]["rank"] > 1 and got["d"].p_value == pytest.approx(1)
    few = relations.feature_selection(spark.createDataFrame(rows, "a string, b string, c string, d string, y int"), ["a", "b"], "y", most=1).collect()
    assert [r["rank"] for r in few] == [1, None]


@pytest.mark.parametrize("values", [[1.0] * 30 + [2.0] * 20 + [5.0], [draw.gauss(0, 1) for draw in [random.Random(4)] for _ in range(200)]])
def test_anderson_darling(spark, values):
    df = spark.createDataFrame([(x, 3.0) for x in [*values, NAN, None]], "v double, flat double")
    got = {r["column"]: r for r in distributions.normality_test(df).collect()}
    x, n = np.sort(values), len(values)
    f = [0.5 * math.erfc(-(v - x.mean()) / x.std(ddof=1) / math.sqrt(2)) for v in x]
    a = -n - sum((2 * i + 1) * (math.log(f[i]) + math.log(1 - f[n - 1 - i])) for i in range(n)) / n
    assert got["v"].n == n and got["v"].anderson_darling == pytest.approx(a, rel=1e-5) and (got["v"].ad_p_value > 0.05) == (n == 200)
    assert got["flat"].anderson_darling is None


@pytest.mark.parametrize(("family", "draw"), [("normal", lambda r: r.gauss(3, 2)), ("exponential", lambda r: r.expovariate(0.5)), ("uniform", lambda r: r.uniform(2, 9)), ("lognormal", lambda r: r.lognormvariate(0, 1)), ("gamma", lambda r: r.gammavariate(4, 2))])
def test_families_are_told_apart(spark, family, draw):
    r = random.Random(6)
    df = spark.createDataFrame([(draw(r),) for _ in range(3000)] + [(None,), (NAN,)], "v double")
    assert [x.family for x in distributions.distribution_type(df).where("best").collect()] == [family]


def test_distribution_of_little(spark):
    assert distributions.distribution_type(spark.createDataFrame([(None,)], "v double")).count() == 0
    assert [r.family for r in distributions.distribution_type(spark.createDataFrame([(2.0,), (2.0,)], "v double")).collect()] == ["exponential"]


def test_clusters(spark):
    draw = random.Random(8)
    rows = [(c * 10 + draw.gauss(0, 0.5), c * -7 + draw.gauss(0, 0.5), c) for c in range(4) for _ in range(100)] + [(0.0, 0.0, 0)] * 500
    df = spark.createDataFrame([*rows, (None, 1.0, -1), (NAN, 1.0, -1)], "x double, y double, c int").repartition(6)
    found, centres = segments.k_means(df, ["x", "y"], 4, seed=1)
    pairs = {(r.c, r.cluster) for r in found.select("c", "cluster").distinct().collect()}
    assert len(centres) == 4 and len({p for p in pairs if p[0] >= 0}) == 4 and (-1, None) in pairs
    assert segments.k_means(df.limit(0), ["x", "y"], 3)[0].count() == 0
    assert len(segments.k_means(df.where("c = 0").limit(5).select(F.lit(1.0).alias("x"), F.lit(1.0).alias("y")), ["x", "y"], 3)[1]) == 1


def test_population_splits_are_exact_and_stable(spark):
    df = spark.range(1000).select((F.col("id") % 700).alias("user"), F.when(F.col("id") % 700 < 400, "big").when(F.col("id") % 700 < 403, "tiny").alias("s"))
    df = df.union(spark.createDataFrame([(None, "big")], "user long, s string"))
    shares = {"a": 0.5, "b": 0.25, "c": 0.25}
    split = segments.population_splits(df, "user", shares, ["s"], "x")
    got = {(r.s, r.arm): r.n for r in split.where("user IS NOT NULL").groupBy("s", "arm").agg(F.countDistinct("user").alias("n")).collect()}
    assert got == {("big", "a"): 200, ("big", "b"): 100, ("big", "c"): 100, ("tiny", "a"): 2, ("tiny", "c"): 1, (None, "a"): 149, (None, "b"): 74, (None, "c"): 74}
    again = segments.population_splits(df.repartition(13), "user", shares, ["s"], "x")
    assert sorted(map(str, split.distinct().collect())) == sorted(map(str, again.distinct().collect())) and split.where("user IS NULL").select("arm").collect() == [(None,)]
    assert split.groupBy("user").agg(F.countDistinct("arm").alias("n")).where("n > 1").count() == 0
    assert {r.arm for r in segments.population_splits(df, "user", {"all": 1.0}).where("user = 1").collect()} == {"all"}
    assert segments.population_splits(df.limit(0), "user", shares).count() == 0


@pytest.mark.parametrize("few", [1, 3, 100_000])
def test_quantiles_leave_nan_out(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW_VALUES", few)
    df = spark.createDataFrame([(float(k % 37), NAN if k % 2 else float(k), None) for k in range(400)] + [(1.0, NAN, None)] * 3, "a double, b double, c double")
    a, b = [float(k % 37) for k in range(400)] + [1.0] * 3, [float(k) for k in range(0, 400, 2)]
    got = S.quantiles(df, [F.col("a"), F.col("b"), F.col("c")], [0.1, 0.5, 0.9])
    assert got[0] == pytest.approx(np.quantile(a, [0.1, 0.5, 0.9])) and got[1] == pytest.approx(np.quantile(b, [0.1, 0.5, 0.9])) and got[2] is None


def test_steps_take_nan_as_null(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (NAN,), (NAN,), (3.0,)], "x double")
    row = analyzers.describe(df).head()
    assert (row["count"], row["mean"], row["min"], row["q50"], row["max"]) == (2, 2.0, 1.0, 2.0, 3.0)
    assert sorted(r.x for r in S.create("fix_numeric_columns")(df).collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]
    for step in ("handle_outliers", "cap_outliers"):
        assert sorted(r.x for r in S.create(step)(df).collect() if r.x is not None)[0] >= 1.0


def test_isolation_forest(spark):
    draw = random.Random(9)
    rows = [(k, draw.gauss(0, 1), draw.gauss(5, 2)) for k in range(600)] + [(900, 9.0, -20.0), (901, None, 1.0), (902, NAN, 1.0)] + [(903, 0.0, 5.0)] * 300
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(3)
    trees, each = forest.forest(df, ["x", "y"], trees=20, rows=64, seed=1)
    assert each == 64 and len(trees) == 20 and len(trees[0].column) == 127
    got = df.select("k", "x", "y", forest.path_length([F.col("x"), F.col("y")], trees).alias("p")).where("k < 901").collect()
    assert [r.p for r in got] == pytest.approx([np.mean([t.length(np.array([r.x, r.y])) for t in trees]) for r in got])
    scores = {r.k: r.isolation_score for r in forest.isolation_scores(df, ["x", "y"]).collect()}
    assert max((s, k) for k, s in scores.items() if s is not None)[1] == 900 and scores[901] is None and scores[902] is None and scores[903] < 0.5
    assert forest.isolation_scores(df.limit(0), ["x"]).count() == 0
    assert {round(r.isolation_score, 9) for r in forest.isolation_scores(df.where("k = 903"), ["x", "y"]).collect()} == {0.5}

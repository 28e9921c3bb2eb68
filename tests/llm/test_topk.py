import numpy as np

from cleanloom.llm import topk as K


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_against_sql(spark, against):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=12)], 0) for k in range(300)]
    rows[7] = (7, rows[9][1], 0)
    rows += [(350, None, 0), (400, [], 0), (407, [], 0), (401, [None] * 12, 0), (402, [float("nan")] * 12, 0), (403, [float("inf")] + [0.0] * 11, 0), (450, [1.0] * 5, 0), (451, [2.0] * 5, 0)]
    df = vectors(spark, rows)
    got = K.top_k(spark, df, df.where("vec_id % 50 = 0"))
    against(got, K.ORACLE, embeddings=df)
    assert [tuple(r) for r in got.where("query_id = 450").collect()] == [(450, 1, 451, 256 * 512 * 5)]


def test_ties_and_small_tables(spark):
    df = vectors(spark, [(k, [1.0, 0.5], 0) for k in (0, 9, 3, 5, 7, 8, 2)])
    got = K.top_k(spark, df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 3, 5, 7, 8]
    few = vectors(spark, [(0, [1.0], 0), (1, [2.0], 0)])
    assert K.top_k(spark, few, few.where("vec_id = 0")).count() == 1
    assert K.top_k(spark, vectors(spark, []), vectors(spark, [])).count() == 0


def test_bounds_hold_and_few_vectors_pass():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(2000, 16)) * 256)
    lo = x.min(0)
    width = np.maximum(1, np.ceil((x.max(0) - lo + 1) / K.CELLS))
    cells = ((x - lo) // width).astype(np.uint8)
    low, high = K.bounds(x[:50], cells, lo, width)
    scores = x[:50] @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    ids = np.arange(2000)
    best = K.Best(ids[:50], 5, 40)
    for at in range(0, 2000, 300):
        best.add(x[:50], ids[at : at + 300], ids[at : at + 300], cells[at : at + 300], lo, width)
    rows = best.rows().to_pylist()
    assert len(rows) < 50 * 20  # exact vectors to read, of 2000 a query
    for q in range(50):
        want = sorted((-s, i) for i, s in enumerate(scores[q]) if i != q)[:5]
        assert {i for _, i in want} <= {r["rid"] for r in rows if r["query_id"] == q}


def test_further_rounds(spark, against, monkeypatch):
    """Vectors that the cells can't tell apart: more rounds, the same result."""
    monkeypatch.setattr(K, "FIRST", 1)
    monkeypatch.setattr(K, "STEP", 3)
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(k, [float(v) for v in base + rng.normal(size=8) * 0.01], 0) for k in range(200)] + [(k, [900.0 * (k - 500)] + [0.0] * 7, 0) for k in (500, 501)]
    rows += [(k, rows[3][1], 0) for k in range(600, 700)]
    df = vectors(spark, rows)
    against(K.top_k(spark, df, df.where("vec_id % 50 = 0")), K.ORACLE, embeddings=df)


def test_python_integers():
    rows = np.array([[2.0**40, 3.0], [2.0**40, 5.0]])
    assert K._exact(rows, np.array([[2.0**40, 1.0]] * 2)) == [2**80 + 3, 2**80 + 5]
    assert K._exact(rows[:, 1:], np.array([[2.0], [3.0]])) == [6, 15]


def settings(spark, **values):
    """Sets them, and returns what they were."""
    names = {k: "spark.sql." + k.replace("_", ".") for k in values}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, v in values.items():
        spark.conf.set(names[k], v) if v is not None else spark.conf.unset(names[k])
    return before


def test_vectors_are_not_broadcast(spark):
    """Packs of queries for many tasks are far larger in memory than the file that Spark judges by."""
    rng = np.random.default_rng(6)
    x = rng.integers(-9, 10, (4000, 64))
    df = vectors(spark, [(k, [float(v) / 256 for v in row], 0) for k, row in enumerate(x)])
    before = settings(spark, maxBroadcastTableSize="8m", shuffle_partitions="100")
    try:
        got = K.top_k(spark, df, df.where("vec_id % 10 = 0")).collect()
    finally:
        settings(spark, **before)
    scores = x @ x.T
    scores[np.arange(4000), np.arange(4000)] = scores.min() - 1
    first = {q: np.lexsort((np.arange(4000), -scores[q]))[:5].tolist() for q in range(0, 4000, 10)}
    assert {tuple(r) for r in got} == {(q, n + 1, v, int(scores[q, v])) for q, best in first.items() for n, v in enumerate(best)}


def test_tiles_meet_each_pair_once(spark, against, monkeypatch):
    """Many packs and segments, of two lengths, some held apart: each query meets each vector in one tile."""
    monkeypatch.setattr(K, "BLOCK", 4)
    monkeypatch.setattr(K, "SEGMENT", 8)
    monkeypatch.setattr(K, "HELD", 40_000)
    assert K.tiles(60, 6, 40, 38, 4) == (3, 2)
    rng = np.random.default_rng(7)
    df = vectors(spark, [(k, [float(v) for v in rng.normal(size=6 if k % 3 else 3)], 0) for k in range(0, 3000, 10)]).repartition(3)
    against(K.top_k(spark, df, df.where("vec_id % 50 = 0")), K.ORACLE, embeddings=df)


def test_what_is_kept_of_a_pack_is_bounded():
    """Equal bounds for all vectors: no more than asked for stays, and the bound of the rest is told."""
    q, cells, lo, width = np.ones((3, 2)), np.zeros((500, 2), np.uint8), np.zeros(2), np.full(2, 1e6)
    best = K.Best(np.arange(3), 2, 10)
    for at in range(0, 2000, 500):
        best.add(q, np.arange(at, at + 500), np.arange(at, at + 500), cells, lo, width)
        assert len(best.at) <= 3 * 500 + 2 * 3 * 10 + 4 * 3
    rows = best.rows().to_pylist()
    assert [sum(r["query_id"] == k and r["rid"] is not None for r in rows) for k in range(3)] == [10] * 3
    assert [r["query_id"] for r in rows if r["rid"] is None] == [0, 1, 2] and all(r["high"] >= 2e6 - 2 for r in rows)

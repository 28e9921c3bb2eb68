"""Exact top-k inner-product search with a vector-approximation file.

Components become integers, floor(256 x). The approximation of a vector is a byte for
each dimension, its cell on a grid of equal cells between that dimension's least and
greatest value over the corpus. Cells lie packed in segments, apart from the exact
vectors. A scan of the cells bounds every score from both sides (matrix products on the
bytes); of each query a task passes on the FIRST vectors with the greatest upper bounds,
as far as these reach the kth greatest lower bound it has seen, and the greatest bound it
left out. The exact vectors of these alone are then read, by a join. A query whose kth
score is above all that was left out is certain. The others, and there are hardly any, go
through further rounds that pass on STEP times as many, until none is left. Ties go to the
smaller vec_id.

Packed queries and segments are dealt over tiles, each some packs by some segments, and a
task reads its tile's packs first, then its segments one by one. Nothing is joined or
broadcast for that, so memory is bounded by HELD and rows of at most ROW bytes, whatever
Spark expects of sizes: tables of vectors are far larger in memory than as files, so joins
with them are merge joins by hint. Of equal vectors only those with the least
ids take part, as many as can be among the best of any query.

Vectors that are null or hold null or non-finite components, and rows without a vec_id,
take no part. A query meets the vectors of its own length only, and no row with its own
vec_id; empty vectors all score 0. Repeated rows count as rows of their own; of queries
with one vec_id the least vector counts. Fewer than k
other rows give all of them; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanloom.llm._common import Scratch, partitions

K = 5
SCALE = 256
CELLS = 256
SEGMENT = 4096
#: Queries in a row that is sent out, at most.
BLOCK = 1024
#: Bytes of a pack of queries with what is kept of it, of a segment's cells, and of all packs of a tile.
ROW, HELD = 1 << 22, 1 << 27
#: Segments of a tile, at least, where there are as many; bytes of what a tile passes on of a query, roughly.
RUN, PASSED = 4, 240
#: Queries whose bounds are in memory at once.
SLICE = 256
#: Vectors that a task passes on for each query, in multiples of k, and how these grow each round.
FIRST, STEP = 8, 16
#: Integers below this are exact as doubles.
EXACT = float(1 << 52)
TAKES_PART = "vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))"


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integers as doubles) for each length of vector in the batch."""
    ids, lists = batch.column(0).to_numpy(), batch.column(1)
    sizes = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten(), np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield ids[rows], np.floor(flat[starts[rows][:, None] + np.arange(d)] * SCALE)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, part in _by_length(batch):
            x = _stacked(part.column(1), d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, d), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(x.min(0)), pa.array(x.max(0))],
                ["dims", "d", "lo", "hi"],
            )


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector's integers, as the bytes of doubles."""
    for batch in batches:
        for ids, x in _matrices(batch):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.astype(np.int64)), pa.array(np.full(len(ids), x.shape[1]), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())],
                ["vec_id", "dims", "x"],
            )


def _stacked(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), d)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.asarray(batch.column(batch.schema.get_field_index("dims")))
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def _segments(batches: Iterator[pa.RecordBatch], grid: dict, segment: int) -> Iterator[pa.RecordBatch]:
    """Rows of at most so many vectors: their row ids and vec_ids, and cells, as bytes."""
    for batch in batches:
        for d, part in _by_length(batch):
            lo, width = grid[d]
            size = max(1, min(segment, ROW // max(1, d)))
            for at in range(0, part.num_rows, size):
                own = part.slice(at, size)
                cells = np.clip((_stacked(own.column(2), d) - lo) // width, 0, CELLS - 1).astype(np.uint8)
                rid, ids = (np.asarray(own.column(k)).astype(np.int64) for k in (0, 3))
                columns = [pa.array([x.tobytes()], pa.binary()) for x in (rid, ids, cells)]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), *columns], ["dims", "rids", "ids", "x"])


def _held(d: int, most: int) -> int:
    """Bytes that a task holds for a query: its components, and the best twice, before and after they are put in order."""
    return 8 * d + 48 * most


def _packs(batches: Iterator[pa.RecordBatch], most: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows of at most so many queries, without row ids."""
    for batch in batches:
        for d, part in _by_length(batch):
            size = max(1, min(block, ROW // _held(d, most)))
            for at in range(0, part.num_rows, size):
                own = part.slice(at, size)
                columns = [pa.array([np.asarray(own.column(0)).astype(np.int64).tobytes()], pa.binary()), pa.array([b"".join(own.column(2).to_pylist())], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.nulls(1, pa.binary()), *columns], ["dims", "rids", "ids", "x"])


def tiles(queries: int, d: int, most: int, segments: int, tasks: int) -> tuple[int, int]:
    """Into how many parts packs and segments are dealt, for about as many tiles as tasks.

    Packs, and what is passed on, are multiplied by the parts of segments, and segments by
    those of packs, so both sides get about the same bytes.
    """
    packs = -(-queries // max(1, min(BLOCK, ROW // _held(d, most))))
    least = max(1, -(-queries * _held(d, most) // HELD))
    even = round((tasks * queries * (8 * d + PASSED) / max(1, segments * SEGMENT * (d + 16))) ** 0.5)
    down = max(least, min(packs, even))
    across = max(1, min(-(-tasks // down), -(-segments // RUN)))
    return max(down, min(packs, -(-tasks // across))), across


def _dealt(df: DataFrame, parts: int, name: str) -> DataFrame:
    """Numbers rows from 0 to parts - 1, in turn within each partition."""
    at = F.col("_at")
    turn = F.shiftright(at, 33) * 7919 + at.bitwiseAND((1 << 33) - 1)
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn(name, (turn % parts).cast("int")).drop("_at")


def _margins(q: np.ndarray, lo: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each query adds to its products with cells for a lower and an upper bound."""
    fixed, slack = q @ lo, 2e-9 * (1 + np.abs(q) @ (np.abs(lo) + CELLS * width))  # above rounding
    return fixed + np.minimum(q, 0) @ (width - 1) - slack, fixed + np.maximum(q, 0) @ (width - 1) + slack


def bounds(q: np.ndarray, cells: np.ndarray, lo: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of queries (rows of q) and vectors (rows of cells).

    A component in cell c is at least lo + c width, and less than lo + (c + 1) width.
    """
    base, (down, up) = (q * width) @ cells.astype(np.float64).T, _margins(q, lo, width)
    return base + down[:, None], base + up[:, None]


class Best:
    """Of one block of queries, the vectors with the greatest bounds so far, and the greatest bound left out.

    Both bounds of a query's scores are its products with cells, and a margin that is the
    same for all vectors, so products are compared: below ``cut``, the kth greatest less the
    distance of the margins, nothing is among the best.
    """

    def __init__(self, qids: np.ndarray, k: int, most: int):
        self.qids, self.k, self.most, n = qids, k, most, len(qids)
        self.order = np.argsort(qids, kind="stable")
        self.at, self.rid, self.base, self.kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        self.cut, self.left = np.full(n, -np.inf), np.full(n, -np.inf)
        self.down, self.up = np.zeros(n), np.zeros(n)

    def add(self, q: np.ndarray, rids: np.ndarray, ids: np.ndarray, cells: np.ndarray, lo: np.ndarray, width: np.ndarray) -> None:
        self.down, self.up = _margins(q, lo, width)
        scaled = q * width
        kind = np.float32 if (np.abs(scaled).sum(1) * (CELLS - 1)).max(initial=0) < 1 << 24 else np.float64  # integers, so exact
        scaled, columns = scaled.astype(kind), cells.T.astype(kind)
        place = self.order[np.minimum(np.searchsorted(self.qids, ids, sorter=self.order), len(q) - 1)]
        own = np.flatnonzero(self.qids[place] == ids)
        for at in range(0, len(q), SLICE):
            rows = slice(at, at + SLICE)
            base = scaled[rows] @ columns
            mine = own[(place[own] >= at) & (place[own] < at + SLICE)]
            base[place[mine] - at, mine] = -np.inf
            cut = self.cut[rows]
            if len(rids) >= self.k and np.isneginf(cut).any():
                kth = np.partition(base, len(rids) - self.k, axis=1)[:, len(rids) - self.k].astype(np.float64)
                cut = np.maximum(cut, kth - (self.up - self.down)[rows])
            floor = np.nextafter(cut.astype(kind), kind(-np.inf))
            r, c = np.divmod(np.flatnonzero(base >= floor[:, None]), len(rids))
            value = base[r, c].astype(np.float64)
            there = np.flatnonzero(np.isfinite(value))
            self.at, self.rid, self.base = (np.concatenate(x) for x in ((self.at, r[there] + at), (self.rid, rids[c[there]]), (self.base, value[there])))
            if len(self.at) > 2 * self.kept + 4 * len(q):
                self._order()

    def _order(self) -> None:
        """Keeps the greatest of each query alone."""
        order = np.lexsort((-self.base, self.at))
        at, base, rid = self.at[order], self.base[order], self.rid[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kth = rank == self.k - 1
        self.cut[at[kth]] = np.maximum(self.cut[at[kth]], base[kth] - (self.up - self.down)[at[kth]])
        near = base >= self.cut[at]
        out = near & (rank == self.most)
        self.left[at[out]] = np.maximum(self.left[at[out]], base[out])
        near &= rank < self.most
        self.at, self.base, self.rid, self.kept = at[near], base[near], rid[near], int(near.sum())

    def rows(self) -> pa.RecordBatch:
        """(query_id, rid, low, high) of what is kept, and (query_id, null, null, bound) of what was left out."""
        self._order()
        out = np.flatnonzero(np.isfinite(self.left))
        rid = pa.concat_arrays([pa.array(self.rid), pa.nulls(len(out), pa.int64())])
        low = pa.concat_arrays([pa.array(self.base + self.down[self.at]), pa.nulls(len(out), pa.float64())])
        high = np.concatenate([self.base + self.up[self.at], self.left[out] + self.up[out]])
        return pa.RecordBatch.from_arrays([pa.array(self.qids[np.concatenate([self.at, out])]), rid, low, pa.array(high)], ["query_id", "rid", "low", "high"])


def _scan(batches: Iterator[pa.RecordBatch], k: int, most: int, grid: dict) -> Iterator[pa.RecordBatch]:
    """The best of each pack of queries over the segments that follow the packs of its length."""
    dims, packs = None, []
    for batch in batches:
        for n in range(batch.num_rows):
            d, rids, ids, x = (column[n].as_py() for column in batch.columns)
            ids = np.frombuffer(ids, np.int64)
            if d != dims:
                yield from (best.rows() for best, _ in packs)
                dims, packs = d, []
            if rids is None:
                packs.append((Best(ids, k, most), np.frombuffer(x, np.float64).reshape(len(ids), d)))
                continue
            for best, q in packs:
                best.add(q, np.frombuffer(rids, np.int64), ids, np.frombuffer(x, np.uint8).reshape(len(ids), d), *grid[d])
    yield from (best.rows() for best, _ in packs)


def _exact(rows: np.ndarray, q: np.ndarray) -> list[int]:
    """Integer inner products of rows of two tables, whatever their size."""
    if np.abs(rows).max(initial=1) * np.abs(q).max(initial=1) * max(1, rows.shape[1]) < EXACT:
        return (rows * q).sum(1).astype(np.int64).tolist()
    return [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(rows, q, strict=True)]


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, part in _by_length(batch):
            scores = _exact(_stacked(part.column(3), d), _stacked(part.column(4), d))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of every query.

    ``queries`` and ``vectors`` have vec_id and embedding.
    """
    scratch = Scratch(spark, "topk")
    whole = lambda df: df.where(TAKES_PART).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_integers, "vec_id long, dims int, x binary")
    given = scratch.cut(whole(vectors), "given")
    few = given  # of an equal vector k rows of an id, and of all ids twice as many, as one id may be the query's own
    for of, n in ((["dims", "x", "vec_id"], k), (["dims", "x"], 2 * k)):
        few = few.withColumn("n", F.row_number().over(Window.partitionBy(*of).orderBy("vec_id"))).where(F.col("n") <= n).drop("n")
    rows = scratch.cut(few.select(F.monotonically_increasing_id().alias("rid"), "dims", "x", "vec_id"), "rows")
    asked = whole(queries).groupBy("vec_id").agg(F.min(F.struct("dims", "x")).alias("v")).select("vec_id", "v.dims", "v.x")
    asked = scratch.cut(asked, "asked")
    measured = rows.select("dims", "x").mapInArrow(_ranges, "dims int, d int, lo double, hi double").groupBy("dims", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    grid: dict = {0: (np.empty(0), np.empty(0))}
    for row in sorted(measured.collect()):  # a row for each dimension
        grid.setdefault(row["dims"], []).append((row["lo"], max(1.0, np.ceil((row["hi"] - row["lo"] + 1) / CELLS))))
    grid = {d: (np.array([x[0] for x in v]), np.array([x[1] for x in v])) if d else v for d, v in grid.items()}
    scratch.drop(given)
    cells = scratch.cut(rows.mapInArrow(lambda it, segment=SEGMENT: _segments(it, grid, segment), "dims int, rids binary, ids binary, x binary"), "cells")
    done, most = [], FIRST * k
    while True:
        down, across = tiles(asked.count(), max(grid), most, cells.count(), partitions(spark))
        packs = asked.mapInArrow(lambda it, most=most, block=BLOCK: _packs(it, most, block), "dims int, rids binary, ids binary, x binary")
        packs = _dealt(packs, down, "i").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        there = _dealt(cells, across, "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
        tiled = packs.unionByName(there).repartitionById(down * across, F.col("i") * across + F.col("j"))
        tiled = tiled.sortWithinPartitions("dims", F.col("rids").isNotNull()).select("dims", "rids", "ids", "x")
        hits = tiled.mapInArrow(lambda it, most=most: _scan(it, k, most, grid), "query_id long, rid long, low double, high double")
        order = Window.partitionBy("query_id").orderBy(F.col("rid").isNull(), F.desc("high"))
        ranked = hits.withColumn("n", F.row_number().over(order)).withColumn("kth", F.nth_value("low", k).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        ranked = ranked.where(F.col("kth").isNull() | (F.col("high") >= F.col("kth")))
        hits = scratch.cut(ranked.select("query_id", "rid", "high", "n"), "hits")
        left = scratch.cut(hits.where((F.col("n") > most) | F.col("rid").isNull()).groupBy("query_id").agg(F.max("high").alias("left")), "left")
        near = hits.where((F.col("n") <= most) & F.col("rid").isNotNull()).join(rows.hint("merge"), "rid")
        both = near.join(asked.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")).hint("merge"), "query_id")
        named = both.select("query_id", "vec_id", "dims", "x", "q").mapInArrow(_score, "query_id long, vec_id long, score long")
        best = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        best = scratch.cut(best.select("query_id", "rank", "vec_id", "score"), "best")
        kth = best.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        open_ = left.join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("n") < k) | (F.col("kth") <= F.col("left"))).select("query_id")
        open_ = scratch.cut(open_, "open")
        done.append(best.join(open_, "query_id", "left_anti"))
        scratch.drop(hits, left)
        if open_.isEmpty():
            return reduce(DataFrame.union, done)
        asked = scratch.cut(asked.join(open_, F.col("vec_id") == F.col("query_id"), "left_semi"), "asked")
        most *= STEP


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(spark, vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_inner_product(q.e, c.e), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

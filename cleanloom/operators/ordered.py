"""Rows in one total order that spreads over tasks: dense places, running sums, neighbours.

Rows are dealt by ranges of the keys, a hash of the row and its place at reading, sorted
within the ranges and written to the shared folder once. So keys with many equal values
spread too, and a range is no larger than a task's share. Places follow from the ranges' row counts,
running sums from their totals (a row for each range on the driver), and windows that look
back a few rows run over blocks of places, each with the last rows of the block before it.

The table stays in the shared folder while a result reads it; ``release`` removes it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.functions.inference import ref
from cleanloom.operators.steps import numbered
from cleanloom.plans import tables

#: Rows of a block, not counting those that it takes from the block before.
BLOCK = 100_000


def within() -> WindowSpec:
    """From the beginning of a row's range up to the row."""
    return Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class Ordered:
    """``table`` has the caller's columns, _range and _place, which counts from 0 in the order of all rows."""

    table: DataFrame
    sizes: dict[int, int]
    path: str

    @property
    def n(self) -> int:
        return sum(self.sizes.values())

    def running(self, sums: dict[str, Column]) -> DataFrame:
        """The table with running sums: those within each range, and the totals of the ranges before it."""
        valued = self.table.withColumns({f"_of_{k}": x for k, x in sums.items()})
        totals = valued.groupBy("_range").agg(*(F.sum(f"_of_{k}").alias(k) for k in sums))
        schema = T.StructType([T.StructField("_range", T.IntegerType()), *(T.StructField(f"_before_{k}", totals.schema[k].dataType) for k in sums)])
        rows, before = [], [None] * len(sums)
        for r in sorted(totals.collect()):  # a row for each range
            rows.append((r["_range"], *before))
            before = [b if r[k] is None else r[k] if b is None else b + r[k] for k, b in zip(sums, before, strict=True)]
        offsets = F.broadcast(self.table.sparkSession.createDataFrame(rows, schema))
        own = valued.withColumns({f"_own_{k}": F.sum(f"_of_{k}").over(within()) for k in sums}).join(offsets, "_range")
        both = {k: F.coalesce(F.col(f"_own_{k}") + F.col(f"_before_{k}"), F.col(f"_own_{k}"), F.col(f"_before_{k}")) for k in sums}
        return own.select(*self.table.columns, *(x.alias(k) for k, x in both.items()))

    def blocks(self, back: int) -> DataFrame:
        """The table with _block and _again: the last ``back`` rows of a block are there once more in the next, marked."""
        size = max(BLOCK, 2 * back)
        own = F.floor(F.col("_place") / size).cast("long")
        both = F.when(F.col("_place") % size >= size - back, F.array(own, own + 1)).otherwise(F.array(own))
        return self.table.select("*", own.alias("_own"), F.explode(both).alias("_block")).withColumn("_again", F.col("_block") != F.col("_own")).drop("_own")

    def release(self) -> None:
        tables.remove(self.table.sparkSession, self.path)


def ordered(df: DataFrame, keys: Iterable[str]) -> Ordered:
    """The rows of ``df`` by ``keys``, nulls first; ties by a hash of the row, equal rows as they are read."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [ref(f.name) for f in df.schema if "map" not in f.dataType.simpleString()]
    order = [*(ref(k) for k in keys), F.col("_tie"), F.col("_no")]
    tied = df.withColumns({"_tie": F.xxhash64(*hashed), "_no": F.monotonically_increasing_id()})
    ranged = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie", "_no").withColumn("_place", F.monotonically_increasing_id())
    table, path = tables.written(ranged, "ordered")
    table = table.withColumn("_range", F.shiftright("_place", 33).cast("int"))
    sizes = {r["_range"]: r["count"] for r in table.groupBy("_range").count().collect()}  # a row for each range
    return Ordered(numbered(table, "_place", F.col("_place"), sizes), sizes, path)


def looked_back(df: DataFrame, by: list[str], order: str | list[str], back: int, new) -> DataFrame:
    """``df`` with the columns ``new(window)``, a window over the rows of a group in order that sees ``back`` rows before each.

    Groups of any size spread over tasks.
    """
    keys = [order] if isinstance(order, str) else list(order)
    blocks = ordered(df, [*by, *keys]).blocks(back)
    window = Window.partitionBy("_block", *(ref(c) for c in by)).orderBy("_place")
    return blocks.withColumns(new(window)).where(~F.col("_again")).drop("_place", "_range", "_block", "_again")

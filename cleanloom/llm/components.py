"""Distributed union-find over an edge table (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm._common import Scratch


def connected_components(
    spark: SparkSession, edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b"
) -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach.

    ``edges`` has two columns of one orderable type; direction, repeats and loops don't
    matter, and edges with a null end are no edges. Returns (node, root); an empty edge
    table gives an empty result. Each round is two aggregations with map-side combine and
    two equi-joins; no node's neighbours are gathered in one place. Rounds are
    logarithmic in the longest chain, and each ends in a table in the shared folder. The
    least of each node is such a table too: adaptive execution splits a skewed join only
    if nothing stands between it and the shuffle.
    """
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = scratch.cut(e, "edges")
    state = _state(e)
    while state[0]:
        # large-star: of all neighbours of u, those above u are hung under the least
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        # small-star: of the neighbours below u, all and u itself are hung under the least
        large = scratch.cut(large, "large")
        low = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new = scratch.cut(small, "edges")
        scratch.drop(e, least, large, low)
        e, before, state = new, state, _state(new)
        if state == before:
            break
    own = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return own.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table; equal states end the rounds."""
    row = e.agg(
        F.count("*").alias("n"),
        F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("s"),
        F.bit_xor(F.xxhash64("v", "u")).alias("x"),
    ).head()
    return (row["n"], row["s"], row["x"])

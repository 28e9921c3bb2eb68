"""Analyzers that divide rows: customers by value and by clusters, populations by exact shares."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.functions.inference import ref
from cleanloom.operators.ordered import ordered
from cleanloom.operators.series import filled
from cleanloom.plans import tables

#: A key's draw has HASH_BITS bits, found DIGIT bits at a time.
HASH_BITS, DIGIT = 60, 12


def rfm(df: DataFrame, customer: str, time: str, money: str, bins: int = 5) -> DataFrame:
    """(customer, last, frequency, monetary, r, f, m): how recent, frequent and valuable each customer is, with scores from 1 to ``bins``.

    Scores divide the customers' places in order of a measure, ties by customer, into equal
    parts. The places are those of range-sorted tables, so no task ranks all customers.
    """
    c = ref(customer)
    out = df.where(c.isNotNull()).groupBy(c.alias(customer)).agg(F.max(ref(time)).alias("last"), F.count("*").alias("frequency"), F.sum(ref(money).cast("double")).alias("monetary"))
    before = None
    for measure, score in (("last", "r"), ("frequency", "f"), ("monetary", "m")):
        o = ordered(out, [measure, customer])
        if before is not None:
            before.release()
        before = o
        out = o.table.withColumn(score, (F.floor(F.col("_place") * bins / F.lit(max(1, o.n))) + 1).cast("int")).drop("_place", "_range")
    return out


def _nearest(x: list[Column], centres: np.ndarray) -> Column:
    """(d, j): squared distance and number of the nearest centre, the first of equals."""
    square = lambda c: sum(((a - F.lit(float(v))) * (a - F.lit(float(v))) for a, v in zip(x, c, strict=True)), F.lit(0.0))
    return F.array_min(F.array(*(F.struct(square(c).alias("d"), F.lit(j).alias("j")) for j, c in enumerate(centres))))


def _seeded(table: DataFrame, x: list[Column], k: int, rounds: int, seed: int) -> np.ndarray:
    """Starting centres: in each round rows are drawn in parallel, about 2k, by their share of all squared distances; k are chosen of these."""
    draw = lambda r: F.pmod(F.xxhash64(*x, F.lit(seed), F.lit(r)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    first = table.orderBy(draw(0), *x).limit(1).collect()
    centres = np.array([[float(v) for v in r] for r in first])
    for r in range(1, rounds + 1):
        near = table.select(*x, _nearest(x, centres)["d"].alias("_d"))
        total = near.agg(F.sum("_d")).head()[0]
        if not total:
            break
        drawn = near.where(draw(r) * F.lit(total) < 2 * k * F.col("_d")).select(*x).distinct().collect()  # about 2k rows
        centres = np.vstack([centres, *([float(v) for v in row] for row in sorted(drawn))])
    weights = np.zeros(len(centres))
    for r in table.select(_nearest(x, centres)["j"].alias("j")).groupBy("j").count().collect():  # a row for each candidate
        weights[r["j"]] = r["count"]
    chosen = [int(np.argmax(weights))]
    while len(chosen) < min(k, len(np.unique(centres, axis=0))):
        d = np.min(((centres[:, None, :] - centres[chosen][None]) ** 2).sum(axis=2), axis=1)
        chosen.append(int(np.argmax(d * weights)) if (d * weights).max() > 0 else int(np.argmax(d)))
    return centres[chosen]


def k_means(df: DataFrame, columns: list[str], k: int, rounds: int = 20, seed: int = 0, centres: list[list[float]] | None = None, tolerance: float = 1e-6, seed_rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """``df`` with column cluster, from 0, and the centres: Lloyd's rounds from ``centres`` or from seeds drawn in parallel.

    Rows with a null or NaN in a column have a null cluster. A round is one aggregation with
    map-side combine of a row for each cluster; a cluster that loses its rows keeps its centre.
    Centres are in order of their coordinates unless they were given. Draws are by a hash of
    the row, so equal rows are drawn together, and as one.
    """
    x = [F.col(f"x{j}") for j in range(len(columns))]
    table, path = tables.written(filled(df, columns).select(*(ref(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns))), "points")
    if table.isEmpty():
        tables.remove(df.sparkSession, path)
        return df.withColumn("cluster", F.lit(None).cast("int")), np.zeros((0, len(columns)))
    at = np.array(centres, float) if centres is not None else _seeded(table, x, k, seed_rounds, seed)
    for _ in range(rounds):
        assigned = table.select(*x, _nearest(x, at)["j"].alias("j"))
        new = at.copy()
        for r in assigned.groupBy("j").agg(*(F.avg(c) for c in x)).collect():  # a row for each cluster
            new[r["j"]] = r[1:]
        moved = float(np.abs(new - at).max())
        at = new
        if moved <= tolerance:
            break
    tables.remove(df.sparkSession, path)
    if centres is None:
        at = at[np.lexsort(at.T[::-1])]
    known = [F.nanvl(ref(c).cast("double"), F.lit(None)) for c in columns]
    whole = sum((F.when(c.isNull(), 1).otherwise(0) for c in known), F.lit(0)) == 0
    return df.withColumn("cluster", F.when(whole, _nearest(known, at)["j"])), at


def customer_segments(df: DataFrame, customer: str, time: str, money: str, k: int = 4, bins: int = 5, seed: int = 0) -> DataFrame:
    """rfm's columns and cluster: customers grouped by k-means on their three scores."""
    return k_means(rfm(df, customer, time, money, bins), ["r", "f", "m"], k, seed=seed)[0]


def draw(key: Column, salt: str) -> Column:
    """HASH_BITS bits of a key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), key.cast("string")), 256), 1, HASH_BITS // 4), 16, 10).cast("long")


def population_splits(df: DataFrame, key: str, shares: dict[str, float], strata: list[str] | None = None, salt: str = "") -> DataFrame:
    """``df`` with column arm: keys dealt to arms by exact shares of every stratum.

    A key's draw depends on key and salt only, so rows of a key share an arm whatever the
    partitioning. In a stratum of n different keys arm j ends with the key of rank floor(n * (shares up to j) + 1/2) in
    order of draws. The draws at these ranks are selected without a sort: counts by their
    first DIGIT bits tell where a rank lies, then counts of the next bits inside that, and
    so on; a row for each bin and stratum moves, not the keys. Null keys have a null arm. Keys of equal draws (2^-60 of the pairs) stay together.
    """
    if abs(sum(shares.values()) - 1) > 1e-9 or min(shares.values()) < 0:
        raise ValueError("shares are positive and sum to 1")
    spark, bins, names = df.sparkSession, 1 << DIGIT, list(shares)
    stratum = F.to_json(F.struct(*(ref(c) for c in strata)), {"ignoreNullFields": "false"}) if strata else F.lit("")
    placed = df.withColumns({"_s": stratum, "_h": draw(ref(key), salt)})
    units, path = tables.written(placed.where(ref(key).isNotNull()).select("_s", ref(key).alias("_k"), "_h").distinct().select("_s", "_h"), "units")
    sizes = units.groupBy("_s").agg(F.count("*").alias("n"))
    ends = [sum(list(shares.values())[: j + 1]) for j in range(len(names) - 1)]
    asked = F.array(*(F.struct(F.lit(j).alias("j"), F.floor(F.col("n") * F.lit(e) + F.lit(0.5)).alias("rank")) for j, e in enumerate(ends)))
    if not ends:
        tables.remove(spark, path)
        return placed.withColumn("arm", F.when(ref(key).isNotNull(), names[0])).drop("_s", "_h")
    state, held = tables.written(sizes.select("_s", F.inline(asked)).select("*", F.lit(0).cast("long").alias("prefix")), "ranks")
    for shift in range(HASH_BITS - DIGIT, -1, -DIGIT):
        prefix, digit = F.shiftright("_h", shift + DIGIT), F.shiftright("_h", shift) % bins
        live = state.where("rank > 0").select("_s", "prefix").distinct()
        counts = units.select("_s", prefix.alias("prefix"), digit.alias("digit")).join(live, ["_s", "prefix"]).groupBy("_s", "prefix", "digit").agg(F.count("*").alias("n"))
        # at most 2^DIGIT rows of a stratum and prefix
        upto = F.sum("n").over(Window.partitionBy("_s", "prefix").orderBy("digit"))
        found = counts.withColumn("upto", upto).join(state, ["_s", "prefix"]).where("rank > upto - n AND rank <= upto")
        none = state.where("rank <= 0")
        new = found.select("_s", "j", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), (F.col("prefix") * bins + F.col("digit")).alias("prefix"))
        before = held
        state, held = tables.written(new.unionByName(none.select("_s", "j", "rank", "prefix")), "ranks")
        tables.remove(spark, before)
    tables.remove(spark, path)
    limit = F.when(F.col("rank") > 0, F.col("prefix")).otherwise(-1)
    limits, _ = tables.written(state.groupBy("_s").agg(F.array_sort(F.collect_list(F.struct("j", limit.alias("limit")))).alias("limits")), "limits")  # a row for each arm but one
    tables.remove(spark, held)
    over = F.size(F.filter("limits", lambda x: x["limit"] < F.col("_h")))
    arm = F.array(*(F.lit(x) for x in names))[over]
    out = placed.join(limits, "_s", "left").withColumn("arm", F.when(ref(key).isNotNull(), arm))
    return out.select(*(ref(c) for c in df.columns), "arm")

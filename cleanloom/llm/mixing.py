"""Temperature mixing of sources, with DataFrame functions only.

A source's weight is its share of the tokens (words) to the power of an exponent, over
the sum of these. The exponent between 0 (all alike) and 1 (as they are) is bisected to
the least that keeps every source within a limit of repetitions, or to one that meets a
target entropy if that is given and keeps within the limit. Rounds evaluate a grid of
exponents in one aggregation over the table of sources; only the sums come to the driver.

The budget is a number of tokens; by default it is the least that uses every document of
every source at least once. Weight x budget tokens are dealt to a source in blocks: each
epoch is a block with all its documents in an order of its own, by a digest of doc_id and
epoch, and the last block takes documents in that order while their tokens fit. Where
that block ends is found by sums over slices of the digest, then inside the one slice;
documents are then dealt by comparing their digest with it, so texts aren't shuffled and
no source is in one task.

A null source is a source of its own. Null text has no tokens; a source without tokens
goes out once, whole. A document without an id is known by a hash of its text. Documents
with equal digests (repeated rows) stay or go together, and count together before any
window sees them. Columns pass through, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from cleanloom.llm._common import Scratch, row_of

MAX_REPEAT = 1.5
GRID, TURNS = 32, 8
#: Hex digits of the digest that make a slice.
SLICE = 4


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _named(docs: DataFrame) -> list[Column]:
    """What the plan knows of each document: its source, its id or else a hash of its text, and its tokens."""
    source = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit(""))
    own = F.concat(F.lit("?"), F.md5(F.coalesce(docs["text"], F.lit(""))))
    return [source.alias("key"), F.coalesce(docs["doc_id"].cast("string"), own).alias("name"), tokens(docs["text"]).alias("tokens")]


def _digest(epoch: Column) -> Column:
    """The place of a document in the order of an epoch."""
    return F.md5(F.concat(F.col("name"), F.lit(":"), epoch.cast("string")))


def solve_exponent(sources: DataFrame, max_repeat: float, budget: float | None, entropy: float | None) -> tuple[float, float, float]:
    """(exponent, budget, sum of shares to the exponent) for a table with positive ``tokens``."""
    ends = sources.agg(F.sum("tokens").alias("all"), F.min("tokens").alias("low"), F.max("tokens").alias("high")).head()
    total, low, high = float(ends["all"]), ends["low"] / ends["all"], ends["high"] / ends["all"]
    if budget is not None and budget > max_repeat * total * (1 + 1e-9):  # even in their own shares sources repeat more often
        raise ValueError(f"a budget of {budget} words of {total:.0f} repeats sources over {max_repeat} times")
    log = F.log(F.col("tokens") / F.lit(total))

    def measure(exponents: list[float]) -> list[tuple[float, float]]:
        """(sum of powers, entropy) at each exponent, in one job."""
        powers = [F.exp(log * a) for a in exponents]
        row = sources.agg(*(F.struct(F.sum(p).alias("z"), F.sum(p * log).alias("s")).alias(f"x{k}") for k, p in enumerate(powers))).head()
        return [(x["z"], math.log(x["z"]) - a * x["s"] / x["z"]) for a, x in zip(exponents, row, strict=True)]

    def spend(a: float, z: float) -> float:
        """The budget: as given, or just enough for the largest source."""
        return budget if budget is not None else total * z * high ** (1 - a)

    def bisect(fits) -> float:
        """Least exponent that fits; fits() is false below it."""
        left, right = 0.0, 1.0
        for _ in range(TURNS):
            grid = [left + (right - left) * k / (GRID - 1) for k in range(GRID)]
            at = next((k for k, (a, m) in enumerate(zip(grid, measure(grid), strict=True)) if fits(a, *m)), GRID - 1)
            left, right = grid[max(0, at - 1)], grid[at]
        return right

    a = bisect(lambda a, z, _: spend(a, z) * low ** (a - 1) / (z * total) <= max_repeat)
    if entropy is not None:
        a = max(a, bisect(lambda a, _, h: h <= entropy))
    z = measure([a])[0][0]
    return a, spend(a, z), z


def plan(docs: DataFrame, scratch: Scratch, max_repeat: float, budget: float | None, entropy: float | None) -> tuple[DataFrame, DataFrame]:
    """(sized, sources): documents' names and tokens; each source's weight, whole epochs and tokens of the last."""
    sized = scratch.cut(docs.select(*_named(docs)), "sized")
    sums = scratch.cut(sized.groupBy("key").agg(F.sum("tokens").alias("tokens")), "sums")
    some = sums.where("tokens > 0")
    if some.isEmpty():
        return sized, sums.select("key", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("epochs"), F.lit(0.0).alias("left"))
    a, spend, z = solve_exponent(some, max_repeat, budget, entropy)
    total = F.lit(float(some.agg(F.sum("tokens")).head()[0]))
    weight = F.when(F.col("tokens") > 0, F.exp(F.log(F.col("tokens") / total) * a) / F.lit(z)).otherwise(0.0)
    epochs = F.when(F.col("tokens") > 0, F.col("weight") * spend / F.col("tokens")).otherwise(1.0)
    whole = F.floor(epochs + 1e-9)
    dealt = sums.withColumn("weight", weight).select("key", "weight", whole.alias("epochs"), ((epochs - whole) * F.col("tokens")).alias("left"))
    return sized, dealt


def last_blocks(sized: DataFrame, dealt: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, last): the greatest digest that the last, partial block of a source takes."""
    part = dealt.where("`left` > 0").select("key", "epochs", "left")
    placed = sized.join(part, "key").select("key", "left", "tokens", _digest(F.col("epochs")).alias("digest"))
    placed = placed.groupBy("key", "digest").agg(F.sum("tokens").alias("tokens"), F.first("left").alias("left")).withColumn("slice", F.substring("digest", 1, SLICE))
    placed = scratch.cut(placed, "placed")
    slices = placed.groupBy("key", "slice").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    begun = scratch.cut(slices.withColumn("before", F.coalesce(before, F.lit(0))).select("key", "slice", "before"), "slices")
    within = F.sum("tokens").over(Window.partitionBy("key", "slice").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))
    # slices that begin past the budget take no part; of the others, digests whose sum fits
    fits = placed.join(begun, ["key", "slice"]).where("before <= `left`").withColumn("sum", F.col("before") + within)
    last = scratch.cut(fits.where("sum <= `left`").groupBy("key").agg(F.max("digest").alias("last")), "last")
    scratch.drop(placed, begun)
    return last


def mixed(
    spark: SparkSession, docs: DataFrame, max_repeat: float = MAX_REPEAT, budget: float | None = None, entropy: float | None = None
) -> DataFrame:
    """(row, epoch, digest, tokens, weight): the rows of ``docs`` dealt by weight; a document is there once for each epoch."""
    scratch = Scratch(spark, "mixing")
    sized, dealt = plan(docs, scratch, max_repeat, budget, entropy)
    dealt = scratch.cut(dealt, "dealt")
    last = last_blocks(sized, dealt, scratch)
    of = scratch.cut(dealt.join(last, "key", "left").select("key", "weight", "epochs", "last"), "sources")
    scratch.drop(sized, dealt, last)
    joined = docs.select(row_of(docs).alias("row"), *_named(docs)).join(of, "key")
    more = F.col("last").isNotNull() & (_digest(F.col("epochs")) <= F.col("last"))
    epochs = F.when(more, F.col("epochs") + 1).otherwise(F.col("epochs"))
    out = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs))).where(F.col("epoch") < epochs)
    return out.select("row", "epoch", _digest(F.col("epoch")).alias("digest"), "tokens", "weight")


def mixture(spark: SparkSession, docs: DataFrame, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """The mixed documents, with the columns of ``docs``."""
    return mixed(spark, docs, max_repeat).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(spark, docs).select("row.doc_id", "row.source", "epoch", F.col("digest").alias("place"), "tokens", F.round("weight", 6).alias("weight"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k,
         CAST(coalesce(len(regexp_extract_all(text, '\\S+')), 0) AS BIGINT) AS tokens FROM documents
), s AS (SELECT k, sum(tokens) AS t FROM d GROUP BY k
), e AS (SELECT CASE WHEN max(t) = min(t) THEN 0.0 ELSE greatest(0.0, 1 - ln({MAX_REPEAT}) / ln(max(t)::DOUBLE / min(t))) END AS a,
                max(t)::DOUBLE AS top FROM s WHERE t > 0
), w AS (SELECT k, t, CASE WHEN t > 0 THEN pow(t / top, a) ELSE 0 END AS p,
                CASE WHEN t > 0 THEN pow(top / t, 1 - a) ELSE 1 END AS epochs FROM s, e
), n AS (SELECT k, p / (SELECT sum(p) FROM w) AS weight, CAST(floor(epochs + 1e-9) AS BIGINT) AS whole,
                (epochs - floor(epochs + 1e-9)) * t AS rest FROM w
), f AS (SELECT d.*, n.weight, n.whole, n.rest FROM d JOIN n USING (k)
), l AS (SELECT *, sum(tokens) OVER (PARTITION BY k ORDER BY md5(doc_id || ':' || whole)) AS upto FROM f
), g AS (
  SELECT doc_id, source, unnest(range(whole)) AS epoch, tokens, weight FROM l
  UNION ALL SELECT doc_id, source, whole, tokens, weight FROM l WHERE rest > 0 AND upto <= rest
)
SELECT doc_id, source, epoch, md5(doc_id || ':' || epoch) AS place, tokens, round(weight, 6) AS weight FROM g
"""

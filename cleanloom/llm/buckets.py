"""Links inside buckets: the pairs that share a bucket, compared without making all pairs of large ones.

Every bucket is first a star: all its members are compared with the one of the least id.
Links give labels, by two steps along them, and what has one label is connected and needs
no further link. Buckets with one label are done. Those of up to PAIRS members compare the
pairs of different labels. Larger ones are a star once more, around another member;
a member of a large component is then mostly linked to it, and what
stays apart is compared by one of two exact ways.

Sets (of shingles) come with ``tokens``. Two sets with a likeness of ``least`` share one of
their first tokens, rare ones first, so early in both that what follows can still suffice
(prefix and positional filtering). The first tokens of a set that isn't like its template
are its own, so members of one template don't meet by what the template gives to all. Of
those that share a token, all pairs of different labels are made but for those inside the
token's most frequent label, where there are none.

Without tokens the distance (one less the likeness) must be a metric, and large buckets are
finished around pivots: a member linked to a pivot can have links of its own only to members
within twice the distance of a link from it; the rest goes through further rounds with twice
the pivots until nothing is left. The cost grows up to the square of a bucket with many
components.

Either way every link of a bucket is found, or a path for it. No bucket is gathered in one
task: all steps are joins and aggregations.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.llm._common import Scratch

#: Members of a bucket that are compared pair by pair.
PAIRS = 16
#: What turns the order of ids in which the middle of each star is the first: of the first star, and of the second one of large buckets.
TURNS = [0, 0x2545F4914F6CDD1D]
#: Pivots of a larger bucket in the first round, about; twice as many in each further one.
PIVOTS = 8
#: compare(pairs of (a, b), floor): those with a likeness of at least floor, with it as ``like``. It leaves out at once those whose sizes can't have it.
Compare = Callable[[DataFrame, float], DataFrame]
Tokens = Callable[[DataFrame], DataFrame]
#: What a rounding error may take from a bound on counts.
SLACK = 1e-6


def _pairs(members: DataFrame, least: float) -> DataFrame:
    """(a, b) for all members of each bucket whose sizes allow ``least``."""
    x = members.select("band", F.col("lid").alias("a"), F.col("grams").alias("ga"))
    y = members.select("band", F.col("lid").alias("b"), F.col("grams").alias("gb"))
    near = F.least("ga", "gb") >= least * F.greatest("ga", "gb")
    return x.join(y, "band").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _labels(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(lid, label): for members with a link, the least that two steps along the links reach."""
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = scratch.cut(both.groupBy(F.col("b").alias("lid")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "one")
    next_ = one.select(F.col("lid").alias("label"), F.col("label").alias("next"))
    return scratch.cut(one.join(next_, "label", "left").select("lid", F.coalesce("next", "label").alias("label")), "labels")


def links(members: DataFrame, compare: Compare, least: float, scratch: Scratch, tokens: Tokens | None = None) -> DataFrame:
    """(a, b): links with a likeness of ``least`` or more that connect what the links inside the buckets connect.

    ``members`` has (band, lid, grams), each lid once a band; grams are positive sizes whose
    ratio is no less than the likeness. ``tokens`` gives (lid, token), each once, for members
    of (lid), where the likeness is that of Jaccard between the sets of tokens and grams are
    their sizes; it is asked for those of large buckets only.
    """
    found: list[DataFrame] = []
    tried: list[DataFrame] = []
    ask: list[DataFrame] = []
    left = members.select("band", "lid", "grams")
    for round_ in range(len(TURNS)):
        turned = F.col("lid").bitwiseXOR(F.lit(TURNS[round_]))  # another order of the ids in every round
        stats = left.groupBy("band").agg(F.count("*").alias("size"), F.min(turned).alias("turned")).where("size > 1")
        stats = scratch.cut(stats.select("band", "size", F.col("turned").bitwiseXOR(F.lit(TURNS[round_])).alias("rep")), "stats")
        sized = left.select("band", "lid", "grams").join(stats, "band")
        star = sized.where(F.col("lid") != F.col("rep")).select(*_ordered("lid", "rep")).distinct()
        star = scratch.cut(star.join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti") if tried else star, "star")
        tried.append(star)
        found.append(scratch.cut(compare(star, least).select("a", "b"), "linked"))
        labels = _labels(reduce(DataFrame.union, found), scratch)
        sized = sized.where("size > 2").select("band", "lid", "grams", "size")
        named = scratch.cut(sized.join(labels, "lid", "left").withColumn("label", F.coalesce("label", "lid")), "named")
        mixed = scratch.cut(named.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("band"), "mixed")
        left = named.join(mixed, "band")
        if not round_:
            ask.append(scratch.cut(_unlike(left.where(F.col("size") <= PAIRS), least), "few"))
        left = scratch.cut(left.where(F.col("size") > PAIRS), "left")
        scratch.drop(stats, labels, named, mixed)
        if left.isEmpty():
            break
    else:
        if tokens is None:
            more = _around_pivots(left.select("band", "lid", "grams"), compare, least, scratch)
            found, ask = found + more[0], ask + more[1]
        else:
            ask.append(_by_tokens(left.select("lid", "label", "grams").distinct(), tokens, least, scratch))
    asked = reduce(DataFrame.union, ask).distinct().join(reduce(DataFrame.union, tried), ["a", "b"], "left_anti")
    out = scratch.cut(reduce(DataFrame.union, found, compare(asked, least).select("a", "b")), "links")
    scratch.drop(*ask, *tried)
    return out


def _unlike(members: DataFrame, least: float) -> DataFrame:
    """(a, b) for members of each bucket with different labels, whose sizes allow ``least``."""
    x = members.select("band", F.col("lid").alias("a"), F.col("grams").alias("ga"), F.col("label").alias("la"))
    y = members.select("band", F.col("lid").alias("b"), F.col("grams").alias("gb"), F.col("label").alias("lb"))
    fits = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (F.least("ga", "gb") >= least * F.greatest("ga", "gb") - SLACK)
    return x.join(y, "band").where(fits).select("a", "b").distinct()


def _needed(share: float, n: Column) -> Column:
    return F.ceil(share * n - SLACK)


def _by_tokens(members: DataFrame, tokens: Tokens, least: float, scratch: Scratch) -> DataFrame:
    """(a, b) of different labels, among them all with a likeness of ``least``, for members of (lid, label, grams).

    The lesser of two sets has a common token among its first ones when as many tokens are
    needed as a set of its own size would ask for, and the greater among those for the least
    size that it can meet.
    """
    some = scratch.cut(members.withColumnRenamed("grams", "n"), "some")
    each = scratch.cut(tokens(some.select("lid")).join(some, "lid"), "tokens")
    # tokens of one label alone come first and meet no other label: only their number matters
    often = each.groupBy("token").agg(F.count("*").alias("often"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
    often = scratch.cut(often.select("token", "often"), "often")
    shared = each.join(often, "token")
    own = Window.partitionBy("lid").orderBy("often", "token")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the same order, so that rows are sorted once
    ranked = shared.select("*", (F.col("n") - F.count("*").over(every)).alias("alone"), F.row_number().over(own).alias("k"))
    probe = F.col("n") - _needed(least, F.col("n")) + 1
    first = ranked.where(F.col("k") <= probe - F.col("alone")).select("lid", "label", "n", (F.col("alone") + F.col("k") - 1).alias("at"), "token")
    posts = scratch.cut(first, "first")
    by_label = posts.groupBy("token", "label").agg(F.count("*").alias("m"))
    main = by_label.groupBy("token").agg(F.count("*").alias("labels"), F.max(F.struct("m", "label")).alias("x")).where("labels > 1")
    main = scratch.cut(main.select("token", (F.col("x.label")).alias("main")), "main")
    first = scratch.cut(posts.join(main, "token").withColumn("in", F.col("label") == F.col("main")), "mixed")
    both = 2 * least / (1 + least)
    x = first.where(F.col("at") <= F.col("n") - _needed(both, F.col("n")))
    x = x.select("token", F.col("in").alias("ia"), F.col("lid").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("at").alias("pa"))
    y = first.select("token", F.col("in").alias("ib"), F.col("lid").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    follows = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = (F.col("la") != F.col("lb")) & follows & (F.col("na") >= least * F.col("nb") - SLACK) & (left >= _needed(least / (1 + least), F.col("na") + F.col("nb")))
    made = x.where(~F.col("ia")).join(y, "token").where(fits).select("a", "b").union(x.where("ia").join(y.where(~F.col("ib")), "token").where(fits).select("a", "b"))
    out = scratch.cut(made.select(*_ordered("a", "b")).distinct(), "near")
    scratch.drop(some, each, often, posts, main, first)
    return out


def _around_pivots(members: DataFrame, compare: Compare, least: float, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links found in buckets of any size, and pairs to compare."""
    ask, found, round_ = [], [], 0
    shell = max(0.0, 2 * least - 1) - 1e-9
    while True:
        stats = scratch.cut(members.groupBy("band").agg(F.count("*").alias("size"), F.min("lid").alias("first")).where("size > 1"), "stats")
        if stats.isEmpty():
            return found, ask
        sized = scratch.cut(members.select("band", "lid", "grams").join(stats, "band"), "sized")
        ask.append(scratch.cut(_pairs(sized.where(F.col("size") <= PAIRS), least), "few"))
        many = sized.where(F.col("size") > PAIRS)
        if many.isEmpty():
            return found, ask
        chosen = (F.col("lid") == F.col("first")) | (F.pmod(F.xxhash64("lid", F.lit(round_)), F.col("size")) < (PIVOTS << round_))
        pivots = scratch.cut(many.where(chosen).select("band", F.col("lid").alias("pivot"), F.col("grams").alias("gp")), "pivots")
        near = (F.col("lid") != F.col("pivot")) & (F.least("grams", "gp") >= shell * F.greatest("grams", "gp"))
        meets = many.join(pivots, "band").where(near).select("band", "pivot", "lid", "grams", *_ordered("lid", "pivot"))
        like = scratch.cut(compare(meets.select("a", "b").distinct(), shell), "like")
        scored = scratch.cut(meets.join(like, ["a", "b"]), "scored")
        found.append(like.where(F.col("like") >= least).select("a", "b"))
        inner = scored.where(F.col("like") >= least).groupBy("band", "lid", "grams").agg(F.max(F.struct("like", "pivot")).alias("x"))
        inner = scratch.cut(inner.select("band", "lid", "grams", "x.like", "x.pivot"), "inner")
        x = inner.select("band", "pivot", F.col("lid").alias("i"), F.col("grams").alias("gi"), F.col("like").alias("li"))
        y = scored.where(F.col("like") < least).select("band", "pivot", "lid", "grams", "like")
        fits = (F.least("gi", "grams") >= least * F.greatest("gi", "grams")) & (F.col("li") - F.col("like") <= 1 - least + 1e-9) & (F.col("i") != F.col("lid"))
        ask.append(scratch.cut(x.join(y, ["band", "pivot"]).where(fits).select(*_ordered("i", "lid")).distinct(), "shell"))
        done = pivots.select("band", F.col("pivot").alias("lid")).union(inner.select("band", "lid"))
        members = scratch.cut(many.select("band", "lid", "grams").join(done, ["band", "lid"], "left_anti"), "rest")
        scratch.drop(stats, sized, pivots, scored, inner)
        round_ += 1

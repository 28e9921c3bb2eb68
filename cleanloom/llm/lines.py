"""Fuzzy line de-duplication by MinHash, with DataFrame functions only.

Lines are what stands between newlines, trimmed of blanks. A line's shingles are the
strings of SHINGLE code points at all its positions, each line laid out in four bytes a
code point so that a shingle is cut out in one step. Every distinct line is exploded into
its shingles once, a few to a row, and one aggregation takes the minima of their hashes under MINIMA
different orders: the MinHash signature. Four minima make a band; the bands are the lines
of the projective plane of order 3, thirteen of its thirteen points, of which any two
share one. Lines with a band in common meet in a bucket, and their shingle sets are
compared exactly, by 64-bit hashes of all shingles: LEAST or more of the union in common
makes a link. By enumeration of the plane, the bands find 97.6 % of pairs at a likeness
of 0.8, 99.3 % at 0.85, 99.9 % at 0.9, and 2 % at 0.2.

Buckets are worked off by ``buckets.links``: first as stars around the most frequent line,
then the pairs not yet connected, in large buckets those that share a rare shingle. Linked
lines form components by distributed union-find, and one line of each component stays: the
occurrence with the least (doc_id, text hash, position).
Equal lines are one line from the start, however short, and their number never matters;
lines shorter than a shingle are alike only to equal ones; blank lines are layout and stay.

Null text stays null. A null doc_id comes before all others. Rows that repeat both id and
text are one document and keep the same lines. Documents whose lines all go keep an empty
text. Columns other than text and n_chars pass through, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanloom.llm import buckets
from cleanloom.llm._common import Scratch, row_of
from cleanloom.llm.components import connected_components

SHINGLE = 9
LEAST = 0.8
MINIMA = 13
#: The minima of each band: a perfect difference set modulo MINIMA, turned.
BANDS = [sorted((k + d) % MINIMA for d in (0, 1, 3, 9)) for k in range(MINIMA)]
#: Shingles of a line that are hashed in one row.
AT_ONCE = 4
#: One line in LOOK is looked at to find large buckets, those with HOT of them or more; all lines go on.
LOOK = 64
HOT = 64
NO_ID = -(1 << 63)
#: Orders of the hashes: each minimum is taken after an exclusive or with another of these.
_ORDERS = [(k * 2654435769 & 0xFFFFFFFF) - (1 << 31) for k in range(1, MINIMA + 1)]


def _laid_out(line: Column) -> Column:
    """The line in four bytes a code point."""
    return F.encode(line, "UTF-32")


def _places(line: Column) -> Column:
    """Where the shingles of a line of SHINGLE code points or more begin when it is laid out."""
    return F.sequence(F.lit(1), 4 * (F.length(line) - SHINGLE) + 1, F.lit(4))


def _shingle(laid_out: Column, at: Column) -> Column:
    return F.substring(laid_out, at, F.lit(4 * SHINGLE))


def shingle_hashes(line: Column) -> Column:
    """64-bit hashes of the shingles of a line of SHINGLE code points or more, repeats included."""
    # the line is laid out once and not for each shingle
    return F.transform(F.array(_laid_out(line)), lambda b: F.transform(_places(line), lambda i: F.xxhash64(_shingle(b, i))))[0]


def signatures(lines: DataFrame, orders: list[int] = _ORDERS) -> DataFrame:
    """(lid, m0, m1, ...) for every line of (lid, line) that has a shingle: its MinHash signature, a minimum for each order.

    A row holds AT_ONCE shingles, so that the aggregation has fewer rows; the last one of a line is repeated in what is left of its last row.
    """
    last = 4 * (F.length("line") - SHINGLE) + 1
    places = F.sequence(F.lit(1), last, F.lit(4 * AT_ONCE)).alias("places")
    laid = lines.where(F.length("line") >= SHINGLE).select("lid", places, last.alias("last"), _laid_out(F.col("line")).alias("b"))
    each = laid.select("lid", "b", "last", F.explode("places").alias("at"))
    at = [F.least(F.col("at") + 4 * k, F.col("last")) for k in range(AT_ONCE)]
    hashed = each.select("lid", *(F.hash(_shingle(F.col("b"), x)).alias(f"h{k}") for k, x in enumerate(at)))
    least = [F.least(*(F.col(f"h{k}").bitwiseXOR(F.lit(x)) for k in range(AT_ONCE))) for x in orders]
    return hashed.groupBy("lid").agg(*(F.min(x).alias(f"m{k}") for k, x in enumerate(least)))


def with_bands(signed: DataFrame) -> DataFrame:
    """(lid, band) for each of the signatures' bands."""
    keys = [F.xxhash64(F.lit(k), *(F.col(f"m{j}") for j in band)) for k, band in enumerate(BANDS)]
    return signed.select("lid", F.explode(F.array(*keys)).alias("band"))


def dealt(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(lid, hot, by): the bands by which lines are dealt out; for those of large buckets ``hot``, dealt out by line.

    A large bucket has HOT members or more among one line in LOOK.
    """
    looked = with_bands(signed.where(F.pmod(F.xxhash64("lid"), F.lit(LOOK)) == 0))
    large = looked.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") >= HOT)
    large = scratch.cut(large.select("band", F.col("band").alias("hot")), "hot")
    by = F.when(F.col("hot").isNull(), F.col("band")).otherwise(F.xxhash64("lid", "hot"))
    return with_bands(signed).join(F.broadcast(large), "band", "left").select("lid", "hot", by.alias("by"))


def meeting(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(lid, band) for the bands that two lines or more share.

    One shuffle: every band counts its members where it is dealt out to. Those of large
    buckets are shared for certain and aren't counted, so no task gets a large bucket.
    """
    counted = dealt(signed, scratch).withColumn("size", F.count("*").over(Window.partitionBy("by")))
    return counted.where("size > 1 OR hot IS NOT NULL").select("lid", F.coalesce("hot", "by").alias("band"))


def tokens_of(lines: DataFrame) -> DataFrame:
    """(lid, token): the distinct shingle hashes of lines of SHINGLE code points or more."""
    return lines.select("lid", F.explode(F.array_distinct(shingle_hashes(F.col("line")))).alias("token"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, h, pos, line) of every line that isn't blank; (id, h) names the document."""
    split = docs.select(*_document(docs), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.withColumn("line", F.trim("line")).where("line <> ''")


def _document(docs: DataFrame) -> list[Column]:
    """Rows with equal (id, h) are the same document."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(docs["text"]).alias("h")]


def compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of lines with a Jaccard likeness of at least ``least`` of their shingle sets, with it as ``like``."""
    x = texts.select(F.col("lid").alias("a"), F.col("line").alias("x"), F.col("grams").alias("gx"))
    y = texts.select(F.col("lid").alias("b"), F.col("line").alias("y"), F.col("grams").alias("gy"))
    both = pairs.join(x, "a").join(y, "b").where(F.least("gx", "gy") >= least * F.greatest("gx", "gy") - buckets.SLACK)
    shared = F.size(F.array_intersect(shingle_hashes(F.col("x")), shingle_hashes(F.col("y"))))
    common = both.select("a", "b", (F.col("gx") + F.col("gy")).alias("g"), shared.cast("double").alias("c"))
    return common.select("a", "b", (F.col("c") / (F.col("g") - F.col("c"))).alias("like")).where(F.col("like") >= least)


def linked_lines(lines: DataFrame, least: float, scratch: Scratch, exact: bool = False) -> DataFrame:
    """Links (a, b) of lines, of (lid, line), that are alike.

    Every link of a bucket is found or a path for it: large buckets of several components are
    finished by their rarest shingles, with ``exact`` around pivots instead, which
    asks for nothing but a metric, at a cost up to the square of such a bucket.
    """
    signed = scratch.cut(signatures(lines.select("lid", "line")), "signed")
    met = scratch.cut(meeting(signed, scratch), "met")
    wanted = lines.select("lid", "line").join(met.select("lid").distinct(), "lid")
    texts = scratch.cut(wanted.withColumn("grams", F.size(F.array_distinct(shingle_hashes(F.col("line"))))), "texts")
    members = scratch.cut(met.join(texts.select("lid", "grams"), "lid"), "members")
    scratch.drop(met)
    tokens = lambda some: tokens_of(texts.join(some, "lid"))
    out = buckets.links(members, lambda pairs, floor: compared(pairs, texts, floor), least, scratch, None if exact else tokens)
    scratch.drop(signed, members, texts)
    return out


def duplicate_lines(spark: SparkSession, docs: DataFrame, scratch: Scratch, least: float = LEAST, exact: bool = False) -> DataFrame:
    """(id, h, gone): positions of the lines to remove, for each document that has any."""
    occ = occurrences(docs)
    named = [F.xxhash64("line").alias("l1"), F.xxhash64(F.lit("line"), "line").alias("l2")]
    # frequent lines have the least ids
    lid = (4095 - F.least("n", F.lit(4095))) * F.lit(1 << 51) + F.monotonically_increasing_id()
    lines = scratch.cut(occ.groupBy("line").agg(F.count("*").alias("n")).select("line", *named, "n", lid.alias("lid")), "lines")
    links = linked_lines(lines, least, scratch, exact)
    roots = scratch.cut(connected_components(spark, links, scratch), "roots")
    of = lines.select("lid", "l1", "l2", "n").join(roots, F.col("lid") == F.col("node"), "left").where("n > 1 OR root IS NOT NULL")
    repeated = scratch.cut(of.select("l1", "l2", F.coalesce("root", "lid").alias("root")), "repeated")
    scratch.drop(lines, links, roots)
    places = occ.select("id", "h", "pos", *named).join(repeated, ["l1", "l2"]).select("id", "h", "pos", "root")
    places = scratch.cut(places, "places")
    kept = scratch.cut(places.groupBy("root").agg(F.min(F.struct("id", "h", "pos")).alias("keep")), "kept")
    gone = places.join(kept, "root").where(F.struct("id", "h", "pos") != F.col("keep")).groupBy("id", "h").agg(F.collect_set("pos").alias("gone"))
    gone = scratch.cut(gone, "gone")
    scratch.drop(repeated, places, kept)
    return gone


def without_duplicates(spark: SparkSession, docs: DataFrame, least: float = LEAST, exact: bool = False) -> DataFrame:
    """(row, n_lines, n_removed): the rows of ``docs`` with one line of each component left, and how many lines went.

    n_chars, if there, counts the text that stays. ``exact`` is as in ``linked_lines``.
    """
    scratch = Scratch(spark, "lines")
    gone = duplicate_lines(spark, docs, scratch, least, exact)
    both = docs.select(row_of(docs).alias("row"), *_document(docs)).join(gone, ["id", "h"], "left")
    before = F.col("row").getField("text")
    breaks = F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit("")))
    stay = F.array_join(F.filter(F.split(before, "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    both = both.withColumn("kept", F.when(F.col("gone").isNull(), before).otherwise(stay))
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return both.select(
        row_of(docs, "row", new).alias("row"), F.coalesce(breaks + 1, F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed")
    )


def deduplicated(spark: SparkSession, docs: DataFrame, exact: bool = False) -> DataFrame:
    return without_duplicates(spark, docs, exact=exact).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_duplicates(spark, docs).select("row.*", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"))

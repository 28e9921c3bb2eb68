"""Fill-in-the-middle rewriting of texts, with the cuts found by relational steps over their units.

A unit is a run of letters or any other single code point. Each text is exploded into its
units, a window takes the running sum of their lengths, and cut requests (two ordinals a
document, drawn from a hash of its id) are joined to the units: what the sum has reached at
a requested ordinal is the offset of a cut. One aggregation brings the two offsets of a
document together, and two substrings make the three parts.

The text itself moves once: it travels in the row of its first unit, from the explosion to
the aggregation, so nothing is joined back. Rows are dealt by their place in the table, so
rows that repeat an id, or have none, never meet in one task. Places tell rows apart for
the length of one query; what comes out of a shuffle is to be written to a table first.

Plain stay: null and empty texts, texts that hold one of the marks, and the share of
documents that isn't drawn. A null text is an empty one, a null id an empty number. The
same id always draws the same cuts of a text. Columns of the caller pass through,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cleanloom.llm._common import partitions, row_of

LETTERS = "[A-Za-z]+"
UNIT = LETTERS + "|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents in a hundred that are cut, and of these the ones whose suffix comes first.
CUT, SUFFIX_FIRST = 90, 20
#: Units take some thirty times the bytes of their text, so texts are dealt in so many times as many parts as else.
FINER = 4


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _form(text: Column, draws: list[Column], cut: int, suffix_first: int) -> Column:
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (draws[2] % 100 >= cut)
    return F.when(plain, "plain").when(draws[3] % 100 < suffix_first, "spm").otherwise("psm")


def _requests(placed: DataFrame, seed: int) -> DataFrame:
    """(place, n, low, high): how many units a document has, and the ordinals of the last units of prefix and middle."""
    # each run of letters as one letter: as many code points are left as there are units
    counted = placed.select("place", "doc_id", F.char_length(F.regexp_replace("text", LETTERS, "a")).cast("long").alias("n"))
    first, second = (h % (F.col("n") + 1) for h in _draws(F.col("doc_id"), seed)[:2])
    return counted.select("place", "n", F.least(first, second).alias("low"), F.greatest(first, second).alias("high"))


def cut(docs: DataFrame, seed: int = 1, percent: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(row, text, n, form, prefix, middle, suffix): the parts of each document, null where its form is plain."""
    place, text = F.monotonically_increasing_id(), F.coalesce(F.col("row.text"), F.lit(""))
    requests = _requests(docs.select(place.alias("place"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), seed)
    dealt = docs.select(place.alias("place"), row_of(docs).alias("row")).repartition(FINER * partitions(docs.sparkSession), "place")
    # texts in order of place: their units are one sorted run
    formed = dealt.sortWithinPartitions("place").withColumn("form", _form(text, _draws(F.col("row.doc_id"), seed), percent, suffix_first))
    matches = F.when(F.col("form") != "plain", F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)))
    each = formed.select("place", "form", "row", F.posexplode_outer(matches).alias("pos", "unit"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    carried = F.when(first, F.struct("form", "row")).alias("carried")
    units = each.select("place", (F.coalesce("pos", F.lit(0)) + 1).alias("ordinal"), F.char_length("unit").cast("long").alias("size"), carried)
    reached = F.sum("size").over(Window.partitionBy("place").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = units.withColumn("reached", reached).join(requests, "place", "left").where("ordinal = 1 OR ordinal = low OR ordinal = high")
    at = lambda k: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(k), F.col("reached"))), F.lit(0)).cast("int")
    whole = met.groupBy("place").agg(F.first("carried", ignorenulls=True).alias("c"), F.max("n").alias("n"), at("low").alias("a"), at("high").alias("b"))
    t = F.coalesce(F.col("c.row").getField("text"), F.lit(""))
    parts = {"prefix": F.substring(t, F.lit(1), F.col("a")), "middle": F.substring(t, F.col("a") + 1, F.col("b") - F.col("a")), "suffix": F.substring(t, F.col("b") + 1, F.char_length(t))}
    return whole.select("c.row", t.alias("text"), "n", "c.form", *(F.when(F.col("c.form") != "plain", p).alias(name) for name, p in parts.items()))


def output(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """The text to train on."""
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm)


def restored(form: Column, out: Column) -> Column:
    """The text that ``out`` was made of. Its marks are the only ones: texts that hold one stay plain."""
    one, two = F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.split_part(out, F.lit(MIDDLE), F.lit(1))
    head = F.substring(F.split_part(two, one, F.lit(1)), F.lit(len(PREFIX) + 1), F.char_length(out))
    tail, middle = F.split_part(two, one, F.lit(2)), F.split_part(out, F.lit(MIDDLE), F.lit(2))
    return F.when(form == "plain", out).when(form == "psm", F.concat(head, middle, tail)).otherwise(F.concat(tail, middle, head))


def transformed(docs: DataFrame, seed: int = 1, percent: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The rows of ``docs`` (column row) with n, form, prefix_chars, middle_chars and output."""
    made = cut(docs, seed, percent, suffix_first)
    return made.select(
        "row", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        output(*(F.col(c) for c in ("form", "text", "prefix", "middle", "suffix"))).alias("output"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = F.col("output")
    return transformed(docs).select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(out, 256).alias("output_sha256"), F.sha2(restored(F.col("form"), out), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), h AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
    CAST('0x' || d[1:8] AS UBIGINT) AS h1, CAST('0x' || d[9:16] AS UBIGINT) AS h2, CAST('0x' || d[17:24] AS UBIGINT) AS h3, CAST('0x' || d[25:32] AS UBIGINT) AS h4
  FROM d
), f AS (
  SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

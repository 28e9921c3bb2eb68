"""Fill-in-the-middle rewriting against plain Python, and the exact way back."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cleanloom.llm import middles

TEXTS = ["", None, "a", " ", "one two", "naïve café — 12,5 €\n\n\tend.", "😀😀 x 😀y", "has <M> inside", "<P", "S><P <S", "a" * 5000, "ab 1 " * 4000, "x" + "́" * 30]


def plainly(doc_id, text, percent=90, suffix_first=20):
    text = text or ""
    units = re.findall(middles.UNIT, text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < suffix_first:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def rows(df):
    return sorted((tuple(r) for r in df.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"percent": 100, "suffix_first": 100}, {"percent": 0}])
def test_like_plain_python(docs, options):
    given = [(k, TEXTS[k % len(TEXTS)]) for k in range(120)] + [(None, t) for t in TEXTS] + [(7, "one two")] * 3
    want = sorted((plainly(k, t, options.get("percent", 90), options.get("suffix_first", 20)) for k, t in given), key=str)
    assert rows(middles.transformed(docs(given), **options)) == want


def test_the_way_back_is_exact(docs):
    given = [(k, TEXTS[k % len(TEXTS)]) for k in range(200)]
    back = middles.transformed(docs(given)).select("row.doc_id", middles.restored(F.col("form"), F.col("output")).alias("back"))
    assert {r.doc_id: r.back for r in back.collect()} == {k: t or "" for k, t in given}


def test_columns_of_the_caller_pass_through(docs, spark):
    made = middles.transformed(docs([(1, "a b"), (1, "a b")]).withColumn("place", F.lit(3)).withColumn("n", F.lit("mine")))
    assert [tuple(r) for r in made.select("row.place", "row.n", "row.text").collect()] == [(3, "mine", "a b")] * 2
    assert middles.transformed(docs([])).count() == 0


def test_query_like_sql(spark, oracle):
    oracle(middles.query(spark, "/root/testdata/sf0.001"), middles.ORACLE)

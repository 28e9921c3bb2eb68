"""Licence scans against plain matching of every template at every place."""

import random
import re

import duckdb
import pytest

from cleanloom.llm import licences as L

TOY = [("one", "a b c d e f"), ("two", "c d e f g h i"), ("one", "a a a a b a a a a"), ("three", "x a b c d y")]
PHRASES = [("p", "a b"), ("q", "b"), ("p", "c d e"), ("r", "a a")]


def plain_words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


def plain_matches(ws, template):
    """All diagonals of equal words of SEED or more, as (word of the text, word of the template, length)."""
    out = []
    for d in range(len(ws)):
        for t in range(len(template)):
            if ws[d] == template[t] and not (d and t and ws[d - 1] == template[t - 1]):
                n = 0
                while d + n < len(ws) and t + n < len(template) and ws[d + n] == template[t + n]:
                    n += 1
                if n >= L.SEED:
                    out.append((d, t, n))
    return out


def plain_best(matches):
    """The greatest cover by any chain, by trying all chains."""

    def grown(k, covered):
        x, y, m = matches[k]
        best = covered
        for j, (d, t, n) in enumerate(matches):
            over = max(0, x + m - d, y + m - t)
            if x < d and y < t and d - (x + m) <= L.GAP and over < n:
                best = max(best, grown(j, covered + n - over))
        return best

    return max((grown(k, n) for k, (_, _, n) in enumerate(matches)), default=0)


@pytest.mark.parametrize("seed", range(60))
def test_matches_phrases_and_chains(seed):
    draw = random.Random(seed)
    a = L.compiled(PHRASES, TOY)
    text = " ".join(draw.choice("abcdefghixyaaaz") if draw.random() < 0.3 else draw.choice(TOY)[1][: draw.randrange(3, 20)] for _ in range(draw.randrange(1, 25)))
    ws = plain_words(text)
    seen = {}
    original = L.chains
    try:
        L.chains = lambda found, size: seen.setdefault(len(seen), (sorted(found), size)) and original(found, size)
        n_words, n_base, first, last, base, labels, score, spans = L.scan(text.encode(), a)
    finally:
        L.chains = original
    places = [(at, label) for label, p in PHRASES for at in range(len(ws)) if ws[at : at + len(p.split())] == [x.encode() for x in p.split()]]
    assert (n_words, n_base, base) == (len(ws), len(places), sorted({x for _, x in places}))
    assert (first, last) == (min((at for at, _ in places), default=None), max((at for at, _ in places), default=None))
    every = [plain_matches(ws, [w.encode() for w in t.split()]) for _, t in TOY]
    assert sorted(found for found, _ in seen.values()) == sorted(sorted(m) for m in every if m)
    shares = [plain_best(m) / len(t.split()) for m, (_, t) in zip(every, TOY, strict=True)]
    assert score == max([*shares, 1.0 if places else 0.0])
    assert set(labels) == set(base) | {label for (label, _), s in zip(TOY, shares, strict=True) if s >= L.LEAST}
    assert {x["template"] for x in spans} == {k for k, s in enumerate(shares) if s >= L.LEAST}


def test_every_template_is_found_whole_and_with_faults():
    a = L.compiled()
    for k, (label, text) in enumerate(L.TEMPLATES):
        ws = L.words(text)
        found = L.scan(b"some words before. " + text.upper().encode() + b" And after", a)
        assert found[6] == 1.0 and label in found[5] and any(x["template"] == k and (x["first"], x["last"]) == (3, 2 + len(ws)) for x in found[7])
        if len(ws) > 40:
            broken = b" ".join([*ws[:15], b"copyright", b"2020", *ws[16:30], *ws[31:]])
            assert any(x["template"] == k and 1 > x["share"] > L.LEAST for x in L.scan(broken, a)[7])


def test_repeats_long_texts_and_blocks(monkeypatch):
    a = L.compiled()
    text = "filler words here. Licensed under CC BY-NC 4.0. " * 3000
    whole = L.scan(text.encode(), a)
    assert len(whole[7]) >= 3000 and whole[0] == 10 * 3000
    monkeypatch.setattr(L, "BLOCK", 100)
    assert L.scan(text.encode(), a) == whole


def test_edges(docs):
    rows = [(1, None), (2, ""), (3, " .,"), (4, "The MIT-License and the mit\nLICENSE"), (4, "The MIT-License and the mit\nLICENSE"), (None, "General Public license é")]
    made = L.scanned(docs(rows).withColumnRenamed("source", "n_words"))
    got = sorted((str(r.row.doc_id), r["n_words"], r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, r.row["n_words"]) for r in made.collect())
    four = ("4", 7, 2, 1, 5, ["mit"], ["mit"], 1.0, "s")
    nothing = (0, 0, None, None, [], [], 0.0, "s")
    assert got == [("1", *nothing), ("2", *nothing), ("3", *nothing), four, four, ("None", 4, 1, 0, 0, ["gpl"], ["gpl"], 1.0, "s")]
    assert L.scanned(docs([])).count() == 0
    with pytest.raises(ValueError):
        L.compiled(templates=[("short", "two words")])


def test_base_columns_like_sql(spark):
    """Places of phrases in the small documents, word by word in SQL."""
    small = "/root/testdata/sf0.001"
    sql = f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM '{small}/documents.parquet'),
    p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    b AS (SELECT doc_id, i - 1 AS place, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache'
      WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label FROM p)
    SELECT w.doc_id, len(w), count(label), min(place), max(place), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '')
    FROM w LEFT JOIN (SELECT * FROM b WHERE label IS NOT NULL) b USING (doc_id) GROUP BY w.doc_id, w
    """
    got = sorted(tuple(r) for r in L.query(spark, small).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    assert got == sorted(duckdb.sql(sql).fetchall()) and any(r[2] for r in got)

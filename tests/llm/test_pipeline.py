"""The stages over the small tables, and the registered queries that SQL can express."""

import pytest

from cleanloom.llm import registry, simhash

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "SentencePiece"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    assert out.columns == [*columns, "token_ids"]
    assert all(r["n_chars"] == len(r["text"]) and r["token_ids"] is not None for r in rows)
    ids = {r["doc_id"] for r in rows}
    assert len(ids) > 0.85 * before
    once = spark.createDataFrame([(r["doc_id"], r["text"]) for r in {r["doc_id"]: r for r in rows}.values()], "doc_id long, text string")
    assert simhash.keep_one(spark, once).count() == once.count()


def test_empty_documents(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries(spark, oracle, name):
    oracle(registry.QUERIES[name](spark, SMALL), registry.ORACLES[name])


def test_names():
    numbered = [n.split("_")[0] for n in registry.QUERIES if n.startswith("op")]
    assert numbered == [f"op{k}" for k in range(1, 14)] and "edit_near_documents" in registry.QUERIES


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage by its plain form: the network text by text, all pairs of lines, all pairs of documents, SQL, the library."""
    import random

    import duckdb
    import sentencepiece
    from test_lines import cleaned
    from test_simhash import kept_by_brute_force

    import corpus_pipeline
    from cleanloom.llm import langid, mixing, sentencepieces

    rng = random.Random(11)
    words = {"en": "the house and with water stone bright under carry window".split(), "de": "und straße der schön nicht haus wasser stein unter fenster".split()}
    rows = []
    for k in range(120):
        lang = ("en", "de")[k % 2]
        text = "\n".join(" ".join(rng.choices(words[lang], k=rng.randint(3, 14))) for _ in range(rng.randint(1, 4)))
        rows.append((k, text, lang, f"s{k % 3 if k % 4 else 0}", len(text)))
    rows += [(200 + k, rows[k][1], rows[k][2], "s9", rows[k][4]) for k in range(6)] + [(300, None, "en", "s1", None), (301, "123 !!", "en", None, 6), (302, "", "de", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["text"], r["n_chars"], tuple(r["token_ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    net = langid.train(docs)
    langs, scores = langid.classify(net, [None if r[1] is None else r[1].encode() for r in rows])
    known = [r for r, lang, s in zip(rows, langs, scores, strict=True) if lang != "und" and s >= langid.LEAST_SCORE]
    lines = cleaned([(r[0], r[1]) for r in known])
    source = {r[0]: r[3] for r in known}
    left = [(i, text, source[i]) for i, text in kept_by_brute_force([(r[0], lines[r[0]]) for r in known])]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(left, "doc_id long, text string, source string").toArrow())
    texts = {r[0]: r[1] for r in left}
    encode = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL).encode
    want = sorted((i, texts[i], len(texts[i]), tuple(encode(texts[i]))) for (i,) in con.sql(f"SELECT doc_id FROM ({mixing.ORACLE})").fetchall())
    assert got == want

import zlib

import numpy as np
import pytest

from cleanloom.llm import langid as L


def corpus(n=160):
    rng = np.random.default_rng(1)
    words = {"en": ["the", "house", "and", "with", "water"], "de": ["und", "straße", "der", "schön", "nicht"], "es": ["el", "niño", "está", "para", "gente"]}
    return [(k, " ".join(rng.choice(words[lang], 30)), lang) for k in range(n) for lang in [list(words)[k % 3]]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    df = frame(spark, [*corpus(), (1000, None, "en"), (1001, " 12 !", "en"), (1002, "", "de"), (None, "the house and", None)])
    net = L.train(df)
    out = {r["doc_id"]: r for r in L.with_language(df, net).select("row.doc_id", "lang_pred", "score", L.held_out("row.doc_id").alias("h")).collect()}
    for k, _, lang in corpus():
        assert out[k]["h"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert out[k]["lang_pred"] == lang and 0 <= out[k]["score"] <= 1
    assert [out[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3
    assert out[None]["h"] and out[None]["lang_pred"] in net.langs


def test_held_out_rows_teach_nothing(spark):
    rows = corpus()
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    wrong = kept + [(k, t, "xx") for k, t, _ in rows if not zlib.crc32(str(k).encode()) % 5]
    a, b = L.train(frame(spark, kept)), L.train(frame(spark, wrong))
    assert a.langs == b.langs and np.array_equal(a.out, b.out)


def test_windows_cover_every_byte():
    for n in (1, 5, 251, 252, 256, 257, 1000):
        text = bytes(97 + k % 26 for k in range(n))
        windows, of, left = L.cut_windows([b"ab", text])
        mine = windows[of == 1]
        seen = b"".join(bytes(w[: L._STEP]) for w in mine[:-1]) + bytes(mine[-1][: left[-1]])
        assert seen == text
        widest = {bytes(w[k : k + 5]) for w in mine for k in range(252)}
        assert all(text[k : k + 5] in widest for k in range(n - 4))


def test_order_and_batches_dont_matter(spark):
    df = frame(spark, corpus())
    net = L.train(df)
    texts = [t.encode() for _, t, _ in corpus(12)] + [b"the water " * 40000]
    langs, scores = L.classify(net, texts)
    for t, lang, score in zip(texts, langs, scores, strict=True):
        one = L.classify(net, [t])
        assert one[0] == [lang] and abs(one[1][0] - score) < 1e-6


def test_nothing_to_learn(spark):
    assert L.train(frame(spark, [])) is None
    df = frame(spark, [(1, "the house", None)])
    assert [r["lang_pred"] for r in L.with_language(df, L.train(df)).collect()] == ["und"]
    assert L.accepted(frame(spark, [])).count() == 0


def test_clean_documents_stay(spark):
    df = frame(spark, [*corpus(), (999, "???", "en")])
    kept = L.accepted(df)
    assert kept.columns == df.columns and kept.count() == len(corpus())


def plain(net, text):
    """The network word for word: embed, filters at every position of every window, greatest value, rectifier, softmax."""
    total, used, low = np.zeros(len(net.langs)), 0, bytes(x + 32 if 65 <= x <= 90 else x for x in text)
    starts = [0]
    while starts[-1] + L.WINDOW < len(low):
        starts.append(starts[-1] + L._STEP)
    for at in starts:
        part = low[at : at + L.WINDOW]
        seen = [net.embed[x].astype(float) for x in part] + [np.zeros(L.EMBED)] * (L.WINDOW - len(part) + L._WIDE - 1)
        values = []
        for f in range(net.conv.shape[1]):
            width = L.WIDTHS[f // L.FILTERS]
            weights = net.conv[:, f].reshape(L._WIDE, L.EMBED).astype(float)
            best = max(sum(float(seen[p + k] @ weights[k]) for k in range(width)) for p in range(L.WINDOW))
            values.append(max(0.0, best + float(net.conv_b[f])))
        z = np.array(values) @ net.out + net.out_b
        e = np.exp(z - z.max())
        total += e / e.sum() * len(part)
        used += len(part)
    return total / used


def test_against_a_plain_convolution(spark):
    net = L.train(frame(spark, corpus(60)))
    for text in (b"the house and water", "schön ist die Straße ".encode() * 14):
        want = plain(net, text)
        langs, scores = L.classify(net, [text])
        assert langs == [net.langs[int(want.argmax())]] and abs(scores[0] - want.max()) < 1e-4


def test_training_lowers_the_loss_and_follows_the_gradient(monkeypatch):
    """One step of the optimiser moves every weight against the numerically measured gradient of the loss."""
    rng = np.random.default_rng(3)
    windows = rng.integers(97, 105, (12, L.WINDOW)).astype(np.uint8)
    labels = np.arange(12) % 2
    monkeypatch.setattr(L, "EPOCHS", 1)
    monkeypatch.setattr(L, "RATE", 0.0)
    begun = L.fit(windows, labels, ["a", "b"])
    monkeypatch.setattr(L, "RATE", 1e-4)
    moved = L.fit(windows, labels, ["a", "b"])

    def loss(net):
        return float(-np.log(net.predict(windows)[np.arange(12), labels].astype(float)).mean())

    assert loss(moved) < loss(begun)
    for name in ("out", "out_b", "conv_b", "conv"):
        value, step = getattr(begun, name), getattr(moved, name) - getattr(begun, name)
        for at in np.argsort(-np.abs(step), axis=None)[:5]:
            spot = np.unravel_index(at, value.shape)
            kept, d = value[spot], 1e-2
            value[spot] = kept + d
            up = loss(begun)
            value[spot] = kept - d
            slope = (up - loss(begun)) / (2 * d)
            value[spot] = kept
            assert abs(slope) < 1e-4 or np.sign(slope) == -np.sign(step[spot])


def test_the_sample_is_the_same_for_any_partitioning(spark):
    df = frame(spark, corpus(200))
    nets = [L.train(df.repartition(n), most=50) for n in (1, 3, 7)]
    assert all(np.array_equal(nets[0].out, x.out) for x in nets[1:])


def test_columns_keep_their_names_and_values(spark):
    names = ["_lang_pred", "_lang_score", "lang_pred", "score", "row", "a.b"]
    rows = [(*r, *(f"{c}{r[0]}" for c in names)) for r in corpus(60)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", *names])
    out = L.accepted(df)
    got = sorted(map(tuple, out.collect()))
    assert out.columns == df.columns and len(got) > 40 and set(got) <= set(rows)


@pytest.mark.parametrize("doc_id", [1, 2, 3, 6])
def test_one_id_for_all_rows(spark, doc_id):
    """A sample is of rows: neither none nor all of a table whose ids are equal, and repeated rows count once."""
    texts = [("en", "the cat and the dog with this and that"), ("de", "der hund und die katze mit dem und das")]
    rows = [(doc_id, *texts[k % 2][:1], f"{texts[k % 2][1]} {k % 400}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    learns = not docs.where(L.held_out()).count()
    assert (L.train(docs, most=50) is not None) == learns
    assert L.accepted(docs).count() == (3000 if learns else 0)

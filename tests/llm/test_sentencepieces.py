import random

import numpy as np
import pytest
import sentencepiece

from cleanloom.llm import sentencepieces as S

MODEL = open(S.MODEL, "rb").read()


@pytest.fixture(scope="module")
def both():
    return S.Transducer(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_against_the_library(both):
    own, library = both
    rng = random.Random(8)
    bits = ["a", "the", "ing", " ", "  ", "   ", "\n", "\t", "é", "漢", "字", "😀", "▁", "Th", "12", "3.5", "ß", "http://", "</p>", "\x01", "x" * 30, " " * 17, "***", "s's"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text)
        assert own.decode(ids) == library.decode(library.encode(text))


def test_pairs_are_stable_as_merging_says(both):
    own, _ = both
    rng = random.Random(9)
    pieces = [p for p in own.id if p.isascii() or "▁" in p]
    for _ in range(5000):
        p, q = rng.choice(pieces), rng.choice(pieces)
        assert own.stable(p, q) == (own.merge(p + q) == [p, q])


def test_unigram_takes_the_least_weight():
    def field(number, data):
        return bytes([number << 3 | 2, len(data)]) + data

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + b"\x15" + np.float32(score).tobytes() + bytes([3 << 3, kind]))

    model = piece("<unk>", 0, 2) + b"".join(piece(t, s, 1) for t, s in [("▁", -2), ("▁a", -1), ("a", -2), ("b", -2), ("ab", -1.5), ("▁ab", -5)])
    model += field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 0]))
    own = S.Transducer(model)
    assert [own.text[i] for i in own.encode("ab")] == ["▁a", "b"]
    assert [own.text[i] for i in own.encode("abab")] == ["▁a", "b", "ab"]
    assert own.encode("ax").tolist()[-1] == own.unknown


def test_frames(spark, docs, both):
    texts = [None, "", "a b", "a b", "new\nline ***x", "🙂" * 300, "word " * 5000]
    df = docs(list(enumerate(texts)))
    out = {r["doc_id"]: r for r in S.encoded(spark, df, check=True).collect()}
    for k, t in enumerate(texts):
        assert out[k]["token_ids"] == (None if t is None else both[1].encode(t))
        assert out[k]["round_trip"] == (None if t is None else True)
    tokens = S.encoded(spark, df)
    assert tokens.columns == [*df.columns, "token_ids"]
    assert {r["doc_id"]: r["text"] for r in S.decoded(spark, tokens).collect()} == dict(enumerate(texts))
    assert S.encoded(spark, docs([])).count() == 0

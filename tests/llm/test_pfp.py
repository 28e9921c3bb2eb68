import hashlib
import random

from cleanloom.llm import pfp


def slow(texts, length=400):
    seen = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((k, p))
    gone = [bytearray(len(t)) for t in texts]
    for at in seen.values():
        if len(at) > 1:
            for k, p in at:
                gone[k][p : p + length] = b"\1" * length
    return gone


def check(spark, docs, rows):
    out = pfp.remove_repeats(spark, docs(rows))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in out.collect())
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), t, g in zip(rows, texts, slow(texts), strict=True):
        kept = bytes(b for b, x in zip(t, g, strict=True) if not x)
        spans = sum(1 for k in range(len(g)) if g[k] and (not k or not g[k - 1]))
        want.append((str(i), len(t), sum(g), spans, hashlib.sha256(kept).hexdigest(), kept))
    assert got == sorted(want)


def test_against_brute_force(spark, docs):
    rng = random.Random(5)
    parts = ["".join(rng.choices("abcdefgh \n", k=rng.randint(300, 900))) for _ in range(5)]
    rows = []
    for k in range(40):
        pieces = [
            rng.choice(parts), rng.choice(parts)[: rng.randint(350, 450)], rng.choice(parts)[rng.randint(0, 200) :], "=" * rng.randint(1, 900), "ab" * rng.randint(1, 400),
            f"x{k}" * rng.randint(1, 30), "".join(rng.choices("pqrst", k=rng.randint(0, 500))),
        ]
        rows.append((k, "".join(rng.choices(pieces, k=rng.randint(0, 5)))))
    check(spark, docs, rows)


def test_edges(spark, docs):
    one = "".join(random.Random(6).choices("abcdefghijklmnop ", k=2000))
    rows = [(1, None), (2, ""), (3, "a" * 399), (4, "a" * 400), (5, "b" * 401), (6, "é" * 200), (7, one), (7, one), (None, one[:700]), (8, "z" + one[300:699]), (9, "y" + one[900:1300])]
    check(spark, docs, rows)


def test_empty(spark, docs):
    assert pfp.remove_repeats(spark, docs([])).count() == 0


def test_triggers_depend_on_content_only():
    text = random.Random(7).randbytes(5000)
    own = pfp.triggers(text)
    part = pfp.triggers(text[1000:3000])
    assert (part + 1000).tolist() == [t for t in own if 1000 <= t <= 3000 - pfp.W]

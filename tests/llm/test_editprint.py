import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cleanloom.llm import editprint as E


def slow(text):
    """Segment by segment and character by character: cuts, names, walks, and for each bit the step shown."""
    if not text:
        return []
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds, n = E.classes(points), len(text)
    hashes = [int(E._windows(points[k : k + E.W])[0]) if k + E.W <= n else None for k in range(n)]
    begins = [0]
    for k in range(1, n):
        if (hashes[k] is not None and (hashes[k] >> 32) < 2**32 // E.MEAN) or k - begins[-1] == E.LONGEST:
            begins.append(k)
    names, before = [], Counter()
    for k in begins:
        name = 1 if k == 0 else n - k + 1 if hashes[k] is None else hashes[k]
        names.append(int(E._mixed(np.array([(name + before[name] * 0x94D049BB133111EB) % 2**64], np.uint64))[0]))
        before[name] += 1
    shown = []
    for a, b in zip(begins, [*begins[1:], n], strict=True):
        own = []
        for x in kinds[a:b]:
            own += [int(x)] * int(E.STAY[int(x) * E.STEPS + len(own)])
        shown.append(own)
    out = []
    for bit in range(E.BITS):
        mask, times = int(E.SLOT[1, bit // E.SHOWN]), int(E.SLOT[0, bit // E.SHOWN])
        own = shown[min(range(len(names)), key=lambda s: ((names[s] ^ mask) * times % 2**64 >> 26, s))]
        level = (len(own) - 1).bit_length()
        drawn = [int(d) >> (12 - level) for d in E.DRAWN[:, bit]]
        step = next((d for d in drawn if d < len(own)), int(E.DRAWN[0, bit]) % len(own))
        out.append(int(E.BIT[own[step], bit]))
    return out


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij klmnopé漢", k=rng.choice([0, 1, 2, 5, 50, 700, 2048, 2049, 5000]))) for _ in range(n)]


def test_all_texts_at_once_give_the_plain_walk():
    many = [*texts(60), "a" * 9000, "ab" * 5000]
    for text, bits in zip(many, E.fingerprints(many), strict=True):
        assert bits.tolist() == slow(text)
        assert E.as_bits(E.as_text(bits)).tolist() == bits.tolist()


@pytest.mark.parametrize("n", [2000, 20_000, 100_000])
@pytest.mark.parametrize("k", [1, 20, 200])
def test_inserted_characters_cost_what_they_touch(n, k):
    rng = random.Random(n + k)
    letters = "abcdefghijklmnop "
    for share in (0.05, 0.5, 0.95):
        like = []
        for _ in range(5):
            text, at = "".join(rng.choices(letters, k=n)), int(share * n)
            like.append(E.likeness(*E.fingerprints([text, text[:at] + "".join(rng.choices(letters, k=k)) + text[at:]])))
        assert np.median(like) > 0.9 and min(like) > 0.7


@pytest.mark.parametrize("n", [3000, 40_000, 400_000])
def test_the_whole_text_counts(n):
    """A new last third costs a third whatever the length, and one character costs little in any third."""
    rng = random.Random(n)
    letters = "abcdefghijklmnop "
    like = []
    for _ in range(5):
        text = "".join(rng.choices(letters, k=n))
        third = n // 3
        edited = [text[: n - third] + "".join(rng.choices(letters, k=third))]
        edited += [text[:at] + "#" + text[at + 1 :] for at in (n // 6, n // 2, n - n // 6)]
        own, *others = E.fingerprints([text, *edited])
        like.append([E.likeness(own, x) for x in others])
    last, *one = np.median(like, axis=0)
    assert abs(last - 2 / 3) < 0.1 and min(one) > 0.9


def test_edits_are_near():
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghijklmnop ", k=4000))
    edited = list(text)
    for _ in range(4):
        edited[rng.randrange(len(edited))] = "z"
    del edited[2000:2003]
    other = "".join(rng.choices("abcdefghijklmnop ", k=4000))
    a, b, c = E.fingerprints([text, "".join(edited), other])
    assert E.likeness(a, a) == 1 and E.likeness(a, b) > 0.7 > 0.4 > E.likeness(a, c)


@pytest.mark.parametrize("n", [1, 2, 40])
def test_next_document(spark, docs, n):
    rows = [(97 * k % 1009, t or None) for k, t in enumerate(texts(n, 3))]
    out = {r["doc_id"]: r for r in E.compare_with_next(spark, docs(rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % n][1] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        r = out[i]
        prints = E.fingerprints([t, edited, after])
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert [r["fingerprint"], r["edited_fingerprint"]] == [E.as_text(prints[0]), E.as_text(prints[1])]
        assert abs(r["near_edited"] - E.likeness(prints[0], prints[1])) < 1e-12
        assert abs(r["near_next"] - E.likeness(prints[0], prints[2])) < 1e-12


def test_edges(spark, docs):
    assert E.compare_with_next(spark, docs([])).count() == 0
    out = E.compare_with_next(spark, docs([(3, "x" * 30), (3, "x" * 30), (None, "y"), (1, None)])).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "3", "3", "None"]


def test_near_documents(spark, docs):
    rng = random.Random(4)
    base = "".join(rng.choices("abcdefghijklmnop ", k=3000))
    rows = [(k, "".join(rng.choices("abcdefghijklmnop ", k=3000))) for k in range(10, 20)]
    rows += [(1, base), (2, base), (3, base[:2990] + "ZZZ"), (4, base[:1000] + "Q" + base[1001:]), (5, None)]
    got = {r["doc_id"]: r["component_id"] for r in E.near_documents(spark, docs(rows)).collect()}
    assert [got[k] for k in (1, 2, 3, 4, 5)] == [1, 1, 1, 1, 5]
    assert all(got[k] == k for k in range(10, 20))


def test_banding_finds_small_edit_distances(spark, docs):
    """Pairs made by inserting, deleting or replacing 1 to 5 % of the characters, in one place: nine in ten or more meet, others don't."""
    rng = random.Random(12)
    letters, rows = "abcdefghijklmnop ", []
    for k in range(80):
        base = "".join(rng.choices(letters, k=rng.choice([600, 1300, 5000, 20_000])))
        n = int(len(base) * rng.uniform(0.01, 0.05))
        at = rng.randrange(len(base) - n)
        new = "".join(rng.choices(letters, k=n))
        rows += [(2 * k, base), (2 * k + 1, rng.choice([base[:at] + new + base[at:], base[:at] + base[at + n :], base[:at] + new + base[at + n :]]))]
    got = {r["doc_id"]: r["component_id"] for r in E.near_documents(spark, docs(rows)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(80)) >= 72
    assert all(got[2 * k] == 2 * k for k in range(80))


@pytest.mark.parametrize("exact, least", [(False, 63), (True, 70)])
def test_one_template_for_many_texts(spark, docs, exact, least):
    """In a bucket of many families of two, alike inside and less so across, nine links in ten are found, and all by the exact way."""
    rng = random.Random(5)
    letters = "abcdefghijklmnop "
    make = lambda n: "".join(rng.choices(letters, k=n))
    base, rows = make(2600), []
    for k in range(70):
        own = base + make(1400)
        rows += [(2 * k, own), (2 * k + 1, own[:1200] + "#" + own[1200:])]
    got = {r["doc_id"]: r["component_id"] for r in E.near_documents(spark, docs(rows), exact=exact).collect()}
    assert sum(got[2 * k + 1] == got[2 * k] for k in range(70)) >= least


def test_one_id_or_text_for_most_rows(spark, docs):
    """Ranges cut hot ids by the text's hash and deal out equal rows; every row comes once, with the next in order."""
    rows = [(None, f"text number {k} of many") for k in range(60)] + [(7, "the same text")] * 50 + [(k, f"own text {k}") for k in range(20)]
    out = E.compare_with_next(spark, docs(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)
    assert sum(r["near_next"] == 1.0 for r in out if r["doc_id"] == 7) >= 49


def test_unrelated_texts_share_few_bands():
    """Pairs of unrelated texts in a band grow with the square of their number, so nearly none may share one; alike ones do."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghijklmnop ", k=1500)) for _ in range(500)]
    texts += [t[:700] + "".join(rng.choices("abcdefghijklmnop ", k=100)) + t[800:] for t in texts[:40]]
    prints = [E.as_text(x) for x in E.fingerprints(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(prints))), pa.array(prints)], ["lid", "fp"])
    keys = [set(r["keys"]) for out in E._banded(iter([batch])) for r in out.to_pylist()]
    assert sum(bool(keys[k] & keys[500 + k]) for k in range(40)) >= 39
    assert sum(bool(keys[a] & keys[b]) for a in range(500) for b in range(a)) <= 5

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from cleanloom.llm import buckets
from cleanloom.llm import simhash as S
from cleanloom.llm._common import Scratch


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def components(prints, ids):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(ids)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            root[find(a)] = find(b)
    group = {}
    for i in range(len(ids)):
        group.setdefault(find(i), []).append(ids[i])
    return {i: min(g) for g in group.values() for i in g}


def test_fingerprint():
    for text in ["", " \t\n", "One", "a B", "x y z", "é À b c\xa0d e", "the cat sat " * 3000, "x\x0by z\x0cw"]:
        assert S.simhash(text.encode()) == slow_print(text)


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def alike(a, b, least=0.8):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= least * len(x | y)


def kept_by_brute_force(rows, least=0.8, n=5):
    """Documents that stay if all pairs of rows are compared: the least (id, hash) of each component, here by id and text."""
    names = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, str(r[1])))
    root = list(range(len(names)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(names)), 2):
        if alike(names[a][1], names[b][1], least):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [r for k, r in enumerate(names) if find(k) == k]


def test_wider_masks_cover_the_radius():
    rng = random.Random(5)
    for radius in (3, 4, 6):
        masks = S.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(300):
            bits = rng.sample(range(64), radius)
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def near_copies(seed, n, sizes=(60, 200)):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(500)]
    rows = []
    for k in range(n):
        base = rng.choices(words, k=rng.randint(*sizes))
        rows.append((10 * k, " ".join(base)))
        for j in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(other))
                other[at : at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
            rows.append((10 * k + j + 1, " ".join(other)))
    return rows


def test_similar_documents_against_brute_force(spark, docs):
    """No document goes without a similar one; of the pairs of different texts that are alike, nine in ten or more meet."""
    rows = [*near_copies(6, 60), (None, None), (9000, " "), (9001, "four words of text"), (9002, "Four words  of text"), (9003, "four words of it")]
    kept = {(r["doc_id"], r["text"]) for r in S.keep_one(spark, docs(rows)).collect()}
    want = set(kept_by_brute_force(rows))
    assert want <= kept
    assert len(kept - want) <= 0.1 * (len(rows) - len(want))


def test_large_groups_are_finished(spark, docs, monkeypatch):
    monkeypatch.setattr(buckets, "PAIRS", 4)
    monkeypatch.setattr(buckets, "PIVOTS", 1)
    rng = random.Random(8)
    base = [f"word{k}" for k in range(300)]
    rows = [(k, " ".join([*base[:at], f"own{k}", *base[at + 1 :]])) for k in range(60) for at in [rng.randrange(300)]]
    assert [r["doc_id"] for r in S.keep_one(spark, docs(rows)).collect()] == [0]


def test_families_of_one_template(spark, docs):
    """Hundreds of families of two, alike by 0.9 inside and 0.7 across, of which the fingerprints find most as they would without a template."""
    rng = random.Random(9)
    base, rows = [f"word{k}" for k in range(400)], []
    for k in range(150):
        own = base + [f"own{k}x{j}" for j in range(90)]
        at = rng.randrange(20, 380)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[:at], "other", *own[at + 1 :]]))]
    kept = {r["doc_id"] for r in S.keep_one(spark, docs(rows)).collect()}
    assert len(kept) <= 165


def test_masks_cover_every_pair():
    masks = S.masks()
    assert len(masks) == 7
    for a, b in itertools.combinations_with_replacement(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def test_links_are_exact(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (1 << 64) - 1 for b in base for k in range(5) for _ in range(12)}
    signed = [S._signed(p) for p in prints]
    found = S.linked_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"), Scratch(spark, "t")).collect()
    scratch_root = {p: p for p in signed}

    def find(p):
        while scratch_root[p] != p:
            p = scratch_root[p]
        return p

    for a, b in found:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
        scratch_root[find(a)] = find(b)
    for a, b in itertools.combinations(signed, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
            assert find(a) == find(b)


def test_documents(spark, docs):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(60)] + [None, "", "Alpha", "alpha"]
    rows = [(7 * k % 101, t) for k, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in S.near_duplicates(spark, docs(rows)).collect()}
    prints = [slow_print(t or "") for _, t in rows]
    want = components(prints, [i for i, _ in rows])
    assert {i: r["component_id"] for i, r in out.items()} == want
    assert [out[i]["fp"] & (1 << 64) - 1 for i, _ in rows] == prints


def test_empty_null_ids_and_repeats(spark, docs):
    assert S.near_duplicates(spark, docs([])).count() == 0
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "q r s t u")]
    got = sorted(map(str, S.near_duplicates(spark, docs(rows)).select("doc_id", "component_id").collect()))
    assert got == sorted(["Row(doc_id=None, component_id=5)", *["Row(doc_id=5, component_id=5)"] * 2, "Row(doc_id=None, component_id=None)"])


def test_one_stays(spark, docs):
    df = docs([(3, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "completely different words here now"), (9, None), (8, "")])
    kept = S.keep_one(spark, df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 8]


def test_rows_are_judged_and_not_ids(spark):
    """Different texts under one id all stay; columns keep names and values; of repeated rows one stays."""
    names = ["_nth", "id", "h", "row", "order", "keep", "fp", "lid", "a.b"]
    texts = ["one text about something else entirely", "another text with words of its own", "one text about something else entirely"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, "a third text that nobody has repeated"), (None, "and a fourth text without an id")]
    full = [(*r, *(f"{c}{k}" for c in names)) for k, r in enumerate(rows)]
    df = spark.createDataFrame([*full, full[1]], ["doc_id", "text", *names])
    out = S.keep_one(spark, df)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in df.limit(5).collect() if r["doc_id"] != 2)


def test_tables_keep_half_the_bits_or_all():
    """A table that keeps few bits would be a bucket of half the documents."""
    assert min(bin(m).count("1") for m in S.masks(6)) == 32


def test_sketches_bound_the_likeness_from_above():
    """No alike pair goes, classes of over 255 hashes included; most others do."""
    rng = np.random.default_rng(3)
    sets, gone = [], 0
    for n in (1, 4, 30, 500, 3000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets += [base, base[: -(-len(base) * 4 // 5)], np.unique(np.concatenate([base, rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]))]
    low = np.arange(400, dtype=np.uint64) * np.uint64(S.CELLS)  # one class for all
    sets += [low, low[:330], low[:100]]
    pairs = list(itertools.combinations(range(len(sets)), 2))
    sketch = [S.sketch_of(x) for x in sets]
    columns = [pa.array([p[k] for p in pairs]) for k in (0, 1)] + [pa.array([sketch[p[k]] for p in pairs]) for k in (0, 1)] + [pa.array([len(sets[p[k]]) for p in pairs]) for k in (0, 1)]
    batch = pa.RecordBatch.from_arrays(columns, ["a", "b", "x", "y", "gx", "gy"])
    left = {(r["a"], r["b"]) for out in S._bounded(iter([batch]), 0.8) for r in out.to_pylist()}
    for a, b in pairs:
        c = len(np.intersect1d(sets[a], sets[b]))
        like = c / (len(sets[a]) + len(sets[b]) - c)
        assert (a, b) in left or like < 0.8
        gone += (a, b) not in left
    assert gone > len(pairs) / 2


def test_alike_documents_beyond_the_radius_meet(spark, docs):
    """Pairs of few words that are alike differ in many bits; MinHash tables find them all the same."""
    rng, rows = random.Random(4), []
    for k in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        at = rng.randrange(6, 54)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:at], f"x{k}", *words[at + 1 :]]))]
    far = sum(bin(S.simhash(rows[2 * k][1].encode(), S.WORDS) ^ S.simhash(rows[2 * k + 1][1].encode(), S.WORDS)).count("1") > S.WIDE for k in range(120))
    assert far > 20
    assert sorted(r["doc_id"] for r in S.keep_one(spark, docs(rows)).collect()) == list(range(0, 240, 2))

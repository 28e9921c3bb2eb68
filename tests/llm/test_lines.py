import random
import re

import pytest
from pyspark.sql import functions as F

from cleanloom.llm import buckets
from cleanloom.llm import lines as L
from cleanloom.llm._common import Scratch


def grams(line, n=9):
    return {line[k : k + n] for k in range(len(line) - n + 1)}


def alike(a, b, least=0.8):
    x, y = grams(a), grams(b)
    return bool(x and y) and len(x & y) >= least * len(x | y)


def slow(rows, least=0.8):
    """(doc_id, position) of the lines to remove."""
    occ = {}
    for i, text in sorted(set(rows), key=str):
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" "):
                occ.setdefault(line.strip(" "), []).append((i, pos))
    names = list(occ)
    root = list(range(len(names)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(names)):
        for b in range(a):
            if alike(names[a], names[b], least):
                root[find(a)] = find(b)
    groups = {}
    for k, x in enumerate(names):
        groups.setdefault(find(k), []).extend(occ[x])
    return {o for g in groups.values() for o in sorted(g)[1:]}


def cleaned(rows):
    gone = slow(rows)
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def test_against_brute_force(spark, docs):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgilmnorstu", k=rng.randint(3, 9))) for _ in range(400)]
    base = [rng.choices(words, k=rng.randint(8, 40)) for _ in range(25)]
    rows = []
    for k in range(60):
        own = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words)
            own.append(rng.choice(["", " "]) + " ".join(line))
        own += rng.choice([[], [""], ["short"], ["*"], ["  "]])
        rows.append((k, "\n".join(own)))
    out = {r["doc_id"]: r["text"] for r in L.deduplicated(spark, docs(rows)).collect()}
    want = cleaned(rows)
    wrong = [i for i in want if out[i] != want[i]]
    assert len(wrong) <= 2  # the bands may miss a pair at the threshold


def test_edges(spark, docs):
    line = "the quick brown foxes jumped over seventeen lazy sleeping hounds yesterday"
    rows = [(1, None), (2, ""), (3, f"{line}\n\n{line}"), (4, line), (4, line), (5, "é" * 40000 + "\nabc"), (6, "abc"), (None, "abc")]
    df = docs(rows)
    out = L.deduplicated(spark, df)
    assert out.columns == df.columns
    got = sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in out.collect())
    want = [("1", None, None), ("2", "", 0), ("3", f"{line}\n", len(line) + 1), ("4", "", 0), ("4", "", 0), ("5", "é" * 40000, 40000), ("6", "", 0), ("None", "abc", 3)]
    assert got == sorted(want, key=lambda r: (r[0], str(r[1])))


def test_large_buckets_use_other_bands(spark, docs, monkeypatch):
    monkeypatch.setattr(buckets, "PAIRS", 3)
    words = [f"word{k:04d}abc" for k in range(60)]
    rows = [(k, " ".join([*words[:40], f"own{k}word"])) for k in range(30)]
    out = {r["doc_id"]: r["text"] for r in L.deduplicated(spark, docs(rows)).collect()}
    assert [i for i, t in out.items() if t] == [0]


def test_large_buckets_are_finished(spark, docs, monkeypatch):
    """Rulers of 40 lengths have one shingle set; chains of lines that the most frequent one isn't like; all against brute force."""
    monkeypatch.setattr(buckets, "PAIRS", 4)
    monkeypatch.setattr(buckets, "PIVOTS", 1)
    rows = [(k, "-" * (9 + k)) for k in range(40)]
    out = {r["doc_id"]: r["text"] for r in L.deduplicated(spark, docs(rows)).collect()}
    assert [i for i, t in out.items() if t] == [0]
    rng = random.Random(3)
    made = []
    for family in range(12):
        own = [f"w{family:02d}x{k:03d}abcde" for k in range(60)]
        for k in range(rng.randint(2, 12)):
            made.append((k % 3, own[k : k + 40]))
    texts = [" ".join(x) for _, x in made]
    members = spark.createDataFrame([(7, k, len(grams(x))) for k, x in enumerate(texts)], "band long, lid long, grams int")
    lines = spark.createDataFrame([(k, x, len(grams(x))) for k, x in enumerate(texts)], "lid long, line string, grams int")
    found = buckets.links(members, lambda pairs, floor: L.compared(pairs, lines, floor), L.LEAST, Scratch(spark, "t"))
    pairs = {(r["a"], r["b"]) for r in found.collect()}
    assert all(alike(texts[a], texts[b]) for a, b in pairs)

    def parts(edges):
        root = list(range(len(texts)))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(k for k in range(len(texts)) if find(k) == find(j)) for j in range(len(texts))}

    every = [(a, b) for b in range(len(texts)) for a in range(b) if alike(texts[a], texts[b])]
    assert every and parts(every) == parts(pairs)


def test_all_positions_are_compared(spark, docs):
    """Lines that agree only where their words begin, or have no words, are told apart; alike ones still meet."""
    cjk = "".join(chr(0x4E00 + k) for k in range(60))
    apart = [f"https://www.example.org/{x}" for x in ("alpha/one", "beta/second", "gamma/3")] + ["Section 10", "Section 19", "Revenue in 2021", "Revenue in 2022"]
    apart += [cjk[:9] + "".join(chr(0x5E00 + 40 * k + j) for j in range(30)) for k in range(3)]
    tabs = "\t".join(chr(0x6E00 + k) for k in range(40))
    close = [cjk, cjk + "\u9000", tabs, tabs + "!"]
    rows = list(enumerate(apart + close))
    out = {r["doc_id"]: r["text"] for r in L.deduplicated(spark, docs(rows)).collect()}
    want, kept = {}, []
    for i, x in rows:
        near = any(alike(x, rows[j][1]) for j in range(i))
        want[i] = "" if near else x
        kept += [] if near else [i]
    assert out == want and kept == [*range(len(apart)), len(apart), len(apart) + 2]


def test_empty(spark, docs):
    assert L.deduplicated(spark, docs([])).count() == 0


def test_no_python_in_the_plan(spark, docs):
    frame = docs([(1, "a b c\nd")])
    lines = spark.createDataFrame([(1, "some line of text")], "lid long, line string")
    parts = [L.without_duplicates(spark, frame), L.occurrences(frame), L.with_bands(L.signatures(lines))]
    plan = "".join(x._jdf.queryExecution().executedPlan().toString() for x in parts)
    assert not re.search("Python|Arrow|Pandas", plan)


def test_columns_keep_their_names_and_values(spark):
    line = "the quick brown foxes jumped over seventeen lazy sleeping hounds yesterday"
    names = ["_id", "id", "_h", "h", "gone", "kept", "row", "lid", "l1", "pos", "line", "_lines", "n_removed", "a.b"]
    rows = [(k, f"{line}\nown {k}", *(f"{c}{k}" for c in names)) for k in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = L.deduplicated(spark, docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(k, f"{line}\nown {k}" if k == 0 else f"own {k}", *r[2:]) for k, r in enumerate(rows)]


def test_recall_and_links_of_all_shingles(spark, docs):
    """Pairs at a likeness near the bound, in text without blanks too; every link found is one, and 0.95 or more are found."""
    rng = random.Random(9)
    rows = []
    for k in range(150):
        base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789" + (" " * 7 if k % 2 else ""), k=rng.randint(60, 300)))
        n = max(1, int(len(base) * 0.11 / 9))
        other = list(base)
        for at in rng.sample(range(len(base)), rng.randint(1, n)):
            other[at] = "#"
        rows += [(2 * k, base.strip()), (2 * k + 1, "".join(other).strip())]
    out = {r["doc_id"]: r["text"] for r in L.deduplicated(spark, docs(rows)).collect()}
    text = dict(rows)
    near = [k for k in range(150) if alike(text[2 * k], text[2 * k + 1])]
    found = [k for k in range(150) if out[2 * k + 1] == ""]
    assert all(out[2 * k] for k in range(150)) and set(found) <= set(near)
    assert 20 < len(near) < 150 and len(found) >= 0.95 * len(near)


def families(n, seed=1):
    """n pairs of lines of one template: a likeness of about 0.88 inside a family and 0.75 across."""
    draw = random.Random(seed)
    sign = lambda k: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    head, tail = sign(100), sign(90)
    for k in range(n):
        own = sign(8)
        yield from ((2 * k, head + own + tail + sign(13)), (2 * k + 1, head + own + tail + sign(13)))


def test_families_of_a_large_bucket(spark, docs):
    """Of hundreds of families of one template, nine in ten or more are linked, and nothing else."""
    got = L.without_duplicates(spark, docs(list(families(300)))).where("n_removed > 0").select("row.doc_id").collect()
    assert len(got) >= 270 and all(r.doc_id % 2 for r in got)


def test_exact_finds_every_family_of_a_large_bucket(spark, docs):
    """Templates with different fillings share buckets of over PAIRS members; ``exact`` links each family all the same."""
    rows = list(families(80))
    made = L.without_duplicates(spark, docs(rows), exact=True).where("n_removed > 0").select("row.doc_id").collect()
    assert sorted(r.doc_id for r in made) == sorted(a for a, _ in slow(rows)) == list(range(1, 160, 2))


def test_large_buckets_are_finished_by_default(spark, docs, monkeypatch):
    """A bucket whose families neither its least members nor a few shared keys connect: every link is found, and few pairs are made for it."""
    rows = list(families(300, seed=5))
    members = spark.createDataFrame([(7, i, len(grams(x))) for i, x in rows], "band long, lid long, grams int")
    texts = spark.createDataFrame([(i, x, len(grams(x))) for i, x in rows], "lid long, line string, grams int")
    asked = []

    def compare(pairs, floor):
        asked.append(pairs.count())
        return L.compared(pairs, texts, floor)

    found = buckets.links(members, compare, L.LEAST, Scratch(spark, "t"), lambda some: L.tokens_of(texts.join(some, "lid")))
    assert {(r["a"], r["b"]) for r in found.collect()} == {(2 * k, 2 * k + 1) for k in range(300)}
    assert sum(asked) <= 5 * len(rows)  # two stars and the families


def test_tokens_find_what_brute_force_finds(spark, monkeypatch):
    """Lines at likenesses about the bound and of many lengths in one bucket; the components are those of all pairs."""
    monkeypatch.setattr(buckets, "PAIRS", 2)
    rng, texts = random.Random(11), []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6):06d}" for _ in range(rng.randint(6, 30))]
        for _ in range(rng.randint(2, 9)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6):06d}"
            texts.append(" ".join(own[: len(own) - rng.randint(0, 3)]))
    texts = sorted(set(texts))
    members = spark.createDataFrame([(7, k, len(grams(x))) for k, x in enumerate(texts)], "band long, lid long, grams int")
    lines = spark.createDataFrame([(k, x, len(grams(x))) for k, x in enumerate(texts)], "lid long, line string, grams int")
    made = buckets.links(members, lambda pairs, floor: L.compared(pairs, lines, floor), L.LEAST, Scratch(spark, "t"), lambda some: L.tokens_of(lines.join(some, "lid")))
    made = [(r["a"], r["b"]) for r in made.collect()]
    every = [(a, b) for b in range(len(texts)) for a in range(b) if alike(texts[a], texts[b])]

    def parts(edges):
        root = list(range(len(texts)))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in edges:
            root[find(a)] = find(b)
        return [find(k) for k in range(len(texts))], find

    (_, one), (_, two) = parts(every), parts(made)
    assert set(made) <= set(every) and len(every) > 20
    assert all(two(a) == two(b) for a, b in every) and all(one(a) == one(b) for a, b in made)


def test_signatures_are_minima_of_all_shingles(spark):
    """Lines of 1 to 3 rows of shingles and the numbers between; each minimum is that over the shingles one by one."""
    text = "abcdefghijklmnopqrstuv\u00e9\U0001f600xyz"
    lines = spark.createDataFrame([(n, text[:n]) for n in range(9, len(text) + 1)], "lid long, line string")
    one = lines.select("lid", F.explode(F.sequence(F.lit(1), F.length("line") - 8)).alias("at"), "line")
    one = one.select("lid", F.hash(F.encode(F.col("line").substr(F.col("at"), F.lit(9)), "UTF-32")).alias("h"))
    want = one.groupBy("lid").agg(*(F.min(F.col("h").bitwiseXOR(F.lit(x))).alias(f"m{k}") for k, x in enumerate(L._ORDERS)))
    assert sorted(map(tuple, L.signatures(lines).collect())) == sorted(map(tuple, want.collect()))


def test_shared_bands_are_dealt_out_once(spark, monkeypatch):
    """Bands of one, two and many lines: the shared ones stay, whether counted or found to be large, and one shuffle finds them."""
    monkeypatch.setattr(L, "LOOK", 1)
    monkeypatch.setattr(L, "HOT", 5)
    rng = random.Random(13)
    minima = [f"m{k}" for k in range(L.MINIMA)]
    rows = [(k, *(rng.randrange(2 + 3 * (k % 4)) if k % 5 else rng.randrange(10**9) for _ in minima)) for k in range(400)]
    signed = spark.createDataFrame(rows, "lid long, " + ", ".join(f"{m} int" for m in minima))
    got = L.meeting(signed, Scratch(spark, "t"))
    by = {}
    for r in L.with_bands(signed).collect():
        by.setdefault(r["band"], set()).add(r["lid"])
    want = sorted((lid, band) for band, lids in by.items() if len(lids) > 1 for lid in lids)
    assert sorted(map(tuple, got.select("lid", "band").collect())) == want
    sizes = {len(x) for x in by.values()}
    assert {1, 2} <= sizes and max(sizes) >= 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_large_bands_meet_in_no_task(spark, monkeypatch):
    """The rows of a large band are dealt out by line: the window that counts has no group of more than one for it."""
    monkeypatch.setattr(L, "LOOK", 1)
    monkeypatch.setattr(L, "HOT", 50)
    minima = [f"m{k}" for k in range(L.MINIMA)]
    signed = spark.createDataFrame([(k, *([7] * L.MINIMA)) for k in range(300)], "lid long, " + ", ".join(f"{m} int" for m in minima))
    got = L.meeting(signed, Scratch(spark, "t"))
    keys = got.select("band").distinct().count()
    assert (keys, got.count()) == (L.MINIMA, 300 * L.MINIMA)
    assert L.dealt(signed, Scratch(spark, "t")).groupBy("by").count().agg(F.max("count")).head()[0] == 1


def test_tokens_of_one_label_are_not_ranked(spark):
    """Two large components with templates of their own and a few lines of both: only tokens that two labels have are ranked and meet."""
    draw = random.Random(17)
    sign = lambda k: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    one, two = sign(200), sign(200)
    texts = [x + sign(12) for x in [one] * 40 + [two] * 40] + [one[:170] + sign(40), one[:170] + sign(40), one[:180] + two[:100], two[:100] + one[:180]]
    labels = [0] * 40 + [40] * 40 + [80, 81, 82, 83]
    rows = [(k, label, len(grams(x))) for k, (x, label) in enumerate(zip(texts, labels, strict=True))]
    members = spark.createDataFrame(rows, "lid long, label long, grams int")
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "lid long, line string")
    seen = {}

    class Seen(Scratch):
        def cut(self, frame, label="t"):
            out = super().cut(frame, label)
            seen[label] = out.count()
            return out

    made = buckets._by_tokens(members, lambda some: L.tokens_of(lines.join(some, "lid")), L.LEAST, Seen(spark, "t"))
    made = {(r["a"], r["b"]) for r in made.collect()}
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if labels[a] != labels[b] and alike(texts[a], texts[b])]
    assert pairs and set(pairs) <= made
    of = {}
    for x, label in zip(texts, labels, strict=True):
        for g in grams(x):
            of.setdefault(g, set()).add(label)
    assert seen["often"] == sum(len(x) > 1 for x in of.values())


def test_numbers_of_lines(spark, docs):
    texts = [None, "", "\n", "a\n\n", "a\nb\r\nc", "\u00e9\n\U0001f600", "x"]
    out = L.without_duplicates(spark, docs(list(enumerate(texts)))).select("row.doc_id", "n_lines")
    assert dict(map(tuple, out.collect())) == {k: 0 if t is None else len(t.split("\n")) for k, t in enumerate(texts)}

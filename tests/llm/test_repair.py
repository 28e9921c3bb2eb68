"""Repair of conversations against all ways of editing them, and segment by segment against whole."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cleanloom.llm import repair as R
from cleanloom.llm._common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_parse(initials, faults):
    """Least (cost, audit) over all edits, by plain dynamic programming over four states."""
    best = {0: (0, "")}  # 0 nothing yet, 1 after s, 2 after u, 3 after a

    def put(new, state, value):
        if state not in new or value < new[state]:
            new[state] = value

    def inserted(states):
        for _ in range(4):
            for q, (c, a) in list(states.items()):
                put(states, 3 if q == 2 else 2, (c + 5, a + "I"))
        return states

    inserted(best)
    for x, f in zip(initials, faults, strict=True):
        new = {}
        for q, (c, a) in best.items():
            put(new, q, (c + 2, a + "D"))
            if f in "bd":
                continue
            more = 5 * (f == "t")
            after = 3 if q == 2 else 2
            put(new, after, (c + 1 + more, a + "R"))
            if x == ("a" if q == 2 else "u"):
                put(new, after, (c + more, a + "K"))
            if x == "s" and q == 0:
                put(new, 1, (c + more, a + "K"))
        best = inserted(new)
    return min(best[q] for q in (0, 3) if q in best)


def plain_conversation(rows):
    """The contract's columns of one conversation, of its rows in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    seen, faults = set(), ""
    for _, r, x in rows:
        own = x.rstrip(R.BLANKS)
        faults += "b" if not own else "d" if (r, x) in seen else "-" if own[-1] in ".!?" else "t"
        seen.add((r, x))
    initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for _, r, _ in rows)
    cost, audit = plain_parse(initials, faults)
    lines, k, want = [], 0, "user"
    for e in audit:
        row = rows[k] if e != "I" else None
        k += e != "I"
        if e == "D":
            continue
        lines.append(f"{row[1]}:{row[2]}" if e == "K" else f"{want}:{row[2] if row else ''}")
        if not (len(lines) == 1 and e == "K" and row[1][:1] == "s"):
            want = "assistant" if want == "user" else "user"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha)


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [] if k == 0 else [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def by_conversation(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda row: (row[1] is not None, row[1] or 0)):
        out.setdefault(c, []).append((t, r, x))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_parse_is_the_least_of_all_edits(seed):
    draw = random.Random(seed)
    for _ in range(40):
        n = draw.randrange(0, 12)
        initials = "".join(draw.choice("suua-aau") for _ in range(n))
        faults = "".join(draw.choice("-----tbd") for _ in range(n))
        cells = R.parsed("begin", initials, faults)
        assert min(cells[x] for x in ("begin", "end") if x in cells) == plain_parse(initials, faults)
        cut = sorted(draw.randrange(0, n + 1) for _ in range(3))
        parts = [(initials[a:b], faults[a:b]) for a, b in zip([0, *cut], [*cut, n], strict=True)]
        cells = [[{"entry": e, "exit": x, "cost": c, "audit": a} for e in R.ENTRIES for x, (c, a) in R.parsed(e, i, f).items()] for i, f in parts]
        segments = [{"seg": k, "cells": c, "initials": i, "faults": f, "low": None, "high": None, "turns": 0} for k, (c, (i, f)) in enumerate(zip(cells, parts, strict=True))]
        made = R.chained(segments)
        assert (made["cost"], made["audit"]) == plain_parse(initials, faults) and "".join(p["audit"] for p in made["pieces"]) == made["audit"]
        roles = "".join(R.given_roles(p["entry"], i, p["audit"]) for p, (i, _) in zip(made["pieces"], parts, strict=True))
        assert roles == R.given_roles("begin", initials, made["audit"])


def test_given_sequences():
    assert R.parsed("begin", "sua", "---")["end"] == (0, "KKK")
    assert plain_parse("uu", "--") == (1, "KR") and plain_parse("s", "-") == (2, "D") and plain_parse("", "") == (0, "")


@pytest.mark.parametrize("segment", [1000, 3])
def test_like_plain_python(spark, monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT", segment)
    draw = random.Random(7)
    texts = ["fine.", "also fine!", "breaks off", "", " \n\t", None, "why? ", "é.", "."]
    rows = [(draw.choice([None, *range(40)]), draw.choice([None, *range(30)]), draw.choice(["user", "assistant", "system", None, "tool", ""]), draw.choice(texts)) for _ in range(900)]
    once = {}
    for r in rows:  # ties have no order to compare with
        once.setdefault(r[:2], r)
    rows = [*once.values(), (50, 1, "user", "one.")] + [(51, 1, "user", "same.")] * 9 + [(52, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(60)]
    found, fixed = R.repaired(spark, spark.createDataFrame(rows, SCHEMA), Scratch(spark, "repair"))
    sha = {r.conv_id: r.repaired_sha256 for r in R.digests(fixed).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha.get(r.conv_id, hashlib.sha256().hexdigest())) for r in found.collect()}
    assert got == {c: plain_conversation(x) for c, x in by_conversation(rows).items()}


def test_query_like_plain_python(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None, None, None, None), (9000, None, "user", None), (9001, 4, "assistant", "x.")]
    spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in R.query(spark, str(tmp_path)).collect()}
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, *_ in rows}
    want |= {c: plain_conversation(x) for c, x in by_conversation(plain_damage(rows)).items()}
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert R.query(spark, str(tmp_path)).count() == 0


def test_a_hot_conversation_is_parsed_in_many_tasks(spark):
    rows = spark.range(6000, numPartitions=4).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    scratch = Scratch(spark, "repair")
    segments = R._segments(R._faults(R._conversations(rows), scratch)).select("seg", F.length("initials").alias("n")).collect()
    assert len(segments) >= 6 and max(s.n for s in segments) <= R.SEGMENT and len({s.seg >> 33 for s in segments}) > 1
    found, fixed = R.repaired(spark, rows, scratch)
    assert found.select("cost", "audit", "gaps").collect() == [(0, "K" * 6000, 0)] and fixed.count() == 6000

"""Repair of conversations: weighted error-correcting Earley parsing of their roles.

A conversation should read S, the grammar below: nothing, or turns of user and assistant,
after one of the system or none. Productions for errors let a row be deleted (2), be given
the role of user or assistant (1), or an empty row of these be inserted (5). Blank rows and
rows that repeat role and text of an earlier one can only be deleted; a row whose text breaks
off costs 5 more unless it is. Chart items keep the least (cost, audit), the audit being the
initials of the edits: Delete, Insert, Keep, Rerole. Equal costs have audits of which none
begins with another, so the least of a whole is made of the least of its parts.

That also lets a conversation be parsed in segments. Rows are dealt by ranges of
(conversation, turn, hash, place) and sorted, so a conversation of any size spreads over
tasks; each task parses its rows in segments of SEGMENT at most, a segment of unknown
beginning once for each of the four things that a conversation can wait for (ENTRIES). The
segments' least costs from entry to exit are then chained, conversation by conversation.
Without its texts a row is some forty bytes, and only such rows take part; the texts are
joined to the edits last. What one task holds of a conversation is its audit and a few of
its length beside it; its digest is taken by streaming over the sorted rows.

Rows of a conversation are taken by turn, nulls first, and ties by a hash of role and text.
Nulls in role and text stand for one space; a null id is an id like others. Rows that are
equal in all columns are duplicates of the first. Places tell rows apart for the length of
one query; what comes out of a shuffle is to be written to a table first. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.llm._common import Scratch

GRAMMAR = {"S": [(), ("B",)], "B": [("s", "u", "a"), ("u", "a"), ("B", "u", "a")]}
KEEP, REROLE, DELETE, INSERT, BROKEN_OFF = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
SEGMENT = 1000
BLANKS = " \t\n\x0b\x0c\r"
#: Faults of a row; the first that holds counts.
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "-"

#: (left side, right side, dot). What begins in the middle of a conversation began at its first row.
Item = tuple[str, tuple[str, ...], int]
_WAITING: list[Item] = [(left, right, 0) for left, rules in GRAMMAR.items() for right in rules if right[:1] == ("B",)]
#: What a conversation can wait for: its beginning, a user after the system, an assistant, or nothing (a user may follow).
ENTRIES: dict[str, list[Item]] = {
    "begin": [("S", right, 0) for right in GRAMMAR["S"]],
    "user": [("B", ("s", "u", "a"), 1)],
    "assistant": [("B", ("B", "u", "a"), 2)],
    "end": [("S", ("B",), 1), ("B", ("B", "u", "a"), 1)],
}
Cells = dict[str, tuple[int, str]]


def _exit(item: Item) -> str | None:
    left, right, dot = item
    if left == "S":
        return "end" if dot else None if right else "begin"
    return {("u", "a"): "user" if dot and right[0] == "s" else None, ("a",): "assistant"}.get(right[dot:])


def _closed(column: list[tuple[int, str, Item]]) -> dict[Item, tuple[int, str]]:
    """The items with all that they predict, complete or reach by insertion, the least first."""
    heapq.heapify(column)
    chart: dict[Item, tuple[int, str]] = {}
    while column:
        cost, audit, item = heapq.heappop(column)
        if item in chart:
            continue
        chart[item] = (cost, audit)
        left, right, dot = item
        if dot == len(right):
            if left == "B":
                for upper, rule, _ in _WAITING:
                    heapq.heappush(column, (cost, audit, (upper, rule, 1)))
        elif right[dot] in GRAMMAR:
            for rule in GRAMMAR[right[dot]]:
                heapq.heappush(column, (cost, audit, (right[dot], rule, 0)))
        elif right[dot] in ROLES:
            heapq.heappush(column, (cost + INSERT, audit + "I", (left, right, dot + 1)))
    return chart


def _scanned(chart: dict[Item, tuple[int, str]], initial: str, fault: str) -> list[tuple[int, str, Item]]:
    """The items after one more row."""
    column = []
    for item, (cost, audit) in chart.items():
        left, right, dot = item
        wanted = right[dot] if dot < len(right) else None
        if wanted in GRAMMAR or (wanted is None and left != "S"):
            continue
        column.append((cost + DELETE, audit + "D", item))
        if wanted is None or fault in (BLANK, DUPLICATE):
            continue
        more = BROKEN_OFF if fault == TRUNCATED else 0
        after = (left, right, dot + 1)
        if wanted == initial:
            column.append((cost + KEEP + more, audit + "K", after))
        if wanted in ROLES:
            column.append((cost + REROLE + more, audit + "R", after))
    return column


def _parsed(entry: str, initials: str, faults: str) -> Cells:
    chart = _closed([(0, "", item) for item in ENTRIES[entry]])
    for initial, fault in zip(initials, faults, strict=True):
        chart = _closed(_scanned(chart, initial, fault))
    out: Cells = {}
    for item, found in chart.items():
        if (x := _exit(item)) and found < out.get(x, (found[0] + 1, "")):
            out[x] = found
    return out


@lru_cache(maxsize=1 << 16)
def _remembered(entry: str, initials: str, faults: str) -> Cells:
    return _parsed(entry, initials, faults)


def parsed(entry: str, initials: str, faults: str) -> Cells:
    """The least (cost, audit) with which rows lead from an entry to each exit."""
    return (_remembered if len(initials) <= 32 else _parsed)(entry, initials, faults)


def given_roles(entry: str, initials: str, audit: str) -> str:
    """For every edit the initial of the role that it gives, = for the row's own, - where the row goes."""
    out, at, want = [], 0, {"assistant": "a"}.get(entry, "u")
    begun = entry != "begin"
    for edit in audit:
        own = initials[at] if edit != "I" else ""
        at += edit != "I"
        if edit == "D":
            out.append("-")
            continue
        out.append("=" if edit == "K" else want)
        if not (edit == "K" and own == "s" and not begun):
            want = "a" if want == "u" else "u"
        begun = True
    return "".join(out)


def _conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place)."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *known, F.monotonically_increasing_id().alias("place"))


def _faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, h, place, initial, fault) of every row."""
    hashes = [F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    own = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(own == "", BLANK).when(F.right(own, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    initial = F.left("role", F.lit(1))
    narrow = rows.select("conv_id", "turn", *hashes, "place", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), fault.alias("fault"))
    first = F.min(F.struct("turn", "place")).alias("first")
    again = narrow.groupBy("conv_id", "h", "h2").agg(F.count("*").alias("n"), first).where("n > 1")
    # the hashes are of the conversation too: rows without an id, or of one conversation, don't meet in one task
    again = scratch.cut(again.select(F.xxhash64("conv_id", "h").alias("k"), F.xxhash64("h2", "conv_id").alias("k2"), "first"), "again")
    keyed = narrow.withColumns({"k": F.xxhash64("conv_id", "h"), "k2": F.xxhash64("h2", "conv_id")})
    later = F.col("first").isNotNull() & (F.struct("turn", "place") != F.col("first"))
    both = keyed.join(again, ["k", "k2"], "left")
    return both.select("conv_id", "turn", "h", "place", "initial", F.when(later & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")).alias("fault"))


CELLS = "array<struct<entry:string,exit:string,cost:long,audit:string>>"
PIECES = "array<struct<seg:long,entry:string,audit:string>>"


def _schemas(of: DataFrame, columns: dict[str, str]) -> tuple[T.StructType, pa.Schema]:
    """Spark's and Arrow's schema of conv_id, as it is in ``of``, and further columns."""
    fields = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    schema = T.StructType([of.schema["conv_id"], *T.StructType.fromDDL(fields)])
    return schema, of.sparkSession.createDataFrame([], schema).toArrow().schema


def _segments(rows: DataFrame) -> DataFrame:
    """(conv_id, seg, places, initials, faults, low, high, turns, cells): rows in order, parsed from each entry that is possible.

    Segments are numbered in order. ``turns`` counts different turns; low and high are the first and the last.
    """
    schema, arrow = _schemas(rows, {"seg": "long", "places": "array<long>", "initials": "string", "faults": "string", "low": "long", "high": "long", "turns": "long", "cells": CELLS})
    names = schema.names

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        out: list[dict] = []
        now: list[tuple] = []
        begins = False  # whether the conversation begins with this segment for certain

        def end() -> None:
            nonlocal number
            initials, faults = "".join(r[3] for r in now), "".join(r[4] for r in now)
            turns = [r[1] for r in now if r[1] is not None]
            cells = [
                {"entry": e, "exit": x, "cost": c, "audit": a}
                for e in (["begin"] if begins else ENTRIES)
                for x, (c, a) in parsed(e, initials, faults).items()
            ]
            values = (now[0][0], number, [r[2] for r in now], initials, faults, turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), cells)
            out.append(dict(zip(names, values, strict=True)))
            number += 1
            now.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "place", "initial", "fault")), strict=True):
                if now and (other := row[0] != now[0][0]) | (len(now) >= SEGMENT):
                    end()
                    begins = other
                now.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
        if now:
            end()
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    order = ["conv_id", "turn", "h", "place"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(segments, schema)


def chained(segments: list[dict]) -> dict:
    """What a conversation comes to, of its segments in order."""
    reached: Cells = {"begin": (0, "")}
    ways: list[dict[str, tuple[str, str]]] = []
    for s in segments:
        after: Cells = {}
        way: dict[str, tuple[str, str]] = {}
        for c in s["cells"]:
            if c["entry"] in reached:
                cost, audit = reached[c["entry"]]
                new = (cost + c["cost"], audit + c["audit"])
                if c["exit"] not in after or new < after[c["exit"]]:
                    after[c["exit"]], way[c["exit"]] = new, (c["entry"], c["audit"])
        reached = after
        ways.append(way)
    at = min((x for x in ("begin", "end") if x in reached), key=lambda x: reached[x])
    cost, audit = reached[at]
    pieces = []
    for s, way in zip(reversed(segments), reversed(ways), strict=True):
        at, own = way[at]
        pieces.append({"seg": s["seg"], "entry": at, "audit": own})
    counts = {name: sum(s["faults"].count(f) for s in segments) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    illegal, before, turns, last = 0, "", 0, None
    for s in segments:
        row = before + s["initials"]
        illegal += sum(row[k : k + 2] not in LEGAL for k in range(len(row) - 1))
        before = row[-1:]
        turns += s["turns"] - (last is not None and last == s["low"])
        last = s["high"] if s["high"] is not None else last
    known = [s["low"] for s in segments if s["low"] is not None]
    gaps = last - known[0] + 1 - turns if known else 0
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "pieces": pieces[::-1]}


def _chains(segments: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, pieces), a row for each conversation."""
    counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "long")
    schema, arrow = _schemas(segments, {**counts, "audit": "string", "pieces": PIECES})

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200).to_pylist()
                yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], **chained(sorted(r["parts"], key=lambda s: s["seg"]))} for r in rows], schema=arrow)

    parts = F.collect_list(F.struct("seg", "initials", "faults", "low", "high", "turns", "cells")).alias("parts")
    return segments.groupBy("conv_id").agg(parts).mapInArrow(chains, schema)


def _edits(chains: DataFrame, segments: DataFrame) -> DataFrame:
    """(conv_id, seg, pos, place, role) of every row that stays or is inserted; place is null for the latter, role for rows that keep theirs."""
    piece = chains.select(F.inline("pieces"))
    both = piece.join(segments.select("conv_id", "seg", "places", "initials"), "seg")
    schema, arrow = _schemas(segments, {"seg": "long", "pos": "long", "place": "long", "role": "string"})

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for r in batch.slice(at, 200).to_pylist():
                    k = 0
                    for pos, (edit, role) in enumerate(zip(r["audit"], given_roles(r["entry"], r["initials"], r["audit"]), strict=True)):
                        place = None if edit == "I" else r["places"][k]
                        k += edit != "I"
                        if edit != "D":
                            out.append({"conv_id": r["conv_id"], "seg": r["seg"], "pos": pos, "place": place, "role": ROLES.get(role)})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return both.mapInArrow(edits, schema)


def repaired(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation, and its rows after repair.

    The latter are (conv_id, seg, pos, turn, role, text), in order of seg and pos; an inserted row has a null turn.
    """
    rows = _conversations(rows)
    segments = scratch.cut(_segments(_faults(rows, scratch)), "segments")
    chains = scratch.cut(_chains(segments), "chains")
    edits = scratch.cut(_edits(chains, segments), "edits")
    kept = edits.where("place IS NOT NULL").withColumnRenamed("role", "given").drop("conv_id").join(rows, "place")
    kept = kept.select("conv_id", "seg", "pos", "turn", F.coalesce("given", "role").alias("role"), "text")
    new = edits.where("place IS NULL").select("conv_id", "seg", "pos", F.lit(None).cast("long").alias("turn"), "role", F.lit("").alias("text"))
    return chains.drop("pieces"), kept.unionByName(new)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows, as lines of role:text; texts are streamed in order."""
    schema, arrow = _schemas(rows, {"repaired_sha256": "string"})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, out = None, None, []
        for batch in batches:
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line"), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append({"conv_id": now, "repaired_sha256": state.hexdigest()})
                    state, now = hashlib.sha256(), conv
                else:
                    state.update(b"\n")
                state.update(line.as_py().encode())
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
            out = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": state.hexdigest()}], schema=arrow)

    lines = rows.select("conv_id", "seg", "pos", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "pos").select("conv_id", "line")
    return ordered.mapInArrow(digest, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults by a checksum of conversation and turn: some go, lose text or marks, are there twice or get another role."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    k = F.col("damage")
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("damage")).where(k != 0)
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hit = hit.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return hit.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found, fixed = repaired(spark, damaged(rows), scratch := Scratch(spark, "repair"))
    every = rows.groupBy("conv_id").count().select(F.col("conv_id").alias("id"))
    lines = scratch.cut(digests(fixed), "digests").withColumnRenamed("conv_id", "d")
    out = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(lines, F.col("id").eqNullSafe(F.col("d")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))

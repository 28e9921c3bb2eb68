"""Removal of byte strings that repeat anywhere in the corpus, by prefix-free parsing.

A byte is removed if a string of LENGTH bytes that covers it also starts elsewhere, in
another document or the same. Equal strings are the ones that stand together in the
corpus order of suffixes at depth LENGTH, and that order is taken apart as prefix-free
parsing does it:

* A rolling hash over W bytes makes triggers; phrases run from trigger to trigger. The
  dictionary has each phrase once, the parse is the sequence of phrases of every text.
  A string that repeats has the same triggers and whole phrases wherever it stands, so all
  whole phrases in it stand in the parse at least twice; all other starts are ruled out.
* Starts that share their next trigger form a run. The suffix of the parse from the run on
  gives the class of the run as a whole: where it repeats, every start of the run does.
* The few runs that differ somewhere are ordered by the suffix of the dictionary phrase
  before the trigger, against one member of each class of runs that goes on with the
  same phrase: first in blocks of STEP starts, by what all of them share and what they
  cover together, then start by start.
* Starts with no whole phrase in their string are compared one by one.

Classes are found by grouping on 128-bit hashes rather than by one sorted suffix array:
that needs a row for each run and not for each byte, and has no group in one task.

Null text counts as empty. Equal texts are held once with their number, so copies of any
number cost no more. Repeated rows and null ids are rows of their own. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm._common import Scratch, slices

LENGTH = 400
W = 16
#: One in so many places is a trigger.
MEAN = 48
#: Starts ruled out together.
STEP = 16
_LUT = np.random.default_rng(4).integers(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_POWERS = (2654435761, 2246822519, 3266489917, 668265263)


def triggers(text: bytes) -> np.ndarray:
    """Starts of the W-byte strings whose hash is a trigger, ascending."""
    n = len(text) - W + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = _LUT[np.frombuffer(text, np.uint8)]
    for k, power in enumerate(_POWERS):  # hashes of 2, 4, 8 and 16 bytes
        h = h[: -(1 << k)] * np.uint32(power) + h[1 << k :]
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return np.flatnonzero(h < np.uint32((1 << 32) // MEAN))


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _hash(text: memoryview) -> tuple[int, int]:
    return _halves(xxhash.xxh3_128_digest(text))


def phrase_hashes(text: bytes, tr: np.ndarray) -> list[int]:
    view, at = memoryview(text), tr.tolist()
    return [xxhash.xxh3_64_intdigest(view[a : b + W]) - (1 << 63) for a, b in zip(at, at[1:], strict=False)]


def whole_phrases(text: bytes, tr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every start: its next trigger's number, and the number of the last trigger that lies in its string."""
    flags = np.zeros(len(text) + 1, np.int32)
    flags[tr] = 1
    before = np.concatenate([[0], np.cumsum(flags)]).astype(np.int32)  # triggers below a place
    n = len(text) - LENGTH + 1
    return before[:n], before[LENGTH - W + 1 : LENGTH - W + 1 + n] - 1


def _starts(mask: np.ndarray, group: np.ndarray) -> tuple[list[int], list[int]]:
    """Begin and end of the stretches of true in ``mask`` with one value of ``group``."""
    edge = np.flatnonzero((mask[1:] != mask[:-1]) | (group[1:] != group[:-1])) + 1
    begin = np.concatenate([[0], edge])
    end = np.concatenate([edge, [len(mask)]])
    keep = mask[begin]
    return begin[keep].tolist(), end[keep].tolist()


PARSE = "tid long, copies long, phrases array<long>, loose array<struct<p:int,k1:long,k2:long>>"
LOOSE = pa.list_(pa.struct([("p", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of each text, and the starts whose string has no whole phrase."""
    for batch in slices(batches):
        phrases, loose = [], []
        for text in batch.column("text").cast(pa.large_binary()).to_pylist():
            tr = triggers(text)
            phrases.append(phrase_hashes(text, tr))
            own = []
            if len(text) >= LENGTH:
                nxt, last = whole_phrases(text, tr)
                view = memoryview(text)
                for p in np.flatnonzero(last <= nxt).tolist():
                    own.append((p, *_hash(view[p : p + LENGTH])))
            loose.append([{"p": p, "k1": a, "k2": b} for p, a, b in own])
        yield pa.RecordBatch.from_arrays(
            [batch.column("tid"), batch.column("copies"), pa.array(phrases, pa.list_(pa.int64())), pa.array(loose, LOOSE)],
            ["tid", "copies", "phrases", "loose"],
        )


RUNS = "tid long, copies long, a int, b int, o1 long, o2 long, follows long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of starts whose whole phrases all repeat, with the hash of all they cover and the phrase that follows."""
    for batch in slices(batches):
        out: list[tuple] = []
        for tid, copies, text, marks in zip(
            batch.column("tid").to_pylist(), batch.column("copies").to_pylist(),
            batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("marks"), strict=True,
        ):
            if len(text) < LENGTH:
                continue
            tr = triggers(text)
            single = np.ones(len(tr) + 1, np.int32)
            single[np.asarray(marks.values)] = 0
            singles = np.concatenate([[0], np.cumsum(single)])
            nxt, last = whole_phrases(text, tr)
            mask = (last > nxt) & (singles[np.maximum(last, nxt)] == singles[nxt])
            if not mask.any():
                continue
            view, at = memoryview(text), tr.tolist()
            for a, b in zip(*_starts(mask, nxt), strict=True):
                k = int(nxt[a])
                follows = xxhash.xxh3_64_intdigest(view[at[k] : at[k + 1] + W]) - (1 << 63)
                out.append((tid, copies, a, b, *_hash(view[a : b - 1 + LENGTH]), follows))
        yield _batch(out, RUNS)


BLOCKS = "tid long, p int, d int, c1 long, c2 long, b1 long, b2 long, open int, keys array<long>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of starts by their distance d from the next trigger: what all their strings share (c), all that
    they cover (b), and a key for each.

    Within a block key i belongs to start p + i, at distance d - i.
    """
    for batch in slices(batches):
        out: list[tuple] = []
        for tid, text, runs in zip(
            batch.column("tid").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True
        ):
            tr, view = triggers(text), memoryview(text)
            for a, b, open_ in sorted({(r["a"], r["b"], r["open"]) for r in runs}):
                t = int(tr[np.searchsorted(tr, a)])
                while a < b:
                    low = (t - a) // STEP * STEP  # distances low to low + STEP - 1
                    end = min(b, t - low + 1)
                    core = _hash(view[t - low : t - low - STEP + 1 + LENGTH])
                    keys = [xxhash.xxh3_64_intdigest(view[p : p + LENGTH]) - (1 << 63) for p in range(a, end)]
                    out.append((tid, a, t - a, *core, *_hash(view[a : end - 1 + LENGTH]), open_, keys))
                    a = end
        yield _batch(out, BLOCKS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    of = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


KEPT = "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the bytes of a text of n bytes that lie in [begin, end) of any interval."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, begin, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) > 0


def _remove(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: list[tuple] = []
        for digest, copies, text, spans, starts in zip(
            batch.column("digest").to_pylist(), batch.column("copies").to_pylist(),
            batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans"), batch.column("starts"), strict=True,
        ):
            kept, removed, n_spans = text, 0, 0
            if copies > 1 and len(text) >= LENGTH:
                kept, removed, n_spans = b"", len(text), 1
            elif spans.is_valid or starts.is_valid:
                begin, end = (np.asarray(spans.values.field(k)) if spans.is_valid else np.empty(0, np.int64) for k in (0, 1))
                alone = np.asarray(starts.values) if starts.is_valid else np.empty(0, np.int64)
                gone = covered(len(text), np.concatenate([begin, alone]).astype(np.int64), np.concatenate([end, alone + LENGTH]).astype(np.int64))
                removed = int(gone.sum())
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((digest, len(text), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if whole else None))
        columns = zip(*out, strict=True) if out else [[] for _ in range(6)]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in KEPT.split(", ")])


def remove_repeats(spark: SparkSession, docs: DataFrame, whole: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; ``kept`` is null unless ``whole``."""
    scratch = Scratch(spark, "pfp")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    texts = scratch.cut(
        keyed.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies")).withColumn("tid", F.monotonically_increasing_id()),
        "texts",
    )
    long_ = texts.where(F.octet_length("text") >= LENGTH)  # shorter ones have no string of LENGTH
    parse = scratch.cut(long_.select("tid", "copies", "text").mapInArrow(_parse, PARSE), "parse")

    # phrases that stand in the parse more than once
    dictionary = parse.select("copies", F.explode("phrases").alias("h")).groupBy("h").agg(F.sum("copies").alias("n")).where("n > 1").select("h")
    dictionary = scratch.cut(dictionary, "dictionary")
    marks = scratch.cut(
        parse.select("tid", F.posexplode("phrases").alias("i", "h")).join(dictionary, "h").groupBy("tid").agg(F.collect_list("i").alias("marks")), "marks"
    )
    loose = scratch.cut(_repeated_loose(parse, scratch), "loose")
    scratch.drop(parse)

    runs = scratch.cut(long_.select("tid", "copies", "text").join(marks, "tid").mapInArrow(_runs, RUNS), "runs")
    scratch.drop(marks)
    classes = scratch.cut(
        runs.groupBy("o1", "o2").agg(F.sum("copies").alias("n"), F.min(F.struct("tid", "a", "b", "follows")).alias("r")), "classes"
    )
    one, many = classes.where("n = 1").select("r.*"), classes.where("n > 1").select("r.*")
    against = many.join(one.select("follows").distinct(), "follows", "left_semi")
    both = one.withColumn("open", F.lit(1)).unionByName(against.withColumn("open", F.lit(0)))
    chosen = both.groupBy("tid").agg(F.collect_list(F.struct("a", "b", "open")).alias("runs"))
    blocks = scratch.cut(long_.select("tid", "text").join(chosen, "tid").mapInArrow(_blocks, BLOCKS), "blocks")
    # blocks that cover the same are one; what is left is compared start by start where cores are shared
    same_block = ["c1", "c2", "b1", "b2"]
    kinds = scratch.cut(
        blocks.groupBy(*same_block).agg(F.count("*").alias("n"), F.max("open").alias("open"), F.first(F.struct("tid", "p", "d", "keys")).alias("r")), "kinds"
    )
    twice = kinds.where("n > 1 AND open = 1").select(*same_block)
    full = scratch.cut(
        blocks.where("open = 1").select("tid", "p", F.size("keys").alias("m"), *same_block).join(twice, same_block).select(
            "tid", F.col("p").alias("begin"), (F.col("p") + F.col("m") - 1 + LENGTH).alias("end")
        ),
        "full",
    )
    scratch.drop(blocks)
    undecided = F.max(F.when(F.col("n") == 1, F.col("open")).otherwise(0))
    shared = kinds.groupBy("c1", "c2").agg(F.count("*").alias("m"), undecided.alias("todo")).where("m > 1 AND todo = 1").select("c1", "c2")
    shared = scratch.cut(shared, "shared")
    alone = ((F.col("n") == 1) & (F.col("open") == 1)).cast("int")
    starts = kinds.join(shared, ["c1", "c2"]).select("r.*", "c1", "c2", alone.alias("open"), F.posexplode("r.keys").alias("i", "k")).select(
        "tid", "open", (F.col("p") + F.col("i")).alias("p"), (F.col("d") - F.col("i")).alias("d"), "c1", "c2", "k"
    )
    same = ["c1", "c2", "d", "k"]
    met = starts.groupBy(*same).agg(F.count("*").alias("n"), F.max("open").alias("any")).where("n > 1 AND any = 1").drop("n", "any")
    single = starts.where("open = 1").join(met, same).select("tid", F.col("p").alias("begin"), (F.col("p") + LENGTH).alias("end"))
    whole_runs = runs.join(classes.where("n > 1").select("o1", "o2"), ["o1", "o2"]).select(
        "tid", F.col("a").alias("begin"), (F.col("b") - 1 + LENGTH).alias("end")
    )
    spans = scratch.cut(whole_runs.union(full).union(single).groupBy("tid").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")
    scratch.drop(runs, classes, kinds, full)

    done = scratch.cut(
        texts.join(spans, "tid", "left").join(loose, "tid", "left").select("digest", "copies", "text", "spans", "starts").mapInArrow(lambda it: _remove(it, whole), KEPT), "done"
    )
    scratch.drop(texts, spans, loose)
    return keyed.select("doc_id", "digest").join(done, "digest").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _repeated_loose(parse: DataFrame, scratch: Scratch) -> DataFrame:
    rows = parse.select("tid", "copies", F.explode("loose").alias("x")).select("tid", "copies", "x.p", "x.k1", "x.k2")
    met = scratch.cut(rows.groupBy("k1", "k2").agg(F.sum("copies").alias("n")).where("n > 1").select("k1", "k2"), "met")
    return rows.join(met, ["k1", "k2"]).groupBy("tid").agg(F.collect_list("p").alias("starts"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), whole=False).drop("kept")

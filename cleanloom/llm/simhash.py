"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

Every document gets a 64-bit SimHash of its word shingles. The tables are those of
covering LSH: bit i carries a non-zero vector m(i) over GF(2)^(r+1), and table v keeps the
bits with <m(i), v> = 1. The vectors of at most r differing bits span at most r
dimensions, so some v is orthogonal to all of them and the pair collides in table v: no
pair within the radius is missed.

``near_duplicates`` links fingerprints within RADIUS = 2 differing bits. Inside a bucket
no pairs are made. A pair within distance 2 shares a midpoint (one of the two, or either
with one bit flipped), and a pair that shares a midpoint is within distance 2. Each
fingerprint of a bucket therefore emits itself and its single flips of the bits that the
table ignores, and those that meet at a midpoint are hung under its least. That is exact
and grows with the bucket, not with its square.

``similar_documents`` links documents whose sets of word shingles have a Jaccard likeness
of LEAST or more. The tables of a wider radius (WIDE) give candidates: all pairs within it,
and some beyond, as differing bits whose vectors happen to be dependent still collide. Its
vectors are those of the Reed-Muller code, so that every table keeps half the bits or all.
As alike documents can be further apart, KEYS hashes of DEPTH MinHash minima of the shingles
are tables too. Buckets are worked off by ``buckets.links``. A candidate pair first has its
likeness bounded from above by counts of the shingles in CELLS classes, a sketch that each
document carries from the start; the pairs that are left are compared exactly, by 64-bit
hashes of their shingles, which are made for the documents of such pairs only. Texts with
equal words are one node from the start.

Null texts count as empty. A document without words has fingerprint zero and is linked
like any other; its likeness to another without words is 1. Rows that repeat, ids
included, give repeated result rows. A null doc_id is kept and takes part; it is never the
component id unless all ids of the component are null. Other columns of the input are
ignored, and passed on by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.llm import buckets
from cleanloom.llm._common import Scratch, row_of, slices
from cleanloom.llm.components import connected_components

RADIUS = 2
SHINGLE = 3
SEED = 42
BITS = 64
#: Of similar_documents: words in a shingle, likeness, and the radius of the tables.
WORDS = 5
LEAST = 0.8
WIDE = 6
#: Tables of MinHash, and the minima of each: 0.999997 of pairs at a likeness of 0.8 share one, 0.78 at 0.5.
KEYS, DEPTH = 24, 4
#: Classes of a sketch, by the low bits of a hash.
CELLS = 256
NO_ID = -(1 << 63)
#: Hashes whose bits are counted at once, so that a long text needs no more memory.
CHUNK = 4096


def _hashes(words: list[bytes], shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text of ``shingle`` words or more, repeats included, CHUNK at a time."""
    n, hashed = len(words) - shingle + 1, xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False)
        yield np.fromiter((hashed(b" ".join(g), seed) for g in grams), np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z only, and ASCII white space only


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one UTF-8 text: a bit is set if it is in over half the shingle hashes."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    return _majority(_hashes(words, shingle, seed), len(words) - shingle + 1)


def _majority(hashes: Iterable[np.ndarray], n: int) -> int:
    """The bits that are in over half of n hashes."""
    ones = np.zeros(BITS, np.int64)
    for h in hashes:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(packed.view(np.uint64)[0])


def shingle_set(text: bytes, shingle: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of the distinct shingles of one UTF-8 text; the whole text is one if it has fewer words, none included."""
    words = words_of(text)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    return np.unique(np.concatenate(list(_hashes(words, shingle, seed))))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        prints = np.fromiter((simhash(t.as_py() or b"", shingle, seed) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64), pa.int64())], ["doc_id", "fp"]
        )


def masks(radius: int = RADIUS) -> list[int]:
    """The 2^(r+1) - 1 masks: bit i is in mask v if <m(i), v> = 1, with m(i) = 1 + i mod (2^(r+1) - 1), or 2^r + i where that gives each bit its own."""
    every, half = (1 << (radius + 1)) - 1, 1 << radius
    vectors = [half + i if half >= BITS else 1 + i % every for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, every + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_documents(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for every row; fp is the unsigned fingerprint in a signed long."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        lambda it: _fingerprints(it, shingle, seed), "doc_id long, fp long"
    )


def _tables(prints: DataFrame, radius: int, *more: str) -> DataFrame:
    """(fp, *more, t, key): the key of every fingerprint in every table."""
    keys = (F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks(radius)))
    return prints.select("fp", *more, F.explode(F.array(*keys)).alias("x")).select("fp", *more, "x.t", "x.key")


def linked_fingerprints(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints within distance 2.

    Counts are tables of their own before they are joined, so that skewed joins are split.
    """
    tables, keyed = masks(RADIUS), _tables(prints, RADIUS)
    full = scratch.cut(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key"), "full")
    near = keyed.join(full, ["t", "key"])
    # flips of the bits that the table ignores; 0 is the fingerprint itself
    flips = F.array(
        *(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1)) for m in tables)
    )
    middle = near.select(
        "fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    met = scratch.cut(middle.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("mid", "b"), "met")
    return middle.join(met, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): components of fingerprints linked at distance 2 or less.

    component_id is the smallest doc_id reachable. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "simhash")
    prints = scratch.cut(fingerprint_documents(docs, shingle, seed), "prints")
    groups = scratch.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    roots = scratch.cut(
        connected_components(spark, linked_fingerprints(groups.select("fp"), scratch), scratch), "roots"
    )
    scratch.free()
    of = groups.join(roots, groups.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = scratch.cut(of.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    named = scratch.cut(of.join(ids, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


NODES = "id long, h long, fp long, w1 long, w2 long, grams int, keys array<long>, sketch binary"
SETS = "lid long, set array<long>"


def _nodes(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Of each text the fingerprint, a 128-bit hash of its words, the size of its shingle set, KEYS hashes of DEPTH minima each and the sketch."""
    orders = np.random.default_rng(SEED).integers(0, 1 << 63, DEPTH * KEYS, dtype=np.uint64)
    for batch in slices(batches):
        prints, halves, sizes, keys, sketches = [], [], [], [], []
        for t in batch.column(2).cast(pa.large_binary()):
            words = words_of(t.as_py() or b"")
            joined = b" ".join(words)
            halves.append(xxhash.xxh3_128_digest(joined))
            if len(words) <= shingle:
                hashes = [np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)]
                prints.append(int(hashes[0][0]) if words else 0)
            else:
                hashes = list(_hashes(words, shingle, SEED))
                prints.append(_majority(hashes, len(words) - shingle + 1))
            own = np.unique(np.concatenate(hashes))
            sizes.append(len(own))
            minima = [int((own ^ order).min()) for order in orders]
            keys.append([hash((k, *minima[DEPTH * k : DEPTH * (k + 1)])) for k in range(KEYS)])  # of numbers: the same in every process
            sketches.append(sketch_of(own))
        both = np.frombuffer(b"".join(halves), ">i8").reshape(-1, 2).astype(np.int64)
        columns = [pa.array(np.array(prints, np.uint64).view(np.int64)), *(pa.array(both[:, k]) for k in (0, 1)), pa.array(sizes, pa.int32())]
        columns += [pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [x.split()[0] for x in NODES.split(", ")])


def sketch_of(own: np.ndarray) -> bytes:
    """How many hashes of a set are in each of CELLS classes, one byte each, at most 255."""
    cells = np.bincount((own & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def _bounded(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sketches leave a likeness of ``least`` possible."""
    for batch in slices(batches, 4096):
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CELLS) for k in (2, 3))
        gx, gy = (batch.column(k).to_numpy().astype(np.int64) for k in (4, 5))
        # no more is common than the lesser count of each class, and of what the bytes don't hold
        more = np.minimum(gx - x.sum(axis=1, dtype=np.int64), gy - y.sum(axis=1, dtype=np.int64))
        common = np.minimum(x, y).sum(axis=1, dtype=np.int64) + more
        keep = pa.array(common >= least * (gx + gy - common) - buckets.SLACK)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The shingle set of each text."""
    for batch in slices(batches):
        sets = [shingle_set(t.as_py() or b"", shingle) for t in batch.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["lid", "set"])


def _document(docs: DataFrame) -> list[Column]:
    """Rows with equal (id, h) are the same document."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(docs["text"]).alias("h")]


def bounded(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that can have a likeness of ``least``: a few bytes a document show that most others can't."""
    x = nodes.select(F.col("lid").alias("a"), F.col("sketch").alias("x"), F.col("grams").alias("gx"))
    y = nodes.select(F.col("lid").alias("b"), F.col("sketch").alias("y"), F.col("grams").alias("gy"))
    both = pairs.join(x, "a").join(y, "b").where(F.least("gx", "gy") >= least * F.greatest("gx", "gy") - buckets.SLACK)
    return both.select("a", "b", "x", "y", "gx", "gy").mapInArrow(lambda it: _bounded(it, least), "a long, b long")


def compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with a Jaccard likeness of at least ``least`` of their sets, with it as ``like``."""
    x, y = sets.select(F.col("lid").alias("a"), F.col("set").alias("x")), sets.select(F.col("lid").alias("b"), F.col("set").alias("y"))
    common = pairs.join(x, "a").join(y, "b").select("a", "b", (F.size("x") + F.size("y")).alias("g"), F.size(F.array_intersect("x", "y")).cast("double").alias("c"))
    return common.select("a", "b", (F.col("c") / (F.col("g") - F.col("c"))).alias("like")).where(F.col("like") >= least)


def similar_documents(
    spark: SparkSession, docs: DataFrame, scratch: Scratch, shingle: int = WORDS, least: float = LEAST, radius: int = WIDE
) -> DataFrame:
    """(id, h, keep): every distinct document, and whether it is the least (id, h) of its component."""
    texts = docs.select(*_document(docs), F.coalesce(docs["text"], F.lit("")).alias("text"))
    prints = scratch.cut(texts.mapInArrow(lambda it: _nodes(it, shingle), NODES), "prints")  # a few hundred bytes a document
    least_of = F.min(F.struct("id", "h")).alias("first")
    # frequent texts have the least ids
    lid = (4095 - F.least("n", F.lit(4095))) * F.lit(1 << 51) + F.monotonically_increasing_id()
    of_words = F.first(F.struct("fp", "grams", "keys", "sketch")).alias("x")
    nodes = prints.groupBy("w1", "w2").agg(least_of, of_words, F.count("*").alias("n")).withColumn("lid", lid)
    nodes = scratch.cut(nodes.select("w1", "w2", "first", "n", "lid", "x.*"), "nodes")

    keyed = _tables(nodes.select("fp", "lid"), radius, "lid").select("lid", F.xxhash64("t", "key").alias("band"))
    shared = []
    # one kind of tables after the other, so that fewer keys are counted at a time
    for bands in (keyed, nodes.select("lid", F.explode("keys").alias("band"))):
        often = scratch.cut(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "shared")
        shared.append(scratch.cut(bands.join(often, "band").select("band", "lid"), "met"))
        scratch.drop(often)
    members = scratch.cut(shared[0].union(shared[1]).join(nodes.select("lid", "grams"), "lid").select("band", "lid", "grams"), "members")
    scratch.drop(*shared)

    def sets_of(some: DataFrame) -> DataFrame:
        named = nodes.join(some.distinct(), "lid").select("lid", "first.id", "first.h")
        own = texts.join(named, ["id", "h"]).groupBy("lid").agg(F.first("text").alias("text"))
        return own.mapInArrow(lambda it: _sets(it, shingle), SETS)

    def compare(pairs: DataFrame, floor: float) -> DataFrame:
        near = scratch.cut(bounded(pairs, nodes, floor), "near")
        sets = scratch.cut(sets_of(near.select(F.explode(F.array("a", "b")).alias("lid"))), "sets")
        alike = scratch.cut(compared(near, sets, floor), "alike")
        scratch.drop(near, sets)
        return alike

    tokens = lambda some: sets_of(some).select("lid", F.explode("set").alias("token"))
    links = buckets.links(members, compare, least, scratch, tokens)
    scratch.drop(members)
    roots = scratch.cut(connected_components(spark, links, scratch), "roots")
    linked = scratch.cut(nodes.join(roots, F.col("lid") == F.col("node")).select("w1", "w2", "root", "first"), "linked")
    firsts = scratch.cut(linked.groupBy("root").agg(F.min("first").alias("first")), "firsts")
    better = linked.drop("first").join(firsts, "root").select("w1", "w2", "first")
    alone = nodes.join(roots, F.col("lid") == F.col("node"), "left_anti").select("w1", "w2", "first")
    named = scratch.cut(alone.union(better), "named")
    keep = (F.col("first.id") == F.col("id")) & (F.col("first.h") == F.col("h"))
    out = scratch.cut(prints.select("id", "h", "w1", "w2").join(named, ["w1", "w2"]).select("id", "h", keep.alias("keep")).distinct(), "judged")
    scratch.drop(prints, nodes, links, roots, linked, firsts, named)
    return out


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = WORDS, least: float = LEAST, radius: int = WIDE) -> DataFrame:
    """One document of each group of similar documents stays: that with the least (doc_id, hash of the text), a null id first.

    Rows that repeat id and text are one document, of which one row stays, that with the
    least hash of all its columns. Columns are those of the input.
    """
    judged = similar_documents(spark, docs, Scratch(spark, "simhash"), shingle, least, radius)
    hashed = [F.col(f"`{f.name.replace('`', '``')}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and not isinstance(f.dataType, T.VariantType)]
    once = docs.select(row_of(docs).alias("row"), *_document(docs), F.xxhash64(*hashed).alias("order"))
    once = once.groupBy("id", "h").agg(F.min_by("row", "order").alias("row"))
    return once.join(judged.where("keep").select("id", "h"), ["id", "h"], "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(spark, docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

"""Document fingerprints by randomised edit embedding.

All texts walk over the same random bits: at step j the embedding shows the character
under the pointer, which moves on if R(j, character) is 1, where R is drawn for every step
and class of characters. Texts a few edits apart fall into step again soon after an edit,
so that edit distance becomes Hamming distance of the embeddings. But k inserted characters
cost a walk of the order of k^2 steps, so one walk over a whole text would lose all that
follows a longer insertion. Walks therefore start anew at anchors, places whose next W
characters have a hash that is a trigger (about one in MEAN), at the latest after LONGEST
characters: an edit costs the segments that it touches, and each segment has a walk of its
own.

The fingerprint samples bits of the embedding, the same for all texts. Of its SLOTS slots
each shows the segment whose name (the anchor's characters, and how often they stood before)
has the least hash of that slot, by SHOWN steps of that segment's walk: of steps drawn over
the length of the segment, the first that it has. It reads as hex digits, SLOTS * SHOWN bits.

Null text counts as empty; its fingerprint is empty, and two empty ones are alike.
Repeated rows and ids are rows of their own, ordered by a hash of the text within an id; a
null doc_id counts as the smallest. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.llm import buckets
from cleanloom.llm._common import Scratch, partitions
from cleanloom.llm.components import connected_components

CLASSES = 256
#: Characters of an anchor; one place in MEAN is one; most characters of a segment.
W, MEAN, LONGEST = 8, 64, 512
#: Steps of a walk, at most: LONGEST characters take about twice as many steps.
STEPS = 4096
SLOTS, SHOWN = 128, 8
BITS = SLOTS * SHOWN
#: Times that a step is drawn for a bit before the rest of a division decides.
DRAWS = 8
SEED = 20
#: Characters walked at once.
CHUNK = 1 << 21
#: Bands of near_documents, and the bits of each.
BANDS, ROWS = 48, 32
LEAST = 0.8
NO_ID = -(1 << 63)
#: Low bits of a segment's hash that give way to its number.
NUMBER = np.uint64((1 << 26) - 1)
#: Name of the segment that begins a text.
FIRST = np.uint64(1)


def _tables(seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps that a character of a class stays from a step on; a random bit of each class for each bit; the
    draws of steps for each bit; multipliers and masks of the slots."""
    rng = np.random.default_rng(seed)
    r = rng.integers(0, 2, (CLASSES, STEPS), dtype=np.uint8)
    r[:, -1] = 1
    stay = np.ones((CLASSES, STEPS), np.uint8)
    for j in range(STEPS - 2, -1, -1):
        stay[:, j] = np.where(r[:, j] == 1, 1, stay[:, j + 1] + 1)
    bit = rng.integers(0, 2, (CLASSES, BITS), dtype=np.uint8)
    draws = rng.integers(0, STEPS, (DRAWS, BITS), dtype=np.int16)
    return stay.ravel(), bit, draws, rng.integers(1, 1 << 63, (2, SLOTS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


STAY, BIT, DRAWN, SLOT = _tables()


def classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point, by multiplicative hashing."""
    return ((points.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(24)).astype(np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _windows(points: np.ndarray) -> np.ndarray:
    """A hash of the W characters from each place on; 0 for the last W - 1 places."""
    h, size = _mixed(points.astype(np.uint64) + np.uint64(7)), 1
    while size < W:
        h = h[:-size] * np.uint64(0xD6E8FEB86659FD93) + h[size:] if len(h) > size else h[:0]
        size *= 2
    return np.concatenate([_mixed(h), np.zeros(len(points) - len(h), np.uint64)])


def segments(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length, text and name of the segments of all texts, which follow each other in ``points``."""
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    windows = _windows(points)
    fits = ends[of] - np.arange(len(points)) >= W
    begins = fits & (windows >> np.uint64(32) < np.uint64((1 << 32) // MEAN))
    begins[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(begins)
    length = np.diff(at, append=len(points))
    pieces = -(-length // LONGEST)
    at = np.repeat(at, pieces) + _ramp(pieces) * LONGEST
    length = np.diff(at, append=len(points))
    text = of[at]
    first = at == (ends - sizes)[text]
    name = np.where(first, FIRST, np.where(fits[at], windows[at], (ends[text] - at).astype(np.uint64) + FIRST))
    order = np.lexsort((name, text))  # stable: segments of one name stay in order
    same = np.concatenate([[False], (name[order][1:] == name[order][:-1]) & (text[order][1:] == text[order][:-1])])
    runs = np.diff(np.flatnonzero(~same), append=len(order))
    before = np.empty(len(order), np.uint64)
    before[order] = _ramp(runs)
    return at, length, text, _mixed(name + before * np.uint64(0x94D049BB133111EB))


def _ramp(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def walk(c: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each character, the step of its segment's walk that first shows the next; all segments side by side."""
    order = np.argsort(-length, kind="stable")
    start, longest = at[order], length[order]
    left = np.zeros(len(c), np.int64)
    step = np.zeros(len(at), np.int64)
    live = np.searchsorted(-longest, -np.arange(longest[0]), side="left")  # segments with more than t characters
    for t, k in enumerate(live.tolist()):
        place = start[:k] + t
        now = step[:k]
        now += STAY[c[place].astype(np.int64) * STEPS + now]
        np.minimum(now, STEPS - 1, out=now)
        left[place] = now
    return left


def _shown_steps(size: np.ndarray) -> np.ndarray:
    """For each size in steps, in a row of SLOTS, the SHOWN steps shown of a segment in that slot."""
    level = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int16)  # 2^level steps or fewer
    shift = (np.int16(STEPS.bit_length() - 1) - level)[:, :, None]
    size = size.astype(np.int16)[:, :, None]
    drawn = DRAWN.reshape(DRAWS, 1, SLOTS, SHOWN)
    out = drawn[0] % size
    for own in drawn[::-1]:
        step = own >> shift
        out = np.where(step < size, step, out)
    return out


def embed_bits(texts: list[str]) -> np.ndarray:
    """The bits of every text, none of which is empty."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = classes(points)
    at, length, text, name = segments(points, sizes)
    left = walk(c, at, length)
    number = np.arange(len(at), dtype=np.uint64)
    edges = np.searchsorted(text, np.arange(len(sizes)))
    chosen = np.empty((len(sizes), SLOTS), np.int64)
    for s in range(SLOTS):
        key = ((name ^ SLOT[1, s]) * SLOT[0, s] & ~NUMBER) | number
        chosen[:, s] = np.minimum.reduceat(key, edges) & NUMBER
    steps = _shown_steps(left[at + length - 1][chosen])
    # steps of all segments in one ascending order
    line = left + np.repeat(np.arange(len(at)), length) * STEPS
    place = np.searchsorted(line, (steps + chosen[:, :, None] * STEPS).ravel(), side="right")
    return BIT[c[place].reshape(len(sizes), BITS), np.arange(BITS)]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """The bits of every text, CHUNK characters at a time; a longer text is walked alone, an empty one has none."""
    out: list[np.ndarray] = [np.empty(0, np.uint8)] * len(texts)
    group, size = [], 0

    def done() -> None:
        for k, bits in zip(group, embed_bits([texts[k] for k in group]) if group else (), strict=True):
            out[k] = bits

    for k, text in enumerate(texts):
        # the bits of short texts take more memory than their characters
        if group and size + max(len(text), 4 * BITS) > CHUNK:
            done()
            group, size = [], 0
        if text:
            group.append(k)
            size += max(len(text), 4 * BITS)
    done()
    return out


def as_text(bits: np.ndarray) -> str:
    return np.packbits(bits).tobytes().hex()


def as_bits(fingerprint: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8))


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Share of bits that agree beyond the half that agree by chance, 0 to 1; one less it is a metric."""
    if not (len(a) and len(b)):
        return float(len(a) == len(b))
    return max(0, 2 * int((a == b).sum()) - BITS) / BITS


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the text that is alike, 0 to 1.

    Segments agree in the share j = both / either; that of what is alike in texts of one
    length is 2j / (1 + j).
    """
    j = agreement(a, b)
    return 2 * j / (1 + j)


def _compare(pairs: list[tuple[int | None, str, str]]) -> Iterator[pa.RecordBatch]:
    texts = [p[1] for p in pairs]
    edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for _, t, after in pairs]
    own, changed = fingerprints(texts), fingerprints(edited)
    # what comes next is mostly the text of the next pair
    strange = [k for k, p in enumerate(pairs) if k + 1 == len(pairs) or p[2] is not texts[k + 1]]
    nxt = [*own[1:], own[0]]
    for k, bits in zip(strange, fingerprints([pairs[k][2] for k in strange]), strict=True):
        nxt[k] = bits
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([p[0] for p in pairs], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
            pa.array([as_text(x) for x in own]),
            pa.array([as_text(x) for x in changed]),
            pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)]),
            pa.array([likeness(a, b) for a, b in zip(own, nxt, strict=True)]),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, descending key, and the first row of the next bucket after a bucket's own."""
    before, pairs, size = None, [], 0
    for batch in batches:
        for bucket, lent, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if before and before[0] == bucket and not before[1]:
                pairs.append((before[2], before[3], text))
                size += len(before[3])
                if size > CHUNK:
                    yield from _compare(pairs)
                    pairs, size = [], 0
            before = (bucket, lent, doc_id, text)
    if pairs:
        yield from _compare(pairs)


def _place(key: F.Column, tie: F.Column, bounds: list[tuple[int, int]], step: int = 64) -> F.Column:
    """How many bounds (key, tie), by descending key and ascending tie, a row has reached: first by blocks, then inside one."""
    if not bounds:
        return F.lit(0)
    reached = lambda b: (b["k"] > key) | ((b["k"] == key) & (b["t"] <= tie))
    of = lambda some: F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in some))
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    begun = F.size(F.filter(of([b[0] for b in blocks]), reached))
    own = F.array(*(of(b) for b in blocks))[F.greatest(begun - 1, F.lit(0))]
    return F.when(begun == 0, 0).otherwise((begun - 1) * step + F.size(F.filter(own, reached)))


def _ranges(keyed: DataFrame, n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Bounds that cut the rows of (key, tie) into about n ranges, and (key, tie, parts) of what no bound can cut.

    An id that holds several ranges is cut by the hash of the text, and rows with one id and
    hash that hold more than a range are dealt into parts; there are at most n of these.
    """
    row = keyed.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 10 * n).alias("cuts"), F.count("*").alias("rows")).head()
    share = -(-row["rows"] // n)
    heavy = keyed.groupBy("key", "tie").agg(F.count("*").alias("n")).where(F.col("n") > 2 * share).collect()
    low, bounds = -(1 << 63), set()
    for k, r in Counter(row["cuts"] or []).items():
        bounds |= {(k, low + j * (1 << 64) // r) for j in range(r)}
    for h in heavy:
        bounds |= {(h["key"], h["tie"])} | ({(h["key"], h["tie"] + 1)} if h["tie"] < -(low + 1) else set())
    return sorted(bounds, key=lambda b: (-b[0], b[1])), [(h["key"], h["tie"], -(-h["n"] // share)) for h in heavy]


def compare_with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see COMPARED.

    The last third of the edited text is the beginning of the next document by descending
    doc_id, after the last the first. Rows are cut into ranges of their order; the first
    document of a range is also lent to the range before, so that texts move once and no
    task sees more than its ranges.
    """
    scratch = Scratch(spark, "editnext")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    bounds, heavy = _ranges(rows.select("key", "tie"), 4 * partitions(spark))
    bucket = _place(F.col("key"), F.col("tie"), bounds).cast("long") * (1 << 32)
    rows = rows.withColumn("bucket", bucket)
    if heavy:
        parts = spark.createDataFrame(heavy, "key long, tie long, parts long")  # at most one for each range
        deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1)))
        rows = rows.join(F.broadcast(parts), ["key", "tie"], "left").withColumn("bucket", F.col("bucket") + deal).drop("parts")
    # the first row of each range, without its text; then those texts
    first = F.min(F.struct(F.bitwise_not("key").alias("k"), "tie")).alias("f")  # orders by descending key
    firsts = scratch.cut(rows.groupBy("bucket").agg(first).select("bucket", F.bitwise_not("f.k").alias("key"), "f.tie"), "firsts")
    order = sorted(r["bucket"] for r in firsts.select("bucket").collect())  # a number for each range
    if not order:
        return spark.createDataFrame([], COMPARED)
    before = spark.createDataFrame([(b, order[i - 1]) for i, b in enumerate(order)], "bucket long, before long")
    found = rows.join(F.broadcast(firsts), ["bucket", "key", "tie"]).groupBy("bucket").agg(F.min(F.struct("text", "doc_id", "key", "tie")).alias("x"))
    lent = found.join(F.broadcast(before), "bucket").select(F.col("before").alias("bucket"), F.lit(1).alias("lent"), "x.doc_id", "x.text", "x.key", "x.tie")
    own = rows.select("bucket", F.lit(0).alias("lent"), "doc_id", "text", "key", "tie")
    return (
        own.union(lent)
        .repartition(partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "lent", F.desc("key"), "tie", "text")
        .select("bucket", "lent", "doc_id", "text")
        .mapInArrow(_with_next, COMPARED)
    )


@cache
def _positions() -> np.ndarray:
    """The bits of each band: those of whole slots, drawn for each band, ROWS in all."""
    order = np.argsort(np.random.default_rng(SEED + 1).random((BANDS, SLOTS)), axis=1)[:, : -(-ROWS // SHOWN)]
    return (order[:, :, None] * SHOWN + np.arange(SHOWN)).reshape(BANDS, -1)[:, :ROWS]


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprint of each text."""
    for batch in batches:
        prints = fingerprints([t or "" for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_text(x) for x in prints], pa.string())], ["doc_id", "fp"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys of each fingerprint."""
    for batch in batches:
        keys = []
        for bits in map(as_bits, batch.column(1).to_pylist()):
            own = bits[_positions()] if len(bits) else np.empty((0, ROWS), np.uint8)
            keys.append([xxhash.xxh64_intdigest(row.tobytes(), b) - (1 << 63) for b, row in enumerate(np.packbits(own, axis=1))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["lid", "keys"])


def _likened(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        like = [agreement(as_bits(x), as_bits(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        keep = pa.array([x >= least for x in like], pa.bool_())
        columns = [batch.column(0), batch.column(1), pa.array(like, pa.float64())]
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["a", "b", "like"])


def compared(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose fingerprints have an agreement of at least ``least``, with it as ``like``."""
    x, y = nodes.select(F.col("lid").alias("a"), F.col("fp").alias("x")), nodes.select(F.col("lid").alias("b"), F.col("fp").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return both.mapInArrow(lambda it: _likened(it, least), "a long, b long, like double")


def near_documents(spark: SparkSession, docs: DataFrame, least: float = LEAST, exact: bool = False) -> DataFrame:
    """(doc_id, fp, component_id): documents linked by bit-sampled bands and verified likeness.

    Every distinct fingerprint is a node; nodes that share a band are compared by
    ``buckets.links`` so that no link inside a bucket of any size is lost, whether ``exact``
    is given (it once had a cheaper way beside it) or not. component_id is the smallest doc_id of the component.
    """
    scratch = Scratch(spark, "editprint")
    use = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    prints = scratch.cut(use.mapInArrow(_printed, "doc_id long, fp string"), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("lid", F.monotonically_increasing_id())
    nodes = scratch.cut(nodes, "nodes")
    banded = scratch.cut(nodes.select("lid", "fp").mapInArrow(_banded, "lid long, keys array<long>"), "banded")
    keyed = banded.select("lid", F.lit(1).alias("grams"), F.explode("keys").alias("band"))
    shared = scratch.cut(keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "shared")
    members = scratch.cut(keyed.join(shared, "band"), "members")
    links = buckets.links(members, lambda pairs, floor: compared(pairs, nodes, floor), least / (2 - least), scratch)
    scratch.drop(members, banded, shared)
    roots = scratch.cut(connected_components(spark, links, scratch), "roots")
    of = nodes.join(roots, F.col("lid") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "lid").alias("root"))
    of = scratch.cut(of, "of")
    ids = scratch.cut(of.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    known = scratch.cut(of.join(ids, "root").select("fp", "component_id"), "known")
    scratch.drop(nodes, links, roots, of, ids)
    return prints.select("doc_id", "fp").join(known, "fp")


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents near each other by banding and verification of their fingerprints."""
    return near_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

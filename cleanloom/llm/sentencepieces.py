"""SentencePiece encoding and decoding by weighted finite-state transduction.

The model is compiled into three parts: the normaliser (dummy prefix, white space to the
meta symbol), an acceptor of the pieces, and byte fallback for characters without a
piece. A text is normalised and cut where no piece reaches across; each part is composed
with the piece transducer, and the path of least weight in the tropical semiring is its
encoding.

A unigram model weighs an arc with the piece's negative score. A BPE model isn't a sum of
scores, so its transducer remembers the last piece: an arc from piece p to piece q has a
finite weight only if merging p + q gives p, q again. A sequence of pieces is what BPE
makes of a text exactly if all its neighbours are stable in this sense, so one path is
left, and it is the encoding that merging gives. Whole parts and pairs once found are kept
by each worker, in tables of bounded size.

Decoding maps ids to their bytes, so that fallback bytes join into characters again; the
dummy prefix goes. Null text encodes to null, empty text to no ids. Text that holds the
meta symbol itself decodes to blanks there. Repeated rows give repeated rows, other
columns pass through, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.llm._common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
#: Parts and pairs that a worker keeps; the tables are emptied when they are full.
MOST_PARTS, MOST_PAIRS = 900_000, 100_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITE = float("inf")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised protocol message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = (4, at) if key & 7 == 5 else (8, at) if key & 7 == 1 else _varint(data, at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes):
        self.text: list[str] = []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.as_bytes: list[bytes] = []
        self.byte_id = [0] * 256
        self.unknown, self.kind, self.dummy, self.squeeze = 0, UNIGRAM, True, True
        for number, value in _fields(model):
            if number == 1:
                self._piece({n: v for n, v in _fields(value)})
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                self.dummy, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("normalisers with a character map aren't supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.longest = max(map(len, self.id), default=1)
        self.parts = re.compile(self._cuts())
        self.known = _Parts(self)
        self.pairs: dict[tuple[str, str], bool] = {}
        if self.kind == BPE:  # pieces that merging never makes are on no path
            self.halves = {p: self._halves(p) for p in self.id}
            self.id = {p: i for p, i in self.id.items() if self.halves[p] is not None}
            born = self.born = {p: INFINITE if len(p) == 1 else self.score[p] for p in self.id}
            # pieces made before their halves' turn, among them those of equal score, are tried out
            self.odd = {p for p in self.id if len(p) > 1 and any(born[h] <= born[p] for h in self.halves[p])}

    def _cuts(self) -> str:
        """A pattern of the longest parts that no piece reaches out of.

        Cuts stand before runs of the meta symbol, around line ends, and between a letter
        and a sign, each if no piece holds such neighbours.
        """
        inside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        letters = re.compile(f"[{LETTERS}]")
        if any(x[1] == META != x[0] for x in inside) or any("\n" in p for p in self.id):
            return "(?s).+"
        taken = {x[1] for x in inside if letters.match(x[0])}
        signs = "".join(re.escape(c) for c in SIGNS if c not in taken)
        more = f"[^{META}\\n{LETTERS}]*[{LETTERS}]*"
        return f"\\n|{META}*{more}(?:[^{META}\\n{LETTERS}{signs}]{more})*"

    def _piece(self, spec: dict) -> None:
        text, kind, i = spec[1].decode(), spec.get(3, NORMAL), len(self.text)
        self.text.append(text)
        raw = b"" if kind == CONTROL else text.encode()
        if kind == BYTE:
            raw = bytes([int(text[3:5], 16)])
            self.byte_id[raw[0]] = i
        elif kind == UNKNOWN:
            self.unknown, raw = i, " ⁇ ".encode()
        elif kind in (NORMAL, USER):
            self.id[text] = i
            self.score[text] = struct.unpack("<f", spec[2])[0] if 2 in spec else 0.0
        self.as_bytes.append(raw)

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (META if self.dummy and text else "") + text.replace(" ", META)

    def merge(self, text: str, until: int = 1) -> list[str]:
        """Greedy merging: of all neighbours that join to a piece the best score first, then the leftmost."""
        parts, score = list(text), self.score
        while len(parts) > until:
            best, at = -INFINITE, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1], -INFINITE)
                if s > best:
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts of the last merge that makes a piece; None if merging doesn't make it."""
        if len(piece) == 1:
            return (piece, piece)
        parts = self.merge(piece, until=2)
        return tuple(parts) if len(parts) == 2 and self.merge(piece) == [piece] else None

    def stable(self, p: str, q: str) -> bool:
        """Whether merging p + q gives p, q.

        Both are unmade again, the younger half first. At each state of the boundary, a
        merge across it must come after the merge that ends the state.
        """
        if p in self.odd or q in self.odd:
            found = self.pairs.get((p, q))
            if found is None:
                if len(self.pairs) >= MOST_PAIRS:
                    self.pairs.clear()
                found = self.pairs[p, q] = self.merge(p + q) == [p, q]
            return found
        score, born, limit, left_first = self.score, self.born, -INFINITE, False
        while True:
            across = score.get(p + q)
            if across is not None and (across > limit or (left_first and across == limit)):
                return False
            a, b = born[p], born[q]
            if b <= a:
                if b == INFINITE:
                    return True
                limit, left_first, q = b, True, self.halves[q][0]
            else:
                limit, left_first, p = a, False, self.halves[p][1]

    def shortest(self, text: str) -> list[int]:
        """Ids on the path of least weight through the composition of ``text`` with the transducer."""
        path = self._only_path(text) if self.kind == BPE else self._least_path(text)
        out: list[int] = []
        for piece, char in path:
            out += [self.id[piece]] if piece else self._fallback(char)
        return out

    def _least_path(self, text: str) -> list[tuple[str, str]]:
        """Unigram: relaxation of the arcs in the order of their ends. Fallback has an empty piece."""
        n = len(text)
        best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(INFINITE, 0, "")] * n
        worst = 10 - min(self.score.values(), default=0)  # a byte is dearer than any piece
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                piece = text[start:end]
                weight = -self.score[piece] if piece in self.id else worst if end - start == 1 else INFINITE
                if best[start][0] + weight < best[end][0]:
                    best[end] = (best[start][0] + weight, start, piece if piece in self.id else "")
        out, at = [], n
        while at:
            _, start, piece = best[at]
            out.append((piece, text[start:at]))
            at = start
        return out[::-1]

    def _only_path(self, text: str) -> list[tuple[str, str]]:
        """BPE: all finite paths are one, so it is searched depth first, long arcs first.

        A prefix has one encoding, so a place from which the end isn't reached is dead.
        """
        ids, stable, n = self.id, self.stable, len(text)
        path: list[str] = []
        at, most, dead = 0, self.longest, set()
        starts: list[int] = []
        while at < n:
            before = path[-1] if path else ""
            for end in range(min(n, at + most), at, -1):
                piece = text[at:end]
                if piece in ids and end not in dead and (not before or stable(before, piece)):
                    break
            else:
                end, piece = at + 1, ""
                if text[at] in ids or end in dead or not most:
                    dead.add(at)
                    most = len(path.pop()) - 1 if path else 0
                    if not starts:
                        raise ValueError(f"no path through {text!r}")
                    at = starts.pop()
                    most = max(most, 0)
                    continue
            path.append(piece)
            starts.append(at)
            at, most = end, self.longest
        return list(zip(path, map(text.__getitem__, starts), strict=True))

    def _fallback(self, char: str) -> list[int]:
        """Ids of the bytes of a character; without byte pieces the unknown piece."""
        return [self.byte_id[b] for b in char.encode("utf-8", "replace")] if self.byte_id[255] else [self.unknown]

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > MOST_PARTS:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.parts.findall(self.normalise(text)))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.as_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(META, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


class _Parts(dict):
    """Encodings of parts, found when they are first asked for."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, part: str) -> bytes:
        found = self[part] = np.array(self.owner.shortest(part), np.int32).tobytes()
        return found


def compiled(model: bytes) -> Transducer:
    """The model's transducer, compiled once in each worker process."""
    kept = sys.__dict__.setdefault("_compiled_piece_models", {})
    key = hashlib.sha256(model).digest()
    if key not in kept:
        kept[key] = Transducer(model)
    return kept[key]


ENCODED = [T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
CHECKED = [
    *ENCODED, T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())
]


def _encode(batches: Iterator[pa.RecordBatch], model, at: int, check: bool) -> Iterator[pa.RecordBatch]:
    own = compiled(model.value)
    for batch in slices(batches):
        ids, decoded, same = [], [], []
        for text in batch.column(at).to_pylist():
            found = None if text is None else own.encode(text)
            ids.append(found)
            if check:
                back = None if text is None else own.decode(found)
                decoded.append(None if back is None else hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(None if back is None else back == text)
        sizes = [0 if x is None else len(x) for x in ids]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.array([x is None for x in ids] + [False]))
        flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
        columns, names = [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], [*batch.schema.names, "token_ids"]
        if check:
            columns += [pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
            names += ["n_tokens", "decoded_sha256", "round_trip"]
        yield pa.RecordBatch.from_arrays(columns, names)


def encoded(spark: SparkSession, docs: DataFrame, model_path: str = MODEL, check: bool = False) -> DataFrame:
    """``docs`` with token_ids; with ``check`` also n_tokens, and what decoding gives back.

    Columns of ``docs`` with these names are replaced.
    """
    model = spark.sparkContext.broadcast(Path(model_path).read_bytes())  # the size of the model file
    added = CHECKED if check else ENCODED
    docs = docs.drop(*(f.name for f in added))
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _encode(it, model, at, check), T.StructType([*docs.schema.fields, *added]))


def _decode(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = compiled(model.value)
    for batch in batches:
        texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decoded(spark: SparkSession, tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, token_ids)."""
    model = spark.sparkContext.broadcast(Path(model_path).read_bytes())
    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids")
    return rows.mapInArrow(lambda it: _decode(it, model), "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(spark, docs, check=True).drop("text")

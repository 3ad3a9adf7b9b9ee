"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

A rank file lists byte strings with their merge ranks.  Each byte string becomes a piece by mapping every byte to a
printable character, scored by its negative rank; the normaliser is the identity.  Sentencepiece then joins the best
scored neighbours first, leftmost on ties, which are the merges of the rank file.  Nothing is trained.

Defined cases: a null or empty text has no ids; texts of any length are processed whole; repeated rows give repeated
results; an empty table gives an empty table; new columns whose names are taken get leading underscores.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldtrace.llm.common import free_name

#: Pre-tokens that a worker remembers; the store is emptied when full, which changes no result.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """A printable character for each byte: visible Latin-1 stands for itself, the others follow from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One field of a protocol buffer message: varint, 32-bit float or length-delimited bytes by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(int(value))


def serialise_model(ranks: list[bytes]) -> bytes:
    """A sentencepiece model: id 0 is the unknown piece, the token of rank r has id r + 1."""
    chars = byte_characters()
    piece = lambda text, score, kind: _field(1, text.encode()) + _field(2, float(score)) + _field(3, kind)
    pieces = [piece("<unk>", 0.0, 2)] + [piece("".join(chars[b] for b in t), -r, 1) for r, t in enumerate(ranks)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and back; one per worker process."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.find = regex.compile(pattern).findall
        self.chars = byte_characters()
        self.latin = {b: self.chars[b] for b in range(256)}
        # Decoding inverts the byte mapping of the model's own pieces.
        byte_of = {c: b for b, c in enumerate(self.chars)}
        self.bytes_of = [bytes(map(byte_of.__getitem__, self.model.id_to_piece(r + 1))) for r in range(len(self.tokens))]
        self.whole = {t: np.uint32(r).tobytes() for r, t in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}

    def learn(self, fresh: list[str]) -> None:
        raw = [t.encode() for t in fresh]
        rest = [(t, r) for t, r in zip(fresh, raw, strict=True) if r not in self.whole]
        self.known.update((t, self.whole[r]) for t, r in zip(fresh, raw, strict=True) if r in self.whole)
        mapped = [r.decode("latin-1").translate(self.latin) for _, r in rest]
        for (t, _), ids in zip(rest, self.model.encode(mapped, num_threads=1) if mapped else [], strict=True):
            self.known[t] = (np.array(ids, dtype="<u4") - np.uint32(1)).tobytes()

    def encode(self, text: str) -> bytes:
        parts = self.find(text)
        fresh = set(parts).difference(self.known)
        if fresh:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                fresh = set(parts)
            self.learn(list(fresh))
        return b"".join(map(self.known.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _append(batch: pa.RecordBatch, new: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *(a for _, a in new)], names=[*batch.schema.names, *(n for n, _ in new)])


def _with(df: DataFrame, new: list[tuple[str, T.DataType]], work) -> DataFrame:
    """`df` with columns appended that `work(batch)` returns, in order, for each Arrow batch."""
    names = [n for n, _ in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 500  # bounds what one batch of very long texts holds at a time
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield _append(part, list(zip(names, work(part), strict=True)))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in new)]))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Appends the ids of `text` as bytes (little-endian unsigned 32-bit) and their number as `n_tokens`."""

    def work(batch):
        c = codec(path, pattern)
        got = [c.encode(t.as_py() or "") for t in batch.column(text)]
        return pa.array(got, pa.binary()), pa.array([len(x) // 4 for x in got], pa.int64())

    return _with(df, [(free_name(df, ids), T.BinaryType()), (free_name(df, "n_tokens"), T.LongType())], work)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Appends the bytes that `ids` stand for."""

    def work(batch):
        c = codec(path, pattern)
        return (pa.array([c.decode(x.as_py() or b"") for x in batch.column(ids)], pa.binary()),)

    return _with(df, [(free_name(df, out), T.BinaryType())], work)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Appends n_tokens, ids_sha256 and decoded_sha256: `encode` and `decode` in one pass, so that ids stay in the task."""

    def work(batch):
        c = codec(path, pattern)
        rows = []
        for t in batch.column(text):
            got = c.encode(t.as_py() or "")
            rows.append((len(got) // 4, hashlib.sha256(got).hexdigest(), hashlib.sha256(c.decode(got)).hexdigest()))
        n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())

    kinds = (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))
    return _with(df, [(free_name(df, n), t) for n, t in kinds], work)

"""Language model scores by context-tree weighting.

Texts are bytes, A-Z in lower case, closed by an end byte that UTF-8 never uses and that also stands before the start.
A byte is eight binary decisions; each decision node has a tree of contexts, the bytes before, of depth 0 to `DEPTH`.
With the Krichevsky-Trofimov estimate K(n0, n1) of the counts at a context, the weighted probability is
    P(context) = K / 2 + product over longer contexts of P / 2,    P = K at full depth,
and a decision is predicted by mixing the estimates of all depths with the posterior weights K / (2 P) along the path.
The counts come from the training documents; scoring does not change them.

Counting and scoring go by chunks of documents.  A chunk reports each distinct window (context and byte) and word with
its count, packed per bucket; buckets sum over chunks; the tree is built level by level as tables; buckets send values
back to the chunks that hold the windows.  So no table is broadcast and no task holds more than a chunk or a bucket.

Defined cases: a null or empty text is the end alone; a null document id is held out; repeated rows get equal scores and
count each; without training documents all estimates are 1/2 and the base score takes N = V = 0; empty tables give
empty tables.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import Saved, Scratch

DEPTH = 5
END = 255
#: Bytes of text in a chunk, about; and at a time within one.
CHUNK_BYTES, STEP_BYTES = 14 << 20, 1 << 20
#: Keys that are looked up at once: what a look-up holds besides its result stays small.
PROBED = 1 << 17
#: Words whose hashes a worker remembers; the store is emptied when full, which changes no result.
REMEMBERED = 400_000
END_WORD = 1  # stands for the end among word hashes, which are even


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = self[word] = xxhash.xxh3_64_intdigest(word) >> 1 & ~1
        return out


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def in_training(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 != 0


def lower(text: str | None) -> bytes:
    return (text or "").encode().lower()


def word_keys(raw: bytes) -> np.ndarray:
    known = _words()
    if len(known) > REMEMBERED:
        known.clear()
    words = raw.split()
    out = np.empty(len(words) + 1, np.int64)
    out[:-1] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    out[-1] = END_WORD
    return out


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of DEPTH + 1 bytes, big-endian, that end at each byte and at the end of each text; and their number by text."""
    pad = bytes([END]) * DEPTH
    a = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), np.uint8)
    key = np.zeros(len(a) - DEPTH, np.int64)
    for i in range(DEPTH + 1):
        key = key << 8 | a[i : len(a) - DEPTH + i]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    inside = np.ones(len(key) + DEPTH, bool)  # the last DEPTH windows of each stretch reach into the next text
    ends = np.cumsum(sizes + DEPTH)
    for i in range(DEPTH):
        inside[ends - 1 - i] = False
    return key[inside[: len(key)]], sizes


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a context or word, well mixed."""
    h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _steps(texts: list[bytes]) -> Iterator[slice]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= STEP_BYTES:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(k) else n


class Sums:
    """Counts by key, added piece by piece; pieces are put together whenever they outgrow what they came to before."""

    def __init__(self):
        self.keys, self.counts, self.held, self.most = [], [], 0, 1 << 20

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.most:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        k, n = _summed(self.keys, self.counts)
        self.keys, self.counts, self.held = [k], [n], len(k)
        self.most = max(1 << 20, 2 * len(k))
        return k, n


class Places:
    """Where keys stand among distinct ones: a table with open addressing, probed for all keys at once.

    A binary search for each window misses the cache at nearly every step; this takes a quarter of its time.
    """

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._hash(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left  # taken, or won by another key
            left, at = left[lost], at[lost] + 1 & self.mask
        self.key = np.where(self.slot >= 0, keys[self.slot], np.int64(-1)) if len(keys) else np.full(1 << bits, -1, np.int64)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; all must be there, and none below 0."""
        out = np.empty(len(keys), np.int32)
        for start in range(0, len(keys), PROBED):
            self._probe(keys[start : start + PROBED], out[start : start + PROBED])
        return out

    def _probe(self, keys: np.ndarray, out: np.ndarray) -> None:
        left, at = np.arange(len(keys), dtype=np.int32), self._hash(keys)
        while len(left):
            met = self.key[at]
            here = met == keys[left]
            out[left[here]] = self.slot[at[here]]
            if (met < 0).any():
                raise KeyError("a window or word that was not counted")
            left, at = left[~here], at[~here] + 1 & self.mask


PACK = "chunk int, kind int, bucket int, keys binary, vals binary"


def _packs(chunk: int, kind: int, keys: np.ndarray, vals: np.ndarray, buckets: int) -> list[tuple]:
    """Rows (chunk, kind, bucket, keys, vals) of sorted keys; windows go by their context."""
    b = bucket_of(keys >> 8 if kind == 0 else keys, buckets)
    order = np.argsort(b, kind="stable")
    cuts = np.searchsorted(b[order], np.arange(buckets + 1))
    out = []
    for i in range(buckets):
        part = order[cuts[i] : cuts[i + 1]]
        if len(part):
            out.append((chunk, kind, i, keys[part].tobytes(), vals[part].tobytes()))
    return out


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_PACK_NAMES = ["chunk", "kind", "bucket", "keys", "vals"]
_PACK_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def count(docs: DataFrame, buckets: int) -> DataFrame:
    """Per chunk: distinct windows (kind 0) and words (kind 1) with their counts in training documents."""

    def work(key, table):
        texts = [lower(t) for t in table.column("text").to_pylist()]
        train = [in_training(i) for i in table.column("doc_id").to_pylist()]
        rows: list[tuple] = []
        for kind in (0, 1):
            found = Sums()
            for step in _steps(texts):
                for flag in (True, False):
                    own = [t for t, x in zip(texts[step], train[step], strict=True) if x == flag]
                    if own:
                        k = windows(own)[0] if kind == 0 else np.concatenate([word_keys(t) for t in own])
                        u, n = np.unique(k, return_counts=True)
                        found.add(u, n if flag else np.zeros(len(u), np.int64))
            rows += _packs(key[0].as_py(), kind, *found.total(), buckets)
        return _table(rows, _PACK_NAMES, _PACK_TYPES)

    return docs.groupBy("chunk").applyInArrow(work, PACK)


def _unpack(table: pa.Table, kind: int) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    keys, vals, chunks = [], [], []
    for c, k, x, v in zip(*(table.column(n).to_pylist() for n in ("chunk", "kind", "keys", "vals")), strict=True):
        if k == kind:
            keys.append(np.frombuffer(x, np.int64))
            vals.append(np.frombuffer(v, np.int64))
            chunks.append(c)
    return keys, vals, chunks


def sums(packs: DataFrame, kind: int) -> DataFrame:
    """(key, n): counts over all chunks."""

    def work(_, table):
        keys, counts, _ = _unpack(table, kind)
        k, n = _summed(keys, counts)
        return pa.table([pa.array(k), pa.array(n)], names=["key", "n"])

    return packs.filter(F.col("kind") == kind).groupBy("bucket").applyInArrow(work, "key long, n long")


def word_values(packs: DataFrame) -> DataFrame:
    """The packs of words with each count summed over all chunks."""

    def work(_, table):
        keys, counts, chunks = _unpack(table, 1)
        k, n = _summed(keys, counts)
        places = Places(k)
        rows = [(c, 1, 0, x.tobytes(), n[places.find(x)].astype(np.float64).tobytes()) for c, x in zip(chunks, keys, strict=True)]
        return _table(rows, _PACK_NAMES, _PACK_TYPES)

    return packs.filter("kind = 1").groupBy("bucket").applyInArrow(work, PACK)


def log_gamma_ratio(n: Column, half: bool) -> Column:
    """ln Gamma(n + 1/2) - ln Gamma(1/2), or ln n!; Stirling's series eight steps up, brought down again."""
    z = n + (0.5 if half else 1.0)
    y = z + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    down = F.log(z * (z + 1) * (z + 2) * (z + 3)) + F.log((z + 4) * (z + 5) * (z + 6) * (z + 7))
    return series - down - (0.5 * math.log(math.pi) if half else 0.0)


def log_kt(n0: Column, n1: Column) -> Column:
    return log_gamma_ratio(n0, True) + log_gamma_ratio(n1, True) - log_gamma_ratio(n0 + n1, False)


def decisions(keys: DataFrame) -> DataFrame:
    """(ctx, node, bit, n) for the eight decisions of each key."""
    x = F.col("key").bitwiseAND(F.lit(255))
    each = F.array(*(F.struct((F.lit(1 << b) + F.shiftright(x, 8 - b)).cast("int").alias("node"), F.shiftright(x, 7 - b).bitwiseAND(F.lit(1)).cast("int").alias("bit")) for b in range(8)))
    return keys.select(F.shiftright("key", 8).alias("ctx"), "n", F.explode(each).alias("d")).select("ctx", "d.node", "d.bit", "n")


def _shorter(ctx: Column | str, depth: int) -> Column:
    return (F.col(ctx) if isinstance(ctx, str) else ctx).bitwiseAND(F.lit((1 << 8 * depth) - 1))


def node_probabilities(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(ctx, node, p): probability of a one at every decision that a key meets, mixed over all depths.

    `p` is acc + rest / 2 at the longest context that has counts: acc the mixed estimates so far, rest the weight left
    for longer contexts, whose estimate without counts is 1/2.
    """
    met = decisions(keys)
    level = met.filter("n > 0").groupBy("ctx", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).cast("double").alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).cast("double").alias("n1"))
    level = level.withColumn("lw", log_kt(F.col("n0"), F.col("n1"))).withColumn("w", F.lit(1.0))
    up = [Saved(level, "tree")]
    for depth in range(DEPTH - 1, -1, -1):
        by = up[-1].df.groupBy(_shorter("ctx", depth).alias("ctx"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("longer"))
        by = by.withColumn("k", log_kt(F.col("n0"), F.col("n1")) - math.log(2)).withColumn("longer", F.col("longer") - math.log(2))
        high = F.greatest("k", "longer")
        by = by.withColumn("lw", high + F.log1p(F.exp(F.least("k", "longer") - high)))
        up.append(Saved(by.select("ctx", "node", "n0", "n1", "lw", F.exp(F.col("k") - F.col("lw")).alias("w")), "tree"))
    up.reverse()  # by depth
    own = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    down: list[DataFrame] = []
    for depth, saved in enumerate(up):
        here = saved.df.select("ctx", "node", "w", own.alias("own"))
        if depth:
            above = down[-1].withColumnRenamed("ctx", "up")
            here = here.withColumn("up", _shorter("ctx", depth - 1)).join(above, ["up", "node"])
            mixed = here.select("ctx", "node", (F.col("acc") + F.col("rest") * F.col("w") * F.col("own")).alias("acc"), (F.col("rest") * (1 - F.col("w"))).alias("rest"))
        else:
            mixed = here.select("ctx", "node", (F.col("w") * F.col("own")).alias("acc"), (1 - F.col("w")).alias("rest"))
        down.append(scratch.save(mixed, "tree-mixed"))
        saved.drop()
    known = down[-1].select("ctx", "node", (F.col("acc") + F.col("rest") / 2).alias("p"))
    # Decisions that training never met at full depth take the longest context that it met.
    open_ = met.filter("n = 0").select("ctx", "node").distinct().join(known, ["ctx", "node"], "left_anti").withColumn("p", F.lit(None).cast("double"))
    for depth in range(DEPTH - 1, -1, -1):
        at = down[depth].select(F.col("ctx").alias("up"), "node", (F.col("acc") + F.col("rest") / 2).alias("at"))
        open_ = open_.withColumn("up", _shorter("ctx", depth)).join(at, ["up", "node"], "left").select("ctx", "node", F.coalesce("p", "at").alias("p"))
    return known.unionByName(open_.withColumn("p", F.coalesce("p", F.lit(0.5))))


def window_values(packs: DataFrame, nodes: DataFrame, buckets: int) -> DataFrame:
    """The packs of windows with the log10 probability of each window's byte."""
    def work(_, table, tree):
        keys, _, chunks = _unpack(table, 0)
        at = tree.column("ctx").to_numpy() << 8 | tree.column("node").to_numpy()
        places, p = Places(at), tree.column("p").to_numpy()
        rows = []
        for c, k in zip(chunks, keys, strict=True):
            value = np.zeros(len(k))
            for b in range(8):
                node = 1 << b | (k & 255) >> (8 - b)
                one = p[places.find(k >> 8 << 8 | node)]
                value += np.log10(np.where(k >> (7 - b) & 1, one, 1 - one))
            rows.append((c, 0, 0, k.tobytes(), value.tobytes()))
        return _table(rows, _PACK_NAMES, _PACK_TYPES)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = bucket_of(batch.column(0).to_numpy(), buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b)], names=["ctx", "node", "p", "bucket"])

    placed = nodes.select("ctx", "node", "p").mapInArrow(place, "ctx long, node int, p double, bucket int")
    return packs.filter("kind = 0").groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(work, PACK)


def score(docs: DataFrame, values: DataFrame, tokens: int, distinct: int) -> DataFrame:
    """One row per document from the values that its chunk was sent."""
    floor = math.log10(tokens + 0.1 * (distinct + 1))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double"
    names = [x.split()[0] for x in out.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def values_of(table: pa.Table, kind: int) -> tuple[Places, np.ndarray]:
        own = [(np.frombuffer(x, np.int64), np.frombuffer(v, np.float64)) for k, x, v in zip(*(table.column(n).to_pylist() for n in ("kind", "keys", "vals")), strict=True) if k == kind]
        return Places(np.concatenate([x for x, _ in own])), np.concatenate([x for _, x in own])

    def work(_, table, sent):
        ids = table.column("doc_id").to_pylist()
        texts = [lower(t) for t in table.column("text").to_pylist()]
        if not ids:
            return _table([], names, kinds)
        wk, wv = values_of(sent, 0)
        ck, cv = values_of(sent, 1)
        logs = np.log10(cv + 0.1) - floor
        rows = []
        for step in _steps(texts):
            key, sizes = windows(texts[step])
            found = np.add.reduceat(wv[wk.find(key)], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            words = [word_keys(t) for t in texts[step]]
            n = np.array([len(w) for w in words])
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            at = ck.find(np.concatenate(words))
            base, known = np.add.reduceat(logs[at], first), np.add.reduceat((cv[at] > 0).astype(np.int64), first)
            rows += zip(ids[step], (not in_training(i) for i in ids[step]), n.tolist(), known.tolist(), (sizes - 1).tolist(), base.tolist(), found.tolist(), strict=True)
        return _table(rows, names, kinds)

    return docs.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(work, out)


def run(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(8, -(-size // CHUNK_BYTES))
    buckets = chunks  # a bucket then holds of each chunk what a chunk holds of each bucket: the same at any size
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    # Tables go as soon as nothing needs them: the disk never holds the counts, the tree and the values together.
    scratch = Scratch(df.sparkSession)
    counted = Saved(count(docs, buckets), "tree-counts")
    packs = counted.df
    words = sums(packs, 1).filter("n > 0").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    keys = scratch.save(sums(packs, 0), "tree-windows")
    nodes = Saved(node_probabilities(keys, scratch), "tree-nodes")
    scratch.drop()
    values = Saved(window_values(packs, nodes.df, buckets).unionByName(word_values(packs)), "tree-values").df
    counted.drop()
    nodes.drop()
    scratch.drop()
    tokens = words["tokens"] or 0
    out = score(docs, values, tokens, words["distinct"]).withColumn("train_tokens", F.lit(tokens).cast("long"))
    bits = -F.col("score") * math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))

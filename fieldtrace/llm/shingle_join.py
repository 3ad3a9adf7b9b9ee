"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and distinct word n-grams columns of an incidence matrix; equal rows are one node.  Jaccard >= r asks
for an overlap of at least r / (1 + r) of both sizes together, and so two similar rows share one of the first
n - ceil(r n) + 1 columns of each in any common order of columns: only these entries choose which blocks are multiplied.
The order puts columns that many rows have last; a sketch of column counts of fixed size decides, which changes cost and
no result.

First product.  Entries are dealt by column, those of columns with very many rows by column and row part.  Each block
multiplies the first rows of a column, the most central ones, with all its rows; a column of up to FEW rows whole.
Either way a column of w rows gives at most 2 w counts.  Counts are summed over all blocks; a pair is dropped where its
count, the columns that are not counted yet and those beyond the prefixes stay below the overlap that its sizes ask for.
The rest are bounded by their hashed rows, then checked on their full rows, and linked rows are joined into components.

Second product.  Columns whose rows lie in several components are multiplied in full; of columns with the same rows one
is enough.  Rows are dealt in row blocks, and each pair of blocks multiplies the hashed rows of both, bit fields with a bit for each column's hash, over all
columns at once.  A bit that one row has alone stands for a column that the other lacks, so the counts bound the overlap
from above; pairs below what their sizes ask for, or within one component, are dropped and the rest checked on full
rows.  Blocks with many pairs give the PER_ROW best ones of each row; then linked rows are joined, and columns that are
still open are multiplied again, until no pair is left out.  So no link between components is lost, and no group of copies is written out pair by pair.

Defined cases: null and wordless texts have size 0, link with nothing and are their own component; texts with fewer than
n words are one n-gram; rows with equal sets share a component at any number of copies; a text of any length is one row
with all its n-grams; a null document id takes the smallest other id of its component, or null; other columns, whatever
their names, are not read by `join` and kept by `keep_one`; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import Saved, Scratch, each_spread, free_name, hash128, spread_of, spreads
from fieldtrace.llm.components import components

#: Words whose hashes a worker remembers; the store is emptied when full, which changes no result.
REMEMBERED = 400_000
#: Rows of a column's first row block; a column of up to FEW rows has no more pairs than its first block would give.
FIRST, FEW = 2, 5
#: Rows of a row block in the second product, and of a part of a column with more rows in the first.
ROW_BLOCK = 512
#: Pairs a row, on average, that a pair of blocks gives in a round of the second product; of more, each row gives its best.
PER_ROW = 4
#: Share of all links below which a round has found so few that the next one gives all pairs.
FEW_LINKS = 0.02
SKETCH_BITS = 22
#: Bits a column, at least, of the marks that pairs are dropped by.
MARK_BITS = 4
CHUNK = 1 << 14
#: Share of the slots of the map of asked-for rows beyond which it is no longer worth its while.
FULL = 0.3

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams, A-Z in lower case."""
    words = (text or "").encode().lower().split()  # bytes split at \x20 and \x09-\x0D only
    if not words:
        return np.zeros(0, np.uint64)
    known = _words()
    if len(known) > REMEMBERED:
        known.clear()
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(each))
    h = each[: len(each) - k + 1].copy()
    for i in range(1, k):
        h = h * _MUL + each[i : len(each) - k + 1 + i]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(h: np.ndarray) -> int:
    """63-bit name of a set; 0 for the empty one."""
    import xxhash

    return xxhash.xxh3_64_intdigest(h.tobytes()) >> 1 if len(h) else 0


def _sketch_parts(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for at in range(0, len(counts), CHUNK):
        part = counts[at : at + CHUNK]
        if part.any():
            yield at, part.tobytes()


def _sum_sketch(rows: DataFrame) -> np.ndarray:
    """Sum of sketch parts (chunk, counts); what comes to the driver has the sketch's fixed size."""
    size = 1 << SKETCH_BITS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = _decode(np.frombuffer(x, np.uint8))
                sums[c] = sums[c] + part if c in sums else part
        for c, part in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "counts": [part.tobytes()]})

    out = np.zeros(size, np.uint32)
    # Collected in one job: an iterator would run one for each partition, and all chunks together are of fixed size.
    for row in rows.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[row.chunk : row.chunk + CHUNK] = np.frombuffer(row.counts, np.uint32)
    return out


def excess(counts: np.ndarray) -> np.ndarray:
    """By how much each sketch slot exceeds the level of chance."""
    mean = counts.mean()
    return np.maximum(0, counts - mean - 4 * np.sqrt(mean))


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank 0 to 31 of each sketch slot: 0 at the level of chance, higher the more rows have its columns."""
    return np.minimum(31, np.ceil(np.log2(1 + excess(counts) / 8))).astype(np.uint8)


def parts_of(counts: np.ndarray) -> np.ndarray:
    """Of each sketch slot, the number of parts, as a power of two, in which the rows of its columns are dealt."""
    return np.ceil(np.log2(np.maximum(1, excess(counts) / ROW_BLOCK))).astype(np.uint8)


def _code(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact below 128, then in steps of a sixteenth power of two."""
    return np.where(counts < 128, counts, np.minimum(255, 128 + 16 * np.log2(np.maximum(counts, 128) / 128))).astype(np.uint8)


def _decode(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 128, codes, 128 * 2.0 ** ((codes.astype(np.float64) - 128) / 16)).astype(np.uint32)


def least_overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest overlap of sets of these sizes with a Jaccard of num / den."""
    return -(-num * (a + b) // (num + den))


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


NODE = "doc_id long, n long, node long, a long, b long, marks binary, chunk int, counts binary"
_NODE_TYPES = [pa.int64()] * 5 + [pa.binary()] + [pa.int32(), pa.binary()]
_NODE_NAMES = [x.split()[0] for x in NODE.split(", ")]


def nodes_and_sketch(docs: DataFrame, n: int) -> DataFrame:
    """Rows of all documents, with marks once per task for each node, and of each task a sketch of its nodes' column counts (chunk, counts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held, seen = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0, {0}

        def flush():
            if waiting:
                counts[:] += np.bincount((np.concatenate(waiting) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)

        for batch in batches:
            size, node, marks = [], [], []
            for t in batch.column(1):
                h = shingles(t.as_py(), n)
                name = signature(h)
                size.append(len(h))
                node.append(name)
                marks.append(None if name in seen else marks_of(h))
                if name not in seen:
                    seen.add(name)
                    waiting.append(h)
                    held += len(h)
                if held > 1 << 20:
                    flush()
                    waiting, held = [], 0
            none = [None] * len(size)
            columns = [batch.column(0), size, node, batch.column(2), batch.column(3), marks, none, none]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _NODE_TYPES, strict=True)], names=_NODE_NAMES)
        flush()
        for at, part in _sketch_parts(_code(counts)):
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([None] * 6 + [at, part], _NODE_TYPES, strict=True)], names=_NODE_NAMES)

    return docs.mapInArrow(scan, NODE)


ENTRY = "col long, part int, node long, n int, central int"
_ENTRY_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def prefixes(docs: DataFrame, n: int, num: int, den: int, ranks) -> DataFrame:
    """Entries of the incidence matrix that are multiplied: ENTRY; equal rows once per task.

    Columns are dealt in one part (0), or in parts from 1 on where very many rows have them.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rank, split), seen = ranks.value, set()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for t in batch.column(1):
                h = shingles(t.as_py(), n)
                node = signature(h)
                if not node or node in seen:
                    continue
                seen.add(node)
                slot = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                r = rank[slot]
                col = r.astype(np.uint64) << np.uint64(58) | h >> np.uint64(6)
                p = prefix_size(len(h), num, den)
                first = np.argpartition(col, p - 1)[:p]
                first = first[np.argsort(col[first])]
                many = split[slot[first]].astype(np.int64)
                out[0].append(col[first].view(np.int64))
                out[1].append(np.where(many > 0, 1 + (node % (1 << many)), 0))
                for values, x in zip(out[2:], (node, len(h), int(r.mean() * 1000)), strict=True):
                    values.append(np.full(p, x, np.int64))
            if out[0]:
                columns = [np.concatenate(x) for x in out]
                columns = [x.astype(np.int32) if i in (1, 3, 4) else x for i, x in enumerate(columns)]
                yield from _batches(columns, _ENTRY_NAMES)

    return docs.mapInArrow(scan, ENTRY)


def _gather(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    parts = list(batches)
    if not parts:
        return []
    whole = pa.Table.from_batches(parts)
    return [c.to_numpy() for c in whole.columns]


def _within(size: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes alone allow the pairs."""
    low, high = np.minimum(size[a], size[b]).astype(np.int64), np.maximum(size[a], size[b]).astype(np.int64)
    return low * den >= high * num


def _batches(arrays: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(arrays[0]), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 18)]) for x in arrays], names=names)


PAIR = "kind int, a long, b long, na int, nb int, c int, col long, central int, first boolean"
_NAMES = [x.split()[0] for x in PAIR.split(", ")]


def product(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Per block: overlap counts of the pairs that are multiplied (kind 0), and the entries of other columns (kind 1).

    `first` marks the first rows of a part of a column, which the parts of that column are multiplied by next.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        if not got:
            return
        order = np.lexsort((got[2], -got[4], got[1], got[0]))  # the most central rows of a column come first
        col, part, node, size, central = (x[order] for x in got)
        keep = np.r_[True, (col[1:] != col[:-1]) | (part[1:] != part[:-1]) | (node[1:] != node[:-1])]  # equal rows of different tasks
        col, part, node, size, central = col[keep], part[keep], node[keep], size[keep], central[keep]
        start = np.flatnonzero(np.r_[True, (col[1:] != col[:-1]) | (part[1:] != part[:-1])])
        width = np.diff(np.r_[start, len(col)])
        one, two = [], []
        for w in range(2, FEW + 1):
            at = start[width == w]
            i, j = np.triu_indices(w, 1)
            one.append((at[:, None] + i).ravel())
            two.append((at[:, None] + j).ravel())
        at, w = start[width > FEW], width[width > FEW]
        place = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        for f in range(FIRST):
            one.append(np.repeat(at + f, w)[place > f])
            two.append((np.repeat(at, w) + place)[place > f])
        a, b = np.concatenate(one), np.concatenate(two)
        ok = _within(size, a, b, num, den)
        a, b = a[ok], b[ok]
        swap = node[a] > node[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        order = np.lexsort((node[b], node[a]))
        a, b = a[order], b[order]
        if len(a):
            at = np.flatnonzero(np.r_[True, (node[a[1:]] != node[a[:-1]]) | (node[b[1:]] != node[b[:-1]])])
            c = np.diff(np.r_[at, len(a)]).astype(np.int32)
            a, b = a[at], b[at]
            zero = np.zeros(len(a), np.int32)
            yield from _batches([zero, node[a], node[b], size[a], size[b], c, zero.astype(np.int64), zero, zero > 0], _NAMES)
        many = np.repeat(width > FEW, width) | (part > 0)
        if many.any():
            first = ((np.arange(len(col)) - np.repeat(start, width)) < FIRST) & (part > 0)
            m = int(many.sum())
            zero = np.zeros(m, np.int32)
            yield from _batches([zero + 1, node[many], zero.astype(np.int64), size[many], zero, zero, col[many], central[many], first[many]], _NAMES)

    return entries.select(*_ENTRY_NAMES).repartition("col", "part").mapInArrow(block, PAIR)


def marks_of(h: np.ndarray) -> bytes:
    """Bit field of a set, a power of two in all, so that a longer one can be folded."""
    bits = np.zeros(1 << max(8, int(MARK_BITS * len(h) - 1).bit_length()), bool)
    bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _possible(own: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether a row of size `n` and marks `own` can reach the threshold with others; marks are of equal or half the length."""
    while own.shape[-1] > others.shape[-1]:
        own = own[: len(own) // 2] | own[len(own) // 2 :]
    while others.shape[-1] > own.shape[-1]:
        half = others.shape[-1] // 2
        others = others[:, :half] | others[:, half:]
    most = np.minimum(n - np.bitwise_count(own & ~others).sum(1, dtype=np.int64), sizes - np.bitwise_count(others & ~own).sum(1, dtype=np.int64))
    return most * (num + den) >= num * (n + sizes)


def _bits(marks: list[bytes], bits: int) -> np.ndarray:
    """Rows of 0 and 1, folded to `bits` columns."""
    field = np.unpackbits(np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), -1), axis=1)
    while field.shape[1] > bits:
        half = field.shape[1] // 2
        # Bits lie byte by byte, so that halves of the field are halves of the hashes' range.
        field = field[:, :half] | field[:, half:]
    return field


#: Cells of a matrix of bits that are multiplied at a time.
CELLS = 1 << 24


def block_product(x: list[bytes], y: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the hashed columns that each row of `x` shares with each of `y`, and the counts of either's own."""
    p, q = _bits(x, bits), _bits(y, bits)
    shared = np.zeros((len(x), len(y)), np.float32)
    step = max(1, CELLS // (len(x) + len(y)))
    for at in range(0, bits, step):
        shared += p[:, at : at + step].astype(np.float32) @ q[:, at : at + step].astype(np.float32).T
    return shared.astype(np.int64), p.sum(1, dtype=np.int64), q.sum(1, dtype=np.int64)


def open_columns(wide: DataFrame) -> DataFrame:
    """The entries (col, node, n, root) of columns whose rows lie in several components, with what is needed to deal them.

    Of columns with the same rows, as those of a passage, one is enough: they would give the same pairs.
    """
    wide = wide.withColumn("share", spread_of("node"))
    marks = hash128("node")
    held = wide.groupBy("col", "root").agg(F.count(F.lit(1)).alias("rows"), spreads(F.col("share")).alias("shares"), F.bit_xor(marks["a"]).alias("x"), F.bit_xor(marks["b"]).alias("y"))
    cols = held.groupBy("col").agg(F.max(F.struct("rows", "root")).alias("most"), F.sum("rows").alias("all"), F.count(F.lit(1)).alias("roots"), F.bit_or("shares").alias("shares"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    one = cols.filter("roots > 1").groupBy("all", "x", "y").agg(F.min(F.struct("col", "most", "shares")).alias("c"))
    number = lambda rows: F.greatest(F.lit(1), F.ceil(rows / ROW_BLOCK)).cast("int")
    one = one.select("c.col", "c.shares", F.col("c.most.root").alias("top"), number(F.col("c.most.rows")).alias("tops"), number(F.col("all") - F.col("c.most.rows")).alias("rests"))
    placed = wide.join(each_spread(one, "shares", "share"), ["col", "share"])
    return placed.select("col", "node", "n", "root", "tops", "rests", (F.col("root") != F.col("top")).alias("rest"))


def wide_pairs(placed: DataFrame, num: int, den: int, most: int | None) -> DataFrame:
    """Pairs (a, b) of rows of one column in different components, as far as the product of their hashed rows allows.

    `placed` has the rows of open columns with marks.  The rows of a column's largest component are multiplied with the
    other rows only; both are dealt in blocks, and a task has two blocks of a column.  Of a pair of blocks with more
    than `most` pairs a row on average each row gives the `most` most promising ones, so that rows of one group do not give all their pairs before they are joined; a row
    of nulls says that there are more.  Without `most` all are given.
    """
    own = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("tops"))).cast("int")
    placed = placed.withColumn("own", own)
    # Blocks: (i, j) of other rows, i <= j, and (i, -1 - j) of block i of the others with block j of the largest component.
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    among = F.transform(upto("rests"), lambda x: pair(F.least(x, F.col("own")), F.greatest(x, F.col("own"))))
    across = F.transform(upto("tops"), lambda x: pair(F.col("own"), -1 - x))
    joined = F.transform(upto("rests"), lambda x: pair(x, -1 - F.col("own")))
    dealt = placed.withColumn("at", F.explode(F.when(F.col("rest"), F.concat(among, across)).otherwise(joined)))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        col, i, j, own, rest, node, size, root = (whole.column(k).to_numpy() for k in range(8))
        marks = whole.column(8)
        order = np.lexsort((j, i, col))
        cuts = np.flatnonzero((np.diff(col[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        done: list[np.ndarray] = []
        for here in np.split(order, cuts):
            left = here[rest[here] & (own[here] == i[here[0]])]
            right = here[(own[here] == j[here[0]]) if j[here[0]] >= 0 else ~rest[here]]
            done += _survivors(left, right, node, size.astype(np.int64), root, marks, num, den, most)
            if sum(x.shape[1] for x in done) > 1 << 20:
                yield from _distinct(done)
                done = []
        if done:
            yield from _distinct(done)

    columns = ["col", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "own", "rest", "node", "n", "root", "marks"]
    found = dealt.select(*columns).repartition("col", "i", "j").mapInArrow(block, "a long, b long").distinct()
    return found.select(F.nullif("a", F.lit(-1)).alias("a"), F.nullif("b", F.lit(-1)).alias("b"))


#: Stands for pairs that are left out.
CUT = np.full((2, 1), -1, np.int64)


def _survivors(left: np.ndarray, right: np.ndarray, node, size, root, marks, num: int, den: int, most: int | None) -> Iterator[np.ndarray]:
    """Pairs of a row of `left` and one of `right` that sizes, components and the product of hashed rows allow; CUT if some are left out."""
    own = {int(k): marks[int(k)].as_py() for k in np.union1d(left, right)}
    bits = {k: 8 * len(m) for k, m in own.items()}
    classes = lambda at: {b: np.array([k for k in at.tolist() if bits[k] == b]) for b in {bits[k] for k in at.tolist()}}
    for x, p in classes(left).items():
        for y, q in classes(right).items():
            low, high = np.minimum(size[p][:, None], size[q][None, :]), np.maximum(size[p][:, None], size[q][None, :])
            open_ = (low * den >= high * num) & (root[p][:, None] != root[q][None, :])
            if not open_.any():
                continue
            shared, a, b = block_product([own[k] for k in p.tolist()], [own[k] for k in q.tolist()], min(x, y))
            # Bits that one row has alone are columns that the other lacks.
            bound = np.minimum(size[p][:, None] - a[:, None], size[q][None, :] - b[None, :]) + shared
            fits = open_ & (bound * (num + den) >= num * (low + high))
            if most and fits.sum() > most * (len(p) + len(q)):
                yield CUT
                promise = np.where(fits, bound / (low + high), 0)
                top = np.zeros_like(fits)
                np.put_along_axis(top, np.argsort(-promise, axis=1, kind="stable")[:, :most], True, 1)
                np.put_along_axis(top, np.argsort(-promise, axis=0, kind="stable")[:most], True, 0)
                fits &= top
            s, t = np.nonzero(fits)
            if len(s):
                yield np.stack([np.minimum(node[p][s], node[q][t]), np.maximum(node[p][s], node[q][t])])


def _distinct(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    a, b = np.concatenate(pairs, axis=1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    yield from _batches([a[keep], b[keep]], ["a", "b"])


def likely(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that sizes and marks allow; `nodes` has node, n, marks."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = [
                bool(_possible(np.frombuffer(x.as_buffer(), np.uint8), int(n), np.frombuffer(y.as_buffer(), np.uint8)[None, :], m, num, den)[0])
                for x, y, n, m in zip(batch.column(4), batch.column(5), na, nb, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("marks").alias("x")), "a")
    two = one.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("y")), "b")
    return two.select("a", "b", "na", "nb", "x", "y").mapInArrow(test, "a long, b long")


def full_rows(docs: DataFrame, holders: DataFrame, n: int) -> DataFrame:
    """(node, row): the hashes of the nodes asked for; `holders` names for each node one document that has it, by hash."""
    spark = docs.sparkSession
    shift = np.uint64(64 - SKETCH_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << SKETCH_BITS, np.uint8)
        for batch in batches:
            marks[batch.column(0).to_numpy().view(np.uint64) >> shift] = 1
        for at, part in _sketch_parts(marks):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int32()), "counts": [part]})

    slots = _sum_sketch(holders.select("a").mapInArrow(mark, "chunk int, counts binary")) > 0
    if slots.mean() > FULL:
        # The map would let nearly all texts pass: they are joined with the holders before they are read.
        docs, slots = docs.join(holders.select("a").distinct(), "a", "left_semi"), np.ones_like(slots)
    wanted = spark.sparkContext.broadcast(slots)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, seen = wanted.value, {0}
        for batch in batches:
            some = pa.array(want[batch.column(1).to_numpy().view(np.uint64) >> shift])
            got: list[tuple[int, bytes]] = []
            for t in batch.column(0).filter(some):
                h = shingles(t.as_py(), n)
                node = signature(h)
                if node not in seen:
                    seen.add(node)
                    got.append((node, h.tobytes()))
            if got:
                nodes_, rows = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes_, pa.int64()), pa.array(rows, pa.binary())], names=["node", "row"])

    return docs.select("text", "a").mapInArrow(scan, "node long, row binary").join(holders.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verify(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose full rows reach the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both * den >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(rows.select(F.col("node").alias("a"), F.col("row").alias("x")), "a")
    two = one.join(rows.select(F.col("node").alias("b"), F.col("row").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b) between nodes; nodes without a root so far are their own."""
    side = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"r{s}"))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    tops = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(tops.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots, "node", "left_anti"))


def join(df: DataFrame, n: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df`: doc_id, n_shingles, node (name of its set), component_id, and a, b (hash of id and text)."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    k = hash128(F.col(doc_id), F.col(text))
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), k["a"].alias("a"), k["b"].alias("b"))
    narrow = Saved(nodes_and_sketch(docs, n), "shingle-nodes").df
    counts = _sum_sketch(narrow.filter("chunk is not null").select("chunk", "counts"))
    documents = narrow.filter("chunk is null").select("doc_id", "n", "node", "a", "b")
    marked = narrow.filter("marks is not null").select("node", "n", "marks")
    ranks = spark.sparkContext.broadcast((ranks_of(counts), parts_of(counts)))
    blocks = scratch.save(product(prefixes(docs, n, num, den, ranks), num, den), "shingle-product")

    wide = blocks.filter("kind = 1").select("col", F.col("a").alias("node"), F.col("na").alias("n"), "central", "first")
    # Pairs may also share wide columns, which are not counted: at most as many as either row has.
    in_wide = scratch.save(wide.groupBy("node").agg(F.count(F.lit(1)).alias("w")), "shingle-wide")
    # The first rows of all parts of a column are multiplied with each other, as a column of their own.
    heads = product(wide.filter("first").select("col", F.lit(0).alias("part"), "node", "n", "central"), num, den)
    summed = blocks.unionByName(heads).filter("kind = 0").groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    for side in "ab":
        summed = summed.join(in_wide.select(F.col("node").alias(side), F.col("w").alias(f"w{side}")), side, "left")
    beyond = lambda s: F.ceil(F.col(s) * num / den) - 1  # noqa: E731  columns after the prefix
    most = F.col("c") + F.least(F.coalesce("wa", F.lit(0)), F.coalesce("wb", F.lit(0))) + F.greatest(beyond("na"), beyond("nb"))
    counted = summed.filter(most * (num + den) >= num * (F.col("na") + F.col("nb"))).select("a", "b")

    # One row for each set, however many documents have it.
    share = spread_of("a", "b")
    first = scratch.save(documents.filter("node <> 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.min("a").alias("a"), spreads(share).alias("shares")), "shingle-first")

    def checked(pairs: DataFrame) -> DataFrame:
        """Links among the pairs, by the full rows of both."""
        own = Scratch(spark)
        pairs = own.save(pairs, "shingle-pairs")
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        holders = own.save(first.join(asked, "node", "left_semi").select("node", "a"), "shingle-holders")
        rows = own.save(full_rows(docs, holders, n), "shingle-rows")
        out = scratch.save(verify(pairs, rows, num, den), "shingle-links")
        own.drop()
        return out

    counted = scratch.save(counted, "shingle-counted")
    asked = counted.select(F.col("a").alias("node")).union(counted.select("b")).distinct()
    links = checked(likely(counted, marked.join(asked, "node", "left_semi").dropDuplicates(["node"]), num, den))
    most, roots, n_links = PER_ROW, components(links), links.count()
    while not in_wide.isEmpty():
        placed = wide.join(roots, "node", "left").select("col", "node", "n", F.coalesce("root", "node").alias("root"))
        left = scratch.save(open_columns(placed), "shingle-open")
        of_left = marked.join(left.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", "marks")
        pairs = scratch.save(wide_pairs(left.join(of_left, "node"), num, den, most), "shingle-wide-pairs")
        found = checked(pairs.filter("a is not null"))
        n_found = found.count()
        if n_found:
            roots = scratch.save(merged(roots, found), "shingle-roots")
        if pairs.filter("a is null").isEmpty():
            break
        # Where a round has joined next to nothing, what it left out is not waiting to be joined: the next gives all.
        n_links += n_found
        most = None if n_found <= FEW_LINKS * n_links else PER_ROW
    named = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_node = Saved(named.join(lowest, "root").select(F.col("node").alias("_node"), "component_id", "shares"), "shingle-components").df
    scratch.drop()
    shared = each_spread(by_node, "shares", "_share")
    out = documents.join(shared, (F.col("node") == F.col("_node")) & (share == F.col("_share")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "doc_id").alias("component_id"), "a", "b")


def keep_one(df: DataFrame, n: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with one row of each component: the one of the smallest id, then of the smallest hash of id and text.

    Rows without words are components of their own and stay; of rows with equal id and text one stays.
    """
    joined = Saved(join(df, n, num, den, doc_id, text), "shingle-classes").df
    wordy = joined.filter("n_shingles > 0")
    # A component is named by its smallest id, and by its set where it has none.
    name = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("node")).alias("set")]
    best = wordy.groupBy(*name).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "a", "b")).alias("best"))
    copies = wordy.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"))
    kept = best.select("best.a", "best.b").join(copies, ["a", "b"])
    kept = kept.unionByName(joined.filter("n_shingles = 0").select("a", "b", F.lit(1).cast("long").alias("copies")).distinct())
    key, x, y, times = (free_name(df, c) for c in ("_key", "_a", "_b", "_copies"))
    kept = kept.withColumnsRenamed({"a": x, "b": y, "copies": times})
    keyed = df.withColumn(key, hash128(F.col(doc_id), F.col(text)))
    rows = keyed.join(kept.hint("merge"), (F.col(key)["a"] == F.col(x)) & (F.col(key)["b"] == F.col(y)))
    once = rows.filter(F.col(times) == 1).unionByName(rows.filter(F.col(times) > 1).dropDuplicates([x, y]))
    return once.select(*df.columns)

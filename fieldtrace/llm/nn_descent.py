"""Near duplicates among embeddings by NN-descent.

Equal vectors with equal labels are one node.  Nodes start with the best neighbours from a few random cells; then each
round joins the neighbours of every node, in both directions, with each other and keeps the `k` best of each node, as
long as lists still change.  Edges that reach the threshold are links.  A list that is full of links is saturated and may
hide others: saturated nodes search again for the best neighbours outside their component, and components that turn out
linked are merged, until no such link is left.  Members of a component are then compared with each other in blocks, so
that dense groups lose no link and no pair of them is written out; blocks that the angles to one direction prove to be
linked whole, or not at all, are not compared.  The recall is audited: for bounded samples of all
nodes and of one node of each component the exact links are counted against all rows, and the search goes on with
doubled lists until the nodes of either sample have, on average, enough of theirs; after DOUBLINGS it fails by name.

Cosines are computed in double precision on vectors scaled by their largest component, so that no finite one leaves the
range.  Defined cases: a null label, and a vector that is null, empty, zero or holds a null or non-finite component,
links with nothing; vectors of different length do not link; repeated rows are copies and link with each other; a null
id takes part, and a component's id is the smallest other one; other columns, whatever their names, are not read; empty
tables give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import Saved, each_spread, spread_of, spreads
from fieldtrace.llm.components import components

K, TABLES, CELL, SPLIT = 12, 3, 48, 256
ROUNDS, LEAST_CHANGE = 8, 0.005
#: Nodes of each of the two samples whose exact links are counted in the audit, and the recall asked for.
AUDITED, RECALL = 1000, 0.97
#: How often lists are doubled before the search gives up with an error.
DOUBLINGS = 6
BLOCK = 512
#: Members whose mean gives a large component's direction; width of a ring of angles; what is left for rounding (radians).
PIVOTS, RING, SLACK = 64, 0.01, 1e-6
#: Labels whose sizes are sent to every task; beyond, they are joined by shuffle.
MAX_SENT = 100_000


def _vectors(column) -> list[np.ndarray | None]:
    """Vectors in double precision; None where one cannot link."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(v if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _unit(blobs: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares of huge or tiny numbers stay in range
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def rows_of(df: DataFrame, vec_id: str, label: str, embedding: str) -> DataFrame:
    """(vec_id, label, node, v) of every row; node is null where the row cannot link."""
    import xxhash

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, blobs = [], []
            for name, v in zip(batch.column(1).to_pylist(), _vectors(batch.column(2)), strict=True):
                raw = None if v is None or name is None else v.tobytes()
                nodes.append(None if raw is None else (xxhash.xxh3_64_intdigest(f"{len(raw)}|{name}|".encode() + raw) >> 1))
                blobs.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["vec_id", "label", "node", "v"])

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"))
    return rows.mapInArrow(work, "vec_id long, label string, node long, v binary")


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    parts = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(parts) if parts else None


def _groups(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """Index arrays of rows with equal keys."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    cuts = np.flatnonzero(change)
    yield from np.split(order, cuts[1:])


EDGE = "node long, other long, sim double, fresh boolean"


def _edges(node: list[np.ndarray], other: list[np.ndarray], sim: list[np.ndarray]) -> pa.RecordBatch:
    n, o, s = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((node, np.int64), (other, np.int64), (sim, np.float64)))
    return pa.RecordBatch.from_arrays([pa.array(n), pa.array(o), pa.array(s), pa.array(np.ones(len(n), bool))], names=["node", "other", "sim", "fresh"])


def first_lists(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """Best neighbours with another root within cells of random hyperplanes; large cells are dealt in parts of about SPLIT.

    Near-equal vectors share all cells however small these are, so cells are counted before vectors are sent to them.
    Each table deals the rows of a large cell by another hash, or pieces of a dense group would never meet.
    """
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size"))
    sized = nodes.join(F.broadcast(sizes) if sizes.limit(MAX_SENT + 1).count() <= MAX_SENT else sizes, ["label", "dim"])
    sized = sized.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / CELL))).cast("int"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            node, bits, dim = (batch.column(i).to_numpy() for i in (0, 2, 3))
            blobs = batch.column(1).to_pylist()
            home = batch.column(4).to_pylist()
            for at in _groups(dim, bits):
                m, b, d = _unit([blobs[i] for i in at]), int(min(bits[at[0]], 40)), int(dim[at[0]])
                for t in range(TABLES):
                    if (t, d) not in planes:
                        planes[t, d] = np.random.default_rng([seed, t, d]).standard_normal((d // 8, 40))
                    code = ((m @ planes[t, d][:, :b] > 0) @ (1 << np.arange(b, dtype=np.int64))) if b else np.zeros(len(at), np.int64)
                    cells = [f"{t}|{d}|{home[i]}|{c}" for i, c in zip(at.tolist(), code.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(node[at])], names=["cell", "node"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gather(batches)
        if table is None:
            return
        cell, part, node = table.column(0).combine_chunks().dictionary_encode().indices.to_numpy(), table.column(1).to_numpy(), table.column(2).to_numpy()
        blobs, root = table.column(3).to_pylist(), table.column(4).to_numpy()
        for at in _groups(cell, part):
            if len(at) > 1:
                m = _unit([blobs[i] for i in at])
                sim = m @ m.T
                sim[root[at][:, None] == root[at][None, :]] = -2
                n = min(k, len(at) - 1)
                top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                sims = np.take_along_axis(sim, top, 1).ravel()
                apart = sims > -2
                yield _edges([np.repeat(node[at], n)[apart]], [node[at][top].ravel()[apart]], [sims[apart]])

    coded = sized.select("node", "v", "bits", F.col("dim").cast("int").alias("dim"), "label").mapInArrow(deal, "cell string, node long")
    cells = Saved(coded.withColumn("share", spread_of("node")), "cells").df
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), spreads(F.col("share")).alias("shares")).filter(F.col("rows") > SPLIT)
    placed = cells.join(each_spread(large, "shares", "share"), ["cell", "share"], "left")
    part = F.pmod(F.xxhash64(F.lit(seed), "cell", "node"), F.ceil(F.coalesce("rows", F.lit(1)) / SPLIT))
    placed = placed.select("cell", "node", part.cast("int").alias("part")).join(nodes.select("node", "v", "root"), "node")
    return placed.select("cell", "part", "node", "v", "root").repartition("cell", "part").mapInArrow(best, EDGE)


def keep_best(edges: DataFrame, k: int, ahead: bool = False) -> DataFrame:
    """The `k` best edges of each node; an edge stays fresh only if no list had it before.

    With `ahead` each task cuts what it sends, for edges of which one node may have very many.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gather(batches)
        if table is None:
            return
        node, other, sim, fresh = (c.to_numpy() for c in table.columns)
        order = np.lexsort((fresh, other, node))  # an older copy of an edge comes first
        node, other, sim, fresh = node[order], other[order], sim[order], fresh[order]
        keep = np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])]
        node, other, sim, fresh = node[keep], other[keep], sim[keep], fresh[keep]
        order = np.lexsort((other, -sim, node))
        node, other, sim, fresh = node[order], other[order], sim[order], fresh[order]
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        place = np.arange(len(node)) - np.repeat(start, np.diff(np.r_[start, len(node)]))
        keep = place < k
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (node, other, sim, fresh)], names=["node", "other", "sim", "fresh"])

    own = edges.select("node", "other", "sim", "fresh")
    own = own.mapInArrow(work, EDGE) if ahead else own
    return own.repartition("node").mapInArrow(work, EDGE)


def join_neighbours(lists: DataFrame, nodes: DataFrame, k: int, inner: DataFrame | None = None) -> DataFrame:
    """Edges between the neighbours of each node, of different roots, that are better than what their lists end with.

    Edges of `inner` make neighbours too, but are in no list.
    """
    worst = lists.groupBy("node").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(F.lit(-1.0)).alias("worst"))
    # In the other direction the k best and freshest count too: a node that many lists name does not gather them all.
    back = keep_best(lists.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim", "fresh"), k, ahead=True)
    both = lists.unionByName(back).groupBy("node", "other").agg(F.min("fresh").alias("fresh"))
    if inner is not None:
        both = both.unionByName(inner.select("node", "other", F.lit(False).alias("fresh")))
    active = both.groupBy("node").agg(F.max("fresh").alias("any")).filter("any").select("node")
    around = both.join(active, "node", "left_semi").select(F.col("node").alias("center"), F.col("other").alias("node"), "fresh")
    told = around.join(nodes.select("node", "v", "root").join(worst, "node", "left"), "node").select("center", "node", "fresh", "v", F.coalesce("worst", F.lit(-1.0)).alias("worst"), "root")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gather(batches)
        if table is None:
            return
        center, node, fresh, worst, root = (table.column(i).to_numpy() for i in (0, 1, 2, 4, 5))
        blobs = table.column(3).to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for at in _groups(center):
            if len(at) < 2:
                continue
            m = _unit([blobs[i] for i in at])
            sim = m @ m.T
            ok = (fresh[at][:, None] | fresh[at][None, :]) & (sim > worst[at][:, None]) & (root[at][:, None] != root[at][None, :])
            i, j = np.nonzero(ok)
            if len(i):
                for values, x in zip(out, (node[at][i], node[at][j], sim[i, j]), strict=True):
                    values.append(x)
        if out[0]:
            yield _edges(*out)

    return told.repartition("center").mapInArrow(work, EDGE)


def descend(lists: Saved, nodes: DataFrame, k: int, total: int, inner: DataFrame | None = None) -> Saved:
    """`lists` after rounds of joins, as long as they still change."""
    for _ in range(ROUNDS):
        known = lists.df.withColumn("fresh", F.lit(False))
        better = Saved(keep_best(known.unionByName(join_neighbours(lists.df, nodes, k, inner)), k), "lists")
        lists.drop()
        lists = better
        if lists.df.filter("fresh").count() <= LEAST_CHANGE * total * k:
            break
    return lists


def merged(roots: DataFrame, lists: DataFrame, nodes: DataFrame, least: float, k: int, seed: int) -> DataFrame:
    """`roots` with those components merged that are linked with each other where saturated lists hide it.

    A link is hidden only if the lists of both its ends are full of better ones.  Such nodes look for the best ones
    outside their component; each round merges every component that has a hidden link, until none has.
    """
    full = Saved(lists.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("sim").alias("worst")).filter((F.col("size") >= k) & (F.col("worst") >= least)).select("node"), "saturated")
    while True:
        held = nodes.join(full.df, "node", "left_semi").select("node", "label", "dim", "v").join(roots, "node")
        several = held.groupBy("label", "dim").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("label", "dim")
        open_ = Saved(held.join(several, ["label", "dim"]), "saturated-vectors")
        total = open_.df.count()
        if not total:
            break
        seed += 1
        outer = descend(Saved(keep_best(first_lists(open_.df, k, seed), k), "lists"), open_.df, k, total, lists)
        root = open_.df.select("node", "root")
        hidden = outer.df.filter(F.col("sim") >= least).join(root.withColumnRenamed("root", "a"), "node")
        hidden = hidden.join(root.select(F.col("node").alias("other"), F.col("root").alias("b")), "other")
        tops = components(hidden.select("a", "b"))
        outer.drop()
        open_.drop()
        if tops.isEmpty():
            break
        tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = Saved(roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "components").df
    full.drop()
    return roots


def compared(dealt: DataFrame, least: float) -> DataFrame:
    """(node, links): of rows dealt by (pair), those of side 0 with those of side 1, or all with each other where there is one side."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gather(batches)
        if table is None:
            return
        pair, side, node, copies = (table.column(i).to_numpy() for i in range(4))
        blobs = table.column(4).to_pylist()
        for at in _groups(pair):
            a, b = at[side[at] == 0], at[side[at] == 1]
            p = _unit([blobs[i] for i in a])
            if len(b):
                linked = p @ _unit([blobs[i] for i in b]).T >= least
                sums = [(a, linked @ copies[b]), (b, copies[a] @ linked)]
            else:
                linked = p @ p.T >= least
                np.fill_diagonal(linked, False)
                sums = [(a, linked @ copies[a])]
            for who, n in sums:
                yield pa.RecordBatch.from_arrays([pa.array(node[who]), pa.array(n.astype(np.int64))], names=["node", "links"])

    return dealt.select("pair", "side", "node", "copies", "v").repartition("pair").mapInArrow(work, "node long, links long")


def angled(large: DataFrame) -> DataFrame:
    """Members of large components with `angle`, that to the mean direction of some members of theirs.

    Any direction would do: it decides which blocks are compared, not what is linked.
    """
    placed = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("node"), "node"))
    some = large.select("root", "node", "v").withColumn("place", placed).filter(F.col("place") <= PIVOTS)

    def mean(_, table):
        m = _unit(table.column("v").to_pylist())
        middle = m.sum(axis=0)
        length = float(np.sqrt(middle @ middle))
        return pa.table({"root": table.column("root")[:1], "pivot": pa.array([(middle / length if length > 1e-9 else m[0]).tobytes()], pa.binary())})

    pivots = some.select("root", "v").groupBy("root").applyInArrow(mean, "root long, pivot binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = np.empty(batch.num_rows)
                length = np.array([len(x.as_buffer()) for x in batch.column(3)])
                for at in _groups(length):  # members of one component are of one length
                    m, q = (_unit([batch.column(i)[int(j)].as_py() for j in at]) for i in (3, 4))
                    angle[at] = np.arccos(np.clip(np.einsum("ij,ij->i", m, q), -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(angle)], names=["root", "node", "copies", "v", "angle"])

    return large.select("root", "node", "copies", "v").join(pivots, "root").select("root", "node", "copies", "v", "pivot").mapInArrow(work, "root long, node long, copies long, v binary, angle double")


def block_links(members: DataFrame, least: float) -> DataFrame:
    """(node, links): rows linked to each node within its component.

    A component of one block is compared whole.  Members of a larger one are put in blocks by their angle to one direction.
    By the triangle inequality two members whose angles sum up to no more than the threshold's are linked, and two whose
    angles differ by more are not: whole pairs of blocks are counted or left out so, and only those in between compared.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    placed = members.select("root", "node", "copies", "v").join(sizes.filter("size > 1"), "root")
    found = [compared(placed.filter(F.col("size") <= BLOCK).select(F.col("root").alias("pair"), F.lit(0).alias("side"), "node", "copies", "v"), least)]
    large = placed.filter(F.col("size") > BLOCK)
    if not large.isEmpty():
        edge = math.acos(max(-1.0, min(1.0, least)))
        turned = Saved(angled(large).withColumn("ring", F.floor(F.col("angle") / RING).cast("int")), "linked-angles").df
        rings = turned.groupBy("root", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        parted = Saved(turned.join(rings, ["root", "ring"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts"), "linked-blocks").df
        blocks = Saved(parted.groupBy("root", "ring", "part").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.sum("copies").alias("held")), "block-angles").df
        one = blocks.select("root", *(F.col(c).alias(f"a_{c}") for c in ("ring", "part", "low", "high", "held")))
        two = blocks.select("root", *(F.col(c).alias(f"b_{c}") for c in ("ring", "part", "low", "high", "held")))
        ordered = F.struct("a_ring", "a_part") <= F.struct("b_ring", "b_part")
        near = F.greatest(F.col("b_low") - F.col("a_high"), F.col("a_low") - F.col("b_high")) <= edge + SLACK
        pairs = one.join(two, "root").filter(ordered & near).withColumn("same", (F.col("a_ring") == F.col("b_ring")) & (F.col("a_part") == F.col("b_part")))
        pairs = Saved(pairs.withColumn("sure", F.col("a_high") + F.col("b_high") <= edge - SLACK), "block-pairs").df
        # Blocks that are linked whole: what each is linked to is summed for the block, and given to its members.
        sure = pairs.filter("sure")
        sums = sure.select("root", F.col("a_ring").alias("ring"), F.col("a_part").alias("part"), F.col("b_held").alias("n"), "same")
        sums = sums.unionByName(sure.filter("not same").select("root", F.col("b_ring").alias("ring"), F.col("b_part").alias("part"), F.col("a_held").alias("n"), F.lit(False).alias("same")))
        sums = sums.groupBy("root", "ring", "part").agg(F.sum("n").alias("n"), F.max("same").alias("same"))
        given = parted.join(sums, ["root", "ring", "part"]).select("node", (F.col("n") - F.when(F.col("same"), F.col("copies")).otherwise(0)).alias("links"))
        found.append(given)
        left = pairs.filter("not sure").withColumn("pair", F.xxhash64("root", "a_ring", "a_part", "b_ring", "b_part"))
        sides = [left.select("root", F.col(f"{x}_ring").alias("ring"), F.col(f"{x}_part").alias("part"), "pair", F.lit(i).alias("side")) for i, x in enumerate("ab")]
        dealt = sides[0].unionByName(sides[1].join(left.filter("not same").select("pair"), "pair", "left_semi").select(*sides[0].columns))
        found.append(compared(parted.join(dealt, ["root", "ring", "part"]), least))
    return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.sum("links").alias("links"))


def exact_links(sample: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(node, exact): rows linked to each sampled node, by comparing the sample with all nodes."""
    asked = [(r.node, r.label, np.frombuffer(bytes(r.v), np.float64)) for r in sample.collect()]  # twice AUDITED rows at most
    by: dict[tuple[str, int], list] = {}
    for node, label, v in asked:
        by.setdefault((label, len(v)), []).append((node, _unit([v.tobytes()])[0]))
    sent = nodes.sparkSession.sparkContext.broadcast({k: (np.array([n for n, _ in x]), np.stack([v for _, v in x])) for k, x in by.items()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            node, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            label, blobs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for key, (names, queries) in sent.value.items():
                at = np.array([i for i, (x, v) in enumerate(zip(label, blobs, strict=True)) if (x, len(v) // 8) == key], np.int64)
                if len(at):
                    linked = (queries @ _unit([blobs[i] for i in at]).T >= least) & (names[:, None] != node[at][None, :])
                    for name, n in zip(names.tolist(), (linked @ copies[at]).tolist(), strict=True):
                        found[name] = found.get(name, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["node", "exact"])

    counts = nodes.select("node", "copies", "label", "v").mapInArrow(work, "node long, exact long")
    return counts.groupBy("node").agg(F.sum("exact").alias("exact"))


def samples(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, part): nodes at large, and one node of each component, so that small groups count as much as large ones."""
    at_large = nodes.orderBy(F.xxhash64("node"), "node").limit(AUDITED).select("node", F.lit(0).alias("part"))
    chosen = roots.groupBy("root").agg(F.min_by("node", F.xxhash64("node")).alias("node"))
    return at_large.unionByName(chosen.orderBy(F.xxhash64("root"), "root").limit(AUDITED).select("node", F.lit(1).alias("part")))


def audited(asked: DataFrame, exact: DataFrame, found: DataFrame) -> float | None:
    """Mean share of its exact links that a node has, in the worse of the samples; None if nothing was to find."""
    share = F.coalesce("links", F.lit(0)) / F.col("exact")
    parts = asked.join(exact.filter("exact > 0"), "node").join(found, "node", "left").groupBy("part").agg(F.avg(share).alias("share"))
    return parts.agg(F.min("share")).first()[0]


def link(df: DataFrame, least: float = 0.93, k: int = K, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", seed: int = 11) -> DataFrame:
    """One row per row of `df`: vec_id, n_links, component_id, kept, recall (of the audit; null if nothing was to find)."""
    rows = Saved(rows_of(df, vec_id, label, embedding), "vectors").df
    grouped = rows.filter("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
    nodes = Saved(grouped.withColumn("dim", F.length("v")).withColumn("root", F.col("node")), "vector-nodes").df
    total, widest = nodes.count(), k << DOUBLINGS
    exact = None

    lists = Saved(keep_best(first_lists(nodes, k, seed), k), "lists")
    while True:
        lists = descend(lists, nodes, k, total)
        links = Saved(lists.df.filter(F.col("sim") >= least).select(F.col("node").alias("a"), F.col("other").alias("b")), "links").df
        roots = merged(components(links), lists.df, nodes, least, k, seed)
        members = Saved(nodes.drop("root").join(roots, "node"), "linked-vectors").df
        found = Saved(block_links(members, least), "vector-links").df
        if exact is None:
            asked = Saved(samples(nodes, roots), "audit-nodes").df
            exact = Saved(exact_links(nodes.join(asked, "node", "left_semi").select("node", "label", "v"), nodes, least), "audit").df
        recall = audited(asked, exact, found)
        if recall is None or recall >= RECALL or k >= total:
            break
        if k >= widest:
            raise RuntimeError(f"lists of {k} neighbours find {recall:.3f} of the audited links, less than {RECALL}: pass a larger k")
        k *= 2
        # Old edges count as fresh again, as longer lists have more to join.
        lists = Saved(keep_best(lists.df.withColumn("fresh", F.lit(True)).unionByName(first_lists(nodes, k, seed + k)), k), "lists")
    lowest = members.groupBy("root").agg(F.min("low").alias("first"))
    named = members.select("node", "root").join(lowest, "root").join(found, "node", "left").select("node", "first", "links")
    per_node = Saved(nodes.select("node", "copies", "low").join(named, "node", "left"), "vector-components").df
    out = rows.select("vec_id", "node").join(per_node, "node", "left")
    component = F.coalesce("first", "low", "vec_id")
    return out.select(
        "vec_id",
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        F.lit(recall).cast("double").alias("recall"),
    )

"""Temperature mixing of sources.

Source s with a share q_s of all tokens gets the weight q_s^t / sum.  The exponent t is found by bisection: for a target
entropy of the weights, or as the smallest for which no source is repeated more often than a limit allows.  Where that
takes sums over all sources, each pass has them for SECTIONS exponents at once and keeps the section in which the target
lies.  The weights are then realised under a token budget: source s is read e_s = weight * budget / tokens times, floor(e_s) whole epochs and
one partial epoch.  A keyed hash deals the documents of a source into blocks; each epoch permutes the blocks, and the
partial epoch takes documents in hash order as long as its budget lasts.

All of it is DataFrame expressions.  Sources are rows of a table, at any number.  Where the partial epoch ends is found
from token sums per source and block, then per part of that block, and then among the documents of one part, so no task
holds a source.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and are read in every whole
epoch, and in the partial one by hash order; texts of any length are counted whole; sources without any token get one
epoch; rows that are equal in id and text are dealt alike; other columns stay, and new ones whose names are taken get
leading underscores; an empty table gives an empty mixture; without a budget, it is as large as lets each source be read
once in full.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import WORD, Saved, free_name

#: Bits of the hash that name a block, and those after them that name a part of a block.
BLOCK_BITS, PART_BITS = 12, 16
#: Exponents tried in one pass over the sources, and passes; halvings where no pass is needed.
SECTIONS, PASSES, STEPS = 15, 13, 60
#: Sources whose plan is sent to every task; beyond, it is joined by shuffle.
MAX_SENT = 100_000
KEY_BITS = 63


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def key_of(seed: int, doc_id: Column, text: Column) -> Column:
    """63-bit keyed hash of a document."""
    return F.xxhash64(F.lit(seed), doc_id, text).bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Per exponent t the sums over all sources of q^t and of q^t ln(q^t), in one pass; `shares` has q > 0."""
    each = []
    for i, t in enumerate(exponents):
        raised = F.pow("q", F.lit(t))
        each += [F.sum(raised).alias(f"a{i}"), F.sum(raised * F.lit(t) * F.log("q")).alias(f"b{i}")]
    row = shares.agg(*each).first()
    return [(row[f"a{i}"], row[f"b{i}"]) for i in range(len(exponents))]


def bisect(low: float, high: float, go_up: Callable[[float], bool]) -> float:
    """Where `go_up(t)`, true below some point, turns false: the upper end of the last half."""
    for _ in range(STEPS):
        t = (low + high) / 2
        low, high = (t, high) if go_up(t) else (low, t)
    return high


def exponent_for(shares: DataFrame, span: tuple[float, float], total: int, max_repeats: float | None, target_entropy: float | None, budget: int | None) -> float:
    """The exponent at which the target is met; `span` is the range of q."""
    if target_entropy is None and max_repeats is None:
        return 1.0
    if target_entropy is None and not budget:
        # The most repeated source relative to the least repeated one: the range of the shares tells.
        return bisect(0.0, 1.0, lambda t: (span[1] / span[0]) ** (1 - t) > max_repeats)
    if target_entropy is not None:
        low, high, go_up = 0.0, 16.0, lambda t, a, b: math.log(a) - b / a > target_entropy
    else:
        # At exponent 1 all sources are repeated alike: nothing flatter is needed where even that is too often.
        low, high, go_up = 0.0, 1.0, lambda t, a, b: span[0] ** (t - 1) / a * budget / total > max_repeats
    for _ in range(PASSES):
        tried = [low + (high - low) * i / (SECTIONS + 1) for i in range(1, SECTIONS + 1)]
        low = max([low, *(t for t, (a, b) in zip(tried, sums(shares, tried), strict=True) if go_up(t, a, b))])
        high = min([high, *(t for t in tried if t > low)])
    return high


def weights(totals: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: int | None) -> DataFrame:
    """One row per source: source, tokens, weight, epochs, exponent; `totals` has source and tokens > 0."""
    total, least, most = totals.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not total:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"), F.lit(1.0).alias("exponent"))
    shares, span = totals.withColumn("q", F.col("tokens") / F.lit(float(total))), (least / total, most / total)
    t = exponent_for(shares, span, total, max_repeats, target_entropy, budget)
    z = sums(shares, [t])[0][0]
    spent = float(budget) if budget else total * z / min(q ** (t - 1) for q in span)
    weight = F.pow("q", F.lit(t)) / F.lit(z)
    # Less than a billionth of an epoch is rounding.
    epochs = F.floor(weight * F.lit(spent) / F.col("tokens") * 1e9 + 0.5) / 1e9
    return shares.select("source", "tokens", weight.alias("weight"), epochs.alias("epochs"), F.lit(t).alias("exponent"))


def _edge(sums: DataFrame, place: str, wanted: DataFrame) -> DataFrame:
    """Per source the place (block, part) in which `rest` tokens end: of, edge, left; `sums` has source, place, tokens."""
    before = Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    both = placed.join(wanted, F.col("source").eqNullSafe(F.col("of")))
    # Places without tokens end where they begin: the last of those that `rest` reaches counts.
    reached = both.filter("rest > 0 and before <= rest")
    return reached.groupBy("of").agg(F.max(F.struct(place, (F.col("rest") - F.col("before")).alias("left"))).alias("e")).select("of", F.col(f"e.{place}").alias("edge"), "e.left")


def plan(narrow: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: int | None) -> DataFrame:
    """Per source: source, weight, epochs, whole (epochs) and cut, the largest key that the partial epoch takes (-1: none).

    `narrow` has source, tokens, key.
    """
    block, part = F.shiftright("key", KEY_BITS - BLOCK_BITS), F.shiftright("key", KEY_BITS - BLOCK_BITS - PART_BITS)
    blocks = Saved(narrow.groupBy("source", block.alias("block")).agg(F.sum("tokens").alias("tokens")), "mix-blocks").df
    totals = Saved(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), "mix-totals").df
    some = weights(totals.filter("tokens > 0"), max_repeats, target_entropy, budget)
    none = totals.filter("tokens = 0").select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"), F.lit(None).cast("double").alias("exponent"))
    all_of = some.unionByName(none).withColumn("whole", F.floor("epochs").cast("long"))
    rest = F.floor((F.col("epochs") - F.col("whole")) * F.col("tokens") + 1e-6).cast("long")
    all_of = Saved(all_of.withColumn("rest", rest), "mix-weights").df
    # At most 2^BLOCK_BITS blocks of a source, then 2^PART_BITS parts of one block, then the documents of one part.
    first = _edge(blocks, "block", all_of.select(F.col("source").alias("of"), "rest"))
    inside = narrow.join(first.withColumnRenamed("edge", "block"), F.col("source").eqNullSafe(F.col("of")) & (block == F.col("block")))
    parts = inside.groupBy("source", part.alias("part")).agg(F.sum("tokens").alias("tokens"))
    second = Saved(_edge(parts, "part", first.select("of", F.col("left").alias("rest"))), "mix-parts").df
    # Where nothing is left for the block at all, its first key is the end.
    ends = first.select(F.col("of").alias("at"), (F.shiftleft(F.col("edge"), KEY_BITS - BLOCK_BITS) - 1).alias("start"))
    last = narrow.join(second.withColumnRenamed("edge", "part"), F.col("source").eqNullSafe(F.col("of")) & (part == F.col("part")))
    # Equal keys are taken together.
    running = last.withColumn("sum", F.sum("tokens").over(Window.partitionBy("source", "part").orderBy("key")))
    taken = running.groupBy("of", "part").agg(F.max(F.when(F.col("sum") <= F.col("left"), F.col("key"))).alias("key"))
    cuts = taken.select("of", F.coalesce("key", F.shiftleft(F.col("part"), KEY_BITS - BLOCK_BITS - PART_BITS) - 1).alias("cut"))
    found = ends.join(cuts, F.col("at").eqNullSafe(F.col("of")), "left").select("at", F.coalesce("cut", "start").alias("cut"))
    out = all_of.join(found, F.col("source").eqNullSafe(F.col("at")), "left")
    return Saved(out.select("source", "weight", "epochs", "exponent", "whole", F.coalesce("cut", F.lit(-1).cast("long")).alias("cut")), "mix-plan").df


def mix(df: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None, budget: int | None = None, seed: int = 7, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of `df` for each time that it is read, with _tokens, _epoch, _block, _position (0..1 in the mixture) and _weight."""
    narrow = df.select(F.col(source).alias("source"), token_count(F.col(text)).alias("tokens"), key_of(seed, F.col(doc_id), F.col(text)).alias("key"))
    by = plan(Saved(narrow, "mix-documents").df, max_repeats, target_entropy, budget)
    tokens, key, of, epoch = (free_name(df, c) for c in ("_tokens", "_key", "_of", "_epoch"))
    by = by.select(F.struct(*by.columns).alias(of))
    if len(by.limit(MAX_SENT + 1).collect()) <= MAX_SENT:
        by = F.broadcast(by)
    rows = df.withColumns({tokens: token_count(F.col(text)), key: key_of(seed, F.col(doc_id), F.col(text))})
    joined = rows.join(by, F.col(source).eqNullSafe(F.col(of)["source"]))
    its = F.col(of)
    times = its["whole"] + F.when(F.col(key) <= its["cut"], 1).otherwise(0)
    read = joined.filter(times > 0).withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    # Each epoch permutes a source's blocks by an affine map with an odd factor, and the documents within a block by hash.
    dice = F.xxhash64(F.lit(seed), F.col(epoch), F.col(source))
    block = (F.shiftright(key, KEY_BITS - BLOCK_BITS) * F.shiftleft(F.shiftright(dice, 40), 1).bitwiseOR(F.lit(1)) + F.shiftright(dice, 17)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    within = F.xxhash64(dice, F.col(key)).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    share = F.when(F.col(epoch) > its["whole"], its["epochs"] - its["whole"]).otherwise(F.lit(1.0))
    position = (F.col(epoch) - 1 + (block + within) / float(1 << BLOCK_BITS) * share) / F.greatest(its["epochs"], F.lit(1e-9))
    new = {"_block": block, "_position": position, "_weight": its["weight"]}
    return read.select(*df.columns, tokens, epoch, *(c.alias(free_name(df, n)) for n, c in new.items()))

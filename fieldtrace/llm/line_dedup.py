"""Removal of repeated line runs by a suffix array over line ids.

The lines of all documents that hold a word form one sequence of line ids; suffixes end with their document.  Prefix
doubling ranks them: from the ranks by 2^k lines come the ranks by 2^(k+1), each rank the start of the suffix array's
interval of suffixes that agree so far.  Intervals of one suffix are dropped at every level, as nothing in them repeats.

A run counts if it holds at least `min_words` words, and a line goes if it lies in a run of which a copy stands earlier
(in an earlier document by id, or earlier in the same one).  Such runs are the unions of the shortest qualifying
windows that start at a line or end at a line: any longer run is covered by those inside it.  The suffixes that agree
on a window of L lines are the longest-common-prefix interval of depth L; two ranks of 2^k <= L lines, at the window's
start and 2^k lines before its end, identify it.  All but the first window of an interval are removed, so maximal
repeated runs vanish whole but for their first copy.  Where copies overlap, as in one line repeated many times, a line of
the first copy may lie in a later one as well, and goes with that: of the line in twelve copies one stays.  Doubling ends at `min_words` lines, as each line holds a word.

All of it is DataFrame expressions; joins and aggregates only.  A line or interval that stands in a third of all
documents is pre-aggregated, and its rows meet their rank in SPREAD shares.  Runs of fewer than `min_words` words stay
at any number of copies.  Defined cases: null texts stay null; empty texts stay; lines without a word follow the line
before them; a text of any length is cut into lines whole; rows with equal document id and text are one document, and
each gets its result; a null document id is the smallest; documents whose lines all go keep an empty text; other columns
stay, and new ones whose names are taken get leading underscores; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import WORD, Saved, Scratch, each_spread, free_name, hash128, spread_of, spreads

DOC = ["doc", "a", "b"]


def lines(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One narrow row per line with a word: doc, a, b (key of the document), at (among such lines), first, next, h, g, n."""
    cut = F.split(F.col(text), "\n")

    def line(x: Column, i: Column) -> Column:
        bare = F.btrim(x, F.lit(" \t\r\x0b\x0c"))
        return F.struct(i.alias("no"), F.xxhash64(F.lit(1), bare).alias("h"), F.xxhash64(F.lit(2), bare).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("n"))

    docs = df.select(F.col(doc_id).alias("doc"), hash128(F.col(doc_id), F.col(text)).alias("k"), F.size(cut).alias("size"), F.filter(F.transform(cut, line), lambda x: x["n"] > 0).alias("ls"))
    ls = docs.select("doc", "k.a", "k.b", "size", "ls", F.posexplode("ls").alias("at", "l"))
    return ls.select(*DOC, "at", F.col("l.no").alias("first"), F.coalesce(F.get("ls", F.col("at") + 1)["no"], F.col("size")).alias("next"), "l.h", "l.g", "l.n")


def ranked(classes: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """`classes` (keys, count, shares) with `rank`: the sum of the counts of smaller keys, by a range-partitioned sort."""
    spread = scratch.save(classes.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranks")
    # One row per partition: small even where the corpus is not.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy("part").agg(F.sum("count").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    within = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumn("local", F.coalesce(F.sum("count").over(within), F.lit(0)))
    return local.join(bases.select("part", "base"), "part").select(*keys, "shares", (F.col("base") + F.col("local")).alias("rank"))


def repeated(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Rows whose keys occur more than once, with the rank of their class in place of the keys."""
    rows = rows.withColumn("share", spread_of("a", "b", "at"))
    classes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), spreads(F.col("share")).alias("shares")).filter("count > 1")
    return rows.join(each_spread(ranked(classes, keys, scratch), "shares", "share"), [*keys, "share"]).drop(*keys, "share")


def double(level: DataFrame, step: int, scratch: Scratch) -> DataFrame:
    """Ranks by twice as many lines; pairs of ranks `step` lines apart are sorted and ranked anew."""
    ahead = level.select(*DOC, (F.col("at") - step).alias("at"), F.col("rank").alias("r2"))
    # A null document id is a value like any other.
    pairs = level.withColumnRenamed("rank", "r1").join(ahead.withColumnRenamed("doc", "_doc"), ["a", "b", "at"]).drop("_doc")
    return repeated(pairs.select(*DOC, "at", "r1", "r2"), ["r1", "r2"], scratch)


def windows(rows: DataFrame, min_words: int) -> DataFrame:
    """Shortest windows of `min_words` words that start, or end, at a line: doc, a, b, at, size."""
    by = Window.partitionBy("a", "b")
    runs = rows.withColumn("run", F.col("at") - F.row_number().over(by.orderBy("at")))
    run = Window.partitionBy("a", "b", "run")
    ends = runs.withColumn("end", F.sum("n").over(run.orderBy("at"))).withColumn("start", F.col("end") - F.col("n"))
    ahead = run.orderBy("start").rangeBetween(0, min_words - 1)
    back = run.orderBy("end").rangeBetween(-(min_words - 1), 0)
    sized = ends.select(
        *DOC,
        "at",
        F.when(F.max("end").over(ahead) - F.col("start") >= min_words, F.count(F.lit(1)).over(ahead)).alias("fore"),
        F.when(F.col("end") - F.min("start").over(back) >= min_words, F.count(F.lit(1)).over(back)).alias("aft"),
    )
    both = F.array(F.struct(F.col("at"), F.col("fore").alias("size")), F.struct((F.col("at") - F.col("aft") + 1).cast("int").alias("at"), F.col("aft").alias("size")))
    return sized.select(*DOC, F.explode(F.filter(both, lambda w: w["size"].isNotNull())).alias("w")).select(*DOC, "w.*").distinct()


def removed(df: DataFrame, scratch: Scratch, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document that loses lines: a, b and `gone`, its sorted array of line ranges [from, to)."""
    every = scratch.save(lines(df, doc_id, text), "lines")
    first = scratch.save(repeated(every, ["h", "g"], scratch).dropDuplicates(["a", "b", "at"]), "lines-repeated")
    levels = [first.select(*DOC, "at", "rank")]
    while 1 << len(levels) <= min_words and not levels[-1].isEmpty():
        levels.append(scratch.save(double(levels[-1], 1 << (len(levels) - 1), scratch), "suffix-ranks"))
    ranks = levels[0].withColumn("level", F.lit(0))
    for i, level in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(level.withColumn("level", F.lit(i)))
    ranks = ranks.select("a", "b", "level", "at", "rank")

    level = F.floor(F.log2(F.col("size").cast("double") + 0.5)).cast("int")
    wide = windows(first, min_words).withColumn("level", level).withColumn("tail", (F.col("at") + F.col("size") - F.pow(F.lit(2.0), F.col("level"))).cast("int"))
    known = wide.join(ranks.withColumnRenamed("rank", "r1"), ["a", "b", "level", "at"])
    known = known.join(ranks.select("a", "b", "level", F.col("at").alias("tail"), F.col("rank").alias("r2")), ["a", "b", "level", "tail"])
    place = F.struct(*DOC, "at")
    known = scratch.save(known.select(*DOC, "at", "size", "r1", "r2", spread_of("a", "b", "at").alias("share")), "line-windows")
    interval = ["size", "r1", "r2"]
    origin = known.groupBy(*interval).agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("copies"), spreads(F.col("share")).alias("shares")).filter("copies > 1")
    later = known.join(each_spread(origin, "shares", "share"), [*interval, "share"]).filter(place > F.col("origin"))
    at = later.select("a", "b", F.explode(F.sequence(F.col("at"), (F.col("at") + F.col("size") - 1).cast("int"))).alias("at")).distinct()
    gone = at.join(first.select("a", "b", "at", "first", "next", "n"), ["a", "b", "at"])
    return gone.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("first", "next"))).alias("gone"), F.sum("n").alias("words_gone"))


def dedup(df: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with repeated runs taken out of `text`, and `_lines_removed` and `_words_removed` (under free names)."""
    scratch = Scratch(df.sparkSession)
    gone = Saved(removed(df, scratch, min_words, doc_id, text), "lines-gone").df
    scratch.drop()
    key, x, y, ranges, n_words = (free_name(df, c) for c in ("_key", "_a", "_b", "_gone", "_words_gone"))
    keyed = df.withColumn(key, hash128(F.col(doc_id), F.col(text)))
    gone = gone.withColumnsRenamed({"a": x, "b": y, "gone": ranges, "words_gone": n_words})
    # The same join at every size: a broadcast would not hold for long, and texts move once.
    joined = keyed.join(gone.hint("merge"), (F.col(key)["a"] == F.col(x)) & (F.col(key)["b"] == F.col(y)), "left")
    m = F.size(ranges)
    cut = F.split(F.col(text), "\n")

    def bind(value: Column, f) -> Column:
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def kept(all_lines: Column) -> Column:
        """Slices between the removed ranges: linear in the lines."""

        def between(i: Column) -> Column:
            start = F.when(i > 0, F.get(ranges, i - 1)["next"]).otherwise(F.lit(0))
            stop = F.when(i < m, F.get(ranges, i)["first"]).otherwise(F.size(all_lines))
            return F.slice(all_lines, start + 1, F.greatest(stop - start, F.lit(0)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), m), between)), "\n")

    new = F.when(F.col(ranges).isNull(), F.col(text)).otherwise(bind(cut, kept))
    n_lines = F.coalesce(F.aggregate(ranges, F.lit(0), lambda s, r: s + r["next"] - r["first"]), F.lit(0)).cast("long")
    rest = [F.col(c) if c.lower() != text.lower() else new.alias(c) for c in df.columns]
    return joined.select(*rest, n_lines.alias(free_name(df, "_lines_removed")), F.coalesce(n_words, F.lit(0)).cast("long").alias(free_name(df, "_words_removed")))

"""Groups of spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word of length L is cut into two segments, of L // 2 and L - L // 2 code points.  One edit leaves one of them whole: of
a word of equal length the same segment stands at the same place; of a word one longer the first segment stands at its
start or the second one ends it, shifted by one.  So every word is indexed twice, under length and segment, and probes
twice among its own length and twice among words one shorter.

Segments shared by many words would make many pairs.  Where the pairs below one key exceed PAIRS, its words are cut once
more: they agree in the shared segment, so the edit lies in the rest, and one half of the rest is whole again.  The keys
get longer until their pairs are few or the rest is one code point, where one key holds no more words than the alphabet
squared; so hot segments split by the rule that finds the candidates, and no pair is lost.  Candidates are verified, and
pairs found along several keys are made one.

A word's form is its near word of largest count, if that is `factor` times the word's own; the root is the end of the
forms.  Counts grow along forms by the factor, so that they end.

Defined cases: null and empty texts have no words; a null id reads as an empty one; very long texts are read whole; rows
that are equal count twice; among near words of equal counts the smallest in code-point order is the form; other columns,
whatever their names, are not read; an empty table, or one without frequent words, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import Saved, Scratch, ascii_lower

#: Fixed value: the letters of words.
LETTERS = "A-Za-zÀ-ÿ"
#: Shortest word in code points.
SHORTEST = 6
#: Pairs below one key that are compared at once; keys with more are cut further.
PAIRS = 4096


def runs(docs: DataFrame, drop_one_in: int, id_col: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(word): every maximal run of letters, lower-cased in A-Z; of every `drop_one_in`-th by hash one code point goes."""
    found = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    each = each.select("id", ascii_lower(F.col("run")).alias("run"))
    each = each.select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.pmod("h", F.lit(drop_one_in)) == 0, cut).otherwise(F.col("run"))
    return each.select(word.alias("word")).filter(F.length("word") >= shortest)


def count(words: DataFrame, least: int) -> DataFrame:
    """(word, n) of words that occur `least` times; counted within each task before the shuffle."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _halves(rest: Column, length: Column, shift: Column | int) -> Column:
    """Two (segment number, segment, rest): of a rest that stands against one of `length` code points and is `shift` longer."""
    first = F.floor(length / 2).cast("int")
    last = length - first
    own = length + shift
    return F.array(
        F.struct(F.lit(1).alias("s"), F.substring(rest, F.lit(1), first).alias("seg"), F.substring(rest, first + 1, own).alias("rest")),
        F.struct(F.lit(2).alias("s"), F.substring(rest, own - last + 1, last).alias("seg"), F.substring(rest, F.lit(1), own - last).alias("rest")),
    )


def _cut(rows: DataFrame, key: Column) -> DataFrame:
    """One level further: each row twice, its key lengthened by a segment, its rest shortened by it."""
    part = F.explode(_halves(F.col("rest"), F.col("length"), F.col("shift")))
    keep = [c for c in rows.columns if c not in ("key", "rest", "length")]
    cut = rows.select(*keep, key.alias("key"), "length", part.alias("part"))
    left = F.col("length") - F.length("part.seg")
    return cut.select(*keep, F.concat_ws("|", "key", F.col("part.s").cast("string"), "part.seg").alias("key"), F.col("part.rest").alias("rest"), left.cast("int").alias("length"))


def near(words: DataFrame, scratch: Scratch, pairs: int = PAIRS) -> DataFrame:
    """(word, n, other, m): every pair of words one edit apart, once; `other` is as long as `word`, and greater, or one shorter."""
    size = F.length("word")
    # A word indexes itself as it is, and probes with shift 0 among its own length and shift 1 among words one shorter.
    index = words.select("word", "n", F.lit(0).alias("shift"), F.col("word").alias("rest"), size.alias("length"))
    same = words.select("word", "n", F.lit(0).alias("shift"), F.col("word").alias("rest"), size.alias("length"))
    longer = words.select("word", "n", F.lit(1).alias("shift"), F.col("word").alias("rest"), (size - 1).alias("length"))
    start = F.col("length").cast("string")
    index, probe = _cut(index, start), _cut(same.unionByName(longer), start)
    found: list[DataFrame] = []
    while True:
        index, probe = scratch.save(index, "spelling-index"), scratch.save(probe, "spelling-probe")
        ways = probe.groupBy("key").agg(F.count(F.lit(1)).alias("probes"), F.first("length").alias("left")).join(index.groupBy("key").agg(F.count(F.lit(1)).alias("held")), "key")
        # A key with one indexed word and its own probe alone has no pair.
        ways = scratch.save(ways.select("key", ((F.col("probes") * F.col("held") > pairs) & (F.col("left") > 1)).alias("hot"), (F.col("probes") + F.col("held") > 2).alias("any")).filter("any"), "spelling-keys")
        few = ways.filter(~F.col("hot")).select("key")
        a = probe.join(few, "key", "left_semi").select("key", "shift", F.col("word"), F.col("n"), F.col("rest").alias("x"))
        b = index.join(few, "key", "left_semi").select("key", F.col("word").alias("other"), F.col("n").alias("m"), F.col("rest").alias("y"))
        met = a.join(b, "key").filter((F.col("shift") == 1) | (F.col("word") < F.col("other")))
        found.append(scratch.save(met.filter(F.levenshtein("x", "y", 1) == 1).select("word", "n", "other", "m"), "spelling-pairs"))
        hot = scratch.save(ways.filter("hot").select("key"), "spelling-hot")
        if hot.isEmpty():
            break
        index, probe = (_cut(rows.join(hot, "key", "left_semi"), F.col("key")) for rows in (index, probe))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def group(words: DataFrame, factor: int, pairs: int = PAIRS) -> DataFrame:
    """(word, n) with form, form_n, n_near and root: see the module."""
    scratch = Scratch(words.sparkSession)
    words = scratch.save(words.select("word", "n"), "spelling-words")
    links = scratch.save(near(words, scratch, pairs), "spelling-links")
    both = links.unionByName(links.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("other"))).alias("best"))
    best = best.withColumn("m", -F.col("best.less")).withColumn("form", F.when(F.col("m") >= factor * F.col("n"), F.col("best.other")))
    best = scratch.save(best.select("word", "n_near", "form", F.when(F.col("form").isNotNull(), F.col("m")).alias("form_n")), "spelling-forms")
    # Forms are followed twice as far in each round; a chain's counts grow by the factor, so rounds are few.
    up = scratch.save(best.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = scratch.save(up.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        up = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    out = words.join(best, "word", "left").join(up, "word", "left")
    out = out.select("word", "n", "form", "form_n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.coalesce("root", "word").alias("root"))
    done = Saved(out, "spelling").df
    scratch.drop()
    return done

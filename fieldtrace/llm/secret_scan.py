"""Secret scan with corpus-wide ownership frequency.

Base patterns find assignments, access keys and hexadecimal runs.  Further candidates are credential formats and long
mixed tokens.  Every candidate value is hashed; over the whole corpus the distinct owners and repositories of each hash
are counted.  A value of many owners, or in many repositories, is a copied example; a value that stays with few of both
looks live.  Live-looking further candidates that overlap no base span are added to the spans.

All of it is DataFrame expressions.  Positions are code points, end exclusive.  Defined cases: null and empty texts
have no spans; all rows with a null owner have one owner, the unknown one, and likewise for repositories; texts of any
length are scanned whole; repeated rows get equal results; other columns, whatever their names, are not read; empty
tables give empty results; a value held by a third of all rows is pre-aggregated per owner and repository before it is
counted, and its rows meet the counts in SPREAD shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import Saved, each_spread, hash128, spread_of, spreads

#: Kind -> (pattern, group that holds the value, shortest value), in the order in which spans are listed.
BASE: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
FURTHER: dict[str, tuple[str, int, int]] = {
    "format": (
        r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}"
        r"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
        0,
        16,
    ),
    "mixed": (r"[A-Za-z0-9+/_-]{20,}", 0, 20),
}
#: Owners and repositories that a live value has at most: a credential and its rotation or review copies stay with one or
#: two owners and within a handful of repositories, even where one owner has very many of these.
MOST_OWNERS, MOST_REPOSITORIES = 2, 10
KINDS = [*BASE, *FURTHER]
SPAN = "array<struct<start:int,rank:int,stop:int,value:string>>"


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of the matches whose value has `least` characters: the pieces between matches give the positions."""
    rank = KINDS.index(kind)
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(pieces.alias("gap"), found.alias("match"), values.alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), x["value"].alias("value"))
        out = F.when(F.length(x["value"]) >= least, F.concat(s["out"], F.array(span))).otherwise(s["out"])
        return F.struct(stop.alias("at"), out.cast(SPAN).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(rows, zero, step, lambda s: s["out"])).otherwise(F.array().cast(SPAN))


def mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")


def listed(found: Column) -> Column:
    """kind:start:stop, comma-joined, by start and then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def candidates(rows: DataFrame) -> DataFrame:
    """`rows` (with `text`) with `base` and `more`, the base spans and the further ones that overlap none of them."""
    t = F.coalesce(F.col("text"), F.lit(""))
    found = rows.withColumns({f"of_{k}": spans(t, k, *spec) for k, spec in (BASE | FURTHER).items()})
    found = found.withColumn("base", F.concat(*(F.col(f"of_{k}") for k in BASE)))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    likely = F.filter("of_mixed", lambda x: mixed(x["value"]) & ~F.exists("of_format", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return found.withColumn("more", F.filter(F.concat("of_format", likely), apart))


def ownership(held: DataFrame) -> DataFrame:
    """Owners and repositories of each value, and its shares; `held` has key, owner, repository, share."""
    once = held.groupBy("key", "owner", "repository").agg(spreads(F.col("share")).alias("shares"))
    by_owner = once.groupBy("key", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.bit_or("shares").alias("shares"))
    return by_owner.groupBy("key").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.bit_or("shares").alias("shares"))


def scan(df: DataFrame, owner: str = "source", repository: str = "doc_id", text: str = "text", most_owners: int = MOST_OWNERS, id_col: str = "doc_id", most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """One row for each row of `df`: counts and spans by base patterns, all spans, and how many values look live or copied."""
    named = df.select(F.col(id_col).alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.col(text).alias("text"))
    rows = candidates(named).select(
        "doc_id",
        "owner",
        "repository",
        *(F.size(f"of_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        "base",
        "more",
        F.monotonically_increasing_id().alias("row"),
    )
    rows = Saved(rows, "secret-candidates").df  # text is scanned once; from here on rows are narrow
    held = rows.select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("span"))
    held = held.withColumn("key", hash128(F.col("span.value"))).withColumn("share", spread_of("row"))
    owners = each_spread(ownership(held.select("key", "owner", "repository", "share")), "shares", "share")
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories)
    judged = held.select("row", "key", "share", "span").join(owners, ["key", "share"]).withColumn("live", live)
    added = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("live") & (F.col("span.rank") >= len(BASE)), F.col("span"))).alias("added"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_copied"),
    )
    out = rows.join(added, "row", "left")
    return out.select(
        "doc_id",
        *(f"n_{k}" for k in BASE),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", F.coalesce("added", F.array().cast(SPAN)))).alias("spans"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_live", "n_copied")),
    )

"""Lines of a bundle within a time window on the aligned clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import rules as R
from fieldtrace.schema import DEFAULT_LIMIT, HARD_LIMIT
from fieldtrace.sources.tables import stage

#: Files of a query are metadata rows; up to so many are sent to every task, more are joined by shuffle.
MAX_SENT = 200_000


def aligned_range() -> tuple[Column, Column]:
    """Aligned range of a file: segmented files store it aligned, others raw."""
    shift = F.when(F.col("offset_method") == "segmented", 0.0).otherwise(F.col("clock_offset"))
    return F.col("valid_ts_min") + shift, F.col("valid_ts_max") + shift


def overlapping(files: DataFrame, start: float, end: float, controllers: list[str] | None = None) -> DataFrame:
    """Files whose aligned range meets the window; a file without range or offset does not."""
    low, high = aligned_range()
    out = files.filter((high >= start) & (low <= end))
    return out.filter(F.col("controller").isin(controllers)) if controllers else out


def estimate(files: DataFrame, start: float, end: float, controllers: list[str] | None = None) -> DataFrame:
    """Upper bound of the lines that a query returns, from metadata alone."""
    return overlapping(files, start, end, controllers).agg(F.coalesce(F.sum("line_count"), F.lit(0)).cast("long").alias("estimated_lines"))


def sent(files: DataFrame, key: str = "file_id") -> DataFrame:
    return F.broadcast(files) if files.select(key).limit(MAX_SENT + 1).count() <= MAX_SENT else files


def query(
    lines: DataFrame,
    files: DataFrame,
    start: float,
    end: float,
    controllers: list[str] | None = None,
    slim: bool = False,
    include_unsynced: bool = False,
    segments: DataFrame | None = None,
    limit: int | None = DEFAULT_LIMIT,
    order: str = "file",
) -> DataFrame:
    """Records of the window, by controller, file name and line (or by time), with `truncated` where the limit cut rows.

    Without a limit (None) all come.

    Lines of unsynced ranges and without time are left out; with `include_unsynced` they are kept where the time index
    places them, and files without any offset are appended whole with `clock_unaligned`.  Segments without an offset
    are never returned.
    """
    if end < start:
        raise ValueError("the window ends before it starts")
    if limit is not None and not 1 <= limit <= HARD_LIMIT:
        raise ValueError(f"the limit must lie between 1 and {HARD_LIMIT}")
    if unknown := set(controllers or ()) - {"android", "fota", "kernel", "tbox", "mcu", "ibdu", "unknown"}:
        raise ValueError(f"no such controllers: {sorted(unknown)}")
    meta = ["file_id", "original_name", "clock_offset", "offset_method", "unsynced"]
    plain = sent(overlapping(files, start, end, controllers).filter("offset_method <> 'segmented'").select(*meta))
    own = lines.join(plain, "file_id")
    unsynced = F.exists(F.coalesce("unsynced", F.array().cast("array<struct<start:long,end:long>>")), lambda r: F.col("line_no").between(r["start"], r["end"]))
    own = own.withColumn("aligned_ts", F.when(~unsynced, F.col("raw_ts") + F.col("clock_offset")))
    inside = F.col("aligned_ts").between(start, end)
    if include_unsynced:
        # Undated lines lie in the stretch from the first to the last dated line of the window's index buckets.
        bucket = lambda t: F.floor(t / 300)
        dated = own.filter("aligned_ts is not null")
        target = F.col("clock_offset")
        reach = dated.filter(bucket(F.col("raw_ts")).between(bucket(F.lit(start) - target), bucket(F.lit(end) - target) + 1)).groupBy("file_id").agg(F.min("line_no").alias("_from"), F.max("line_no").alias("_to"))
        own = own.join(sent(reach), "file_id", "left")
        inside = inside | (F.col("aligned_ts").isNull() & F.col("line_no").between(F.col("_from"), F.col("_to")))
    parts = [own.filter(F.coalesce(inside, F.lit(False))).withColumn("clock_unaligned", F.lit(False))]
    if segments is not None:
        seg = segments.filter(F.col("clock_offset").isNotNull()).select("file_id", "line_start", "line_end", F.col("clock_offset").alias("_segment"))
        whole = files.filter("offset_method = 'segmented'")
        whole = whole.filter(F.col("controller").isin(controllers)) if controllers else whole
        named = sent(whole.select("file_id", "original_name").join(seg, "file_id"))
        held = lines.join(named, "file_id").filter("line_no >= line_start and line_no < line_end").withColumn("aligned_ts", F.col("raw_ts") + F.col("_segment"))
        parts.append(held.filter(F.col("aligned_ts").between(start, end)).withColumn("clock_unaligned", F.lit(False)))
    if include_unsynced:
        free = files.filter("clock_offset is null and offset_method <> 'segmented'")
        free = free.filter(F.col("controller").isin(controllers)) if controllers else free
        parts.append(lines.join(sent(free.select("file_id", "original_name")), "file_id").withColumns({"aligned_ts": F.lit(None).cast("double"), "clock_unaligned": F.lit(True)}))
    out = None
    for i, p in enumerate(parts):
        p = p.select("controller", "file_id", "original_name", "aligned_ts", "raw_ts", "line_no", F.col("text").alias("line"), "clock_unaligned", F.lit(i == 2).alias("_last"))
        out = p if out is None else out.unionByName(p)
    if slim:
        out = out.filter(R.slim_keeps(F.col("controller"), F.col("line")))
    keys = ["_last", "controller", "original_name", "file_id", "line_no"] if order == "file" else ["aligned_ts", "controller", "original_name", "line_no"]
    if limit is None:
        return out.orderBy(*keys).drop("_last").withColumn("truncated", F.lit(False))
    return limited(out, keys, limit).drop("_last")


#: Limits up to this many rows are taken in one task, from the best rows of each.
TOP = 10_000


def limited(df: DataFrame, keys: list[str], limit: int, top: int = TOP) -> DataFrame:
    """The first `limit` rows by `keys`; `truncated` says whether there were more.

    Rows are sorted in range partitions and written; the counts of the partitions sum up to the place of the cut, which is
    one number: partition and place within it.  No task holds more than its partition.  Small limits need no sort of all.
    """
    if limit <= top:
        whole = Window.partitionBy(F.lit(0))  # at most `top` and one rows, which the limit has brought together already
        probe = df.orderBy(*keys).limit(limit + 1)
        numbered = probe.withColumns({"_n": F.row_number().over(whole.orderBy(*keys)), "truncated": F.count(F.lit(1)).over(whole) > limit})
        return numbered.filter(F.col("_n") <= limit).drop("_n")
    placed = stage(df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    left, cut = limit, None
    # One row for each partition that has any.
    for part, rows in sorted(map(tuple, placed.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())):
        if cut is None and rows > left:
            cut = (part << 33) + left
        left -= rows
    kept = placed if cut is None else placed.filter(F.col("_at") < cut)
    return kept.orderBy("_at").drop("_at").withColumn("truncated", F.lit(cut is not None))


def events(df: DataFrame, types: list[str] | None = None, controllers: list[str] | None = None, start: float | None = None, end: float | None = None, clock: str = "raw_timestamp") -> DataFrame:
    """Events by type, controller and time, undated last; bounds keep undated events."""
    for column, values in (("event_type", types), ("controller", controllers)):
        if values:
            df = df.filter(F.col(column).isin(values))
    if start is not None:
        df = df.filter(F.col(clock).isNull() | (F.col(clock) >= start))
    if end is not None:
        df = df.filter(F.col(clock).isNull() | (F.col(clock) <= end))
    return df.orderBy(F.asc_nulls_last(clock), "line_no")


def valid_ranges(files: DataFrame) -> DataFrame:
    """Aligned range per controller; a file counts only if both its ends are usable."""
    from fieldtrace.schema import effective

    low, high = aligned_range()
    ends = files.withColumns({"_low": low, "_high": high}).filter(effective(F.col("_low")) & effective(F.col("_high")))
    return ends.groupBy("bundle_id", "controller").agg(F.min("_low").alias("valid_start"), F.max("_high").alias("valid_end"))


def files_of(files: DataFrame, bundle: str) -> DataFrame:
    """Files of a bundle, by controller and name."""
    return files.filter(F.col("bundle_id") == bundle).orderBy("controller", "original_name")


def overall_range(ranges: DataFrame) -> DataFrame:
    """Per bundle the range that covers all its controllers (bundle_id, start, end); null ends do not count."""
    return ranges.groupBy("bundle_id").agg(F.min("valid_start").alias("start"), F.max("valid_end").alias("end"))


def fetch(lines: DataFrame, files: DataFrame, bundle: str, words: list[str], limit: int = DEFAULT_LIMIT, **more) -> DataFrame:
    """Lines of a bundle's whole valid range that hold any of the words, with `shown`: time, controller and text.

    A bundle without a valid range has none; what is shown then is the caller's choice.
    """
    own = files.filter(F.col("bundle_id") == bundle)
    span = overall_range(valid_ranges(own)).first()  # one row
    start, end = (span["start"], span["end"]) if span and span["start"] is not None else (0.0, -1.0)
    if end < start:
        return query(lines.limit(0), own, 0.0, 0.0, limit=limit).withColumn("shown", F.lit(None).cast("string"))
    found = query(lines.filter(F.col("bundle_id") == bundle), own, start, end, limit=limit, **more)
    shown = found.withColumn("shown", F.concat(F.lit("["), F.coalesce(F.col("aligned_ts").cast("string"), F.lit("")), F.lit("]["), "controller", F.lit("] "), "line"))
    return keyword_lines(shown, words, "shown")


def ndjson(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def parse_time(value: str) -> float:
    """Epoch seconds of a number or of an ISO time; a time without zone is UTC."""
    from datetime import UTC, datetime

    try:
        return float(value)
    except ValueError:
        at = datetime.fromisoformat(value.replace("Z", "+00:00"))
        return (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()


def keyword_lines(lines: DataFrame, words: list[str], column: str = "text") -> DataFrame:
    """Lines that hold any of the words, in any case."""
    low = F.lower(column)
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return lines.filter(hit) if words else lines


__all__ = ["aligned_range", "estimate", "events", "fetch", "keyword_lines", "limited", "ndjson", "overall_range", "overlapping", "parse_time", "query", "valid_ranges"]

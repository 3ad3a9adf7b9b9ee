"""What one pass over decoded lines gives: file statistics, time index, unsynced ranges, boot segments, events and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import rules as R
from fieldtrace.functions import text as T
from fieldtrace.functions import timeparse as P
from fieldtrace.operators import scan
from fieldtrace.schema import BUCKET_SECONDS, RAW_LINE_BYTES, effective


def file_stats(lines: DataFrame, by: str = "file_id", ts: str = "raw_ts") -> DataFrame:
    """Lines per file, and the range of all and of usable times."""
    good = F.when(effective(F.col(ts)), F.col(ts))
    return lines.groupBy(by).agg(
        F.count(F.lit(1)).alias("line_count"), F.min(ts).alias("raw_ts_min"), F.max(ts).alias("raw_ts_max"), F.min(good).alias("valid_ts_min"), F.max(good).alias("valid_ts_max")
    )


def bucket_transitions(lines: DataFrame, by: str = "file_id", order: str = "line_no", ts: str = "raw_ts", size: int = scan.BLOCK) -> DataFrame:
    """The first line of each stretch of one five-minute bucket, among lines with a usable time."""
    bucket = F.floor(F.col(ts) / BUCKET_SECONDS).cast("long")
    known = lines.filter(effective(F.col(ts))).withColumn("bucket", bucket)
    return scan.last_seen(known, F.col("bucket"), "_before", [by], [order], size, inclusive=False).filter("_before is null or _before <> bucket").drop("_before")


def runs(lines: DataFrame, bad: Column, by: str = "file_id", order: str = "line_no", size: int = scan.BLOCK) -> DataFrame:
    """Unbroken runs of lines for which `bad` holds, as inclusive ranges."""
    # Good lines count up; a run of bad ones shares the count.
    marked = lines.select(by, order, bad.alias("_bad"))
    numbered = scan.running_sum(marked, F.when(F.col("_bad"), 0).otherwise(1), "_run", [by], [order], size)
    return numbered.filter("_bad").groupBy(by, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("lines")).drop("_run")


def segments(lines: DataFrame, tick: Column, sync: Column, by: str = "file_id", order: str = "line_no", size: int = scan.BLOCK) -> DataFrame:
    """Boot segments: a new one where the tick falls below the last tick before; line spans are half-open.

    Lines without a tick belong to the segment open at their place, leading ones to the first.  The first line that sets
    the clock gives the segment's offset, with confidence 0.95; without one it has none.
    """
    ticked = lines.select(by, order, tick.alias("_tick"), sync.alias("_sync"))
    placed = scan.resets(ticked, "_tick", "seq_no", [by], order, size).withColumn("seq_no", F.col("seq_no").cast("int"))
    out = placed.groupBy(by, "seq_no").agg(
        F.min(order).alias("line_start"),
        (F.max(order) + 1).alias("line_end"),
        F.min("_tick").alias("raw_ts_min"),
        F.max("_tick").alias("raw_ts_max"),
        F.min_by("_sync", F.when(F.col("_sync").isNotNull(), F.col(order))).alias("clock_offset"),
    )
    return out.withColumn("offset_confidence", F.when(F.col("clock_offset").isNotNull(), 0.95).otherwise(0.0))


def mcu_segments(lines: DataFrame) -> DataFrame:
    """Boot segments of MCU files; files without any tick have none."""
    return segments(lines.filter("controller = 'mcu'"), P.mcu_tick(F.col("text")), P.mcu_offset(F.col("text"))).filter("raw_ts_min is not null")


def in_segment(rows: DataFrame, segs: DataFrame, size: int = scan.BLOCK) -> DataFrame:
    """Rows with the segment that holds their line; segments of one file do not overlap."""
    s = segs.select("file_id", "seq_no", "line_start", "line_end", F.col("clock_offset").alias("segment_offset"), F.col("offset_confidence").alias("segment_confidence"))
    return scan.within_ranges(rows, s, "file_id", "line_no", "line_start", "line_end", size)


def rule_events(lines: DataFrame, rules: tuple[R.Rule, ...] = R.EVENT_RULES) -> DataFrame:
    """One event per hit; a line without a time has time 0."""
    hit = lines.filter(F.length("text") > 0).withColumn("_rule", F.explode(R.line_hits(rules, F.col("controller"), F.col("text"))))
    return hit.select(
        "bundle_id",
        "file_id",
        "controller",
        R.rule_names(rules, F.col("_rule")).alias("event_type"),
        F.coalesce("raw_ts", F.lit(0.0)).alias("raw_timestamp"),
        F.lit(None).cast("double").alias("aligned_timestamp"),
        R.rule_confidence(rules, F.col("_rule")).alias("alignment_quality"),
        "line_no",
        T.cut_bytes(F.col("text"), RAW_LINE_BYTES).alias("raw_line"),
        R.rule_fields(rules, F.col("_rule"), F.col("text")).alias("extracted_fields"),
    )


def rule_anchors(lines: DataFrame, rules: tuple[R.Rule, ...] = R.ANCHOR_RULES) -> DataFrame:
    """One anchor per hit."""
    hit = lines.filter(F.length("text") > 0).withColumn("_rule", F.explode(R.line_hits(rules, F.col("controller"), F.col("text"))))
    return hit.select(
        "bundle_id",
        "file_id",
        "controller",
        R.rule_names(rules, F.col("_rule")).alias("anchor_type"),
        F.coalesce("raw_ts", F.lit(0.0)).alias("raw_timestamp"),
        "line_no",
        R.rule_confidence(rules, F.col("_rule")).alias("confidence"),
    )


def boot_sessions(files: DataFrame) -> DataFrame:
    """An event for each boot capture whose offset is known."""
    captures = files.filter(F.col("bundle_relative_path").contains("/kernel_logs/") & F.col("clock_offset").isNotNull() & (F.col("offset_method") == "filename_anchor"))
    return captures.select(
        "bundle_id",
        "file_id",
        "controller",
        F.lit("boot_session").alias("event_type"),
        F.lit(0.0).alias("raw_timestamp"),
        F.col("clock_offset").alias("aligned_timestamp"),
        F.lit(0.99).alias("alignment_quality"),
        F.lit(0).cast("long").alias("line_no"),
        F.col("original_name").alias("raw_line"),
        F.create_map().cast("map<string,string>").alias("extracted_fields"),
    )


def backfill(events: DataFrame, files: DataFrame, segs: DataFrame) -> DataFrame:
    """Aligned times of events in files whose clock is known: by file with quality 0.99, by segment with the segment's."""
    known = files.filter(F.col("offset_method").isin("filename_anchor", "clock_sync") & F.col("clock_offset").isNotNull()).select("file_id", F.col("clock_offset").alias("_offset"))
    both = in_segment(events.join(known, "file_id", "left"), segs)
    aligned = F.coalesce("aligned_timestamp", F.col("raw_timestamp") + F.col("_offset"), F.col("raw_timestamp") + F.col("segment_offset"))
    quality = F.when(F.col("aligned_timestamp").isNotNull(), F.col("alignment_quality")).when(F.col("_offset").isNotNull(), 0.99).when(F.col("segment_offset").isNotNull(), F.col("segment_confidence")).otherwise(F.col("alignment_quality"))
    return both.withColumns({"alignment_quality": quality, "aligned_timestamp": aligned}).select(*events.columns)


def suspected_crashes(sessions: DataFrame, files: DataFrame, capture: float = 90.0, gap: float = 300.0, by: str = "bundle_id", ts: str = "aligned_timestamp") -> DataFrame:
    """Boots whose capture is short and whose next boot follows soon."""
    dated = sessions.filter(F.col(ts).isNotNull()).withColumn("next_boot", F.lead(ts).over(Window.partitionBy(by).orderBy(ts)))
    ended = dated.join(files.select("file_id", F.col("raw_ts_max").alias("capture_seconds")), "file_id")
    return ended.filter((F.col("capture_seconds") < capture) & (F.col("next_boot") - F.col(ts) < gap))


def forward_filled(lines: DataFrame, by: str, order: str, ts: str, size: int = scan.BLOCK) -> DataFrame:
    """`lines` with `filled`: the last time seen up to each line."""
    return scan.last_seen(lines, F.col(ts), "filled", [by], [order], size)


def counters(files: DataFrame, events: DataFrame, anchors: DataFrame, index: DataFrame) -> DataFrame:
    """Per bundle: events, anchors, files with an index, files with unsynced ranges, and files that gave no lines."""
    indexed = index.select("file_id").distinct().withColumn("_indexed", F.lit(1))
    none = F.coalesce(F.col("line_count"), F.lit(0)) == 0
    whole = files.join(indexed, "file_id", "left").groupBy("bundle_id").agg(
        F.count("_indexed").alias("indexed_files"), F.count(F.when(F.size(F.coalesce("unsynced", F.array())) > 0, 1)).alias("unsynced_files"), F.count(F.when(none, 1)).alias("skipped")
    )
    per = lambda df, name: df.groupBy("bundle_id").agg(F.count(F.lit(1)).alias(name))
    out = whole.join(per(events, "events"), "bundle_id", "left").join(per(anchors, "anchors"), "bundle_id", "left")
    return out.select("bundle_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("events", "anchors", "indexed_files", "unsynced_files", "skipped")))


def controllers_present(files: DataFrame) -> DataFrame:
    """(bundle_id, controller) of all known controllers."""
    return files.filter("controller <> 'unknown'").select("bundle_id", "controller").distinct()


def clip(lines: DataFrame, fault: float, before: float = 60.0, after: float = 30.0, most: int = 500, by: str = "file_id", order: str = "line_no", ts: str = "raw_ts", size: int = scan.BLOCK) -> DataFrame:
    """Lines of each file around a fault; all its lines, with `fallback`, if none is there.  At most `most` of each file."""
    near = F.col("filled").between(fault - before, fault + after)
    return scan.first_rows(forward_filled(lines, by, order, ts, size), most, [by], order, size, near, "fallback").orderBy(by, order)


def merged_ranges(ranges: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Union of inclusive ranges that overlap or touch."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    isle = ranges.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_isle", F.sum("_new").over(w))
    return isle.groupBy(by, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_isle")

"""A bundle from archive to aligned events; each stage is written, so that a later one neither plans nor computes it again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.functions import rules as R
from fieldtrace.functions import timeparse as P
from fieldtrace.operators import align, prescan
from fieldtrace.operators.range_query import sent
from fieldtrace.operators.services import first_seen
from fieldtrace.plans.audit import Audit
from fieldtrace.schema import effective
from fieldtrace.sources import archives
from fieldtrace.sources import lines as L
from fieldtrace.sources.tables import shared_path, stage
from fieldtrace.sources.versions import Tables


@dataclass(frozen=True)
class Bundle:
    files: DataFrame
    lines: DataFrame
    segments: DataFrame
    events: DataFrame
    anchors: DataFrame
    index: DataFrame
    summary: DataFrame


def store(bundle: Bundle, folder: str, note: tuple[str, int] | None = None) -> int:
    """A bundle's tables below `folder` as one new version; storing a bundle again replaces its own rows and no others."""
    own = bundle.files.select("file_id", "bundle_id")
    named = {name: getattr(bundle, name) for name in ("events", "anchors", "files")}
    named |= {name: getattr(bundle, name).join(own, "file_id") for name in ("segments", "index")}
    keys = [r.bundle_id for r in own.select("bundle_id").distinct().toLocalIterator()]
    return Tables(bundle.files.sparkSession, folder).replace(named | {"alignment": bundle.summary}, keys, note)


def ingest(
    spark: SparkSession,
    paths: list[str] | str,
    extra_names: dict[str, tuple[str, ...]] | None = None,
    store_at: str | None = None,
    decoders: tuple[L.Decoder, ...] = L.DECODERS,
    split: int = L.SPLIT,
    file_rules: tuple[R.FileRule, ...] = R.FILE_RULES,
    audit: Audit | None = None,
) -> Bundle:
    """`extra_names` adds file names by controller to the rules that classify files; members are kept below `store_at`."""
    audit = audit or Audit(spark, "ingest")
    with audit.stage("extract"):
        members = stage(audit.counted("extract", archives.extract(spark, paths, store_at or shared_path(spark, "members")), members=F.count(F.lit(1)), bytes=F.sum("size_bytes")), "extracted")
    with audit.stage("classify"):
        first = first_seen(members.withColumn("_key", F.struct("bundle_id", "sha256")), F.col("_key"), "seq").drop("_key")
        kind = R.classify(F.col("bundle_relative_path"), F.col("original_name"), F.col("head"), file_rules, extra_names)
        placed = first.withColumn("controller", kind).withColumn("modified", F.lit(None).cast("timestamp"))
        placed = stage(audit.counted("classify", placed, files=F.count(F.lit(1)), unknown=F.count_if(F.col("controller") == "unknown")), "members")
    with audit.stage("decode"):
        lines = stage(audit.counted("decode", L.decode(placed, decoders, split), lines=F.count(F.lit(1))), "lines")
    return derive(placed.drop("head"), lines, audit)


def derive(files: DataFrame, lines: DataFrame, audit: Audit | None = None) -> Bundle:
    """Everything that follows from decoded lines."""
    audit = audit or Audit(files.sparkSession, "derive")
    rows = F.count(F.lit(1))
    with audit.stage("prescan"):
        segs = stage(prescan.mcu_segments(lines), "segments")
        known = stage(align.file_offsets(files.join(prescan.file_stats(lines), "file_id", "left"), segs), "offsets")
        # Times and places alone: texts are not written again.
        placed = lines.select("file_id", "line_no", "byte_offset", "raw_ts").join(sent(known.select("file_id", F.col("clock_offset").alias("_offset"), "offset_method")), "file_id")
        timed = prescan.in_segment(placed, segs)
        preset = F.col("offset_method").isin("filename_anchor", "clock_sync")
        wall = F.when(F.col("offset_method") == "segmented", F.col("raw_ts") + F.col("segment_offset")).when(preset, F.col("raw_ts") + F.col("_offset")).otherwise(F.col("raw_ts"))
        timed = stage(timed.withColumn("_wall", wall), "timed")
        good = effective(F.col("_wall"))
        stored = F.when(F.col("offset_method") == "segmented", F.col("_wall")).otherwise(F.col("raw_ts"))
        ranges = timed.groupBy("file_id").agg(F.min(F.when(good, stored)).alias("valid_ts_min"), F.max(F.when(good, stored)).alias("valid_ts_max"))
        islands = prescan.runs(timed, ~good).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("unsynced"))
        known = known.drop("valid_ts_min", "valid_ts_max").join(ranges, "file_id", "left").join(islands, "file_id", "left")
        # A file has index rows where it is not segmented and a line has a usable time.
        indexed = (F.col("offset_method") != "segmented") & F.col("valid_ts_min").isNotNull()
        counts = {"indexed_files": F.count_if(indexed), "unsynced_files": F.count_if(F.size(F.coalesce("unsynced", F.array())) > 0), "skipped": F.count_if(F.coalesce("line_count", F.lit(0)) == 0)}
        known = stage(audit.counted("prescan", known, **counts), "ranges")
        index = prescan.bucket_transitions(timed.filter("offset_method <> 'segmented'").withColumn("raw_ts", F.when(good, F.col("raw_ts"))))
        anchors = stage(audit.counted("prescan", prescan.rule_anchors(lines), anchors=rows), "anchors")
        found_events = stage(audit.counted("prescan", prescan.rule_events(lines), events=rows), "found")
    with audit.stage("align"):
        found = stage(align.align(anchors, files.select("bundle_id", "controller").distinct()), "alignment")
        final = align.apply_offsets(known, found)
        sync = F.regexp_extract(F.col("text"), P.MCU_SYNC, 0) != ""
        final = align.refine_unsynced(final, lines, sync | F.lower("text").rlike("rtc set hw|time sync|gps time|ntp sync|clock sync") & F.col("controller").isin("mcu", "kernel"))
        final = stage(final, "files")
        events = stage(prescan.backfill(found_events.unionByName(prescan.boot_sessions(final)), final, segs), "events")
        crashes = prescan.suspected_crashes(events.filter("event_type = 'boot_session'"), final)
        crashes = crashes.withColumn("event_type", F.lit("system_crash_suspected")).select(*events.columns)
    audit.flush()
    return Bundle(final, lines, segs, events.unionByName(crashes), anchors, index.select("file_id", "bucket", "byte_offset", "line_no"), align.summary(found))

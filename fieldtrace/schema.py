"""Schemas and constants of the log tables, and the predicate for usable wall-clock times.

Times are epoch seconds as double.  Boot-relative clocks (kernel ring buffer, MCU ticks) share the column, so it cannot be a timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = "struct<seq_no:int,line_start:long,line_end:long,raw_ts_min:double,raw_ts_max:double,clock_offset:double,offset_confidence:double>"
LINES = "bundle_id string, file_id string, controller string, line_no long, byte_offset long, raw_ts double, text string"
FILES = (
    "bundle_id string, file_id string, controller string, original_name string, bundle_relative_path string, sha256 string, size_bytes long, "
    "line_count long, raw_ts_min double, raw_ts_max double, valid_ts_min double, valid_ts_max double, clock_offset double, "
    f"offset_confidence double, offset_method string, unsynced array<struct<start:long,end:long>>, segments array<{SEGMENT}>"
)
EVENTS = (
    "bundle_id string, file_id string, controller string, event_type string, raw_timestamp double, aligned_timestamp double, "
    "alignment_quality double, line_no long, raw_line string, extracted_fields map<string,string>"
)
ANCHORS = "bundle_id string, file_id string, controller string, anchor_type string, raw_timestamp double, line_no long, confidence double"

CONTROLLERS = ("android", "fota", "kernel", "tbox", "mcu", "ibdu", "unknown")
#: 2020-01-01T00:00:00Z; clocks that lost their battery restart on this day.
SENTINEL_DAY = 1577836800
BUCKET_SECONDS = 300
MAX_OFFSET = 30 * 86400.0
RAW_LINE_BYTES = 4096
DEFAULT_LIMIT, HARD_LIMIT = 1_000_000, 5_000_000


def effective(ts: Column) -> Column:
    """Whether a time is a usable wall-clock time: present, and after the sentinel day."""
    return F.coalesce(ts >= SENTINEL_DAY + 86400, F.lit(False))


def epoch(ts: Column) -> Column:
    """Epoch seconds of a timestamp with or without zone (session zone UTC)."""
    return ts.cast("timestamp").cast("double")

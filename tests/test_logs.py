"""Log operators on small cases with known answers."""

from __future__ import annotations

import hashlib
import io
import random
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldtrace.functions import rules as R
from fieldtrace.functions import text as T
from fieldtrace.functions import timeparse as P
from fieldtrace.operators import align, prescan, services
from fieldtrace.operators import range_query as Q
from fieldtrace.plans import ingest
from fieldtrace.schema import ANCHORS, FILES, LINES
from fieldtrace.sources import archives, tables
from fieldtrace.sources import lines as L

T0 = 1710000000.0


def lines(spark, rows):
    return spark.createDataFrame(rows, LINES)


def files(spark, *rows):
    full = []
    for r in rows:
        base = dict(bundle_id="b", file_id="f", controller="android", original_name="a.log", bundle_relative_path="a.log", sha256="", size_bytes=0, line_count=0, raw_ts_min=None, raw_ts_max=None, valid_ts_min=None, valid_ts_max=None, clock_offset=0.0, offset_confidence=1.0, offset_method="direct", unsynced=None, segments=None)
        full.append(tuple((base | r).values()))
    return spark.createDataFrame(full, FILES)


def log(spark, n, file_id="f", controller="android", text="x"):
    return lines(spark, [("b", file_id, controller, i, i * 10, T0 + i, f"{text} {i}") for i in range(n)])


def one(spark, column, text="", **more):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first().v


def test_window_is_inclusive(spark):
    f = files(spark, dict(valid_ts_min=T0, valid_ts_max=T0 + 19, line_count=20))
    got = Q.query(log(spark, 20), f, T0 + 5, T0 + 10).collect()
    assert [r.line_no for r in got] == [5, 6, 7, 8, 9, 10] and not got[0].truncated


def test_offset_moves_lines(spark):
    f = files(spark, dict(valid_ts_min=T0, valid_ts_max=T0 + 19, clock_offset=100.0))
    got = Q.query(log(spark, 20), f, T0 + 103, T0 + 105).collect()
    assert [r.line_no for r in got] == [3, 4, 5] and got[0].aligned_ts == T0 + 103


def test_limit_says_so(spark):
    f = files(spark, dict(valid_ts_min=T0, valid_ts_max=T0 + 49))
    got = Q.query(log(spark, 50), f, T0, T0 + 100, limit=10).collect()
    assert len(got) == 10 and all(r.truncated for r in got)
    with pytest.raises(ValueError):
        Q.query(log(spark, 1), f, T0, T0 - 1)
    with pytest.raises(ValueError):
        Q.query(log(spark, 1), f, T0, T0, limit=0)


def test_estimate(spark):
    f = files(spark, dict(valid_ts_min=T0, valid_ts_max=T0 + 41, line_count=42))
    assert Q.estimate(f, T0 + 1, T0 + 2).first()[0] == 42
    assert Q.estimate(f, T0 + 9000, T0 + 9001).first()[0] == 0


def test_unsynced_lines_and_free_files(spark):
    rows = [("b", "f", "android", 0, 0, None, "cont"), ("b", "f", "android", 1, 5, T0, "a"), ("b", "f", "android", 2, 9, None, "stack"), ("b", "f", "android", 3, 12, T0 + 1, "b"), ("b", "g", "kernel", 0, 0, 5.0, "boot")]
    f = files(spark, dict(valid_ts_min=T0, valid_ts_max=T0 + 1, unsynced=[(0, 0), (2, 2)]), dict(file_id="g", controller="kernel", original_name="k.log", clock_offset=None, offset_method="none"))
    assert [r.line_no for r in Q.query(lines(spark, rows), f, T0, T0 + 1).collect()] == [1, 3]
    got = Q.query(lines(spark, rows), f, T0, T0 + 1, include_unsynced=True).collect()
    assert [(r.file_id, r.line_no, r.clock_unaligned) for r in got] == [("f", 1, False), ("f", 2, False), ("f", 3, False), ("g", 0, True)]


def test_segmented_files(spark):
    rows = [("b", "m", "mcu", i, 0, float(i), "t") for i in range(6)]
    f = files(spark, dict(file_id="m", controller="mcu", original_name="m", clock_offset=None, offset_method="segmented", valid_ts_min=T0, valid_ts_max=T0 + 9))
    segs = spark.createDataFrame([("m", 0, 3, T0), ("m", 3, 6, None)], "file_id string, line_start long, line_end long, clock_offset double")
    assert [r.line_no for r in Q.query(lines(spark, rows), f, T0 + 1, T0 + 100, segments=segs).collect()] == [1, 2]


def test_slim_precedence(spark):
    rows = [("tbox", "heartbeat fine"), ("tbox", "heartbeat PANIC now"), ("android", "heartbeat fine"), ("kernel", "audit: x")]
    got = spark.createDataFrame(rows, "c string, t string").select(R.slim_keeps(F.col("c"), F.col("t")).alias("k")).collect()
    assert [r.k for r in got] == [False, True, True, False]


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (lambda: P.logcat(F.col("text"), F.lit(2024)), "03-01 10:00:00.123456  12  34 I Tag: m", 1709287200.123456),
        (lambda: P.logcat(F.col("text"), F.lit(2024)), "02-30 10:00:00.123  12  34 I Tag: m", None),
        (lambda: P.logcat(F.col("text"), F.lit(2024)), "no time", None),
        (lambda: P.fota(F.col("text")), "2024-03-01 10:00:00,250 INFO x", 1709287200.25),
        (lambda: P.generic(F.col("text")), "[x] 2024-03-01T10:00:00.5 y", 1709287200.5),
        (lambda: P.generic(F.col("text")), "2024-03-01 10:00:00 y", 1709287200.0),
        (lambda: P.dmesg(F.col("text")), "[   12.345678] m", 12.345678),
        (lambda: P.dmesg(F.col("text")), "[   12.5] m", 12.000005),
        (lambda: P.decoded(F.col("text")), "2024-03-01T10:00:00.000001 E A C t", 1709287200.000001),
        (lambda: P.decoded(F.col("text")), "2024-03-01T25:00:00.000001 E", None),
        (lambda: P.ibdu(F.col("text")), "[2024.03.01 10:00:00.125]AABB", 1709287200.125),
        (lambda: P.mcu_tick(F.col("text")), "&1500 INF@MOD : m", 1.5),
        (lambda: P.mcu_offset(F.col("text")), "&1000 INF@SYS : Set Date By Second: 100, x", 1577836800 + 99.0),
        (lambda: P.boot_file(F.col("text")), "3_2024-03-01_10-00-00.log", 1709287200.0),
        (lambda: P.boot_file(F.col("text")), "3_2020-01-01_10-00-00.log", None),
        (lambda: P.dump_file(F.col("text")), "kernel@2024-03-01_10-00-00.2.log", 1709287200.0),
    ],
)
def test_times(spark, column, text, want):
    got = one(spark, column(), text)
    assert got is None if want is None else got == pytest.approx(want, abs=1e-6)


def test_rules_take_text_leftmost_first(spark):
    rows = [("b", "f", "tbox", 0, 0, T0, "UNLOCK_OK then LOCK_OK"), ("b", "f", "mcu", 1, 0, None, "GEAR -> D"), ("b", "f", "kernel", 2, 0, 7.0, "system reboot reason=watchdog now"), ("b", "f", "fota", 3, 0, T0, "FotaDownloadCenter start"), ("b", "f", "kernel", 4, 0, 7.0, "UNLOCK_OK")]
    got = prescan.rule_events(lines(spark, rows)).collect()
    assert [(r.line_no, r.event_type) for r in sorted(got, key=lambda r: r.line_no)] == [(0, "vehicle_unlock"), (0, "vehicle_lock"), (1, "gear_shift"), (2, "system_reboot"), (2, "kernel_watchdog"), (3, "fota_download_start")]
    by = {(r.line_no, r.event_type): r for r in got}
    assert by[2, "system_reboot"].extracted_fields == {"reason": "watchdog"} and by[1, "gear_shift"].extracted_fields == {"gear": "D"}
    assert by[1, "gear_shift"].raw_timestamp == 0.0
    anchors = prescan.rule_anchors(lines(spark, rows)).collect()
    assert sorted((r.anchor_type, r.confidence) for r in anchors) == [("fota_download_start", 0.95), ("system_reboot", 0.9)]


def test_long_line_is_cut(spark):
    rows = [("b", "f", "kernel", 0, 0, T0, "reboot " + "é" * 4000)]
    assert len(prescan.rule_events(lines(spark, rows)).first().raw_line.encode()) <= 4096


def test_bucket_transitions(spark):
    edge = 1710000000.0 - 1710000000.0 % 300
    rows = [("b", "f", "android", i, 0, edge + t, "") for i, t in enumerate((0, 30, 299, 300, 599, 600))]
    assert [r.line_no for r in prescan.bucket_transitions(lines(spark, rows)).orderBy("line_no").collect()] == [0, 3, 5]


def test_runs_and_ranges(spark):
    rows = [("b", "f", "android", i, 0, t, "") for i, t in enumerate((None, None, None, T0, None, T0, None))]
    bad = F.col("raw_ts").isNull()
    assert sorted((r.start, r.end) for r in prescan.runs(lines(spark, rows), bad).collect()) == [(0, 2), (4, 4), (6, 6)]
    ranges = spark.createDataFrame([("f", 0, 4), ("f", 3, 8), ("f", 15, 20), ("f", 21, 25)], "f string, s int, e int")
    assert sorted((r.s, r.e) for r in prescan.merged_ranges(ranges, "f", "s", "e").collect()) == [(0, 8), (15, 20), (21, 25)]


def test_boot_segments_match_a_walk(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for f in ("m1", "m2"):
        tick, seg, last = 0, 0, None
        for i in range(60):
            kind = rng.random()
            tick = 0 if kind < 0.08 else tick + rng.randint(1, 50)
            text = "undated" if kind > 0.85 else f"&{tick} INF@SYS : Set Date By Second: {1000 + i}, x" if kind > 0.75 else f"&{tick} INF@MOD : m"
            if text != "undated":
                if last is not None and tick < last:
                    seg += 1
                last = tick
            s = want.setdefault((f, seg), [i, i + 1, None])
            s[1] = i + 1
            if s[2] is None and "Set Date" in text:
                s[2] = 1577836800 + 1000 + i - tick / 1000
            rows.append(("b", f, "mcu", i, 0, None, text))
    got = {(r.file_id, r.seq_no): [r.line_start, r.line_end, r.clock_offset] for r in prescan.mcu_segments(lines(spark, rows)).collect()}
    assert got == want


def test_greedy_pairs(spark):
    def pairs(source, base):
        s = spark.createDataFrame([("b", "m", "x", t, 0.9) for t in source], "bundle_id string, controller string, anchor_type string, raw_timestamp double, confidence double")
        b = spark.createDataFrame([("b", "x", t, 0.9) for t in base], "bundle_id string, anchor_type string, raw_timestamp double, confidence double")
        return sorted((r.source_ts, r.base_ts) for r in align.anchor_pairs(s, b, (60.0,)).collect())

    assert pairs([0.0, 1.0, 100.0], [0.4, 50.0]) == [(0.0, 0.4), (1.0, 50.0)]
    assert pairs([10.0], [5.0, 15.0]) == [(10.0, 5.0)]


def anchor(controller, kind, ts, confidence=0.9):
    return ("b", controller, controller, kind, ts, 0, confidence)


def aligned(spark, rows, present=None):
    a = spark.createDataFrame(rows, "bundle_id string, file_id string, controller string, anchor_type string, raw_timestamp double, line_no long, confidence double")
    p = spark.createDataFrame([("b", c) for c in (present or {r[2] for r in rows})], "bundle_id string, controller string")
    return {r.controller: r for r in align.align(a, p).collect()}


def test_alignment(spark):
    got = aligned(spark, [anchor("tbox", "system_boot", T0 + i * 5000) for i in range(3)] + [anchor("android", "system_boot", T0 + i * 5000 - 5) for i in range(3)])
    assert got["android"].offset == pytest.approx(5.0) and (got["android"].n, got["android"].status, got["tbox"].offset) == (3, "success", 0.0) and got["android"].confidence >= 0.85
    sparse = aligned(spark, [anchor("tbox", "system_boot", T0 + i * 5000) for i in range(2)] + [anchor("fota", "system_boot", T0 + i * 5000 - 200) for i in range(2)])
    assert sparse["fota"].offset == pytest.approx(200.0) and sparse["fota"].n == 2
    far = aligned(spark, [anchor("tbox", "system_boot", T0), anchor("fota", "system_boot", T0 - 100 * 86400)])
    assert far["fota"].offset is None and far["fota"].n == 0
    degraded = aligned(spark, [anchor("android", "system_boot", T0 + i * 5000) for i in range(3)] + [anchor("fota", "system_boot", T0 + i * 5000 - 1) for i in range(3)])
    assert degraded["fota"].base == "android" and degraded["fota"].status == "partial"
    hop = aligned(spark, [anchor("tbox", "system_boot", T0 + i * 5000) for i in range(3)] + [anchor("android", "system_boot", T0 + i * 5000 - 1) for i in range(3)] + [anchor("android", "fota_install_start", T0 + i * 5000 + 900) for i in range(3)] + [anchor("fota", "fota_install_start", T0 + i * 5000 + 890) for i in range(3)])
    assert hop["fota"].method == "two_hop" and hop["fota"].offset == pytest.approx(11.0)
    assert aligned(spark, [anchor("fota", "system_boot", T0)])["fota"].status == "failed"


def test_crash_pairs(spark):
    s = spark.createDataFrame([("b", "f1", 100.0), ("b", "f2", 300.0), ("b", "f3", 900.0)], "bundle_id string, file_id string, aligned_timestamp double")
    f = spark.createDataFrame([("f1", 50.0), ("f2", 50.0), ("f3", 50.0)], "file_id string, raw_ts_max double")
    assert [r.file_id for r in prescan.suspected_crashes(s, f).collect()] == ["f1"]


def dlt(seconds, micros, payload):
    body = b"ECU1" + b"\x01\x00APP1CTX1" + payload
    head = struct.pack(">BBH", 0x05, 0, 4 + len(body))
    return b"DLT\x01" + struct.pack("<Ii", seconds, micros) + b"ECU0" + head + body


def test_text_and_trace_lines():
    assert list(L.text_lines(b"\xef\xbb\xbfa\r\nb\xff\n\nc")) == [(0, 3, "a"), (1, 6, "b�"), (2, 9, ""), (3, 10, "c")]
    got = list(L.dlt_messages(dlt(10, 5, b"hello") + b"junk" + dlt(11, -1, b"\x00world")))
    assert [(g[0], g[2], g[3], g[4], g[5]) for g in got] == [(0, 10.000005, "ECU1", "APP1", "CTX1"), (1, 11.0, "ECU1", "APP1", "CTX1")]


def test_glob_and_classes(spark):
    assert R.glob("**/tbox/**") == "^.*tbox/.*$" and R.glob("*.dlt") == r"^[^/]*\.dlt$"
    rows = [("x/mcu/a.txt", "a.txt", b""), ("x/y", "kernel_1.log", b""), ("x/y", "z", b"[   1.5] m"), ("x/y", "z", b"DLT\x01"), ("x/y", "z", b"?")]
    df = spark.createDataFrame(rows, "p string, n string, h binary")
    assert [r.c for r in df.select(R.classify(F.col("p"), F.col("n"), F.col("h")).alias("c")).collect()] == ["mcu", "kernel", "kernel", "tbox", "unknown"]


def test_bundle_end_to_end(spark, tmp_path):
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:gz") as t:
        data = b"".join(b"2024-03-01 10:00:%02d.000 system started\n" % i for i in range(3))
        info = tarfile.TarInfo("tbox/tbox1.log")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("logs/in.tar.gz", inner.getvalue())
        z.writestr("android/main_2024-03-01.log", "".join(f"03-01 09:59:{50 + i}.000  1  2 I T: system started\n" for i in range(3)))
        z.writestr("android/copy_2024-03-01.log", "".join(f"03-01 09:59:{50 + i}.000  1  2 I T: system started\n" for i in range(3)))
        z.writestr("__MACOSX/x", "no")
        z.writestr("mcu/mcu1.log", "&100 INF@SYS : Set Date By Second: 131680000, x\n&200 INF@A : GEAR -> D\n&50 INF@A : x\n")
    b = ingest.ingest(spark, str(tmp_path / "b.zip"))
    kinds = {r.original_name: r for r in b.files.collect()}
    assert set(kinds) == {"tbox1.log", "main_2024-03-01.log", "mcu1.log"}
    assert kinds["tbox1.log"].offset_method == "clock_sync" and kinds["main_2024-03-01.log"].clock_offset == pytest.approx(10.0)
    assert kinds["mcu1.log"].offset_method == "segmented"
    gear = b.events.filter("event_type = 'gear_shift'").first()
    assert gear.aligned_timestamp == pytest.approx(1577836800 + 131680000 + 0.1) and gear.extracted_fields["gear"] == "D"
    got = Q.query(b.lines, b.files, 1709287200.0, 1709287201.0, segments=b.segments).collect()
    assert sorted((r.controller, r.line_no) for r in got) == [("android", 0), ("android", 1), ("tbox", 0), ("tbox", 1)]
    # Every controller present is a target, and mcu, whose clock is placed by its own segments, gets no offset: half of two.
    assert b.summary.first().status == "partial"


def test_archive_names():
    assert archives.member_name("日志".encode("gbk").decode("cp437"), 0) == "日志" and archives.skipped("a/../b") and not archives.skipped("a/b.log")


def test_log_lines_source(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"x\r\ny\n")
    spark.dataSource.register(L.LinesSource)
    assert [(r.byte_offset, r.text) for r in spark.read.format("log_lines").load(str(tmp_path)).orderBy("byte_offset").collect()] == [(0, "x"), (3, "y")]
    got = L.log_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.byte_offset, r.text) for r in got] == [(0, 0, "x"), (1, 3, "y")]


def test_events_with_bounds_keep_undated(spark):
    rows = [(1, 5.0), (2, 15.0), (3, None), (4, 25.0)]
    df = spark.createDataFrame(rows, "line_no long, raw_timestamp double")
    got = lambda **bounds: [r.line_no for r in Q.events(df, **bounds).collect()]
    assert got(start=10.0, end=20.0) == [2, 3]
    assert got(start=10.0) == [2, 4, 3] and got(end=20.0) == [1, 2, 3]


def test_clip_cuts_and_falls_back_per_file(spark):
    rows = [("a", i, 100.0 + i) for i in range(8)] + [("b", 0, None), ("b", 1, 101.0), ("b", 2, None), ("b", 3, 900.0)] + [("c", i, 900.0 + i) for i in range(6)]
    df = spark.createDataFrame(rows, "file_id string, line_no long, raw_ts double")
    got = [(r.file_id, r.line_no, r.fallback) for r in prescan.clip(df, 100.0, most=5).collect()]
    assert got == [("a", i, False) for i in range(5)] + [("b", 1, False), ("b", 2, False)] + [("c", i, True) for i in range(5)]


def test_white_space_of_any_kind_goes_at_the_ends(spark):
    for text, want in (("\t a b \n", "a b"), ("　x ", "x"), ("\x1cq\x1f", "q"), (" \r\n ", ""), ("a\n\nb\n", "a\n\nb")):
        assert one(spark, T.strip(F.lit(text))) == want == text.strip()
        assert one(spark, T.query_key(F.lit("s"), F.lit(text))) == hashlib.sha256(f"s|{text.strip().lower()}".encode()).hexdigest()
    chunks = one(spark, T.chunk_paragraphs(F.lit("\tfirst paragraph that is long enough to stand for itself, yes\n \t\n second"), 500, 5))
    assert [c.text for c in chunks] == ["first paragraph that is long enough to stand for itself, yes\n\nsecond"]


def test_labels(spark):
    assert [one(spark, T.duration_label(F.lit(float(s)))) for s in (0, 59.4, 60, 3600, 3725, -1)] == ["0s", "59s", "1m", "1h", "1h 2m", ""]
    assert [one(spark, T.delta_label(F.lit(float(s)))) for s in (5, 65, 3725, -3)] == ["Δ5s", "Δ1m 5s", "Δ1h 2m", "Δ0s"]


def test_keyword_files_keep_the_order_of_a_split_file(spark, tmp_path):
    rows = [f"line {i:05d} {'Alpha' if i % 3 else 'beta'}" for i in range(4000)]
    (tmp_path / "a.log").write_text("\n".join(rows))
    (tmp_path / "b.dat").write_text("alpha")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = L.keyword_files(spark, str(tmp_path), ["ALPHA"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.text for r in got] == ["=== a.log ===\n" + "\n".join(x for x in rows if "Alpha" in x)]


def test_alignment_counts_and_warnings(spark):
    rows = [anchor("tbox", "k", 1.7e9), anchor("tbox", "k", 1.7e9 + 50), anchor("mcu", "k", 1.7e9 + 1), anchor("fota", "j", 1.7e9)]
    got = {r.controller: r for r in align.align(spark.createDataFrame(rows, ANCHORS), spark.createDataFrame([("b", c) for c in ("tbox", "mcu", "fota", "kernel")], "bundle_id string, controller string")).collect()}
    assert (got["tbox"].n, got["tbox"].method, got["tbox"].warnings) == (2, "none", [])
    assert got["kernel"].warnings == ["kernel: no usable anchors"] and got["fota"].warnings == []
    only = align.align(spark.createDataFrame([anchor("android", "k", 1.7e9)], ANCHORS), spark.createDataFrame([("b", "android")], "bundle_id string, controller string"))
    assert align.summary(only).first().warnings == ["no usable anchors of tbox: android is the base clock"]


def test_updates_keep_old_values_where_new_ones_are_null(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, at double")
    new = spark.createDataFrame([(1, None, 5.0)], "id int, name string, at double")
    assert sorted(tuple(r) for r in tables.updated(old, new, "id").collect()) == [(1, "a", 5.0), (2, "b", 2.0)]


def test_users_rules(spark, tmp_path):
    text = """
events:
  - type: door
    applies_to: [mcu]
    patterns: [{regex: '(?P<x>DOOR_\\w+)'}, {keyword_any: [hatch]}, {keyword_all: [lock, open]}]
    fields: {which: 'DOOR_(\\w+)'}
    confidence: 0.5
slim:
  keep_always: [panic]
  drop: [{controller: mcu, patterns: [noise]}]
"""
    (tmp_path / "rules.yaml").write_text(text)
    rules = R.load_rules(str(tmp_path / "rules.yaml"), "events")
    got = prescan.rule_events(lines(spark, [("b", "f", "mcu", i, 0, 0.0, t) for i, t in enumerate(("DOOR_FL and Hatch", "open the lock", "none"))]), rules).orderBy("line_no").collect()
    assert [(r.line_no, r.event_type, r.extracted_fields["which"]) for r in got] == [(0, "door", "FL"), (0, "door", "FL"), (1, "door", None)]
    drop, keep = R.load_slim(str(tmp_path / "rules.yaml"))
    assert (drop, keep) == ({"mcu": ("noise",)}, ("panic",))
    with pytest.raises(ValueError):
        (tmp_path / "bad.yaml").write_text("events: [{type: x}]")
        R.load_rules(str(tmp_path / "bad.yaml"), "events")


def test_trace_payload_and_services(spark):
    assert one(spark, T.printable(F.lit(b"\x01\x02hello\x00wor\x00ld"))) == "hello wor"
    said = spark.createDataFrame([("s", 0, "user", " \n"), ("s", 1, "user", "x" * 30), ("t", 0, "assistant", "hi")], "conv_id string, turn int, role string, text string")
    assert [tuple(r) for r in services.session_titles(said, "conv_id", "turn", "role", "text").collect()] == [("s", "x" * 18 + "...")]
    cases = spark.createDataFrame([("c",)], "case_id string")
    rows = [("c", "confirmed", 0.5), ("d", "confirmed", 0.5), ("c", "odd", 0.5), ("c", "pending", 1.5)]
    errors = services.feedback_errors(spark.createDataFrame(rows, "case_id string, confirmation_status string, confidence double"), cases).collect()
    assert sorted(r.error for r in errors) == ["confidence outside 0..1", "no such case", "no such status"]
    assert services.conflicts(cases, cases, "case_id").count() == 1 and services.add_new(cases, cases, "case_id").count() == 1

"""Streams: batches stored once, restarts, late rows, forgotten state, and the same results as batch."""

from __future__ import annotations

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldtrace.functions import rules as R
from fieldtrace.operators import prescan, scan
from fieldtrace.plans import ingest
from fieldtrace.plans.audit import Audit
from fieldtrace.schema import LINES
from fieldtrace.sources.versions import Manifests, Tables
from fieldtrace.streaming import monitor, store

T0 = 1710000000.0


def run(query):
    assert query.awaitTermination(120)
    if query.exception():
        raise query.exception()


def arrive(spark, folder, rows, schema):
    """One more file in a folder of a stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def lines(n, at=0, bundle="b1"):
    return [(bundle, "f", "tbox", i, 0, T0 + i, f"line {i} {'system started' if i % 3 == 0 else ''}") for i in range(at, at + n)]


def test_stored_stream_equals_batch_over_restarts(spark, tmp_path):
    source, folder, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")

    def stream():
        return monitor.event_stream(spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(source))

    arrive(spark, source, lines(10), LINES)
    arrive(spark, source, lines(10, 10) + lines(5, bundle="b2"), LINES)
    run(store.store_stream(stream(), folder, "events", "events", check))
    arrive(spark, source, lines(10, 20), LINES)
    run(store.store_stream(stream(), folder, "events", "events", check))
    key = lambda df: sorted((r.bundle_id, r.line_no, r.event_type) for r in df.collect())
    want = key(prescan.rule_events(spark.read.parquet(source)))
    assert key(Tables(spark, folder).read("events")) == want and len(want) > 10


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_batch_lost_around_its_commit_is_stored_once(spark, tmp_path, monkeypatch, when):
    source, folder, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    arrive(spark, source, lines(12), LINES)
    rows = lambda: spark.readStream.schema(LINES).parquet(source)
    real = Manifests.publish

    def broken(self, change):
        if when == "after":
            real(self, change)
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Manifests, "publish", broken)
        with pytest.raises(Exception, match="lost"):
            run(store.store_stream(rows(), folder, "lines", "lines", check))
    run(store.store_stream(rows(), folder, "lines", "lines", check))
    assert sorted(r.line_no for r in Tables(spark, folder).read("lines").collect()) == list(range(12))


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    source, folder, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "bundle_id string, at timestamp, kind string"
    stamp = lambda s: __import__("datetime").datetime.fromtimestamp(T0 + s, __import__("datetime").UTC)

    def stream():
        own = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return monitor.windowed_counts(own, "at", "kind").withColumn("bundle_id", F.lit("b"))

    for batch in ([0, 10, 299], [2000], [5, 1500], [9000]):  # the third batch: one row behind the watermark, one within it
        arrive(spark, source, [("b", stamp(s), "x") for s in batch], schema)
        run(store.store_stream(stream(), folder, "windows", "windows", check))
    got = {int(r.start.timestamp() - T0 // 300 * 300): r.n for r in Tables(spark, folder).read("windows").collect()}
    whole = {int((T0 + s) // 300 * 300 - T0 // 300 * 300) for s in (0, 10, 299)}
    assert sum(got.get(w, 0) for w in whole) == 3 and sum(got.values()) == 5  # [9000] is still open


def test_boot_numbers_equal_batch_and_late_lines_change_nothing(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    schema = "file_id string, line_no long, tick double"
    ticks = [5.0, 6.0, None, 2.0, 3.0, 1.0, None, 9.0, 8.0, 8.5, 0.5, 4.0]
    rows = [(f, i, t if f == "a" else (t and -t)) for f in "ab" for i, t in enumerate(ticks)]
    got = []

    def step():
        stream = spark.readStream.schema(schema).parquet(source)
        # A time to live asks for batches without data, so that a run until all is read has no end: one batch at a time.
        run(monitor.boot_numbers(stream).writeStream.option("checkpointLocation", check).foreachBatch(lambda df, _: got.extend(df.collect())).trigger(once=True).start())

    for at in (0, 4, 8):
        arrive(spark, source, list(reversed([r for r in rows if at <= r[1] < at + 4])), schema)
        step()
    arrive(spark, source, [("a", 3, 0.1), ("a", 12, 5.0)], schema)
    step()
    batch = scan.resets(spark.createDataFrame([*rows, ("a", 12, 5.0)], schema), "tick", "boot", ["file_id"], "line_no")
    assert {(r.file_id, r.line_no): r.boot for r in got if not r.late} == {(r.file_id, r.line_no): r.boot for r in batch.collect()}
    assert [(r.file_id, r.line_no, r.boot) for r in got if r.late] == [("a", 3, None)]


def test_a_silent_file_is_forgotten(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    schema = "file_id string, line_no long, tick double"

    def step(name):
        stream = spark.readStream.schema(schema).parquet(source)
        run(monitor.boot_numbers(stream, ttl_ms=3000).writeStream.option("checkpointLocation", check).foreachBatch(lambda df, _: out.extend(df.collect())).queryName(name).trigger(once=True).start())

    out = []
    arrive(spark, source, [("a", 0, 5.0), ("a", 1, 4.0)], schema)
    step("one")
    time.sleep(5)
    arrive(spark, source, [("a", 2, 3.0)], schema)
    step("two")
    assert [(r.line_no, r.boot) for r in sorted(out, key=lambda r: r.line_no)] == [(0, 0), (1, 1), (2, 0)]


def test_progress_is_kept_as_rows(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for at in (0, 10, 20):
        arrive(spark, source, lines(10, at), LINES)
    shown = monitor.Progress(every=15)
    spark.streams.addListener(shown)
    try:
        run(store.store_stream(spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(source), folder, "lines", "watched", str(tmp_path / "c1")))
        for _ in range(50):
            if sum(shown.totals.values()) == 30:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(shown)
    rows = shown.table(spark).collect()
    assert [(r.name, r.total) for r in rows] == [("watched", 20)] and list(shown.totals.values()) == [30]


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def android(n):
    return "".join(f"03-01 09:59:{i:02d}.000  1  2 I T: system started\n" for i in range(n))


def test_uploads_are_ingested_as_they_come(spark, tmp_path):
    uploads, folder = tmp_path / "up", str(tmp_path / "out")
    uploads.mkdir()
    go = lambda: run(store.ingest_stream(spark, str(uploads), folder, str(tmp_path / "check"), str(tmp_path / "members"), each=1))
    (uploads / "one.zip").write_bytes(zipped({"android/main_2024-03-01.log": android(3)}))
    go()
    (uploads / "two.zip").write_bytes(zipped({"android/main_2024-03-01.log": android(4)}))
    go()
    go()
    got = Tables(spark, folder).read("events").groupBy("bundle_id").count().collect()
    assert {r.bundle_id: r["count"] for r in got} == {"one.zip": 3, "two.zip": 4}


def test_counters_are_observed_without_a_second_scan(spark, tmp_path):
    trace = "&100 INF@SYS : Set Date By Second: 131680000, x\n&200 INF@A : GEAR -> D\n&50 INF@A : x\n"
    (tmp_path / "b.zip").write_bytes(zipped({"android/main_2024-03-01.log": "no time\n" + android(5), "mcu/mcu1.log": trace, "tbox/tbox_empty.log": "", "x/what.bin": "\x00\x01"}))
    audit = Audit(spark, "b.zip", str(tmp_path / "audit"))
    b = ingest.ingest(spark, str(tmp_path / "b.zip"), audit=audit)
    kept = {(r.stage, r.status): r for r in Tables(spark, str(tmp_path / "audit")).read("audit").collect()}
    assert set(kept) == {(s, x) for s in ("extract", "classify", "decode", "prescan", "align") for x in ("start", "ok")}
    assert kept["extract", "ok"].counters["members"] == 4 and kept["classify", "ok"].counters == {"files": 4, "unknown": 1}
    assert kept["decode", "ok"].counters == {"lines": b.lines.count()}
    want = prescan.counters(b.files.join(b.lines.groupBy("file_id").agg(F.count("*").alias("_n")), "file_id", "left"), b.events, b.anchors, b.index).first()
    seen = kept["prescan", "ok"].counters
    assert {k: seen[k] for k in ("events", "anchors", "indexed_files", "skipped")} == {k: want[k] for k in ("events", "anchors", "indexed_files", "skipped")}
    assert seen["indexed_files"] == 1 and seen["skipped"] == 2 and seen["unsynced_files"] >= 1
    with pytest.raises(ZeroDivisionError), audit.stage("more"):
        _ = 1 / 0
    last = [r for r in Tables(spark, str(tmp_path / "audit")).read("audit").collect() if r.stage == "more" and r.status == "error"]
    assert [r.message for r in last] == ["division by zero"]


def test_rules_for_files_from_a_file(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"controllers": [{"type": "tbox", "path_patterns": ["**/gw/**"], "content_signatures": [{"magic_bytes": "DLT\\u0001"}, {"regex": "^\\\\[TBOX\\\\]"}]}, {"type": "mcu", "path_patterns": ["**/gw/mcu/**"], "name_patterns": ["m*.txt"]}, {"type": "fota"}], "priority_order": ["mcu"]}')
    rules = R.load_files(str(tmp_path / "rules.json"))
    assert [r.controller for r in rules] == ["mcu", "tbox", "fota"]
    rows = [("gw/a", "a", b""), ("gw/mcu/b", "b", b""), ("x/m1.txt", "m1.txt", b""), ("x/c", "c", b"DLT\x01"), ("x/d", "d", b"x DLT\x01"), ("x/e", "e", b"z\n[TBOX] up")]
    df = spark.createDataFrame(rows, "p string, n string, h binary")
    assert [r.c for r in df.select(R.classify(F.col("p"), F.col("n"), F.col("h"), rules).alias("c")).collect()] == ["tbox", "mcu", "mcu", "tbox", "unknown", "tbox"]
    (tmp_path / "bad.json").write_text('{"controllers": [{"path_patterns": []}]}')
    with pytest.raises(ValueError, match="type"):
        R.load_files(str(tmp_path / "bad.json"))

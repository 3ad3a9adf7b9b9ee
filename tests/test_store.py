"""Versioned tables and the indexed store of lines: equal to full scans, few bytes read, failures leave a whole version."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition

from fieldtrace.operators import range_query as Q
from fieldtrace.plans import queries
from fieldtrace.schema import EVENTS, FILES, LINES
from fieldtrace.sources import logstore
from fieldtrace.sources.versions import Manifests, Tables

T0 = 1710000000.0


# --- versioned tables ---------------------------------------------------------------------------------------------


def events(spark, rows):
    return spark.createDataFrame([(b, "f", "mcu", kind, ts, None, 1.0, 0, "", {}) for b, kind, ts in rows], EVENTS)


def held(table, version=None):
    return sorted((r.bundle_id, r.event_type, r.raw_timestamp) for r in table.read("events", version).collect())


def test_a_bundle_is_replaced_and_no_other_and_old_versions_stay_readable(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    one = events(spark, [("b1", "boot", 1.0), ("b1", "crash", 2.0), ("b2=/:%", "boot", 3.0)])
    assert t.replace({"events": one}) == 1
    assert t.replace({"events": events(spark, [("b1", "boot", 9.0), ("b1", "crash", 9.0)])}) == 2
    assert held(t) == [("b1", "boot", 9.0), ("b1", "crash", 9.0), ("b2=/:%", "boot", 3.0)]
    assert held(t, 1) == [("b1", "boot", 1.0), ("b1", "crash", 2.0), ("b2=/:%", "boot", 3.0)]
    assert t.remove_rows("events", "b1", F.col("event_type") == "crash") == 3
    assert held(t) == [("b1", "boot", 9.0), ("b2=/:%", "boot", 3.0)]
    assert t.remove_rows("events", "b1", F.lit(True)) == 4
    assert t.drop(["b2=/:%"]) == 5 and held(t) == []
    assert [r.event_type for r in t.read("events", 3, ["b1"]).collect()] == ["boot"]
    assert t.vacuum(keep=3) == [1, 2]
    assert held(t, 3) == [("b1", "boot", 9.0), ("b2=/:%", "boot", 3.0)] and held(t) == []
    with pytest.raises(KeyError):
        t.read("anchors")


def test_several_tables_change_together_or_not_at_all(spark, tmp_path, monkeypatch):
    t = Tables(spark, str(tmp_path))
    first, second = events(spark, [("b1", "boot", 1.0)]), events(spark, [("b1", "boot", 2.0)])
    t.replace({"events": first, "more": first})
    for step in ("_write", "publish", "_put"):
        with monkeypatch.context() as m:

            def broken(*a, real=Tables._write, step=step):
                if step == "_write" and a[1] == "events":
                    return real(*a)
                raise OSError("lost")

            m.setattr(Tables if step == "_write" else Manifests, step, broken)
            with pytest.raises(OSError, match="lost"):
                t.replace({"events": second, "more": second})
        assert held(t) == [("b1", "boot", 1.0)] and [r.raw_timestamp for r in t.read("more").collect()] == [1.0]
    assert t.replace({"events": second, "more": second}) == 2
    assert held(t) == [("b1", "boot", 2.0)] and held(t, 1) == [("b1", "boot", 1.0)]
    t.vacuum(keep=1)
    assert held(t) == [("b1", "boot", 2.0)] and len(list((tmp_path / "events").iterdir())) == 1


def test_rows_are_added_once_for_each_note(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    one, two = events(spark, [("b1", "boot", 1.0)]), events(spark, [("b1", "crash", 2.0), ("b2", "boot", 3.0)])
    assert t.append({"events": one}, ("stream", 0)) == 1 and t.noted("stream") == 0 and t.noted("other") == -1
    assert t.append({"events": one}, ("stream", 0)) == 1  # brought again: nothing happens
    assert t.append({"events": two}, ("stream", 1)) == 2
    assert held(t) == [("b1", "boot", 1.0), ("b1", "crash", 2.0), ("b2", "boot", 3.0)]
    assert t.replace({"events": one}, note=("other", 5)) == 3 and held(t) == [("b1", "boot", 1.0), ("b2", "boot", 3.0)]
    t.drop(["b2"])
    t.vacuum(1)
    assert held(t) == [("b1", "boot", 1.0)] and (t.noted("stream"), t.noted("other")) == (1, 5)


def test_of_two_writers_one_begins_again(spark, tmp_path):
    t = Tables(spark, str(tmp_path))
    real = t.manifests._put
    other = Manifests(str(tmp_path))

    def late(number, content):
        if number == 1:
            other.publish(lambda now: now | {"other": {"folders": {}, "schema": events(spark, []).schema.json()}})
        return real(number, content)

    t.manifests._put = late
    assert t.replace({"events": events(spark, [("b1", "boot", 1.0)])}) == 2
    assert set(t.manifests.read()[1]) == {"other", "events"}


# --- indexed store ------------------------------------------------------------------------------------------------

#: File, controller, lines, seconds from line to line, offset, method; one file holds most lines.
SPECS = [("hot", "android", 6000, 60, 100.0, "direct"), ("b", "tbox", 400, 700, 0.0, "direct"), ("c", "fota", 300, 50, -50000.0, "direct"), ("seg", "mcu", 100, 1, None, "segmented"), ("free", "ibdu", 50, 1, None, "none"), ("far", "kernel", 50, 1, 9e8, "direct")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rnd = random.Random(3)
    rows, meta = [], []
    for name, controller, n, step, offset, method in SPECS:
        own = []
        for i in range(n):
            ts = float(i) if method == "segmented" else T0 + i * step + rnd.choice([0, 0, -400, 0.25])
            own.append(("b", name, controller, i, 0, None if rnd.random() < 0.2 or i < 3 else ts, f"line {i} of {name} \t é"))
        rows += own
        good = [r[5] for r in own if r[5] and r[5] >= T0 - 1000]
        unsynced = [(5, 9)] if name == "hot" else None
        meta.append(("b", name, controller, f"{name}.log", name, "", 0, n, None, None, min(good, default=None), max(good, default=None), offset, 1.0, method, unsynced, None))
    lines, files = spark.createDataFrame(rows, LINES).repartition(4), spark.createDataFrame(meta, FILES)
    segs = spark.createDataFrame([("seg", 0, 0, 60, T0 + 20000.0, 0.95), ("seg", 1, 60, 100, None, 0.0)], "file_id string, seq_no int, line_start long, line_end long, clock_offset double, offset_confidence double")
    folder = str(tmp_path_factory.mktemp("store"))
    logstore.write(lines, folder, objects=5)
    return lines, files, segs, folder


def rows_of(df):
    return sorted((r.file_id, r.line_no, r.aligned_ts or 0.0, r.line, r.clock_unaligned) for r in df.collect())


@pytest.mark.parametrize("undated", [False, True])
@pytest.mark.parametrize(("start", "length"), [(T0 + 19000, 3600), (T0 - 40000, 100), (T0 + 200000, 86400), (T0 + 1000, 0), (T0 + 9e8, 100)])
def test_indexed_reads_equal_the_full_scan(spark, stored, start, length, undated):
    lines, files, segs, folder = stored
    ask = dict(start=start, end=start + length, include_unsynced=undated, segments=segs)
    want = rows_of(Q.query(lines, files, **ask))
    got = rows_of(Q.query(logstore.window(spark, folder, files, start, start + length, undated), files, **ask))
    assert got == want


def test_a_tenth_of_the_time_reads_a_tenth_of_the_bytes_and_no_other(spark, stored, tmp_path):
    lines, files, _, folder = stored
    hot = files.filter("file_id = 'hot'")
    start, end = T0 + 100000, T0 + 100000 + 36000
    asked = logstore.ranges(spark, folder, hot, start, end)
    total = logstore.index(spark, folder).filter("file_id = 'hot'").agg(F.sum(F.col("stop") - F.col("start"))).first()[0]
    read = asked.agg(F.sum(F.col("stop") - F.col("start"))).first()[0]
    assert 0 < read <= 0.13 * total
    want = rows_of(Q.query(lines, hot, start, end))
    # In a copy all other bytes are spoilt: what comes is the same, so they are not looked at.
    copy = tmp_path / "copy"
    for f in Path(folder).rglob("*"):
        if f.is_file() and ".crc" not in f.name:
            (copy / f.relative_to(folder)).parent.mkdir(parents=True, exist_ok=True)
            (copy / f.relative_to(folder)).write_bytes(f.read_bytes() if f.suffix != ".log" else b"\xff" * f.stat().st_size)
    for r in asked.collect():
        raw = bytearray((copy / "objects" / f"{r.object}.log").read_bytes())
        raw[r.start : r.stop] = (Path(folder) / "objects" / f"{r.object}.log").read_bytes()[r.start : r.stop]
        (copy / "objects" / f"{r.object}.log").write_bytes(raw)
    assert rows_of(Q.query(logstore.window(spark, str(copy), hot, start, end), hot, start, end)) == want
    day = logstore.lines(spark, str(copy)).filter((F.col("file_id") == "hot") & (F.col("raw_ts") >= start - 100) & (F.col("raw_ts") <= end - 100))
    assert sorted(r.line_no for r in day.collect()) == [r[1] for r in want]


def test_pushed_filters_equal_the_full_scan(spark, stored):
    lines, _, _, folder = stored
    whole = logstore.lines(spark, folder)
    key = lambda df: sorted((r.file_id, r.line_no, r.raw_ts or -1.0, r.text) for r in df.collect())
    assert key(whole) == key(lines)
    for rule in ("file_id = 'b'", "raw_ts < 50", "raw_ts is null and file_id in ('b', 'c')", f"raw_ts > {T0 + 5000} and controller = 'android' and raw_ts < {T0 + 9000}", f"raw_ts = {T0 + 700}", "file_id = 'b' and file_id = 'c'", f"raw_ts >= {T0} or line_no = 4", "true"):
        assert key(whole.filter(rule)) == key(lines.filter(rule)), rule


def test_a_large_file_has_several_objects_and_lines_stay_whole(spark, stored):
    *_, folder = stored
    found = logstore.index(spark, folder)
    assert found.filter("file_id = 'hot'").select("object").distinct().count() >= 3
    assert found.filter("stop - start > 2000000 or dated_to < dated_from or first_line > last_line").count() == 0


def test_append_overwrite_line_feeds_and_nothing(spark, tmp_path):
    row = lambda i, text="x": ("b", "f", "tbox", i, 0, T0 + i, text)
    frame = lambda *rows: spark.createDataFrame(rows, LINES)
    folder = str(tmp_path / "s")
    assert logstore.index(spark, folder).collect() == []
    logstore.write(frame(row(0), row(1, None)), folder)
    logstore.write(frame(row(2)), folder)
    read = lambda: sorted((r.line_no, r.text) for r in logstore.lines(spark, folder).collect())
    assert read() == [(0, "x"), (1, ""), (2, "x")]
    with pytest.raises(Exception, match="line feed"):
        logstore.write(frame(row(3), row(4, "a\nb")), folder)
    assert len(read()) == 3  # a failed write leaves the version before
    logstore.write(frame(row(5)), folder, overwrite=True)
    assert read() == [(5, "x")]
    logstore.write(frame(row(6)).filter("false"), folder)
    assert read() == [(5, "x")]


def test_index_rows_are_written_as_they_come(tmp_path):
    n = 2 * logstore.HELD + 500
    columns = {"bundle_id": ["b"] * n, "file_id": [f"f{i:06d}" for i in range(n)], "controller": ["mcu"] * n, "line_no": list(range(n)), "raw_ts": [1.7e9 + i for i in range(n)], "text": [f"t{i}" for i in range(n)]}
    made = logstore._Writer(str(tmp_path), False).write(iter(pa.table(columns).to_batches(1000)))
    index = pq.ParquetFile(tmp_path / "index" / f"{made.name}.parquet")
    groups = [index.metadata.row_group(i).num_rows for i in range(index.metadata.num_row_groups)]
    assert groups == [logstore.HELD, logstore.HELD, 500]  # a row for each line, and no more than these at once
    assert index.read(["file_id"]).column(0).to_pylist() == columns["file_id"]
    batches = list(logstore._Reader(str(tmp_path)).read(InputPartition(made.name)))
    assert pa.Table.from_batches(batches).to_pydict() == columns
    assert len(batches) == 3  # lines of short ranges come together
    assert logstore._Writer(str(tmp_path), False).write(iter([])).name is None
    assert len(list((tmp_path / "index").iterdir())) == 1


def test_long_lines_of_many_ranges_do_not_come_in_one_batch(tmp_path):
    n, size = 20, 1 << 20
    columns = {"bundle_id": ["b"] * n, "file_id": [f"f{i:02d}" for i in range(n)], "controller": ["mcu"] * n, "line_no": list(range(n)), "raw_ts": [1.7e9 + i for i in range(n)], "text": [chr(97 + i) * size for i in range(n)]}
    made = logstore._Writer(str(tmp_path), False).write(iter(pa.table(columns).to_batches(5)))
    batches = list(logstore._Reader(str(tmp_path)).read(InputPartition(made.name)))
    held = logstore.READ // size
    assert [b.num_rows for b in batches] == [held, held, n - 2 * held]
    assert pa.Table.from_batches(batches).to_pydict() == columns


@pytest.mark.parametrize("name", ["range_indexed", "range_window_controllers"])
def test_windows_of_queries_without_a_limit_are_not_cut_by_the_default(spark, monkeypatch, name):
    real = Q.query
    monkeypatch.setattr(Q, "query", lambda *a, **more: real(*a, **{"limit": 5} | more))
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert len(got) > 5 and not any(r.truncated for r in got)
    assert [(r.controller, r.original_name, r.line_no) for r in got] == sorted((r.controller, r.original_name, r.line_no) for r in got)

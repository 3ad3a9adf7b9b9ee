"""Small operators with known answers: JSON and PDF sources, line output, times of requests, offsets of files, boots, hexadecimal payloads."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fieldtrace.functions import text as T
from fieldtrace.functions import timeparse as P
from fieldtrace.operators import align, prescan
from fieldtrace.operators import range_query as Q
from fieldtrace.schema import FILES, LINES
from fieldtrace.sources import archives, tables

T0 = 1710000000.0


def files(spark, *rows):
    base = dict(bundle_id="b", file_id="f", controller="android", original_name="a.log", bundle_relative_path="a.log", sha256="", size_bytes=0, line_count=0, raw_ts_min=None, raw_ts_max=None, valid_ts_min=None, valid_ts_max=None, clock_offset=None, offset_confidence=0.0, offset_method="none", unsynced=None, segments=None)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], FILES)


def test_json_tables_and_their_fallback(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"key": "AB-1", "summary": "Zeile\n2", "more": 1}, {"key": "AB-2"}]))
    got = tables.json_table(spark, str(tmp_path / "t.json"), "key string, summary string", [("x", "y")])
    assert [tuple(r) for r in got.orderBy("key").collect()] == [("AB-1", "Zeile\n2"), ("AB-2", None)]
    assert [tuple(r) for r in tables.json_table(spark, str(tmp_path / "none.json"), "key string, summary string", [("x", "y")]).collect()] == [("x", "y")]


def test_pdf_text_is_empty_where_nothing_reads_it(spark):
    df = spark.createDataFrame([(1, b"not a pdf"), (2, None)], "id int, content binary")
    assert [r.text for r in tables.pdf_text(df).orderBy("id").collect()] == ["", ""]


def test_lines_of_json(spark):
    df = spark.createDataFrame([(1, "a\"b\n", None, 1.5)], "line_no long, line string, aligned_ts double, raw_ts double")
    assert [json.loads(r.value) for r in Q.ndjson(df).collect()] == [{"line_no": 1, "line": 'a"b\n', "raw_ts": 1.5}]


@pytest.mark.parametrize(("value", "want"), [("12.5", 12.5), ("2024-03-01T10:00:00Z", 1709287200.0), ("2024-03-01T10:00:00", 1709287200.0), ("2024-03-01T12:00:00+02:00", 1709287200.0)])
def test_times_of_requests(value, want):
    assert Q.parse_time(value) == want
    with pytest.raises(ValueError):
        Q.parse_time("yesterday")


@pytest.mark.parametrize("bad", [dict(start=2.0, end=1.0), dict(start=0.0, end=1.0, limit=0), dict(start=0.0, end=1.0, limit=5_000_001), dict(start=0.0, end=1.0, controllers=["tbox", "radio"])])
def test_requests_that_are_refused(spark, bad):
    with pytest.raises(ValueError):
        Q.query(spark.createDataFrame([], LINES), files(spark), **bad)


def test_offsets_that_files_give_by_themselves(spark):
    own = files(
        spark,
        dict(file_id="boot", controller="kernel", original_name="12_2024-03-01_10-00-00.log", bundle_relative_path="x/kernel_logs/12_2024-03-01_10-00-00.log"),
        dict(file_id="dump", controller="kernel", original_name="kernel@2024-03-01_10-00-00.1.log", bundle_relative_path="x/kernel@2024-03-01_10-00-00.1.log", raw_ts_max=200.0),
        dict(file_id="early", controller="kernel", original_name="kernel@2019-03-01_10-00-00.log", raw_ts_max=200.0),
        dict(file_id="clock", controller="tbox", valid_ts_min=T0),
        dict(file_id="none", controller="tbox"),
        dict(file_id="seg", controller="mcu"),
    )
    segs = spark.createDataFrame([("seg",)], "file_id string")
    got = {r.file_id: (r.offset_method, r.clock_offset, r.offset_confidence) for r in align.file_offsets(own, segs).collect()}
    assert got == {
        "boot": ("filename_anchor", 1709287200.0, 0.99),
        "dump": ("filename_anchor", 1709287000.0, 0.85),
        "early": ("none", None, 0.0),
        "clock": ("clock_sync", 0.0, 1.0),
        "none": ("none", None, 0.0),
        "seg": ("segmented", None, 0.0),
    }
    placed = spark.createDataFrame([("b", "tbox", 5.0, 0.7, "direct"), ("b", "kernel", 9.0, 0.9, "two_hop")], "bundle_id string, controller string, offset double, confidence double, method string")
    after = {r.file_id: (r.offset_method, r.clock_offset, r.offset_confidence) for r in align.apply_offsets(align.file_offsets(own, segs), placed).collect()}
    assert after == got | {"early": ("two_hop", 9.0, 0.9), "none": ("direct", 5.0, 0.7)}


def test_unsynced_lines_end_where_the_clock_is_set(spark):
    rows = [("b", f, "mcu", i, 0, None, "clock sync" if i == k else "x") for f, k in (("a", 3), ("c", 0), ("d", 99)) for i in range(5)]
    own = files(spark, *(dict(file_id=f, unsynced=[(1, 1)]) for f in "acd"))
    got = {r.file_id: [tuple(x) for x in r.unsynced] for r in align.refine_unsynced(own, spark.createDataFrame(rows, LINES), F.col("text") == "clock sync").collect()}
    assert got == {"a": [(0, 2)], "c": [(1, 1)], "d": [(1, 1)]}


def test_boots_of_captures_with_an_offset(spark):
    path = "x/kernel_logs/1_2024-03-01_10-00-00.log"
    own = files(
        spark,
        dict(file_id="a", controller="kernel", original_name="1.log", bundle_relative_path=path, clock_offset=T0, offset_method="filename_anchor"),
        dict(file_id="b", controller="kernel", bundle_relative_path=path, clock_offset=T0, offset_method="direct"),
        dict(file_id="c", controller="kernel", bundle_relative_path="x/other/1.log", clock_offset=T0, offset_method="filename_anchor"),
        dict(file_id="d", controller="kernel", bundle_relative_path=path, offset_method="filename_anchor"),
    )
    got = prescan.boot_sessions(own).collect()
    assert [(r.file_id, r.event_type, r.raw_timestamp, r.aligned_timestamp, r.alignment_quality, r.raw_line) for r in got] == [("a", "boot_session", 0.0, T0, 0.99, "1.log")]


@pytest.mark.parametrize(("payload", "want"), [("48656C6C6F", "Hello"), ("4865 zz 414", "He zz 414"), ("00FF41", "..A"), ("", ""), ("x", "x"), ("DE", "DE"), ("4142-4344", "AB-CD")])
def test_hexadecimal_runs_as_text(spark, payload, want):
    df = spark.createDataFrame([(payload,)], "p string")
    assert df.select(T.hex_text(F.col("p")).alias("v")).first().v == want


def test_where_files_are_kept(spark):
    df = spark.createDataFrame([("b", "tbox", "f1", 'a/b:c*?"<>|.log'), ("b", "tbox", "f2", "x" * 300)], "b string, c string, f string, n string")
    got = [r.v for r in df.select(archives.stored_path(*map(F.col, "bcfn")).alias("v")).collect()]
    assert got == ["b/tbox/f1__a_b_c______.log", "b/tbox/f2__" + "x" * 200]
    assert archives.stored_name("f1", 'a/b:c*?"<>|.log') == "f1__a_b_c______.log"


def test_year_of_a_log_without_one(spark):
    df = spark.createDataFrame([("main_2021-03-01.log", None), ("x.log", "2019-05-05 00:00:00")], "n string, m string").withColumn("m", F.col("m").cast("timestamp"))
    assert [r.v for r in df.select(P.year_hint(F.col("n"), F.col("m")).alias("v")).collect()] == [2021, 2019]


def test_times_in_steps_equal_the_expression(spark):
    texts = """03-01 09:59:50.000  1  2 I T: x
03-01 09:59:50.123456  1  2 I T: x
02-30 09:59:50.000  1  2 I T: x
2024-03-01 10:00:00,250 x
2024-03-01 10:00:00.25 x
2024-13-01 10:00:00.250 x
2024-03-01 10:00:60.250 x
some words 2024-02-29T23:59:59.5 x
2023-02-29 10:00:00 x
[   12.000345] boot
[x] boot
2024-03-01T10:00:00.123456 ECU1 x
[2024.03.01 10:00:00.250]0A 0B
[2024.03.01 10:00:00.250] 2024-03-01T10:00:00.1
&1500 INF@SYS : x
&x INF@SYS : x
,1,2,3
\ufdd0,2024,3,1,10,0,0,5

no time""".split("\n")
    rows = [(c, t, 2024) for c in ("android", "kernel", "fota", "tbox", "mcu", "ibdu", "unknown") for t in texts]
    df = spark.createDataFrame(rows, "controller string, text string, year int")
    both = P.timed(df).withColumn("want", P.line_time(F.col("controller"), F.col("text"), F.col("year"), F.lit(False))).collect()
    assert [(r.controller, r.text, r.raw_ts) for r in both] == [(r.controller, r.text, r.want) for r in both]
    assert sum(r.want is not None for r in both) >= 15

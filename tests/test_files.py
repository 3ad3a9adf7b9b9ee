"""Archives, text files and traces of any size: splits equal the whole read, members pass through in pieces."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import struct
import subprocess
import sys
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldtrace.functions import rules as R
from fieldtrace.plans import ingest
from fieldtrace.sources import archives
from fieldtrace.sources import lines as L


def message(seconds, payload, ecu=b"ECU1"):
    body = ecu + b"\x01\x00APP1CTX1" + payload
    return b"DLT\x01" + struct.pack("<Ii", seconds, 5) + b"ECU0" + struct.pack(">BBH", 0x05, 0, 4 + len(body)) + body


def frame(spark, *paths):
    return spark.createDataFrame([(str(p), p.stat().st_size, p.name) for p in paths], "uri string, size_bytes long, name string")


def text_content(seed):
    rnd = random.Random(seed)
    out = b"\xef\xbb\xbf" if seed % 2 else b""
    for _ in range(300):
        out += rnd.choice([b"", b"x", b"line \xff\xfe", "Zeile é".encode(), b"y" * rnd.randint(0, 200)]) + rnd.choice([b"\n", b"\r\n", b"\n\n", b"\r\r\n"])
    return out + rnd.choice([b"", b"no end", b"\r"])


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000, 1 << 20])
def test_split_lines_equal_the_whole_read(size):
    for content in [text_content(s) for s in range(6)] + [b"", b"\n", b"\xef\xbb\xbf", b"\xef\xbb\xbf\n", b"a", b"\n\n\n", b"q" * 500]:
        f, got, counts = io.BytesIO(content), [], []
        for start in range(0, max(1, len(content)), size):
            own = list(L.split_lines(f, len(content), start, min(len(content), start + size)))
            counts.append((L.count_lines(f, len(content), start, min(len(content), start + size)), len(own)))
            got += own
        assert got == [(at, text) for _, at, text in L.text_lines(content)]
        assert all(a == b for a, b in counts)


@pytest.mark.parametrize("piece", [1, 5, 1 << 20])
def test_lines_longer_than_a_piece(monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    content = text_content(3)
    f = io.BytesIO(content)
    got = [x for start in range(0, len(content), 100) for x in L.split_lines(f, len(content), start, min(len(content), start + 100))]
    assert got == [(at, text) for _, at, text in L.text_lines(content)]


def test_numbered_lines_of_large_files_in_several_partitions(spark, tmp_path):
    a, b, c = tmp_path / "a.log", tmp_path / "b.log", tmp_path / "c.log"
    a.write_bytes(text_content(1) * 5)
    b.write_bytes(text_content(2))
    c.write_bytes(b"")
    got = L.read_text(frame(spark, a, b, c), 2000).withColumn("p", F.spark_partition_id())
    rows = got.collect()
    for p in (a, b, c):
        assert sorted((r.line_no, r.byte_offset, r.text) for r in rows if r.name == p.name) == list(L.text_lines(p.read_bytes()))
    assert len({r.p for r in rows if r.name == "a.log"}) > 5
    L_rows = L.log_lines(spark, str(tmp_path), "*.log", 999).collect()
    assert sorted((r.line_no, r.text) for r in L_rows if r.uri.endswith("b.log")) == [(n, t) for n, _, t in L.text_lines(b.read_bytes())]
    spark.dataSource.register(L.LinesSource)
    source = spark.read.format("log_lines").option("splitBytes", 777).load(str(tmp_path))
    assert sorted((r.byte_offset, r.text) for r in source.collect() if r.path.endswith("a.log")) == [(at, t) for _, at, t in L.text_lines(a.read_bytes())]
    assert source.rdd.getNumPartitions() > 20


def trace_content(seed):
    rnd = random.Random(seed)
    out = rnd.choice([b"", b"junk"])
    for i in range(200):
        inner = message(1, b"inside" * rnd.randint(0, 3))
        # Payloads that hold whole messages or their marks mislead whoever begins in the middle.
        out += message(100 + i, rnd.choice([b"p" * rnd.randint(0, 60), inner, inner * 4, b"DLT\x01", b"DL"]))
        out += rnd.choice([b"", b"", b"", b"broken", b"DLT\x01" + b"\x00" * 30, b"DLT\x01"])
    return out + rnd.choice([b"", message(9, b"cut off" * 9)[:-5]])


def old_messages(content):
    """Places and payloads by a walk over content in memory."""
    at, out = content.find(b"DLT\x01"), []
    while 0 <= at <= len(content) - 20:
        (length,) = struct.unpack_from(">H", content, at + 18)
        head, stop = content[at + 16], at + 16 + length
        p = at + 20 + 4 * bool(head & 4) + 4 * bool(head & 8) + 4 * bool(head & 16) + 10 * (head & 1)
        if length < 4 or stop > len(content) or p > stop:
            at = content.find(b"DLT\x01", at + 1)
        else:
            out.append((at, content[p:stop]))
            at = content.find(b"DLT\x01", stop)
    return out


@pytest.mark.parametrize("size", [50, 5000])
def test_trace_splits_equal_the_whole_read(spark, tmp_path, size):
    paths = []
    for seed in range(3):
        (tmp_path / f"{seed}.dlt").write_bytes(trace_content(seed))
        paths.append(tmp_path / f"{seed}.dlt")
    (tmp_path / "none.dlt").write_bytes(b"nothing here")
    rows = L.read_trace(frame(spark, *paths, tmp_path / "none.dlt"), size).collect()
    for p in paths:
        own = sorted((r.line_no, r.byte_offset, bytes(r.payload)) for r in rows if r.name == p.name)
        want = old_messages(p.read_bytes())
        assert own == [(i, at, payload) for i, (at, payload) in enumerate(want)] and len(want) > 150
        assert [(m[1], m[-1]) for m in L.dlt_messages(p.read_bytes())] == want
    assert {r.who for r in rows if r.trace_ts >= 100} >= {"ECU1 APP1 CTX1"} and not any(r.name == "none.dlt" for r in rows)


def test_decoders_are_tried_in_order_and_can_be_added(spark, tmp_path):
    files = {
        ("tbox", "t.dlt"): message(1709287200, b"hello"),
        ("tbox", "t.log"): b"2024-03-01 10:00:00.000 up\n",
        ("ibdu", "ibdu_1.log"): b"[2024.03.01 10:00:00.000]0A 0B\n",
        ("fota", "x.csv"): b"1709287200;a;b\n1709287201;c\n",
        ("fota", "f.db"): b"SQLite",
        ("unknown", "u.log"): b"line\n",
    }
    rows = []
    for (controller, name), content in files.items():
        (tmp_path / name).write_bytes(content)
        rows.append(("b", name, controller, name, str(tmp_path / name), len(content), content[:8192], None))
    df = spark.createDataFrame(rows, "bundle_id string, file_id string, controller string, original_name string, uri string, size_bytes long, head binary, modified timestamp")
    got = {(r.file_id, r.line_no): (r.raw_ts, r.text) for r in L.decode(df).collect()}
    assert got[("t.dlt", 0)] == (1709287200.000005, "2024-03-01T10:00:00.000005 ECU1 APP1 CTX1 hello")
    assert got[("t.log", 0)] == (1709287200.0, "2024-03-01 10:00:00.000 up") and got[("ibdu_1.log", 0)][0] == 1709287200.0
    assert got[("x.csv", 0)] == (None, "1709287200;a;b") and not any(f in ("f.db", "u.log") for f, _ in got)
    table = L.Decoder("table", ("fota",), lambda name, head: name.endswith(".csv"), L.read_text, lambda df: df.withColumn("raw_ts", F.split_part("text", F.lit(";"), F.lit(1)).cast("double")), lambda: F.regexp_replace("text", "^[^;]*;", ""))
    more = {(r.file_id, r.line_no): (r.raw_ts, r.text) for r in L.decode(df, (table, *L.DECODERS)).collect()}
    assert more == got | {("x.csv", 0): (1709287200.0, "a;b"), ("x.csv", 1): (1709287201.0, "c")}
    assert L.decode(df.filter("controller = 'unknown'")).collect() == []


# --- archives -----------------------------------------------------------------------------------------------------


def tarred(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, content in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def test_members_of_all_kinds_are_stored(spark, tmp_path):
    deep = b"leaf"
    for i in range(7):
        deep = zipped({f"l{i}.zip" if i else "leaf.log": deep})
    inside = {"a/one.log": b"1\n" * 5000, "__MACOSX/no": b"x", "../no.log": b"x", "t.tar.gz": tarred({"two.log": b"2", "in.zip": zipped({"three.log": b"3"})}), "g.log.gz": gzip.compress(b"zipped"), "plain.tar": tarred({"d/four.log": b"4"}, "w"), "deep.zip": deep}
    uploads = tmp_path / "up"
    uploads.mkdir()
    (uploads / ("0" * 32 + "__b.zip")).write_bytes(zipped(inside))
    (uploads / "solo?.log").write_bytes(b"alone")
    got = archives.extract(spark, str(uploads), str(tmp_path / "store")).collect()
    rows = {(r.bundle_id, r.bundle_relative_path): r for r in got}
    want = {"a/one.log": b"1\n" * 5000, "two.log": b"2", "three.log": b"3", "g.log": b"zipped", "d/four.log": b"4"}
    assert {p for b, p in rows if b == "b.zip"} - {"l3.zip"} == set(want) and len(rows) == len(want) + 2
    for path, content in want.items():
        r = rows["b.zip", path]
        with open(r.uri, "rb") as f:
            assert f.read() == content
        assert (r.sha256, r.size_bytes, bytes(r.head)) == (hashlib.sha256(content).hexdigest(), len(content), content[:8192])
        assert r.file_id == hashlib.sha256(f"b.zip|{path}".encode()).hexdigest() and r.uri.endswith(f"{r.file_id}__{r.original_name}")
    assert rows["solo?.log", "solo?.log"].uri.endswith("__solo_.log")
    assert [r.seq for r in sorted((r for r in got if r.bundle_id == "b.zip"), key=lambda r: r.seq)] == list(range(len(want) + 1))
    left = [p for p in (tmp_path / "store").rglob(".*") if not p.name.endswith(".crc")]
    assert left == []  # archives inside archives are put beside and go
    again = archives.extract(spark, str(uploads), str(tmp_path / "store")).collect()
    assert sorted(r.uri for r in again) == sorted(r.uri for r in got)


def test_an_archive_larger_than_the_memory_passes(tmp_path):
    big = 600 << 20
    with zipfile.ZipFile(tmp_path / "inner.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.log", "w", force_zip64=True) as f:
        for _ in range(big >> 20):
            f.write(b"\n" * (1 << 20))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.write(tmp_path / "inner.zip", "inner.zip")
    code = f"""
import resource, sys
sys.path.insert(0, {sys.path[0]!r})
from fieldtrace.sources import archives
now = int(open("/proc/self/statm").read().split()[0]) * 4096
resource.setrlimit(resource.RLIMIT_AS, (now + (200 << 20),) * 2)
with archives.opened({str(tmp_path)!r})[0].open_input_file({str(tmp_path / "b.zip")!r}) as f:
    print([(r["bundle_relative_path"], r["size_bytes"]) for r in archives.Unpacker({str(tmp_path / "store")!r}).unpack("b", "b.zip", f)])
"""
    import os

    env = os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=300)
    assert out.stdout.strip() == str([("big.log", big)]), out.stderr[-2000:]


def test_rar_without_its_package_says_so(tmp_path):
    (tmp_path / "x.rar").write_bytes(b"Rar!")
    try:
        import rarfile  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="rarfile"), open(tmp_path / "x.rar", "rb") as f:
            list(archives.Unpacker(str(tmp_path)).unpack("b", "x.rar", f))


def test_a_bundle_in_small_splits_equals_one_in_large_ones(spark, tmp_path):
    body = "".join(f"03-01 09:{i // 60:02d}:{i % 60:02d}.000  1  2 I T: system started {i}\n" for i in range(600))
    trace = b"".join(message(1709287200 + i, b"rtc set hw") for i in range(50))
    (tmp_path / "b.zip").write_bytes(zipped({"android/main_2024-03-01.log": body.encode(), "tbox/t.dlt": trace}))
    views = []
    for split in (500, 1 << 26):
        b = ingest.ingest(spark, str(tmp_path / "b.zip"), split=split)
        views.append((sorted(map(str, b.lines.collect())), sorted((r.file_id, r.event_type, r.line_no, r.aligned_timestamp) for r in b.events.collect()), sorted(map(str, b.index.collect()))))
    assert views[0] == views[1] and len(views[0][0]) == 650 and R.classify is not None
    folder = str(tmp_path / "tables")
    assert ingest.store(b, folder) == 1 and ingest.store(b, folder) == 2
    from fieldtrace.sources.versions import Tables

    kept = Tables(spark, folder)
    assert kept.read("events").count() == len(views[0][1]) and kept.read("index").count() == len(views[0][2])
    assert {r.controller for r in kept.read("files").collect()} == {"android", "tbox"} and kept.read("alignment", 1).count() == 1

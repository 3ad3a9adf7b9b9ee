"""Segmented scans and greedy matching in pieces, against plain walks over whole files and groups."""

from __future__ import annotations

import bisect
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldtrace.operators import align, prescan, scan

#: One file holds a third of all rows; orders have holes; some files have one row.
SIZES = {"hot": 400, "b": 150, "c": 150, "d": 90, "e": 9, "f": 1}


def rows_of(seed):
    rnd = random.Random(seed)
    out = []
    for name, n in SIZES.items():
        for at in sorted(rnd.sample(range(3 * n), n)):
            out.append((name, at, rnd.choice([None, None, float(rnd.randint(0, 30))]), 1577923200.0 + 40 * rnd.randint(0, 60) if rnd.random() < 0.8 else rnd.choice([None, 5.0])))
    return out


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    rows = rows_of(request.param)
    return rows, spark.createDataFrame(rows, "file_id string, line_no long, tick double, raw_ts double").repartition(5)


def by_file(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("size", [7, 65536])
def test_scans_equal_walks_at_any_block_size(case, size):
    rows, df = case
    filled, before, after, total, falls, transitions, islands = {}, {}, {}, {}, {}, set(), set()
    for name, own in by_file(rows).items():
        last = None
        for _, at, tick, _ in own:
            before[name, at] = last
            last = tick if tick is not None else last
            filled[name, at] = last
        last = None
        for _, at, tick, _ in reversed(own):
            after[name, at] = last
            last = tick if tick is not None else last
        n, f, last, bucket, start = 0, 0, None, None, None
        for i, (_, at, tick, ts) in enumerate(own):
            n += at % 5
            if tick is not None:
                f += last is not None and tick < last
                last = tick
            total[name, at], falls[name, at] = n, f
            good = ts is not None and ts >= 1577923200
            if good:
                if int(ts // 300) != bucket:
                    transitions.add((name, at, int(ts // 300)))
                bucket = int(ts // 300)
            start = at if not good and start is None else start
            if start is not None and (good or i == len(own) - 1):
                islands.add((name, start, own[i - 1][1] if good else at))
                start = None
    by, order = ["file_id"], ["line_no"]
    both = scan.seen(df, {"f": (F.col("tick"), True, False), "b": (F.col("tick"), False, False), "a": (F.col("tick"), False, True)}, by, order, size)
    assert both.columns == [*df.columns, "f", "b", "a"]
    got = {(r.file_id, r.line_no): (r.f, r.b, r.a) for r in both.collect()}
    assert got == {k: (filled[k], before[k], after[k]) for k in filled}
    sums = scan.running_sum(df, F.col("line_no") % 5, "s", by, order, size)
    assert {(r.file_id, r.line_no): r.s for r in sums.collect()} == total
    assert {(r.file_id, r.line_no): r.s for r in scan.resets(df, "tick", "s", by, "line_no", size).collect()} == falls
    assert {(r.file_id, r.line_no, r.bucket) for r in prescan.bucket_transitions(df, size=size).collect()} == transitions
    bad = ~F.coalesce(F.col("raw_ts") >= 1577923200, F.lit(False))
    assert {(r.file_id, r.start, r.end) for r in prescan.runs(df, bad, size=size).collect()} == islands


@pytest.mark.parametrize("size", [1, 65536])
def test_segments_clip_and_lines_in_segments_at_any_block_size(case, size):
    rows, df = case
    want, place = {}, {}
    for name, own in by_file(rows).items():
        seg, last = 0, None
        for _, at, tick, ts in own:
            if tick is not None:
                seg += last is not None and tick < last
                last = tick
            s = want.setdefault((name, seg), [at, at + 1, [], None])
            s[1] = at + 1
            s[2] += [tick] if tick is not None else []
            s[3] = s[3] if s[3] is not None or not ts or at % 7 else ts
            place[name, at] = seg
    sync = F.when((F.col("line_no") % 7 == 0) & (F.col("raw_ts") > 0), F.col("raw_ts"))
    segs = prescan.segments(df, F.col("tick"), sync, size=size)
    got = {(r.file_id, r.seq_no): [r.line_start, r.line_end, r.raw_ts_min, r.raw_ts_max, r.clock_offset, r.offset_confidence] for r in segs.collect()}
    assert got == {k: [s, e, min(t, default=None), max(t, default=None), o, 0.95 if o is not None else 0.0] for k, (s, e, t, o) in want.items()}
    held = prescan.in_segment(df, segs, size)
    assert {(r.file_id, r.line_no): r.seq_no for r in held.collect()} == place
    for most in (3, 1000):
        kept = set()
        for name, own in by_file(rows).items():
            last, lines = None, []
            for _, at, tick, _ in own:
                last = tick if tick is not None else last
                lines.append((name, at, last, False))
            near = [x for x in lines if x[2] is not None and 4 <= x[2] <= 6]
            kept |= set((near or [(*x[:3], True) for x in lines])[:most])
        clipped = prescan.clip(df, 5.0, 1.0, 1.0, most, ts="tick", size=size)
        assert {(r.file_id, r.line_no, r.filled, r.fallback) for r in clipped.collect()} == kept


def test_a_hot_file_is_dealt_in_blocks(spark, case):
    _, df = case
    marked = df.withColumn("b", scan.block_of(F.col("line_no"), 50))
    assert marked.groupBy("file_id", "b").count().agg(F.max("count")).first()[0] <= 50
    text = "\n".join(str(x) for x in [prescan.in_segment(df, prescan.segments(df, F.col("tick"), F.lit(None).cast("double"), size=50), 50)._jdf.queryExecution().optimizedPlan().toString()])
    joins = [x for x in text.splitlines() if "Join LeftOuter" in x]
    assert joins and all("_block" in x and "_at" in x for x in joins)  # equal blocks are part of the join's keys


def test_a_range_costs_no_more_where_lines_are_far_apart(spark):
    far = 4_000_000_000
    lines = [("a", 5), ("a", far), ("a", 2 * far), ("a", 3 * far), ("b", 7), ("c", 1), (None, 1), ("a", None)]
    df = spark.createDataFrame(lines, "file_id string, line_no long")
    spans = [("a", 5, far, 0), ("a", far, 3 * far, 1), ("b", 0, 7, 2), ("b", 8, 9, 3), ("b", 7, 7, 4), ("a", None, 9, 5), ("d", 0, far, 6)]
    ranges = spark.createDataFrame(spans, "file_id string, start long, stop long, seq_no int")
    for size in (1, 10, far):
        held = scan.within_ranges(df, ranges, "file_id", "line_no", "start", "stop", size)
        assert held.columns == ["file_id", "line_no", "seq_no"]
        assert {(r.file_id, r.line_no): r.seq_no for r in held.collect()} == dict(zip(lines, [0, 1, 1, None, None, None, None, None], strict=True))
        assert held.count() == len(lines)


def test_scans_of_nothing(spark, case):
    _, df = case
    none = df.filter("false")
    assert scan.running_sum(none, F.lit(1), "s", ["file_id"], ["line_no"]).collect() == []
    assert prescan.clip(none, 5.0, ts="tick").collect() == []
    assert prescan.segments(none, F.col("tick"), F.col("raw_ts")).collect() == []


# --- greedy matching ----------------------------------------------------------------------------------------------


def walk(source, base, window):
    source, base, used, out = sorted(source), sorted(base), set(), []
    times = [t for t, _ in base]
    for t, c in source:
        at = bisect.bisect_left(times, t)
        around = [j for j in (at - 1, at) if 0 <= j < len(base) and j not in used]
        if around:
            j = min(around, key=lambda j: (abs(times[j] - t), j))
            if abs(times[j] - t) <= window:
                used.add(j)
                out.append((window, t, times[j], round(max(c * base[j][1], 1e-6), 9)))
    return out


@pytest.mark.parametrize("stretch", [3.0, 3600.0])
def test_greedy_matching_equals_the_walk(spark, stretch):
    rnd = random.Random(int(stretch))
    source, base, want = [], [], Counter()
    for g in range(40):
        span, n, m = rnd.choice([10, 100, 1000, 10000]), rnd.randint(0, 60), rnd.randint(0, 40)
        theirs = [(float(rnd.randint(0, span)), rnd.choice([0.5, 0.7, 0.9])) for _ in range(m)]
        base += [(f"b{g}", "x", *p) for p in theirs]
        for name in ("m", "n"):
            own = [(float(rnd.randint(-50, span + 50)), rnd.choice([0.5, 0.9])) for _ in range(n)]
            source += [(f"b{g}", name, "x", *p) for p in own]
            for window in (5.0, 60.0):
                want.update((f"b{g}", name, "x", *p) for p in walk(own, theirs, window))
    source += [("b0", "m", "x", None, 0.5), ("b0", "m", "y", 1.0, 0.5)]
    s = spark.createDataFrame(source, "bundle_id string, controller string, anchor_type string, raw_timestamp double, confidence double").repartition(3)
    b = spark.createDataFrame(base, "bundle_id string, anchor_type string, raw_timestamp double, confidence double").repartition(3)
    found = align.anchor_pairs(s, b, (5.0, 60.0), stretch)
    assert Counter((r.bundle_id, r.controller, r.anchor_type, r.window, r.source_ts, r.base_ts, round(r.weight, 9)) for r in found.collect()) == want


def test_greedy_matching_of_one_long_chain_and_of_one_full_gap(spark):
    # Every source lies between two base times and pushes the next one on; then a third of all sources in one gap.
    own = [(10.0 * i + 4, 0.9) for i in range(500)] + [(9000.0 + i / 1000, 0.9) for i in range(400)]
    theirs = [(10.0 * i, 0.8) for i in range(500)] + [(8990.0, 0.8), (9010.0, 0.8)]
    s = spark.createDataFrame([("b", "m", "x", *p) for p in own], "bundle_id string, controller string, anchor_type string, raw_timestamp double, confidence double")
    b = spark.createDataFrame([("b", "x", *p) for p in theirs], "bundle_id string, anchor_type string, raw_timestamp double, confidence double")
    got = sorted((r.window, r.source_ts, r.base_ts, round(r.weight, 9)) for r in align.anchor_pairs(s, b, (60.0,), 500.0).collect())
    assert got == sorted(walk(own, theirs, 60.0))


def test_alignment_sums_pairs_once(spark):
    rows = [(c, "k", 1.7e9 + i * 1000 + d, 0.9) for i in range(4) for c, d in (("tbox", 0.0), ("mcu", 3.0))]
    own = spark.createDataFrame([("b", *r) for r in rows], "bundle_id string, controller string, anchor_type string, raw_timestamp double, confidence double")
    found = align.align(own, own.select("bundle_id", "controller").distinct())
    # What is left to do reads the written sums: no pair is searched again.
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.controller, r.offset, r.n, r.status) for r in found.collect()} == {("tbox", 0.0, 4, "success"), ("mcu", -3.0, 4, "success")}

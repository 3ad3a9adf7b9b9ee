"""The log and service operators on the tables of the driver, each with the same result in SQL.

`events` plays a log: a file is a user and an event type, its clock the event's time, its line number the event's id.
`documents`, `conversations` and `embeddings` play texts, sessions and vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.functions import rules as R
from fieldtrace.functions import text as T
from fieldtrace.operators import align, prescan, retrieval, search_index, services
from fieldtrace.operators import range_query as Q
from fieldtrace.schema import epoch
from fieldtrace.sources import logstore
from fieldtrace.sources.tables import shared_path, stage, table, updated
from fieldtrace.sources.versions import Tables
from fieldtrace.streaming import monitor, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

START, END = 1704412800.0, 1704499200.0  # 2024-01-05, one day
#: Lines of a block in the segmented scans of these queries: small, so that the given tables have many blocks.
SMALL = 1000
NAMES = {"view": "android", "click": "fota", "error": "kernel", "purchase": "tbox", "signup": "mcu"}
LINES = f"""lines AS (SELECT concat(user_id, '_', event_type) AS file_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())} END AS controller,
  event_id AS line_no, epoch(ts) AS raw_ts, props AS text, user_id, event_type, value FROM events)"""
FILES = """files AS (SELECT file_id, controller, min(user_id) % 5 * 60.0 AS clock_offset, count(*) AS line_count, min(raw_ts) AS raw_ts_min, max(raw_ts) AS raw_ts_max FROM lines GROUP BY ALL)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    return table(spark, sf_dir, "events").select(
        F.lit("b").alias("bundle_id"),
        F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("file_id"),
        kind[F.col("event_type")].alias("controller"),
        F.col("event_id").alias("line_no"),
        epoch(F.col("ts")).alias("raw_ts"),
        F.col("props").alias("text"),
        "user_id",
        "event_type",
        "value",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir)
    offset = own.groupBy("file_id", "controller").agg((F.min("user_id") % 5 * 60.0).alias("clock_offset"))
    stats = prescan.file_stats(own)
    return stats.join(offset, "file_id").withColumns(
        {"bundle_id": F.lit("b"), "original_name": F.col("file_id"), "offset_method": F.lit("direct"), "unsynced": F.lit(None).cast("array<struct<start:long,end:long>>")}
    )


@query(f"""WITH {LINES}, {FILES}, hit AS (SELECT l.controller, l.file_id, l.file_id AS original_name, l.raw_ts + f.clock_offset AS aligned_ts, l.raw_ts, l.line_no, l.text AS line, false AS clock_unaligned
  FROM lines l JOIN files f USING (file_id) WHERE l.raw_ts + f.clock_offset BETWEEN {START} AND {END})
SELECT *, (SELECT count(*) > 200 FROM hit) AS truncated FROM hit ORDER BY controller, original_name, line_no LIMIT 200""")
def range_window_scan(spark, sf_dir):
    return Q.query(lines(spark, sf_dir), files(spark, sf_dir), START, END, limit=200)


@query(f"""WITH {LINES} SELECT controller, file_id, line_no, text, (SELECT count(*) > 3000 FROM lines) AS truncated FROM lines ORDER BY controller, file_id, line_no LIMIT 3000""")
def limit_by_prefix_sums(spark, sf_dir):
    """The feature is the limit: the first 3,000 lines in file order, and whether there are more."""
    own = lines(spark, sf_dir).select("controller", "file_id", "line_no", "text")
    return Q.limited(own, ["controller", "file_id", "line_no"], 3000, top=0)


@query(f"""WITH {LINES}, {FILES} SELECT l.controller, l.file_id, l.file_id AS original_name, l.raw_ts + f.clock_offset AS aligned_ts, l.raw_ts, l.line_no, l.text AS line, false AS clock_unaligned, false AS truncated
FROM lines l JOIN files f USING (file_id) WHERE f.controller IN ('kernel', 'tbox') AND l.raw_ts + f.clock_offset BETWEEN {START} AND {END}""")
def range_window_controllers(spark, sf_dir):
    return Q.query(lines(spark, sf_dir), files(spark, sf_dir), START, END, controllers=["kernel", "tbox"], limit=None)


@query(f"""WITH {LINES}, {FILES} SELECT coalesce(sum(line_count), 0)::BIGINT AS estimated_lines FROM files WHERE raw_ts_max + clock_offset >= {START} AND raw_ts_min + clock_offset <= {END}""")
def estimate_rows(spark, sf_dir):
    return Q.estimate(files(spark, sf_dir), START, END)


UNDATED = f"""{LINES}, own AS (SELECT *, CASE WHEN line_no % 7 > 0 THEN raw_ts END AS t FROM lines),
meta AS (SELECT file_id, min(user_id) % 5 * 60.0 AS off, min(t) AS lo, max(t) AS hi FROM own GROUP BY file_id), met AS (SELECT * FROM meta WHERE hi + off >= {START} AND lo + off <= {END}),
reach AS (SELECT file_id, min(line_no) AS a, max(line_no) AS b FROM own JOIN met USING (file_id) WHERE floor(t / 300) BETWEEN floor(({START} - off) / 300) AND floor(({END} - off) / 300) + 1 GROUP BY file_id)"""


@query(f"""WITH {UNDATED} SELECT l.controller, l.file_id, l.file_id AS original_name, l.t + off AS aligned_ts, l.t AS raw_ts, l.line_no, l.text AS line, false AS clock_unaligned, false AS truncated
FROM own l JOIN met USING (file_id) LEFT JOIN reach USING (file_id) WHERE l.t + off BETWEEN {START} AND {END} OR l.t IS NULL AND l.line_no BETWEEN a AND b""")
def range_indexed(spark, sf_dir):
    """The window read by the bucket index of stored lines; a seventh of the lines has no time."""
    own = lines(spark, sf_dir).withColumn("raw_ts", F.when(F.col("line_no") % 7 > 0, F.col("raw_ts")))
    offset = own.groupBy("file_id").agg((F.min("user_id") % 5 * 60.0).alias("clock_offset"))
    meta = stage(own.groupBy("file_id", "bundle_id", "controller").agg(F.min("raw_ts").alias("valid_ts_min"), F.max("raw_ts").alias("valid_ts_max"), F.count(F.lit(1)).alias("line_count")).join(offset, "file_id"), "files")
    meta = meta.withColumns({"original_name": F.col("file_id"), "offset_method": F.lit("direct"), "unsynced": F.lit(None).cast("array<struct<start:long,end:long>>")})
    folder = shared_path(spark, "store")
    logstore.write(own, folder)
    return Q.query(logstore.window(spark, folder, meta, START, END, undated=True), meta, START, END, include_unsynced=True, limit=None)


@query(f"""WITH {LINES} SELECT bundle_id, file_id, controller, line_no, raw_ts, text FROM (SELECT *, concat('b', user_id % 20) AS bundle_id FROM lines) WHERE raw_ts >= {START} AND raw_ts < {END} AND bundle_id IN ('b2', 'b3')""")
def stored_lines_pushdown(spark, sf_dir):
    """Stored lines of two bundles and a day; bundle and times are pushed into the source."""
    own = lines(spark, sf_dir).withColumn("bundle_id", F.concat(F.lit("b"), (F.col("user_id") % 20).cast("string")))
    folder = shared_path(spark, "store")
    logstore.write(own, folder)
    return logstore.lines(spark, folder).filter(F.col("bundle_id").isin("b2", "b3") & (F.col("raw_ts") >= START) & (F.col("raw_ts") < END))


@query(f"""WITH {LINES} SELECT file_id, count(*) AS line_count, min(raw_ts) AS raw_ts_min, max(raw_ts) AS raw_ts_max, min(CASE WHEN raw_ts >= 1577923200 THEN raw_ts END) AS valid_ts_min, max(CASE WHEN raw_ts >= 1577923200 THEN raw_ts END) AS valid_ts_max FROM lines GROUP BY file_id""")
def file_stats(spark, sf_dir):
    return prescan.file_stats(lines(spark, sf_dir))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def events_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def files_by_group(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINES} SELECT event_type, controller, CASE WHEN line_no % 7 = 0 THEN NULL ELSE raw_ts END AS raw_timestamp, line_no FROM lines WHERE event_type IN ('error', 'signup') AND controller IN ('kernel', 'mcu')
""")
def events_filtered_nulls_last(spark, sf_dir):
    own = lines(spark, sf_dir).select("event_type", "controller", F.when(F.col("line_no") % 7 != 0, F.col("raw_ts")).alias("raw_timestamp"), "line_no")
    return Q.events(own, ["error", "signup"], ["kernel", "mcu"])


@query(f"""WITH {LINES} SELECT event_type, line_no, raw_ts FROM lines WHERE event_type = 'purchase' AND raw_ts >= {START} AND raw_ts <= {END}""")
def events_time_bounds(spark, sf_dir):
    return Q.events(lines(spark, sf_dir), ["purchase"], start=START, end=END, clock="raw_ts").select("event_type", "line_no", "raw_ts")


@query("""SELECT c_nationkey, round(avg(o_totalprice), 4) AS avg_price, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F') GROUP BY c_nationkey""")
def latest_group_avg(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    latest = orders.filter("o_orderstatus = 'F'").agg(F.max("o_orderdate").alias("o_orderdate"))  # one row
    own = orders.join(F.broadcast(latest), "o_orderdate").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return own.groupBy("c_nationkey").agg(F.round(F.avg("o_totalprice"), 4).alias("avg_price"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINES}, {FILES}, v AS (SELECT controller, CASE WHEN line_count % 3 = 0 THEN 1577836900.0 ELSE raw_ts_min + clock_offset END AS s, raw_ts_max + clock_offset AS e FROM files)
SELECT 'b' AS bundle_id, controller, min(s) AS valid_start, max(e) AS valid_end FROM v WHERE s >= 1577923200 AND e >= 1577923200 GROUP BY controller""")
def valid_range_by_group(spark, sf_dir):
    own = files(spark, sf_dir)
    sentinel = F.when(F.col("line_count") % 3 == 0, F.lit(1577836900.0) - F.col("clock_offset")).otherwise(F.col("raw_ts_min"))
    return Q.valid_ranges(own.withColumn("valid_ts_min", sentinel))


@query(f"""WITH {LINES}, b AS (SELECT file_id, line_no, floor(raw_ts / 300)::BIGINT AS bucket FROM lines WHERE raw_ts >= 1577923200), c AS (SELECT *, lag(bucket) OVER (PARTITION BY file_id ORDER BY line_no) AS before FROM b)
SELECT file_id, line_no, bucket FROM c WHERE before IS NULL OR before <> bucket""")
def bucket_transitions(spark, sf_dir):
    return prescan.bucket_transitions(lines(spark, sf_dir), size=SMALL).select("file_id", "line_no", "bucket")


@query("""WITH n AS (SELECT user_id, event_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
SELECT user_id, min(event_id) AS start, max(event_id) AS "end", count(*) AS lines FROM n WHERE bad GROUP BY user_id, run""")
def unsynced_ranges(spark, sf_dir):
    return prescan.runs(table(spark, sf_dir, "events"), F.col("event_type") == "error", "user_id", "event_id", SMALL)


@query("""WITH r AS (SELECT o_custkey, epoch(o_orderdate) AS s, epoch(o_orderdate) + 86400.0 * (o_orderkey % 90) AS e FROM orders),
w AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM w)
SELECT o_custkey, min(s) AS s, max(e) AS e FROM i GROUP BY o_custkey, isle""")
def merge_ranges(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_custkey", epoch(F.col("o_orderdate")).alias("s"), (epoch(F.col("o_orderdate")) + 86400.0 * (F.col("o_orderkey") % 90)).alias("e"))
    return prescan.merged_ranges(own, "o_custkey", "s", "e")


@query("""WITH t AS (SELECT user_id, event_id, value, CASE WHEN event_type = 'signup' THEN epoch(ts) - value END AS sync, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN value < before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS seq_no FROM t)
SELECT user_id, seq_no::INT AS seq_no, min(event_id) AS line_start, max(event_id) + 1 AS line_end, min(value) AS raw_ts_min, max(value) AS raw_ts_max, arg_min(sync, event_id) AS clock_offset,
CASE WHEN arg_min(sync, event_id) IS NULL THEN 0.0 ELSE 0.95 END::DOUBLE AS offset_confidence FROM s GROUP BY user_id, seq_no""")
def boot_segments(spark, sf_dir):
    sync = F.when(F.col("event_type") == "signup", epoch(F.col("ts")) - F.col("value"))
    return prescan.segments(table(spark, sf_dir, "events"), F.col("value"), sync, "user_id", "event_id", SMALL)


@query("""WITH t AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN value < before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS seq_no FROM t),
g AS (SELECT user_id, seq_no, min(event_id) AS line_start, max(event_id) + 1 AS line_end FROM s GROUP BY user_id, seq_no)
SELECT e.user_id::VARCHAR AS file_id, e.event_id AS line_no, g.seq_no::INT AS seq_no FROM events e JOIN g ON e.user_id = g.user_id AND e.event_id >= g.line_start AND e.event_id < g.line_end WHERE e.event_type = 'error'""")
def line_in_segment(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_id"), F.col("event_id").alias("line_no"), "value", "event_type")
    segs = prescan.segments(own, F.col("value"), F.lit(None).cast("double"), size=SMALL)
    return prescan.in_segment(own.filter("event_type = 'error'"), segs, SMALL).select("file_id", "line_no", "seq_no")


@query("""WITH s AS (SELECT user_id, event_id, epoch(ts) AS boot, value, lead(epoch(ts)) OVER (PARTITION BY user_id ORDER BY epoch(ts)) AS next_boot FROM events WHERE event_type = 'signup')
SELECT user_id, event_id, boot, next_boot FROM s WHERE value < 90 AND next_boot - boot < 90000""")
def suspected_crash_pairs(spark, sf_dir):
    own = lines(spark, sf_dir).filter("event_type = 'signup'").select("user_id", F.col("line_no").alias("event_id"), F.col("line_no").cast("string").alias("file_id"), F.col("raw_ts").alias("boot"), "value")
    captures = own.select("file_id", F.col("value").alias("raw_ts_max"))
    return prescan.suspected_crashes(own, captures, 90, 90000, "user_id", "boot").select("user_id", "event_id", "boot", "next_boot")


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type <> 'view' THEN epoch(ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""")
def forward_fill(spark, sf_dir):
    own = lines(spark, sf_dir).select("user_id", F.col("line_no").alias("event_id"), F.when(F.col("event_type") != "view", F.col("raw_ts")).alias("t"))
    return prescan.forward_filled(own, "user_id", "event_id", "t", SMALL).drop("t")


@query(f"""WITH f AS (SELECT user_id, event_id, last_value(CASE WHEN event_type <> 'view' THEN epoch(ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events),
n AS (SELECT *, coalesce(filled BETWEEN {START} - 60 AND {START} + 3600, false) AS near FROM f), k AS (SELECT *, NOT bool_or(near) OVER (PARTITION BY user_id) AS fallback FROM n)
SELECT user_id, event_id, filled, fallback FROM k WHERE near OR fallback QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 20""")
def forward_fill_clip(spark, sf_dir):
    own = lines(spark, sf_dir).select("user_id", F.col("line_no").alias("event_id"), F.when(F.col("event_type") != "view", F.col("raw_ts")).alias("t"))
    # The feature keeps a number of lines of each log: twenty here, so that the cut falls in most of them.
    return prescan.clip(own, START, 60, 3600, 20, "user_id", "event_id", "t", SMALL).select("user_id", "event_id", "filled", "fallback")


def _anchors(spark, sf_dir) -> DataFrame:
    """Anchors of twenty bundles; b3 has none of tbox, b4 none of tbox and android, and those of mcu in b5 are not usable."""
    own = lines(spark, sf_dir).withColumn("bundle_id", F.concat(F.lit("b"), (F.col("user_id") % 20).cast("string")))
    own = own.filter("not (controller = 'tbox' and bundle_id in ('b3', 'b4')) and not (controller = 'android' and bundle_id = 'b4')")
    ts = F.when((F.col("controller") == "mcu") & (F.col("bundle_id") == "b5"), F.lit(0.0)).otherwise(F.col("raw_ts"))
    return own.select("bundle_id", "file_id", "controller", F.concat(F.lit("k"), (F.col("value") % 3).cast("int").cast("string")).alias("anchor_type"), ts.alias("raw_timestamp"), "line_no", (0.55 + F.col("line_no") % 10 * 0.05).alias("confidence"))


ANCHORS = f"""{LINES}, anchors AS (SELECT * FROM (SELECT concat('b', user_id % 20) AS bundle_id, controller, concat('k', trunc(value % 3)::INT) AS anchor_type,
  CASE WHEN controller = 'mcu' AND user_id % 20 = 5 THEN 0.0 ELSE raw_ts END AS t, 0.55::DOUBLE + (line_no % 10) * 0.05::DOUBLE AS c FROM lines)
  WHERE NOT (controller = 'tbox' AND bundle_id IN ('b3', 'b4')) AND NOT (controller = 'android' AND bundle_id = 'b4'))"""


def _walk(name: str, source: str, base: str) -> str:
    """SQL of the walk itself: source after source takes the nearer free one of the two base times around it."""
    return f"""{name}_s AS (SELECT bundle_id, controller, anchor_type, win, list({{'t': t, 'c': c}} ORDER BY t, c) AS st FROM ({source}), (VALUES (60.0::DOUBLE), (600.0::DOUBLE)) w(win) GROUP BY ALL),
{name}_b AS (SELECT bundle_id, anchor_type, list({{'t': t, 'c': c}} ORDER BY t, c) AS bt FROM ({base}) GROUP BY ALL),
{name}_w AS (SELECT s.*, b.bt, 0 AS i, []::BIGINT[] AS used, NULL::BIGINT AS j FROM {name}_s s JOIN {name}_b b USING (bundle_id, anchor_type)
  UNION ALL SELECT bundle_id, controller, anchor_type, win, st, bt, i + 1, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, got FROM (
    SELECT *, CASE WHEN abs(bt[best].t - st[i + 1].t) <= win THEN best END AS got FROM (
      SELECT *, CASE WHEN len(cand) = 2 AND abs(bt[cand[2]].t - st[i + 1].t) < abs(bt[cand[1]].t - st[i + 1].t) THEN cand[2] ELSE cand[1] END AS best FROM (
        SELECT *, list_filter([before, before + 1], lambda x: x >= 1 AND x <= len(bt) AND NOT list_contains(used, x)) AS cand FROM (
          SELECT *, len(list_filter(bt, lambda x: x.t < st[i + 1].t)) AS before FROM {name}_w WHERE i < len(st)))))),
{name} AS (SELECT bundle_id, controller, anchor_type, win, st[i].t AS source_ts, bt[j].t AS base_ts, greatest(st[i].c * bt[j].c, 1e-6) AS weight FROM {name}_w WHERE j IS NOT NULL)"""


@query(f"""WITH RECURSIVE {ANCHORS}, {_walk('pairs', "SELECT * FROM anchors WHERE controller <> 'tbox'", "SELECT * FROM anchors WHERE controller = 'tbox'")}
SELECT bundle_id, controller, anchor_type, win AS "window", source_ts, base_ts, round(weight, 9) AS weight FROM pairs""")
def anchor_pairs_greedy(spark, sf_dir):
    own = _anchors(spark, sf_dir)
    base = own.filter("controller = 'tbox'").select("bundle_id", "anchor_type", "raw_timestamp", "confidence")
    found = align.anchor_pairs(own.filter("controller <> 'tbox'").select("bundle_id", "controller", "anchor_type", "raw_timestamp", "confidence"), base)
    return found.withColumn("weight", F.round("weight", 9))


def _offsets_sql(name: str, pairs: str) -> str:
    """SQL of offset, confidence and number of the pairs of the window chosen for each controller."""
    return f"""{name}_m AS (SELECT bundle_id, controller, win, count(*) AS n, sum(weight * (base_ts - source_ts)) / sum(weight) AS m, avg(weight) AS aw FROM {pairs} GROUP BY ALL),
{name}_d AS (SELECT p.bundle_id, p.controller, win, any_value(n) AS n, any_value(m) AS m, any_value(aw) AS aw, CASE WHEN any_value(n) < 2 THEN 0 ELSE sqrt(sum(weight * (base_ts - source_ts - m) ** 2) / sum(weight)) END AS sd FROM {pairs} p JOIN {name}_m USING (bundle_id, controller, win) GROUP BY ALL),
{name} AS (SELECT bundle_id, controller, n, m AS off, greatest(0, least(1, least(n / 2, 1) * sqrt(aw) * CASE WHEN sd <= 5 THEN 1 ELSE greatest(0.6, 1 - 0.4 * least((sd - 5) / 25, 1)) END)) AS conf FROM {name}_d
  QUALIFY row_number() OVER (PARTITION BY bundle_id, controller ORDER BY CASE WHEN win = 60 AND n >= 3 THEN 1000000000 ELSE n END DESC, win) = 1)"""


@query(f"""WITH RECURSIVE {ANCHORS}, clean AS (SELECT * FROM anchors WHERE t >= 1577923200),
bases AS (SELECT bundle_id, CASE WHEN bool_or(controller = 'tbox') THEN 'tbox' WHEN bool_or(controller = 'android') THEN 'android' END AS base FROM clean GROUP BY bundle_id),
known AS (SELECT * FROM clean JOIN bases USING (bundle_id)), {_walk('one', "SELECT * FROM known WHERE controller <> base", "SELECT * FROM known WHERE controller = base")}, {_offsets_sql('direct', 'one')},
bridge AS (SELECT bundle_id, off AS b_off, conf AS b_conf FROM direct WHERE controller = 'android' AND conf >= 0.6),
weak AS (SELECT k.* FROM known k LEFT JOIN direct d ON d.bundle_id = k.bundle_id AND d.controller = k.controller WHERE k.controller NOT IN (k.base, 'android') AND coalesce(d.conf, 0) < 0.7),
{_walk('two', "SELECT * FROM weak", "SELECT * FROM known WHERE controller = 'android' AND base <> 'android'")}, {_offsets_sql('over', 'two')},
hop AS (SELECT o.bundle_id, controller, b_off + off AS h_off, conf * b_conf * 0.95::DOUBLE AS h_conf, n AS h_n FROM over o JOIN bridge USING (bundle_id)),
seen AS (SELECT bundle_id, controller, count(*) AS anchors FROM clean GROUP BY ALL),
p AS (SELECT q.bundle_id, q.controller, base, coalesce(q.controller = base, false) AS is_base, off, conf, n, h_off, h_conf, h_n, anchors, coalesce(h_conf > coalesce(conf, 0), false) AS better
  FROM (SELECT DISTINCT bundle_id, controller FROM anchors) q LEFT JOIN bases USING (bundle_id) LEFT JOIN direct USING (bundle_id, controller) LEFT JOIN hop USING (bundle_id, controller) LEFT JOIN seen USING (bundle_id, controller)),
r AS (SELECT bundle_id, controller, base, CASE WHEN is_base THEN 0.0 WHEN better THEN h_off ELSE off END AS "offset", CASE WHEN is_base THEN 1.0 WHEN better THEN h_conf ELSE coalesce(conf, 0) END AS confidence,
  CASE WHEN is_base THEN 'none' WHEN better THEN 'two_hop' WHEN off IS NOT NULL THEN 'direct' ELSE 'none' END AS method, CASE WHEN is_base THEN coalesce(anchors, 0) WHEN better THEN h_n ELSE coalesce(n, 0) END AS n,
  concat_ws('; ', CASE WHEN base = 'android' THEN 'no usable anchors of tbox: android is the base clock' END, CASE WHEN base IS NULL THEN 'no usable anchors of tbox or android: not aligned' END, CASE WHEN base IS NOT NULL AND NOT is_base AND anchors IS NULL THEN concat(controller, ': no usable anchors') END) AS warnings FROM p),
t AS (SELECT bundle_id, any_value(base) AS base, count(*) FILTER (WHERE coalesce(controller <> base, true)) AS targets, count(*) FILTER (WHERE coalesce(controller <> base, true) AND "offset" IS NOT NULL) AS placed,
  count(*) FILTER (WHERE coalesce(controller <> base, true) AND "offset" IS NOT NULL AND confidence >= 0.8) AS sure FROM r GROUP BY bundle_id)
SELECT bundle_id, controller, r.base, round("offset", 6) AS "offset", round(confidence, 6) AS confidence, method, n, warnings, CASE WHEN t.base IS NULL THEN 'failed' WHEN sure = targets AND t.base = 'tbox' THEN 'success' WHEN placed >= greatest(1, ceil(targets * 0.5)) OR sure = targets THEN 'partial' ELSE 'failed' END AS status
FROM r JOIN t USING (bundle_id)""")
def alignment_status(spark, sf_dir):
    own = _anchors(spark, sf_dir)
    found = align.align(own, own.select("bundle_id", "controller").distinct())
    return found.withColumns({"offset": F.round("offset", 6), "confidence": F.round("confidence", 6), "warnings": F.array_join("warnings", "; ")})


@query("""WITH p AS (SELECT o_orderpriority AS k, (o_totalprice % 40) - 20 AS d, 0.5 + (o_orderkey % 5) / 10.0 AS w FROM orders), m AS (SELECT k, count(*) AS n, sum(w * d) / sum(w) AS m, avg(w) AS aw FROM p GROUP BY k),
s AS (SELECT p.k, any_value(m.n) AS n, any_value(m.m) AS m, any_value(m.aw) AS aw, sqrt(sum(w * (d - m.m) ** 2) / sum(w)) AS sd FROM p JOIN m USING (k) GROUP BY p.k)
SELECT k, n, round(m, 6) AS "offset", round(sd, 6) AS stdev, round(greatest(0, least(1, least(n / 2, 1) * sqrt(aw) * CASE WHEN sd <= 5 THEN 1 ELSE greatest(0.6, 1 - 0.4 * least((sd - 5) / 25, 1)) END)), 6) AS confidence FROM s""")
def offset_confidence(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), F.lit(0.0).alias("source_ts"), (F.col("o_totalprice") % 40 - 20).alias("base_ts"), (0.5 + F.col("o_orderkey") % 5 / 10.0).alias("weight"))
    out = align.offsets(own, "k")
    return out.select("k", "n", *(F.round(c, 6).alias(c) for c in ("offset", "stdev", "confidence")))


def _texts(spark, sf_dir) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "tbox").when(F.col("role") == "assistant", "android").otherwise("kernel")
    return said.select(F.lit("b").alias("bundle_id"), F.col("conv_id").cast("string").alias("file_id"), kind.alias("controller"), F.col("turn").alias("line_no"), F.lit(None).cast("double").alias("raw_ts"), "text")


#: Rules over the words of the tables, in place of those of vehicle logs.
WORD_RULES = (
    R.Rule("starts", R.ALL, (r"(?i)\b(the|le|der)\b",), fields={"first": r"^(\w+)"}),
    R.Rule("longer", R.ALL, any_words=("with that", "the")),
    R.Rule("both", ("android", "tbox"), all_words=("and", "of")),
)


@query(r"""WITH t AS (SELECT conv_id::VARCHAR AS file_id, turn AS line_no, text, CASE role WHEN 'user' THEN 'tbox' WHEN 'assistant' THEN 'android' ELSE 'kernel' END AS controller FROM conversations WHERE length(text) > 0),
g AS (SELECT file_id, controller, line_no, text, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '(?i)(\b(?:the|le|der)\b)|(with that|the)', 1)) AS word FROM t)
SELECT file_id, controller, line_no, CASE WHEN coalesce(word, '') <> '' THEN 'starts' ELSE 'longer' END AS event_type, CASE WHEN coalesce(word, '') <> '' THEN nullif(regexp_extract(text, '^(\w+)', 1), '') END AS first FROM g
UNION ALL SELECT file_id, controller, line_no, 'both', NULL FROM t WHERE controller IN ('android', 'tbox') AND contains(lower(text), 'and') AND contains(lower(text), 'of')""")
def rule_hits_events(spark, sf_dir):
    return prescan.rule_events(_texts(spark, sf_dir), WORD_RULES).select("file_id", "controller", "line_no", "event_type", F.col("extracted_fields")["first"].alias("first"))


@query("""SELECT conv_id, turn, len(regexp_extract_all(text, '(?i)(?:the|and|of)'))::BIGINT AS n FROM conversations WHERE len(regexp_extract_all(text, '(?i)(?:the|and|of)')) > 0""")
def rule_hits_count(spark, sf_dir):
    rule = (R.Rule("words", ("x",), (r"(?i)(?:the|and|of)",)),)
    own = table(spark, sf_dir, "conversations").withColumn("n", F.size(R.hits(rule, "x", F.col("text"))).cast("long"))
    return own.filter("n > 0").select("conv_id", "turn", "n")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def rule_field_extract(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"))
    return own.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?i) panic |(?i) qui ') OR NOT ((role = 'user' AND regexp_matches(text, '(?i) the ')) OR (role = 'assistant' AND regexp_matches(text, '(?i) (?:de|der) ')))""")
def slim_filter(spark, sf_dir):
    keeps = R.slim_keeps(F.col("role"), F.col("text"), {"user": ("(?i) the ",), "assistant": ("(?i) (?:de|der) ",)}, ("(?i) panic ", "(?i) qui "))
    return table(spark, sf_dir, "conversations").filter(keeps).select("conv_id", "turn")


@query(r"""WITH p AS (SELECT page_id, url, strpos(html, '</article>') AS ends, html FROM pages), s AS (SELECT page_id, url, ends > 0 AND octet_length(encode(left(html, (ends + 9)::INT))) <= 8192 AS sniffed FROM p)
SELECT page_id, CASE WHEN regexp_matches(url, '^.*fr/[^/]*$') THEN 'tbox' WHEN regexp_matches(url, '^.*en/.*$') THEN 'mcu' WHEN regexp_matches(url, '^https:.*page=.*$') THEN 'tbox' WHEN sniffed THEN 'mcu' ELSE 'unknown' END AS controller FROM s""")
def classify_priority(spark, sf_dir):
    """By path, then by name, then by the first 8,192 bytes: an article that ends behind them is not seen."""
    rules = (R.FileRule("tbox", ("**/fr/*",), ("https:**page=**",), ()), R.FileRule("mcu", ("**/en/**",), (), ("</article>",)))
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", R.classify(F.col("url"), F.col("url"), F.encode(F.col("html"), "UTF-8"), rules).alias("controller"))


@query("""SELECT doc_id, sha256(text) AS sha FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def dedup_first_seen(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return services.first_seen(own, F.col("sha"), "doc_id")


@query(r"""WITH t AS (SELECT doc_id, concat(text, ' 京A', lpad((doc_id % 100000)::VARCHAR, 5, '0'), ' 粤B', lpad((doc_id % 7919)::VARCHAR, 5, 'K'), '挂 沪I1') AS text FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-HJ-NPR-Z0-9]{17}', '[REDACTED_VIN]', 'g'), '1[3-9]\d{9}', '[REDACTED_PHONE]', 'g'), '[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁使领][A-Z][A-HJ-NP-Z0-9]{4,5}[A-HJ-NP-Z0-9挂学警港澳试超]', '[REDACTED_PLATE]', 'g')) AS sha,
len(regexp_extract_all(text, '[京粤][AB]'))::INT AS plates FROM t""")
def redact_text(spark, sf_dir):
    number = lambda n, fill: F.lpad((F.col("doc_id") % n).cast("string"), 5, fill)
    text = F.concat("text", F.lit(" 京A"), number(100000, "0"), F.lit(" 粤B"), number(7919, "K"), F.lit("挂 沪I1"))
    own = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return own.select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("sha"), F.size(F.regexp_extract_all("text", F.lit("[京粤][AB]"), F.lit(0))).alias("plates"))


TERMS = r"""found AS MATERIALIZED (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[a-z][a-z0-9_\-]*(?:\.[a-z0-9]+)*') AS l FROM documents),
terms AS (SELECT doc, unnest(l) AS term, len(l) AS total FROM found),
counts AS MATERIALIZED (SELECT doc, term, total, count(*) AS count FROM terms GROUP BY ALL)"""


@query(f"WITH {TERMS} SELECT term, sum(count)::BIGINT AS n, count(*) AS df FROM counts GROUP BY term")
def tokenize_terms(spark, sf_dir):
    counts = retrieval.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return counts.groupBy("term").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("df"))


@query(f"WITH {TERMS} SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1, 8) AS idf FROM counts GROUP BY term")
def idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = retrieval.idf(retrieval.term_counts(docs, "doc_id", "text"), F.lit(docs.count()))
    return out.withColumn("idf", F.round("idf", 8))


ASK = "the attion of queaux und nowhere"


@query(f"""WITH {TERMS}, w AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM counts GROUP BY term),
q AS (SELECT term, count(*) / 6.0 * coalesce(any_value(idf), 1.0) AS q FROM (SELECT unnest(string_split('{ASK}', ' ')) AS term) LEFT JOIN w USING (term) GROUP BY term),
d AS (SELECT doc, sqrt(sum((count / total * idf) ** 2)) AS norm, sum(count / total * idf * q) AS dot FROM counts JOIN w USING (term) LEFT JOIN q USING (term) GROUP BY doc)
SELECT doc, round(dot / (norm * (SELECT sqrt(sum(q * q)) FROM q)), 4) AS score FROM d WHERE dot / (norm * (SELECT sqrt(sum(q * q)) FROM q)) >= 0.05 ORDER BY score DESC, doc LIMIT 20""")
def tfidf_topk(spark, sf_dir):
    return retrieval.tfidf_topk(table(spark, sf_dir, "documents"), ASK, 20, 0.05)


@query(SQL["tfidf_topk"])
def tfidf_indexed(spark, sf_dir):
    """The same answer from a stored index: the postings of the query's terms, in blocks that can hold one of the best."""
    folder = shared_path(spark, "terms")
    search_index.index_terms(table(spark, sf_dir, "documents"), folder, block=64)
    return search_index.search_terms(spark, folder, ASK, 20, 0.05)


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q)
SELECT vec_id, round(s, 4) AS score FROM s WHERE s >= 0.1 ORDER BY score DESC, vec_id LIMIT 10""")
def cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.filter("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    scored = vectors.crossJoin(F.broadcast(first)).withColumn("_s", T.cosine(F.col("embedding"), F.col("q")))
    return scored.filter("_s >= 0.1").select("vec_id", F.round("_s", 4).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query(SQL["cosine_topk"])
def cosine_indexed(spark, sf_dir):
    """The same answer from stored cells: those whose centre and radius allow one of the best."""
    vectors = table(spark, sf_dir, "embeddings")
    folder = shared_path(spark, "vectors")
    search_index.index_vectors(vectors, folder)
    asked = vectors.filter("vec_id = 0").select(F.col("embedding").cast("array<double>")).first()[0]  # one row
    return search_index.search_vectors(spark, folder, asked, 10, 0.1).withColumnRenamed("key", "vec_id")


def _chunks(spark, sf_dir, chunks: Column) -> DataFrame:
    return retrieval.chunk_table(table(spark, sf_dir, "documents").filter("length(text) > 0"), chunks, "doc_id")


def _merged_sql(pieces: str) -> str:
    """SQL of chunks from pieces (doc, i, piece, start, stop): a short one is joined to the chunk before it, and dropped where there is none."""
    blank = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return f"""{pieces}, bare AS (SELECT *, regexp_replace(piece, '^{blank}+|{blank}+$', '', 'g') AS bare FROM pieces), runs AS (SELECT *, sum((length(bare) >= 50)::INT) OVER (PARTITION BY doc ORDER BY i) AS run FROM bare)
SELECT doc, (run - 1)::INT AS idx, concat(doc, '_', run - 1) AS chunk_id, string_agg(bare, chr(10) ORDER BY i) AS text, min(start)::INT AS start, arg_max(stop, i)::INT AS stop FROM runs WHERE run > 0 GROUP BY doc, run"""


@query(_merged_sql(r"""WITH pieces AS (SELECT doc_id AS doc, i, substring(text, (i * 500 + 1)::INT, 500) AS piece, i * 500 AS start, least(i * 500 + 500, length(text)) AS stop FROM documents, unnest(range(0, (greatest(length(text) - 1, 0) // 500 + 1)::BIGINT)) AS t(i) WHERE length(text) > 0)"""))
def chunk_fixed(spark, sf_dir):
    return _chunks(spark, sf_dir, T.chunk_fixed(F.col("text")))


@query(_merged_sql(r"""WITH pieces AS (SELECT * FROM (SELECT doc_id AS doc, i, substring(text, (i * 420 + 1)::INT, 500) AS piece, i * 420 AS start, least(i * 420 + 500, length(text)) AS stop
FROM documents, unnest(range(0, (greatest(ceil((length(text) - 500) / 420.0), 0) + 1)::BIGINT)) AS t(i) WHERE length(text) > 0) WHERE length(piece) >= 50)"""))
def chunk_sliding(spark, sf_dir):
    return _chunks(spark, sf_dir, T.chunk_sliding(F.col("text"), 500, 80))


@query(_merged_sql(r"""WITH RECURSIVE parts AS (SELECT doc_id AS doc, list_filter(list_transform(string_split_regex(regexp_replace(text, '[.] ', '.' || chr(10) || chr(9) || chr(10), 'g'), '\n[ \t\n\x0B\f\r]*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents WHERE length(text) > 0),
walk AS (SELECT doc, ps, 0 AS i, 0 AS k, 0 AS held, 0 AS place, 0 AS start FROM parts
  UNION ALL SELECT doc, ps, i + 1, CASE WHEN fits THEN k ELSE k + 1 END, CASE WHEN fits AND held > 0 THEN held + 2 + n ELSE n END, place + n + 2, CASE WHEN fits AND held > 0 THEN start ELSE place END
  FROM (SELECT *, length(ps[i + 1]) AS n, held = 0 OR held + length(ps[i + 1]) + 1 <= 500 AS fits FROM walk WHERE i < len(ps))),
pieces AS (SELECT doc, k AS i, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS piece, min(start) AS start, min(start) + length(string_agg(ps[i], chr(10) || chr(10) ORDER BY i)) AS stop FROM walk WHERE i > 0 GROUP BY doc, k)"""))
def chunk_paragraph(spark, sf_dir):
    """Sentences play paragraphs: the documents have no blank lines."""
    return _chunks(spark, sf_dir, T.chunk_paragraphs(F.regexp_replace("text", "[.] ", ".\n\t\n")))


@query(r"SELECT conv_id, turn, sha256(concat(role, '|', lower(regexp_replace(text, '^\s+|\s+$', '', 'g')))) AS query_hash FROM conversations")
def query_hash_cache(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.query_key(F.col("role"), F.col("text")).alias("query_hash"))


def _cache(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "conversations")
    return own.select(F.col("role").alias("query_hash"), F.col("text").alias("response_text"), F.when(F.col("turn") % 2 == 0, "a").otherwise("b").alias("cache_type"), (F.col("conv_id") * 100 + F.col("turn")).cast("double").alias("created_at"), F.when(F.col("conv_id") % 3 > 0, F.col("conv_id") * 50.0).alias("expires_at"), (F.col("turn") % 4).cast("int").alias("hit_count"))


CACHE = "cache AS (SELECT role AS query_hash, text AS response_text, CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END AS cache_type, (conv_id * 100 + turn)::DOUBLE AS created_at, CASE WHEN conv_id % 3 > 0 THEN conv_id * 50.0 END AS expires_at, (turn % 4)::INT AS hit_count FROM conversations)"


@query(f"WITH {CACHE} SELECT query_hash, cache_type, created_at FROM cache WHERE query_hash = 'user' AND cache_type = 'a' AND (expires_at IS NULL OR expires_at > 1000) ORDER BY created_at DESC LIMIT 1")
def cache_latest_valid(spark, sf_dir):
    return services.cache_get(_cache(spark, sf_dir), "user", "a", F.lit(1000.0)).select("query_hash", "cache_type", "created_at")


@query(f"WITH {CACHE} SELECT count(*) AS entries, sum(hit_count)::BIGINT AS hits, sum(CASE WHEN expires_at <= 1000 THEN 1 END)::BIGINT AS expired, avg(hit_count) AS avg_hits FROM cache")
def cache_stats(spark, sf_dir):
    return services.cache_stats(_cache(spark, sf_dir), F.lit(1000.0))


@query(f"""WITH {CACHE}, k AS (SELECT * REPLACE (concat(query_hash, '_', (created_at % 50)::INT) AS query_hash) FROM cache), n AS (SELECT * FROM k WHERE cache_type = 'a' UNION ALL SELECT query_hash, response_text, cache_type, created_at, expires_at, 0 FROM k WHERE cache_type = 'b')
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_hash ORDER BY created_at DESC) = 1""")
def cache_upsert(spark, sf_dir):
    own = _cache(spark, sf_dir).withColumn("query_hash", F.concat_ws("_", "query_hash", (F.col("created_at") % 50).cast("int").cast("string")))
    return services.cache_upsert(own.filter("cache_type = 'a'"), own.filter("cache_type = 'b'"))


@query("SELECT count(*) AS total, sum((quality = 1)::INT)::BIGINT AS n_1, sum((quality = 0)::INT)::BIGINT AS n_0, round(avg(toxic), 3) AS avg_confidence FROM labels")
def feedback_stats(spark, sf_dir):
    own = table(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("string"))
    return services.feedback_stats(own, "quality", "toxic", ["1", "0"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def case_page(spark, sf_dir):
    own = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return services.page(own, [F.desc("c_acctbal"), F.col("c_custkey")], 40, 20).select("c_custkey", "c_name")


@query("SELECT conv_id, sha256(string_agg(concat(role, ':', text), '\n' ORDER BY turn)) AS sha, count(*) AS turn_count FROM conversations GROUP BY conv_id")
def session_transcripts(spark, sf_dir):
    out = services.transcripts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    return out.select("conv_id", F.sha2(joined, 256).alias("sha"), "turn_count")


@query(r"""WITH m AS (SELECT conv_id, arg_min(trim(regexp_replace(text, '\s+', ' ', 'g')), turn) AS t FROM conversations WHERE role = 'user' AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(t) > 18 THEN concat(left(t, 18), '...') ELSE t END AS title FROM m""")
def session_titles(spark, sf_dir):
    return services.session_titles(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


EVAL = r"""judged AS (SELECT b.item_id AS case_id, lower(concat(' ', coalesce(d.text, ''))) AS text, string_split(lower(b.text), ' ') AS kw, list_distinct(regexp_extract_all(lower(b.text), '[\pL\pM\pN_]+')) AS rc,
  d.doc_id IS NOT NULL AS has FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id),
parts AS (SELECT case_id, len([w for w in kw if contains(text, w)]) / greatest(len(kw), 1) AS k, CASE WHEN len(rc) > 0 THEN len(list_intersect(rc, regexp_extract_all(text, '[\pL\pM\pN_]+'))) / len(rc) ELSE 0 END AS r, CASE WHEN has AND case_id % 3 > 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS c,
  len([w for w in kw[1:3] if contains(text, w)]) / greatest(len(kw[1:3]), 1) AS e, len([w for w in kw[6:20:2] if contains(text, w)]) / greatest(len(kw[6:20:2]), 1) AS s FROM judged),
rounded AS (SELECT case_id, round(k, 3) AS k, round(r, 3) AS r, c, round(e, 3) AS e, round(s, 3) AS s FROM parts),
scores AS (SELECT case_id, k AS keyword_score, e AS ecu_score, s AS stage_score, r AS root_cause_score, c AS confidence_score, round(total::DECIMAL(18, 12), 3)::DOUBLE AS total_score, total >= 0.6 AS passed FROM (SELECT *, k * 0.25::DOUBLE + e * 0.2::DOUBLE + s * 0.2::DOUBLE + r * 0.25::DOUBLE + c * 0.1::DOUBLE AS total FROM rounded))"""


@query(f"WITH {EVAL} SELECT * FROM scores")
def eval_scores(spark, sf_dir):
    return services.evaluate(*_eval(spark, sf_dir))


def _eval(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    words = F.split(F.lower("text"), " ")
    odd = F.filter(F.slice(words, 6, 15), lambda w, i: i % 2 == 0)
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), words.alias("expected_keywords"), F.slice(words, 1, 3).alias("expected_ecus"), odd.alias("expected_fota_stages"), F.col("text").alias("expected_root_cause"), F.lit("high").alias("expected_confidence"))
    outputs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit("").alias("summary"), F.col("text").alias("detail"), F.when(F.col("doc_id") % 3 > 0, "high").otherwise("low").alias("confidence"))
    return cases, outputs


@query(f"""WITH {EVAL} SELECT count(*) AS cases, sum(passed::INT)::BIGINT AS passed, round(avg(keyword_score), 3) AS avg_keyword_score, round(avg(ecu_score), 3) AS avg_ecu_score, round(avg(stage_score), 3) AS avg_stage_score,
round(avg(root_cause_score), 3) AS avg_root_cause_score, round(avg(confidence_score), 3) AS avg_confidence_score, round(avg(total_score), 3) AS avg_total_score FROM scores""")
def eval_report(spark, sf_dir):
    return services.report(services.evaluate(*_eval(spark, sf_dir)))


@query("""WITH v AS (SELECT c_nationkey, avg(CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 2 ELSE 1 END) AS m FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, CASE WHEN m >= 2.5 THEN 'high' WHEN m >= 1.5 THEN 'medium' ELSE 'low' END AS vote FROM v""")
def confidence_vote(spark, sf_dir):
    level = F.when(F.col("c_mktsegment") == "BUILDING", "high").when(F.col("c_mktsegment") == "MACHINERY", "medium").otherwise("low")
    return services.confidence_vote(table(spark, sf_dir, "customer").withColumn("level", level), "c_nationkey", "level")


@query("""WITH c AS (SELECT source AS agent, doc_id AS seq, CASE WHEN doc_id % 11 <> 0 THEN left(text, 12) END AS title FROM documents), k AS (SELECT DISTINCT left(text, 12) AS title FROM benchmark)
SELECT agent, seq, 'missing field' AS warning FROM c WHERE title IS NULL UNION ALL SELECT agent, seq, 'unknown title' FROM c WHERE title IS NOT NULL AND title NOT IN (SELECT title FROM k)
UNION ALL SELECT agent, seq, 'repeated title' FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY seq) AS n FROM c WHERE title IS NOT NULL) WHERE n > 1 UNION ALL SELECT 'nobody', NULL, 'no source'""")
def citation_checks(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("source").alias("agent"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 11 != 0, F.left("text", F.lit(12))).alias("title"), F.lit("x").alias("source"))
    known = table(spark, sf_dir, "benchmark").select(F.left("text", F.lit(12)).alias("title")).distinct()
    agents = own.select("agent").distinct().unionByName(spark.createDataFrame([("nobody",)], "agent string"))  # one more row
    return services.citation_warnings(own, known, agents)


@query(f"""WITH {LINES}, w AS (SELECT min(raw_ts) AS s, max(raw_ts) AS e FROM lines), r AS (SELECT controller, floor((raw_ts - s) / (e - s) * 100 / 3.0)::BIGINT AS slot, event_type, raw_ts FROM lines, w),
n AS (SELECT *, row_number() OVER (PARTITION BY controller, slot ORDER BY raw_ts, event_type) AS i, count(*) OVER (PARTITION BY controller, slot) AS n FROM r)
SELECT controller, slot, n, string_agg(event_type, ',' ORDER BY i) AS types FROM n WHERE i <= 3 GROUP BY ALL""")
def event_density_lanes(spark, sf_dir):
    own = lines(spark, sf_dir)
    w = own.agg(F.min("raw_ts").alias("s"), F.max("raw_ts").alias("e"))  # one row
    return services.density(own.crossJoin(F.broadcast(w)), "controller", "raw_ts", "event_type", F.col("s"), F.col("e")).withColumn("types", F.array_join("types", ","))


@query(f"""WITH {LINES}, w AS (SELECT min(raw_ts) AS s, max(raw_ts) AS e FROM lines) SELECT file_id, round((min(raw_ts) - any_value(s)) / (any_value(e) - any_value(s)) * 100, 6) AS from_pct, round((max(raw_ts) - any_value(s)) / (any_value(e) - any_value(s)) * 100, 6) AS to_pct FROM lines, w GROUP BY file_id""")
def lane_ranges(spark, sf_dir):
    out = services.lanes(lines(spark, sf_dir), "file_id", "raw_ts", "raw_ts")
    return out.select("file_id", F.round("from_pct", 6).alias("from_pct"), F.round("to_pct", 6).alias("to_pct"))


DIMENSION = [("view", "display", 1), ("click", "input", 1), ("error", "fault", 3), ("purchase", "trade", 2)]


@query(f"""SELECT category, severity, count(*) AS n FROM events LEFT JOIN (VALUES {', '.join(map(str, DIMENSION))}) d(event_type, category, severity) USING (event_type) GROUP BY ALL""")
def enrich_dimension(spark, sf_dir):
    dim = spark.createDataFrame(DIMENSION, "event_type string, category string, severity int")  # fixed rows
    return table(spark, sf_dir, "events").join(F.broadcast(dim), "event_type", "left").groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT format('bundles_total{{status="{}"}} {}', o_orderstatus, count(*)) AS line FROM orders GROUP BY o_orderstatus UNION ALL SELECT format('files_total{{controller="{}"}} {}', c_mktsegment, count(*)) FROM customer GROUP BY c_mktsegment
UNION ALL SELECT format('events_total{{event_type="{}"}} {}', event_type, count(*)) FROM events GROUP BY event_type""")
def metrics_union(spark, sf_dir):
    bundles = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"))
    return services.metrics(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("controller")), table(spark, sf_dir, "events"), bundles)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_rows(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return services.orphans(table(spark, sf_dir, "orders"), parents, "o_custkey").select("o_orderkey")


@query("""WITH t AS (SELECT item_id AS seq, concat('AB-', item_id) AS key, text FROM benchmark) (SELECT key, 0 AS rank, seq FROM t WHERE key IN ('AB-3', 'AB-7') ORDER BY seq LIMIT 5)
UNION ALL (SELECT key, 1, seq FROM t WHERE key NOT IN ('AB-3', 'AB-7') AND contains(lower(text), 'tion') ORDER BY seq LIMIT 3)""")
def ticket_lookup(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), F.concat(F.lit("AB-"), F.col("item_id").cast("string")).alias("key"), F.col("text").alias("summary"), F.lit("").alias("description"), F.lit("").alias("resolution"))
    return retrieval.tickets(own, "see ab-3 and AB-7", ["tion"]).select("key", "rank", "seq")


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'queaux') OR contains(lower(text), 'attion')")
def keyword_lines(spark, sf_dir):
    return Q.keyword_lines(table(spark, sf_dir, "conversations"), ["Queaux", "attion"]).select("conv_id", "turn")


# A bundle is the files of every twentieth user.
BUNDLED = """owned AS (SELECT *, concat('b', user_id % 20) AS bundle_id FROM lines), ranges AS (SELECT bundle_id, file_id, controller, min(user_id) % 5 * 60.0 AS clock_offset, count(*) AS line_count, min(raw_ts) AS lo, max(raw_ts) AS hi FROM owned GROUP BY ALL)"""


def _bundled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lines and files of all bundles; lines 300 to 6,000 of type `error` are unsynced stretches."""
    own = lines(spark, sf_dir).withColumn("bundle_id", F.concat(F.lit("b"), (F.col("user_id") % 20).cast("string")))
    meta = own.groupBy("file_id", "bundle_id", "controller").agg((F.min("user_id") % 5 * 60.0).alias("clock_offset"))
    named = meta.withColumns({"original_name": F.col("file_id"), "offset_method": F.lit("direct"), "unsynced": F.when(F.col("controller") == "kernel", F.array(F.struct(F.lit(300).cast("long").alias("start"), F.lit(6000).cast("long").alias("end"))))})
    return own, named.join(prescan.file_stats(own), "file_id")


def _bundles(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "nation").select(F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("bundle_id"), F.col("n_name").alias("archive_filename"))
    return own.withColumns({"status": F.lit("done"), "progress": F.lit(1.0), "archive_size_bytes": F.length("archive_filename").cast("long"), "error": F.lit(None).cast("string")})


@query(f"""WITH {LINES}, {BUNDLED}, c AS (SELECT bundle_id, controller, count(*) AS n, min(lo + clock_offset) AS s, max(hi + clock_offset) AS e FROM ranges GROUP BY ALL),
t AS (SELECT bundle_id, sum(n)::BIGINT AS file_count, string_agg(concat(controller, '=', n), ',' ORDER BY controller) AS files, string_agg(concat(controller, '=', floor(s)::BIGINT, '-', floor(e)::BIGINT), ',' ORDER BY controller) AS spans FROM c GROUP BY bundle_id)
SELECT concat('b', n_nationkey) AS bundle_id, 'done' AS status, n_name AS archive_filename, length(n_name) AS archive_size_bytes, coalesce(file_count, 0) AS file_count, coalesce(files, '') AS files, coalesce(spans, '') AS spans FROM nation LEFT JOIN t ON t.bundle_id = concat('b', n_nationkey)""")
def bundle_status(spark, sf_dir):
    _, own = _bundled(spark, sf_dir)
    out = services.bundle_status(_bundles(spark, sf_dir), own, Q.valid_ranges(own))
    shown = lambda c, f: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), f(e["value"]))), ",")
    whole = lambda t: F.floor(t).cast("long").cast("string")
    files_ = shown("files_by_controller", lambda n: n.cast("string"))
    spans = shown("valid_time_range_by_controller", lambda r: F.concat_ws("-", whole(r["start"]), whole(r["end"])))
    return out.select("bundle_id", "status", "archive_filename", "archive_size_bytes", "file_count", files_.alias("files"), spans.alias("spans"))


@query(f"""WITH {LINES}, {BUNDLED}, e AS (SELECT bundle_id, count(*) AS events FROM owned WHERE event_type = 'click' GROUP BY bundle_id), a AS (SELECT bundle_id, count(*) AS anchors FROM owned WHERE event_type = 'signup' GROUP BY bundle_id)
SELECT r.bundle_id, coalesce(any_value(events), 0) AS events, coalesce(any_value(anchors), 0) AS anchors, count(*) AS indexed_files, count(*) FILTER (WHERE controller = 'kernel') AS unsynced_files, 0::BIGINT AS skipped
FROM ranges r LEFT JOIN e ON e.bundle_id = r.bundle_id LEFT JOIN a ON a.bundle_id = r.bundle_id GROUP BY r.bundle_id""")
def prescan_counters(spark, sf_dir):
    own, meta = _bundled(spark, sf_dir)
    return prescan.counters(meta, own.filter("event_type = 'click'"), own.filter("event_type = 'signup'"), prescan.bucket_transitions(own))


@query(f"WITH {LINES}, {BUNDLED} SELECT bundle_id, min(lo + clock_offset) AS start, max(hi + clock_offset) AS \"end\" FROM ranges GROUP BY bundle_id")
def bundle_overall_range(spark, sf_dir):
    return Q.overall_range(Q.valid_ranges(_bundled(spark, sf_dir)[1]))


@query(f"""WITH {LINES}, {BUNDLED} SELECT l.file_id, l.controller, l.line_no, l.text AS line, l.raw_ts + r.clock_offset AS aligned_ts, concat('][', l.controller, '] ', l.text) AS shown FROM owned l JOIN ranges r USING (file_id) WHERE l.bundle_id = 'b7'
AND NOT (l.controller = 'kernel' AND l.line_no BETWEEN 300 AND 6000) AND (contains(lower(l.text), ': 7') OR contains(l.controller, 'tbox') OR contains(l.controller, 'kernel'))""")
def bundle_log_fetch(spark, sf_dir):
    """Lines of unsynced stretches have no place on the aligned clock; here these are lines 300 to 6,000 of kernel files."""
    own, meta = _bundled(spark, sf_dir)
    found = Q.fetch(own, meta, "b7", [": 7", "TBOX", "Kernel"])
    # Both engines write seconds differently: what is shown is compared from behind them.
    return found.select("file_id", "controller", "line_no", "line", "aligned_ts", F.regexp_replace("shown", r"^\[[-+.E0-9]+\]", "]").alias("shown"))


@query(f"WITH {LINES}, {BUNDLED} SELECT DISTINCT bundle_id, controller FROM ranges")
def controllers_present(spark, sf_dir):
    return prescan.controllers_present(_bundled(spark, sf_dir)[1])


@query(f"WITH {LINES}, {BUNDLED} SELECT file_id, controller, line_count FROM ranges WHERE bundle_id = 'b3'")
def files_of_bundle(spark, sf_dir):
    return Q.files_of(_bundled(spark, sf_dir)[1], "b3").select("file_id", "controller", "line_count")


@query("SELECT source, CASE WHEN bool_or(lang = 'fr' AND n_chars > 3000) THEN 'high' ELSE 'medium' END AS label FROM documents GROUP BY source")
def overall_label(spark, sf_dir):
    level = F.when((F.col("lang") == "fr") & (F.col("n_chars") > 3000), "high").otherwise("low")
    return services.overall_label(table(spark, sf_dir, "documents").withColumn("level", level), "source", "level")


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice - 5000 END AS d, floor(o_totalprice - 5000 + 0.5)::BIGINT AS s FROM orders)
SELECT o_orderkey, CASE WHEN d IS NULL OR d < 0 THEN '' WHEN s < 60 THEN concat(s, 's') WHEN s < 3600 THEN concat(s // 60, 'm') WHEN s % 3600 // 60 = 0 THEN concat(s // 3600, 'h') ELSE concat(s // 3600, 'h ', s % 3600 // 60, 'm') END AS duration,
CASE WHEN d IS NULL THEN 'Δ--' WHEN s >= 3600 THEN concat('Δ', s // 3600, 'h ', s % 3600 // 60, 'm') WHEN s >= 60 THEN concat('Δ', s // 60, 'm ', s % 60, 's') ELSE concat('Δ', greatest(s, 0), 's') END AS delta FROM t""")
def time_labels(spark, sf_dir):
    d = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") - 5000)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.duration_label(d).alias("duration"), T.delta_label(d).alias("delta"))


@query("SELECT o_orderkey, o_orderdate, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def case_list_total(spark, sf_dir):
    own = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return services.page_of(own, [F.desc("o_orderdate"), F.col("o_orderkey")], 100, 50)


@query("SELECT 'case' AS kind, c_custkey AS key FROM customer WHERE c_custkey <> 11 UNION ALL SELECT 'log', o_orderkey FROM orders WHERE o_custkey <> 11")
def case_delete(spark, sf_dir):
    cases = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("key"))
    logs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("key"))
    one, two = services.without(cases, "c_custkey", 11, logs)
    return one.select(F.lit("case").alias("kind"), "key").unionByName(two.select(F.lit("log").alias("kind"), "key"))


@query("SELECT o_orderkey AS id, o_custkey AS case_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 5")
def feedback_list(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("confirmation_status"), F.col("o_orderdate").alias("confirmed_at"))
    return services.of_case(own, status="O", offset=5, limit=25).select("id", "case_id")


@query("""SELECT CASE WHEN c_custkey IS NULL THEN 'no such case' WHEN o_orderstatus NOT IN ('O', 'F') THEN 'no such status' ELSE 'confidence outside 0..1' END AS error, count(*) AS n
FROM (SELECT *, (o_orderkey % 13) / 10.0 AS conf FROM orders) LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey WHERE c_custkey IS NULL OR o_orderstatus NOT IN ('O', 'F') OR conf > 1 GROUP BY ALL""")
def feedback_checks(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "confirmed").when(F.col("o_orderstatus") == "F", "rejected").otherwise("other")
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), status.alias("confirmation_status"), (F.col("o_orderkey") % 13 / 10.0).alias("confidence"))
    cases = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("case_id"))
    return services.feedback_errors(own, cases).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CACHE}, n AS (SELECT *, created_at AS id FROM cache), f AS (SELECT id FROM n WHERE query_hash = 'user' AND cache_type = 'a' AND (expires_at IS NULL OR expires_at > 1000) ORDER BY created_at DESC LIMIT 1)
SELECT id, hit_count + (id IN (SELECT id FROM f))::INT AS hit_count FROM n""")
def cache_hit_counted(spark, sf_dir):
    own = _cache(spark, sf_dir).withColumn("id", F.col("created_at"))
    return services.cache_hit(own, "user", "a", F.lit(1000.0)).select("id", "hit_count")


@query(f"""WITH {CACHE} SELECT 'hash' AS mode, count(*) AS n, max(created_at) AS last FROM cache WHERE query_hash <> 'user' UNION ALL SELECT 'type', count(*), max(created_at) FROM cache WHERE NOT (coalesce(expires_at <= 1000, false) AND cache_type = 'a')
UNION ALL SELECT 'expired', count(*), max(created_at) FROM cache WHERE NOT coalesce(expires_at <= 1000, false)""")
def cache_invalidate(spark, sf_dir):
    own, now = _cache(spark, sf_dir), F.lit(1000.0)
    modes = {"hash": services.cache_drop(own, now, "user"), "type": services.cache_drop(own, now, kind="a"), "expired": services.cache_drop(own, now)}
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last")).select(F.lit(m).alias("mode"), "n", "last") for m, df in modes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE coalesce(o.name, c_name) END AS c_name, coalesce(o.total, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, CASE WHEN o_custkey % 2 = 1 THEN max(o_orderpriority) END AS name, max(o_totalprice) AS total FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def catalog_update(spark, sf_dir):
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_name"), F.max("o_totalprice").alias("c_acctbal"))
    new = new.withColumn("c_name", F.when(F.col("c_custkey") % 2 == 1, F.col("c_name")))
    return updated(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), new, "c_custkey")


@query("""WITH s AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 4) SELECT conv_id, turn, CASE WHEN conv_id IN (SELECT conv_id FROM s) THEN 'new' ELSE role END AS role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM s) OR turn < 2""")
def session_replace(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    long_ = said.groupBy("conv_id").count().filter("count >= 4").select("conv_id")
    return services.replace_session(said, said.join(long_, "conv_id", "left_semi").filter("turn < 2").withColumn("role", F.lit("new")), "conv_id")


@query(r"""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(b.text), '[\pL\pM\pN_]+')) AS mine, list_distinct(regexp_extract_all(lower(d.text), '[\pL\pM\pN_]+')) AS theirs FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3)
SELECT item_id, len(mine)::INT AS words, len(theirs)::INT AS others, round(len(list_intersect(mine, theirs)) / len(mine), 6) AS share, round(len(list_intersect(mine, theirs)) / len(theirs), 6) AS back FROM w""")
def word_sets(spark, sf_dir):
    """Words that the text of a case and that of a document share, seen from both."""
    mine = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("mine"))
    both = mine.join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("theirs")), F.col("doc_id") == F.col("item_id") * 3)
    a, b = F.col("mine"), F.col("theirs")
    share = lambda x, y: F.round(services.token_overlap(x, y), 6)
    return both.select("item_id", F.size(services.word_set(a)).alias("words"), F.size(services.word_set(b)).alias("others"), share(b, a).alias("share"), share(a, b).alias("back"))


def _event_stream(spark, sf_dir, folder: str, each: int = 2) -> DataFrame:
    """The events as a stream of files, some in each batch."""
    own = table(spark, sf_dir, "events")
    own.repartition(6).write.mode("overwrite").parquet(f"{folder}/in")
    return spark.readStream.schema(own.schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/in")


@query("""SELECT concat('b', user_id % 20) AS bundle_id, (floor(epoch(ts) / 300) * 300)::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_window_counts(spark, sf_dir):
    """Windows of five minutes over a stream, whose whole result each batch puts in place of the one before."""
    folder = shared_path(spark, "stream")
    own = _event_stream(spark, sf_dir, folder).withColumn("bundle_id", F.concat(F.lit("b"), (F.col("user_id") % 20).cast("string")))
    counts = own.withColumn("at", F.col("ts").cast("timestamp")).groupBy("bundle_id", F.window("at", "5 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select("bundle_id", epoch(F.col("w.start")).cast("long").alias("start"), "event_type", "n")
    stored = store.store_stream(rows, folder, "windows", "windows", f"{folder}/_check", mode="complete")
    stored.awaitTermination()
    return Tables(spark, folder).read("windows")


@query("""SELECT concat('b', user_id % 20) AS bundle_id, user_id::VARCHAR AS file_id, event_id AS line_no, sum(CASE WHEN value < before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::INT AS boot, false AS late
FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)""")
def stream_boot_numbers(spark, sf_dir):
    """Boot numbers by state kept for each file of a stream."""
    folder = shared_path(spark, "stream")
    own = _event_stream(spark, sf_dir, folder).select(F.col("user_id").cast("string").alias("file_id"), F.col("event_id").alias("line_no"), F.col("value").alias("tick"))
    numbered = monitor.boot_numbers(own).withColumn("bundle_id", F.concat(F.lit("b"), (F.col("file_id").cast("long") % 20).cast("string")))
    stored = store.store_stream(numbered.select("bundle_id", "file_id", "line_no", "boot", "late"), folder, "boots", "boots", f"{folder}/_check", trigger={"once": True})
    stored.awaitTermination()
    return Tables(spark, folder).read("boots")

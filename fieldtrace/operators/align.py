"""Clock alignment of a bundle's controllers by matching anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import timeparse as P
from fieldtrace.operators import scan
from fieldtrace.schema import MAX_OFFSET, effective
from fieldtrace.sources.tables import stage

NARROW, WIDE = 60.0, 600.0


#: Seconds of a stretch in which the neighbours of anchors are searched by one task.
STRETCH = 3600.0


def neighbours(source: DataFrame, base: DataFrame, by: list[str], stretch: float = STRETCH) -> DataFrame:
    """Sources with `left`, the last base time before theirs, and `right`, the first at or after it; either may be null.

    A base time is a struct of the time, how many anchors share it, and the least and greatest confidence among them.
    """
    points = base.groupBy(*by, F.col("raw_timestamp").alias("_t")).agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))
    points = points.select(*by, "_t", F.lit(1).alias("_kind"), F.struct(F.col("_t").alias("t"), "n", "low", "high").alias("_point"), F.lit(None).cast(source.schema["controller"].dataType).alias("controller"), F.lit(None).cast("double").alias("confidence"))
    own = source.select(*by, F.col("raw_timestamp").alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(points.schema["_point"].dataType).alias("_point"), "controller", "confidence")
    # Among equal times sources come first: the base time is then to their right.
    merged, order = own.unionByName(points), ["_t", "_kind"]
    around = scan.seen(merged, {"left": (F.col("_point"), False, False), "right": (F.col("_point"), False, True)}, by, order, stretch)
    return around.filter("_kind = 0").select(*by, "controller", "_t", "confidence", "left", "right")


def anchor_pairs(source: DataFrame, base: DataFrame, windows: tuple[float, ...] = (NARROW, WIDE), stretch: float = STRETCH) -> DataFrame:
    """Pairs per window; `source` has bundle_id, controller, anchor_type, raw_timestamp, confidence, `base` the same without controller.

    The sources of a controller and type, in order of time and confidence, each take the nearer base time of the two around
    them that is still free, if it lies within the window; of two equally near the earlier.  This walk is computed without
    walking.  The sources between two base times form a gap, and compete for these two alone; of what came before, a gap
    feels only whether its left base time is taken, by the gap to its left.  Its first two sources and its first one near the
    right base time decide what it takes in either case.  Whether its right base time ends up taken is then fixed, or is
    what the left one was; so the state at each gap is the last fixed one before it along a chain of touching gaps, which a
    segmented scan finds.  No task holds the anchors of a group, and no gap more than its first two.
    """
    by = ["bundle_id", "anchor_type"]
    base = base.select(*(F.col(c).alias(c) for c in base.columns))  # both sides may come from one frame
    # Each step is read by several others: written once, as narrow rows.
    near = stage(neighbours(source.filter("raw_timestamp is not null"), base.filter("raw_timestamp is not null"), by, stretch), "neighbours")
    near = near.withColumn("window", F.explode(F.array(*(F.lit(float(w)) for w in windows))))
    to_left, to_right = F.col("_t") - F.col("left.t"), F.col("right.t") - F.col("_t")
    reach = lambda d: F.coalesce(d <= F.col("window"), F.lit(False))
    near = near.withColumns({"_l": reach(to_left), "_r": reach(to_right)}).filter("_l or _r")
    gap = [*by, "controller", "window", "left", "right"]
    one = F.struct(F.col("_t").alias("t"), F.col("confidence").alias("c"), F.col("_l").alias("l"), F.col("_r").alias("r"))
    near = near.select(*gap, one.alias("_one"))
    # Tasks keep the first two rows of each gap before the shuffle.
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy(*gap).orderBy("_one"))).filter("_n <= 2")
    first = ranked.groupBy(*gap).agg(F.max(F.when(F.col("_n") == 1, F.col("_one"))).alias("a"), F.max(F.when(F.col("_n") == 2, F.col("_one"))).alias("b"))
    late = near.filter("_one.r").groupBy(*gap).agg(F.min("_one").alias("s"))
    same = [first[c].eqNullSafe(late[c]) for c in gap]
    gaps = first.join(late, same, "left").select(*(first[c] for c in gap), "a", "b", "s")
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    goes_left = a["l"] & (F.col("right").isNull() | (a["t"] - F.col("left.t") <= F.col("right.t") - a["t"]))
    free = F.struct(
        F.when(goes_left, a).when(b["l"], b).alias("left"),
        F.when(~goes_left, a).when(~a["r"], s).otherwise(F.when(b["r"], b)).alias("right"),
    )
    taken = F.struct(F.when(F.lit(False), a).alias("left"), s.alias("right"))
    gaps = gaps.withColumns({"free": free, "taken": taken, "_at": F.coalesce(F.col("left.t"), F.lit(-1e15))}).drop("a", "b", "s")
    gaps = stage(gaps, "gaps")
    chain = [*by, "controller", "window"]
    gaps = scan.last_seen(gaps, F.col("right"), "_before", chain, ["_at"], stretch, inclusive=False)
    # Anchors that share a time are taken one from the left, another from the right.
    touches = F.coalesce((F.col("_before.t") == F.col("left.t")) & (F.col("left.n") == 1), F.lit(False))
    after = lambda c: F.col(f"{c}.right").isNotNull()
    fixed = F.when(after("free") == after("taken"), after("free")).when(~touches, after("free"))
    gaps = stage(gaps.withColumns({"_touches": touches, "_fixed": fixed}), "chains")
    gaps = scan.last_seen(gaps, F.col("_fixed"), "_state", chain, ["_at"], stretch, inclusive=False)
    got = F.when(F.col("_touches") & F.coalesce("_state", F.lit(False)), F.col("taken")).otherwise(F.col("free"))
    pair = lambda side, trust: F.when(got[side].isNotNull(), F.struct(got[side]["t"].alias("source_ts"), F.col(f"{side}.t").alias("base_ts"), F.greatest(got[side]["c"] * F.col(f"{side}.{trust}"), F.lit(1e-6)).alias("weight")))
    pairs = gaps.withColumn("_pair", F.explode(F.array_compact(F.array(pair("left", "high"), pair("right", "low")))))
    return pairs.select("bundle_id", "controller", "anchor_type", "window", "_pair.*")


def consistency(stdev: Column) -> Column:
    """1 up to 5 seconds of spread, falling to 0.6 at 30."""
    return F.greatest(F.lit(0.6), 1 - 0.4 * F.least((stdev - 5) / 25, F.lit(1.0))) * F.when(stdev <= 5, 0).otherwise(1) + F.when(stdev <= 5, 1.0).otherwise(0.0)


def offsets(pairs: DataFrame, *by: str) -> DataFrame:
    """Weighted mean offset, number and confidence of the pairs of each group."""
    d = F.col("base_ts") - F.col("source_ts")
    sums = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("_w"), F.sum(F.col("weight") * d).alias("_wd"), F.avg("weight").alias("_mean_w"), F.min(d).alias("_d0")
    )
    # The spread is summed around the mean, in a second pass over few rows, for precision.
    centred = pairs.join(sums.select(*by, (F.col("_wd") / F.col("_w")).alias("offset")), list(by))
    spread = centred.groupBy(*by).agg(F.first("offset").alias("offset"), F.sum(F.col("weight") * F.pow(d - F.col("offset"), 2)).alias("_ss"))
    both = sums.join(spread, list(by))
    stdev = F.when(F.col("n") < 2, 0.0).otherwise(F.sqrt(F.col("_ss") / F.col("_w")))
    confidence = F.least(F.col("n") / 2, F.lit(1.0)) * F.sqrt("_mean_w") * consistency(stdev)
    return both.select(*by, "n", "offset", stdev.alias("stdev"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence"))


def chosen_window(found: DataFrame, *by: str) -> DataFrame:
    """The narrow window's result, unless it has under three pairs and the wide one has more."""
    best = F.max_by(F.struct("n", "offset", "confidence"), F.struct(F.when((F.col("window") == NARROW), F.when(F.col("n") >= 3, 1 << 30).otherwise(F.col("n"))).otherwise(F.col("n")), -F.col("window"))).alias("best")
    return found.groupBy(*by).agg(best).select(*by, "best.*")


def align(anchors: DataFrame, present: DataFrame) -> DataFrame:
    """Offset, confidence and method of each present controller (bundle_id, controller), and its bundle's status.

    The base is tbox if it has usable anchors, else android, which caps the status at partial; without either the bundle fails.
    """
    clean = anchors.filter(effective(F.col("raw_timestamp")) & (F.col("controller") != "unknown"))
    bases = clean.groupBy("bundle_id").agg(F.when(F.max((F.col("controller") == "tbox").cast("int")) == 1, "tbox").when(F.max((F.col("controller") == "android").cast("int")) == 1, "android").alias("base"))
    known = clean.join(bases, "bundle_id")
    base = known.filter("controller = base").select("bundle_id", "anchor_type", "raw_timestamp", "confidence")
    sane = lambda df: df.filter(F.abs("offset") <= MAX_OFFSET)
    # A row a controller, which much below reads: the pairs are found and summed up once, and written.
    summed = lambda pairs, name: stage(chosen_window(offsets(stage(pairs, "pairs"), "bundle_id", "controller", "window"), "bundle_id", "controller"), name)
    every = summed(anchor_pairs(known.filter("controller <> base").select(*clean.columns), base), "direct")
    direct = sane(every)
    seen = clean.groupBy("bundle_id", "controller").agg(F.count(F.lit(1)).alias("anchors"))

    # A second hop over android, where it is well aligned itself and the target is not.
    bridge = direct.filter("controller = 'android' and confidence >= 0.6").select("bundle_id", F.col("offset").alias("bridge_offset"), F.col("confidence").alias("bridge_confidence"))
    weak = known.filter("controller <> base and controller <> 'android'").join(direct.select("bundle_id", "controller", F.col("confidence").alias("own")), ["bundle_id", "controller"], "left").filter("coalesce(own, 0) < 0.7")
    over = known.filter("controller = 'android' and base <> 'android'").select("bundle_id", "anchor_type", "raw_timestamp", "confidence")
    hop = summed(anchor_pairs(weak.select(*clean.columns), over), "over").join(bridge, "bundle_id")
    hops = hop.select("bundle_id", "controller", (F.col("bridge_offset") + F.col("offset")).alias("offset"), (F.col("confidence") * F.col("bridge_confidence") * 0.95).alias("confidence"), "n")
    hop = sane(hops)
    far = lambda df, name: df.filter(F.abs("offset") > MAX_OFFSET).select("bundle_id", "controller", F.col("offset").alias(name))
    two = hop.select("bundle_id", "controller", F.col("offset").alias("hop_offset"), F.col("confidence").alias("hop_confidence"), F.col("n").alias("hop_n"))

    both = present.filter("controller <> 'unknown'").join(bases, "bundle_id", "left").join(direct, ["bundle_id", "controller"], "left").join(two, ["bundle_id", "controller"], "left")
    both = both.join(seen, ["bundle_id", "controller"], "left").join(far(every, "far_direct"), ["bundle_id", "controller"], "left").join(far(hops, "far_hop"), ["bundle_id", "controller"], "left")
    better = F.col("hop_confidence") > F.coalesce("confidence", F.lit(0.0))
    is_base = F.coalesce(F.col("controller") == F.col("base"), F.lit(False))
    placed = both.select(
        "bundle_id",
        "controller",
        "base",
        F.when(is_base, 0.0).when(better, F.col("hop_offset")).otherwise(F.col("offset")).alias("offset"),
        F.when(is_base, 1.0).when(better, F.col("hop_confidence")).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.when(is_base, "none").when(better, "two_hop").when(F.col("offset").isNotNull(), "direct").otherwise("none").alias("method"),
        F.when(is_base, F.coalesce("anchors", F.lit(0))).when(better, F.col("hop_n")).otherwise(F.coalesce("n", F.lit(0))).alias("n"),
        warnings_of(is_base).alias("warnings"),
    )
    return placed.join(statuses(placed), "bundle_id")


def warnings_of(is_base: Column) -> Column:
    """What went wrong for a controller, and for its bundle."""
    name, based = F.col("controller"), F.col("base").isNotNull()
    rejected = lambda c, how: F.when(F.col(c).isNotNull(), F.format_string(f"%s: {how} offset of %.0f s is beyond 30 days", name, c))
    each = (
        F.when(F.col("base") == "android", "no usable anchors of tbox: android is the base clock"),
        F.when(~based, "no usable anchors of tbox or android: not aligned"),
        F.when(based & ~is_base & F.col("anchors").isNull(), F.concat(name, F.lit(": no usable anchors"))),
        rejected("far_direct", "direct"),
        rejected("far_hop", "two-hop"),
    )
    return F.filter(F.array(*each), lambda w: w.isNotNull())


def statuses(placed: DataFrame) -> DataFrame:
    """success: every target has confidence 0.8; partial: at least half of them, one at least, have an offset; else failed."""
    target = F.coalesce(F.col("controller") != F.col("base"), F.lit(True))
    sums = placed.groupBy("bundle_id").agg(
        F.max("base").alias("base"),
        F.sum(target.cast("int")).alias("targets"),
        F.sum((target & (F.col("confidence") >= 0.8) & F.col("offset").isNotNull()).cast("int")).alias("sure"),
        F.sum((target & F.col("offset").isNotNull()).cast("int")).alias("placed"),
    )
    enough = F.col("placed") >= F.greatest(F.lit(1), F.ceil(F.col("targets") * 0.5))
    status = F.when(F.col("base").isNull(), "failed").when((F.col("sure") == F.col("targets")) & (F.col("base") == "tbox"), "success").when(enough | (F.col("sure") == F.col("targets")), "partial").otherwise("failed")
    return sums.select("bundle_id", status.alias("status"))


def file_offsets(files: DataFrame, segs: DataFrame) -> DataFrame:
    """Offsets that a file gives by itself: by its name, by a synchronised clock, or by segments."""
    boot, dump = P.boot_file(F.col("original_name")), P.dump_file(F.col("original_name"))
    captured = F.col("bundle_relative_path").contains("/kernel_logs/") & boot.isNotNull()
    kernel = F.col("controller") == "kernel"
    synced = F.col("controller").isin("ibdu", "tbox") & F.col("valid_ts_min").isNotNull()
    has = files.join(segs.select("file_id").distinct().withColumn("_segmented", F.lit(True)), "file_id", "left")
    method = F.when(kernel & (captured | (dump.isNotNull() & F.col("raw_ts_max").isNotNull())), "filename_anchor").when(synced, "clock_sync").when(F.col("_segmented"), "segmented").otherwise("none")
    offset = F.when(kernel & captured, boot).when(kernel, dump - F.col("raw_ts_max")).when(synced, 0.0)
    confidence = F.when(kernel & captured, 0.99).when(kernel & offset.isNotNull(), 0.85).when(synced, 1.0).otherwise(0.0)
    return has.withColumns({"offset_method": method, "clock_offset": offset, "offset_confidence": confidence}).drop("_segmented")


def apply_offsets(files: DataFrame, placed: DataFrame) -> DataFrame:
    """Controller offsets for files that have none of their own."""
    own = F.col("offset_method").isin("filename_anchor", "clock_sync", "segmented")
    both = files.join(placed.select("bundle_id", "controller", "offset", "confidence", "method"), ["bundle_id", "controller"], "left")
    return both.withColumns(
        {
            "clock_offset": F.when(own, F.col("clock_offset")).otherwise(F.col("offset")),
            "offset_confidence": F.when(own, F.col("offset_confidence")).otherwise(F.coalesce("confidence", F.lit(0.0))),
            "offset_method": F.when(own, F.col("offset_method")).otherwise(F.coalesce("method", F.lit("none"))),
        }
    ).drop("offset", "confidence", "method")


def refine_unsynced(files: DataFrame, lines: DataFrame, sync: Column) -> DataFrame:
    """Files with a clock-sync line at K > 0 are unsynced before it, and nowhere else."""
    first = lines.filter(sync).groupBy("file_id").agg(F.min("line_no").alias("_k"))
    new = F.when(F.col("_k") > 0, F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("_k") - 1).alias("end")))).otherwise(F.col("unsynced"))
    return files.join(first, "file_id", "left").withColumn("unsynced", new).drop("_k")


def summary(placed: DataFrame) -> DataFrame:
    """One row per bundle: status, a map from controller to what was found, and all warnings."""
    value = F.struct("offset", "confidence", "method", "n")
    return placed.groupBy("bundle_id", "status").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("controller", value)))).alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"))

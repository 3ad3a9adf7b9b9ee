"""Tables of cases, feedback, sessions, cached answers and evaluations: derived frames in place of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions import text as T


def first_seen(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def add_new(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`table` with the rows of `new` whose key it lacks."""
    return table.unionByName(new.join(table.select(key), key, "left_anti").select(*table.columns))


def page_of(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with `total`, the number of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    return page(df, order, offset, limit).crossJoin(F.broadcast(total))


def without(table: DataFrame, key: str, value, *dependants: DataFrame) -> tuple[DataFrame, ...]:
    """`table` and the tables that refer to it, without the rows of one key."""
    return tuple(df.filter(~F.coalesce(F.col(key) == value, F.lit(False))) for df in (table, *dependants))


def of_case(feedback: DataFrame, case: str | None = None, status: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Feedback of a case, or with a status, newest first."""
    for column, value in (("case_id", case), ("confirmation_status", status)):
        if value:
            feedback = feedback.filter(F.col(column) == value)
    ordered = feedback.orderBy(F.desc("confirmed_at"), "id").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def bundle_status(bundles: DataFrame, files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each bundle with its number of files, files by controller and valid range by controller (maps)."""
    each = files.groupBy("bundle_id", "controller").agg(F.count(F.lit(1)).alias("n"))
    counts = each.groupBy("bundle_id").agg(F.sum("n").alias("file_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("controller", "n")))).alias("files_by_controller"))
    span = F.struct("controller", F.struct(F.col("valid_start").alias("start"), F.col("valid_end").alias("end")).alias("range"))
    spans = ranges.groupBy("bundle_id").agg(F.map_from_entries(F.array_sort(F.collect_list(span))).alias("valid_time_range_by_controller"))
    out = bundles.join(counts, "bundle_id", "left").join(spans, "bundle_id", "left")
    return out.withColumns(
        {
            "file_count": F.coalesce("file_count", F.lit(0).cast("long")),
            "files_by_controller": F.coalesce("files_by_controller", F.create_map().cast("map<string,bigint>")),
            "valid_time_range_by_controller": F.coalesce("valid_time_range_by_controller", F.create_map().cast("map<string,struct<start:double,end:double>>")),
        }
    )


def overall_label(answers: DataFrame, by: str, level: str) -> DataFrame:
    """high if any answer is, else medium."""
    return answers.groupBy(by).agg(F.when(F.bool_or(F.coalesce(F.col(level) == "high", F.lit(False))), "high").otherwise("medium").alias("label"))


def conflicts(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(table.select(key), key, "left_semi")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows that refer to nothing."""
    return rows.join(parents.select(key), key, "left_anti")


def feedback_errors(feedback: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows with what is wrong with them: unknown case, unknown status, or confidence outside 0..1."""
    known = feedback.join(cases.select("case_id", F.lit(True).alias("_known")), "case_id", "left")
    wrong = F.when(F.col("_known").isNull(), "no such case").when(~F.col("confirmation_status").isin("confirmed", "rejected", "pending"), "no such status").when(~F.col("confidence").between(0, 1), "confidence outside 0..1")
    return known.withColumn("error", wrong).drop("_known").filter("error is not null")


def feedback_stats(feedback: DataFrame, status: str, confidence: str, kinds: list[str]) -> DataFrame:
    """Rows, rows of each status and mean confidence, in one pass."""
    return feedback.agg(F.count(F.lit(1)).alias("total"), *(F.sum((F.col(status) == k).cast("long")).alias(f"n_{k}") for k in kinds), F.round(F.avg(confidence), 3).alias("avg_confidence"))


def cache_upsert(table: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row of each query hash; a replaced row starts its hits anew."""
    return first_seen(table.unionByName(new.withColumn("hit_count", F.lit(0))), F.col("query_hash"), F.desc("created_at"))


def cache_get(table: DataFrame, query_hash: str, kind: str, now: Column) -> DataFrame:
    """The newest row of a hash and type that has not expired."""
    live = table.filter((F.col("query_hash") == query_hash) & (F.col("cache_type") == kind) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return live.orderBy(F.desc("created_at")).limit(1)


def cache_hit(table: DataFrame, query_hash: str, kind: str, now: Column) -> DataFrame:
    """`table` after a read: the row that `cache_get` finds has one hit more; `id` names rows."""
    found = cache_get(table, query_hash, kind, now).select(F.col("id").alias("_id"))  # one row at most
    return table.join(F.broadcast(found), F.col("id") == F.col("_id"), "left").withColumn("hit_count", F.col("hit_count") + F.when(F.col("_id").isNotNull(), 1).otherwise(0)).select(*table.columns)


def cache_drop(table: DataFrame, now: Column, query_hash: str | None = None, kind: str | None = None) -> DataFrame:
    """Without one hash, or without what has expired, of one type or of all."""
    if query_hash is not None:
        return table.filter(F.col("query_hash") != query_hash)
    gone = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return table.filter(~(gone & (F.col("cache_type") == kind)) if kind else ~gone)


def cache_stats(table: DataFrame, now: Column) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("entries"), F.sum("hit_count").alias("hits"), F.sum((F.col("expires_at") <= now).cast("long")).alias("expired"), F.avg("hit_count").alias("avg_hits")
    )


def transcripts(messages: DataFrame, session: str, order: str, *fields: str) -> DataFrame:
    """Messages of each session in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return messages.groupBy(session).agg(ordered.alias("messages"), F.count(F.lit(1)).alias("turn_count"))


def session_titles(messages: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """Title of each session from its first user message that is not blank."""
    said = messages.filter((F.col(role) == "user") & (F.trim(F.regexp_replace(text, r"\s+", " ")) != ""))
    return said.groupBy(session).agg(F.min_by(text, order).alias("_m")).select(session, T.title_of(F.col("_m")).alias("title"))


def replace_session(messages: DataFrame, new: DataFrame, session: str) -> DataFrame:
    """All messages of the new rows' sessions replaced."""
    return messages.join(new.select(session).distinct(), session, "left_anti").select(*messages.columns).unionByName(new.select(*messages.columns))


def recall(text: Column, wanted: Column) -> Column:
    """Share of the wanted strings that the text holds."""
    return F.size(F.filter(wanted, lambda w: text.contains(F.lower(w)))) / F.greatest(F.size(wanted), F.lit(1))


def word_set(text: Column) -> Column:
    """Distinct words of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)))


def token_overlap(text: Column, wanted: Column) -> Column:
    """Share of the wanted text's words that the text has; 0 without words."""
    want = word_set(wanted)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, word_set(text))) / F.size(want)).otherwise(0.0)


def evaluate(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Scores per case; a case without output is judged on empty text."""
    both = cases.join(outputs.select("case_id", "summary", "detail", "confidence"), "case_id", "left")
    text = F.lower(F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("detail", F.lit(""))))
    parts = {
        "keyword_score": recall(text, F.col("expected_keywords")),
        "ecu_score": recall(text, F.col("expected_ecus")),
        "stage_score": recall(text, F.col("expected_fota_stages")),
        "root_cause_score": token_overlap(text, F.col("expected_root_cause")),
        "confidence_score": F.when(F.col("confidence").eqNullSafe(F.col("expected_confidence")), 1.0).otherwise(0.5),
    }
    weights = dict(zip(parts, (0.25, 0.20, 0.20, 0.25, 0.10), strict=True))
    scored = both.withColumns({f"_{k}": c for k, c in parts.items()})
    total = lambda c: sum((c(k) * w for k, w in weights.items()), F.lit(0.0))
    rounded = {k: F.round(f"_{k}", 3) for k in parts}
    return scored.withColumns(rounded).select("case_id", *parts, F.round(total(F.col), 3).alias("total_score"), (total(F.col) >= 0.6).alias("passed"))


def report(scores: DataFrame) -> DataFrame:
    names = [c for c in scores.columns if c.endswith("_score")]
    return scores.agg(F.count(F.lit(1)).alias("cases"), F.sum(F.col("passed").cast("long")).alias("passed"), *(F.round(F.avg(c), 3).alias(f"avg_{c}") for c in names))


def confidence_vote(votes: DataFrame, by: str, level: str) -> DataFrame:
    """high 3, medium 2, others 1; the mean at 2.5 is high, at 1.5 medium."""
    points = F.when(F.col(level) == "high", 3).when(F.col(level) == "medium", 2).otherwise(1)
    mean = votes.groupBy(by).agg(F.avg(points).alias("mean"))
    return mean.select(by, F.when(F.col("mean") >= 2.5, "high").when(F.col("mean") >= 1.5, "medium").otherwise("low").alias("vote"))


def citation_warnings(citations: DataFrame, known: DataFrame, agents: DataFrame) -> DataFrame:
    """What is wrong with citations (agent, seq, title, source): fields missing, unknown title, repeated title; agents without any."""
    missing = citations.filter("title is null or source is null").select("agent", "seq", F.lit("missing field").alias("warning"))
    unknown = citations.filter("title is not null").join(known.select("title"), "title", "left_anti").select("agent", "seq", F.lit("unknown title").alias("warning"))
    nth = F.row_number().over(Window.partitionBy("title").orderBy("seq"))
    repeated = citations.filter("title is not null").withColumn("_n", nth).filter("_n > 1").select("agent", "seq", F.lit("repeated title").alias("warning"))
    silent = agents.join(citations.select("agent"), "agent", "left_anti").select("agent", F.lit(None).cast("long").alias("seq"), F.lit("no source").alias("warning"))
    return missing.unionByName(unknown).unionByName(repeated).unionByName(silent)


def lanes(ranges: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Where each lane lies on the common time line, in percent."""
    whole = ranges.agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    own = ranges.groupBy(by).agg(F.min(start).alias("lane_start"), F.max(end).alias("lane_end")).crossJoin(F.broadcast(whole))  # one row
    span = F.greatest(F.col("_e") - F.col("_s"), F.lit(1e-9))
    pct = lambda c: F.least(F.greatest((F.col(c) - F.col("_s")) / span * 100, F.lit(0.0)), F.lit(100.0))
    return own.select(by, pct("lane_start").alias("from_pct"), pct("lane_end").alias("to_pct"))


def density(events: DataFrame, by: str, ts: str, kind: str, start: Column, end: Column, width: float = 3.0) -> DataFrame:
    """Events per lane and slice of the time line, with the first three types in order of time."""
    pct = (F.col(ts) - start) / (end - start) * 100
    each = events.select(by, F.floor(pct / width).cast("long").alias("slot"), F.col(ts).alias("_t"), F.col(kind).alias("_k"))
    counts = each.groupBy(by, "slot").agg(F.count(F.lit(1)).alias("n"))
    # Three rows of each slice are kept before they meet, so that no task holds a slice.
    first = each.withColumn("_n", F.row_number().over(Window.partitionBy(by, "slot").orderBy("_t", "_k"))).filter("_n <= 3")
    types = first.groupBy(by, "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_k"))), lambda x: x["_k"]).alias("types"))
    one, two = (df.withColumn("_slot", F.coalesce("slot", F.lit(-1).cast("long"))) for df in (counts, types))
    return one.join(two.drop("slot"), [by, "_slot"], "left").drop("_slot")


def metrics(files: DataFrame, events: DataFrame, bundles: DataFrame) -> DataFrame:
    """Counters in the text form that scrapers read."""

    def family(df: DataFrame, by: str, name: str) -> DataFrame:
        return df.groupBy(by).count().select(F.format_string(f'{name}{{{by}="%s"}} %d', F.col(by), F.col("count")).alias("line"))

    return family(bundles, "status", "bundles_total").unionByName(family(files, "controller", "files_total")).unionByName(family(events, "event_type", "events_total"))

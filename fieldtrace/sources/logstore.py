"""Decoded lines at rest, with a bucket index that turns a time window into byte ranges.

`write` deals lines by file and number into objects of bounded size; a large file has several.  Beside each object stands
its index: a row for each stretch of lines of one file and one five-minute bucket, with the bytes and lines that it covers.
Objects and index are named by a manifest (see `versions`), made when all tasks have ended: what a lost task wrote is
never read.

Two ways to read.  `lines` is a data source that takes filters on bundle, file, controller and time: a task reads the
index of its object, and of the object only the stretches that can hold such lines.  `window` joins the index with a
bundle's files, each with its own clock, and gives the lines of the stretches that meet a window on the aligned clock: all
that a range query needs of the lines, and little more.

A line is stored as number, time and text with tabs between; a text with a line feed in it is none, and is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from fieldtrace.schema import BUCKET_SECONDS, SENTINEL_DAY
from fieldtrace.sources.versions import Manifests, opened

SCHEMA = "bundle_id string, file_id string, controller string, line_no long, raw_ts double, text string"
INDEX = "object string, bundle_id string, file_id string, controller string, bucket long, start long, stop long, first_line long, last_line long, dated_from long, dated_to long"
#: A stretch ends after so many bytes, one bucket or not; lines that come together; bytes read at once, and characters that
#: come together.
STRETCH, BATCH, READ = 1 << 20, 10_000, 8 << 20
#: Rows of the index that are held at once: where each line has a bucket of its own, they are as many as lines.
HELD = 10_000
KINDS = pa.schema([(k, pa.int64() if v == "long" else pa.string()) for k, v in (x.split() for x in INDEX.split(", "))])
USABLE = SENTINEL_DAY + 86400


class LogStore(DataSource):
    """`log_store`: lines in objects with an index; written by append, read with pushed filters."""

    @classmethod
    def name(cls) -> str:
        return "log_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        name = uuid.uuid4().hex
        store, base = opened(self.folder)
        store.create_dir(f"{base}/objects", recursive=True)
        store.create_dir(f"{base}/index", recursive=True)
        rows: list[dict] = []
        at = 0
        with store.open_output_stream(f"{base}/objects/{name}.log") as out, store.open_output_stream(f"{base}/index/{name}.parquet") as beside, pq.ParquetWriter(beside, KINDS) as index:
            for batch in iterator:
                columns = batch.to_pydict()
                parts = []
                for b, f, c, n, t, text in zip(*(columns[k] for k in ("bundle_id", "file_id", "controller", "line_no", "raw_ts", "text")), strict=True):
                    text = text or ""
                    if "\n" in text:
                        raise ValueError(f"line {n} of {f} holds a line feed")
                    raw = f"{n}\t{'' if t is None else repr(t)}\t{text}\n".encode()
                    dated = t is not None and t >= USABLE
                    bucket = int(t // BUCKET_SECONDS) if dated else None
                    last = rows[-1] if rows else None
                    same = last and (last["bundle_id"], last["file_id"]) == (b, f)
                    # Undated lines go with the stretch that is open; a stretch without a date yet takes the first one.
                    if not same or last["stop"] - last["start"] >= STRETCH or (dated and last["bucket"] not in (None, bucket)):
                        if len(rows) >= HELD:
                            index.write_table(pa.Table.from_pylist(rows, KINDS))
                            rows.clear()
                        carried = last["bucket"] if same and not dated else None
                        rows.append({"object": name, "bundle_id": b, "file_id": f, "controller": c, "bucket": carried, "start": at, "first_line": n, "dated_from": None, "dated_to": None})
                    row = rows[-1]
                    at += len(raw)
                    row["stop"], row["last_line"] = at, n
                    if dated:
                        row["bucket"], row["dated_to"] = bucket, n
                        row["dated_from"] = n if row["dated_from"] is None else row["dated_from"]
                    parts.append(raw)
                out.write(b"".join(parts))
            if rows:
                index.write_table(pa.Table.from_pylist(rows, KINDS))
        if not rows:
            store.delete_file(f"{base}/objects/{name}.log")
            store.delete_file(f"{base}/index/{name}.parquet")
            return _Made(None)
        return _Made(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        made = [m.name for m in messages if m is not None and m.name]
        Manifests(self.folder).publish(lambda now: {"objects": ([] if self.overwrite else now.get("objects", [])) + made})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = opened(self.folder)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{base}/objects/{m.name}.log")
                store.delete_file(f"{base}/index/{m.name}.parquet")


class _Made(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name  # none where a task had no lines


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.equal: dict[str, set] = {}
        self.low, self.high = float("-inf"), float("inf")

    def pushFilters(self, filters):  # noqa: N802
        """All filters are looked at again by Spark; these choose what is read."""
        self.equal, self.low, self.high = {}, float("-inf"), float("inf")
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, (EqualTo, In)) and column in (("bundle_id",), ("file_id",), ("controller",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.equal[column[0]] = self.equal.get(column[0], values) & values
            elif column == ("raw_ts",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value)
            elif column == ("raw_ts",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value)
            elif column == ("raw_ts",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            yield f

    def partitions(self):
        return [InputPartition(name) for name in Manifests(self.folder).read()[1].get("objects", [])]

    def read(self, partition):
        store, base = opened(self.folder)
        with store.open_input_file(f"{base}/index/{partition.value}.parquet") as f:
            index = pq.ParquetFile(f)
            for batch in index.iter_batches(HELD):
                yield from _lines(self.folder, self._met(pa.Table.from_batches([batch])))

    def _met(self, index: pa.Table) -> list[dict]:
        """The stretches that can hold lines asked for."""
        for column, values in self.equal.items():
            index = index.filter(pc.is_in(index[column], pa.array(sorted(values, key=str), index[column].type)))
        if (self.low, self.high) != (float("-inf"), float("inf")):
            # A stretch has its dated lines in one bucket; where undated times are asked for, it may have those too.
            meets = pc.and_(pc.greater_equal(index["bucket"], int(max(self.low, 0) // BUCKET_SECONDS)), pc.less_equal(index["bucket"], int(min(self.high, 1e15) // BUCKET_SECONDS)))
            index = index.filter(pc.fill_null(meets, False)) if self.low >= USABLE else index
        return index.select(["object", "bundle_id", "file_id", "controller", "start", "stop"]).to_pylist()


def _lines(folder: str, ranges: list[dict]) -> Iterator[pa.RecordBatch]:
    """Lines of byte ranges, in order; ranges that touch are read with one seek, and no other byte is read.

    Lines of short ranges come together, so that a window of many files is not many batches of a line; long lines end a
    batch by their size.
    """
    rows: list[tuple] = []
    held = 0
    for row in _rows(folder, ranges):
        rows.append(row)
        held += len(row[-1])
        if len(rows) == BATCH or held >= READ:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    bundle, file, controller, n, t, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict(
        {
            **{c: pa.array(v, pa.string()) for c, v in (("bundle_id", bundle), ("file_id", file), ("controller", controller))},
            "line_no": pa.array(map(int, n), pa.int64()),
            "raw_ts": pa.array([float(x) if x else None for x in t], pa.float64()),
            "text": pa.array(text, pa.string()),
        }
    )


def _rows(folder: str, ranges: list[dict]) -> Iterator[tuple]:
    store, base = opened(folder)
    i = 0
    while i < len(ranges):
        j = i + 1
        while j < len(ranges) and ranges[j]["object"] == ranges[i]["object"] and ranges[j]["start"] == ranges[j - 1]["stop"] and ranges[j]["stop"] - ranges[i]["start"] <= READ:
            j += 1
        start = ranges[i]["start"]
        with store.open_input_file(f"{base}/objects/{ranges[i]['object']}.log") as f:
            f.seek(start)
            data = f.read(ranges[j - 1]["stop"] - start)
        for r in ranges[i:j]:
            for x in data[r["start"] - start : r["stop"] - start].decode().split("\n")[:-1]:
                yield (r["bundle_id"], r["file_id"], r["controller"], *x.split("\t", 2))
        i = j


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogStore)


def write(lines: DataFrame, folder: str, objects: int | None = None, overwrite: bool = False) -> None:
    """Lines (bundle_id, file_id, controller, line_no, raw_ts, text) added to a store; each file's lines in order."""
    register(lines.sparkSession)
    keys = ["bundle_id", "file_id", "line_no"]
    dealt = lines.select("bundle_id", "file_id", "controller", F.col("line_no").cast("long"), "raw_ts", "text")
    dealt = dealt.repartitionByRange(objects, *keys) if objects else dealt.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.format("log_store").option("path", folder).mode("overwrite" if overwrite else "append").save()


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of a store, for filters to choose from.

    Spark keeps what a scan was told to read for further queries on the same frame that push nothing.  So the frame has a
    filter of its own that always holds and is always pushed, and every query tells the source anew.
    """
    register(spark)
    return spark.read.format("log_store").option("path", folder).load().filter("line_no >= 0")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all objects."""
    names = Manifests(folder).read()[1].get("objects", [])
    kind = ", ".join(INDEX.split(", "))
    return spark.read.schema(kind).parquet(*(f"{folder.rstrip('/')}/index/{n}.parquet" for n in names)) if names else spark.createDataFrame([], kind)


def ranges(spark: SparkSession, folder: str, files: DataFrame, start: float, end: float, undated: bool = False) -> DataFrame:
    """Stretches (rows of the index) that a range query over these files reads.

    Of a file on the wall clock those of the window's buckets on the file's own clock, and the next; with `undated` all
    from the first to the last of these, for lines without a time between them.  Of a segmented file, whose lines have no
    wall-clock times, and with `undated` of a file without an offset, all.
    """
    from fieldtrace.operators.range_query import sent

    own = files.select(F.col("file_id").alias("_file"), F.col("clock_offset").alias("_offset"), F.col("offset_method").alias("_method"))
    held = index(spark, folder).join(sent(own, "_file"), F.col("file_id") == F.col("_file"))
    bucket = lambda t: F.floor(t / BUCKET_SECONDS)
    met = F.coalesce(F.col("bucket").between(bucket(F.lit(start) - F.col("_offset")), bucket(F.lit(end) - F.col("_offset")) + 1), F.lit(False))
    plain = F.col("_method") != "segmented"
    if undated:
        reach = held.filter(plain & met).groupBy("file_id").agg(F.min("dated_from").alias("_from"), F.max("dated_to").alias("_to"))
        held = held.join(sent(reach), "file_id", "left")
        met = met | ((F.col("last_line") >= F.col("_from")) & (F.col("first_line") <= F.col("_to"))) | F.col("_offset").isNull()
    whole = F.lit(True) if undated else F.col("_offset").isNotNull()
    return held.filter(F.when(plain, met & whole).otherwise(F.lit(True))).select(*(c.split()[0] for c in INDEX.split(", ")))


def read_ranges(stretches: DataFrame, folder: str) -> DataFrame:
    """Lines of stretches; those of one object are read in order by few tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _lines(folder, batch.to_pylist())

    asked = stretches.select("object", "bundle_id", "file_id", "controller", "start", "stop")
    return asked.repartitionByRange("object", "start").sortWithinPartitions("object", "start").mapInArrow(work, SCHEMA)


def window(spark: SparkSession, folder: str, files: DataFrame, start: float, end: float, undated: bool = False) -> DataFrame:
    """The lines that `range_query.query` needs for a window, read by the index."""
    from fieldtrace.operators.range_query import overlapping

    segmented = F.col("offset_method") == "segmented"
    plain = overlapping(files, start, end).filter(~segmented)
    rest = files.filter(segmented | (F.lit(undated) & F.col("clock_offset").isNull()))
    own = plain.select("file_id", "clock_offset", "offset_method").unionByName(rest.select("file_id", "clock_offset", "offset_method"))
    return read_ranges(ranges(spark, folder, own, start, end, undated), folder)

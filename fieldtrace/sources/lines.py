"""Log lines with their number and byte offset, from text files and DLT traces of any size.

A file is cut into splits of a fixed number of bytes, each read by itself.  A text line belongs to the split that holds its
first byte.  A trace's messages form a chain, each found from the one before; a split guesses its first message at the
first mark, and a chain of guesses that do not meet is walked again from where the split before it ended, until all meet.
Numbers are prefix sums of the splits' counts.  Only rows about splits are shuffled, never lines.
"""

from __future__ import annotations

import codecs
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldtrace.functions import text as T
from fieldtrace.functions import timeparse as P
from fieldtrace.sources.archives import listed
from fieldtrace.sources.tables import stage
from fieldtrace.sources.versions import opened

MAGIC = b"DLT\x01"
BOM = codecs.BOM_UTF8
#: Bytes of a split, bytes read at once, and rows of a batch.
SPLIT, PIECE, ROWS = 16 << 20, 4 << 20, 20_000
#: Tasks of a pass over splits at most.
TASKS = 20_000


def text_lines(content: bytes) -> Iterator[tuple[int, int, str]]:
    """(number, byte offset, text) of content in memory: lines end at \\n, trailing \\r goes, a byte order mark is skipped, bad bytes are replaced."""
    at = len(BOM) if content.startswith(BOM) else 0
    number = 0
    while at < len(content):
        end = content.find(b"\n", at)
        stop = len(content) if end < 0 else end
        yield number, at, content[at:stop].rstrip(b"\r\n").decode("utf-8", "replace")
        number, at = number + 1, stop + 1


def _pieces(f, at: int, stop: int) -> Iterator[tuple[int, bytes]]:
    while at < stop:
        f.seek(at)
        piece = f.read(min(PIECE, stop - at))
        if not piece:
            return
        yield at, piece
        at += len(piece)


def count_lines(f, size: int, start: int, stop: int) -> int:
    """Lines that begin in [start, stop)."""
    first = 0
    if start == 0:
        f.seek(0)
        skip = len(BOM) if f.read(len(BOM)) == BOM else 0
        first = int(size > skip)
    return first + sum(piece.count(b"\n") for _, piece in _pieces(f, max(0, start - 1), min(stop, size) - 1))


def split_lines(f, size: int, start: int, stop: int) -> Iterator[tuple[int, str]]:
    """(byte offset, text) of the lines that begin in [start, stop); the last one is read to its end, wherever that is."""
    at = start
    if start:
        found = next((p + i for p, piece in _pieces(f, start - 1, min(stop, size) - 1) if (i := piece.find(b"\n")) >= 0), None)
        if found is None:
            return
        at = found + 1
    else:
        f.seek(0)
        at = len(BOM) if f.read(len(BOM)) == BOM else 0
        stop = max(stop, at + 1)  # the first line is the first split's, mark or not
    held: list[bytes] = []
    begun = at
    for p, piece in _pieces(f, at, size):
        cut = piece.split(b"\n")
        for part in cut[:-1]:
            if begun >= stop:
                return
            held.append(part)
            line = b"".join(held)
            yield begun, line.rstrip(b"\r\n").decode("utf-8", "replace")
            begun += len(line) + 1
            held.clear()
        if begun >= stop:
            return
        held.append(cut[-1])
    if begun < min(stop, size):
        yield begun, b"".join(held).rstrip(b"\r\n").decode("utf-8", "replace")


class Trace:
    """A DLT trace, walked from any place; broken stretches are skipped to the next mark."""

    def __init__(self, f, size: int):
        self.f, self.size = f, size
        self.at, self.piece = 0, b""

    def _hold(self, at: int, n: int) -> None:
        if not (self.at <= at and at + n <= self.at + len(self.piece)):
            self.f.seek(at)
            self.at, self.piece = at, self.f.read(max(n, PIECE))

    def _bytes(self, at: int, n: int) -> bytes:
        self._hold(at, n)
        return self.piece[at - self.at : at - self.at + n]

    def mark(self, at: int, stop: int) -> int | None:
        """The first mark at or after a place and before `stop`."""
        while at < min(stop, self.size):
            self._hold(at, len(MAGIC))
            i = self.piece.find(MAGIC, at - self.at)
            if i >= 0:
                return self.at + i if self.at + i < stop else None
            at = max(at + 1, self.at + len(self.piece) - len(MAGIC) + 1)
        return None

    def message(self, at: int) -> tuple[tuple | None, int]:
        """(message, place to go on): the message is None where what the mark promises is not there."""
        raw = self._bytes(at, 20)
        seconds, micros = struct.unpack_from("<Ii", raw, 4)
        ecu, head = raw[12:16], raw[16]
        (length,) = struct.unpack_from(">H", raw, 18)
        stop, p = at + 16 + length, at + 20
        body = self._bytes(p, max(0, min(stop, self.size) - p))
        names, skip = [b"", b""], 0
        if head & 4:
            ecu, skip = body[:4], 4
        skip += 4 * bool(head & 8) + 4 * bool(head & 16)
        if head & 1:
            names, skip = [body[skip + 2 : skip + 6], body[skip + 6 : skip + 10]], skip + 10
        if length < 4 or stop > self.size or p + skip > stop:
            return None, at + 1
        tidy = lambda b: b.rstrip(b"\0").decode("ascii", "replace")
        return (seconds + max(micros, 0) / 1e6, tidy(ecu), tidy(names[0]), tidy(names[1]), body[skip:]), stop

    def chain(self, entry: int | None, stop: int) -> Iterator[tuple[int, tuple | None]]:
        """(place, message) of the chain from `entry` on, while it lies before `stop`; at last the place where it goes on, and None."""
        at = entry
        while at is not None and at < stop and at <= self.size - 20:
            message, after = self.message(at)
            if message is not None:
                yield at, message
            # A mark within the next split belongs to it, but a chain that crosses a split looks for it there.
            at = self.mark(after, self.size)
        yield -1 if at is None or at > self.size - 20 else at, None


def dlt_messages(content: bytes) -> Iterator[tuple[int, int, float, str, str, str, bytes]]:
    """(number, byte offset, time, ecu, application, context, payload) of a trace in memory."""
    import io

    trace = Trace(io.BytesIO(content), len(content))
    number = 0
    for at, message in trace.chain(trace.mark(0, len(content)), len(content)):
        if message is not None:
            yield number, at, *message
            number += 1


# --- splits -------------------------------------------------------------------------------------------------------


def splits(files: DataFrame, size: int = SPLIT) -> DataFrame:
    """Files (uri, size_bytes) with `split`, `start` and `stop`, a row for each split."""
    last = F.greatest(F.ceil(F.col("size_bytes") / size), F.lit(1)).cast("long") - 1
    each = files.withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return each.withColumns({"start": F.col("split") * size, "stop": F.least((F.col("split") + 1) * size, F.col("size_bytes"))})


def _spread(df: DataFrame) -> DataFrame:
    """Few rows that mean much work each, dealt one by one."""
    return df.repartition(max(1, min(TASKS, df.count())))


#: What says how to read a split; rows that come from it do not carry it on.
HOW = {"size_bytes", "split", "start", "stop", "lines", "base", "entry", "leave", "messages"}


def _each(df: DataFrame, more: str, work: Callable, hidden: set[str] = frozenset()) -> DataFrame:
    """`df` with columns added to each row by `work(open file, row)`, which yields batches of values; columns of a row are repeated, but for hidden ones."""
    added = [x.split() for x in more.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    kept = [f for f in df.schema.fields if f.name not in {n for n, _ in added} | hidden]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                store, path = opened(row["uri"])
                with store.open_input_file(path) as f:
                    for columns in work(f, row):
                        n = len(columns[0])
                        same = [pa.repeat(pa.scalar(row[x.name], batch.schema.field(x.name).type), n) for x in kept]
                        yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, kinds[t]) for c, (_, t) in zip(columns, added, strict=True))], names=[*(x.name for x in kept), *(n for n, _ in added)])

    return df.mapInArrow(run, schema)


def _batched(rows: Iterator[tuple]) -> Iterator[list[list]]:
    """Rows as columns, in batches bounded by rows and by size of text."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[-1] or "")
        if len(held) >= ROWS or weight >= 4 * PIECE:
            yield [list(c) for c in zip(*held, strict=True)]
            held, weight = [], 0
    if held:
        yield [list(c) for c in zip(*held, strict=True)]


def _before(value: str) -> Column:
    """What the splits of a file before each one sum to."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("uri").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def read_text(files: DataFrame, size: int = SPLIT, hidden: set[str] = frozenset()) -> DataFrame:
    """Lines of text files (uri, size_bytes, further columns): `line_no`, `byte_offset`, `text` and all columns but `size_bytes` and hidden ones."""
    cut = splits(files, size)
    counted = stage(_each(_spread(cut), "lines long", lambda f, r: iter([[[count_lines(f, r["size_bytes"], r["start"], r["stop"])]]])), "splits")
    based = counted.withColumn("base", _before("lines")).filter("lines > 0")

    def work(f, r):
        rows = ((r["base"] + i, at, text) for i, (at, text) in enumerate(split_lines(f, r["size_bytes"], r["start"], r["stop"])))
        return _batched(rows)

    return _each(_spread(based), "line_no long, byte_offset long, text string", work, HOW | hidden)


def read_trace(files: DataFrame, size: int = SPLIT, hidden: set[str] = frozenset()) -> DataFrame:
    """Messages of DLT traces, as `read_text` has lines: `line_no`, `byte_offset`, `trace_ts`, `who`, `payload` and the files' columns."""

    def walk(f, r):
        """First and last place and number of the messages of a split, from a place that is given or guessed."""
        trace = Trace(f, r["size_bytes"])
        entry = trace.mark(r["start"], r["stop"]) if r["entry"] is None else (r["entry"] if r["entry"] >= 0 else None)
        n, leave = 0, -1
        if entry is None:
            leave = -2  # whoever comes here passes through
        else:
            for at, message in trace.chain(entry, r["stop"]):
                n, leave = (n + 1, leave) if message is not None else (n, at)
        return iter([[[entry if entry is not None else -1], [leave], [n]]])

    columns = "entry long, leave long, messages long"
    known = stage(_each(_spread(splits(files, size).withColumn("entry", F.lit(None).cast("long"))), columns, walk), "splits")
    while True:
        # Where the splits before one leave to: a split without messages is passed through.
        order = Window.partitionBy("uri").orderBy("split")
        left = F.last(F.when(F.col("leave") != -2, F.col("leave")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        due = known.withColumn("_left", left).withColumn("_due", F.when(F.col("_left").isNull(), F.col("entry")).when((F.col("_left") >= 0) & (F.col("_left") < F.col("stop")), F.col("_left")).otherwise(-1))
        wrong = F.col("_due") != F.col("entry")
        # The first split that is not met is walked again from where it should begin, and those behind it are looked at again.
        marked = stage(due.withColumn("_first", F.min(F.when(wrong, F.col("split"))).over(Window.partitionBy("uri"))), "splits")
        again = marked.filter("split = _first")
        if again.isEmpty():
            break
        redone = _each(_spread(again.withColumn("entry", F.col("_due")).select(*known.columns)), columns, walk)
        known = stage(marked.filter("_first is null or split <> _first").select(*known.columns).unionByName(redone.select(*known.columns)), "splits")

    def work(f, r):
        found = ((at, m) for at, m in Trace(f, r["size_bytes"]).chain(r["entry"], r["stop"]) if m is not None)
        return _batched((r["base"] + i, at, m[0], " ".join(m[1:4]), m[4]) for i, (at, m) in enumerate(found))

    based = known.withColumn("base", _before("messages")).filter("messages > 0")
    return _each(_spread(based), "line_no long, byte_offset long, trace_ts double, who string, payload binary", work, HOW | hidden)


# --- decoders -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Decoder:
    """How files of some controllers are read: the first decoder of a file's controller that accepts it takes it.

    `accepts` is a condition on name and first bytes.  `reader` is `read_text`, `read_trace` or a function of the same kind.
    `time` adds `raw_ts`, and `text` is an expression, over the reader's columns and those of the file (controller,
    year).
    """

    name: str
    controllers: tuple[str, ...]
    accepts: Callable[[Column, Column], Column]
    reader: Callable[[DataFrame, int, set[str]], DataFrame]
    time: Callable[[DataFrame], DataFrame]
    text: Callable[[], Column]


def _stamp(seconds: Column, digits: int) -> Column:
    return F.date_format(F.timestamp_micros((seconds * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss." + "S" * digits)


def _ibdu_text() -> Column:
    payload = P.part(F.col("text"), P.IBDU, 8)
    return F.coalesce(F.concat(_stamp(P.ibdu(F.col("text")), 3), F.lit(" "), T.hex_text(payload), F.lit(" (raw="), payload, F.lit(")")), "text")


EVERY = ("android", "fota", "kernel", "tbox", "mcu", "ibdu")
#: Files that hold no lines whatever their controller.
NO_LINES = r"\.(db|db-journal|bin)$"
DECODERS = (
    Decoder("trace", EVERY, lambda name, head: F.startswith(head, F.lit(MAGIC)), read_trace, lambda df: df.withColumn("raw_ts", F.col("trace_ts")), lambda: F.concat_ws(" ", _stamp(F.col("trace_ts"), 6), "who", T.printable(F.col("payload")))),
    Decoder("ibdu", ("ibdu",), lambda name, head: F.lit(True), read_text, P.timed, _ibdu_text),
    Decoder("text", ("android", "fota", "kernel", "tbox", "mcu"), lambda name, head: F.lit(True), read_text, P.timed, lambda: F.col("text")),
)


def chosen(files: DataFrame, decoders: tuple[Decoder, ...] = DECODERS) -> DataFrame:
    """`files` with `decoder`, the number of the one that takes each; files that none takes are left out."""
    takes = F.lit(None).cast("int")
    for i, d in reversed(list(enumerate(decoders))):
        takes = F.when(F.col("controller").isin(*d.controllers) & F.coalesce(d.accepts(F.col("original_name"), F.col("head")), F.lit(False)), i).otherwise(takes)
    return files.filter(~F.lower("original_name").rlike(NO_LINES)).withColumn("decoder", takes).filter("decoder is not null")


def decode(files: DataFrame, decoders: tuple[Decoder, ...] = DECODERS, size: int = SPLIT) -> DataFrame:
    """`lines` of stored files (bundle_id, file_id, controller, original_name, uri, size_bytes, head, modified); unknown files have none."""
    taken = stage(chosen(files, decoders).select("bundle_id", "file_id", "controller", P.year_hint(F.col("original_name"), F.col("modified")).alias("year"), "uri", "size_bytes", "decoder"), "decoders")
    parts = []
    for i, d in enumerate(decoders):
        own = taken.filter(F.col("decoder") == i).drop("decoder")
        if not own.isEmpty():
            parts.append(d.time(d.reader(own, size, {"uri"})).select("bundle_id", "file_id", "controller", "line_no", "byte_offset", "raw_ts", d.text().alias("text")))
    none = taken.sparkSession.createDataFrame([], "bundle_id string, file_id string, controller string, line_no long, byte_offset long, raw_ts double, text string")
    return reduce(DataFrame.unionByName, parts) if parts else none


def log_lines(spark: SparkSession, path: str, pattern: str = "*", size: int = SPLIT) -> DataFrame:
    """Numbered lines of the text files below a folder: uri, modified, line_no, byte_offset, text."""
    return read_text(listed(spark, path, pattern), size)


class LinesSource(DataSource):
    """`spark.read.format("log_lines").load(folder)`: path, byte_offset, text; one partition per split of `splitBytes` bytes.

    Numbers need a count of the splits before: `log_lines` gives them.
    """

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "path string, byte_offset long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _LinesReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))


class _LinesReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self):
        from pyarrow import fs

        store, base = opened(self.path)
        found = store.get_file_info(base)
        inside = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        return [InputPartition((i.path, i.size, at)) for i in inside if i.is_file for at in range(0, max(i.size, 1), self.size)]

    def read(self, partition):
        path, size, start = partition.value
        with opened(self.path)[0].open_input_file(path) as f:
            for at, text in _batched((at, text) for at, text in split_lines(f, size, start, min(size, start + self.size))):
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(at), pa.string()), "byte_offset": pa.array(at, pa.int64()), "text": pa.array(text, pa.string())})


def keyword_files(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """One row per .log or .txt file that has lines with the words: its name and these lines, in file order, under a header."""
    low = F.lower("value")
    hit = F.lit(not words)
    for w in words:
        hit = hit | low.contains(w.lower())
    read = spark.read.option("pathGlobFilter", "*.{log,txt}").option("recursiveFileLookup", "true").text(path, lineSep="\n")
    named = read.select(F.col("_metadata.file_name").alias("name"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), "value").filter(hit)
    return named.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n").alias("_t")).select("name", F.concat(F.lit("=== "), "name", F.lit(" ===\n"), "_t").alias("text"))

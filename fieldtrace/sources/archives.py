"""Bundles: archives unpacked in tasks, member after member, into the cluster's store.

`extract(spark, paths, store)` gives one row per member: bundle_id, seq, bundle_relative_path, original_name, uri, sha256,
size_bytes, file_id, head.  Zip, tar (also gzipped), gzip and plain log files are read; archives inside archives up to five
deep.  Rar needs the optional package `rarfile`.

A member goes to the store in pieces of CHUNK bytes, so that a task holds one piece of an archive of any size; an archive
inside an archive is put beside it first, as its directory may stand at its end.  A member's file appears under its final
name when it is whole; a task that runs again writes the same bytes to the same name.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.sources.versions import opened

DEPTH = 5
CHUNK = 4 << 20
#: First bytes of a member that come with its row, for rules that look at content.
HEAD = 8192
UPLOAD_PREFIX = re.compile(r"^[0-9a-f]{32}__")
UNSAFE = r'[\\/:*?"<>|\x00-\x1f]'
MEMBERS = "bundle_id string, seq long, bundle_relative_path string, original_name string, uri string, sha256 string, size_bytes long, file_id string, head binary"


def member_name(raw: str, flag_bits: int) -> str:
    """Name of a zip member; without the UTF-8 flag it may be GBK that was read as code page 437."""
    if flag_bits & 0x800:
        return raw
    try:
        return raw.encode("cp437").decode("gbk")
    except UnicodeError:
        return raw


def skipped(name: str) -> bool:
    parts = name.split("/")
    return not name or name.endswith("/") or name.startswith(("/", "__MACOSX/")) or parts[-1] == ".DS_Store" or ".." in parts


def kind_of(name: str) -> str:
    low = name.lower()
    for suffix, kind in ((".zip", "zip"), (".tar", "tar"), (".tar.gz", "tar"), (".tgz", "tar"), (".gz", "gz"), (".rar", "rar")):
        if low.endswith(suffix) and not (suffix == ".gz" and low.endswith(".tar.gz")):
            return kind
    return "plain"


def members(name: str, f: BinaryIO) -> Iterator[tuple[str, BinaryIO]]:
    """(path, open stream) of the members of one archive, each to be read before the next; `f` can seek."""
    kind = kind_of(name)
    if kind == "zip":
        with zipfile.ZipFile(f) as z:
            for i in z.infolist():
                if not i.is_dir():
                    with z.open(i) as member:
                        yield member_name(i.filename, i.flag_bits), member
    elif kind == "tar":
        with tarfile.open(fileobj=f, mode="r:*") as t:
            for i in t:
                if i.isfile():
                    yield i.name, t.extractfile(i)
    elif kind == "gz":
        with gzip.GzipFile(fileobj=f) as member:
            yield name[: -len(".gz")], member
    else:
        try:
            import rarfile
        except ImportError as e:
            raise RuntimeError(f"{name}: rar archives need the package rarfile") from e
        with rarfile.RarFile(f) as r:
            for i in r.infolist():
                if not i.is_dir():
                    with r.open(i) as member:
                        yield i.filename, member


def stored_name(file_id: str, name: str) -> str:
    """Unsafe characters become underscores, names end at 200 characters."""
    return f"{file_id}__{re.sub(UNSAFE, '_', name)[-200:]}"


class Unpacker:
    """Puts the members of archives into a folder of a store."""

    def __init__(self, store: str):
        self.base = store.rstrip("/")
        self.fs, self.path = opened(self.base)

    def _copy(self, source: BinaryIO, beside: str) -> tuple[str, int, bytes]:
        digest, size, head = hashlib.sha256(), 0, b""
        with self.fs.open_output_stream(beside) as out:
            while piece := source.read(CHUNK):
                digest.update(piece)
                size += len(piece)
                head = (head + piece[:HEAD])[:HEAD]
                out.write(piece)
        return digest.hexdigest(), size, head

    def unpack(self, bundle: str, name: str, source: BinaryIO, depth: int = 0) -> Iterator[dict]:
        """A row for each member of an open archive or plain file, archives inside included."""
        folder = f"{self.path}/{re.sub(UNSAFE, '_', bundle)}"
        self.fs.create_dir(folder, recursive=True)
        if kind_of(name) != "plain" and depth < DEPTH:
            for inner, member in members(name, source):
                if skipped(inner):
                    continue
                if kind_of(inner) == "plain" or depth + 1 >= DEPTH:
                    yield from self.unpack(bundle, inner, member, DEPTH)
                else:
                    beside = f"{folder}/.{uuid.uuid4().hex}"
                    self._copy(member, beside)
                    try:
                        with self.fs.open_input_file(beside) as again:
                            yield from self.unpack(bundle, inner, again, depth + 1)
                    finally:
                        self.fs.delete_file(beside)
            return
        file_id = hashlib.sha256(f"{bundle}|{name}".encode()).hexdigest()
        beside, original = f"{folder}/.{uuid.uuid4().hex}", name.rsplit("/", 1)[-1]
        sha, size, head = self._copy(source, beside)
        final = stored_name(file_id, original)
        self.fs.move(beside, f"{folder}/{final}")
        yield {"bundle_id": bundle, "bundle_relative_path": name, "original_name": original, "uri": f"{self.base}/{re.sub(UNSAFE, '_', bundle)}/{final}", "sha256": sha, "size_bytes": size, "file_id": file_id, "head": head}


def extract(spark: SparkSession, paths: list[str] | str, store: str) -> DataFrame:
    """Members of all archives, in archive order, put into `store`; one archive is one task's work, a piece of it at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in MEMBERS.split(", "))])
        unpacker = Unpacker(store)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                name = UPLOAD_PREFIX.sub("", uri.rsplit("/", 1)[-1])
                source, path = opened(uri)
                with source.open_input_file(path) as f:
                    for seq, row in enumerate(unpacker.unpack(name, name, f)):
                        yield pa.RecordBatch.from_pylist([row | {"seq": seq}], kind)

    named = spark.read.format("binaryFile").load(paths).select("path")  # names alone: no content is read here
    return named.repartition(max(1, named.count())).mapInArrow(work, MEMBERS)


def stored_path(bundle: Column, controller: Column, file_id: Column, name: Column) -> Column:
    """Where a file is kept: unsafe characters become underscores, names end at 200 characters."""
    safe = F.right(F.regexp_replace(name, UNSAFE, "_"), F.lit(200))
    return F.concat_ws("/", bundle, controller, F.concat(file_id, F.lit("__"), safe))


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(uri, size_bytes, modified) of the files below a folder, by name and not by content."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return read.select(F.col("path").alias("uri"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))

"""Token ids as flat binary files.

A data set is a folder of parts.  Part p has `p.bin`, the ids as unsigned integers of one width, little-endian, and
`p.idx`, two 64-bit little-endian integers for each document: its id and the end of its ids within the part.  Parts
hold ascending ranges of document ids; a part's base is the sum of all ids in earlier parts (a prefix sum over the
parts' totals), so a document's global offset is base + local offset.  Files are read through a memory map where the
file system has one.

Writing is idempotent: each attempt writes files of its own name and the manifest lists those of the attempt that
Spark counts, so retried and speculative tasks do no harm.

Ids are those of the library with its defaults: the text of a special token in a document becomes its one id.

Defined cases: a null or empty text has the end id alone; null document ids come first and are stored as the smallest
64-bit integer; rows with the same document id follow each other, ordered by the text's hash, then the text; a text of
any length is encoded whole; other columns, whatever their names, are not read; an empty table gives an empty data set.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrace.llm.common import Saved, new_dir

NULL_ID = -(1 << 63)
#: Words whose ids a worker remembers; the store is emptied when full, which changes no result.
REMEMBERED = 800_000


class WordEncoder:
    """Ids of a text by a tokenizers file that treats the pieces between spaces and line ends on their own.

    A word whose normal form is letters alone is one piece, which one id with the word-end mark closes: fresh ones are
    encoded together, as one text, and cut at these ids.  A sign after such a word is a piece of its own.  All other
    words, those with text of special tokens among them, go to the library one by one.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.width = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.letters_only = regex.compile(r"\p{L}+").fullmatch
        self.signs = {c: self._ids(c) for c in ".,;:!?"}

    def _ids(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def one_piece(self, word: str) -> bool:
        """Whether the library keeps the word in one piece; lower case or composition may turn one letter into two signs."""
        if not word.isalpha():
            return False
        return word.isascii() or self.letters_only(self.model.normalizer.normalize_str(word)) is not None

    def _letters(self, fresh: list[str]) -> None:
        ids = np.array(self.model.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, self.width)
        ends = ((np.flatnonzero(self.closes[ids]) + 1) * self.width.itemsize).tolist()
        raw = ids.tobytes()
        self.known.update(zip(fresh, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def learn(self, fresh: set[str]) -> None:
        alone = {w for w in fresh if self.one_piece(w)}
        signed = [w for w in fresh if w[-1:] in self.signs and (w[:-1] in alone or self.one_piece(w[:-1]))]
        letters = alone.union(w[:-1] for w in signed).difference(self.known)
        if letters:
            self._letters(list(letters))
        for w in signed:
            self.known[w] = self.known[w[:-1]] + self.signs[w[-1]]
        rest = [w for w in fresh if w not in self.known]
        for w, e in zip(rest, self.model.encode_batch_fast(rest, add_special_tokens=False) if rest else [], strict=True):
            self.known[w] = np.array(e.ids, self.width).tobytes()

    def encode(self, text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        fresh = set(parts).difference(self.known)
        if fresh:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                fresh = set(parts)
            self.learn(fresh)
        return b"".join(map(self.known.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _open(folder: str):
    """(file system, path) of a folder given as URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write(df: DataFrame, folder: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the data set and returns its manifest: part, name, width, n_docs, n_tokens, base."""
    spark = df.sparkSession

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fs, docs, total = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            c = encoder(path)
            if fs is None:
                fs, base = _open(folder)
                name = f"{part:06d}-{uuid.uuid4().hex[:8]}"
                end = np.array([end_id], c.width).tobytes()
                out = fs.open_output_stream(f"{base}/{name}.bin")
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids = c.encode(t.as_py() or "") + end
                out.write(ids)
                total += len(ids) // c.width.itemsize
                docs.append((NULL_ID if i.as_py() is None else i.as_py(), total))
        if fs is not None:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.idx") as index:
                index.write(np.array(docs, "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "width": [c.width.itemsize], "n_docs": [len(docs)], "n_tokens": [total]})

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The text's hash spreads rows that share an id.
    placed = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    parts = Saved(placed.mapInArrow(put, "part long, name string, width long, n_docs long, n_tokens long"), "token-parts").df
    # One row for each part: small even where the corpus is not.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = Saved(parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))), "token-manifest")
    return manifest.df


def read(manifest: DataFrame, folder: str, piece: int = 1 << 22) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit)."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, base = _open(folder)
                with fs.open_input_file(f"{base}/{row['name']}.idx") as index:
                    docs = np.frombuffer(index.read(), "<i8").reshape(-1, 2)
                kind = np.dtype(f"<u{row['width']}")
                ids = _mapped(fs, f"{base}/{row['name']}.bin", kind)
                starts = np.concatenate([[0], docs[:-1, 1]])
                for at in range(0, len(docs), 5000):
                    part = slice(at, at + 5000)
                    crc = [zlib.crc32(ids(a, b).astype("<u4").tobytes()) for a, b in zip(starts[part].tolist(), docs[part, 1].tolist(), strict=True)]
                    keys = docs[part, 0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, mask=keys == NULL_ID), pa.array(starts[part] + row["base"]), pa.array(docs[part, 1] - starts[part]), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    parts = manifest.repartition(F.col("part"))
    return parts.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _mapped(fs, path: str, kind: np.dtype):
    """A function (from, to) -> ids: by a memory map on a local file, else by ranged reads."""
    from pyarrow import fs as afs

    if isinstance(fs, afs.LocalFileSystem):
        ids = np.memmap(path, kind, mode="r")
        return lambda a, b: ids[a:b]
    file = fs.open_input_file(path)
    return lambda a, b: np.frombuffer(file.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)


def round_trip(spark: SparkSession, df: DataFrame, path: str, end_id: int) -> DataFrame:
    folder = new_dir(spark, "token-files")
    return read(write(df, folder, path, end_id), folder)

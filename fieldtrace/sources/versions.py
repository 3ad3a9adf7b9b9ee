"""Tables below a folder, changed as a whole: new files first, then one new manifest that names what holds.

A manifest is a numbered file; the highest number is the present version.  Readers take the files that it names and no
others, so that a failure at any step before it leaves the version before, and whatever lies beside is never read.  A
manifest appears at once or not at all, and a number can be taken once: of two writers one begins again on the other's
version.  The store must refuse to rename onto an existing file, as file systems and HDFS do.

A table's rows are kept by a key, a bundle as a rule: a manifest has an entry for each table and bundle.  It also keeps
notes, such as the last batch that a stream has stored: rows and note appear together, so that a batch that is brought
again after a failure is known.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


#: Where a manifest keeps its notes.
NOTES = "_notes"


class Manifests:
    """Numbered manifests of a folder."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self.store, self.path = opened(f"{self.folder}/_versions")

    def numbers(self) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(int(i.base_name.removesuffix(".json")) for i in found if i.base_name.endswith(".json"))

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """A version and its content; 0 and nothing before the first."""
        number = (self.numbers() or [0])[-1] if number is None else number
        if number == 0:
            return 0, {}
        with self.store.open_input_file(f"{self.path}/{number:012d}.json") as f:
            return number, json.loads(f.read())

    def _put(self, number: int, content: dict) -> bool:
        """Whether this version could be made; it cannot where another writer has made it."""
        self.store.create_dir(self.path, recursive=True)
        beside, final = f"{self.path}/.{uuid.uuid4().hex}", f"{self.path}/{number:012d}.json"
        with self.store.open_output_stream(beside) as f:
            f.write(json.dumps(content).encode())
        try:
            if isinstance(self.store, fs.LocalFileSystem):
                os.link(beside, final)  # a local rename would replace
            else:
                self.store.move(beside, final)
                return True
        except (FileExistsError, OSError):
            if self.store.get_file_info(final).type == fs.FileType.NotFound:
                raise
            return False
        finally:
            if self.store.get_file_info(beside).type != fs.FileType.NotFound:
                self.store.delete_file(beside)
        return True

    def publish(self, change: Callable[[dict], dict]) -> int:
        """A new version, made by `change` from the present one; made again where another came first."""
        while True:
            number, now = self.read()
            if self._put(number + 1, change(now)):
                return number + 1


class Tables:
    """Versioned tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str, by: str = "bundle_id"):
        self.spark, self.folder, self.by = spark, folder.rstrip("/"), by
        self.manifests = Manifests(folder)

    def _write(self, name: str, df: DataFrame) -> dict[str, str]:
        """Rows written beside all versions: the folder of each key."""
        place = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        # The key stays in the files too, so that a folder is read by itself.
        # Rebalanced, a key has few files, and one that holds a third of the rows is split.
        df.withColumn("_key", F.col(self.by).cast("string")).hint("rebalance", "_key").write.partitionBy("_key").parquet(place)
        store, path = opened(place)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {unquote(i.base_name.removeprefix("_key=")): f"{place}/{i.base_name}" for i in found if i.base_name.startswith("_key=")}

    def _change(self, tables: dict[str, DataFrame], note: tuple[str, int] | None, change: Callable[[dict[str, list[str]], dict[str, str]], None]) -> int:
        """One new version with rows of these frames, whose folders `change` puts into those of each table."""
        if note and self.noted(note[0]) >= note[1]:
            return self.manifests.read()[0]
        written = {name: self._write(name, df) for name, df in tables.items()}

        def changed(now: dict) -> dict:
            if note and now.get(NOTES, {}).get(note[0], -1) >= note[1]:
                return now  # another run of this batch came first
            out = json.loads(json.dumps(now))
            for name, places in written.items():
                entry = out.setdefault(name, {"folders": {}})
                entry["schema"] = tables[name].schema.json()
                change(entry["folders"], places)
            if note:
                out.setdefault(NOTES, {})[note[0]] = note[1]
            return out

        return self.manifests.publish(changed)

    def noted(self, name: str) -> int:
        """The last number noted under a name, -1 before the first."""
        return self.manifests.read()[1].get(NOTES, {}).get(name, -1)

    def replace(self, tables: dict[str, DataFrame], keys: list[str] | None = None, note: tuple[str, int] | None = None) -> int:
        """One new version, in which the rows of these keys in these tables are those of the frames.

        Without `keys` they are those that the frames have rows of.  All tables change together.
        """

        def change(folders: dict[str, list[str]], places: dict[str, str]) -> None:
            for gone in keys or ():
                folders.pop(gone, None)
            folders.update({k: [p] for k, p in places.items()})

        return self._change(tables, note, change)

    def append(self, tables: dict[str, DataFrame], note: tuple[str, int] | None = None) -> int:
        """One new version with these rows added; none where `note`, a name and a number, has been reached before."""

        def change(folders: dict[str, list[str]], places: dict[str, str]) -> None:
            for k, p in places.items():
                folders.setdefault(k, []).append(p)

        return self._change(tables, note, change)

    def drop(self, keys: list[str], names: list[str] | None = None) -> int:
        """One new version without the rows of these keys."""

        def change(now: dict) -> dict:
            out = json.loads(json.dumps(now))
            for name in names or [n for n in out if n != NOTES]:
                for key in keys:
                    out.get(name, {"folders": {}})["folders"].pop(key, None)
            return out

        return self.manifests.publish(change)

    def remove_rows(self, name: str, key: str, gone: Column) -> int:
        """One new version without the rows of a key for which `gone` holds."""
        rest = self.read(name).filter((F.col(self.by) == key) & ~F.coalesce(gone, F.lit(False)))
        return self.replace({name: rest}, [key])

    def read(self, name: str, version: int | None = None, keys: list[str] | None = None) -> DataFrame:
        """A table as a version has it, the present one by default; of some keys only, if asked for."""
        _, content = self.manifests.read(version)
        if name not in content:
            raise KeyError(f"no table {name} in {self.folder}")
        schema = StructType.fromJson(json.loads(content[name]["schema"]))
        folders = [p for k, ps in content[name]["folders"].items() if keys is None or k in keys for p in ps]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Removes all but the last versions, and files that none of them names; returns the versions that went.

        For times without writers: files of a version that is not published yet are named by none.
        """
        numbers = self.manifests.numbers()
        gone, kept = numbers[:-keep], numbers[-keep:]
        named = {opened(p)[1].rsplit("/", 1)[0] for n in kept for t, entry in self.manifests.read(n)[1].items() if t != NOTES for ps in entry["folders"].values() for p in ps}
        for n in gone:
            self.manifests.store.delete_file(f"{self.manifests.path}/{n:012d}.json")
        store, base = opened(self.folder)
        for table in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if table.type == fs.FileType.Directory and not table.base_name.startswith("_"):
                for place in store.get_file_info(fs.FileSelector(table.path)):
                    if place.path not in named:
                        store.delete_dir(place.path)
        return gone

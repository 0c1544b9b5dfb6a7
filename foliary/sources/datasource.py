"""Packages as a data source: `spark.read`, `spark.readStream` and `df.write` with format `packages`.

Reading lists the files under a path and takes the directory of each ZIP from its
end; a partition is a group of entries of bounded size, read by seeking, so
neither a package nor a folder is held whole. A file that is no package, as a
single upload may be, is one entry of its own. A stream picks up files in order of
their last change, each once.

Writing takes rows of doc_id and content to `folder/doc_id.suffix`. Every attempt
of a task writes aside; only on commit do the files of the attempts that counted
come to their places, so a failed or doubled task leaves nothing.

Paths are ones that all machines see, or URIs that Arrow's file systems open.
"""

from __future__ import annotations

import datetime
import fnmatch
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, modified timestamp, ord long, path string, size long, content binary, error string"
#: Bytes of entries that a partition reads, at most (a larger entry is one by itself).
PARTITION_BYTES = 64 << 20
_ASIDE = "_attempts"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Found:
    """A file that is read: its path, time of last change in nanoseconds, and size."""

    path: str
    changed: int
    size: int


def listed(path: str, glob: str) -> list[Found]:
    """Files under a path whose name fits, in order of their last change; those that are being written are left out."""
    store, base = _store(path)
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    files = [Found(x.path, x.mtime_ns or 0, x.size) for x in found if x.is_file and fnmatch.fnmatch(x.base_name, glob) and f"/{_ASIDE}/" not in x.path]
    return sorted(files, key=lambda x: (x.changed, x.path))


@dataclass
class Entries(InputPartition):
    """Entries of packages that one task reads: of each file its places in the directory, null for a file as a whole."""

    base: str
    files: list[tuple[Found, list[int] | None]]


def parted(base: str, files: list[Found], most: int) -> list[Entries]:
    """Partitions of at most `most` bytes of entries; a package's directory is read here, its contents are not."""
    store, _ = _store(base)
    parts, held, size = [], [], 0

    def close() -> None:
        nonlocal held, size
        if held:
            parts.append(Entries(base, held))
        held, size = [], 0

    for f in files:
        try:
            with store.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                sizes = [x.file_size for x in z.infolist()]
        except (zipfile.BadZipFile, OSError, ValueError):
            sizes = None
        if sizes is None:
            if size + f.size > most:
                close()
            held.append((f, None))
            size += f.size
            continue
        places: list[int] = []
        for i, n in enumerate(sizes):
            if size + n > most and (held or places):
                if places:
                    held.append((f, places))
                close()
                places = []
            places.append(i)
            size += n
        held.append((f, places))
    close()
    return parts


def _rows(part: Entries) -> Iterator[tuple]:
    store, _ = _store(part.base)
    for f, places in part.files:
        changed = datetime.datetime.fromtimestamp(f.changed / 1e9, datetime.UTC)
        try:
            if places is None:
                with store.open_input_file(f.path) as raw:
                    yield f.path, changed, 0, f.path.rpartition("/")[2], f.size, raw.read(), None
                continue
            with store.open_input_file(f.path) as raw, zipfile.ZipFile(raw) as z:
                found = z.infolist()
                for i in places:
                    if not found[i].is_dir():
                        yield f.path, changed, i, found[i].filename, found[i].file_size, z.read(found[i]), None
        except (zipfile.BadZipFile, OSError, ValueError, IndexError, NotImplementedError, RuntimeError) as e:
            yield f.path, changed, 0, None, None, None, str(e)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.glob, self.most = options["path"], options.get("glob", "*"), int(options.get("maxbytes", PARTITION_BYTES))

    def partitions(self) -> list[Entries]:
        return parted(self.path, listed(self.path, self.glob), self.most) or [Entries(self.path, [])]

    def read(self, partition: Entries) -> Iterator[tuple]:
        yield from _rows(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are the last change and path of the last file that was taken."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.glob, self.most = options["path"], options.get("glob", "*"), int(options.get("maxbytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path, self.glob)
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Entries]:
        low, high = (start["changed"], start["path"]), (end["changed"], end["path"])
        return parted(self.path, [f for f in listed(self.path, self.glob) if low < (f.changed, f.path) <= high], self.most)

    def read(self, partition: Entries) -> Iterator[tuple]:
        yield from _rows(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    """Files of a task's attempt, aside and where they belong."""

    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", "zip"), overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, base = _store(self.path)
        aside = f"{base}/{_ASIDE}/{self.run}/{uuid.uuid4().hex}"
        store.create_dir(aside)
        files = []
        for row in iterator:
            name = f"{row['doc_id']}.{self.suffix}"
            with store.open_output_stream(f"{aside}/{len(files)}") as f:
                f.write(row["content"])
            files.append((f"{aside}/{len(files)}", f"{base}/{name}"))
        return Written(files)

    def _cleared(self) -> None:
        store, base = _store(self.path)
        if store.get_file_info(f"{base}/{_ASIDE}/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{_ASIDE}/{self.run}")

    def commit(self, messages: list[Written | None]) -> None:
        """Files of the attempts that counted come to their places; what else the run wrote goes."""
        store, base = _store(self.path)
        if self.overwrite:
            for f in listed(self.path, f"*.{self.suffix}"):
                store.delete_file(f.path)
        for m in messages:
            for aside, at in m.files if m else []:
                store.move(aside, at)
        self._cleared()

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared()


class Packages(DataSource):
    """The format `packages`; options are path, glob, maxbytes (of a partition) and, for writing, suffix."""

    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(Packages)

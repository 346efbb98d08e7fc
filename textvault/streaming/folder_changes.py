"""A streaming source of folder changes: new files, files with new contents, and removals.

The file source of Spark reports a path once. Here an offset is the number of a listing, (path,
length, modification time) of every file below the folder, kept in a state folder; a batch is the
difference of two listings. The same two numbers always give the same rows, so a replayed batch is the same
batch; what changed meanwhile comes with a later one.

Listing and reading go through ``pyarrow.fs``, so folder and state may lie on any file system it knows
(local, HDFS, S3, GCS); both must be visible to driver and executors. Contents are read in the tasks, in
partitions of at most ``files`` files and about ``bytes`` bytes. The driver holds one listing.

A file that goes while a batch reads it comes with NULL content and kind ``removed``; a later listing confirms it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, kind string, length long, modified_ms long, content binary"
FILES, BYTES = 1000, 256 << 20


def _opened(folder: str):
    """(file system, path) of a folder with or without a scheme."""
    from pyarrow import fs
    if folder.startswith("file:"):
        folder = re.sub("^file:/+", "/", folder)
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def listing(folder: str) -> dict[str, list[int]]:
    """path -> [length, modification time in ms] of every file below the folder."""
    from pyarrow import fs
    system, path = _opened(folder)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    infos = system.get_file_info(fs.FileSelector(path, recursive=True))
    return {i.path: [i.size or 0, (i.mtime_ns or 0) // 1_000_000] for i in infos if i.is_file and not i.base_name.startswith((".", "_"))}


def changes(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[str, str, int, int]]:
    """(path, kind, length, modification time) by path; kind is new, changed or removed."""
    out = [(p, "changed" if p in old else "new", *x) for p, x in new.items() if old.get(p) != x]
    return sorted(out + [(p, "removed", *x) for p, x in old.items() if p not in new])


@dataclass
class Part(InputPartition):
    rows: list


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.state = options["path"], options["state"]
        self.files, self.bytes = int(options.get("files", FILES)), int(options.get("bytes", BYTES))

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def _name(self, n: int):
        system, path = _opened(self.state)
        return system, f"{path.rstrip('/')}/listing-{n:010d}.json"

    def _last(self) -> int:
        from pyarrow import fs
        system, path = _opened(self.state)
        system.create_dir(path, recursive=True)
        names = [re.fullmatch(r"listing-(\d+)\.json", i.base_name) for i in system.get_file_info(fs.FileSelector(path))]
        return max((int(m.group(1)) for m in names if m), default=0)

    def _listing(self, n: int) -> dict[str, list[int]]:
        if n == 0:
            return {}
        system, name = self._name(n)
        with system.open_input_stream(name) as fh:
            return json.loads(fh.read().decode("utf-8"))

    def latestOffset(self) -> dict:
        """The number of the last listing; a new one is written first if anything has changed."""
        last, now = self._last(), listing(self.folder)
        if now != self._listing(last):
            last += 1
            system, name = self._name(last)
            with system.open_output_stream(name + ".part") as fh:
                fh.write(json.dumps(now).encode("utf-8"))
            system.move(name + ".part", name)                 # a listing is there whole or not at all
        return {"listing": last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts, size = [Part([])], 0
        for row in changes(self._listing(start["listing"]), self._listing(end["listing"])):
            if parts[-1].rows and (len(parts[-1].rows) >= self.files or size + row[2] > self.bytes):
                parts.append(Part([]))
                size = 0
            parts[-1].rows.append(row)
            size += row[2] if row[1] != "removed" else 0
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        system, _ = _opened(self.folder)
        for path, kind, length, modified in partition.rows:
            content = None
            if kind != "removed":
                try:
                    with system.open_input_stream(path) as fh:
                        content = fh.read()
                except FileNotFoundError:
                    kind = "removed"
            yield path, kind, length, modified, content

    def commit(self, end: dict) -> None:
        """Listings before the last committed one are not needed any more, but the one before it, for a replay."""
        from pyarrow import fs
        system, path = _opened(self.state)
        for i in system.get_file_info(fs.FileSelector(path)):
            m = re.fullmatch(r"listing-(\d+)\.json", i.base_name)
            if m and int(m.group(1)) < end["listing"] - 1:
                system.delete_file(i.path)


class FolderChanges(DataSource):
    """``spark.readStream.format("folder_changes").option("state", ...).load(folder)``, once registered."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))

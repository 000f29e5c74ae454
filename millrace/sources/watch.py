"""A streaming data source of changed files (S20, ST09).

spark.dataSource.register(FileChanges); spark.readStream.format("millrace_changes").options(path=..., pattern="*.md", quiet_ms=1500).load()

Rows: file_path, event (added, changed or vanished), modified, size, text (null for what vanished). The offset is the listing of the folder, path
to (time, size); a batch holds what differs between two listings. A listing counts once the folder has been quiet for a while: each further
change starts that time again, so many edits in a row give one batch. It is meant for folders of notes, whose listing fits in an offset.
Paths may be of any file system that pyarrow knows.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Fixed value: how long a folder has to be quiet, in milliseconds.
QUIET_MS = 1500
SCHEMA = "file_path string, event string, modified timestamp, size long, text string"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listing(path: str, pattern: str) -> dict[str, list[int]]:
    """Files of a folder and those below it by path: time in nanoseconds, and size."""
    from pyarrow import fs

    store, top = _store(path)
    found = store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    return {f.path: [f.mtime_ns or 0, f.size] for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, pattern)}


def changes(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[str, str, int, int]]:
    """(path, event, time, size) by path."""
    out = [(p, "added" if p not in old else "changed", *new[p]) for p in new if old.get(p) != new[p]]
    return sorted(out + [(p, "vanished", *old[p]) for p in old if p not in new])


class _Changed(InputPartition):
    def __init__(self, path: str, event: str, at: int, size: int):
        self.path, self.event, self.at, self.size = path, event, at, size


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*.md")
        self.quiet = float(options.get("quiet_ms", QUIET_MS)) / 1000
        #: What exists at the start is reported as added, unless only later changes are asked for.
        self.from_now = str(options.get("from_now", "false")).lower() == "true"
        self.seen: dict | None = None
        self.since, self.given = 0.0, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": listing(self.path, self.pattern) if self.from_now else {}}

    def latestOffset(self) -> dict:  # noqa: N802
        now, clock = listing(self.path, self.pattern), time.monotonic()
        if now != self.seen:
            first = self.seen is None
            self.seen, self.since = now, clock
            if first and self.given is None:
                # Nothing was given out yet: what lies there has been quiet for as long as its files are old.
                newest = max((t for t, _ in now.values()), default=0) / 1e9
                self.since = clock - max(0.0, time.time() - newest)
        if clock - self.since >= self.quiet:
            self.given = {"files": now}
        return self.given if self.given is not None else {"files": {}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Changed(*c) for c in changes(start["files"], end["files"])]

    def read(self, partition: _Changed) -> Iterator[tuple]:
        text = None
        if partition.event != "vanished":
            store, _ = _store(self.path)
            try:
                with store.open_input_stream(partition.path) as f:
                    text = f.read().decode("utf-8", "replace")
            except FileNotFoundError:
                text = None  # it has gone since; the next listing says so
        yield partition.path, partition.event, dt.datetime.fromtimestamp(partition.at / 1e9, dt.timezone.utc), partition.size, text

    def commit(self, end: dict) -> None:
        self.given = end if self.given is None else self.given


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangesReader:  # noqa: N802
        return ChangesReader(self.options)

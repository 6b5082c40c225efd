"""A corpus's changes as a stream: a data source whose offsets are versions of its listing.

Each look at the folder that finds a difference is a new version. Its changes are written to a log before the stream hears
of them, so a batch can be read again after a restart, and what happened while nobody looked is the next version's.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from citeloom.functions.workers import with_python_path

FORMAT = "citeloom_changes"
SCHEMA = "event_id long, path string, op string, dest string, ts timestamp, is_dir boolean, size long"
EVENTS = 1_000_000  # changes of a version; their numbers are made with it


def listed(root: str, recursive: bool = True) -> dict[str, list[int]]:
    """{path: [size, time]} of the files under root; paths start below it."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=recursive))
    return {f.path.removeprefix(base).lstrip("/"): [f.size, f.mtime_ns] for f in found if f.type == fs.FileType.File}


def changes(before: dict[str, list[int]], after: dict[str, list[int]]) -> list[tuple[str, str, str | None, int | None]]:
    """(path, op, dest, size) in the order of paths. A file that goes while one of its size and time comes has moved there,
    if no other could be meant."""
    gone, come = before.keys() - after.keys(), after.keys() - before.keys()
    by_look: dict[tuple, tuple[list, list]] = {}
    for side, paths, of in ((0, gone, before), (1, come, after)):
        for p in paths:
            by_look.setdefault(tuple(of[p]), ([], []))[side].append(p)
    moved = {a[0]: b[0] for a, b in by_look.values() if len(a) == len(b) == 1}
    rows = [(p, "moved", moved[p], after[moved[p]][0]) for p in moved]
    rows += [(p, "deleted", None, None) for p in gone - moved.keys()]
    rows += [(p, "created", None, after[p][0]) for p in come - set(moved.values())]
    rows += [(p, "modified", None, after[p][0]) for p in before.keys() & after.keys() if before[p] != after[p]]
    return sorted(rows)


class Log:
    """The latest listing of a root and the changes of its versions, as files of a local folder."""

    def __init__(self, folder: str, root: str, recursive: bool = True):
        self.folder, self.root, self.recursive = Path(folder), root, recursive
        self.folder.mkdir(parents=True, exist_ok=True)

    def _put(self, name: str, value) -> None:
        new = self.folder / f"{name}.new"
        new.write_text(json.dumps(value))
        os.replace(new, self.folder / name)

    def latest(self) -> int:
        """The version of the latest listing; the first one is taken now."""
        if not (self.folder / "listing.json").exists():
            self._put("listing.json", {"version": 0, "files": listed(self.root, self.recursive)})
        return json.loads((self.folder / "listing.json").read_text())["version"]

    def look(self) -> int:
        """Looks at the folder; gives the version, a new one if something changed."""
        self.latest()
        known = json.loads((self.folder / "listing.json").read_text())
        now = listed(self.root, self.recursive)
        found = changes(known["files"], now)
        if not found:
            return known["version"]
        version = known["version"] + 1
        self._put(f"changes-{version:09}.json", [time.time(), found])
        self._put("listing.json", {"version": version, "files": now})
        return version

    def rows(self, start: int, end: int) -> Iterator[tuple]:
        """The changes of the versions after start up to end."""
        import datetime

        for version in range(start + 1, end + 1):
            at, found = json.loads((self.folder / f"changes-{version:09}.json").read_text())
            ts = datetime.datetime.fromtimestamp(at)
            for i, (path, op, dest, size) in enumerate(found):
                yield version * EVENTS + i, path, op, dest, ts, False, size

    def forget(self, end: int) -> None:
        """Removes the changes up to a version that has been taken."""
        for path in self.folder.glob("changes-*.json"):
            if int(path.stem.removeprefix("changes-")) <= end:
                path.unlink(missing_ok=True)


class ChangesReader(SimpleDataSourceStreamReader):
    def __init__(self, log: Log):
        self.log = log

    def initialOffset(self) -> dict:
        return {"version": self.log.latest()}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        version = self.log.look()
        return iter(list(self.log.rows(start["version"], version))), {"version": version}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(self.log.rows(start["version"], end["version"])))

    def commit(self, end: dict) -> None:
        self.log.forget(end["version"] - KEPT)


KEPT = 100  # versions whose changes stay, for a restart from the batch before the last


class Changes(DataSource):
    """Options: root, log (a folder of the driver's machine), recursive."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> ChangesReader:
        return ChangesReader(Log(self.options["log"], self.options["root"], self.options.get("recursive", "true").lower() == "true"))


def stream(spark: SparkSession, root: str, log: str, recursive: bool = True):
    """The stream of a folder's changes (SCHEMA)."""
    with_python_path(spark)
    spark.dataSource.register(Changes)
    return spark.readStream.format(FORMAT).option("root", root).option("log", log).option("recursive", str(recursive).lower()).load()

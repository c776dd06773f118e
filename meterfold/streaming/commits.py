"""A commit log over folders of Parquet files, so that several tables change as one.

A run is what a range of commits added: for each table some folders. A commit is a small file that names all runs; it is
written under another name and renamed, so that it is there as a whole or not at all. Readers take the newest one and read
the folders that it names, whatever is written meanwhile; folders that no commit names are leftovers. One writer at a time
may add commits.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Run:
    """Commits first to last; span: least and greatest time of their rows in microseconds, if they have any."""

    first: int
    last: int
    folders: dict[str, list[str]]
    span: tuple[int, int] | None = None

    @property
    def size(self) -> int:
        return self.last - self.first + 1


@dataclass(frozen=True)
class Commit:
    """version: number of the file. done: the last batch of each stream that is in it."""

    version: int = -1
    done: dict[str, int] = field(default_factory=dict)
    runs: tuple[Run, ...] = ()

    @property
    def next(self) -> int:
        return self.runs[-1].last + 1 if self.runs else 0


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> tuple[Any, Any]:
        """A path of Hadoop's below the root, and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        if not fs.exists(path):
            return []
        return [f.getPath().getName() for f in fs.listStatus(path)]

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("commits") if n.endswith(".json") and n[0] != ".")

    def load(self, version: int) -> Commit:
        path, fs = self._path(f"commits/{version:012d}.json")
        stream = fs.open(path)
        try:
            own = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Commit(version, own["done"], tuple(Run(r["first"], r["last"], r["folders"], r["span"] and tuple(r["span"])) for r in own["runs"]))

    def newest(self) -> Commit:
        versions = self.versions()
        return self.load(versions[-1]) if versions else Commit()

    def add(self, commit: Commit) -> Commit:
        """Write the commit after the one that it was made from; raises if another writer was there first."""
        own = replace(commit, version=commit.version + 1)
        path, fs = self._path(f"commits/{own.version:012d}.json")
        if fs.exists(path):
            raise RuntimeError(f"commit {own.version} of {self.root} is there already: the log has another writer")
        draft = self._path(f"commits/.{own.version:012d}-{uuid.uuid4().hex}")[0]
        stream = fs.create(draft)
        runs = [{"first": r.first, "last": r.last, "folders": r.folders, "span": r.span} for r in own.runs]
        stream.write(bytearray(json.dumps({"done": own.done, "runs": runs}).encode()))
        stream.close()
        if not fs.rename(draft, path):
            raise RuntimeError(f"commit {own.version} of {self.root} couldn't be put in place")
        return own

    def write(self, df: DataFrame, table: str, first: int, last: int, partition_by: list[str] = []) -> str:  # noqa: B006
        """Write rows to a new folder of a table, which no commit names yet, and return its name."""
        name = f"{table}/run={first}-{last}-{uuid.uuid4().hex[:12]}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{name}")
        return name

    def drop(self, folder: str) -> None:
        """Delete a folder that no commit names."""
        path, fs = self._path(folder)
        fs.delete(path, True)

    def read(self, table: str, schema: T.StructType, runs: tuple[Run, ...] | list[Run]) -> DataFrame:
        """A table's rows in some runs; none is an empty table."""
        paths = [f"{self.root}/{f}" for r in runs for f in r.folders.get(table, [])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*schema.fieldNames())

    def parts(self, folder: str) -> list[str]:
        """A written folder as its partitions' folders; as itself if it has none."""
        return [f"{folder}/{n}" for n in self._names(folder) if "=" in n and n[0] not in "._"] or [folder]

    def replace_parts(self, commit: Commit, column: str, values: list[str], new: dict[str, DataFrame]) -> Commit:
        """The commit after some partitions of tables have new rows, as one; other partitions keep their files.

        new: for each table all rows that its partitions of those values have from now on, with the partition column.
        """
        at, gone = commit.next, {f"{column}={v}" for v in values}
        written = {table: self.write(df, table, at, at, [column]) for table, df in new.items()}
        runs = []
        for r in commit.runs:
            folders = {t: [p for f in own for p in (self.parts(f) if f.count("/") == 1 else [f]) if p.rpartition("/")[2] not in gone] if t in new else own for t, own in r.folders.items()}
            runs.append(replace(r, folders=folders))
        own = {t: [p for p in self.parts(f) if p != f] for t, f in written.items()}
        return self.add(replace(commit, runs=(*runs, Run(at, at, own))))

    def in_parts(self, runs: tuple[Run, ...], table: str, column: str, values: list[str]) -> list[Run]:
        """The runs with only those folders of a table that may have rows of some partitions."""
        named = {f"{column}={v}" for v in values}
        keep = lambda f: f.count("/") == 1 or f.rpartition("/")[2] in named
        return [replace(r, folders={table: [f for f in r.folders.get(table, []) if keep(f)]}) for r in runs]

    def vacuum(self, keep: int = 200) -> None:
        """Delete all but the newest commits, and the folders that none of those names; a reader of an older one would miss them."""
        versions = self.versions()
        stay = [self.load(v) for v in versions[-keep:]]
        named = {f for c in stay for r in c.runs for own in r.folders.values() for f in own}
        for v in versions[:-keep]:
            path, fs = self._path(f"commits/{v:012d}.json")
            fs.delete(path, False)
        for draft in (n for n in self._names("commits") if n[0] == "."):
            path, fs = self._path(f"commits/{draft}")
            fs.delete(path, False)
        for table in (n for n in self._names("") if n != "commits" and n[0] not in "._"):
            for name in self._names(table):
                whole = f"{table}/{name}"
                if whole in named:
                    continue
                parts = self.parts(whole)
                # of a folder some of whose partitions are named only the others go
                for folder in [p for p in parts if p not in named] if named & {*parts} else [whole]:
                    path, fs = self._path(folder)
                    fs.delete(path, True)


def to_merge(runs: tuple[Run, ...], fanout: int) -> int:
    """How many of the last runs to put together: fanout of one size, if there are so many, so that runs stay few."""
    if len(runs) < fanout:
        return 0
    level = lambda size: 0 if size < fanout else 1 + level(size // fanout)
    return fanout if len({level(r.size) for r in runs[-fanout:]}) == 1 else 0


def merged(log: CommitLog, commit: Commit, fanout: int, rewrite: dict[str, Callable[[list[Run], int, int], str | None]]) -> Commit:
    """The commit after due merges, each a commit of its own. rewrite: what writes a table's rows in some runs to one new folder, or None to leave their folders."""
    while n := to_merge(commit.runs, fanout):
        old = list(commit.runs[-n:])
        first, last = old[0].first, old[-1].last
        folders = {}
        for table, one in rewrite.items():
            new = one(old, first, last)
            folders[table] = [f for r in old for f in r.folders.get(table, [])] if new is None else [new]
        spans = [r.span for r in old if r.span]
        span = (min(s[0] for s in spans), max(s[1] for s in spans)) if spans else None
        commit = log.add(replace(commit, runs=(*commit.runs[:-n], Run(first, last, folders, span))))
    return commit

"""A log of committed table parts: appends that happen once, whoever retries and however many write.

An append writes its rows into folders of its own and then commits: it creates the file of the next version, which only one
writer can do. The others start anew from the version that won. A version names all live folders, so readers see whole
appends and never list data. Each append carries the name of its batch; a batch that was committed before is not written again.

Folders are merged like a log-structured tree: as soon as ``fan`` folders of one generation are live, a commit replaces them by one
folder of the next generation, made by the part's merge. At most ``fan - 1`` folders for each generation are live, and their
generations are as many as the logarithm of the appends. Folders that no version names any more may still be read by lazy frames; expire
them by age.

The log's folder needs a file system whose rename (on local paths: link) refuses an existing target, as HDFS does.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Live folders of one generation that are merged into the next.
FAN = 8

Merge = Callable[[DataFrame], DataFrame]


class Folder(NamedTuple):
    generation: int
    path: str


class Version(NamedTuple):
    number: int
    batch: str | None
    parts: dict[str, list[Folder]]
    schemas: dict[str, str]


class _Files:
    """The few file operations the log needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getScheme() == "file"

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Make the file with its whole content, unless it is there already."""
        draft = f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}"
        self.write(draft, text)
        try:
            if self._local:
                os.link(self._place(draft), self._place(path))
                return True
            return self._fs.rename(self._path(draft), self._path(path))
        except FileExistsError:
            return False
        except Py4JJavaError as refused:
            if "FileAlreadyExists" in str(refused.java_exception):
                return False
            raise
        finally:
            self._fs.delete(self._path(draft), False)

    def _place(self, path: str) -> str:
        return self._path(path).toUri().getPath()


class CommitLog:
    """Named parts under ``root``, each with a merge that turns the rows of several folders into fewer or the same rows."""

    def __init__(self, spark: SparkSession, root: str, merges: dict[str, Merge], fan: int = FAN) -> None:
        self._spark, self.root, self._merges, self._fan = spark, root.rstrip("/"), merges, fan
        self._files = _Files(spark, self.root)

    def head(self) -> Version:
        """The newest version; version 0 of a log that was never written to."""
        hint = f"{self.root}/_log/_last"
        known = 0
        if self._files.exists(hint):
            known = int(self._files.read(hint) or 0)
        elif found := [n for n in self._files.names(f"{self.root}/_log") if n.endswith(".json")]:
            known = int(max(found).removesuffix(".json"))
        while self._files.exists(self._version(known + 1)):
            known += 1
        if not known:
            return Version(0, None, {}, {})
        held = json.loads(self._files.read(self._version(known)))
        parts = {name: [Folder(*f) for f in folders] for name, folders in held["parts"].items()}
        return Version(known, held["batch"], parts, held["schemas"])

    def read(self, name: str, schema: str | T.StructType, head: Version | None = None) -> DataFrame:
        """All rows of a part; of a log without it, no rows of ``schema``."""
        head = head or self.head()
        folders = head.parts.get(name, [])
        if not folders:
            return self._spark.createDataFrame([], schema)
        return self._read(folders, head.schemas[name])

    def append(self, batch: str, make: Callable[[Version], dict[str, DataFrame]]) -> int:
        """Commit what ``make`` gives for the newest version, once per batch; returns the version that holds it."""
        while True:
            head = self.head()
            if head.batch is not None:
                self._remember(head.batch, head.number)  # its writer may have ended between commit and note
            if self._files.exists(self._note(batch)):
                return int(self._files.read(self._note(batch)))
            parts = defaultdict(list, {n: list(f) for n, f in head.parts.items()})
            schemas = dict(head.schemas)
            for name, rows in make(head).items():
                schemas[name] = rows.schema.json()
                parts[name].append(Folder(0, self._store(name, rows)))
                self._merge(name, parts[name], schemas[name])
            content = json.dumps({"batch": batch, "parts": parts, "schemas": schemas})
            if self._files.create(self._version(head.number + 1), content):
                self._files.write(f"{self.root}/_log/_last", str(head.number + 1))
                self._remember(batch, head.number + 1)
                return head.number + 1

    def _merge(self, name: str, folders: list[Folder], schema: str) -> None:
        generation = 0
        while sum(f.generation == generation for f in folders) >= self._fan:
            old = [f for f in folders if f.generation == generation]
            merged = self._merges[name](self._read(old, schema))
            folders[:] = [f for f in folders if f.generation != generation]
            generation += 1
            folders.append(Folder(generation, self._store(name, merged)))

    def _read(self, folders: list[Folder], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        return self._spark.read.schema(kind).parquet(*[f"{self.root}/{f.path}" for f in folders])

    def _store(self, name: str, rows: DataFrame) -> str:
        path = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{path}")
        return path

    def _version(self, number: int) -> str:
        return f"{self.root}/_log/{number:020d}.json"

    def _note(self, batch: str) -> str:
        return f"{self.root}/_batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def _remember(self, batch: str, number: int) -> None:
        if not self._files.exists(self._note(batch)):
            self._files.create(self._note(batch), str(number))

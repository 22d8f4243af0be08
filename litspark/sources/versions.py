"""Tables whose every version is named by one atomically published list.

    <table>/data/commit=<id>/<partition>=<value>/part-*.parquet     written once, never changed
    <table>/_versions/00000000000000000007.json                     the list of version 7

A writer first writes a folder of its own, which no list names yet, and then publishes the list of the next version: the
parts that stay, the new ones, and whatever else belongs to the same commit. Publishing is a rename that fails where the name
is taken, so readers see a version whole or not at all, a stopped writer leaves nothing but a folder for
``vacuum``, and of two writers one is told to start again. The file system must rename atomically, as HDFS does.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTS, DATA, COMMIT = "_versions", "data", "commit"


class ConcurrentCommit(RuntimeError):
    """Another writer has published this version; read the table again and repeat the work."""


class Folder:
    """The few file operations that commits need, in any file system Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def list(self, name: str = "") -> list[tuple[str, int, float]]:
        """(name, bytes, time of change in seconds) of what a folder holds; none where there is no folder."""
        if not self.exists(name):
            return []
        return [(s.getPath().getName(), s.getLen(), s.getModificationTime() / 1000) for s in self.fs.listStatus(self._path(name))]

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str, replace: bool = False) -> None:
        """Make a file appear with its whole content; FileExistsError where the name is taken, unless replaced."""
        beside = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self.move(beside.getName() if "/" not in name else f"{name.rpartition('/')[0]}/{beside.getName()}", name, replace)
        except Exception:
            self.fs.delete(beside, False)
            raise

    def move(self, name: str, to: str, replace: bool = False) -> None:
        """Rename a file or folder at once; FileExistsError where the new name is taken, unless replaced."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, int(replace))
        if replace:
            how[0] = kind.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self._path(name)), self.fs.makeQualified(self._path(to)), how)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise FileExistsError(to) from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass
class Part:
    """One partition of one commit: its folder, files, bytes and rows."""

    commit: str
    partition: str
    files: int
    bytes: int
    rows: int


@dataclass
class Version:
    """What a list says: the parts, the schema of the rows, and the commit's own data (``extra``)."""

    number: int
    created: str
    operation: str
    schema: str
    parts: list[Part]
    extra: dict = field(default_factory=dict)


class VersionedTable:
    """Rows partitioned by one column of texts, in versions."""

    def __init__(self, spark: SparkSession, path: str, partition: str):
        self.spark, self.path, self.partition, self.folder = spark, path.rstrip("/"), partition, Folder(spark, path)

    def numbers(self) -> list[int]:
        return sorted(int(name[:-5]) for name, _, _ in self.folder.list(LISTS) if name.endswith(".json"))

    def version(self, number: int | None = None) -> Version | None:
        """A version, the last one if none is named; None where nothing has been published."""
        numbers = self.numbers()
        if number is None and not numbers:
            return None
        if number is not None and number not in numbers:
            raise ValueError(f"{self.path} has no version {number}, but {numbers}")
        said = json.loads(self.folder.read(f"{LISTS}/{numbers[-1] if number is None else number:020d}.json"))
        return Version(**said | {"parts": [Part(**p) for p in said["parts"]]})

    def read(self, version: Version, parts: Iterable[Part] | None = None) -> DataFrame:
        """The rows of a version, or of some parts, with the column ``commit`` that their folders name."""
        schema = T.StructType.fromJson(json.loads(version.schema)).add(COMMIT, T.StringType())
        chosen = version.parts if parts is None else list(parts)
        if not chosen:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/{DATA}/{COMMIT}={p.commit}/{self.partition}={p.partition}" for p in chosen]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{DATA}").parquet(*folders)

    def write(self, rows: DataFrame) -> list[Part]:
        """Write rows to a folder of their own; nobody sees them before a list names the parts."""
        commit = uuid.uuid4().hex
        folder = f"{DATA}/{COMMIT}={commit}"
        rows.write.partitionBy(self.partition).parquet(f"{self.path}/{folder}")
        found = []
        for name, _, _ in self.folder.list(folder):
            if name.startswith(f"{self.partition}="):
                files = [(f, size) for f, size, _ in self.folder.list(f"{folder}/{name}") if f.endswith(".parquet")]
                found.append(Part(commit, name.partition("=")[2], len(files), sum(size for _, size in files), 0))
        if found:
            draft = Version(0, "", "", rows.schema.json(), found)
            counts = {r[0]: r[1] for r in self.read(draft).groupBy(self.partition).count().collect()}  # a row per partition
            for p in found:
                p.rows = counts.get(p.partition, 0)
        return found

    def publish(self, after: Version | None, parts: list[Part], schema: T.StructType, operation: str, extra: dict, created: str = "") -> Version:
        """Make these parts the version that follows ``after``."""
        number = after.number + 1 if after else 0
        made = Version(number, created or now(), operation, schema.json(), parts, extra)
        try:
            self.folder.publish(f"{LISTS}/{number:020d}.json", json.dumps(asdict(made)))
        except FileExistsError as e:
            raise ConcurrentCommit(f"{self.path}: version {number} is there already") from e
        return made

    def lost(self, version: Version) -> list[Part]:
        """The parts whose folders do not hold what the list says."""
        wrong = []
        for p in version.parts:
            files = self.folder.list(f"{DATA}/{COMMIT}={p.commit}/{self.partition}={p.partition}")
            sizes = [size for name, size, _ in files if name.endswith(".parquet")]
            if (len(sizes), sum(sizes)) != (p.files, p.bytes):
                wrong.append(p)
        return wrong

    def history(self) -> DataFrame:
        """(version, created, operation, parts, files, bytes, rows), a row per version."""
        rows = []
        for n in self.numbers():
            v = self.version(n)
            sums = [sum(getattr(p, what) for p in v.parts) for what in ("files", "bytes", "rows")]
            rows.append((n, v.created, v.operation, len(v.parts), *sums))
        return self.spark.createDataFrame(rows, "version int, created string, operation string, parts int, files long, bytes long, rows long")

    def vacuum(self, keep: int = 2, min_age: float = 86400.0) -> list[str]:
        """Delete all but the last ``keep`` lists, and the folders that no kept list names; returns the folders.

        Folders younger than ``min_age`` seconds stay: their writer may not have published yet.
        """
        if keep < 1:
            raise ValueError("the last version must stay")
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self.folder.delete(f"{LISTS}/{n:020d}.json")
        named = {(p.commit, p.partition) for n in numbers[-keep:] for p in self.version(n).parts}
        commits, gone = {c for c, _ in named}, []
        for name, _, changed in self.folder.list(DATA):
            commit = name.partition("=")[2]
            if time.time() - changed < min_age:
                continue
            if commit not in commits:
                gone.append(f"{DATA}/{name}")
                continue
            for part, _, _ in self.folder.list(f"{DATA}/{name}"):
                if part.startswith(f"{self.partition}=") and (commit, part.partition("=")[2]) not in named:
                    gone.append(f"{DATA}/{name}/{part}")
        for name in gone:
            self.folder.delete(name)
        return gone


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")


def timestamp(text: str):
    """A literal of a time as ``now`` writes it."""
    return F.to_timestamp(F.lit(text))

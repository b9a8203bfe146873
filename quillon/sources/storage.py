"""Versioned tables: immutable Parquet parts, and a catalog that points at them.

A table's version is a list of part directories. A mutation writes new parts and swaps the
pointer; nothing is changed in place, so a rollback is the old catalog, a savepoint a copy of it,
and a reader keeps what it began with. The catalog of a persistent engine is a JSON manifest that
is replaced by one rename. Only the catalog is held by the driver, never rows.
"""

from __future__ import annotations

import copy
import json
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..errors import QuillonError, TransactionError
from ..plans.types import Type

ROWID = "rowid"
#: Seconds that a writer waits for the lock, and after which a lock's owner is taken for dead; it is held for one rename.
LOCK_WAIT, LOCK_SECONDS = 10.0, 60.0


@dataclass
class ColumnMeta:
    name: str
    type: Type
    nullable: bool = True
    auto: bool = False
    default: str | None = None


@dataclass
class ForeignKey:
    name: str
    columns: list[str]
    table: str
    target: list[str]
    on_delete: str = "RESTRICT"
    on_update: str = "RESTRICT"


@dataclass
class Table:
    name: str
    columns: list[ColumnMeta]
    primary: list[str]
    unique: dict[str, list[str]] = field(default_factory=dict)
    indexes: dict[str, list[str]] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    foreign: list[ForeignKey] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    next_rowid: int = 1

    def column(self, name: str) -> ColumnMeta | None:
        return next((c for c in self.columns if c.name == name), None)

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def schema(self) -> str:
        return ", ".join([f"`{c.name}` {c.type.spark()}" for c in self.columns] + [f"`{ROWID}` bigint"])


@dataclass
class Trigger:
    name: str
    event: str
    table: str
    body: str


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)
    version: int = 0

    def copy(self) -> Catalog:
        return copy.deepcopy(self)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Catalog:
        raw = json.loads(text)
        out = Catalog(views=raw["views"], triggers={k: Trigger(**v) for k, v in raw["triggers"].items()}, version=raw.get("version", 0))
        for name, table in raw["tables"].items():
            columns = [ColumnMeta(**{**c, "type": Type(**{**c["type"], "values": tuple(c["type"]["values"])})}) for c in table.pop("columns")]
            foreign = [ForeignKey(**f) for f in table.pop("foreign")]
            out.tables[name] = Table(columns=columns, foreign=foreign, **table)
        return out


class Storage:
    """Parts and manifest below one directory of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.persistent = spark, path is not None
        if path is None:
            shared = spark.conf.get("spark.checkpoint.dir", None)
            if not shared and not spark.sparkContext.master.startswith("local"):
                raise QuillonError("on a cluster, an engine without a path needs spark.checkpoint.dir: executors share no local folder")
            path = f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="quillon-tables-")
        self.path = path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def load(self) -> Catalog:
        at = self._path("manifest.json")
        if not self.persistent or not self._fs.exists(at):
            return Catalog()
        stream = self._fs.open(at)
        try:
            return Catalog.from_json(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def publish(self, catalog: Catalog) -> None:
        """Replaces the manifest by one rename, under the writers' lock, if it is still the version that this engine read."""
        if not self.persistent:
            return
        with self._locked():
            there = self.load().version
            if there != catalog.version:
                raise TransactionError(f"another engine has published version {there} since version {catalog.version} was read; open the path anew")
            catalog.version += 1
            try:
                self._replace(catalog)
            except BaseException:
                catalog.version -= 1
                raise

    @contextmanager
    def _locked(self) -> Iterator[None]:
        """The writers' lock: a file that only one can create. A lock of LOCK_SECONDS is taken for one whose owner is gone."""
        at, began = self._path("writer.lock"), time.monotonic()
        while True:
            try:
                self._fs.create(at, False).close()
                break
            except Py4JJavaError as error:
                if not self._fs.exists(self._path("")) or "exist" not in str(error.java_exception).lower():
                    raise
                status = self._fs.listStatus(at) if self._fs.exists(at) else []
                if len(status) and time.time() - status[0].getModificationTime() / 1000 > LOCK_SECONDS:
                    self._fs.delete(at, False)
                elif time.monotonic() - began > LOCK_WAIT:
                    raise TransactionError(f"{self.path} is locked by another writer") from None
                else:
                    time.sleep(0.05)
        try:
            yield
        finally:
            self._fs.delete(at, False)

    def _replace(self, catalog: Catalog) -> None:
        fresh = self._path(f"manifest-{uuid.uuid4().hex}.json")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(catalog.to_json().encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, self._path("manifest.json"), overwrite)

    def read(self, table: Table) -> DataFrame:
        if not table.parts:
            return self.spark.createDataFrame([], table.schema())
        return self.spark.read.schema(table.schema()).parquet(*[f"{self.path}/{p}" for p in table.parts])

    def write(self, table: str, rows: DataFrame) -> str:
        """A new part, named relative to the directory."""
        safe = re.sub(r"\W", "_", table)
        part = f"{safe}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}")
        return part

    def faults(self, table: Table) -> list[str]:
        """Parts that are not there, or whose files have other columns than the table."""
        found = []
        want = {(c.name, kind.lower()) for c, kind in [*((c, c.type.spark()) for c in table.columns), (ColumnMeta(ROWID, Type("int64")), "bigint")]}
        for part in table.parts:
            if not self._fs.exists(self._path(part)):
                found.append(f"{table.name}: part {part} is missing")
            elif {(n, k) for n, k in self.spark.read.parquet(f"{self.path}/{part}").dtypes} != want:
                found.append(f"{table.name}: part {part} has other columns")
        return found

    def vacuum(self, catalogs: list[Catalog]) -> int:
        """Deletes the parts that none of the catalogs points at; how many."""
        used = {p for c in catalogs for table in c.tables.values() for p in table.parts}
        gone = 0
        if not self._fs.exists(self._path("")):
            return 0
        for folder in self._fs.listStatus(self._path("")):
            if folder.isDirectory():
                for part in self._fs.listStatus(folder.getPath()):
                    name = f"{folder.getPath().getName()}/{part.getPath().getName()}"
                    if name not in used:
                        self._fs.delete(part.getPath(), True)
                        gone += 1
        return gone

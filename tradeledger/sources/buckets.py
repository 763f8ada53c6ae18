"""Tables that change in place: files by bucket of the key, and a manifest of the files that count.

A store holds several tables.  Each lies in files by a hash of its key.  A change
reads the buckets that its keys fall in, writes them anew beside the old files,
and publishes a manifest in which they take the old ones' place; all other buckets
keep their files.  All tables of a store change together.

A manifest counts once a pointer of its version exists.  The pointer is put there
by a rename that fails where one is, so of two writers that began at one version
only one publishes; the other raises ``Conflict`` and can begin again.  A writer
that dies before has changed nothing.  Readers keep the version they opened.

A manifest has one row per bucket, and a read one path per bucket, so choose
buckets of some hundred megabytes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
_MANIFEST = "name string, keys array<string>, of int, shape string, bucket int, folder string"


class Conflict(RuntimeError):
    """Somebody else published in between."""


@dataclass(frozen=True)
class Part:
    """What a manifest says about a table: its key, number of buckets, columns, and the folder of each bucket that has rows."""

    keys: tuple[str, ...]
    of: int
    shape: StructType
    folders: dict[int, str]


def bucket(keys: Iterable[str], of: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(of)).cast("int")


class Store:
    """Bucketed tables below ``base``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._read: dict[int, dict[str, Part]] = {}      # a published version never changes

    # ---- files -----------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        files, path = self._files(), self._path(name)
        return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

    # ---- versions ----------------------------------------------------------

    def version(self) -> int:
        """The newest published version, 0 before the first."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=0)

    def parts(self, version: int | None = None) -> dict[str, Part]:
        version = self.version() if version is None else version
        if not version:
            return {}
        if version in self._read:
            return self._read[version]
        pointed = self.spark.read.text(f"{self.base}/versions/{version}").first()[0]
        found: dict[str, Part] = {}
        for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.base}/manifests/{pointed}").collect():
            part = found.setdefault(r.name, Part(tuple(r["keys"]), r.of, StructType.fromJson(json.loads(r.shape)), {}))
            if r.folder is not None:
                part.folders[r.bucket] = r.folder
        self._read[version] = found
        return found

    def read(self, name: str, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """A table, or only some of its buckets, as of a version."""
        part = self.parts(version)[name]
        chosen = set(part.folders if buckets is None else buckets)
        paths = [f for b, f in sorted(part.folders.items()) if b in chosen]
        return self.spark.read.schema(part.shape).parquet(*paths) if paths else self.spark.createDataFrame([], part.shape)

    # ---- changes -----------------------------------------------------------

    def write(self, rows: DataFrame, keys: Iterable[str], of: int, buckets: Iterable[int] | None = None, before: Part | None = None) -> Part:
        """Files of ``rows``, which are all that the ``buckets`` (all, if none are given) hold from now on; not published yet."""
        folder = f"{self.base}/data/{uuid.uuid4().hex}"
        keys = tuple(keys)
        placed = rows.withColumn(BUCKET, bucket(keys, of))
        # Adaptive execution writes a large bucket with several tasks.
        placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder)
        there = {int(n.split("=")[1]): f"{folder}/{n}" for n in self._names(folder.removeprefix(f"{self.base}/")) if n.startswith(f"{BUCKET}=")}
        kept = {} if buckets is None or before is None else {b: f for b, f in before.folders.items() if b not in set(buckets)}
        return Part(keys, of, rows.schema, kept | there)

    def publish(self, parts: dict[str, Part], since: int) -> int:
        """Make ``parts`` the version after ``since``; tables left out stay as they are in ``since``."""
        whole = self.parts(since) | parts
        rows = [(n, list(p.keys), p.of, json.dumps(p.shape.jsonValue()), b, f) for n, p in whole.items() for b, f in [*p.folders.items(), (-1, None)]]
        named = uuid.uuid4().hex
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{self.base}/manifests/{named}")
        draft, files = self._path(f"drafts/{named}"), self._files()
        out = files.create(draft)
        out.write(bytearray(named, "ascii"))
        out.close()
        files.mkdirs(self._path("versions"))
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        from py4j.protocol import Py4JJavaError

        try:
            context.rename(draft, self._path(f"versions/{since + 1}"), no_overwrite)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            raise Conflict(f"version {since + 1} of {self.base} has been published by another writer") from e
        return since + 1


def touched(changes: DataFrame, keys: Iterable[str], of: int) -> list[int]:
    """The buckets of the keys that change, ``of`` at most."""
    return [r[0] for r in changes.select(bucket(keys, of)).distinct().collect()]


def create(store: Store, tables: dict[str, tuple[DataFrame, list[str], int]]) -> int:
    """Store whole tables, each with its key and number of buckets."""
    since = store.version()
    return store.publish({n: store.write(df, keys, of) for n, (df, keys, of) in tables.items()}, since)


def merge(store: Store, changes: dict[str, DataFrame], since: int | None = None) -> int:
    """Apply change sets ``old, new`` (rows or null, as ``cascade`` emits them) to the tables named, together.

    Rows before and after are told by the table's key, which may itself change.
    ``since`` is the version that the change sets were made from.
    """
    since = store.version() if since is None else since
    parts, new = store.parts(since), {}
    for name, change in changes.items():
        part = parts[name]
        columns = part.shape.names
        gone = change.where("old IS NOT NULL").select("old.*").select(*part.keys)
        come = change.where("new IS NOT NULL").select("new.*").select(*columns)
        hit = touched(gone.union(come.select(*part.keys)), part.keys, part.of)
        rows = store.read(name, hit, since).join(gone, list(part.keys), "left_anti").select(*columns).union(come)
        typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in part.shape])
        new[name] = store.write(typed, part.keys, part.of, hit, part)
    return store.publish(new, since)

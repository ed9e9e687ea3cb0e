"""Sharding by size-tiered compaction with a versioned manifest, native.

Arrivals are appended as small immutable shards.  Runs of similar size are
merged, a tier at a time, into files near ``target_bytes``; every change is one
new manifest version.  A manifest is written whole under a name of its own and
then given its version's name by a rename that refuses to replace (on a local file
system, by a hard link), so it is there whole or not at all, a writer that dies
leaves garbage only, and two writers never commit the same version; the loser
takes the newer manifest and puts its own change on top, or gives up a merge whose
shards are gone.  A reader sees the shards of one version, never a mixture, and
never waits for a commit under way.  A manifest that cannot be read, as another
program may leave one, is passed over by readers, and its number by writers.
Data move only through DataFrame reads and writes; the driver handles file
names, row counts and sizes.

Edge cases: an empty arrival commits a version without new shards; a store
without shards reads as no rows; null ids and texts are stored as they are;
repeated rows stay repeated, ties of the sorting column lie in any order; a
column that an arrival adds is null in the rows before it, and one of another
type is refused; any column names are accepted.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 128 << 20
FANOUT = 4
SMALL_BYTES = 4 << 20
#: Versions that stay readable, and the age in seconds from which a file that none of them names is garbage.
KEEP_VERSIONS = 8
GARBAGE_AGE = 24 * 3600


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    born: int  # manifest version that added it


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: T.StructType | None
    shards: tuple[Shard, ...]
    #: The highest number taken when this version was read; the next commit takes the one after it.
    taken: int = 0


class Conflict(RuntimeError):
    """Another writer committed first."""


class ShardStore:
    """A folder of immutable Parquet shards and the manifests that name them."""

    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, small_bytes: int = SMALL_BYTES):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.target_bytes, self.fanout, self.small_bytes = target_bytes, fanout, small_bytes
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    # -- manifests -------------------------------------------------------

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _parsed(self, version: int) -> Manifest | None:
        """A version's manifest; ``None`` if it is not whole."""
        row = self.spark.read.text(f"{self.folder}/manifests/v{version:08d}.json", wholetext=True).first()
        try:
            m = json.loads(row[0])
            return Manifest(version, T.StructType.fromJson(m["schema"]) if m["schema"] else None, tuple(Shard(**s) for s in m["shards"]), version)
        except (TypeError, ValueError, KeyError):
            return None

    def manifest(self, version: int | None = None) -> Manifest:
        """One version, by default the newest whole one; version 0 is the empty store."""
        if version is not None:
            found = self._parsed(version) if version else Manifest(0, None, ())
            if found is None:
                raise ValueError(f"version {version} has no whole manifest")
            return found
        versions = self.versions()
        for v in reversed(versions):
            if found := self._parsed(v):
                return replace(found, taken=versions[-1])
        return Manifest(0, None, (), versions[-1] if versions else 0)

    def _commit(self, base: Manifest, shards: list[Shard], schema: T.StructType | None) -> int:
        """Put a whole manifest in the place of the version after the last one taken."""
        version = base.taken + 1
        body = json.dumps({"version": version, "schema": schema.jsonValue() if schema else None, "shards": [asdict(s) for s in shards]})
        self._fs.mkdirs(self._path("manifests"))
        draft, target = self._path(f"manifests/draft-{uuid.uuid4().hex}"), self._path(f"manifests/v{version:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        try:
            self._publish(draft, target)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} was committed by another writer") from e
            raise
        finally:
            self._fs.delete(draft, False)
        return version

    def _publish(self, draft, target) -> None:
        """Give ``draft`` its final name, unless that exists."""
        jvm = self._jvm
        if self._fs.getUri().getScheme() == "file":
            paths = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)]
            jvm.java.nio.file.Files.createLink(*paths)
            return
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, none)

    def _retried(self, change, tries: int = 20) -> int | None:
        """Commit what ``change`` makes of the newest manifest; on a conflict, of the one that won."""
        for attempt in range(tries):
            try:
                base = self.manifest()
                made = change(base)
                return None if made is None else self._commit(base, *made)
            except Conflict:
                time.sleep(0.05 * attempt)
        raise Conflict("other writers kept committing first")

    def _written(self, rows: DataFrame, kind: str) -> list[Shard]:
        """Write rows to a new folder; the shards it got, without files that hold no row."""
        name = f"data/{kind}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        counts = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}").groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
        rows_of, found = {r["f"]: r["count"] for r in counts}, []
        for s in self._fs.listStatus(self._path(name)):
            file = s.getPath().getName()
            if file in rows_of:
                found.append(Shard(f"{name}/{file}", s.getLen(), rows_of[file], 0))
        return sorted(found, key=lambda s: s.path)

    # -- writing ---------------------------------------------------------

    def append(self, arrivals: DataFrame) -> int:
        """Append rows as they come: every input partition becomes one small shard, no shuffle."""
        new = self._written(arrivals, "a")

        def change(base: Manifest):
            return [*base.shards, *_born(new, base)], _merged(base.schema, arrivals.schema)

        return self._retried(change)

    def _tier(self, size: int) -> int:
        return 0 if size <= self.small_bytes else 1 + int(math.log(size / self.small_bytes, self.fanout))

    def plan(self, shards) -> list[list[Shard]]:
        """Runs to merge: shards of one tier, when there are at least ``fanout`` of them below half the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: (s.bytes, s.path)):
            if s.bytes < self.target_bytes // 2:
                tiers.setdefault(self._tier(s.bytes), []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= self.fanout]

    def compact(self, sort_by: str) -> int | None:
        """Merge the lowest run that :meth:`plan` names and commit; ``None`` if there is none, or if
        the merge would leave as many files.

        Rows are ranged by ``sort_by`` and then by a hash of the whole row, so
        equal keys spread over several files, into as many files as the run's
        bytes fill.
        """
        base = self.manifest()
        runs = self.plan(base.shards)
        if not runs:
            return None
        old = runs[0]
        gone = {s.path for s in old}
        rows = self._read(old, base.schema)
        spread = F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t])
        n = max(1, math.ceil(sum(s.bytes for s in old) / self.target_bytes))
        new = self._written(rows.repartitionByRange(n, F.col(sort_by), spread).sortWithinPartitions(sort_by), "c")
        if len(new) >= len(old):  # no fewer files than before: nothing is won
            self._fs.delete(self._path(new[0].path).getParent(), True)
            return None

        def change(latest: Manifest):
            if not gone <= {s.path for s in latest.shards}:
                return None  # another compaction took them; what was written is garbage
            return [*(s for s in latest.shards if s.path not in gone), *_born(new, latest)], latest.schema

        return self._retried(change)

    def settle(self, sort_by: str, rounds: int = 64) -> int:
        """Compact until no tier has enough runs."""
        for _ in range(rounds):
            if self.compact(sort_by) is None:
                break
        return self.manifest().version

    def vacuum(self, keep: int = KEEP_VERSIONS, age: float = GARBAGE_AGE) -> int:
        """Delete manifests before the last ``keep`` and old data files that no kept one names; returns how many files.

        Files younger than ``age`` seconds may belong to writers that have not
        committed yet and stay.
        """
        whole = {v: m for v in self.versions() if (m := self._parsed(v))}
        kept = sorted(whole)[-max(1, keep) :]
        live, gone = {s.path for v in kept for s in whole[v].shards}, 0
        # What is not whole stays while its number is the highest: the next commit takes the one after it.
        for v in self.versions():
            if kept and v < kept[-1] and v not in kept:
                self._fs.delete(self._path(f"manifests/v{v:08d}.json"), False)
        before = (time.time() - age) * 1000
        for s in self._fs.listStatus(self._path("manifests")) if kept else []:
            if s.getPath().getName().startswith("draft-") and s.getModificationTime() <= before:
                self._fs.delete(s.getPath(), False)
        for folder in self._fs.listStatus(self._path("data")) if self._fs.exists(self._path("data")) else []:
            for s in self._fs.listStatus(folder.getPath()):
                path = f"data/{folder.getPath().getName()}/{s.getPath().getName()}"
                if path.endswith(".parquet") and path not in live and s.getModificationTime() <= before:
                    gone += bool(self._fs.delete(self._path(path), False))
        return gone

    # -- reading ---------------------------------------------------------

    def _read(self, shards, schema: T.StructType | None) -> DataFrame:
        if schema is None:
            raise ValueError("nothing was ever appended to this store")
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read(m.shards, m.schema)


def _born(new: list[Shard], base: Manifest) -> list[Shard]:
    return [Shard(s.path, s.bytes, s.rows, base.version + 1) for s in new]


def _merged(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """The fields of both, nullable; a field that changes its type is refused."""
    fields = {f.name: T.StructField(f.name, f.dataType) for f in (old or T.StructType())}
    for f in new:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name!r} was {fields[f.name].dataType.simpleString()} and comes as {f.dataType.simpleString()}")
        fields.setdefault(f.name, T.StructField(f.name, f.dataType))
    return T.StructType(list(fields.values()))

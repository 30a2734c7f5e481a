"""A table of immutable shards with size-tiered compaction and versioned manifests.

Arrivals are appended as small shards, one file for each task that writes. Compaction takes tiers of similarly
sized shards and merges a tier's run into files of about the target size, without a shuffle. Every change is a
new manifest: a JSON list of shards. It is written whole under a name of its own and then appears under the number after the version
it was made from, in one step that fails if the number is taken. Readers see one whole version; a writer that loses the race
starts over from what is there. What a job leaves that fails before its commit is in no manifest.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm.spread import fresh

TARGET_BYTES = 128 << 20
#: A tier holds shards of sizes within this factor; so many make a run.
TIER_FACTOR, RUN = 4, 2
#: Bytes of a row group, so that a task that writes a whole target file needs little memory.
ROW_GROUP = 16 << 20


class Shard(NamedTuple):
    """A file, relative to the store, with its rows and bytes."""

    file: str
    rows: int
    bytes: int


class Conflict(RuntimeError):
    """Another writer changed the shards that this one replaces."""


class ShardStore:
    """Shards below ``path``, a folder of any file system that Spark reaches; it need not exist."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET_BYTES):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._no_names = spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[tuple[str, int]]:
        at = self._at(folder)
        return [(x.getPath().getName(), x.getLen()) for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        """The last committed version; 0 if there is none."""
        return max((int(n[1:-5]) for n, _ in self._names("_manifests") if n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._at(f"_manifests/v{version:08d}.json"))
        try:
            return [Shard(*x) for x in json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["shards"]]
        finally:
            stream.close()

    def _publish(self, draft, final) -> bool:
        """Gives a complete draft its final name; False if that is taken. Any other failure is raised."""
        try:
            if self._fs.getScheme() == "file":  # a link is made or not, a rename would overwrite
                files, paths = self._jvm.java.nio.file.Files, self._jvm.java.nio.file.Paths
                files.createLink(paths.get(final.toUri().getPath(), self._no_names), paths.get(draft.toUri().getPath(), self._no_names))
            else:
                kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                options = self.spark.sparkContext._gateway.new_array(kinds, 1)
                options[0] = kinds.NONE
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(draft, final, options)
            return True
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        finally:
            self._fs.delete(draft, False)

    def commit(self, added: list[Shard], removed: list[str] = ()) -> int:
        """Makes a version with these changes to the last one. Raises Conflict if a removed shard is gone already."""
        while True:  # each round that does not end is another writer's version
            last = self.version()
            now = self.shards(last)
            if missing := set(removed) - {s.file for s in now}:
                raise Conflict(f"shards that are no longer there: {sorted(missing)[:3]}")
            after = [s for s in now if s.file not in set(removed)] + list(added)
            draft = self._at(f"_manifests/.{uuid.uuid4().hex}.tmp")
            out = self._fs.create(draft, False)
            out.write(bytearray(json.dumps({"version": last + 1, "shards": after}).encode()))
            out.close()
            if self._publish(draft, self._at(f"_manifests/v{last + 1:08d}.json")):
                return last + 1

    def _written(self, frame: DataFrame) -> list[Shard]:
        folder = f"data/{uuid.uuid4().hex}"
        frame.write.option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/{folder}")
        files = {n: size for n, size in self._names(folder) if n.endswith(".parquet")}
        if not files:
            return []
        rows = {r[0].rpartition("/")[2]: r[1] for r in self.spark.read.parquet(f"{self.path}/{folder}").groupBy("_metadata.file_path").count().collect()}
        empty = [n for n in files if not rows.get(n)]
        for n in empty[1:] if len(empty) == len(files) else empty:
            self._fs.delete(self._at(f"{folder}/{n}"), False)
        return [Shard(f"{folder}/{n}", rows.get(n, 0), size) for n, size in sorted(files.items()) if rows.get(n) or (len(empty) == len(files) and n == empty[0])]

    def append(self, arrival: DataFrame) -> int:
        """Adds the rows of an arrival as small shards, as they lie in its partitions; the version. An empty first arrival keeps the schema."""
        return self.commit(self._written(arrival))

    def tiers(self, shards: list[Shard]) -> list[list[Shard]]:
        """Shards below the target by size: each tier's largest is at most TIER_FACTOR times its smallest."""
        out: list[list[Shard]] = []
        for s in sorted((s for s in shards if s.bytes < self.target * 3 // 4), key=lambda s: (s.bytes, s.file)):
            if out and s.bytes <= out[-1][0].bytes * TIER_FACTOR:
                out[-1].append(s)
            else:
                out.append([s])
        return out

    def compact(self, vacuum: bool = True) -> int:
        """Merges runs until no tier holds RUN shards that fit one file; the version. ``vacuum`` deletes merged shards, which earlier versions then lack."""
        while True:
            now = self.shards()
            added: list[Shard] = []
            removed: list[Shard] = []
            for tier in self.tiers(now):
                total = sum(s.bytes for s in tier)
                files = max(1, round(total / self.target))
                if len(tier) < RUN or files >= len(tier):
                    continue
                frame = self.spark.read.parquet(*[f"{self.path}/{s.file}" for s in tier])
                new = self._written(frame.coalesce(files))
                if sum(s.rows for s in new) != sum(s.rows for s in tier):
                    raise RuntimeError("a merge changed the number of rows")
                added += new
                removed += tier
            if not removed:
                return self.version()
            self.commit(added, [s.file for s in removed])
            if vacuum:
                for s in removed:
                    self._fs.delete(self._at(s.file), False)
            if len(added) >= len(removed):
                return self.version()

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """The rows of a version (the last); ``shard``: a new column for the shard's file."""
        files = self.shards(version)
        if not files:
            raise ValueError("the store has no shards")
        frame = self.spark.read.parquet(*[f"{self.path}/{s.file}" for s in files])
        if shard is None:
            return frame
        return frame.withColumn(shard, F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -3, 3)))


def shard_documents(docs: DataFrame, path: str, arrivals: int = 2, doc_id: str = "doc_id", target: int = TARGET_BYTES) -> tuple[DataFrame, dict[str, str], ShardStore]:
    """``docs`` through a store: appended in ``arrivals`` (by a hash of the id), compacted and read back with shard and version.

    Nulls, repeated rows and empty tables come back as they are; column names that differ from the new ones are kept.
    """
    store = ShardStore(docs.sparkSession, path, target)
    for k in range(arrivals):
        store.append(docs.filter(F.pmod(F.xxhash64(doc_id), F.lit(arrivals)) == k))
    version = store.compact()
    names = {"shard": fresh(docs.columns, "shard"), "version": fresh(docs.columns, "shard_version")}
    return store.read(shard=names["shard"]).withColumn(names["version"], F.lit(version)), names, store

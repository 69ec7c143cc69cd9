"""Size-tiered compaction of immutable shards under a versioned manifest."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1 << 20
#: How often a commit that another writer came before is tried on the version then latest.
TRIES = 20
#: Files that no manifest has named yet may belong to a writer that is still at work for so many seconds.
GRACE = 24 * 3600


class CommitConflict(RuntimeError):
    """Another writer committed the version first; read the manifest again and retry."""


@dataclass(frozen=True)
class Shard:
    file: str
    size: int
    rows: int


class ShardStore:
    """A table in a folder: immutable Parquet shards, and manifests v00000001.json, ... each naming the shards it has.

    The folder is reached by Hadoop's file systems alone. A version is committed by renaming its finished manifest to
    a name that must not exist yet, so readers see all of a version or none, and of two writers one fails and tries
    again on the other's version. Files that no manifest names, as those of a job that was cut off, are never read;
    vacuum() removes them once they are old. The driver handles the shards' names, sizes and row counts, never their
    rows."""

    def __init__(self, spark: SparkSession, folder: str, target: int = 64 * MB, fanout: int = 4, least: int = MB, width: int = 64):
        self.spark, self.folder, self.target, self.fanout, self.least, self.width = spark, folder.rstrip("/"), target, fanout, least, width
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.folder}/manifests"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        """The versions whose manifests are there, in order."""
        names = [x.getPath().getName() for x in self.fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The latest version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        text = self.spark.read.text(f"{self.folder}/manifests/v{version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**x) for x in self.manifest(version)["shards"]]

    def _commit(self, version: int, schema: str, shards: list[Shard]) -> None:
        draft = self._path(f"{self.folder}/manifests/draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, self._path(f"{self.folder}/manifests/v{version:08d}.json"), none)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {version} is there already") from e
            raise

    def _update(self, schema: str | None, change: Callable[[list[Shard]], list[Shard] | None]) -> int | None:
        """Commits what change makes of the latest version's shards; gives the version, or null if change gives null.

        change runs anew on the version of another writer who came first."""
        for _ in range(TRIES):
            old = self.manifest()
            shards = change([Shard(**x) for x in old["shards"]])
            if shards is None:
                return None
            try:
                self._commit(old["version"] + 1, old["schema"] or schema, shards)
                return old["version"] + 1
            except CommitConflict:
                continue
        raise CommitConflict(f"{TRIES} other versions came first")

    def _write(self, df: DataFrame) -> list[Shard]:
        """A shard for each task of df that has rows."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        files = {x.getPath().getName(): x.getLen() for x in self.fs.listStatus(self._path(folder)) if x.getPath().getName().startswith("part-")}
        if not files:
            return []
        rows = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).count().collect()  # a row a shard
        rows = {r["name"]: r["count"] for r in rows}
        return [Shard(f"{folder[len(self.folder) + 1 :]}/{n}", size, rows[n]) for n, size in sorted(files.items()) if n in rows]

    def append(self, df: DataFrame) -> int:
        """Adds df's rows as new shards, one for each of its tasks, and commits; gives the version.

        The rows are written once; where another writer commits meanwhile, they are added to that version."""
        shards = self._write(df)
        return self._update(df.schema.json(), lambda old: old + shards)

    def tier(self, size: int) -> int:
        tier, top = 0, self.least
        while size >= top:
            tier, top = tier + 1, top * self.fanout
        return tier

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to be merged: neighbours in order of arrival within a tier, from fanout shards up, cut near the target.

        Shards of half the target or more are finished. What the last run of a tier leaves below fanout waits."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target // 2:
                tiers.setdefault(self.tier(s.size), []).append(s)
        runs = []
        for _, members in sorted(tiers.items()):
            run: list[Shard] = []
            for s in members:
                if run and sum(x.size for x in run) + s.size > self.target:
                    runs.append(run)
                    run = []
                run.append(s)
            if run:
                runs.append(run)
        return [r for r in runs if len(r) >= self.fanout or len(r) > 1 and sum(x.size for x in r) >= self.target // 2]

    def _read(self, files: list[str], schema: str) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*[f"{self.folder}/{f}" for f in files])

    def compact(self) -> int:
        """Merges runs until no tier has one, committing a version a round; gives the version.

        A merge is one task that reads a run's shards and writes one file, without a shuffle, so that no key's rows
        gather anywhere; jobs hold `width` merges at most. Shards that arrive meanwhile stay. If another compaction took
        the same shards first, this round's files are left to vacuum() and the runs are planned anew."""
        while runs := self.plan((old := self.manifest()) and [Shard(**x) for x in old["shards"]]):
            new: list[Shard] = []
            for k in range(0, len(runs), self.width):
                merges = [self._read([s.file for s in run], old["schema"]).coalesce(1) for run in runs[k : k + self.width]]
                new += self._write(reduce(DataFrame.unionAll, merges))
            gone = {s.file for run in runs for s in run}
            if sum(s.rows for run in runs for s in run) != sum(s.rows for s in new):
                raise RuntimeError("merged shards hold other row counts than their sources")
            self._update(old["schema"], lambda now: [s for s in now if s.file not in gone] + new if gone <= {s.file for s in now} else None)
        return self.version()

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> int:
        """Removes the data files that only versions before the last `keep` name, with their manifests; gives the files removed.

        Files that no manifest names at all may belong to a writer that hasn't committed yet; they go when they are
        older than grace seconds."""
        versions = self.versions()
        kept, old = versions[-keep:] if keep else [], versions[:-keep] if keep else versions
        named = {s.file for v in kept for s in self.shards(v)}
        retired = {s.file for v in old for s in self.shards(v)} - named
        n = sum(bool(self.fs.delete(self._path(f"{self.folder}/{f}"), False)) for f in sorted(retired))
        data, latest = self._path(f"{self.folder}/data"), (time.time() - grace) * 1000
        for d in self.fs.listStatus(data) if self.fs.exists(data) else []:
            files = list(self.fs.listStatus(d.getPath()))
            own = {f"data/{d.getPath().getName()}/{x.getPath().getName()}": x for x in files if x.getPath().getName().startswith("part-")}
            if not own.keys() & named and max([d.getModificationTime(), *(x.getModificationTime() for x in files)]) <= latest:
                n += len(own)
                self.fs.delete(d.getPath(), True)
        for v in old:
            self.fs.delete(self._path(f"{self.folder}/manifests/v{v:08d}.json"), False)
        return n

    def read(self, version: int | None = None, shard: str | None = None) -> DataFrame:
        """The rows of a version; shard: a column for the place of each row's shard in the manifest, by a name that no
        column has."""
        manifest = self.manifest(version)
        if not manifest["version"]:
            raise ValueError("nothing was committed yet")
        files = [s["file"] for s in manifest["shards"]]
        df = self._read(files, manifest["schema"]) if files else self.spark.createDataFrame([], self._read(["manifests"], manifest["schema"]).schema)
        if not shard:
            return df
        columns = df.columns
        if shard.lower() in map(str.lower, columns):
            raise ValueError(f"there is a column {shard} already")
        places = {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1]: k for k, f in enumerate(files)}
        own = [f"c{k}" for k in range(len(columns))]
        names = self.spark.createDataFrame(list(places.items()), "file string, place int")
        tail = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1) if files else F.lit(None).cast("string")
        # The columns go by place, so that none can clash with the two that are added; names has a row a shard.
        tagged = df.select(*[F.col(f"`{c.replace('`', '``')}`").alias(x) for c, x in zip(columns, own, strict=True)], tail.alias("file"))
        return tagged.join(F.broadcast(names), "file", "left").select(*[F.col(x).alias(c) for x, c in zip(own, columns, strict=True)], F.col("place").alias(shard))


def free_name(columns: list[str], name: str) -> str:
    """name, with so many _ behind it that no column has it."""
    while name.lower() in map(str.lower, columns):
        name += "_"
    return name


def compacted(docs: DataFrame, folder: str, target: int = 64 * MB, fanout: int = 4) -> ShardStore:
    """A store in folder with the rows of docs, arrived as one shard for each of its tasks, compacted and vacuumed.

    Rows, columns, nulls and repeats stay as they are, whatever the columns are called. An empty table gives a
    version without shards."""
    store = ShardStore(docs.sparkSession, folder, target, fanout)
    store.append(docs)
    store.compact()
    store.vacuum()
    return store

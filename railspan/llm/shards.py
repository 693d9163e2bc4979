"""Sharded tables with size-tiered compaction and versioned manifests (operator 2).

A store is a folder of immutable Parquet shards and numbered manifests. append() writes an arrival as small
shards and commits a manifest that adds them. compact() looks for tiers, shards whose sizes share a power of
FAN_IN, merges each tier of FAN_IN shards or more into files of the target size in one pass without a
shuffle (the reader packs whole small files into one task up to the target), checks that no row was lost, and
commits a manifest that swaps them. A manifest is written beside its name and renamed only if no one else
took that version, so readers see whole versions, and of two writers one fails and can retry. Files of lost
or repeated tasks are in no manifest. vacuum() deletes what only old manifests name; a writer leaves an intent
before its first file and takes it away after its commit, and vacuum() spares the files of intents younger than
a grace time.

A manifest holds a line for each shard (about a hundred bytes for a target-sized file), never rows. Nulls and
extra columns are stored as they are; an empty arrival commits a version without new shards.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, table

TARGET_BYTES = 128 << 20
#: Rows of an arrival's shards at most, and shards of a tier that are merged.
ARRIVAL_ROWS, FAN_IN = 4000, 4
#: Sizes under this are one tier.
LEAST_BYTES = 1 << 20


class Conflict(RuntimeError):
    """Another writer committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int

    @property
    def tier(self) -> int:
        return 0 if self.bytes < LEAST_BYTES else 1 + int(math.log(self.bytes / LEAST_BYTES, FAN_IN))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES) -> None:
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        self._jvm = spark._jvm
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(folder) if f.getPath().getName()[0].isdigit() and f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, dict | None, list[Shard]]:
        """(version, schema, shards) of a version, by default the last; (0, None, []) for a new store."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return 0, None, []
        head, *rows = [r["value"] for r in self.spark.read.text(f"{self.root}/_manifests/{version:010d}.json", wholetext=False).collect()]
        return version, json.loads(head)["schema"], [Shard(**json.loads(r)) for r in rows]

    def _commit(self, version: int, schema: dict, shards: list[Shard]) -> int:
        folder = f"{self.root}/_manifests"
        self._fs.mkdirs(self._path(folder))
        temporary = self._path(f"{folder}/_{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        text = "\n".join([json.dumps({"version": version, "schema": schema}), *(json.dumps(asdict(s)) for s in shards)])
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self._jvm.org.apache.hadoop.fs.Options
        none = self.spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 0)
        try:
            context.rename(temporary, self._path(f"{folder}/{version:010d}.json"), none)
        except Exception as e:
            self._fs.delete(temporary, False)
            raise Conflict(f"version {version} exists") from e
        return version

    def _shards(self, folder: str) -> list[Shard]:
        """The shards of a written folder; rows come from the files' footers."""
        files = {}
        todo = self._fs.listFiles(self._path(folder), True)
        while todo.hasNext():
            f = todo.next()
            if f.getPath().getName().endswith(".parquet"):
                files[f.getPath().toString()] = f.getLen()
        if not files:
            return []
        counted = self.spark.read.parquet(*files).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count("*").alias("n")).collect()  # a row for each file
        name = lambda p: unquote(p).split("/data/", 1)[1]
        rows = {name(r["p"]): r["n"] for r in counted}
        return [Shard(p, size, rows[name(p)]) for p, size in sorted(files.items()) if rows.get(name(p))]

    def append(self, df: DataFrame) -> int:
        return self.append_each(df, None)

    def append_each(self, df: DataFrame, arrival: str | None) -> int:
        """Append df as one arrival, or as one for each value of the column arrival, in a single scan; returns the last version."""
        version, schema, shards = self.manifest()
        own = json.loads((df.drop(arrival) if arrival else df).schema.json())
        if schema is not None and schema != own:
            raise ValueError("the arrival's columns differ from the store's")
        folder = self._intend()
        writer = df.write.option("maxRecordsPerFile", ARRIVAL_ROWS)
        if arrival:
            writer = writer.partitionBy(arrival)
            df = df.drop(arrival)
        writer.parquet(folder)
        new = self._shards(folder)
        groups: dict[str, list[Shard]] = {}
        for s in new:
            groups.setdefault(s.path.rsplit("/", 1)[0], []).append(s)
        for part in [groups[k] for k in sorted(groups)] or [[]]:
            shards = shards + part
            version = self._commit(version + 1, own, shards)
        self._done(folder)
        return version

    def _intend(self) -> str:
        """A new data folder, named by an intent."""
        name = uuid.uuid4().hex
        self._fs.mkdirs(self._path(f"{self.root}/_intents"))
        self._fs.create(self._path(f"{self.root}/_intents/{name}"), False).close()
        return f"{self.root}/data/{name}"

    def _done(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.root}/_intents/{folder.rsplit('/', 1)[1]}"), False)

    def _merge(self, shards: list[Shard], schema: dict, folder: str) -> list[Shard]:
        confs = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in confs}
        try:
            for k, v in confs.items():
                self.spark.conf.set(k, v)
            self._read(shards, schema).write.parquet(folder)
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        merged = self._shards(folder)
        if sum(s.rows for s in merged) != sum(s.rows for s in shards):
            raise RuntimeError("a merge lost rows; nothing is committed")
        return merged

    def compact(self) -> int:
        """Merge every tier of FAN_IN or more shards under the target; returns the version, unchanged if there is none."""
        version, schema, shards = self.manifest()
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target * 3 // 4:
                tiers.setdefault(s.tier, []).append(s)
        due = {t: v for t, v in tiers.items() if len(v) >= FAN_IN}
        if not due:
            return version
        gone = {s.path for v in due.values() for s in v}
        folders = {t: self._intend() for t in sorted(due)}
        new = [m for t in sorted(due) for m in self._merge(due[t], schema, folders[t])]
        version = self._commit(version + 1, schema, [s for s in shards if s.path not in gone] + new)
        for folder in folders.values():
            self._done(folder)
        return version

    def compact_all(self) -> int:
        """Rounds of compact() until no tier is due or a round saves no file; each round before has fewer files, so it ends."""
        while True:
            before = self.manifest()
            version = self.compact()
            if version == before[0] or len(self.manifest()[2]) >= len(before[2]):
                return version

    def _read(self, shards: list[Shard], schema: dict) -> DataFrame:
        kind = T.StructType.fromJson(schema)
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        version, schema, shards = self.manifest(version)
        if schema is None:
            raise ValueError("the store has no version")
        return self._read(shards, schema)

    def vacuum(self, grace_s: float = 86_400) -> int:
        """Delete shards that the last manifest doesn't name, and all older manifests; the number of shards deleted.

        Folders of writers at work stay: those with an intent younger than grace_s. Files are listed first, intents next
        and the manifest last, so a file without an intent was committed before the manifest was read, or never will be.
        """
        name = lambda p: p.split("/data/", 1)[1]
        todo, files = self._fs.listFiles(self._path(f"{self.root}/data"), True), []
        while todo.hasNext():
            f = todo.next().getPath()
            if f.getName().endswith(".parquet"):
                files.append(f)
        folder, busy = self._path(f"{self.root}/_intents"), set()
        if self._fs.exists(folder):
            busy = {f.getPath().getName() for f in self._fs.listStatus(folder) if time.time() - f.getModificationTime() / 1000 < grace_s}
        version, _, shards = self.manifest()
        live, gone = {name(s.path) for s in shards}, 0
        old = [f for f in files if name(f.toString()) not in live and name(f.toString()).split("/")[0] not in busy]
        for f in old:
            gone += bool(self._fs.delete(f, False))
        for v in self.versions():
            if v < version:
                self._fs.delete(self._path(f"{self.root}/_manifests/{v:010d}.json"), False)
        return gone


ARRIVALS = 4


def op2_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in ARRIVALS arrivals, compacted, and read back by the last manifest."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, fresh_path(spark, "shards"))
    store.append_each(docs.withColumn("_arrival", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), "_arrival")
    version = store.compact_all()
    store.vacuum()
    text = F.coalesce(F.col("text"), F.lit(""))
    return store.read().select("doc_id", "lang", "source", F.octet_length(text).cast("bigint").alias("n_bytes"), F.md5(text.cast("binary")).alias("text_md5"), (F.lit(version) > ARRIVALS).alias("compacted"))


OP2_SQL = "SELECT doc_id, lang, source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS text_md5, true AS compacted FROM documents"

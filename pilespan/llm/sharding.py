"""Immutable shards, compacted by size tiers, under a versioned manifest.

Arrivals are appended as small Parquet files, one a task, without a shuffle. Files of similar size form a
tier; a tier with enough of them is merged into larger files, up to the target size, by tasks that each
read a run of files and write one. A version's manifest says which files it adds and removes, and every
CHECKPOINT versions all files are listed. A manifest is written aside and gets its number in one step that fails if
the number is taken, so of two writers one commits and readers see a whole version or the one before. A
lost task is run again; a lost driver leaves only files that no manifest lists.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, work_path

#: Bytes of a full shard; files of a tier that start a merge; how much larger the next tier is.
TARGET_BYTES, FAN_IN, TIER_RATIO = 128 << 20, 4, 4
#: Most rows of a shard as it arrives; versions from one full list of files to the next.
ARRIVAL_ROWS, CHECKPOINT = 4096, 16
#: Versions that vacuum() keeps for readers and writers on them; seconds after which a file that no manifest ever listed is taken for abandoned.
KEEP, GRACE = 8, 7 * 86400


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """A folder with data files and manifests.

    The step that commits is a hard link on local disks and a rename that doesn't overwrite elsewhere. It is
    atomic on HDFS and on file systems that rename as it does; object stores without such a rename may
    be read by many, but need a single writer.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target_bytes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> set[str]:
        at = self._path(f"{self.path}/manifests")
        return {f.getPath().getName() for f in self._fs.listStatus(at)} if self._fs.exists(at) else set()

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        return sorted(int(n[1:-5]) for n in self._names() if n.startswith("v") and n.endswith(".json"))

    def _read(self, kind: str, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/manifests/{kind}{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, kind: str, version: int, entry: dict) -> None:
        """A manifest (v) or full list (c) under its number; FileExistsError if that is taken."""
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        aside = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        try:
            self._publish(aside, self._path(f"{self.path}/manifests/{kind}{version:012d}.json"))
        finally:
            self._fs.delete(aside, False)

    def manifest(self, version: int | None = None) -> dict:
        """The version, schema and files of a version, the last by default; an empty one before the first commit."""
        names = self._names()
        known = sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))
        if not known:
            return {"version": 0, "schema": None, "files": []}
        last = at = version or known[-1]
        steps = []
        while at and f"c{at:012d}.json" not in names:
            steps.append(self._read("v", at))
            at -= 1
        files = {f["name"]: f for f in self._read("c", at)["files"]} if at else {}
        for e in reversed(steps):
            for name in e["removed"]:
                del files[name]
            files |= {f["name"]: f for f in e["added"]}
        return {"version": last, "schema": self._read("v", last)["schema"], "files": list(files.values())}

    def commit(self, base: dict, added: list[dict], removed: list[str], schema: str) -> dict:
        """Make base without `removed` and with `added` the version after it; Conflict if that version is there already."""
        number, gone = base["version"] + 1, set(removed)
        try:
            self._write("v", number, {"version": number, "schema": schema, "added": added, "removed": removed})
        except FileExistsError:
            raise Conflict(f"version {number} is committed already") from None
        new = {"version": number, "schema": schema, "files": [f for f in base["files"] if f["name"] not in gone] + added}
        if number % CHECKPOINT == 0:
            self._list(new)
        return new

    def _list(self, manifest: dict) -> None:
        """Write the full list of a version's files, which is the same whoever does."""
        with contextlib.suppress(FileExistsError):
            self._write("c", manifest["version"], {"files": manifest["files"]})

    def _publish(self, aside, final) -> None:
        """Give a file its final name; FileExistsError if the name is taken."""
        if self._fs.getScheme() == "file":
            os.link(aside.toUri().getPath(), final.toUri().getPath())
            return
        hadoop = self.spark._jvm.org.apache.hadoop
        none = self.spark._sc._gateway.new_array(hadoop.fs.Options.Rename, 1)
        none[0] = hadoop.fs.Options.Rename.NONE
        try:
            hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, none)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise FileExistsError(str(final)) from None
            raise

    def _written(self, df: DataFrame, most_rows: int = 0) -> list[dict]:
        """Write df as data files, of at most most_rows if that isn't 0; their names and sizes."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", most_rows).parquet(f"{self.path}/{folder}")
        found = self._fs.listStatus(self._path(f"{self.path}/{folder}"))
        return sorted(({"name": f"{folder}/{f.getPath().getName()}", "bytes": f.getLen()} for f in found if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda x: x["name"])

    def append(self, df: DataFrame, most_rows: int = ARRIVAL_ROWS) -> dict:
        """Commit the rows of df as small shards of their own, as df's tasks hold them."""
        base = self.manifest()
        return self.commit(base, self._written(df, most_rows), [], df.schema.json())

    def tier(self, size: int) -> int:
        """Files at most TIER_RATIO times apart share a tier, counted from the target down."""
        tier, room = 0, self.target // 2
        while size < room:
            tier, room = tier + 1, room // TIER_RATIO
        return tier

    def plan(self, files: list[dict]) -> list[list[dict]]:
        """Runs of similarly sized files to merge, each near the target at most.

        A tier below full shards is merged when it has FAN_IN files, or bytes for a full shard.
        """
        tiers: dict[int, list[dict]] = {}
        for f in sorted(files, key=lambda f: f["name"]):
            tiers.setdefault(self.tier(f["bytes"]), []).append(f)
        runs = []
        for tier, own in tiers.items():
            if tier and (len(own) >= FAN_IN or sum(f["bytes"] for f in own) >= self.target):
                run, size = [], 0
                for f in own:
                    if run and size + f["bytes"] > self.target:
                        runs.append(run)
                        run, size = [], 0
                    run.append(f)
                    size += f["bytes"]
                runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self) -> dict:
        """Merge tiers until none is due; each round is a version of its own. Returns the last manifest."""
        while True:
            base = self.manifest()
            runs = self.plan(base["files"])
            if not runs:
                return base
            gone = [f["name"] for r in runs for f in r]
            merged = []
            for run in self._batches(runs):
                merged += self._merge(run, base["schema"])
            self.commit(base, merged, gone, base["schema"])

    def _batches(self, runs: list[list[dict]], most: int = 512) -> list[list[list[dict]]]:
        return [runs[i : i + most] for i in range(0, len(runs), most)]

    def _merge(self, runs: list[list[dict]], schema: str) -> list[dict]:
        """One file a run: the union keeps a run's rows in a partition of their own."""
        reader = self.spark.read.schema(StructType.fromJson(json.loads(schema)))
        parts = [reader.parquet(*[f"{self.path}/{f['name']}" for f in run]).coalesce(1) for run in runs]
        while len(parts) > 1:  # a balanced tree of unions
            parts = [a.union(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
        # else Spark puts single partitions together in one
        name, kept = "spark.sql.unionOutputPartitioning", self.spark.conf.get("spark.sql.unionOutputPartitioning", None)
        self.spark.conf.set(name, "false")
        try:
            return self._written(parts[0])
        finally:
            self.spark.conf.unset(name) if kept is None else self.spark.conf.set(name, kept)

    def vacuum(self, keep: int = KEEP, grace: float = GRACE) -> None:
        """Forget all but the last `keep` versions, and delete the files that only forgotten versions have.

        A file that no version lists may be a writer's who hasn't committed yet; it goes only when it is
        older than `grace` seconds. Readers and writers on kept versions aren't disturbed.
        """
        known = self.versions()
        kept, gone = known[-keep:], known[:-keep]
        if not kept:
            return
        steps = [self._read("v", v) for v in known]
        lists = [self.manifest(v) for v in kept]
        live = {f["name"] for m in lists for f in m["files"]}
        expired = {name for e in steps for name in e["removed"]} - live
        self._list(lists[0])
        for v in gone:
            for kind in "vc":
                self._fs.delete(self._path(f"{self.path}/manifests/{kind}{v:012d}.json"), False)
        for name in expired:
            self._fs.delete(self._path(f"{self.path}/{name}"), False)
        listed, before = live | expired, (time.time() - grace) * 1000
        for folder in self._fs.listStatus(self._path(f"{self.path}/data")):
            files = list(self._fs.listStatus(folder.getPath()))
            for f in files:
                if f"data/{folder.getPath().getName()}/{f.getPath().getName()}" not in listed and f.getModificationTime() < before:
                    self._fs.delete(f.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("nothing is committed")
        schema = StructType.fromJson(json.loads(m["schema"]))
        if not m["files"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f['name']}" for f in m["files"]])


def shard(arrivals: list[DataFrame], path: str, target_bytes: int = TARGET_BYTES) -> ShardStore:
    """Append each arrival, compacting after each; the store.

    Rows keep every column and value, in any number: nulls, ties, repeated rows, very long texts, extra columns of any
    name, and empty arrivals are stored as they are.
    """
    store = None
    for df in arrivals:
        store = store or ShardStore(df.sparkSession, path, target_bytes)
        store.append(df)
        store.compact()
    return store


#: Arrivals that the query makes of the table, and its target.
QUERY_ARRIVALS, QUERY_TARGET = 8, 64 << 20


def by_id(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs as n arrivals in the order of doc_id, of about as many rows each; rows without id come first."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("cuts")).first()["cuts"]
    edges = [None, *sorted(set(cuts or [])), None]
    out = []
    for low, high in zip(edges[:-1], edges[1:]):
        here = F.lit(True) if low is None else F.col("doc_id") >= low
        out.append(docs.where(here if high is None else here & (F.col("doc_id") < high)))
    return [docs.where("doc_id is null").unionByName(out[0].where("doc_id is not null")), *out[1:]]


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document lies after the table arrived in the order of its ids, in eighths, and was compacted.

    Returns doc_id, shard (its file's name), version, shard_bytes and n_chars_stored (code points, null for a null
    text), all read from the committed version. An empty table gives no rows.
    """
    docs = documents(spark, sf_dir)
    store = shard(by_id(docs, QUERY_ARRIVALS), work_path(spark, "shards"), QUERY_TARGET)
    store.vacuum(keep=1)  # the query's store has no other writer
    rows = store.read().select("doc_id", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.length("text").cast("long").alias("n_chars_stored"))
    return rows.select("doc_id", "shard", F.lit(store.manifest()["version"]).alias("version"), "shard_bytes", "n_chars_stored")

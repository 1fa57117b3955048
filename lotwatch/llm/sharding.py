"""Sharding by size-tiered compaction with versioned manifests; DataFrame functions only.

A table is a folder of immutable Parquet files (shards) and of versions. An arrival is appended as the small shards
that its own tasks write, without a shuffle. Compaction puts shards into tiers by size (each tier FAN_IN times the
one below), packs the shards of a tier, in order of size, into runs of about the target size, and merges each run
that fills three quarters of it, or has FAN_IN * FAN_IN shards, into one new shard. Smaller runs wait for more
arrivals, so that a row is rewritten about once on its way to a target-sized file; the last compaction of an import
also merges what waits, tier by tier and at the end across tiers. Shards of half the target size or more stay as they are. The plan is made
on the manifest, one row per shard; only the rows of merged shards are shuffled, to one task per new shard.

A version is a Parquet folder with the manifest's rows; it is committed by renaming a small pointer file to its
number, which fails if another writer had that number first. Readers see whole versions only; a lost task or job
leaves files that no version names. vacuum() deletes the shards that the last version doesn't name; it is for when no other
writer is at work, whose files no version names yet.

Edge cases: all columns travel unread, so nulls, empty and long texts, repeated rows and extra columns come back as
they were, every row once; a row larger than the target is a shard of its own size; an empty arrival adds no shards, and
a table without any reads as an empty one with the arrival's columns; columns that only some arrivals have are null in
the others; the operator's own column names give way to the table's by underscores.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lotwatch.llm.common import delete_path, fresh_path

TARGET_BYTES, FAN_IN, ARRIVALS = 128 << 20, 4, 4
MANIFEST = "shard string, path string, bytes long, rows long, tier int, since long"


class ShardedTable:
    """A table below `path`. Each append() or compact() commits one version."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> None:
        self.spark, self.path, self.target, self.fan_in = spark, path.rstrip("/"), target_bytes, fan_in
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._hadoop(self.path).getFileSystem(self.conf)
        self.fs.mkdirs(self._hadoop(f"{self.path}/versions"))

    def _hadoop(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """The number of the last committed version, 0 before the first."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._hadoop(f"{self.path}/versions"))]
        return max([0, *(int(n) for n in names if n.isdigit())])

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version, the last one by default."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        name = self.spark.read.text(f"{self.path}/versions/{version:012d}").first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{name}")

    def commit(self, manifest: DataFrame, version: int) -> None:
        """Make `manifest` version `version`, or fail if there is such a version already."""
        name = uuid.uuid4().hex
        manifest.select("shard", "path", "bytes", "rows", "tier", "since").write.parquet(f"{self.path}/manifests/{name}")
        # A hidden name: not a version until renamed.
        draft = self._hadoop(f"{self.path}/versions/.{name}")
        out = self.fs.create(draft, False)
        out.write(bytearray(name.encode()))
        out.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(draft, self._hadoop(f"{self.path}/versions/{version:012d}"), options)

    def _shards(self, folder: str, version: int) -> DataFrame:
        """Manifest rows of the files that a write has left in `folder`; counts come from the files' footers."""
        files = self.spark.read.parquet(folder) if self._has_files(folder) else None
        if files is None:
            return self.spark.createDataFrame([], MANIFEST)
        meta = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        tier = F.greatest(F.lit(0), F.floor(F.log(F.col("bytes") * F.lit(float(self.fan_in**6)) / self.target) / F.log(F.lit(float(self.fan_in)))))
        counted = meta.groupBy("path", "bytes").agg(F.count(F.lit(1)).alias("rows"))
        return counted.select(F.sha2("path", 256).substr(1, 16).alias("shard"), "path", "bytes", "rows", tier.cast("int").alias("tier"), F.lit(version).cast("long").alias("since"))

    def _has_files(self, folder: str) -> bool:
        found = self.fs.listFiles(self._hadoop(folder), True)
        while found.hasNext():
            if found.next().getPath().getName().endswith(".parquet"):
                return True
        return False

    def append(self, rows: DataFrame) -> int:
        """Add an arrival as shards of what its tasks hold; the new version."""
        version = self.version() + 1
        folder = f"{self.path}/data/append-{version:012d}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        self.spark.createDataFrame([(f"{version:012d} {rows.schema.json()}",)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/schema")
        self.commit(self.manifest(version - 1).unionByName(self._shards(folder, version)), version)
        return version

    def plan(self, last: bool = False, apart: bool = True) -> DataFrame:
        """The shards to merge now: path and run, a number from 0 for each new shard. Without `apart` tiers are one."""
        small = self.manifest().filter(F.col("bytes") < self.target / 2)
        if not apart:
            small = small.withColumn("tier", F.lit(0))
        by_size = Window.partitionBy("tier").orderBy("bytes", "path")
        before = F.coalesce(F.sum("bytes").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        packed = small.withColumn("run", F.concat_ws("-", "tier", F.floor((before + F.col("bytes") / 2) / self.target)))
        together = Window.partitionBy("run")
        shards, filled = F.count(F.lit(1)).over(together), F.sum("bytes").over(together) >= 0.75 * self.target
        worth = (shards > 1) & (F.lit(last) | filled | (shards >= self.fan_in**2))
        # One window over the manifest's rows, of which there is one a shard.
        return packed.withColumn("worth", worth).filter("worth").select("path", (F.dense_rank().over(Window.orderBy("run")) - 1).alias("run"))

    def compact(self, last: bool = False) -> int:
        """Merge until no run is worth merging. The last compaction of an import then merges what is left of a tier,
        however little, and at the end the shards that are alone in theirs. The number of the last version."""
        while True:
            version = self.version() + 1
            for apart in (True, False) if last else (True,):
                plan = self.plan(last, apart)
                chosen = plan.collect()  # a path and a number for each shard to merge, as Spark's file index has anyway
                if chosen:
                    break
            else:
                return version - 1
            folder = f"{self.path}/data/merge-{version:012d}-{uuid.uuid4().hex}"
            rows = self.spark.read.option("mergeSchema", "true").parquet(*[r["path"] for r in chosen])
            at, run = free_name("_path", rows.columns), free_name("_run", rows.columns)
            runs = 1 + max(r["run"] for r in chosen)
            merged = rows.withColumn(at, F.col("_metadata.file_path")).join(plan.toDF(at, run), at).drop(at)
            # Each run has a partition, and so a file, of its own.
            merged.repartitionById(runs, F.col(run).cast("int")).drop(run).write.option("compression", "zstd").parquet(folder)
            kept = self.manifest(version - 1).join(plan, "path", "left_anti")
            self.commit(kept.unionByName(self._shards(folder, version)), version)

    def vacuum(self) -> None:
        """Delete shards that the last version doesn't name."""
        named = {r["path"].rpartition("/data/")[2] for r in self.manifest().select("path").collect()}
        found = self.fs.listFiles(self._hadoop(f"{self.path}/data"), True)
        while found.hasNext():
            p = found.next().getPath()
            if p.getName().endswith(".parquet") and p.toString().rpartition("/data/")[2] not in named:
                delete_path(self.spark, p.toString())

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows, with the shard that each lies in as column `_shard` (with more underscores if there is one)."""
        manifest = self.manifest(version)
        paths = [r["path"] for r in manifest.select("path").collect()]
        if paths:
            rows = self.spark.read.option("mergeSchema", "true").parquet(*paths)
            path = F.col("_metadata.file_path")
        else:
            rows, path = self.spark.createDataFrame([], self.schema()), F.lit("")
        at, shard = free_name("_path", rows.columns), free_name("_shard", rows.columns)
        about = manifest.select(F.col("path").alias(at), F.struct("shard", "tier", "bytes", "rows").alias(shard))
        return rows.withColumn(at, path).join(about, at).drop(at)

    def schema(self) -> StructType:
        """The columns of the last arrival."""
        found = self.spark.read.text(f"{self.path}/schema").orderBy(F.desc("value")).first()
        return StructType.fromJson(json.loads(found[0].partition(" ")[2]))


def free_name(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def arrivals(docs: DataFrame, most: int = ARRIVALS) -> list[DataFrame]:
    """The input as so many arrivals: its files in order of their names, or where they are fewer, its rows dealt out."""
    files = sorted(docs.inputFiles())
    if len(files) < most:
        turn = F.pmod(F.xxhash64(*docs.columns), F.lit(most))
        return [docs.filter(turn == i) for i in range(most)]
    step = -(-len(files) // most)
    return [docs.sparkSession.read.schema(docs.schema).parquet(*files[i : i + step]) for i in range(0, len(files), step)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back after all arrivals and compactions, with its shard."""
    t = ShardedTable(spark, fresh_path(spark, "sharded"))
    batches = arrivals(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, rows in enumerate(batches):
        t.append(rows)
        t.compact(last=i == len(batches) - 1)
        t.vacuum()
    return t.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col("_shard.shard").alias("shard"), F.col("_shard.tier").alias("tier"), F.col("_shard.bytes").alias("shard_bytes"), F.col("_shard.rows").alias("shard_rows"))

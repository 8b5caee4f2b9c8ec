"""Versions of artifacts: an append-only table that is read through a log of commits.

A batch of artifacts is written into a folder of its own, and counts once its lineage rows are in the log; what a killed writer left is never
read. A key that is immutable, or that is put as immutable though it is there, is refused. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LINEAGE = "batch string, key string, version long, sha256 string, size long, content_type string, immutable boolean, run_id string, stage string, source_hash string, user string, timestamp_utc string"


class ImmutableArtifact(ValueError):
    """Keys that may not be written again."""


class ArtifactStore:
    """Artifacts (key, content, content_type, immutable) below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def lineage(self, run_id: str | None = None) -> DataFrame:
        """Every committed version of every key, or those of a run."""
        try:
            log = self.spark.read.schema(LINEAGE).parquet(f"{self.root}/lineage")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            log = self.spark.createDataFrame([], LINEAGE)
        return log if run_id is None else log.where(F.col("run_id") == run_id)

    def refused(self, artifacts: DataFrame) -> DataFrame:
        """The keys that may not be written: those that are there, if they or what is put are immutable."""
        there = self.lineage().groupBy("key").agg(F.max("immutable").alias("fixed"))
        return artifacts.join(there, "key").where(F.col("fixed") | F.coalesce("immutable", F.lit(False))).select("key").distinct()

    def put(self, artifacts: DataFrame, run_id: str, user: str, stage: str = "download", source_hash: str = "", skip_refused: bool = False) -> DataFrame:
        """Writes new versions and gives their lineage rows. Refused keys raise, or are left out; then nothing, or the rest, is written.

        Within a batch the rows of one key become versions in the order of their hashes, and an immutable one must be the only one.
        """
        refused = self.refused(artifacts)
        twice = artifacts.groupBy("key").agg(F.count("*").alias("n"), F.max(F.coalesce("immutable", F.lit(False))).alias("fixed")).where("n > 1 AND fixed").select("key")
        bad = refused.unionByName(twice)
        if skip_refused:
            artifacts = artifacts.join(bad, "key", "left_anti")
        elif some := bad.limit(3).collect():
            raise ImmutableArtifact(", ".join(r["key"] for r in some))
        batch = uuid.uuid4().hex
        last = self.lineage().groupBy("key").agg(F.max("version").alias("last"))
        sha = F.sha2("content", 256)
        order = Window.partitionBy("key").orderBy("sha256")
        rows = artifacts.select("key", "content", "content_type", F.coalesce("immutable", F.lit(False)).alias("immutable"), sha.alias("sha256"))
        # contents do not go through the exchange that numbers versions
        numbers = rows.select("key", "sha256").withColumn("n", F.row_number().over(order)).join(last, "key", "left").select("key", "sha256", (F.coalesce("last", F.lit(0)) + F.col("n")).alias("version"))
        numbers = numbers.groupBy("key", "sha256").agg(F.sort_array(F.collect_list("version")).alias("versions"))
        path = f"{self.root}/batches/{batch}"
        rows.dropDuplicates(["key", "sha256"]).join(numbers, ["key", "sha256"]).write.mode("errorifexists").parquet(path)
        back = self.spark.read.parquet(path)
        made = back.select(
            F.lit(batch).alias("batch"), "key", F.explode(F.col("versions").cast("array<long>")).alias("version"), "sha256", F.length("content").cast("long").alias("size"), "content_type", "immutable",
            F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), F.lit(source_hash).alias("source_hash"), F.lit(user).alias("user"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp_utc"),
        )
        # the commit: until these rows are there, the batch is not
        made.write.mode("append").parquet(f"{self.root}/lineage")
        return self.lineage().where(F.col("batch") == batch)

    def list_versions(self, key: str) -> DataFrame:
        """The versions of a key, oldest first; none of a key that is not there."""
        return self.lineage().where(F.col("key") == key).orderBy("version")

    def contents(self, wanted: DataFrame | None = None) -> DataFrame:
        """key, version, content of the wanted (key, version), where a null version is the latest; without `wanted`, the latest of every key."""
        log = self.lineage()
        latest = log.groupBy("key").agg(F.max_by(F.struct("version", "batch", "sha256"), "version").alias("s")).select("key", "s.*")
        if wanted is None:
            chosen = latest
        else:
            chosen = wanted.where("version IS NULL").select("key").join(latest, "key").unionByName(log.join(wanted.where("version IS NOT NULL").select("key", "version"), ["key", "version"]).select("key", "version", "batch", "sha256"))
        batches = [r["batch"] for r in chosen.select("batch").distinct().collect()]  # only the batches that are needed are read
        if not batches:
            return chosen.select("key", "version").withColumn("content", F.lit(None).cast("binary")).limit(0)
        data = None
        for b in batches:
            one = self.spark.read.parquet(f"{self.root}/batches/{b}").select(F.lit(b).alias("batch"), "key", "sha256", "content")
            data = one if data is None else data.unionByName(one)
        return chosen.join(data, ["batch", "key", "sha256"]).select("key", "version", "content")

    def get(self, key: str, version: int | None = None) -> bytes:
        """The bytes of a version, or of the latest; a missing one raises."""
        rows = self.contents(self.spark.createDataFrame([(key, version)], "key string, version long")).collect()
        if not rows:
            raise FileNotFoundError(f"{key}, version {version or 'latest'}")
        return bytes(rows[0]["content"])

    def damaged(self) -> DataFrame:
        """Versions whose bytes no longer have the hash that was logged, or are gone."""
        log = self.lineage()
        batches = [r["batch"] for r in log.select("batch").distinct().collect()]
        found = None
        for b in batches:
            one = self.spark.read.parquet(f"{self.root}/batches/{b}").select(F.lit(b).alias("batch"), "key", F.sha2("content", 256).alias("sha256"))
            found = one if found is None else found.unionByName(one)
        return log if found is None else log.join(found, ["batch", "key", "sha256"], "left_anti")

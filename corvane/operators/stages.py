"""Stages whose results are kept: committed under the hashes of their input and code, resumed after a kill; tables that are updated in place."""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corvane.operators.studies import _cut

COMMITS = "stage string, input string, code string, path string, rows long"


def input_hash(rows: DataFrame) -> str:
    """A hash of a table's columns, types and rows, in any order: row hashes are summed, so a changed, lost or repeated row shows."""
    own = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) for c in rows.columns)) if rows.columns else F.lit(0)
    found = rows.agg(F.count("*").alias("n"), F.sum(own.cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(own, F.lit(1)).cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256(f"{rows.schema.json()}|{found['n']}|{found['a']}|{found['b']}".encode()).hexdigest()


def code_hash(stage: Callable, **params) -> str:
    """A hash of a function's source and of its parameters."""
    return hashlib.sha256(f"{inspect.getsource(stage)}|{sorted(params.items())!r}".encode()).hexdigest()


class Stages:
    """Results of stages below a shared folder. A result counts once its row is in the log of commits."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMITS)

    def load(self, stage: str, source: str, code: str) -> DataFrame | None:
        """The committed result of a stage, or None."""
        found = self.commits().where((F.col("stage") == stage) & (F.col("input") == source) & (F.col("code") == code)).select("path").limit(1).collect()
        return self.spark.read.parquet(found[0]["path"]) if found else None

    def loaded(self, source: str) -> dict[str, DataFrame]:
        """All committed results of an input, by stage; of several by different code the one that was committed under the greatest path."""
        rows = self.commits().where(F.col("input") == source).groupBy("stage").agg(F.max("path").alias("path")).collect()
        return {r["stage"]: self.spark.read.parquet(r["path"]) for r in rows}

    def save(self, stage: str, source: str, code: str, rows: DataFrame) -> DataFrame:
        """Writes a result into a folder of its own and then commits it, so a killed writer leaves nothing that is read."""
        path = f"{self.root}/data/{stage}-{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(path)
        back = self.spark.read.parquet(path)
        commit = [(stage, source, code, path, back.count())]
        self.spark.createDataFrame(commit, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return back

    def run(self, stages: list[tuple[str, Callable[..., DataFrame]]], rows: DataFrame, **params) -> DataFrame:
        """Applies stages in order, each to the result before it. One that is committed under its input and code is read, not run.

        The input of the first is hashed by its rows; that of a later one is the hash of everything before it.
        """
        source = input_hash(rows)
        for name, stage in stages:
            code = code_hash(stage, **params)
            done = self.load(name, source, code)
            rows = done if done is not None else self.save(name, source, code, stage(rows, **params))
            source = hashlib.sha256(f"{source}|{name}|{code}".encode()).hexdigest()
        return rows


def create_keyed(rows: DataFrame, path: str, key: list[str], parts: int = 64) -> None:
    """A table in parts by a hash of its key, which `upsert` updates."""
    rows.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")).repartition("part").write.partitionBy("part").parquet(path)


def upsert(rows: DataFrame, path: str, key: list[str], order: str, parts: int = 64) -> int:
    """Puts rows into a keyed table: the row with the greatest `order` stays (ties: the new one). Only parts that a key falls into are read and written.

    Gives the number of parts that were written. The merged parts are made whole in the shared folder before they replace the old ones.
    """
    spark = rows.sparkSession
    new = _cut(rows.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")))
    touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most `parts`
    if not touched:
        return 0
    old = spark.read.parquet(path)
    both = old.where(F.col("part").isin(touched)).withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    # structs compare by order first; a null order is the least
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(order).isNotNull(), F.lit(False)).alias("known"), F.col(order), "new"))
    merged = _cut(both.groupBy(*key).agg(best.alias("s")).select(*key, "s.*").select(old.columns))
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return len(touched)

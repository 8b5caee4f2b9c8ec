"""Study designs: cell votes, stream merging, tables per page, epochs, tabulation datasets, shape graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cell_votes(cells: DataFrame, by: list[str], mark: str) -> DataFrame:
    """Majority of several methods on a cell: true only if more say so than not; confidence is the larger share."""
    yes = F.count(F.when(F.col(mark), 1))
    total = F.count("*")
    voted = cells.groupBy(*by).agg(yes.alias("yes"), total.alias("methods"))
    no = F.col("methods") - F.col("yes")
    return voted.select(*by, (F.col("yes") > no).alias("scheduled"), (F.greatest(F.col("yes"), no) / F.col("methods")).alias("confidence"), ((F.col("yes") > 0) & (no > 0)).alias("disputed"))


def merged_pairs(parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Union of streams by exact key: greatest confidence, +0.1 for every further occurrence, at most 0.95; its sources."""
    rows = None
    for name, df in parts.items():
        one = df.select(*key, "confidence", F.lit(name).alias("source"))
        rows = one if rows is None else rows.unionByName(one)
    out = rows.groupBy(*key).agg(F.max("confidence").alias("best"), F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))
    boosted = F.when(F.col("n") == 1, F.col("best")).otherwise(F.least(F.lit(0.95), F.col("best") + 0.1 * (F.col("n") - 1)))
    return out.select(*key, F.round(boosted, 4).alias("confidence"), F.array_join("sources", ",").alias("sources"), (F.size("sources") > 1).alias("multi_source"))


def one_table_per_page(tables: DataFrame, by: list[str], cells: str, order: list[str]) -> DataFrame:
    """The table with most cells on each page, the first on a tie."""
    return tables.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(cells), *order))).where("rank = 1").drop("rank")


def epochs(visits: DataFrame, study: str, kind: str, order: list[str], names: dict[str, str], default: str) -> DataFrame:
    """Epochs of a study, numbered by first appearance."""
    name = F.lit(default)
    for k, v in names.items():
        name = F.when(F.col(kind) == k, v).otherwise(name)
    first = visits.withColumn("epoch", name).withColumn("pos", F.row_number().over(Window.partitionBy(study).orderBy(*order))).groupBy(study, "epoch").agg(F.min("pos").alias("pos"), F.count("*").alias("visits"))
    return first.select(study, "epoch", "visits", F.row_number().over(Window.partitionBy(study).orderBy("pos")).cast("long").alias("number"))


def trial_visits(timepoints: DataFrame, study: str, order: list[str]) -> DataFrame:
    """TV rows: VISITNUM by order, the window as days before and after."""
    w = Window.partitionBy(study).orderBy(*order)
    return timepoints.select(F.col(study).cast("string").alias("STUDYID"), F.lit("TV").alias("DOMAIN"), F.row_number().over(w).cast("double").alias("VISITNUM"), F.col("name").alias("VISIT"), F.col("day").cast("double").alias("VISITDY"), (-F.col("before")).cast("double").alias("TVSTRL"), F.col("after").cast("double").alias("TVENRL"))


def trial_arms(arms: DataFrame, elements: DataFrame, study: str) -> DataFrame:
    """TA rows: every arm of a study with each of its elements in order."""
    return arms.join(elements, study).select(F.col(study).cast("string").alias("STUDYID"), F.lit("TA").alias("DOMAIN"), F.col("armcd").alias("ARMCD"), F.col("pos").cast("double").alias("TAETORD"), F.col("etcd").alias("ETCD"))


def parameters(rows: DataFrame, study: str, values: dict[str, Column]) -> DataFrame:
    """TS rows of the values that are there, numbered in the given order."""
    array = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("TSPARMCD"), v.cast("string").alias("TSVAL")) for i, (k, v) in enumerate(values.items())))
    kept = F.filter(array, lambda s: s["TSVAL"].isNotNull() & (F.trim(s["TSVAL"]) != ""))
    return rows.select(F.col(study).cast("string").alias("STUDYID"), F.lit("TS").alias("DOMAIN"), F.posexplode(kept).alias("at", "s")).select("STUDYID", "DOMAIN", (F.col("at") + 1).cast("double").alias("TSSEQ"), "s.TSPARMCD", "s.TSVAL")


def normalised_terms(values: DataFrame, value: str, terms: dict[str, str]) -> DataFrame:
    """Exact upper-case lookup, else the first term that the value begins with; the rest is for review."""
    key = F.upper(F.trim(value))
    exact, prefix = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, v in reversed(terms.items()):
        exact = F.when(key == k, v).otherwise(exact)
        prefix = F.when(key.startswith(k), v).otherwise(prefix)
    return values.withColumn("term", F.coalesce(exact, prefix)).withColumn("review", F.col("term").isNull())


def hash_draw(key: Column, seed: int, n: int) -> Column:
    """A repeatable whole number from 0 to n - 1 for a key: the leading 32 bits of an MD5."""
    return F.pmod(F.conv(F.left(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), F.lit(8)), 16, 10).cast("long"), F.lit(n))


def synthetic_subjects(studies: DataFrame, study: str, n: int, seed: int) -> DataFrame:
    """DM rows: n subjects of each study with drawn age, sex and arm."""
    rows = studies.select(F.col(study).cast("string").alias("STUDYID"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    subject = F.concat_ws("-", "STUDYID", F.lpad(F.col("k").cast("string"), 4, "0"))
    return rows.select("STUDYID", F.lit("DM").alias("DOMAIN"), subject.alias("USUBJID")).select("*", (hash_draw(F.col("USUBJID"), seed, 60) + 18).alias("AGE"), F.element_at(F.array(F.lit("F"), F.lit("M")), (hash_draw(F.col("USUBJID"), seed + 1, 2) + 1).cast("int")).alias("SEX"))


def shape_components(edges: DataFrame) -> DataFrame:
    """Components of graphs (page, a, b), one per page: each node's label is the smallest node that it reaches.

    By alternating large and small stars, so rounds grow with the logarithm of a path's length; lineage is cut every round.
    """
    links = _cut(edges.select("page", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = links.select("page", F.explode(F.array("u", "v")).alias("a")).distinct()
    links, sign = links.where("u <> v"), None
    while True:
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("page", "u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == sign or not now["n"]:
            break
        sign = (now["n"], now["h"])
        both = links.unionByName(links.select("page", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("page", "u").agg(F.min("v").alias("m")).select("page", "u", F.least("u", "m").alias("m"))
        large = both.join(least, ["page", "u"]).where("v > u").select("page", F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(large.groupBy("page", "u").agg(F.min("v").alias("m")), ["page", "u"])
        links = _cut(small.select("page", "u", F.col("m").alias("v")).unionByName(small.where("v <> m").select("page", F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
    return nodes.join(links.select("page", F.col("u").alias("a"), F.col("v").alias("label")), ["page", "a"], "left").withColumn("label", F.coalesce("label", "a"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    import uuid

    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only on one machine, where none is named, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    """Lineage is cut in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)

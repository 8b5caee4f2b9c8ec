"""Connected components, and components of candidates that meet in buckets, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import store

#: Pivots of a bucket in each round; the last number holds for all further rounds.
PIVOTS = (1, 8, 64, 512)


def connected(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in links (a, b), by alternating large and small stars.

    A star step only groups by a node and joins the minimum back, so no neighbourhood is collected.
    """
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    sign = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == sign or not now["n"]:  # nothing moved
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        sign = (now["n"], now["h"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, F.col("u") == F.col("c"))
        edges = store(small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """id, component after more links (a, b). Links are first put on the components that are known, so one of many is enough."""
    if labels is None:
        return store(connected(links))
    for side in ("a", "b"):
        known = labels.select(F.col("id").alias(side), F.col("component").alias("c"))
        links = links.join(known, side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
    new = store(connected(links.select("a", "b").distinct()))
    moved = new.select(F.col("id").alias("component"), F.col("component").alias("to"))
    old = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return store(old.unionByName(new.join(labels.select("id"), "id", "left_anti")))


def with_component(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds `cid`: the component of `id`, or the id itself where it has none yet."""
    if labels is None:
        return rows.withColumn("cid", F.col("id"))
    return rows.join(labels, "id", "left").withColumn("cid", F.coalesce("component", "id")).drop("component")


def shared(members: DataFrame) -> DataFrame:
    """The members (key, id) of buckets that two or more are in, with the `degree` of each id: how many it meets, over all its buckets.

    Keys are counted before the exchange, and members meet the counts by a join, which is split where a key is hot.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = store(members.join(sizes, "key"))
    degree = rows.groupBy("id").agg(F.sum("size").alias("degree"))
    return store(rows.drop("size").join(degree, "id"))


def bucket_components(rows: DataFrame, verify: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame] | None = None, pivots: tuple[int, ...] = PIVOTS, quick: Callable[[Column, Column], Column] | None = None) -> DataFrame | None:
    """id, component by all true links between members of a bucket; None if there is no link. rows: key, id, degree.

    In a round each member is held against a few pivots of its buckets, those of the greatest degree, by `verify`, which gives
    the true ones of pairs (id, pivot). Pivots then leave the bucket, since all their pairs are known, and so does every bucket
    whose other members lie in one component. Rounds go on, each with more pivots, until no bucket is left; or after the rounds of
    `pivots` `finish` makes the pairs of all that is left. With `quick` rows have a `mark` too,
    and pairs whose marks it refuses are no links.
    """

    def linked(pairs: DataFrame) -> DataFrame:
        return store(verify(store(pairs.select("id", "pivot").distinct())).select(F.col("id").alias("a"), F.col("pivot").alias("b")))

    labels, turn = None, 0
    marks = ["mark"] if quick else []
    now = rows.select("key", "id", "degree", *marks, F.col("id").alias("cid"))
    while True:
        last = turn >= len(pivots) and finish is not None
        if last:
            found = linked(finish(now))
        else:
            order = Window.partitionBy("key").orderBy(F.desc("degree"), F.xxhash64(F.lit(turn), "id"), "id")
            first = store(now.select("key", F.col("id").alias("pivot"), F.col("cid").alias("pivot_cid"), *(F.col(m).alias("pivot_mark") for m in marks), F.row_number().over(order).alias("rank")).where(F.col("rank") <= pivots[min(turn, len(pivots) - 1)]).drop("rank"))
            near = F.col("key") == F.col("pivot_key")
            if quick:
                near = near & quick(F.col("mark"), F.col("pivot_mark"))
            found = linked(now.join(first.withColumnRenamed("key", "pivot_key"), near & (F.col("cid") != F.col("pivot_cid"))))
        if not found.isEmpty():
            labels = merged(labels, found)
        if last:
            return labels
        rest = with_component(now.drop("cid").join(first.select("key", F.col("pivot").alias("id")), ["key", "id"], "left_anti"), labels)
        open_ = rest.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low != high").select("key")
        now = store(rest.join(open_, "key", "left_semi"))
        if now.isEmpty():
            return labels
        turn += 1

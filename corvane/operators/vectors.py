"""Centroids, indexes of sections, label propagation. Vectors are an input column of arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vector import dot, unit
from corvane.operators.joins import broadcast_if_small
from corvane.operators.neighbour_index import Index, neighbours  # noqa: F401


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean of unit vectors per label, scaled to length 1. Coordinates are averaged as rows, so sums combine before the exchange."""
    parts = rows.select(label, F.posexplode(unit(vector)).alias("at", "x")).groupBy(label, "at").agg(F.avg("x").alias("x"))
    mean = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))
    return mean.select(label, unit("mean").alias("centroid"))


def label_similarity(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """same, pairs, mean: mean inner product over all pairs of one label, and over all pairs of two.

    The sum over pairs is half of the squared length of the sum of vectors less the sum of squared lengths, so no pair is made.
    """
    flat = rows.select(F.col(label).alias("label"), F.posexplode(vector).alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    sums = flat.groupBy("label", "at").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("own"))
    per_label = sums.groupBy("label").agg(F.sum(F.col("x") * F.col("x") - F.col("own")).alias("twice"))
    all_ = sums.groupBy("at").agg(F.sum("x").alias("x"), F.sum("own").alias("own")).agg(F.sum(F.col("x") * F.col("x") - F.col("own")).alias("all_twice"))
    n = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    # one row a label, then one row
    one = per_label.join(n, "label").agg(F.sum("twice").alias("twice"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.sum("n").alias("n"))
    both = one.crossJoin(F.broadcast(all_)).withColumn("all_pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    cases = F.array(F.struct(F.lit(True).alias("same"), F.col("pairs").alias("pairs"), F.col("twice").alias("twice")), F.struct(F.lit(False).alias("same"), (F.col("all_pairs") - F.col("pairs")).alias("pairs"), (F.col("all_twice") - F.col("twice")).alias("twice")))
    return both.select(F.inline(cases)).where("pairs > 0").select("same", "pairs", (F.col("twice") / 2 / F.col("pairs")).alias("mean"))


#: Columns of an index of sections beside key and vector.
INDEX = ("section_code", "confidence_score", "source")


def indexable(sections: DataFrame, key: str, vector: str, min_confidence: float = 0.0) -> DataFrame:
    """What goes into an index of sections: those with a vector, scaled to length 1, and enough confidence."""
    kept = sections.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.coalesce("confidence_score", F.lit(0.0)) >= min_confidence))
    return kept.select(key, unit(vector).alias(vector), *INDEX)


def search_sections(index: Index, queries: DataFrame, key: str, vector: str, k: int = 5, exact: bool = False) -> DataFrame:
    """query, idx, similarity, rank and the metadata: the k entries of the greatest cosine; a query's own key is left out."""
    near = index.search(queries.select(key, unit(vector).alias(vector)), key, vector, k, exact)
    return near.join(index.entries.select("idx", *INDEX), F.col("neighbour") == F.col("idx")).select(F.col("target").alias("query"), "idx", "similarity", "rank", *INDEX)


def nearest_centroids(rows: DataFrame, centres: DataFrame, key: str, vector: str, label: str, k: int) -> DataFrame:
    """For each label the k rows nearest to its centroid with a positive similarity. There is a centroid a label, so they are few."""
    pairs = rows.select(key, vector).crossJoin(broadcast_if_small(centres.select(F.col(label).alias("code"), "centroid"))).select(key, "code", dot(vector, "centroid").alias("similarity")).where("similarity > 0")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("similarity"), key))).where(F.col("rank") <= k)


def propagate(near: DataFrame, labels: DataFrame, key: str, label: str, confidence: str, least: float) -> DataFrame:
    """One hop: the label with most labelled neighbours (ties: the most similar first); confidence of the best one times its similarity."""
    known = labels.select(F.col(key).alias("neighbour"), F.col(label).alias("label"), F.col(confidence).alias("c"))
    votes = near.join(known, "neighbour").groupBy("target", "label").agg(F.count("*").alias("votes"), F.max(F.struct("similarity", -F.col("neighbour"), F.col("c").alias("c"))).alias("best"))
    ranked = votes.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("votes"), F.desc("best.similarity"), "label"))).where("k = 1")
    return ranked.select(F.col("target").alias(key), F.col("label").alias(label), (F.col("best.c") * F.col("best.similarity")).alias(confidence), "votes").where(F.col(confidence) >= least)

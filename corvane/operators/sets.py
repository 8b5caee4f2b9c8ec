"""Set operations with a defined order: first wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in a stated order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rank = 1").drop("rank")


def jaccard(a: Column | str, b: Column | str, both_empty: float = 1.0) -> Column:
    """Share of common elements; what two empty sets give is stated."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def near_duplicates_removed(new: DataFrame, old: DataFrame, url: str, title: str, threshold: float = 0.8) -> DataFrame:
    """New rows whose URL is not known and whose title words are not nearly those of an old title.

    Of two sets above the threshold each has one of its rarest words in common with the other: those that are left when as many words as
    must agree are taken from the frequent end. So titles meet by these words only, and no frequent word is a hot key.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))
    rest = new.join(old.select(url).where(F.col(url).isNotNull()), url, "left_anti").withColumn("__w", words(title))
    sides = rest.select("__w").unionByName(old.select(words(title).alias("__w"))).where(F.size("__w") > 0).distinct()
    each = sides.select("__w", F.explode("__w").alias("__k"))
    often = each.groupBy("__k").agg(F.count("*").alias("__n"))
    ranked = each.join(often, "__k").groupBy("__w").agg(F.array_sort(F.collect_list(F.struct("__n", "__k"))).alias("__s"))
    rare = ranked.select("__w", F.explode(F.slice("__s", F.lit(1), F.size("__s") - F.ceil(F.size("__s") * threshold).cast("int") + 1)).alias("__x")).select("__w", F.col("__x.__k").alias("__k"))
    a = rare.join(rest.select("__w").distinct(), "__w", "left_semi")
    b = rare.join(old.select(words(title).alias("__w")).distinct(), "__w", "left_semi").select(F.col("__w").alias("__o"), "__k")
    near = a.join(b, "__k").where(jaccard("__w", "__o") > threshold).select("__w").distinct()
    return rest.join(near, "__w", "left_anti").drop("__w")

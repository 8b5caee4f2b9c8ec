"""Vector expressions; floats are widened before they are multiplied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column | str) -> Column:
    """Divided by its length; a zero vector stays."""
    length = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def composite(embed: Column, keyword: Column, judge: Column) -> Column:
    """.45 embedding + .15 keyword + .40 judge; without a judge (negative) .65 and .35. Within 0 and 1, four places."""
    with_judge = 0.45 * embed + 0.15 * keyword + 0.40 * judge
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(judge < 0, 0.65 * embed + 0.35 * keyword).otherwise(with_judge))), 4)


def tier(score: Column, auto: float = 0.75, review: float = 0.50) -> Column:
    return F.when(score >= auto, "HIGH").when(score >= review, "REVIEW").otherwise("LOW")

"""Ordered and positional operators: schedules, sequences, spans, packing, hash chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lead_overlaps(visits: DataFrame, study: str, day: str, early: str, late: str, ties: list[str]) -> DataFrame:
    """Adjacent visits whose windows overlap: this day + late reaches beyond the next day + early."""
    w = Window.partitionBy(study).orderBy(day, *ties)
    rows = visits.where(F.col(day).isNotNull()).withColumn("next_day", F.lead(day).over(w)).withColumn("next_early", F.lead(early).over(w))
    overlap = F.col(day) + F.col(late) - (F.col("next_day") + F.col("next_early"))
    return rows.withColumn("overlap", overlap).where("overlap > 0")


def wide_windows(visits: DataFrame, study: str, day: str, early: str, late: str, ties: list[str], share: float = 0.5) -> DataFrame:
    """Visits whose window is wider than a share of the interval to the next; intervals of 0 or less are skipped."""
    w = Window.partitionBy(study).orderBy(day, *ties)
    rows = visits.where(F.col(day).isNotNull()).withColumn("interval", F.lead(day).over(w) - F.col(day)).withColumn("width", F.col(late) - F.col(early))
    return rows.where((F.col("interval") > 0) & (F.col("width") > share * F.col("interval")))


def first_rank_drop(visits: DataFrame, study: str, order: list[str], rank: str) -> DataFrame:
    """The first row of a study whose rank is below the greatest before it."""
    w = Window.partitionBy(study).orderBy(*order)
    rows = visits.withColumn("before", F.max(rank).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.where(F.col(rank) < F.col("before")).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def dense_periods(visits: DataFrame, study: str, day: str, span: int = 28, most: int = 20) -> DataFrame:
    """The first day of a study from which more than `most` visits follow within `span` days."""
    w = Window.partitionBy(study).orderBy(day).rangeBetween(0, span)
    rows = visits.where(F.col(day).isNotNull()).select(study, day, F.count("*").over(w).alias("n")).where(F.col("n") > most)
    return rows.groupBy(study).agg(F.min(F.struct(day, "n")).alias("s")).select(study, F.col(f"s.{day}").alias(day), F.col("s.n").alias("n"))


def repeats(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Second and later occurrences of a key."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("occurrence > 1")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Sequence numbers from 1 within a subject."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def top_k(rows: DataFrame, by: list[str], score: str, k: int, ties: list[str]) -> DataFrame:
    """The k best rows of a group with a positive score."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return rows.where(F.col(score) > 0).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tiered_top_k(rows: DataFrame, by: list[str], score: str, ties: list[str], auto: float = 0.75, review: float = 0.50) -> DataFrame:
    """All candidates of `auto` or more if the best is so; the best three if it reaches `review`; else the best one."""
    w = Window.partitionBy(*by)
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), *ties))).withColumn("best", F.max(score).over(w))
    tier = F.when(F.col("best") >= auto, "HIGH").when(F.col("best") >= review, "REVIEW").otherwise("LOW")
    keep = F.when(tier == "HIGH", F.col(score) >= auto).when(tier == "REVIEW", F.col("rank") <= 3).otherwise(F.col("rank") == 1)
    return rows.withColumn("tier", tier).where(keep).drop("best")


def spans(heads: DataFrame, doc: str, offset: str, length: str) -> DataFrame:
    """From each header's offset up to the next one's, the last up to the end of the text."""
    end = F.coalesce(F.lead(offset).over(Window.partitionBy(doc).orderBy(offset)), F.col(length))
    return heads.withColumn("span_end", end).withColumn("span_chars", F.col("span_end") - F.col(offset))


def without_overlaps(spans: Column) -> Column:
    """Of an array of structs (start, end, ...) sorted by start: those that start at or after the end of the last one kept."""
    fold = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(-1).cast("long").alias("end"), F.slice(spans, 1, 0).alias("kept")),
        lambda a, s: F.when(s["start"] >= a["end"], F.struct(s["end"].cast("long").alias("end"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a),
    )
    return fold["kept"]


def gaps_between(rows: DataFrame, doc: str, start: str, end: str, length: str) -> DataFrame:
    """What kept spans leave uncovered, between them and at the tail."""
    w = Window.partitionBy(doc).orderBy(start)
    rows = rows.withColumn("gap_start", F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    inner = rows.select(doc, "gap_start", F.col(start).cast("long").alias("gap_end"))
    tail = rows.groupBy(doc).agg(F.max(end).cast("long").alias("gap_start"), F.max(length).cast("long").alias("gap_end"))
    return inner.unionByName(tail).where("gap_end > gap_start")


def sessions(rows: DataFrame, by: str, order: list[str], starts_new: Column) -> DataFrame:
    """A running group number: a row that `starts_new` (null at the first row) opens the next group."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("new_group", F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(starts_new.cast("int"), F.lit(1)))).withColumn("group_no", F.sum("new_group").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def packed(items: Column, limit: int, separator: str = " ") -> Column:
    """Strings put together in order into chunks of at most `limit` characters; a longer one stands alone."""
    joined = lambda a, x: F.concat(a["now"], F.lit(separator), x)
    fold = F.aggregate(
        items,
        F.struct(F.lit("").alias("now"), F.slice(F.array(F.lit("")), 1, 0).alias("done")),
        lambda a, x: F.when(a["now"] == "", F.struct(x.alias("now"), a["done"].alias("done")))
        .when(F.length(joined(a, x)) <= limit, F.struct(joined(a, x).alias("now"), a["done"].alias("done")))
        .otherwise(F.struct(x.alias("now"), F.concat(a["done"], F.array(a["now"])).alias("done"))),
        lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))),
    )
    return fold


def sliding(items: Column, length: int) -> Column:
    """Windows of length - 2 elements, each starting length / 2 after the one before; short arrays give one window."""
    size, stride = length - 2, length // 2
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(items)), F.lit(stride))
    return F.transform(starts, lambda s: F.slice(items, s, size))


def within_budget(rows: DataFrame, doc: str, score: str, position: str, size: str, budget: int) -> DataFrame:
    """Best rows first while their summed sizes fit; the first that does not fit ends it. One row stays always."""
    w = Window.partitionBy(doc).orderBy(F.desc(score), position)
    rows = rows.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(w))
    return rows.where((F.col("used") <= budget) | (F.col("k") == 1)).drop("k")


def capped(rows: Column, most: int, budget: int) -> Column:
    """Of an array of structs (pos, chars, rank): those kept in order, skipping what no longer fits; the worst rank of the kept."""
    return F.aggregate(
        F.array_sort(rows),
        F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"), F.lit(99).alias("worst")),
        lambda a, s: F.when((a["n"] < most) & (a["chars"] + s["chars"] <= budget), F.struct((a["n"] + 1).alias("n"), (a["chars"] + s["chars"]).cast("long").alias("chars"), F.least(a["worst"], s["rank"]).cast("int").alias("worst"))).otherwise(a),
    )


def milestones(rows: DataFrame, doc: str, label: str, day: str, cycle: str) -> DataFrame:
    """Days of relative visits: the end is the greatest day + 1, follow-up + 30, a repeat + its cycle; 1 where no day is positive."""
    top = F.coalesce(F.max(F.when(F.col(day) > 0, F.col(day))).over(Window.partitionBy(doc)), F.lit(1))
    filled = F.when(F.col(label) == "EOT", top + 1).when(F.col(label) == "FU", top + 30).when(F.col(label) == "REPEAT", top + F.col(cycle)).otherwise(F.col(day))
    return rows.withColumn("filled_day", filled)


def anchored(rows: DataFrame, doc: str, kind: str, day: str) -> DataFrame:
    """Days counted from the first screening day, or from the first day of all."""
    w = Window.partitionBy(doc)
    first = F.coalesce(F.min(F.when(F.col(kind) == "screening", F.col(day))).over(w), F.min(day).over(w))
    return rows.withColumn("anchored_day", F.col(day) - first)


def chain(rows: DataFrame, run: str, order: str, source: str, artifact: str) -> DataFrame:
    """Per run: stages verified before the first whose source is not the artifact before it, and where that is."""
    before = F.lag(artifact).over(Window.partitionBy(run).orderBy(order))
    broken = rows.select(run, order, (before.isNotNull() & (F.col(source) != before)).alias("broken"))
    ends = broken.groupBy(run).agg(F.count("*").alias("stages"), F.min(F.when(F.col("broken"), F.col(order))).alias("first_break"))
    counted = broken.join(ends, run).groupBy(run).agg(F.count(F.when(F.col("first_break").isNull() | (F.col(order) < F.col("first_break")), 1)).alias("verified"), F.max("first_break").alias("first_break"), F.max("stages").alias("stages"))
    return counted


def consecutive_breaks(rows: DataFrame, by: str, seq: str) -> DataFrame:
    """Rows whose number is not their place in the order."""
    w = Window.partitionBy(by).orderBy(seq)
    return rows.select(by, seq, F.row_number().over(w).cast("long").alias("expected")).where(F.col(seq) != F.col("expected"))


def neighbours(rows: DataFrame, by: str, order: list[str], key: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))

"""Order hints for close calls: a header's second candidate gains if it fits between the neighbours and the first does not.

The rule goes through a document in order, and the header before counts as already adjusted. All that one header tells the next is
whether its second candidate has overtaken the first: a single bit. So each header is a function of that bit (always no, always yes, the same,
the opposite), and functions compose in any grouping. Rows are dealt out in ranges of document and position, each range
is composed by running windows, the ranges by a table of a row each. A document that holds a third of all rows spans many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.studies import _cut


def _bits(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds `base` and `odd`: the bit after each row is `base` if set, else the bit before the first row, and the opposite where `odd`.

    rows: off and on, the bit after the row by the bit before it.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("turns", F.sum((F.col("off") & ~F.col("on")).cast("long")).over(w))
    last = F.last(F.when(F.col("off") == F.col("on"), F.struct(F.col("off").alias("bit"), F.col("turns").alias("turns"))), ignorenulls=True).over(w)
    rows = rows.withColumn("fixed", last)
    return rows.select("*", F.col("fixed.bit").alias("base"), ((F.col("turns") - F.coalesce("fixed.turns", F.lit(0))) % 2 == 1).alias("odd")).drop("turns", "fixed")


def _after(before: Column) -> Column:
    return F.coalesce("base", before) != F.col("odd")


def order_hints(headers: DataFrame, doc: str, pos: str, scores: str, eligible: Column | None = None, auto: float = 0.75, review: float = 0.50, delta: float = 0.10, gain: float = 0.06) -> DataFrame:
    """The headers with `boosted` (whether the second candidate gained), `chosen` (the ordinal of the best score then) and adjusted scores.

    A header is a close call if its best score is at least `review` and below `auto` and the second one is at most `delta` behind. A
    candidate fits if its ordinal lies strictly between the ordinals chosen before and after it, at an end of the document beyond the one there
    is; the header after counts by its unadjusted scores. Of equal scores the smaller ordinal comes first. `eligible`: only documents with a
    table of contents. Headers without scores choose nothing, and are no neighbours that others must fit to. Positions are distinct in a document.
    """
    names = headers.columns
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    one, two = F.get(F.col("ranked"), F.lit(0)), F.get(F.col("ranked"), F.lit(1))
    rows = headers.select(F.struct(*names).alias("row"), F.col(doc).alias("doc"), F.col(pos).alias("pos"), ranked.alias("ranked"), (F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))).alias("eligible"))
    rows = rows.select("row", "doc", "pos", "eligible", one["i"].alias("first"), two["i"].alias("second"), (-one["x"]).alias("s1"), (-two["x"]).alias("s2"))
    close = F.col("eligible") & (F.col("s1") < auto) & (F.col("s1") >= review) & (F.col("s1") - F.col("s2") <= delta)
    raised = F.least(F.lit(1.0), F.col("s2") + gain)
    overtakes = (raised > F.col("s1")) | ((raised == F.col("s1")) & (F.col("second") < F.col("first")))
    rows = rows.select("row", "doc", "pos", "first", "second", F.coalesce(close, F.lit(False)).alias("close"), F.coalesce(overtakes, F.lit(False)).alias("overtakes"))
    # ranges are fixed here, so that every pass sees the same
    rows = _cut(rows.repartitionByRange("doc", "pos").withColumn("part", F.spark_partition_id()))

    inside = Window.partitionBy("part").orderBy("doc", "pos")
    place = F.struct("doc", "pos")
    ends = rows.groupBy("part").agg(F.min_by(F.struct("doc", "first"), place).alias("head"), F.max_by(F.struct("doc", "first", "second"), place).alias("tail"))
    # a row a range
    parts = Window.orderBy("part")
    ends = F.broadcast(ends.select("part", F.lag("tail").over(parts).alias("tail"), F.lead("head").over(parts).alias("head")))
    rows = rows.join(ends, "part")
    rows = rows.withColumn("before", F.coalesce(F.lag(F.struct("doc", "first", "second")).over(inside), "tail")).withColumn("after", F.coalesce(F.lead(F.struct("doc", "first")).over(inside), "head")).drop("tail", "head")

    follows = F.col("before.doc").eqNullSafe(F.col("doc")) & F.col("before").isNotNull()
    after = F.when(F.col("after.doc").eqNullSafe(F.col("doc")) & F.col("after").isNotNull(), F.col("after.first"))

    def gains(before: Column) -> Column:
        fits = lambda x: F.coalesce(F.col(x) > before, F.lit(True)) & F.coalesce(F.col(x) < after, F.lit(True))
        return F.col("close") & (before.isNotNull() | after.isNotNull()) & fits("second") & ~fits("first")

    rows = rows.withColumn("if_first", gains(F.when(follows, F.col("before.first")))).withColumn("if_second", gains(F.when(follows, F.col("before.second"))))
    # where a document begins both are the same, so no bit passes from one to the next
    rows = rows.withColumn("off", F.col("if_first") & F.col("overtakes")).withColumn("on", F.col("if_second") & F.col("overtakes"))
    rows = _cut(_bits(rows.drop("before", "after"), ["part"], ["doc", "pos"]))

    whole = rows.groupBy("part").agg(F.max_by(F.struct("base", "odd"), place).alias("of"))
    # a range as a function of one bit, and the ranges composed: a row a range again
    whole = _bits(whole.select("part", (F.coalesce("of.base", F.lit(False)) != F.col("of.odd")).alias("off"), (F.coalesce("of.base", F.lit(True)) != F.col("of.odd")).alias("on")), [], ["part"])
    carried = F.broadcast(whole.select("part", F.coalesce(F.lag(_after(F.lit(False))).over(parts), F.lit(False)).alias("carried")))
    rows = rows.join(carried, "part").withColumn("overtaken", _after(F.col("carried")))
    rows = rows.withColumn("bit", F.coalesce(F.lag("overtaken").over(inside), "carried"))
    boosted = F.when(F.col("bit"), F.col("if_second")).otherwise(F.col("if_first"))
    adjusted = F.when(boosted, F.transform(F.col("row")[scores], lambda x, i: F.when(i == F.col("second"), F.least(F.lit(1.0), x + gain)).otherwise(x))).otherwise(F.col("row")[scores])
    kept = [adjusted.alias(n) if n == scores else F.col("row")[n].alias(n) for n in names]
    return rows.select(*kept, boosted.alias("boosted"), F.when(F.col("overtaken"), F.col("second")).otherwise(F.col("first")).alias("chosen"))

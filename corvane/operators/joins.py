"""Joins whose strategy depends on a checked size, ranges and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import bound
from corvane.operators.studies import _cut

#: Rows up to which a dimension is broadcast.
SMALL_ROWS = 50_000
#: Values of a list that is joined as one row.
LIST = 1_024
#: Needles that are tried on every text.
FEW_NEEDLES = 32


def broadcast_if_small(dim: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The broadcast hint for a dimension of counted size, else the table as it is."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows that are small and whose work is not, over enough tasks, by the given columns or evenly; Spark does not put these parts together."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def listed(rows: DataFrame, dim: DataFrame, key: str, value: str, size: int = LIST, dealt_out: bool = False) -> DataFrame:
    """Rows with each value that the dimension has for their key, for keys of many values on both sides.

    Values meet the rows as lists of some `size`, so few rows are moved or broadcast; each pair is made last and goes on without being kept.
    Rows that are `dealt_out` over enough tasks stay there.
    """
    part, values = (next(n for i in range(len(rows.columns) + 1) if (n := f"{name}{i}") not in rows.columns) for name in ("part", "values"))
    counts = dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / size).alias(part))
    dealt = dim.select(key, F.struct(value).alias(values)).join(broadcast_if_small(counts), key).withColumn(part, F.pmod(F.xxhash64(values), part))
    lists = dealt.groupBy(key, part).agg(F.collect_list(values).alias(values)).drop(part)
    # few rows become many, so they are dealt over as many tasks as work asks for, not as their own size does
    return (rows if dealt_out else spread(rows)).join(broadcast_if_small(lists, SMALL_ROWS // 50), key).select(*rows.columns, F.inline(values))


def scheduled_grid(instances: DataFrame, timepoints: DataFrame, activities: DataFrame) -> DataFrame:
    """Scheduled instances with their timepoint and activity; unmatched ones drop."""
    return instances.where("scheduled").join(broadcast_if_small(timepoints), "timepoint_id").join(broadcast_if_small(activities), "activity_id")


def remapped(instances: DataFrame, timepoints: DataFrame, by: list[str]) -> DataFrame:
    """Instances of equal timepoints under the first one's id, each pair once."""
    first = timepoints.withColumn("kept_id", F.first_value("timepoint_id").over(Window.partitionBy(*by).orderBy("pos", "timepoint_id"))).select("timepoint_id", "kept_id")
    return instances.join(broadcast_if_small(first), "timepoint_id").select("activity_id", F.col("kept_id").alias("timepoint_id")).distinct()


def diff(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Added and removed keys, and each changed field with both values; two nulls are no change."""
    a = before.select(*key, *(F.col(f).cast("string").alias(f"{f}_a") for f in fields), F.lit(True).alias("in_a"))
    b = after.select(*key, *(F.col(f).cast("string").alias(f"{f}_b") for f in fields), F.lit(True).alias("in_b"))
    both = a.join(b, key, "full_outer")
    kind = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("changed")
    parts = ", ".join(f"'{f}', `{f}_a`, `{f}_b`" for f in fields)
    rows = both.select(*key, kind.alias("change"), F.expr(f"stack({len(fields)}, {parts}) AS (field, before, after)"))
    changed = rows.where("change = 'changed' AND NOT (before <=> after)")
    whole = both.where("in_a IS NULL OR in_b IS NULL").select(*key, kind.alias("change"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    return changed.unionByName(whole)


def routed(queries: DataFrame, routes: list[DataFrame], key: str) -> DataFrame:
    """The first route that a query has; routes hold key, section, similarity and come in priority order."""
    out = queries
    for i, r in enumerate(routes):
        out = out.join(r.select(key, F.struct("section", "similarity", F.lit(i).alias("level")).alias(f"r{i}")), key, "left")
    full = F.struct(F.lit("full text").alias("section"), F.lit(0.0).alias("similarity"), F.lit(len(routes)).alias("level"))
    return out.withColumn("route", F.coalesce(*(f"r{i}" for i in range(len(routes))), full)).select(*queries.columns, "route.section", "route.similarity", "route.level")


def containing(texts: DataFrame, needles: DataFrame, text: str, needle: str, rows: int = FEW_NEEDLES) -> DataFrame:
    """Texts with each needle that they contain; both in single spaces.

    A counted few needles are tried on every text. More meet the texts by words in a row: a needle's second to fourth word stand whole in
    any text that contains it. Texts send hashes of their words in a row only, under two hashes of their own, and what met is joined back.
    Needles without that many words are few, as there are few such strings, and are tried on every text.
    """
    if needles.limit(rows + 1).count() <= rows:
        return texts.join(F.broadcast(needles), F.contains(F.col(text), F.col(needle)))
    key, own = (next(n for i in range(len(texts.columns + needles.columns) + 1) if (n := f"{name}{i}") not in texts.columns + needles.columns) for name in ("key", "own"))
    words = F.split(F.col(needle), " ")
    long = needles.where(F.size(words) >= 5).withColumn(key, F.xxhash64(*(F.get(words, F.lit(i)) for i in (1, 2, 3))))
    marked = texts.withColumn(own, F.struct(F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))))
    windows = bound(F.split(F.col(text), " "), lambda w: F.array_distinct(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))))
    # found in a pass of its own, since it is counted and then joined
    met = _cut(marked.select(own, F.explode(windows).alias(key)).join(broadcast_if_small(long), key).drop(key).distinct())
    found = marked.join(broadcast_if_small(met), own).drop(own)
    short = texts.crossJoin(broadcast_if_small(needles.where(F.size(words) < 5)))
    return found.unionByName(short).where(F.contains(F.col(text), F.col(needle)))


def occurring(needles: DataFrame, needle: str, texts: DataFrame, text: str, letters: int = 20) -> DataFrame:
    """The distinct needles that occur in a text. Needles have at least `letters` characters: their first ones are met by those of all places of the texts."""
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - letters + 1, F.lit(1))), lambda i: F.xxhash64(F.col(text).substr(i, F.lit(letters))))
    heads = texts.select(F.col(text).alias("text"), F.explode(F.array_distinct(places)).alias("head"))
    asked = needles.select(F.col(needle).alias("needle")).distinct().withColumn("head", F.xxhash64(F.col("needle").substr(1, letters)))
    # texts meet the needles without their letters first, so a place that no needle begins at sends a number only
    wanted = heads.join(asked.select("head").distinct(), "head", "left_semi")
    return asked.join(wanted, "head").where(F.contains("text", "needle")).select(F.col("needle").alias(needle)).distinct()


def fidelity(outputs: DataFrame, key: str, sentences: str, originals: DataFrame, text: str, least: int = 20, head: int = 60) -> DataFrame:
    """key, fidelity: the share of an output's characters that lie in sentences whose beginning occurs in an original; 1.0 of nothing to check.

    outputs: one row a key, with an array of normalised sentences; shorter ones than `least` do not count.
    """
    said = outputs.select(F.col(key).alias("key"), F.explode(F.filter(sentences, lambda x: F.length(x) >= least)).alias("said")).withColumn("head", F.left("said", F.lit(head)))
    held = occurring(said, "head", originals, text, least).withColumn("held", F.lit(True))
    share = said.join(held, "head", "left").groupBy("key").agg((F.coalesce(F.sum(F.when(F.col("held"), F.length("said"))), F.lit(0)) / F.sum(F.length("said"))).alias("fidelity"))
    return outputs.select(F.col(key).alias("key")).join(share, "key", "left").select(F.col("key").alias(key), F.coalesce("fidelity", F.lit(1.0)).alias("fidelity"))


def looked_up(rows: DataFrame, terms: DataFrame, key: str, term: str, default: str) -> DataFrame:
    """Rows with the term of their key, or the default. terms: one row a key."""
    return rows.join(broadcast_if_small(terms), key, "left").withColumn(term, F.coalesce(term, F.lit(default)))


def amendment(before: DataFrame, after: DataFrame, key: str, parts: list[tuple[str, list[str]]]) -> DataFrame:
    """key, part, change: keys that came or went, then, for those in both versions, each part any of whose fields changed, in order."""
    found = diff(before, after, [key], [f for _, fields in parts for f in fields])
    kinds = F.lit(None).cast("string")
    for name, fields in parts:
        kinds = F.when(F.col("field").isin(fields), name).otherwise(kinds)
    order = F.lit(1)
    for i, (name, _) in enumerate(parts, 2):
        order = F.when(F.col("change") == name, i).otherwise(order)
    return found.select(key, F.coalesce(kinds, F.col("change")).alias("change")).distinct().select(key, order.alias("part"), "change")


def page_ranges(starts: DataFrame, blocks: DataFrame, doc: str, start: str, page: str) -> DataFrame:
    """Blocks with each section whose pages they lie on: from its start to the page before the next one's, the last to the document's end."""
    last = blocks.groupBy(doc).agg(F.max(page).alias("__last"))
    stop = F.coalesce(F.lead(start).over(Window.partitionBy(doc).orderBy(start)) - 1, F.col("__last"))
    ranges = starts.join(last, doc).withColumn("__stop", F.greatest(stop, F.col(start)))
    return ranges.join(blocks, doc).where((F.col(page) >= F.col(start)) & (F.col(page) <= F.col("__stop"))).drop("__stop", "__last")

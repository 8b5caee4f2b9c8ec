"""Matching and routing: greedy name matching, neighbour boosts, stream merging, alignment, gap recovery, cascades."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy_names(expected: DataFrame, actual: DataFrame, doc: str) -> DataFrame:
    """Per document each expected name takes the first unused actual name that equals, contains or is contained in it.

    The choice depends on order, so a document's names, which are few, are matched together.
    """
    kind = expected.schema[doc].dataType.simpleString()

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out = []
        names = right.sort_values("pos")["name"].tolist()
        for d, e in left.sort_values("pos")[[doc, "name"]].itertuples(index=False):
            a = next((i for i, n in enumerate(names) if i not in used and (e.lower() == n.lower() or e.lower() in n.lower() or n.lower() in e.lower())), None)
            if a is not None:
                used.add(a)
            out.append((d, e, None if a is None else names[a]))
        return pd.DataFrame(out, columns=[doc, "expected", "actual"])

    return expected.groupBy(doc).cogroup(actual.groupBy(doc)).applyInPandas(match, f"{doc} {kind}, expected string, actual string")


def contained_in_any(rows: DataFrame, name: str, others: Column) -> DataFrame:
    """Rows whose name contains, or is contained in, one of the names of an array; several may take the same one."""
    low = F.lower(name)
    return rows.where(F.exists(others, lambda o: F.contains(low, F.lower(o)) | F.contains(F.lower(o), low)))


def header_votes(votes: DataFrame, key: str) -> DataFrame:
    """The code that two or more of the top three exemplars agree on, with a gain of .06."""
    counts = votes.where("rank <= 3").groupBy(key, "code").agg(F.count("*").alias("n"))
    return counts.where("n >= 2").select(key, "code", F.lit(0.06).alias("gain"))


def cascade(rows: DataFrame, local: str, centroid: str, threshold: float = 0.7, prefilter: float = 0.85) -> DataFrame:
    """Where each section is decided; only a model's decision would change its code, so the code stays local."""
    route = F.when(F.col(local) >= threshold, "local").when(F.col(centroid) >= prefilter, "centroid").otherwise("local")
    return rows.withColumn("route", route)


def cascade_stats(rows: DataFrame, by: str) -> DataFrame:
    """Local decisions; every other route counts as a model's. Agreement with the local top candidate."""
    local = F.col("route") == "local"
    return rows.groupBy(by).agg(F.count(F.when(local, 1)).alias("local"), F.count(F.when(~local, 1)).alias("model"), F.avg((F.col("code") == F.col("top")).cast("int")).alias("agreement"), F.sum("tokens").alias("tokens"))


def gap_recovery(gaps: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """The first candidate of an unanswered query by level, then order; what an adjacent section gives counts 0.8.

    candidates: key, level (1 own section, 2 adjacent, 3 registry), order, answer, confidence.
    """
    c = candidates.where("trim(answer) <> '' AND confidence > 0").join(gaps.select(key), key, "left_semi")
    scaled = F.when(F.col("level") == 2, F.col("confidence") * 0.8).when(F.col("level") == 3, 0.85).otherwise(F.col("confidence"))
    first = c.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("level", "order", "answer"))).where("k = 1")
    return first.select(key, "level", "answer", F.round(scaled, 4).alias("confidence"))


def exact_stream_merge(pairs: DataFrame, doc: str) -> DataFrame:
    """The order-dependent merge of visit pairs of a document: a pair joins the first kept one whose name and visit contain, or are in, its own; each re-match adds .1, at most .95."""
    kind = pairs.schema[doc].dataType.simpleString()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        alike = lambda a, b: a in b or b in a
        for d, name, visit, c, source in frame.sort_values(["pos", "name", "visit", "source", "confidence"])[[doc, "name", "visit", "confidence", "source"]].itertuples(index=False):
            hit = next((k for k in kept if alike(k[1].lower(), name.lower()) and alike(k[2].lower(), visit.lower())), None)
            if hit is None:
                kept.append([d, name, visit, c, {source}])
            else:
                hit[3] = min(max(hit[3], c) + 0.1, 0.95)
                hit[4].add(source)
        return pd.DataFrame([[d, n, v, c, ",".join(sorted(s))] for d, n, v, c, s in kept], columns=[doc, "name", "visit", "confidence", "sources"])

    return pairs.groupBy(doc).applyInPandas(merge, f"{doc} {kind}, name string, visit string, confidence double, sources string")


def safely(rows: DataFrame, work, schema: str, key: str) -> DataFrame:
    """Run a function on every row; a failure becomes status 'error' with the end of its message instead of ending the batch."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import traceback

        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    out.append({key: row[key], "status": "pass", "error": None, "value": work(row)})
                except Exception:
                    out.append({key: row[key], "status": "error", "error": traceback.format_exc()[-2000:], "value": None})
            yield pd.DataFrame(out, columns=[key, "status", "error", "value"])

    return rows.mapInPandas(run, f"{key} {kind}, status string, error string, value {schema}")


def continuation_merge(tables: DataFrame, doc: str, least: float = 0.5) -> DataFrame:
    """Group numbers of tables that continue the one before: within two pages and with headers that overlap enough."""
    from corvane.operators.sets import jaccard

    # tables at one place go by their headers
    w = Window.partitionBy(doc).orderBy("page", "pos", "header")
    before_page, before_head = F.lag("page").over(w), F.lag("header").over(w)
    starts = ~((F.col("page") <= before_page + 2) & (jaccard("header", F.coalesce(before_head, F.array().cast("array<string>"))) >= least))
    rows = tables.withColumn("starts", F.coalesce(starts, F.lit(True)).cast("int"))
    return rows.withColumn("group_no", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("starts")

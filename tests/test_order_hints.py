"""Order hints against a plain loop through each document."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators.order_hints import order_hints


def plain(headers, toc=None, auto=0.75, review=0.5, delta=0.10, gain=0.06):
    """headers: {doc: [(pos, scores)]}; the loop changes scores as it goes."""
    out = {}
    for doc, rows in headers.items():
        rows = [[p, list(s)] for p, s in sorted(rows)]
        best = lambda s: max(range(len(s)), key=lambda j: s[j])
        flags = [False] * len(rows)
        if toc is None or doc in toc:
            for i, (_, s) in enumerate(rows):
                order = sorted(range(len(s)), key=lambda j: (-s[j], j))
                if len(s) < 2 or not review <= s[order[0]] < auto or s[order[0]] - s[order[1]] > delta:
                    continue
                before = best(rows[i - 1][1]) if i else None
                after = best(rows[i + 1][1]) if i + 1 < len(rows) else None
                if before is None and after is None:
                    continue
                fits = lambda c: (before is None or c > before) and (after is None or c < after)
                if fits(order[1]) and not fits(order[0]):
                    s[order[1]] = min(1.0, s[order[1]] + gain)
                    flags[i] = True
        for (p, s), f in zip(rows, flags):
            out[doc, p] = (f, best(s), s)
    return out


def rows_of(df):
    return {(r["doc"], r["pos"]): (r["boosted"], r["chosen"], r["scores"]) for r in df.collect()}


def made(seed, docs, codes=5):
    rng = random.Random(seed)
    out = {}
    for d in docs:
        n = rng.choice([1, 2, 3, 30]) if d != "hot" else 3000
        # scores in steps of .03 give ties and many close calls
        out[d] = [(p * 3, [round(0.5 + 0.03 * rng.randrange(9), 2) for _ in range(codes)]) for p in rng.sample(range(n * 2), n)]
    return out


def frame(spark, headers, parts):
    rows = [(d, p, s, "x") for d, hs in headers.items() for p, s in hs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc string, pos int, scores array<double>, first string").repartition(parts)


@pytest.mark.parametrize("seed, parts", [(1, 3), (2, 8)])
def test_equal_to_the_loop(spark, seed, parts):
    headers = made(seed, ["a", "b", "c", "d", "e", "f", "hot", "z"])
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(order_hints(frame(spark, headers, parts), "doc", "pos", "scores"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = plain(headers)
    assert got == want
    assert any(f for f, _, _ in want.values())


def test_the_header_before_counts_as_adjusted(spark):
    """The second header turns from 4 to 2, so 3 fits in the third one; held against 4 it would not, and 5 would gain wrongly."""
    headers = {"d": [(1, [0.0, 0.9, 0.0, 0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.58, 0.0, 0.6, 0.0]), (3, [0.0, 0.0, 0.0, 0.6, 0.0, 0.58])]}
    got = rows_of(order_hints(frame(spark, headers, 1), "doc", "pos", "scores"))
    assert got == plain(headers)
    assert got["d", 2][:2] == (True, 2) and got["d", 3][:2] == (False, 3)


def test_documents_without_contents_stay(spark):
    headers = made(3, ["a", "b", "c", "d"])
    df = frame(spark, headers, 2)
    got = rows_of(order_hints(df, "doc", "pos", "scores", F.col("doc").isin("a", "c")))
    assert got == plain(headers, toc={"a", "c"})


def test_edges(spark):
    df = spark.createDataFrame([(None, 1, [0.6, 0.58], "x"), ("a", 1, [0.6], "x"), ("b", 1, None, "x"), ("b", 2, [], "x")], "doc string, pos int, scores array<double>, first string")
    got = rows_of(order_hints(df, "doc", "pos", "scores"))
    assert got == {(None, 1): (False, 0, [0.6, 0.58]), ("a", 1): (False, 0, [0.6]), ("b", 1): (False, None, None), ("b", 2): (False, None, [])}
    assert order_hints(df.limit(0), "doc", "pos", "scores").count() == 0

"""Neighbours through inverted lists against products of all vectors with all."""

import os
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import neighbour_index as N

SCHEMA = "id long, v array<double>, list string, label string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", str(i % 3)) for i, v in vectors], SCHEMA)


def clustered(seed, n=900, dim=12, clusters=15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, v.tolist()) for i, v in enumerate(x)]


def brute(targets, rows, k):
    out = {}
    for i, q in targets:
        if q:
            scored = sorted((-round(float(np.dot(q, v)), 12), j) for j, v in rows if v and j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def rows_of(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["target"], r["rank"])):
        out.setdefault(r["target"], []).append((r["neighbour"], r["similarity"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for i, near in want.items():
        assert [j for j, _ in got[i]] == [j for j, _ in near], i
        assert np.allclose([s for _, s in got[i]], [s for _, s in near], atol=1e-9)


@pytest.mark.parametrize("lists, probes", [(1, 1), (30, 1), (30, 4)])
def test_exact_search_misses_nothing(spark, lists, probes):
    vectors = clustered(lists)
    hot = vectors[5][1]
    vectors += [(2000 + i, hot) for i in range(300)] + [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [9.0] + [0.0] * 11)]
    index = N.build(frame(spark, vectors), "id", "v", lists=lists)
    asked = [x for x in vectors if x[0] % 7 == 0 or x[0] > 2290]
    same(rows_of(index.search(frame(spark, asked), "id", "v", 6, exact=True, probes=probes)), brute(asked, vectors, 6))


def test_blocks_of_hot_lists(spark):
    """A list that is larger than a block goes to several tasks; nothing changes."""
    vectors = clustered(4, 500)
    vectors += [(2000 + i, [x + 1e-7 * i for x in vectors[0][1]]) for i in range(250)]
    index = replace(N.build(frame(spark, vectors), "id", "v", lists=6), block=50)
    same(rows_of(index.search(frame(spark, vectors), "id", "v", 4, exact=True, probes=1)), brute(vectors, vectors, 4))


def test_ties_go_to_the_smaller_key(spark):
    vectors = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in random.Random(1).sample(range(100), 100)]
    got = rows_of(N.neighbours(frame(spark, vectors), frame(spark, vectors), "id", "v", 3))
    assert [j for j, _ in got[50]] == [0, 2, 4] and [j for j, _ in got[1]] == [3, 5, 7]


def test_tuned_probes_find_most(spark):
    vectors = clustered(9, 3000, 16, 40)
    index = N.build(frame(spark, vectors), "id", "v", lists=60).tuned(5)
    assert 1 <= index.probes < 40  # most lists are never looked at
    asked = [x for x in vectors if x[0] % 10 == 0]
    got, want = rows_of(index.search(frame(spark, asked), "id", "v", 5)), brute(asked, vectors, 5)
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in near}) for i, near in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_only_near_lists_are_compared(spark):
    """The pairs that tasks compare are a small part of all pairs."""
    vectors = clustered(10, 2000, 8, 50)
    index = N.build(frame(spark, vectors), "id", "v", lists=50)
    asked = frame(spark, vectors).select(F.col("id").alias("target"), F.col("v").alias("q"))
    probed = index._probed(asked, 4).groupBy("list").count().collect()
    assert sum(r["count"] * int(index.sizes[r["list"]]) for r in probed) < 0.3 * len(vectors) ** 2


def test_save_load_and_add(spark, tmp_path):
    vectors = clustered(3, 600)
    index = N.build(frame(spark, vectors[:300]), "id", "v", lists=12)
    index.save(str(tmp_path / "a"))
    changed = [(i, [-x for x in v]) for i, v in vectors[:50]]  # keys that the index has stay as they were
    grown = N.load(spark, str(tmp_path / "a")).add(frame(spark, vectors[300:] + changed), "id", "v")
    grown.save(str(tmp_path / "b"))
    again = N.load(spark, str(tmp_path / "b"))
    assert again.entries.count() == 600 and int(again.sizes.sum()) == 600 and again.probes == index.probes
    asked = vectors[::9]
    same(rows_of(again.search(frame(spark, asked), "id", "v", 5, exact=True)), brute(asked, vectors, 5))
    assert "label" in again.entries.columns


def test_empty(spark):
    none = frame(spark, [(1, None)])
    index = N.build(none, "id", "v")
    some = frame(spark, clustered(1, 5))
    assert index.search(some, "id", "v", 3, exact=True).count() == 0
    assert N.neighbours(none, some, "id", "v", 3).count() == 0
    assert index.tuned(3).probes == index.probes


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are not here")
def test_recall_on_the_embeddings(spark):
    """Every fiftieth row against all rows, through the probed lists only."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = N.build(e, "vec_id", "embedding", lists=64).tuned(10)
    got = rows_of(index.search(e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10))
    rows = [(r["vec_id"], r["embedding"]) for r in e.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    hits = total = 0
    for i, q in rows:
        if i % 50 == 0:
            s = np.round(x @ np.array(q, np.float64), 12)
            s[ids == i] = -np.inf
            want = {int(ids[j]) for j in np.lexsort((ids, -s))[:10]}
            hits, total = hits + len(want & {j for j, _ in got[i]}), total + 10
    assert hits >= 0.9 * total


def test_exact_search_sends_a_vector_once_a_part(spark):
    """However many lists a query could have to go through, it is sent to the parts of the entries, not to the lists."""
    vectors = clustered(6, 2600, 24, 1)
    asked = frame(spark, vectors).select(F.col("id").alias("target"), F.col("v").alias("q"))
    index = N.build(frame(spark, vectors), "id", "v", lists=60)
    near = index.search(frame(spark, vectors), "id", "v", 4, exact=True)
    assert N.swept(asked, index.entries.select("idx", "vec"), 4).count() <= len(vectors) * N.GRID * 4
    same(rows_of(near), brute(vectors, vectors, 4))


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e6, 1e20])
def test_best_by_single_precision_is_exact(scale):
    """Vectors that single precision cannot tell apart are told apart."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3, 8))[rng.integers(0, 3, 300)] + 1e-9 * rng.normal(size=(300, 8))
    x *= scale
    row, at, values = N._best(x, x, np.arange(300), 5, rows=64, columns=32)
    s = np.round(np.einsum("id,jd->ijd", x, x).sum(axis=2), 12) if scale == 1 else None
    assert len(row) == 1500 and not (row == at).any()
    if s is not None:
        s[np.arange(300), np.arange(300)] = -np.inf
        assert np.allclose(values.reshape(300, 5), -np.sort(-s, axis=1)[:, :5], atol=2e-12, rtol=0)

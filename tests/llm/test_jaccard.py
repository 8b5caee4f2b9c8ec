import random

import numpy as np
import pytest

from corvane.llm import components, jaccard
from tests.llm.helpers import component_ids, frame, mixed, near_copies, prose, sets_of


def brute(texts):
    s = [sets_of(t) for t in texts]
    links = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    comp = component_ids(list(range(len(s))), links)
    return {i: (len(s[i]), comp[i]) for i in comp}


def check(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(frame(spark, texts)).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    check(spark, mixed(seed))


def test_chains_and_sizes(spark):
    rng = random.Random(5)
    texts = []
    for n in (5, 6, 9, 12, 17, 20, 36, 70, 130, 300):
        t = prose(rng, n)
        texts += [t] + near_copies(rng, t, 5, max(1, n // 60)) + [t + " " + prose(rng, max(1, n // 8)), " ".join(t.split()[: max(1, n * 9 // 10)])]
        for _ in range(4):  # a chain, whose ends are far apart
            texts.append(near_copies(rng, texts[-1], 1, max(1, n // 50))[0])
    check(spark, texts)


def test_empty_and_extra_columns(spark):
    df = frame(spark, []).withColumnRenamed("lang", "n")
    assert jaccard.components(df).count() == 0
    df = frame(spark, [(None, "a b"), (1, "a b"), (1, "a b")]).withColumnRenamed("lang", "key").withColumnRenamed("source", "id")
    assert sorted(map(tuple, jaccard.components(df).collect()), key=str) == [(1, 1, 1), (1, 1, 1), (None, 1, None)]


def test_keep_one(spark):
    rng = random.Random(3)
    t = prose(rng, 200)
    df = frame(spark, near_copies(rng, t, 9, 1) + ["other words here for all of us"])
    assert sorted(r["doc_id"] for r in jaccard.keep_one(df).collect()) == [0, 9]


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(4)
    data = rng.poisson(3, (700, 64)).astype(np.int32)
    data[350:] = np.maximum(data[:350] + rng.integers(-1, 2, (350, 64)), 0)
    tree = jaccard.Tree(data)
    for i in range(0, 700, 50):
        over = np.minimum(data, data[i]).sum(axis=1)
        want = np.flatnonzero(over >= 0.8 / 1.8 * (data.sum(axis=1) + data[i].sum()) - 1e-9)
        assert sorted(tree.search(data[i], 0.8)) == want.tolist()


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(500, 501)]
    got = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == component_ids(sorted({x for e in links for x in e}), links)

"""Operators and queries that must not stop early or read a part of their tables."""

import os

import pytest
from pyspark.sql import functions as F

from corvane import catalog
from corvane.operators import studies as S

SF = "/root/testdata/sf0.001"


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(60)], "page int, a int, b int")
    rows = S.shape_components(edges).collect()
    assert len(rows) == 61 and {r["label"] for r in rows} == {0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_merge_reads_all_orders(spark):
    docs = spark.read.parquet(f"{SF}/lineitem.parquet").select((F.col("l_orderkey") % 200).alias("doc")).distinct().count()
    assert catalog.queries()["jn12_agg20_ordered_merge"](spark, SF).select("doc").distinct().count() == docs


def test_needles_meet_texts_by_words(spark):
    from corvane.operators.joins import containing

    words = "alpha beta gamma delta echo fox golf hotel india".split()
    texts = [(i, " ".join(words[(i * 3 + j * j) % 9] for j in range(14))) for i in range(20)]
    needles = [(i, t[3 : 3 + n]) for i, t in texts for n in (4, 20, 33, 45)]
    a, b = spark.createDataFrame(texts, "doc int, text string"), spark.createDataFrame(needles, "item int, needle string").distinct()
    want = sorted({(d, i, n) for d, t in texts for i, n in needles if n in t})
    for rows in (1000, 30):
        got = sorted((r["doc"], r["item"], r["needle"]) for r in containing(a, b, "text", "needle", rows).distinct().collect())
        assert got == want


def test_neighbours_against_all(spark):
    import numpy as np

    from corvane.operators import vectors

    v = np.random.default_rng(3).normal(size=(60, 8))
    v[7] = v[3]
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(v)], "id long, v array<double>, label int")
    got = {(r["target"], r["rank"]): r["neighbour"] for r in vectors.neighbours(rows, rows, "id", "v", 4, size=16).collect()}
    s = np.round(v @ v.T, 12)
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-s[i, j], j))[:4]
        assert [got[i, k + 1] for k in range(4)] == order
    same = {r["same"]: (r["pairs"], r["mean"]) for r in vectors.label_similarity(rows, "label", "v").collect()}
    pairs = [(i % 4 == j % 4, float(v[i] @ v[j])) for i in range(60) for j in range(i)]
    for flag in (True, False):
        own = [x for f, x in pairs if f is flag]
        assert same[flag][0] == len(own) and abs(same[flag][1] - np.mean(own)) < 1e-9


def test_near_titles_against_all(spark):
    from corvane.operators.sets import near_duplicates_removed

    words = "the of a study trial cancer heart drug dose phase two three".split()
    titles = [" ".join(words[(i * 5 + j * (1 + i % 3)) % 12] for j in range(3 + i % 6)) for i in range(80)]
    rows = spark.createDataFrame(list(enumerate(titles)), "url int, title string")
    new, old = rows.where("url % 2 = 1"), rows.where("url % 2 = 0")
    sets = [set(t.split()) for t in titles]
    want = sorted(i for i in range(1, 80, 2) if not any(len(sets[i] & sets[j]) > 0.8 * len(sets[i] | sets[j]) for j in range(0, 80, 2)))
    assert sorted(r["url"] for r in near_duplicates_removed(new, old, "url", "title").collect()) == want


def test_narrative_forms(spark):
    from corvane.functions.parsing import narrative_pairs

    text = "Blood pressure will be measured at Screening, Day 1, and Day 15. The MRI on week 3 and at home. MRI every 2 Weeks. ECG at every scheduled visit. MRI on Week 3"
    row = spark.createDataFrame([(text,)], "t string").select(narrative_pairs(F.col("t")).alias("p")).first()["p"]
    assert [tuple(x) for x in row] == [("Blood pressure", "Screening", 0.7), ("Blood pressure", "Day 1", 0.7), ("Blood pressure", "Day 15", 0.7), ("MRI", "week 3", 0.7), ("MRI", "Every 2 Weeks", 0.65), ("ECG", "Each Visit", 0.6)]


def test_fidelity_against_all_originals(spark):
    import random

    from corvane.operators.joins import fidelity

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abc", k=rng.randrange(1, 9)))
    originals = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(12)] + [None, "", "x" * 30]
    said = {}
    for d in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(0, 5))]
        for _ in range(rng.randrange(0, 3)):
            o = rng.choice(originals[:12])
            at = rng.randrange(len(o) + 1)
            parts.append(o[at : at + rng.randrange(10, 90)] + rng.choice(["", " changed at the end of it"]))
        said[d] = parts
    said[99], said[98] = None, ["x" * 25, "x" * 31]
    got = {r["id"]: r["fidelity"] for r in fidelity(spark.createDataFrame(list(said.items()), "id int, s array<string>"), "id", "s", spark.createDataFrame([(o,) for o in originals], "t string"), "t").collect()}
    for d, parts in said.items():
        long = [p for p in parts or [] if len(p) >= 20]
        held = [p for p in long if any(o and p[:60] in o for o in originals)]
        assert abs(got[d] - (sum(map(len, held)) / sum(map(len, long)) if long else 1.0)) < 1e-12
    assert len(got) == len(said) and 0 < sum(0 < v < 1 for v in got.values())

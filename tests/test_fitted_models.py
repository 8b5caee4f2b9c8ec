"""The copula, the text encoder and the window classifier: errors of correlations, similarities and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import copula, encoder
from corvane.operators.partition_sums import summed

SF = "/root/testdata/sf0.01"


def ranks(x):
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    out[order] = np.arange(len(x))
    values, inverse = np.unique(x, return_inverse=True)
    return (np.bincount(inverse, out) / np.bincount(inverse))[inverse]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    z = rng.multivariate_normal([0, 0, 0, 0], [[1, 0.8, -0.5, 0.3], [0.8, 1, -0.3, 0.2], [-0.5, -0.3, 1, 0], [0.3, 0.2, 0, 1]], 8000)
    rows = []
    for i, (a, b, c, d) in enumerate(z):
        rows.append((float(np.exp(a)), int(round(40 + 12 * b)), None if i % 5 == 0 else float(c**3), "low" if d < -0.5 else "mid" if d < 1 else "up", None, 7.5))
    return spark.createDataFrame(rows, "amount double, age int, marker double, level string, nothing string, same double").repartition(4)


COLUMNS = ["amount", "age", "marker", "level", "nothing", "same"]


def test_copula_keeps_distributions_and_correlations(spark, skewed):
    model = copula.fit(skewed, COLUMNS)
    real, made = skewed.toPandas(), model.rows(spark, 20_000, "k").toPandas()
    for c in ("amount", "age", "marker"):
        q = np.linspace(0.05, 0.95, 19)
        # shares below each quantile of the real rows
        a, b = real[c].dropna().to_numpy(), made[c].dropna().to_numpy()
        assert np.abs((b[:, None] <= np.quantile(a, q)).mean(axis=0) - (a[:, None] <= np.quantile(a, q)).mean(axis=0)).max() < 0.02, c
    for x, y in (("amount", "age"), ("amount", "marker"), ("age", "marker")):
        both, other = real[[x, y]].dropna(), made[[x, y]].dropna()
        want, got = (np.corrcoef(ranks(t[x].to_numpy(float)), ranks(t[y].to_numpy(float)))[0, 1] for t in (both, other))
        assert abs(want - got) < 0.03, (x, y, want, got)
    levels = real.level.value_counts(normalize=True) - made.level.value_counts(normalize=True)
    assert levels.abs().max() < 0.02
    # the category goes with the amount as it does in the real rows
    gap = lambda t: t[t.level == "up"].amount.median() - t[t.level == "low"].amount.median()
    assert abs(gap(real) - gap(made)) < 0.25 * gap(real)
    assert abs(made.marker.isna().mean() - 0.2) < 0.02 and made.nothing.isna().all() and (made["same"] == 7.5).all()
    assert made.age.dtype.kind in "iu" and model.rows(spark, 1, "k").schema["age"].dataType == skewed.schema["age"].dataType


def test_copula_rows_do_not_depend_on_partitions(spark, skewed):
    model = copula.fit(skewed, COLUMNS)
    few = sorted(map(tuple, model.rows(spark, 500, "k").collect()))
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", "4")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "9")
    try:
        assert sorted(map(tuple, model.rows(spark, 900, "k").where("id < 500").collect())) == few
    finally:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
    assert sorted(map(tuple, model.rows(spark, 500, "other").collect())) != few


def test_copula_of_nothing(spark, skewed):
    made = copula.fit(skewed.limit(0), COLUMNS).rows(spark, 3, "k").collect()
    assert len(made) == 3 and all(r[c] is None for r in made for c in COLUMNS)
    with pytest.raises(ValueError, match="categories"):
        copula.fit(spark.range(3000).select(F.col("id").cast("string").alias("c")), ["c"])


def test_sums_over_partitions(spark):
    rows = spark.range(1000).withColumn("x", F.col("id").cast("double")).repartition(7)

    def add(batch, out):
        x = batch.column("x").to_numpy()
        out[0] += x.sum()
        out[1] += len(x)

    assert summed(rows, add, (2,)).tolist() == [499500.0, 1000.0]
    assert summed(rows.limit(0), add, (2,)).tolist() == [0.0, 0.0]


@pytest.fixture(scope="module")
def topics(spark):
    """Three topics whose words share stems with nothing; each document uses a few of its topic's many words and common ones."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    own = [[word() for _ in range(150)] for _ in range(3)]
    common = [word() for _ in range(40)]
    rows = []
    for i in range(450):
        t = i % 3
        rows.append((i, "topic%d" % t, " ".join(rng.choices(own[t], k=14) + rng.choices(common, k=26))))
    return spark.createDataFrame([*rows, (900, "topic0", None), (901, None, ""), (902, "topic1", "...")], "id int, y string, text string").repartition(3)


def gain(rows) -> float:
    """Mean similarity within a class less that between classes."""
    x, y = np.array([v for v, _ in rows]), np.array([c for _, c in rows])
    s, same = x @ x.T, y[:, None] == y[None, :]
    off = ~np.eye(len(y), dtype=bool)
    return s[same & off].mean() - s[~same].mean()


def test_encoder_tells_topics_apart(spark, topics):
    model = encoder.fit_encoder(topics, "text", dims=16)
    assert np.allclose(model.basis.T @ model.basis, np.eye(16), atol=1e-8)
    rows = [(r["v"], r["y"]) for r in model.encode(topics, "text", "v").where("id < 900").collect()]
    # the stand-in before: hashed counts of the same number of dimensions
    hashed = []
    for r in topics.where("id < 900").collect():
        v = np.zeros(16)
        for w in r["text"].split():
            v[zlib.crc32(w.encode()) % 16] += 1
        hashed.append((v / np.linalg.norm(v), r["y"]))
    assert gain(rows) > 0.2 and gain(rows) > 4 * gain(hashed)
    empty = model.encode(topics, "text", "v").where("id >= 900").collect()
    assert len(empty) == 3 and all(not any(r["v"]) for r in empty)


def test_tuning_brings_labels_together(spark, topics):
    """On rows that the tuning has not seen, texts of one topic come closer to each other than before, measured against the others."""
    base = encoder.fit_encoder(topics, "text", dims=16)
    better = encoder.tuned(base, topics.where("id % 5 <> 0"), "text", "y")
    held = topics.where("id % 5 = 0 AND id < 900")
    before, after = (gain([(r["v"], r["y"]) for r in m.encode(held, "text", "v").collect()]) for m in (base, better))
    assert after > before + 0.2
    assert not any(better.encode(topics.where("id = 900"), "text", "v").first()["v"])


def test_directions_are_those_of_the_whole_decomposition(spark, topics):
    """Against a plain decomposition of the same weights."""
    model = encoder.fit_encoder(topics, "text", dims=3)
    texts = [r["text"] for r in topics.collect()]
    row, at, weight = encoder._weighted(texts, model.idf)
    x = np.zeros((len(texts), encoder.BUCKETS))
    np.add.at(x, (row, at), weight)
    exact = np.linalg.svd(x, full_matrices=False)[2][:3]
    kept = np.linalg.norm(x @ model.basis) / np.linalg.norm(x @ exact.T)
    assert kept > 0.99


def plain_windows(text, size, step):
    words = (text or "").split()
    out, at = [], 0
    while words:
        out.append((at, min(at + size, len(words)), " ".join(words[at : at + size])))
        if at + size >= len(words):
            break
        at += step
    return out


def test_windows(spark):
    texts = [None, "", " \n ", "one", *(" ".join(f"w{i}" for i in range(n)) for n in (3, 4, 5, 6, 7, 8, 9, 21))]
    got = encoder.windows(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", 4, 2).collect()
    want = [(i, *w) for i, t in enumerate(texts) for w in plain_windows(t, 4, 2)]
    assert sorted((r["id"], r["at"], r["until"], r["window"]) for r in got) == sorted(want)


def test_classifier_on_rows_it_has_not_seen(spark, topics):
    model = encoder.fit_classifier(topics.where("id % 5 <> 0"), "text", "y", encoder.fit_encoder(topics, "text", dims=16), size=20, step=10)
    found = encoder.sections(model.classify(topics.where("id % 5 = 0 and id < 900"), "text", 20, 10), "id")
    told = {r["id"]: r["label"] for r in encoder.main_label(found, "id").collect()}
    assert len(told) == 90 and sum(told[i] == f"topic{i % 3}" for i in told) >= 0.95 * len(told)
    row = found.where("id = 5").orderBy("at").first()
    assert 0 < row["confidence"] <= 1 and row["windows"] >= 1 and row["until"] <= 40
    assert model.classify(topics.where("id >= 900"), "text").count() == 1  # "..." is a word of signs; the other two have none


def test_languages_of_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = encoder.fit_classifier(d.where(~held), "text", "lang", encoder.fit_encoder(d, "text"))
    told = encoder.main_label(encoder.sections(model.classify(d.where(held).drop("lang"), "text"), "doc_id"), "doc_id").join(d, "doc_id").select(F.avg((F.col("label") == F.col("lang")).cast("int"))).first()[0]
    most = d.where(held).groupBy("lang").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert told > 0.9 and told > most + 0.1


def test_tuning_by_vectors_is_tuning_by_texts(spark):
    from corvane.operators import encoder as E

    texts = [(i, " ".join(f"word{(i * 7 + k * k) % 23}" for k in range(3 + i % 9)) if i % 10 else None, None if i % 11 == 0 else f"l{i % 3}") for i in range(60)]
    rows = spark.createDataFrame(texts, "id int, text string, label string")
    base = E.fit_encoder(rows, "text", 6)
    vectors = base.encode(rows, "text", "v").drop("text")
    a, b = E.tuned(base, rows, "text", "label"), E.tuned_by(base, vectors, "v", "label")
    assert abs(a.turn - b.turn).max() < 1e-9
    want = {r["id"]: r["v"] for r in a.encode(rows, "text", "v").collect()}
    got = {r["id"]: r["v"] for r in b.turned(vectors, "v").collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-9 for i in got for x, y in zip(got[i], want[i]))


def test_a_fit_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        read.add(1)
        return f"word{i % 7} word{i % 5} other{i % 3}"

    model = encoder.fit_encoder(spark.range(120, numPartitions=3).select(text("id").alias("text")), "text", dims=4)
    assert read.value == 120 and model.basis.shape == (encoder.BUCKETS, 4)


def test_counts_of_buckets():
    texts = ["A b ab AB abc", None, "", "ab " * 70_000]
    counts = encoder._counted(texts, encoder._Buckets())
    ab, abc = (zlib.crc32(w) % encoder.BUCKETS for w in (b"ab", b"abc"))
    assert counts.sum(axis=1).tolist() == [3, 0, 0, 70_000] and counts[:, ab].tolist() == [2, 0, 0, 70_000] and counts[0, abc] == 1


def test_a_classifier_encodes_each_window_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        read.add(1)
        return f"word{i % 3} both{i % 5} one{i % 7}"

    rows = spark.range(90, numPartitions=3).select("id", text("id").alias("text"), F.concat(F.lit("l"), F.col("id") % 3).alias("lang"))
    plain = rows.select("id", F.expr("concat('word', id % 3, ' both', id % 5, ' one', id % 7)").alias("text"), "lang")
    base = encoder.fit_encoder(plain, "text", dims=6)
    model = encoder.fit_classifier(rows, "text", "lang", base)
    assert read.value == 90
    again = encoder.classifier_by(encoder.encoded(base, plain, "text").localCheckpoint(), "lang", base)
    want = {r["id"]: (r["label"], round(r["confidence"], 6)) for r in model.classify(plain, "text").collect()}
    assert {r["id"]: (r["label"], round(r["confidence"], 6)) for r in again.classify(plain, "text").collect()} == want

"""Tables whose columns are named like the inner ones of operators, and items without ids."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import decontam, lines, pii, quality
from tests.llm.helpers import frame

NAMES = ["__gone", "__doc", "__tag", "__text", "__stats", "__score", "__steps", "__key", "__id", "column", "__spans", "__n_words", "__contaminated"]
LINE = "the line that several documents have in common, every one of its words"


def odd(spark, texts):
    df = frame(spark, texts)
    for i, name in enumerate(NAMES):
        df = df.withColumn(name, F.lit(f"kept {i}"))
    return df


def kept(df, n):
    rows = df.collect()
    assert len(rows) == n and all(r[name] == f"kept {i}" for r in rows for i, name in enumerate(NAMES))
    return {r["doc_id"]: r for r in rows}


def test_lines(spark):
    texts = [f"{LINE}\n{own}" for own in ("apples ripen late in autumn rain", "ships carry grain across an ocean", "old clocks need winding every night")]
    rows = kept(lines.dedup(odd(spark, texts)), 3)
    assert sorted(r["n_dropped"] for r in rows.values()) == [0, 1, 1]
    by_name = lines.dedup(odd(spark, texts).drop("__doc").withColumnRenamed("doc_id", "__doc"), id_col="__doc")
    assert "__doc" in by_name.columns and by_name.agg(F.sum("n_dropped")).first()[0] == 2


def test_quality(spark):
    texts = ["Good plain text with words of many kinds, and sentences. " * 5, "$$$ ### !!! 111 " * 9] * 40
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, quality int")
    good = quality.keep_good(odd(spark, texts), labels)
    assert good.columns == odd(spark, ["x"]).columns and set(kept(good, 40)) == set(range(0, 80, 2))
    scored = quality.scores(odd(spark, texts), labels, keep=("__score", "__text"))
    assert scored.columns == ["doc_id", "__score", "__text", "held_out", "score", "predicted"] and scored.where("__score = 'kept 5'").count() == 80


def test_surrogates(spark):
    rows = kept(pii.replace(odd(spark, ["Write to Maria Lopez at maria@mail.example today.", "nothing", None]), b"key"), 3)
    assert "Maria" not in rows[0]["text"] and rows[0]["n_entities"] == 3 and rows[2]["text"] is None


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


@pytest.mark.parametrize("block_bytes", [16 << 20, 10])
def test_items_without_ids(spark, block_bytes):
    """The same rows whether the benchmark goes out at once or in blocks."""
    items = spark.createDataFrame([(None, ITEM), ("b", ITEM + " pi"), (None, "short one"), ("c", None), (None, None)], "item_id string, text string")
    docs = odd(spark, [f"x {ITEM} y", "a short one here", "clean", None, ""])
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.contamination(docs, items, block_bytes=block_bytes).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {0: (17, 15, 1, sha("b"), True), 1: (4, 2, 0, sha(""), True), 2: (1, 0, 0, sha(""), False), 3: (0, 0, 0, sha(""), False), 4: (0, 0, 0, sha(""), False)}
    left = decontam.decontaminate(docs, items, block_bytes=block_bytes)
    assert left.columns == docs.columns and set(kept(left, 3)) == {2, 3, 4}


def test_pipeline_lines_stage(spark):
    import corpus_pipeline

    texts = [f"{LINE}\n{own}" for own in ("apples ripen late in autumn rain", "ships carry grain across an ocean")] + [None, "", LINE]
    docs = odd(spark, texts).withColumn("__gone_lines", F.lit("u")).withColumn("gone_lines", F.lit("v"))
    out = corpus_pipeline.lines_stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(rows) == {0, 1, 2, 3} and all((r["__gone_lines"], r["gone_lines"], r["__gone"]) == ("u", "v", "kept 0") for r in rows.values())
    assert rows[1]["text"] == "ships carry grain across an ocean" and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[0]["text"] == texts[0]


def test_workers_keep_one_operators_things(spark):
    """A task of another operator gives up the vocabulary that a worker kept; its own operator's tasks do not."""
    from corvane.llm import bpe, common, token_counts

    with open(bpe.default_path(), encoding="utf-8") as f:
        text = f.read()
    own = bpe.vocabulary(text)
    common.forget_others(bpe.__name__)
    assert bpe.vocabulary(text) is own
    common.forget_others(token_counts.__name__)
    assert bpe.vocabulary.cache_info().currsize == 0

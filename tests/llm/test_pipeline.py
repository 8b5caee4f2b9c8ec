"""The pipeline's stages on the small tables: columns, decisions, and what reaches the end."""

import os

import pytest

import corpus_pipeline
from corvane.llm import decontam, jaccard, quality
from tests.llm.helpers import frame, near_copies, prose

SF = "/root/testdata/sf0.001"


def test_lines_stage(spark):
    import random

    rng = random.Random(1)
    a, b, c = (prose(rng, 20) for _ in range(3))
    docs = frame(spark, [a + "\n" + b, b + "\n" + c, a, None, ""])
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.lines_stage(spark, docs, SF).collect()}
    assert out == {0: (a + "\n" + b, len(a + b) + 1), 1: (c, len(c)), 3: (None, 0), 4: ("", 0)}


def test_jaccard_stage(spark):
    import random

    rng = random.Random(2)
    t = prose(rng, 150)
    docs = frame(spark, near_copies(rng, t, 4, 1) + ["", None, "x"])
    assert sorted(r["doc_id"] for r in corpus_pipeline.jaccard_stage(spark, docs, SF).collect()) == [0, 4, 5, 6]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.store(stage(spark, docs, SF))
        assert docs.columns == columns and 0 < docs.count() <= before, name
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.contamination(docs, bench).where("contaminated").count() == 0
    assert jaccard.components(docs).where("component_id <> doc_id AND n_shingles > 0").count() == 0
    want = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.bpe_stage(spark, docs, SF).collect()}
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert len(quality.NAMES) == len(quality.features(docs).first()["__stats"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages_against_plain_ones(spark):
    """Each stage on its predecessor's output, against a rereading of its contract that shares no code with it."""
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.helpers import component_ids, sets_of
    from tests.llm.test_lines import alike, normal
    from tests.llm.test_media_text import brute_contamination

    def rows(df):
        return {r["doc_id"]: r["text"] for r in df.collect()}

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = corpus_pipeline.store(stages["quality classifier"](spark, docs, SF))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = rows(good)
    right = [(i in kept) == bool(y) for i, y in labels.items() if y is not None]
    assert sum(right) >= 0.9 * len(right)

    lined = corpus_pipeline.store(stages["line dedup"](spark, good, SF))
    got = rows(lined)
    seen: dict[str, tuple] = {}
    for d in sorted(kept):
        for x in (kept[d] or "").split("\n"):
            if normal_all(x):
                seen.setdefault(normal_all(x), (d, x))
    left = [x for t in got.values() for x in (t or "").split("\n") if normal_all(x)]
    forms = [normal_all(x) for x in left]
    assert len(set(forms)) == len(forms)  # no class twice
    held = sorted(set(forms), key=len)
    missing = [n for n in seen if n not in set(forms)]
    # what went is near a line that stays, or near another that went
    assert all(any(alike(n, m) for m in [*held, *missing] if m != n and abs(len(m) - len(n)) <= 0.2 * max(len(m), len(n))) for n in missing)

    one = corpus_pipeline.store(stages["n-gram Jaccard join"](spark, lined, SF))
    sets = {i: sets_of(t) for i, t in got.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = component_ids(ids, links)
    assert sorted(rows(one)) == [i for i in ids if comp[i] == i]

    clean = corpus_pipeline.store(stages["benchmark decontamination"](spark, one, SF))
    texts = rows(one)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    order = sorted(texts)
    found = brute_contamination([texts[i] for i in order], items)
    assert sorted(rows(clean)) == [i for k, i in enumerate(order) if not found[k][-1]]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = {r["doc_id"]: r["ids_sha256"] for r in stages["BPE encoding and decoding"](spark, clean, SF).collect()}
    assert last == {i: hashlib.sha256(",".join(map(str, tokenizer.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest() for i, t in rows(clean).items()}


def normal_all(line):
    import re
    import string

    return " ".join(w for w in re.split(rf"[ \t\n\x0b\f\r{re.escape(string.punctuation)}]+", line.lower()) if w)


def test_stages_on_empty_tables_and_clashes(spark, tmp_path):
    """No documents, no labels and no items; null texts and ids; columns with the names that operators use."""
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    empty = frame(spark, [])
    odd = frame(spark, [(None, "a null id"), (1, None), (1, ""), (2, "x " * 3000), (2, "x " * 3000)])
    for c in ("score", "n_hit", "n_dropped", "keys", "tag", "__n_dropped", "node"):
        odd = odd.withColumn(c, odd["lang"])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0, name
        done = stage(spark, odd, str(tmp_path))
        assert done.count() > 0 and (name == "BPE encoding and decoding" or done.columns == odd.columns), name

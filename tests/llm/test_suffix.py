import hashlib
import random

import pytest

from corvane.llm import suffix
from tests.llm.helpers import frame, mixed, near_copies, prose


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            s = r[i : i + length]
            seen[s] = seen.get(s, 0) + 1
    out = {}
    for d, r in enumerate(raw):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest())
    return out


def check(spark, texts, length=suffix.LENGTH):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.digests(frame(spark, texts), length).collect()}
    want = brute(texts, length)
    assert got == want
    return want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_strings(spark, seed):
    want = check(spark, mixed(seed))
    assert 0 < sum(w[1] for w in want.values()) < sum(w[0] for w in want.values())


def test_edges_of_near_copies(spark):
    rng = random.Random(9)
    texts = []
    for edits in (1, 3, 6, 12):
        texts += near_copies(rng, prose(rng, 500), 5, edits)
    t = prose(rng, 300)
    texts += [t[:399], t[:400] + "!", "?" + t[:401], t[1:402], t[5:406] + t[:402]]
    check(spark, texts)


def test_repeats_inside_one_text(spark):
    rng = random.Random(2)
    p = prose(rng, 120)
    check(spark, [p + prose(rng, 50) + p, "z" * 401, "z" * 400, "q" * 399, "\x00" * 405])


def test_empty(spark):
    assert suffix.digests(frame(spark, [])).count() == 0
    rows = suffix.digests(frame(spark, [(None, "k" * 500), (7, "k" * 500), (7, None)])).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 0), (500, 500), (500, 500)]


def test_frequent_cores_change_nothing(spark, monkeypatch):
    """Every core that occurs twice is dealt out by its unions, and so is none."""
    texts = mixed(3)
    for often in (2, 10**9):
        monkeypatch.setattr(suffix, "SAMPLE", 1.0)
        monkeypatch.setattr(suffix, "OFTEN", often)
        check(spark, texts)


def test_clashing_columns(spark):
    df = frame(spark, ["k" * 500, "k" * 500 + "!", "short"]).withColumnRenamed("lang", "key").withColumnRenamed("source", "core").withColumnRenamed("n_chars", "spans")
    assert [r["n_removed"] for r in suffix.digests(df).orderBy("doc_id").collect()] == [500, 500, 0]
